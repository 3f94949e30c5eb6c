"""From raw documents to packed training sequences.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps. Every stage
but the last returns the columns of documents; each is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.llm import boilerplate, common, decontam, packing, quality, simhash
from vectide.llm.common import documents
from vectide.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and the lines that are frequent on their host."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go."""
    return boilerplate.remove_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing_stage),
]

#: SimHash and the tokenizer can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with common.Tables(spark) as own:
            docs = common.write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # what the stage wrote, and its input, has been read for the last time
        own.drop(but=1)
        if before:
            before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
