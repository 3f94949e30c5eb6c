"""Thin queries over the operators of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import boilerplate, licenses, quality, suffixes, url_filter
from .common import documents

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_path())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .boilerplate import line_report

    return line_report(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Conversation -1 of the contract.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digest, format_chats

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digest(format_chats(turns.unionByName(probe), tokenizer_path()))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(documents(spark, sf_dir))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_chat": op4_chat,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {"op1_url_filter": url_filter.sql(), "op5_licenses": licenses.sql(), "op6_quality": quality.SQL, "op9_line_dedup": boilerplate.SQL, "op10_suffix_dedup": suffixes.SQL}
