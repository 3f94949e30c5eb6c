"""Every query over the driver's tables against the same in SQL, and the registry's contract."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from vectide.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings documents pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [x[0] for x in result.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, map(tuple, got.collect())), rows(columns, result.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(z, (int, float)) for z in x) else x == y


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name, column", [("spectral_clustering", "id"), ("fisher_vector_each", "id"), ("hamming_embedding", "qid")])
def test_query_sees_the_whole_table(spark, sf_dir, name, column):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert QUERIES[name](spark, sf_dir).select(column).distinct().count() == n


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_subpackage(tmp_path):
    """The entry, the package and its queries don't need the subpackage of training-data operators."""
    import shutil

    shutil.copytree(f"{REPO}/vectide", tmp_path / "vectide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
