import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from weft.plans import catalogue, formats  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 8


def test_registries():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.sql(catalogue.ORACLE[name])
    assert sorted(expected.columns) == columns
    place = [expected.columns.index(c) for c in columns]
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in expected.fetchall())


@pytest.mark.parametrize("gone", [("weft/llm", "tests/llm"), ("weft/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_corpus_operators(tmp_path, gone):
    root = Path(__spark_entry__.__file__).resolve().parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache", *(Path(x).name for x in gone)))
    assert not (copy / "weft/llm").exists()
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert not said.returncode, said.stderr
    first, second = said.stdout.splitlines()
    assert set(first.split()) == set(catalogue.QUERIES) and set(second.split()) == set(catalogue.ORACLE)
