"""Every query with SQL is compared with DuckDB on the smallest tables; all others must run."""

import glob
import math
import os

import duckdb
import pytest

from pageloom.plans.catalog import ORACLE, QUERIES


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*columns).collect())
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(norm(r[k]) for k in at)) for r in cur.fetchall())


def test_names_follow_the_inventory():
    assert len(QUERIES) >= 70 and set(ORACLE) <= set(QUERIES)


def test_entry_works_without_the_training_folder(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_training", lambda: ({}, {}))
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE)


def test_the_rest_works_with_the_training_folders_deleted(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = tmp_path / "copy"
    shutil.copytree(root, there, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.parquet"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=there, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))], said.stderr
