import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from driftspark.plans import catalog

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    text = lambda v: "NULL" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df.astype(object).itertuples(index=False)), list(df.columns)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_agree_with_sql(spark, sf, duck, name):
    assert plain(catalog.QUERIES[name](spark, sf).toPandas()) == plain(duck.execute(catalog.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for name in ("driftspark", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "driftspark/llm")], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_outside_imports_the_corpus_operators():
    for path in [*(ROOT / "driftspark").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts[:-1]:
            assert not re.search(r"^\s*(from|import)\s[^\n]*\bllm\b", path.read_text(), re.M), path
