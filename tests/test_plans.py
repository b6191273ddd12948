"""Every registered query of the reference side against its DuckDB statement, over whole tables."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from cardloom.plans.base import TABLES

PLANS = {}
ORACLES = {}
for _name in entry.PLANS:
    _m = __import__(f"cardloom.plans.{_name}", fromlist=["QUERIES"])
    PLANS |= _m.QUERIES
    ORACLES |= _m.ORACLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, duck, name):
    df = PLANS[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_names_and_entry(spark):
    assert set(ORACLES) <= set(PLANS) and set(PLANS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries when the llm folders and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    shutil.copytree(entry.ROOT + "/cardloom", tmp_path / "cardloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.ROOT + "/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op1') for k in q) and len(q) > 90"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "PATH", "HOME")})
