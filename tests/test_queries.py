"""The catalogue against DuckDB on the smallest tables, and the contract of the entry module."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from gyrelake import catalogue as queries

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in queries.ORACLE_SQL:
        assert got
        return
    found = duck.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_files(tmp_path):
    for item in ("gyrelake", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "gyrelake" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op')]; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
