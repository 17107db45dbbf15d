"""Every registered query runs; every one with SQL gives what DuckDB gives, on the smallest tables."""

import math
import zlib

import duckdb
import pytest

from vellum.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v if v is None or isinstance(v, str) else str(int(v)) if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    rows = sorted(str([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())
    if sql := registry.oracle_sql().get(name):
        want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in sorted(df.columns))} from ({sql})").fetchall()
        assert rows == sorted(str([plain(v) for v in r]) for r in want)


def test_hash_split(spark):
    for r in registry.queries()["hash_split"](spark, SF).collect():
        b = zlib.crc32(f"{r['doc_id']}:42".encode()) % 100
        assert r["split"] == ("train" if b < 90 else "valid" if b < 95 else "test")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
