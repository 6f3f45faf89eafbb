"""Every query of the view engine against its SQL twin."""

import duckdb
import pytest

from lumenfold.plans.products import QUERIES

TABLES = ("part", "supplier", "events", "lineitem", "embeddings", "nation", "region")


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    q = QUERIES[name]
    ours = q.spark(spark, sf).toPandas()
    names = [k.split(":")[0] for k in q.keys]
    assert list(ours.columns) == [*names, *q.values]
    assert len(ours)
    if q.sql is None:
        return
    theirs = oracle.execute(q.oracle()).fetchdf()
    by = names or list(q.values)
    a, b = (x.sort_values(by).reset_index(drop=True) for x in (ours, theirs[list(ours.columns)]))
    assert len(a) == len(b)
    for c in a.columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("shuffles", ["1", "7"])
def test_partitions_dont_matter(spark, sf, shuffles):
    name = "q_fused_surface_adaptive"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(map(tuple, QUERIES[name].spark(spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        assert sorted(map(tuple, QUERIES[name].spark(spark, sf).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
