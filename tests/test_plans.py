"""Every catalogued query against its SQL in DuckDB, and properties of some plans."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.operators import keyed, ordering
from quern.plans import catalog
from quern.streaming import windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if isinstance(x, float) and not isinstance(x, bool):
            return repr(round(x, 6) + 0.0)
        return repr(float(x)) if isinstance(x, int) and not isinstance(x, bool) else repr(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.collect()
    assert rows, "a row that compares nothing proves nothing"
    assert normal(got.columns, rows) == normal(want.columns, want.fetchall())


def test_rows_only(spark):
    for name in catalog.QUERIES.keys() - catalog.ORACLES.keys():
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.pipeline_slice(spark, SF))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25.0)]" in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in text


def test_one_exchange_for_a_cogroup(spark):
    assert plan(catalog.cogroup(spark, SF)).count("Exchange hashpartitioning") == 1


def test_take_is_a_bounded_top(spark):
    assert "TakeOrderedAndProject" in plan(ordering.take(catalog.table(spark, SF, "orders"), 10, "o_orderkey"))


def test_aggregates_combine_before_the_shuffle(spark):
    assert "partial_sum" in plan(keyed.reduce_by_key(catalog.pairs(spark, SF, "lineitem", "l_returnflag", "l_linenumber")))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(2).write.parquet(folder)
    stream = windows.read_events(spark, folder, events.schema)
    q = windows.tumbling(stream, "1 day", F.count("*").alias("n"), late="40 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    want = windows.tumbling(events, "1 day", F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, want.collect()))
    assert isinstance(want.first()["window_start"], datetime.datetime)
