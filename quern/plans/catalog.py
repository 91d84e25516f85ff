"""One query for each operator on the star-schema tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.dataset import Context, Dataset
from quern.functions import scalar
from quern.ml.kmeans import KMeans
from quern.ml.metrics import classification_metrics, confusion, with_rates
from quern.ml.scaler import StandardScaler
from quern.ml.sgd import LOSSES, PENALTIES, SGDLinearModel
from quern.operators import joins, keyed, narrow, ordering, partitioning, sampling, sets
from quern.sinks import files as sinks
from quern.sources import files, memory, streams
from quern.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        name = f"q_{f.__name__}"
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(spark: SparkSession, sf: str, name: str, key: str, value: str) -> DataFrame:
    return table(spark, sf, name).select(F.col(key).alias("key"), F.col(value).alias("value"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (on one machine: in the warehouse)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/quern-{uuid.uuid4().hex}"


@query("SELECT l_returnflag AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def pipeline_slice(spark, sf):
    """The flagship: scan, filter, map, reduceByKey, sortByKey."""
    items = Dataset(table(spark, sf, "lineitem"))
    sums = items.filter("l_quantity > 25").map(F.col("l_returnflag").alias("key"), F.col("l_extendedprice").alias("value")).reduce_by_key("sum")
    return sums.map_values(F.round("value", 2)).sort_by_key().ordered()


def ranked(df: DataFrame) -> DataFrame:
    """The rows with ``_rank``, their places as they lie, partition after partition."""
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    return placed.withColumn("_rank", F.row_number().over(Window.orderBy("__place"))).drop("__place")


# Narrow operators


@query("SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")
def map(spark, sf):  # noqa: A001
    return narrow.map_rows(table(spark, sf, "lineitem"), "l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("SELECT o_orderkey, upper(o_orderpriority) AS p FROM orders")
def map_udf(spark, sf):
    return narrow.map_udf(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), lambda r: {"o_orderkey": r["o_orderkey"], "p": r["o_orderpriority"].upper()}, "o_orderkey long, p string")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 <> 0")
def filter(spark, sf):  # noqa: A001
    return narrow.filter_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), F.col("l_linenumber") % 2)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def flat_map_wordcount(spark, sf):
    """flatMap, map and reduceByKey."""
    words = Dataset(table(spark, sf, "documents")).flat_map(scalar.words("text"), "key").map("key", F.lit(1).cast("long").alias("value"))
    return words.reduce_by_key("sum").df.select(F.col("key").alias("word"), F.col("value").alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'B%'")
def filter_udf(spark, sf):
    return narrow.filter_udf(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), lambda r: r["c_mktsegment"].startswith("B"))


@query("SELECT o_orderkey, o_orderkey * 2 AS twice FROM orders")
def map_batches(spark, sf):
    import pyarrow as pa
    import pyarrow.compute as pc

    double = lambda b: pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(0), 2)], names=["o_orderkey", "twice"])
    return narrow.map_batches(table(spark, sf, "orders").select("o_orderkey"), double, "o_orderkey long, twice long")


@query("SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders")
def flat_map_udf(spark, sf):
    return narrow.flat_map_udf(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), lambda r: ({"o_orderkey": r["o_orderkey"], "part": p} for p in r["o_orderpriority"].split("-")), "o_orderkey long, part string")


@query("SELECT c_nationkey AS key, c_acctbal * 2 AS value FROM customer")
def map_values(spark, sf):
    return narrow.map_values(pairs(spark, sf, "customer", "c_nationkey", "c_acctbal"), F.col("value") * 2)


@query("SELECT c_nationkey AS key, unnest([c_custkey, c_custkey * 2]) AS value FROM customer")
def flat_map_values(spark, sf):
    return narrow.flat_map_values(pairs(spark, sf, "customer", "c_nationkey", "c_custkey"), F.array("value", F.col("value") * 2))


@query("SELECT c_nationkey AS key FROM customer")
def keys(spark, sf):
    return narrow.keys(pairs(spark, sf, "customer", "c_nationkey", "c_acctbal"))


@query("SELECT c_acctbal AS value FROM customer")
def values(spark, sf):
    return narrow.values(pairs(spark, sf, "customer", "c_nationkey", "c_acctbal"))


@query(
    """SELECT event_id, len(string_split(event_type, 'e')) AS pieces, TRY_CAST(split_part(props, ':', -1) AS DOUBLE) AS num,
       CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS code, round(1 / (1 + exp(-value / 100)), 6) AS s, event_type LIKE 'c%' AS c FROM events"""
)
def scalar_idioms(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.size(scalar.words("event_type", "e")).cast("long").alias("pieces"),
        scalar.number(scalar.after_last("props")).alias("num"),
        scalar.index_of("event_type", ["click", "view"]).alias("code"),
        F.round(scalar.sigmoid(F.col("value") / 100), 6).alias("s"),
        scalar.starts_with("event_type", "c").alias("c"),
    )


# Aggregations


@query("SELECT round(sum(l_quantity) / count(*), 6) AS mean FROM lineitem")
def aggregate_avg(spark, sf):
    return keyed.aggregate(table(spark, sf, "lineitem"), F.round(F.sum("l_quantity") / F.count("*"), 6).alias("mean"))


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS value FROM orders")
def reduce(spark, sf):
    return keyed.reduce(table(spark, sf, "orders"), "o_orderkey", "sum")


@query("SELECT count(*) AS count FROM lineitem")
def count(spark, sf):
    return keyed.count(table(spark, sf, "lineitem"))


@query("SELECT l_returnflag AS key, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def reduce_by_key(spark, sf):
    return keyed.reduce_by_key(pairs(spark, sf, "lineitem", "l_returnflag", "l_linenumber"), "sum")


@query("SELECT l_suppkey AS key, round(sum(l_quantity), 2) AS total, count(*) AS n, min(l_linenumber) AS least FROM lineitem GROUP BY 1")
def aggregate_by_key(spark, sf):
    items = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "key")
    return keyed.aggregate_by_key(items, F.round(F.sum("l_quantity"), 2).alias("total"), F.count("*").alias("n"), F.min("l_linenumber").alias("least"))


@query("SELECT c_mktsegment AS key, CAST(sum(c_custkey) AS BIGINT) AS value FROM customer GROUP BY 1")
def aggregate_by_key_udf(spark, sf):
    return keyed.aggregate_by_key_udf(pairs(spark, sf, "customer", "c_mktsegment", "c_custkey"), 0, lambda a, v: a + v, lambda a, b: a + b, "key string, value long")


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, count(*) AS n FROM orders")
def aggregate_udf(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return spark.createDataFrame([keyed.aggregate_udf(orders, (0, 0), lambda a, r: (a[0] + r[0], a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))], "total long, n long")


@query("SELECT o_custkey AS key, array_to_string(list_sort(list(o_orderkey)), ',') AS value FROM orders GROUP BY 1")
def group_by_key(spark, sf):
    return keyed.group_by_key(pairs(spark, sf, "orders", "o_custkey", "o_orderkey")).withColumn("value", F.array_join("value", ","))


@query("SELECT l_shipdate AS key, count(*) AS count FROM lineitem GROUP BY 1")
def count_by_key(spark, sf):
    return keyed.count_by_key(pairs(spark, sf, "lineitem", "l_shipdate", "l_quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def count_by_value(spark, sf):
    return keyed.count_by_value(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct(spark, sf):
    return keyed.distinct(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag"))


# Joins


#: Keys of both sides over the whole tables: repeats, nulls, and keys that only one side has.
_LEFT = "(SELECT nullif(c_custkey % 97, 0) AS key, c_custkey AS v FROM customer)"
_RIGHT = "(SELECT nullif(s_suppkey % 89, 0) + 10 AS key, s_suppkey AS v FROM supplier)"


def _sides(spark, sf):
    left = table(spark, sf, "customer").select(F.nullif(F.col("c_custkey") % 97, F.lit(0)).alias("key"), F.col("c_custkey").alias("value"))
    return left, table(spark, sf, "supplier").select((F.nullif(F.col("s_suppkey") % 89, F.lit(0)) + 10).alias("key"), F.col("s_suppkey").alias("value"))


@query(
    f"""WITH a AS (SELECT key, list_sort(list(v)) AS v FROM {_LEFT} GROUP BY 1), b AS (SELECT key, list_sort(list(v)) AS v FROM {_RIGHT} GROUP BY 1)
       SELECT coalesce(a.key, b.key) AS key, coalesce(array_to_string(a.v, ','), '') AS lefts, coalesce(array_to_string(b.v, ','), '') AS rights
       FROM a FULL JOIN b ON a.key IS NOT DISTINCT FROM b.key"""
)
def cogroup(spark, sf):
    return joins.co_group(*_sides(spark, sf)).withColumns({"lefts": F.array_join("lefts", ","), "rights": F.array_join("rights", ",")})


_JOINED = f'SELECT coalesce(a.key, b.key) AS key, a.v AS "left", b.v AS "right" FROM {_LEFT} a {{}} JOIN {_RIGHT} b ON a.key IS NOT DISTINCT FROM b.key'


@query(_JOINED.format("INNER"))
def join(spark, sf):
    return joins.join(*_sides(spark, sf))


@query(_JOINED.format("LEFT"))
def left_outer(spark, sf):
    return joins.left_outer_join(*_sides(spark, sf))


@query(_JOINED.format("RIGHT"))
def right_outer(spark, sf):
    return joins.right_outer_join(*_sides(spark, sf))


@query(_JOINED.format("FULL"))
def full_outer(spark, sf):
    return joins.full_outer_join(*_sides(spark, sf))


@query(
    """WITH a AS (SELECT nullif(c_nationkey % 5, 0) AS key, count(*) AS l FROM customer GROUP BY 1), b AS (SELECT nullif(s_nationkey % 5, 0) AS key, count(*) AS r FROM supplier GROUP BY 1)
       SELECT a.key AS key, l AS "left", r AS "right" FROM a JOIN b ON a.key IS NOT DISTINCT FROM b.key"""
)
def join_null_keys(spark, sf):
    sides = [keyed.count_by_key(table(spark, sf, t).select(F.nullif(F.col(c) % 5, F.lit(0)).alias("key"))).withColumnRenamed("count", "value") for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return joins.join(*sides)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cartesian(spark, sf):
    return joins.cartesian(table(spark, sf, "region").select("r_name"), table(spark, sf, "nation").select("n_name"))


_KEYS = "FROM (SELECT nullif(c_custkey % 40, 0) AS key FROM customer) a WHERE {} (SELECT 1 FROM (SELECT nullif(s_suppkey % 25, 0) AS key FROM supplier) b WHERE a.key IS NOT DISTINCT FROM b.key)"


def _keys(spark, sf):
    return table(spark, sf, "customer").select(F.nullif(F.col("c_custkey") % 40, F.lit(0)).alias("key")), table(spark, sf, "supplier").select(F.nullif(F.col("s_suppkey") % 25, F.lit(0)).alias("key"))


@query("SELECT a.key " + _KEYS.format("EXISTS"))
def semi_join(spark, sf):
    return joins.semi_join(*_keys(spark, sf))


@query("SELECT a.key " + _KEYS.format("NOT EXISTS"))
def anti_join(spark, sf):
    return joins.anti_join(*_keys(spark, sf))


# Set operations


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union(spark, sf):
    return sets.union(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT l_suppkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity < 10 INTERSECT SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 40")
def intersection(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity")
    return sets.intersection(items.where("l_quantity < 10").select("k", "n"), items.where("l_quantity > 40").select("k", "n"))


@query(
    """WITH a AS (SELECT nullif(l_linenumber, 3) AS n, l_returnflag AS f, l_linenumber < 4 AS low FROM lineitem)
       SELECT n, f FROM a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT n, f FROM a WHERE low) b WHERE b.n IS NOT DISTINCT FROM a.n AND b.f IS NOT DISTINCT FROM a.f)"""
)
def subtract(spark, sf):
    items = table(spark, sf, "lineitem").select(F.nullif("l_linenumber", F.lit(3)).alias("n"), F.col("l_returnflag").alias("f"), (F.col("l_linenumber") < 4).alias("low"))
    return sets.subtract(items.select("n", "f"), items.where("low").select("n", "f"))


# Order and position


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS _rank FROM orders")
def sort_by(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranked(ordering.sort_by(orders, F.struct("o_totalprice", "o_orderkey")))


@query("SELECT o_orderkey, p, row_number() OVER (ORDER BY p NULLS LAST, o_orderkey DESC) AS _rank FROM (SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS p FROM orders)")
def sort_by_partitions(spark, sf):
    """Ranges by number, nulls last, equal keys in the order of an earlier sort."""
    rows = Dataset(table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("p")))
    return ranked(rows.sort_by("o_orderkey", ascending=False).sort_by("p", partitions=5, nulls_first=False).ordered())


@query("SELECT c_custkey AS key, c_acctbal AS value, row_number() OVER (ORDER BY c_custkey DESC) AS _rank FROM customer")
def sort_by_key_desc(spark, sf):
    return ranked(ordering.sort_by_key(pairs(spark, sf, "customer", "c_custkey", "c_acctbal"), ascending=False))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def take(spark, sf):
    return ordering.take(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, "o_orderkey")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 7")
def top(spark, sf):
    return ordering.top(table(spark, sf, "events").select("event_id", "event_type"), 7, "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_by(spark, sf):
    return ordering.top_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 5, "o_totalprice", "o_orderkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 1")
def first(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return spark.createDataFrame([ordering.first(part, "p_partkey")], part.schema)


@query("SELECT o_orderkey AS value FROM orders WHERE o_custkey = 7")
def lookup(spark, sf):
    return ordering.lookup(pairs(spark, sf, "orders", "o_custkey", "o_orderkey"), 7)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS _rank FROM orders")
def collect_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("p")).repartition(7, "o_orderkey")
    rows = Context(spark).dataset(orders, "p").sort_by("o_orderkey").collect()
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "o_orderkey long, _rank long")


# Generators and sources


@query("SELECT range AS value FROM range(10, -5, -3)")
def range(spark, sf):  # noqa: A001
    return memory.range_of(spark, 10, -5, -3).drop("_pos")


@query("SELECT range * range AS value FROM range(1000)")
def source(spark, sf):
    return memory.source(spark, 1000, lambda i: i * i).drop("_pos")


@query("SELECT range AS i, CAST(range AS VARCHAR) || 'x' AS s FROM range(100)")
def source_udf(spark, sf):
    return memory.source_udf(spark, 100, lambda i: {"i": i, "s": f"{i}x"}, "i long, s string").drop("_pos")


@query("SELECT * FROM (VALUES ('hello', 1), ('hello', 2), ('world', 1)) t(key, value)")
def parallelize(spark, sf):
    return memory.parallelize(spark, [("hello", 1), ("hello", 2), ("world", 1)], "key string, value int").drop("_pos")


@query("SELECT * FROM orders")
def parquet_scan(spark, sf):
    return files.text_file(spark, f"{sf}/orders.parquet")


@query("SELECT c_name AS value FROM customer")
def text_file(spark, sf):
    path = scratch(spark)
    table(spark, sf, "customer").select("c_name").repartition(3).write.text(path)
    return files.text_file(spark, path)


@query("SELECT c_name AS value FROM customer")
def text_file_gzip(spark, sf):
    path = scratch(spark)
    table(spark, sf, "customer").select("c_name").repartition(3).write.option("compression", "gzip").text(path)
    return files.text_file(spark, path + "/*.gz")


@query("SELECT c_name || ' ' || c_custkey AS value FROM customer")
def line_stream(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name").toLocalIterator()
    return streams.line_stream(spark, (f"{r['c_name']} {r['c_custkey']}\n" for r in customers), scratch(spark))


@query("SELECT c_custkey AS a, c_name AS b FROM customer")
def object_stream(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name").toLocalIterator()
    return streams.object_stream(spark, ({"a": r["c_custkey"], "b": r["c_name"]} for r in customers), "a long, b string", scratch(spark))


# Sinks


@query("SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS p FROM orders")
def save_json(spark, sf):
    path = scratch(spark)
    sinks.save_json(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p")), path)
    return files.json_file(spark, path, "o_orderkey long, o_orderstatus string, p string")


@query("SELECT c_custkey, c_name FROM customer")
def save_json_gzip(spark, sf):
    path = scratch(spark)
    sinks.save_json(table(spark, sf, "customer").select("c_custkey", "c_name"), path, gzip=True)
    return files.json_file(spark, path, "c_custkey long, c_name string")


@query("SELECT c_custkey || ';' || c_name || ';' AS value FROM customer")
def save_csv(spark, sf):
    path = scratch(spark)
    sinks.save_csv(table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("int").alias("none")), path, sep=";")
    return files.text_file(spark, path)


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def save_parquet(spark, sf):
    path = scratch(spark)
    sinks.save_parquet(table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return spark.read.parquet(path)


_LINE = """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS line, row_number() OVER (ORDER BY c_custkey) AS _rank FROM customer"""


@query(_LINE)
def stream(spark, sf):
    lines = sinks.stream(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    return spark.createDataFrame([(x, i) for i, x in enumerate(lines, 1)], "line string, _rank long")


@query(_LINE)
def stream_gzip(spark, sf):
    import gzip

    members = sinks.stream_gzip(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    lines = gzip.decompress(b"".join(members)).decode().splitlines()
    return spark.createDataFrame([(x, i) for i, x in enumerate(lines, 1)], "line string, _rank long")


@query("SELECT 'id;name' AS value UNION ALL SELECT c_custkey || ';' || c_name FROM customer")
def save_csv_header(spark, sf):
    path = scratch(spark)
    sinks.save_csv(table(spark, sf, "customer").select("c_custkey", "c_name").coalesce(1), path, sep=";", header="id;name")
    return files.text_file(spark, path)


@query("SELECT c_name AS value FROM customer WHERE c_custkey % 3 = 0")
def text_file_max_files(spark, sf):
    """The first file by name, of three."""
    path = scratch(spark)
    for i in (0, 1, 2):
        table(spark, sf, "customer").where(F.col("c_custkey") % 3 == i).select("c_name").coalesce(1).write.text(f"{path}/part{i}")
    return files.text_file(spark, f"{path}/part*", max_files=1)


# Partitioning, persistence, sampling


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.spark_partition_id())


@query("SELECT key, n, 1 AS parts, true AS several FROM (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1)")
def partition_by_hash(spark, sf):
    """Each key lies in one partition, and there are several."""
    placed = _placed(partitioning.partition_by(pairs(spark, sf, "orders", "o_custkey", "o_orderkey"), partitioning.HashPartitioner(4)))
    by_key = placed.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("part").cast("int").alias("parts"), F.min("part").alias("part"))
    return by_key.withColumn("several", F.size(F.collect_set("part").over(Window.partitionBy())) == 4).drop("part")


@query("SELECT 4 AS parts, count(*) AS n, true AS apart FROM orders")
def partition_by_range(spark, sf):
    """The partitions' ranges of keys follow one another."""
    placed = _placed(partitioning.partition_by(pairs(spark, sf, "orders", "o_custkey", "o_orderkey"), partitioning.RangePartitioner(4)))
    ranges = placed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    after = ranges.withColumn("before", F.lag("high").over(Window.orderBy("part")))
    return after.agg(F.count("*").cast("int").alias("parts"), F.sum("n").alias("n"), F.bool_and(F.coalesce(F.col("before") < F.col("low"), F.lit(True))).alias("apart"))


@query("SELECT o_custkey AS key, o_orderkey AS value, CAST(o_custkey % 3 AS INTEGER) AS part FROM orders")
def partition_by_custom(spark, sf):
    """The partition of each row is the number that the expression gives."""
    return _placed(partitioning.partition_by(pairs(spark, sf, "orders", "o_custkey", "o_orderkey"), partitioning.CustomPartitioner(3, lambda k: k % 3)))


@query("SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS s, true AS held, false AS after FROM supplier")
def persist(spark, sf):
    rows = partitioning.persist(table(spark, sf, "supplier"))
    n, total = rows.agg(F.count("*"), F.sum("s_suppkey")).first()
    held = rows.storageLevel.useMemory
    partitioning.unpersist(rows)
    return spark.createDataFrame([(n, total, held, rows.storageLevel.useMemory)], "n long, s long, held boolean, after boolean")


def _bounds(df: DataFrame, drawn: DataFrame, again: DataFrame, mean: float, variance: float) -> DataFrame:
    """Whether a draw has about the rows it should (4 sigma), all of the table, and comes again with its seed."""
    total = df.agg(F.count("*").alias("total"))
    n = drawn.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_orderkey").alias("s"))
    other = again.agg(F.count("*").alias("n2"), F.sum("o_orderkey").alias("s2"))
    known = drawn.join(df, "o_orderkey", "left_anti").agg((F.count("*") == 0).alias("known"))
    within = F.abs(F.col("n") - mean * F.col("total")) <= 4 * F.sqrt(variance * F.col("total"))
    return total.crossJoin(n).crossJoin(other).crossJoin(known).select(within.alias("within"), ((F.col("n") == F.col("n2")) & (F.col("s") == F.col("s2"))).alias("repeats"), "known", (F.col("keys") < F.col("n")).alias("replaced"))


@query("SELECT true AS within, true AS repeats, true AS known, false AS replaced")
def sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    draw = lambda: sampling.sample(orders, False, 0.1, 7)
    return _bounds(orders, draw(), draw(), 0.1, 0.09)


@query("SELECT true AS within, true AS repeats, true AS known, true AS replaced")
def sample_with_replacement(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    draw = lambda: sampling.sample(orders, True, 0.5, 7)
    return _bounds(orders, draw(), draw(), 0.5, 0.5)


@query("SELECT 20 AS n, 20 AS keys, 0 AS unknown, true AS repeats, 30 AS replaced")
def take_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    drawn, again = (sampling.take_sample(orders, False, 20, 7) for _ in "ab")
    keys = {r[0] for r in drawn}
    unknown = 20 - orders.where(F.col("o_orderkey").isin(list(keys))).count()
    return spark.createDataFrame([(len(drawn), len(keys), unknown, drawn == again, len(sampling.take_sample(orders, True, 30, 7)))], "n int, keys int, unknown int, repeats boolean, replaced int")


@query("SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10 < 2")
def hash_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 2, 10)


# Machine learning


def _points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


_COMPONENTS = "SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(
    f"""WITH p AS ({_COMPONENTS}), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM p GROUP BY i)
       SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round((x - m) / d, 6) + 0.0 AS z FROM p JOIN s USING (i)"""
)
def scaler(spark, sf):
    points = _points(spark, sf)
    return points.select("vec_id", F.posexplode(StandardScaler.fit(points).transform()).alias("i", "z")).withColumn("z", F.round("z", 6) + 0.0)


def _labelled(spark, sf):
    items = table(spark, sf, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0)
    return items.select(label.alias("label"), F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features"))


@query(
    """SELECT round(-avg(y), 9) * -1 AS w0, round(avg(y * q), 9) AS w1, round(avg(y * d), 9) AS w2, round(avg(y * t), 9) AS w3
       FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0 END AS y, l_quantity / 50 AS q, l_discount * 10 AS d, l_tax * 10 AS t FROM lineitem)"""
)
def sgd_step(spark, sf):
    """One step of hinge loss from zero weights."""
    model = SGDLinearModel().fit(_labelled(spark, sf), 1)
    return spark.createDataFrame([tuple(round(w, 9) for w in (model.intercept, *model.weights))], "w0 double, w1 double, w2 double, w3 double")


@query()
def lr(spark, sf):
    model = SGDLinearModel(loss="log", proba=True).fit(_labelled(spark, sf).withColumn("label", (F.col("label") > 0).cast("double")), 10)
    return spark.createDataFrame([(i, w) for i, w in enumerate([model.intercept, *model.weights])], "i int, w double")


@query(
    "WITH "
    + "\n, ".join(
        [
            "p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0 END AS y, 1.0::DOUBLE AS x0, l_quantity / 50 AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3 FROM lineitem)",
            *(
                f"{loss}_{penalty}_{t} AS ("
                + (
                    "SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3"
                    if t == 0
                    else "SELECT "
                    + ", ".join(f"w{i} - {1 / t**0.5!r}::DOUBLE * (avg(g * x{i}) + " + {"l2": f"0.001 * w{i}", "l1": f"0.001 * sign(w{i})", "none": "0"}[penalty] + f") AS w{i}" for i in (0, 1, 2, 3))
                    + " FROM (SELECT *, " + {"hinge": "CASE WHEN y * m < 1 THEN -y ELSE 0.0 END", "log": "1 / (1 + exp(-m)) - greatest(y, 0)", "square": "m - y"}[loss] + f" AS g FROM (SELECT *, w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 AS m FROM p, {loss}_{penalty}_{t - 1})) GROUP BY w0, w1, w2, w3"
                )
                + ")"
                for loss in LOSSES
                for penalty in PENALTIES
                for t in (0, 1, 2, 3)
            ),
        ]
    )
    + "\n"
    + " UNION ALL ".join(f"SELECT '{loss}' AS loss, '{penalty}' AS penalty, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3 FROM {loss}_{penalty}_3" for loss in LOSSES for penalty in PENALTIES)
)
def sgd_losses(spark, sf):
    """Three steps of every loss with every penalty."""
    signed = _labelled(spark, sf).persist()
    out = []
    for loss in LOSSES:
        rows = signed.withColumn("label", F.greatest("label", F.lit(0.0))) if loss == "log" else signed
        for penalty in PENALTIES:
            model = SGDLinearModel(loss=loss, penalty=penalty).fit(rows, 3)
            out.append((loss, penalty, *(round(w, 6) for w in (model.intercept, *model.weights))))
    signed.unpersist()
    return spark.createDataFrame(out, "loss string, penalty string, w0 double, w1 double, w2 double, w3 double")


@query("SELECT l_orderkey, round(0.5 - l_quantity / 50 + 2 * l_discount * 10 + 0.25 * l_tax * 10, 6) AS margin, round(1 / (1 + exp(-(0.5 - l_quantity / 50 + 2 * l_discount * 10 + 0.25 * l_tax * 10))), 6) AS proba FROM lineitem")
def sgd_predict(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features"))
    margin, proba = (SGDLinearModel(weights=[-1.0, 2.0, 0.25], intercept=0.5, proba=p).predict() for p in (False, True))
    return items.select("l_orderkey", F.round(margin, 6).alias("margin"), F.round(proba, 6).alias("proba"))


def _first_means(spark, sf) -> list[list[float]]:
    """The vectors of the three smallest ids."""
    return [list(r["features"]) for r in _points(spark, sf).orderBy("vec_id").limit(3).collect()]


def _lloyd(rounds: int) -> str:
    """CTEs p, m0, a1, m1, ...: the components, the means and the assignments of each round."""
    out = [f"p AS ({_COMPONENTS})", "m0 AS (SELECT k - 1 AS c, i, x AS m FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings) USING (vec_id) WHERE k <= 3)"]
    for t in (1, 2, 3)[:rounds]:
        out.append(f"a{t} AS (SELECT vec_id, arg_min(c, (d, c)) AS c FROM (SELECT vec_id, c, sum((x - m) * (x - m)) AS d FROM p JOIN m{t - 1} USING (i) GROUP BY vec_id, c) GROUP BY vec_id)")
        out.append(f"m{t} AS (SELECT c, i, avg(x) AS m, count(*) AS n FROM p JOIN a{t} USING (vec_id) GROUP BY c, i)")
    return "WITH " + ", ".join(out)


@query(_lloyd(1) + " SELECT vec_id, CAST(c AS INTEGER) AS cluster FROM a1")
def kmeans_assign(spark, sf):
    return _points(spark, sf).select("vec_id", KMeans(3, _first_means(spark, sf)).predict().alias("cluster"))


@query(_lloyd(1) + " SELECT CAST(c AS INTEGER) AS cluster, n, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS mean FROM m1")
def kmeans_step(spark, sf):
    step = KMeans(3, _first_means(spark, sf)).step(_points(spark, sf))
    means = F.posexplode(F.array(*[c for c in step.columns if c not in ("cluster", "n")])).alias("i", "mean")
    return step.select("cluster", "n", means).withColumn("mean", F.round("mean", 6))


@query(_lloyd(3) + " SELECT CAST(c AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS mean FROM m3")
def kmeans_fit(spark, sf):
    """Three rounds from given means."""
    model = KMeans(3, _first_means(spark, sf), max_mse=0.0, max_iterations=3).fit(_points(spark, sf))
    return spark.createDataFrame([(c, i, round(x, 6)) for c, m in enumerate(model.means) for i, x in enumerate(m)], "cluster int, i int, mean double")


def _scored(spark, sf):
    return table(spark, sf, "labels").select(((F.col("doc_id") % 97) / F.lit(97.0)).alias("prediction"), F.col("quality").alias("label"))


@query(
    """WITH p AS (SELECT (doc_id % 97) / 97.0::DOUBLE AS p, quality > 0 AS y FROM labels), t AS (SELECT range AS i, range / 10::DOUBLE AS threshold FROM range(10)),
            c AS (SELECT threshold, count(*) FILTER (p > threshold AND y) AS tp, count(*) FILTER (p > threshold AND NOT y) AS fp, count(*) FILTER (p <= threshold AND y) AS fn, count(*) FILTER (p <= threshold AND NOT y) AS tn FROM p, t GROUP BY threshold)
       SELECT threshold, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
              round(tn / (tn + fp), 6) AS specificity, round(fp / (fp + tn), 6) AS fpr, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS j FROM c"""
)
def metrics(spark, sf):
    rates = ("precision", "recall", "accuracy", "specificity", "fpr", "f1", "j")
    return with_rates(confusion(_scored(spark, sf))).select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in rates])


@query(
    """WITH p AS (SELECT (doc_id % 97) / 97.0::DOUBLE AS p, quality > 0 AS y FROM labels), t AS (SELECT range / 10::DOUBLE AS threshold FROM range(10)),
            c AS (SELECT threshold, count(*) FILTER (p > threshold AND y) AS tp, count(*) FILTER (p > threshold AND NOT y) AS fp, count(*) FILTER (p <= threshold AND y) AS fn, count(*) FILTER (p <= threshold AND NOT y) AS tn FROM p, t GROUP BY threshold),
            r AS (SELECT threshold, fp / (fp + tn) AS fpr, tp / (tp + fn) AS recall, tp / (tp + fp) AS prec, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c),
            a AS (SELECT (fpr - lag(fpr) OVER w) * (recall + lag(recall) OVER w) / 2 AS area FROM r WINDOW w AS (ORDER BY fpr, threshold)),
            b AS (SELECT (recall - lag(recall) OVER w) * (prec + lag(prec) OVER w) / 2 AS area FROM r WINDOW w AS (ORDER BY recall, threshold))
       SELECT round((SELECT sum(area) FROM a), 6) AS au_roc, round((SELECT sum(area) FROM b), 6) AS au_pr, (SELECT arg_max(threshold, (f1, -threshold)) FROM r) AS threshold"""
)
def areas(spark, sf):
    m = classification_metrics(_scored(spark, sf))
    return spark.createDataFrame([(round(m.au_roc, 6), round(m.au_pr, 6), m.threshold)], "au_roc double, au_pr double, threshold double")


# Extensions


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf):
    out = windows.tumbling(table(spark, sf, "events"), "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), keys=("event_type",))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),
            g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
       SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM g GROUP BY user_id, k"""
)
def session_window(spark, sf):
    out = windows.sessions(table(spark, sf, "events"), "30 minutes", F.count("*").alias("n"), keys=("user_id",))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
