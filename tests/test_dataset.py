import gzip

import pytest
from pyspark.sql import functions as F

from quern import Context, CustomPartitioner, HashPartitioner, RangePartitioner
from quern.operators import joins, sampling


@pytest.fixture(scope="module")
def sc(spark):
    return Context(spark)


def flat(rows):
    return [r[0] for r in rows]


def kv(sc, rows, value="bigint", partitions=None):
    return sc.parallelize(rows, f"key string, value {value}", partitions)


def tuples(ds):
    return sorted(tuple(r) for r in ds.collect())


def test_parallelize_keeps_order(sc):
    assert flat(sc.parallelize([3, 1, 2], "int", 3).collect()) == [3, 1, 2]
    assert sc.parallelize([], "int").collect() == []


@pytest.mark.parametrize("args, want", [((6,), [0, 1, 2, 3, 4, 5]), ((2, 4), [2, 3]), ((10, -5, -3), [10, 7, 4, 1, -2]), ((5, 0), []), ((0, 1, 0.25), [0, 0.25, 0.5, 0.75])])
def test_range(sc, args, want):
    assert flat(sc.range(*args).collect()) == want


def test_source(sc):
    assert flat(sc.source(5, lambda i: i * i).collect()) == [0, 1, 4, 9, 16]
    assert [r["s"] for r in sc.source_udf(3, lambda i: {"s": f"<{i}>"}, "s string").collect()] == ["<0>", "<1>", "<2>"]


def test_map_filter_flat_map(sc):
    ints = sc.parallelize([1, 2, 3, 4], "bigint")
    assert ints.map((F.col("value") * 2 * 2).alias("value")).reduce("sum") == 40
    assert flat(ints.filter(F.col("value") % 2).collect()) == [1, 3]
    assert flat(ints.flat_map(F.array("value", "value")).collect()) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert sorted(flat(ints.map_udf(lambda r: {"w": r["value"] + 1}, "w long").collect())) == [2, 3, 4, 5]
    assert sorted(flat(ints.filter_udf(lambda r: r["value"] > 2).collect())) == [3, 4]


def test_filter_is_truthy(sc):
    numbers = sc.parallelize([(0.0,), (None,), (float("nan"),), (2.0,)], "v double")
    assert flat(numbers.filter(F.col("v")).collect()) == [2.0]


def test_map_values_and_keys(sc):
    data = kv(sc, [("hello", 1), ("world", 2), ("test", 4)])
    assert tuples(data.map_values(F.col("value") * 2)) == [("hello", 2), ("test", 8), ("world", 4)]
    two = kv(sc, [("hello", 1), ("world", 2)])
    assert [tuple(r) for r in two.flat_map_values(F.array("value", F.col("value") * 2)).collect()] == [("hello", 1), ("hello", 2), ("world", 2), ("world", 4)]
    pairs = sc.parallelize([(1, 2), (2, 4), (4, 6)], "key long, value long")
    assert flat(pairs.keys().collect()) == [1, 2, 4]
    assert flat(pairs.values().collect()) == [2, 4, 6]


def test_aggregates(sc):
    numbers = sc.parallelize([3, 5, 2, 7, 4, 8], "bigint", 2)
    row = numbers.aggregate(F.sum("value"), F.count("*"))
    assert row[0] / row[1] == 29 / 6
    assert numbers.aggregate_udf((0, 0), lambda a, r: (a[0] + r[0], a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1])) == (29, 6)
    assert sc.range(6).count() == 6
    assert sc.parallelize([1, 2, 3, 4], "bigint", 2).reduce("sum") == 10
    assert sc.parallelize([], "bigint").reduce("sum") is None


def test_by_key(sc):
    data = kv(sc, [("hello", 1), ("hello", 1), ("world", 1)])
    assert tuples(data.reduce_by_key("sum")) == [("hello", 2), ("world", 1)]
    assert tuples(data.aggregate_by_key(F.sum("value").alias("s"), F.count("*").alias("n"))) == [("hello", 2, 2), ("world", 1, 1)]
    assert tuples(data.aggregate_by_key_udf(0, lambda a, v: a + v, lambda a, b: a + b, "key string, value long")) == [("hello", 2), ("world", 1)]
    with pytest.raises(ValueError):
        data.aggregate_by_key()
    grouped = kv(sc, [("hello", 2), ("hello", 1), ("world", 1)]).group_by_key()
    assert tuples(grouped) == [("hello", [2, 1]), ("world", [1])]


def test_structured_accumulator(sc):
    rows = [("hello", (12, "a", "b")), ("hello", (10, "c", "d")), ("world", (5, "e", "f"))]
    data = sc.parallelize(rows, "key string, value struct<n:bigint,p:string,q:string>")
    out = data.aggregate_by_key(F.sum("value.n").alias("n"), F.array_sort(F.collect_list("value.p")).alias("p"))
    assert tuples(out) == [("hello", 22, ["a", "c"]), ("world", 5, ["e"])]


def test_counts_and_distinct(sc):
    data = sc.parallelize([(1, 2), (3, 4), (3, 6)], "key long, value long")
    assert data.count_by_key() == {1: 1, 3: 2}
    assert data.lookup(3) == [4, 6]
    assert sorted(sc.parallelize([(1, 2), (3, 4), (1, 2), (3, 4)], "a long, b long").count_by_value()) == [((1, 2), 2), ((3, 4), 2)]
    assert sorted(flat(sc.parallelize([1, 2, 3, 1, 4, 3, 5], "int").distinct().collect())) == [1, 2, 3, 4, 5]


def test_co_group(sc):
    a = kv(sc, [("hello", 1), ("world", 2), ("cedric", 3), ("cedric", 4)])
    b = kv(sc, [("cedric", 3), ("world", 4), ("test", 5)])
    assert tuples(a.co_group(b)) == [("cedric", [3, 4], [3]), ("hello", [1], []), ("test", [], [5]), ("world", [2], [4])]


def test_joins(sc):
    a = kv(sc, [("hello", 1), ("world", 2), ("world", 3)])
    b = kv(sc, [("cedric", 3), ("world", 4)])
    inner = [("world", 2, 4), ("world", 3, 4)]
    assert tuples(a.join(b)) == inner
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in a.left_outer_join(b).collect()), key=key) == sorted([*inner, ("hello", 1, None)], key=key)
    assert sorted((tuple(r) for r in a.right_outer_join(b).collect()), key=key) == sorted([*inner, ("cedric", None, 3)], key=key)
    assert sorted(tuple(r) for r in a.join(a).collect()) == [("hello", 1, 1), ("world", 2, 2), ("world", 2, 3), ("world", 3, 2), ("world", 3, 3)]


def test_null_keys_match(sc):
    a = kv(sc, [(None, 1), ("x", 2)])
    b = kv(sc, [(None, 3)])
    assert [tuple(r) for r in a.join(b).collect()] == [(None, 1, 3)]
    assert joins.join(a.df, b.df, null_safe=False).count() == 0
    assert sorted(joins.full_outer_join(a.df, b.df).collect(), key=str) == sorted([(None, 1, 3), ("x", 2, None)], key=str)


def test_cartesian(sc):
    pairs = sc.range(1, 7, 1, 3).cartesian(sc.range(7, 13, 1, 3)).collect()
    assert sorted(map(tuple, pairs)) == [(x, y) for x in range(1, 7) for y in range(7, 13)]


def test_sets(sc):
    assert flat(sc.range(1, 5).union(sc.range(5, 9)).collect()) == list(range(1, 9))
    ds = sc.range(3)
    assert flat(ds.union(ds).collect()) == [0, 1, 2, 0, 1, 2]
    assert sorted(flat(sc.range(1, 10).intersection(sc.range(5, 16)).collect())) == [5, 6, 7, 8, 9]
    a = sc.parallelize([(1, 1), (1, 1), (2, 3), (2, 4), (3, 5), (3, 5)], "a long, b long")
    b = sc.parallelize([(1, 1), (1, 1), (2, 3)], "a long, b long")
    assert tuples(a.subtract(b)) == [(2, 4), (3, 5), (3, 5)]


def test_sort_is_global_both_ways(sc):
    data = sc.parallelize([4, 6, 10, 5, 1, 2, 9, 7, 3, 0], "int", 3)
    want = [0, 1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert flat(data.sort_by("value").collect()) == want
    assert flat(data.sort_by("value", ascending=False).collect()) == want[::-1]
    assert [r["key"] for r in kv(sc, [("world", 2), ("cedric", 3), ("hello", 1)], partitions=2).sort_by_key().collect()] == ["cedric", "hello", "world"]


def test_positions(sc):
    data = sc.range(100)
    assert data.first()[0] == 0
    assert flat(data.take(3)) == [0, 1, 2]
    assert flat(data.top(3)) == [97, 98, 99]
    assert flat(data.sort_by("value", ascending=False).take(2)) == [99, 98]
    assert flat(data.sort_by("value", ascending=False).top(2)) == [1, 0]
    assert sc.parallelize([], "int").first() is None


def test_order_survives_partitioning(sc):
    data = sc.range(20).map(F.col("value").alias("key"), F.col("value")).partition_by(HashPartitioner(3))
    assert [r["key"] for r in data.collect()] == list(range(20))
    assert [r["key"] for r in data.top(2)] == [18, 19]
    assert [r["value"] for r in data.flat_map_values(F.array("value", -F.col("value"))).take(4)] == [0, 0, 1, -1]
    assert flat(sc.parallelize([5, 4, 3, 2, 1], "int", 3).union(sc.range(2)).collect()) == [5, 4, 3, 2, 1, 0, 1]


def test_no_sort_where_rows_lie_in_order(sc):
    assert "Sort" not in sc.range(9).filter("value > 3").ordered()._jdf.queryExecution().executedPlan().toString()


def test_sampling(sc):
    data = sc.range(100)
    assert 0 < data.sample(False, 0.1, 1).count() < 25
    assert 0 < data.sample(True, 0.5, 1).count() < 100
    assert len(data.take_sample(False, 4)) == 4
    assert len(data.take_sample(False, 200)) == 100
    assert len(data.take_sample(True, 150)) == 150
    assert data.take_sample(False, 0) == []
    assert sampling.hash_sample(data.df, "value", 10, 10).count() == 100


def test_partitioners(sc):
    data = kv(sc, [("hello", 1), ("world", 2), ("cedric", 3)])
    for p in (HashPartitioner(3), RangePartitioner(2)):
        assert tuples(data.partition_by(p)) == tuples(data)
    even = sc.range(10).map(F.col("value").alias("key"), F.col("value")).partition_by(CustomPartitioner(2, lambda k: k % 2))
    parts = even.df.select(F.spark_partition_id().alias("p"), (F.col("key") % 2).alias("m")).distinct().collect()
    assert sorted(map(tuple, parts)) == [(0, 0), (1, 1)]
    held = data.persist()
    assert held.count() == held.count() == 3
    held.unpersist()


def test_for_each(sc):
    sc.range(4).for_each(lambda r: None)


def test_for_each_runs_on_every_row(sc, spark):
    seen = spark.sparkContext.accumulator(0)
    sc.range(5).for_each(lambda r: seen.add(r["value"] + 1))
    assert seen.value == 15


def test_text_order_is_by_file(sc, tmp_path):
    """Small before large, plain and gzip: Spark packs the large file first."""
    (tmp_path / "a.txt").write_text("a0\na1\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(5000)))
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress("".join(f"c{i}\n" for i in range(300)).encode()))
    (tmp_path / "d.txt").write_text("d0\n")
    want = ["a0", "a1", *(f"b{i}" for i in range(5000)), *(f"c{i}" for i in range(300)), "d0"]
    lines = sc.text_file(f"{tmp_path}/*.txt*")
    assert flat(lines.collect()) == want
    assert lines.first()[0] == "a0" and flat(lines.take(4)) == want[:4] and flat(lines.top(3)) == want[-3:]
    assert flat(lines.flat_map(F.split("value", "b")).take(4)) == ["a0", "a1", "", "0"]
    assert flat(lines.union(lines).collect()) == want + want


def test_sort_options(sc):
    data = sc.parallelize([(2, "x"), (None, "y"), (1, "z")], "key int, value string")
    assert [r["key"] for r in data.sort_by_key(nulls_first=False).collect()] == [1, 2, None]
    assert [r["key"] for r in data.sort_by_key(False, nulls_first=True).collect()] == [None, 2, 1]
    assert [r["key"] for r in data.sort_by_key(nulls_first=False).top(2)] == [2, None]
    ranges = data.sort_by("value", partitions=2)
    assert ranges.df.rdd.getNumPartitions() == 2 and [r["value"] for r in ranges.collect()] == ["x", "y", "z"]


def test_facade(sc, tmp_path):
    a, b = kv(sc, [("x", 1), ("y", 2), ("y", 3), (None, 4)]), kv(sc, [("y", 5), (None, 6), ("z", 7)])
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, a.full_outer_join(b).collect()), key=key) == sorted([("x", 1, None), ("y", 2, 5), ("y", 3, 5), (None, 4, 6), ("z", None, 7)], key=key)
    assert sorted(r["value"] for r in a.semi_join(b).collect()) == [2, 3, 4] and [r["value"] for r in a.anti_join(b).collect()] == [1]
    assert [r["value"] for r in a.top_by(2, "value")] == [4, 3]
    assert sorted(flat(a.flat_map_udf(lambda r: [{"v": r["value"]}] * 2, "v long").collect())) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert a.hash_sample("value", 10, 10).count() == 4
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert sorted(flat(sc.json_file(str(tmp_path / "j.json"), "a long").collect())) == [1, 2]
    assert tuples(sc.csv_file(str(tmp_path / "c.csv"), "a long, b string", header=True)) == [(1, "x")]


def test_require_and_env(sc, tmp_path):
    (tmp_path / "shipped_module.py").write_text("def twice(x):\n    return 2 * x\n")
    sc.require(str(tmp_path / "shipped_module.py"))

    def use(r):
        import shipped_module

        return {"v": shipped_module.twice(r["value"])}

    assert sorted(flat(sc.range(3).map_udf(use, "v long").collect())) == [0, 2, 4]
    assert isinstance(sc.env, dict)


def test_folds_by_functions(sc):
    data = sc.parallelize([(k, i) for i in range(300) for k in ("a", None, f"k{i % 7}")], "key string, value long", 5)
    joined = data.aggregate_by_key_udf([], lambda a, v: [*a, v], lambda a, b: a + b, "key string, value array<long>")
    got = {r["key"]: sorted(r["value"]) for r in joined.collect()}
    assert got["a"] == got[None] == list(range(300)) and got["k3"] == list(range(3, 300, 7))
    assert sc.parallelize([], "key string, value long").aggregate_by_key_udf(0, lambda a, v: a + v, lambda a, b: a + b, "key string, value long").count() == 0
    assert sc.parallelize([], "bigint").aggregate_udf(0, lambda a, r: a + r[0], lambda a, b: a + b) == 0


def test_text_files(sc, tmp_path):
    for i, part in enumerate(["a\nb\r\n\nc", "d\n"]):
        (tmp_path / f"p{i}.txt").write_bytes(part.encode())
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress(b"e\nf\n"))
    assert sorted(flat(sc.text_file(f"{tmp_path}/").collect())) == ["", "a", "b", "c", "d", "e", "f"]
    assert sorted(flat(sc.text_file(f"{tmp_path}/*.gz").collect())) == ["e", "f"]
    assert flat(sc.text_file(f"{tmp_path}/p*.txt", max_files=1).collect()) == ["a", "b", "", "c"]
    assert sc.text_file(f"{tmp_path}/nothing*", max_files=2).count() == 0


def test_split_file_equals_whole(sc, tmp_path):
    lines = ["length,width,name", *(f"{i / 10},{i % 7},n{i % 3}" for i in range(150))]
    (tmp_path / "whole.csv").write_text("\n".join(lines))
    (tmp_path / "split").mkdir()
    for i in range(4):
        (tmp_path / "split" / f"part{i}.csv").write_text("\n".join(lines[40 * i : 40 * i + 40]) + "\n")
    for path in ("whole.csv", "split/", "split/*.csv"):
        assert sc.text_file(f"{tmp_path}/{path}").count() == 151


def test_streams(sc, tmp_path):
    path = tmp_path / "kv"
    path.write_text("1 1\n1 1\n2 3\n2 4\n3 5")
    with open(path) as f:
        assert flat(sc.line_stream(f).collect()) == ["1 1", "1 1", "2 3", "2 4", "3 5"]
    assert tuples(sc.object_stream([{"a": 1, "b": "x\ny"}, {"a": 2}], "a long, b string").map("a", F.coalesce("b", F.lit("-")))) == [(1, "x\ny"), (2, "-")]


@pytest.mark.parametrize("zipped", [False, True])
def test_save_json(sc, spark, tmp_path, zipped):
    out = str(tmp_path / "out")
    sc.range(10).save(out, gzip=zipped)
    assert sorted(int(x) for x in flat(sc.text_file(out).collect())) == list(range(10))
    assert any(p.suffix == ".gz" for p in (tmp_path / "out").iterdir()) == zipped
    nulls = str(tmp_path / "nulls")
    sc.parallelize([(1, None)], "a int, b string").save(nulls)
    assert flat(spark.read.text(nulls).collect()) == ['{"a":1,"b":null}']


def test_save_csv(sc, tmp_path):
    out = str(tmp_path / "csv")
    triples = sc.range(10).map(*[F.col("value").alias(c) for c in "abc"])
    triples.save(out, csv={"sep": ";"})
    assert sorted(flat(sc.text_file(out).collect())) == [f"{a};{a};{a}" for a in range(10)]
    titled = str(tmp_path / "titled")
    sc.parallelize([(1, None, "x,y")], "a int, b int, c string", 1).save(titled, csv={"sep": ",", "header": "A,B,C"})
    assert flat(sc.text_file(titled).collect()) == ["A,B,C", "1,,x,y"]


def test_save_parquet(sc, tmp_path):
    out = str(tmp_path / "t.parquet")
    sc.range(10).save(out, parquet={"compression": "gzip"})
    assert sorted(flat(sc.text_file(out).collect())) == list(range(10))


def test_stream(sc):
    assert list(sc.range(10).stream()) == [str(i) for i in range(10)]
    assert gzip.decompress(b"".join(sc.range(10).stream(gzip=True))).decode() == "".join(f"{i}\n" for i in range(10))
