import pytest
from pyspark.sql import functions as F

from millrace.functions import sketches
from millrace.plans.compile import ResultTooLarge
from millrace.sources import ingest, sinks
from millrace.workspace import workspace


def test_types(spark):
    df = spark.createDataFrame([("1", "x", "", "NaN"), ("2.5", "3", None, "1"), ("0", "4", " ", "2")], "age string, city string, blank string, odd string")
    assert ingest.infer_types(df) == {"age": "number", "city": "string", "blank": "number", "odd": "string"}
    assert set(ingest.infer_types(df.limit(0)).values()) == {"number"}


@pytest.mark.parametrize(("n", "p"), [(1, 3), (2, 3), (7, 3), (10, 5), (100, 4)])
def test_ranges(spark, n, p):
    df = spark.range(n).select(F.col("id"))
    parts = ingest.range_partitioned(df, p, ["id"]).collect()
    size = -(-n // p)
    assert {(r.id, r.part) for r in parts} == {(i, min(i // size, p - 1)) for i in range(n)}
    with pytest.raises(ValueError, match="partitions"):
        ingest.range_partitioned(df, 33)


def test_catalog(spark):
    path = workspace(spark, "csv") + ".csv"
    spark.createDataFrame([("north", "10", "1"), ("south", None, "2"), ("east", "5", "3")], "region string, sales string, units string").coalesce(1).write.option("header", True).csv(path)
    c = ingest.Catalog(spark, workspace(spark, "catalog"))
    d = c.ingest_csv("sales", path, 2)
    assert (d.rows, d.columns, d.version) == (3, {"region": "string", "sales": "number", "units": "number"}, 1)
    want = [("east", 5.0, 3.0), ("north", 10.0, 1.0), ("south", None, 2.0)]
    assert sorted(map(tuple, c.table("sales").collect())) == want
    c.switch_storage("sales", "csv")
    assert sorted(map(tuple, c.table("sales").collect())) == want
    c.running.add("sales")
    with pytest.raises(RuntimeError, match="running"):
        c.switch_storage("sales", "parquet")
    assert c.list().first()["storage"] == "csv"
    later = ingest.Catalog(spark, c.root)  # as another process finds it
    assert later.datasets == c.datasets and sorted(map(tuple, later.table("sales").collect())) == want
    assert c.ingest_csv("auto", path, None, part_bytes=1).partitions > 3
    with pytest.raises(ValueError, match=".csv"):
        c.ingest_csv("x", "/tmp/x.json")
    groups = ingest.row_group_stats(spark, d.path + "/*", "sales").collect()
    assert sum(g.n_rows for g in groups) == 3 and sum(g.n_null for g in groups) == 1
    with pytest.raises(ValueError, match="empty"):
        c.materialize("none", c.table("sales").limit(0))


def test_files_of_any_size_are_hashed(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 40_000
    (tmp_path / "a.csv").write_bytes(data)
    (r,) = ingest.digests(spark, f"file://{tmp_path}/a.csv", block=1 << 20).collect()
    assert r.sha256 == hashlib.sha256(data).hexdigest()


def test_scans_refuse(spark, sf, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"a,b\n1,2\n3,4\n5,6\n")
    with pytest.raises(ingest.NotParquet):
        ingest.parquet_scan(spark, f"file://{tmp_path}/x.parquet", ["a"])
    assert ingest.parquet_scan(spark, f"{sf}/region.parquet", ["r_name"], "r_regionkey < 2").count() == 2
    (tmp_path / "r.csv").write_text("a,b\n1,x\n2\n3,y\n")
    assert ingest.scan_rows(spark, f"file://{tmp_path}/r.csv", "b != 'x'", ragged=True).count() == 1
    with pytest.raises(Exception):  # noqa: B017  a row lacks a cell
        ingest.scan_rows(spark, f"file://{tmp_path}/r.csv", "b != 'x'").collect()


def test_objects(spark, sf):
    store = workspace(spark, "store")
    sinks.put_object(spark, store, "datasets", "r.parquet", f"file://{sf}/region.parquet")
    assert sinks.get_object(spark, store, "datasets", "r.parquet").count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.get_object(spark, store, "partitions", "r.parquet")
    with pytest.raises(ValueError, match="buckets"):
        sinks.put_object(spark, store, "other", "r", f"file://{sf}/region.parquet")


def test_topics_in_files(spark):
    folder = workspace(spark, "topics")
    sinks.publish_files(spark.range(10).selectExpr("id as t"), folder, "a")
    sinks.publish_files(spark.range(10, 15).selectExpr("id as t"), folder, "a")
    rows = sinks.parsed_events(spark.read.schema(sinks.MESSAGES).parquet(f"{folder}/a"), "t bigint").collect()
    assert sorted((r.seq, r.partition) for r in rows) == [(i, 0) for i in range(15)] and {r.t for r in rows} == set(range(15))
    with pytest.raises(ValueError, match="events"):
        sinks.publish_files(spark.range(10_001).selectExpr("id as t"), folder, "a")


def test_chaos_is_told(spark):
    from millrace.control import Chaos

    c = Chaos()
    c.arm("delay", delay_ms=1)
    assert [m["type"] for m in sinks.live(spark.range(2), "q", chaos=c)] == ["subscribed", "chaos", "row", "row", "complete"]
    c.arm("network_loss")
    assert [m["type"] for m in sinks.live(spark.range(2), "q", chaos=c)] == ["subscribed", "chaos", "error"]


def test_stats(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "b")], "x int, y string")
    s = {r.column_name: (r.n_rows, r.n_null, r.least, r.greatest, r.approx_distinct) for r in ingest.column_stats(df).collect()}
    assert s == {"x": (3, 1, "1", "3", 2), "y": (3, 0, "a", "b", 2)}


def test_sinks(spark):
    df = spark.range(2500).select("id")
    got = list(sinks.live(df.limit(2500), "q"))
    assert [m["type"] for m in got if m["type"] != "row"] == ["subscribed", "progress", "progress", "complete"]
    assert sinks.to_arrow(df, 2500).num_rows == 2500
    with pytest.raises(ResultTooLarge):
        sinks.to_arrow(df, 10)
    back = sinks.from_ipc(sinks.to_ipc(spark.createDataFrame([(1, 2.5, None)], "a int, b double, c date")))
    assert back.to_pylist() == [{"a": "1", "b": "2.5", "c": None}]
    path = workspace(spark, "rows")
    assert sinks.durable(df.orderBy("id"), path).where("row_index <> cast(get_json_object(row, '$.id') as bigint)").count() == 0
    assert sinks.replayed(path, spark, 2490).count() == 10
    with pytest.raises(ValueError, match="events"):
        sinks.publish_kafka(df.limit(0), "localhost:1", "t")
    out = workspace(spark, "export")
    sinks.export_csv(df, out)
    assert spark.read.option("header", True).csv(out).count() == 2500
    bad = df.select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("x"))
    assert list(sinks.live(bad, "q"))[-1]["type"] == "error"


def test_sketches_merge_and_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), ((F.col("id") * 7919) % 100_003 - 50_000).cast("double").alias("v"))
    est = df.agg(sketches.approx_distinct("k", 12).alias("d")).first()["d"]
    assert sketches.observed_error("approx_count_distinct", est, 20_000) <= 4 * sketches.configured_error("approx_count_distinct", precision=12)
    halves = df.groupBy((F.col("k") % 2).alias("h")).agg(sketches.distinct_sketch("k").alias("s"))
    merged = halves.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("d")).first()["d"]
    assert abs(merged - est) <= 0.02 * est
    q = df.agg(sketches.approx_percentile("v", 0.95).alias("q")).first()["q"]
    rank = df.where(F.col("v") <= q).count() / 60_000
    assert abs(rank - 0.95) <= sketches.configured_error("approx_percentile", capacity=200)
    z = df.select(F.when(F.col("k") < 10_000, "a").when(F.col("k") < 15_000, "b").otherwise(F.col("k").cast("string")).alias("z"))
    assert [(r["item"], r["n_rows"]) for r in sketches.heavy_hitters(z, "z", 2).collect()] == [("a", 30_000), ("b", 15_000)]
    a = sketches.bottom_k(df.distinct(), "v", 50).collect()
    assert a == sketches.bottom_k(df.distinct().repartition(7), "v", 50).collect()
    with pytest.raises(ValueError, match="precision"):
        sketches.approx_distinct("k", 3)


def test_bloom(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("v"))
    words = sketches.bloom_bits(df, "v", 8_192, 4)
    some = spark.range(0, 3000).select(F.when(F.col("id") < 2999, F.col("id").cast("string")).alias("v"))
    got = {r.v: r.might for r in sketches.bloom_might_contain(some, "v", words, 8_192, 4).collect()}
    assert all(got[str(i)] for i in range(500)) and got[None] is False
    assert sum(got[str(i)] for i in range(500, 2999)) < 250
