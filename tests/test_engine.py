import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import aggregates, checksum, joins
from millrace.operators.joins import BucketStats, Strategy, choose_strategy, hot_buckets
from millrace.plans.compile import Engine, ResultTooLarge


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(repr(round(v, 9) if isinstance(v, float) else v) for v in (r[c] for c in cols)) for r in df.collect())


def oracle_rows(con, sql):
    r = con.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted(tuple(repr(round(v, 9) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v) for v in (x[i] for i in at)) for x in r.fetchall())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.own.SQL))
def test_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols, want = oracle_rows(con, entry.oracle_sql()[name])
    assert sorted(df.columns) == cols
    assert rows_of(df) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def differential(n=300):
    state, rows = 0x51F15E, []
    for i in range(n):
        state = (state * 1664525 + 1013904223) % (1 << 32)
        rows.append((i, ["north", "south", "east", "west"][state % 4], None if i % 17 == 0 else float(state % 1000), state // 7 % 20))
    return rows


def test_generated_statements(spark):
    rows = differential()
    df = spark.createDataFrame(rows, "id bigint, region string, amount double, units bigint").cache()
    e = Engine(spark, {"d": df})
    con = duckdb.connect()
    con.sql("CREATE TABLE d(id BIGINT, region VARCHAR, amount DOUBLE, units BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", rows)
    rng = random.Random(7)
    for i in range(24):
        op, v = rng.choice(["<", "<=", ">", ">=", "=", "!="]), rng.randrange(1000)
        sql = [
            f"SELECT id, region FROM d WHERE amount {op} {v} AND units >= {v % 20}",
            f"SELECT region, COUNT(*) AS n, COUNT(amount) AS m, SUM(amount) AS s FROM d WHERE units {op} {v % 20} GROUP BY region",
            f"SELECT COUNT(*) AS n, AVG(units) AS a, MIN(amount) AS lo, MAX(amount) AS hi FROM d WHERE region != 'north' AND amount {op} {v}",
            f"SELECT id, units FROM d WHERE id {op} {v % 300} ORDER BY id {'DESC' if i % 2 else 'ASC'} LIMIT {1 + v % 30}",
        ][i % 4]
        assert rows_of(e.sql(sql)) == oracle_rows(con, sql)[1], sql


def test_budget_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "k int, v double")
    e = Engine(spark, {"t": df})
    with pytest.raises(ResultTooLarge):
        e.collect("SELECT k FROM t", max_rows=2)
    assert [r.k for r in e.sql("SELECT k, v FROM t ORDER BY v").collect()] == [2, 3, 1]
    assert [r.k for r in e.sql("SELECT k, v FROM t ORDER BY v", zero_nulls=True).collect()] == [3, 2, 1]


def test_pushdown_and_pruning(spark, sf):
    e = Engine(spark, {"lineitem": spark.read.parquet(f"{sf}/lineitem.parquet")})
    plan = e.sql("SELECT SUM(l_quantity) AS s FROM lineitem WHERE l_discount > 0.05")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_discount,0.05)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_discount:double>" in plan
    assert "partial_sum" in plan


def test_strategies():
    m = joins.MIB
    assert choose_strategy(m, m) == Strategy.LOCAL
    assert choose_strategy(100 * m, 16 * m) == Strategy.BROADCAST
    assert choose_strategy(100 * m, 17 * m) == Strategy.HASH_SHUFFLE
    assert choose_strategy(20 * m, 10 * m) == Strategy.HASH_SHUFFLE


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strategies_of_columns(spark):
    m = joins.MIB
    sizes = [-1, 0, 1, 7, 20, m, m + 1, 2 * m, 10 * m, 16 * m, 16 * m + 1, 20 * m, 100 * m, 1 << 62, (1 << 63) - 1]
    pairs = spark.createDataFrame([(a, b) for a in sizes for b in sizes], "a bigint, b bigint")
    got = pairs.select("a", "b", joins.strategy_of(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == [str(choose_strategy(r["a"], r["b"])) for r in got]


def test_strategy_table_stays_off_the_driver(spark, sf):
    plan = plan_of(entry.queries()["join_strategy_table"](spark, sf))
    assert "LocalTableScan" not in plan and "Scan ExistingRDD" not in plan and plan.count("FileScan parquet") == 2


def test_nothing_is_combined_before_the_exchange(spark, sf):
    """Without the combiner, rows move one by one: no aggregate stands below the exchange, of scans, joins and states."""
    e = entry.own.engine(spark, sf, "orders", "customer", "lineitem")
    one, two = "SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", entry.own.JOIN_AGG
    states = aggregates.exchanged(aggregates.uncombined_states(e.tables["lineitem"], ["l_returnflag"], "l_quantity"), ["l_returnflag"])
    for df in (e.sql(one, combiner=False), e.sql(two, combiner=False), e.sql("SELECT SUM(l_quantity) AS s FROM lineitem", combiner=False), aggregates.final_reduce(states, ["l_returnflag"])):
        above, below = plan_of(df).split("REPARTITION_BY_NUM", 1)
        assert "HashAggregate" in above and "Aggregate" not in below
    assert "Aggregate" in plan_of(e.sql(one)).split("Exchange", 1)[1]
    assert rows_of(e.sql(one)) == rows_of(e.sql(one, combiner=False))


def test_bloom_filter_stands_before_the_exchange(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").where("p_size < 10")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    some = joins.bloom_reduced(line, part, F.col("l_partkey"), F.col("p_partkey"))
    whole = line.join(part, line["l_partkey"] == part["p_partkey"])
    assert "Exchange" not in plan_of(some).split("Subquery", 1)[0]  # the probe side stays where it is
    assert whole.count() <= some.count() <= 1.05 * whole.count() + 5 < line.count()
    assert rows_of(some.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_partkey")) == rows_of(whole.select("l_orderkey", "p_partkey"))
    null = spark.createDataFrame([(None,), ("1",), ("x",)], "k string")
    assert [r.k for r in joins.bloom_reduced(null, null.where("k = '1'"), F.col("k"), F.col("k")).collect()] == ["1"]


def test_sizes_are_checked():
    big = 100 * joins.MIB
    with pytest.warns(UserWarning, match="shuffle"):
        assert joins.affordable(Strategy.BROADCAST, big, big) == Strategy.HASH_SHUFFLE
    with pytest.warns(UserWarning, match="local"):
        assert joins.affordable(Strategy.LOCAL, big, joins.MIB) == Strategy.BROADCAST
    assert joins.affordable(Strategy.LOCAL, joins.MIB, joins.MIB) == Strategy.LOCAL


def test_salts_follow_the_share(spark):
    """A bucket with four fifths of the rows is dealt to about as many parts as it has mean buckets' rows; balanced keys to none."""
    skewed = spark.range(10_000).select(F.when(F.col("id") % 5 < 4, 1).otherwise(F.col("id")).alias("k"))
    (parts,) = joins.hot_salts(skewed, "k").values()
    assert 48 <= parts <= 56
    assert joins.hot_salts(spark.range(64_000).select(F.col("id").alias("k")), "k") == {} == joins.hot_salts(skewed.limit(0), "k")


def test_strategy_plans_and_checksums(spark, sf):
    e = entry.own.engine(spark, sf, "orders", "customer")
    sums, want = set(), {"broadcast": "BroadcastHashJoin", "hash_shuffle": "ShuffledHashJoin", "local": "BroadcastHashJoin"}
    for s, node in want.items():
        df = e.sql(entry.own.JOIN_AGG.replace("SUM(o.o_totalprice) AS total", "MAX(o.o_totalprice) AS total"), strategy=s)
        assert node in df._jdf.queryExecution().executedPlan().toString()
        sums.add(checksum.semantic_checksum(df).first()["checksum"])
    assert len(sums) == 1


def test_hot_buckets():
    assert hot_buckets([BucketStats(0, 90, 3), *(BucketStats(i, 10, 3) for i in (1, 2, 3))]) == [0]
    assert hot_buckets([BucketStats(0, 100, 1), BucketStats(1, 1, 1)]) == []
    assert hot_buckets([]) == []


def test_salted_join_keeps_every_pair(spark):
    probe = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 5 < 4, 1).otherwise(F.col("id") % 50).alias("k"))
    build = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).union(spark.createDataFrame([(1, 77)], "k bigint, w bigint"))
    a = joins.salted_join(probe, build, "k", salt_by=["id"]).select("id", "k", "w")
    assert rows_of(a) == rows_of(probe.join(build, "k").select("id", "k", "w"))
    assert joins.salted_join(probe.limit(0), build, "k").count() == 0


def test_states(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    on = aggregates.final_reduce(aggregates.partial_states(df, ["g"], "v"), ["g"])
    off = aggregates.final_reduce(aggregates.uncombined_states(df, ["g"], "v"), ["g"])
    assert rows_of(on) == rows_of(off)
    empty = aggregates.final_reduce(aggregates.partial_states(df.limit(0), [], "v"), []).collect()
    assert [tuple(r) for r in empty] == [(0, None, None, None, None)]


def test_legacy_states(spark):
    rows = [("a", 2, {"x": 3.0, "__min__x": 1.0, "__max__x": 2.0}), ("a", 1, {"x": 5.0, "__min__x": 5.0, "__max__x": 5.0}), ("b", 4, {})]
    got = {r.g: tuple(r)[1:] for r in aggregates.legacy_states(spark.createDataFrame(rows, "g string, count int, sums map<string,double>"), ["g"], ["x"]).collect()}
    assert got == {"a": (3, 8.0, 8 / 3, 1.0, 5.0), "b": (4, None, None, None, None)}


def test_canonical_values(spark):
    df = spark.createDataFrame([(1, 1.0, "1.00", " 1 ", "x", None, 0.1 + 0.2, True, "")], "a int, b double, c string, d string, e string, f string, g double, h boolean, i string")
    assert tuple(checksum.canonical(df).first()) == ("1", "1", "1", "1", "x", None, "0.3", "true", "")


def test_checksum_tells_rows_apart(spark):
    c = lambda rows: checksum.semantic_checksum(spark.createDataFrame(rows, "a string, b int")).first()["checksum"]
    assert c([("x", 1), ("y", 2)]) == c([("y", 2), ("x", 1)])
    assert c([("x", 1)]) != c([("x", 1), ("x", 1)])
    assert c([(None, 1)]) != c([("", 1)])
