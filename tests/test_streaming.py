import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.streaming import windows as W
from millrace.streaming.config import StreamConfig, StreamConfigError, parse_statement
from millrace.streaming.standing import Registry, StandingQuery
from millrace.workspace import workspace


def test_statements():
    c = parse_statement("register query q as select count(distinct u), sum(r) from t window tumble(ts, interval '1' second) watermark interval '2' seconds;")
    assert (c.window, c.size, c.lateness, c.distinct, c.total) == ("TUMBLE", 1000, 2000, "u", "r")
    assert parse_statement("UNREGISTER QUERY q") == "q"
    s = parse_statement("REGISTER QUERY q AS SELECT COUNT(*) FROM t WINDOW SESSION(ts, INTERVAL '1' MINUTE)")
    assert (s.window, s.gap) == ("SESSION", 60_000)
    for bad in ("SELECT 1", "REGISTER QUERY q AS SELECT x FROM t WINDOW HOP(ts, INTERVAL '1' SECOND)", "REGISTER QUERY q AS SELECT x FROM t WINDOW TUMBLE(ts, 5)"):
        with pytest.raises(StreamConfigError):
            parse_statement(bad)


@pytest.mark.parametrize("bad", [{"size": 50}, {"window": "HOP", "slide": 50}, {"window": "HOP", "slide": 2000}, {"lateness": -1}, {"precision": 12}, {"window": "COUNT"}])
def test_config_bounds(bad):
    with pytest.raises(StreamConfigError):
        StreamConfig(**({"name": "q", "topic": "t", "window": "TUMBLE", "size": 1000} | bad))


def ev(spark, rows, cols="seq bigint, t bigint"):
    return spark.createDataFrame(rows, cols)


def test_window_math(spark):
    one = ev(spark, [(0, 2500)])
    t = W.assigned(one, StreamConfig("q", "t", "TUMBLE", 1000)).first()
    assert (t.window_start, t.window_end) == (2000, 3000)
    hop = W.assigned(one, StreamConfig("q", "t", "HOP", 3000, slide=1000)).collect()
    assert sorted(r.window_start for r in hop) == [0, 1000, 2000]
    six = ev(spark, [(i, 1000 * i) for i in range(6)])
    assert W.assigned(six, StreamConfig("q", "t", "HOP", 3000, slide=1000)).count() == 18


def test_sessions_touch(spark):
    e = ev(spark, [(0, 0, "a", 2.0), (1, 500, "a", 3.0), (2, 2000, "a", 7.0), (3, 3000, "a", 5.0)], "seq bigint, t bigint, u string, r double")
    c = StreamConfig("q", "t", "SESSION", 1000, gap=1000, group_by="u", total="r")
    got = sorted((r.window_start, r.window_end, r.event_count, r.total) for r in W.windowed(e, c).collect())
    assert got == [(0, 1500, 2, 5.0), (2000, 4000, 2, 12.0)]


def brute_late(rows, allowed, before=None):
    top, out = before, []
    for seq, t in sorted(rows):
        mark = None if top is None else top - allowed
        late = mark is not None and mark > 0 and t <= mark
        out.append((seq, late, not late and top is not None and t < top))
        top = t if top is None else max(top, t)
    return out


@pytest.mark.parametrize("allowed", [0, 1000, 2500])
@pytest.mark.parametrize("width", [1, 3, 1000])
def test_lateness(spark, allowed, width):
    rows = [(i, (i * 7919) % 5003) for i in range(200)] + [(200, 5002), (201, 5002)]
    got = sorted((r.seq, r.late, r.accepted_late) for r in W.lateness(ev(spark, rows), allowed, width=width).collect())
    assert got == brute_late(rows, allowed)
    got = sorted((r.seq, r.late, r.accepted_late) for r in W.lateness(ev(spark, rows[:5]), allowed, before=4000).collect())
    assert got == brute_late(rows[:5], allowed, 4000)


def test_late_boundary(spark):
    rows = [(0, 2000), (1, 999), (2, 1000), (3, 1001)]
    assert [r.late for r in W.lateness(ev(spark, rows), 1000).orderBy("seq").collect()] == [False, True, True, False]
    assert [r.late for r in W.lateness(ev(spark, [(0, 0), (1, 0)]), 0).orderBy("seq").collect()] == [False, False]


@pytest.fixture(scope="module")
def shared_places(sf, tmp_path_factory):
    """Events of which six arrive at each place, months apart, the last of them first in the file."""
    folder = tmp_path_factory.mktemp("shared")
    duckdb.execute(f"COPY (SELECT event_id + k * 1000003 AS event_id, ts + k * INTERVAL 30 DAY AS ts, user_id + k * 15 AS user_id, event_type, value, props FROM range(6) r(k), '{sf}/events.parquet' ORDER BY 1 DESC) TO '{folder}/events.parquet'")
    return str(folder)


TIED = [
    "stream_late_audit",
    "stream_lateness_zero",
    "stream_accepted_late",
    "stream_finalized",
    "stream_epoch_snapshot",
    "stream_heavy_hitters",
    "stream_materialize",
    "stream_observed_error",
    "stream_session_merge",
]


@pytest.mark.parametrize("name", TIED)
def test_events_of_one_place_come_by_id(spark, shared_places, name):
    got = entry.queries()[name](spark, shared_places)
    sql = entry.oracle_sql()[name].replace("OVER (ORDER BY seq ROWS", "OVER (ORDER BY seq, event_id ROWS")
    assert sql != entry.oracle_sql()[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{shared_places}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.fixture(scope="module")
def untyped(sf, tmp_path_factory):
    """Events of which a seventh have no type, and a seventh an empty one."""
    folder = tmp_path_factory.mktemp("untyped")
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS event_type) FROM '{sf}/events.parquet') TO '{folder}/events.parquet'")
    return str(folder)


def equals_sql(spark, name, folder):
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["stream_heavy_hitters", "stream_materialize", "stream_epoch_snapshot", "stream_observed_error", "stream_windows_closed", "stream_batch_ledger"])
def test_missing_and_empty_types_are_groups(spark, untyped, name):
    equals_sql(spark, name, untyped)


@pytest.mark.parametrize("name", ["stream_heavy_hitters", "stream_materialize"])
def test_negative_places_are_not_lost(spark, sf, tmp_path, name):
    duckdb.execute(f"COPY (SELECT * REPLACE (event_id - 500 AS event_id) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet'")
    equals_sql(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["stream_materialize"])
def test_windows_of_missing_times(spark, sf, tmp_path, name):
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 11 > 0 THEN ts END AS ts) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet'")
    equals_sql(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["stream_materialize"])
def test_times_are_utc_in_any_session(spark, sf, name):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        equals_sql(spark, name, sf)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_materialized_times(spark):
    q = StandingQuery(spark, StreamConfig("many", "t", "TUMBLE", 1234), workspace(spark, "q"))
    q.process(ev(spark, [(0, -5), (1, 1_709_251_199_999), (2, None)]), 0)
    got = {(r.window_start, r.window_end) for r in q.materialize(workspace(spark, "m")).collect()}
    assert got == {("1969-12-31T23:59:58.766Z", "1970-01-01T00:00:00.000Z"), ("2024-02-29T23:59:59.888Z", "2024-03-01T00:00:01.122Z"), (None, None)}


def fixture():
    """600 events over 12 seconds, one accepted late and one too late."""
    rows = [(i, (i // 50) * 1000 + (i % 50) * 10, f"u{i % 40}", 1.0 + i % 23, f"/p{i % 3}") for i in range(600)]
    rows.append((600, 10_000, "u1", 7.0, "/p0"))
    rows.append((601, 1_000, "u2", 9.0, "/p1"))
    return rows


COLS = "seq bigint, t bigint, user_id string, revenue double, url string"
CONFIG = StreamConfig("clicks", "clicks", "TUMBLE", 1000, lateness=2000, distinct="user_id", total="revenue", frequent="url")


@pytest.mark.parametrize("cuts", [1, 3])
def test_standing_query(spark, cuts):
    q = StandingQuery(spark, CONFIG, workspace(spark, "q"))
    rows = fixture()
    step = -(-len(rows) // cuts)
    for b in range(cuts):
        part = ev(spark, rows[b * step : (b + 1) * step], COLS)
        q.process(part, b)
        q.process(part, b)  # again: does nothing
    ledger = q.ledger().agg(F.sum("events").alias("n"), F.sum("accepted").alias("a"), F.sum("accepted_late").alias("l"), F.sum("late").alias("x")).first()
    assert tuple(ledger) == (602, 601, 1, 1)
    s = q.snapshot().orderBy("window_start").collect()
    assert len(s) == 12 and sum(r.event_count for r in s) == 601
    assert sum(r.total for r in s) == sum(r[3] for r in rows[:601])
    assert {r.status for r in s if r.window_end <= 11_490 - 2000} == {"finalized"}
    assert all(abs(r.distinct_users - 40) <= 1 for r in s)
    assert [(r.t, r.user_id) for r in q.late_events().collect()] == [(1000, "u2")]
    top = q.top_items().where("window_start = 0").orderBy(F.desc("n"), "item").collect()
    assert [(r["item"], r["n"]) for r in top] == [("/p0", 17), ("/p1", 17), ("/p2", 16)]
    assert q.materialize(workspace(spark, "m")).count() == 12


def test_errors_are_told_for_any_number_of_values(spark):
    q = StandingQuery(spark, StreamConfig("many", "t", "TUMBLE", 1000, distinct="user_id", frequent="url", exact=True), workspace(spark, "q"))
    q.process(spark.range(50_001).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("t"), F.col("id").cast("string").alias("user_id"), F.lit("/").alias("url")), 0)
    r = q.evaluation().first()
    assert r.exact_distinct == 50_001 and r.distinct_observed_error < 0.03 and r.frequency_observed_error == 0


def test_cut_off_batch_is_done_anew(spark):
    q = StandingQuery(spark, CONFIG, workspace(spark, "q"))
    rows = fixture()
    q.process(ev(spark, rows[:300], COLS), 0)
    broken = StandingQuery(spark, CONFIG, q.root)
    broken._read("state", 0, "window_start bigint").write.mode("overwrite").parquet(f"{q.root}/state/1")  # half a batch, no ledger row
    again = StandingQuery(spark, CONFIG, q.root)
    again.process(ev(spark, rows[300:], COLS), 1)
    assert again.snapshot().agg(F.sum("event_count")).first()[0] == 601


def test_sessions_merge_across_batches(spark):
    c = StreamConfig("s", "t", "SESSION", 1000, gap=1000, lateness=60_000, group_by="user_id", total="revenue", frequent="url")
    q = StandingQuery(spark, c, workspace(spark, "q"))
    rows = [(0, 0, "a", 1.0, "/"), (1, 1800, "a", 2.0, "/"), (2, 900, "a", 4.0, "/x")]
    q.process(ev(spark, rows[:2], COLS), 0)
    assert q.snapshot().count() == 2
    q.process(ev(spark, rows[2:], COLS), 1)
    r = q.snapshot().collect()
    assert [(x.window_start, x.window_end, x.event_count, x.total) for x in r] == [(0, 2800, 3, 7.0)]


def test_files_restart_and_registry(spark):
    root, drop = workspace(spark, "root"), workspace(spark, "drop")
    registry = Registry(spark, root)
    q = registry.register(CONFIG)
    ev(spark, fixture()[:300], COLS).coalesce(1).write.parquet(drop)
    stream = lambda: spark.readStream.schema(COLS).parquet(drop)
    q.start(stream(), available_now=True).awaitTermination()
    ev(spark, fixture()[300:], COLS).coalesce(1).write.mode("append").parquet(drop)
    q.start(stream(), available_now=True).awaitTermination()
    assert q.snapshot().agg(F.sum("event_count")).first()[0] == 601
    with pytest.raises(ValueError, match="registered"):
        registry.register(CONFIG)
    registry.register("UNREGISTER QUERY clicks")
    assert not registry.queries


def test_bad_time_fails(spark):
    df = spark.createDataFrame([("not-a-date",)], "ts string")
    with pytest.raises(Exception, match="not an event time"):
        W.checked(df, "t", "ts").collect()
    ok = W.checked(spark.createDataFrame([("1970-01-01T00:00:02.500Z",)], "ts string"), "t", "ts").first()
    assert ok.t == 2500


def test_native_mode(spark):
    drop = workspace(spark, "native")
    spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:00.5", "a")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").write.parquet(drop)
    s = spark.readStream.schema("ts timestamp, k string").parquet(drop)
    run = W.native(s, StreamConfig("n", "t", "TUMBLE", 1000, group_by="k")).writeStream.outputMode("complete").format("memory").queryName("native_out").start()
    run.processAllAvailable()
    run.stop()
    assert spark.sql("SELECT event_count FROM native_out").first()[0] == 2
