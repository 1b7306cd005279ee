import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace import analyze, control
from millrace.operators.checksum import semantic_checksum
from millrace.plans.compile import ResultTooLarge
from millrace.plans.lazy import Cache, LazyPlan
from millrace.plans.lineage import Lineage
from millrace.plans.sqlgate import UnsupportedSQL
from millrace.workspace import workspace


def test_admission():
    a = control.Admission(slots=1, queue=2)
    assert a.submit() == (0, True)
    assert a.submit(1) == (1, False) and a.submit(5) == (2, False)
    with pytest.raises(control.QueueFull):
        a.submit()
    assert [a.release(0), a.release(2), a.release(1)] == [2, 1, None]
    with pytest.raises(ValueError, match="priority"):
        a.submit(11)


def test_budget(spark):
    with pytest.raises(ValueError, match="max_rows"):
        control.Budget(max_rows=0)
    assert control.within(spark, lambda: spark.range(5).count(), control.Budget(), "g") == 5
    slow = spark.range(4).repartition(4).mapInPandas(lambda it: (__import__("time").sleep(20) or x for x in it), "id bigint")
    with pytest.raises(Exception):  # noqa: B017  cancelled
        control.within(spark, slow.count, control.Budget(max_execution_ms=500), "slow")


def test_chaos(spark):
    df = spark.range(100)
    c = control.Chaos()
    for kind in ("delay", "skew"):
        c.arm(kind, partition=0, delay_ms=10)
        assert c.injected(df).count() == 100
    assert c.injected(df) is df and c.log == ["delay", "skew"]
    with pytest.raises(ValueError, match="kind"):
        c.arm("meteor")
    for kind in ("network_loss", "corrupted_input", "duplicate"):  # without retries, these fail
        c.arm(kind, partition=0)
        with pytest.raises(Exception, match=kind):
            c.injected(df).count()


RETRIES = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from millrace import analyze, control
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
df = spark.range(0, 1000, 1, 4)
for kind in control.FAULTS:
    c = control.Chaos()
    c.arm(kind, partition=1, occurrences=2, delay_ms=20)
    spark.sparkContext.setJobGroup(kind, kind)
    c.injected(df).write.mode("overwrite").parquet({out!r} + "/" + kind)
    rows = spark.read.parquet({out!r} + "/" + kind)
    a = analyze.autopsy(analyze.task_metrics(spark, kind)).first()
    print(kind, rows.count(), rows.distinct().count(), a["failed"], a["retried"])
spark.stop()
"""


def test_faults_are_retried(tmp_path):
    """With three attempts a task, from another folder: every row is there once, and the failed attempts are seen."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RETRIES.format(root=str(Path(__file__).resolve().parents[1]), out=str(tmp_path))
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    found = {x[0]: tuple(map(int, x[1:])) for x in map(str.split, got.stdout.splitlines()) if x and x[0] in control.FAULTS}
    assert found == {k: (1000, 1000, f, f) for k, f in (("delay", 0), ("network_loss", 2), ("corrupted_input", 2), ("duplicate", 2), ("skew", 0))}, got.stderr[-2000:]


def test_budgets_act(spark, sf):
    e = entry.own.engine(spark, sf, "orders")
    sql = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"
    want = sorted(map(tuple, e.sql(sql).collect()))
    cache = Cache()
    for how in ({}, {"combiner": False}, {"worker_limit": 2}, {"cache_level": "MEMORY_AND_DISK"}, {"skew_factor": 3.0}):
        run = control.execute(e, sql, control.Budget(**how), cache)
        assert sorted(map(tuple, run.rows)) == want, how
    assert cache.counters["misses"] == 1
    with pytest.raises(ResultTooLarge):
        control.execute(e, "SELECT o_orderkey FROM orders", control.Budget(max_rows=10))
    with pytest.raises(ValueError, match="speculation"):
        control.execute(e, sql, control.Budget(speculation=True))
    f = control.Feedback()
    for _ in range(2):
        control.execute(e, sql, control.Budget(), feedback=f)
    (k,) = f.known.values()
    assert k["runs"] == 2 and round(k["rows"], 9) == len(want)
    m = analyze.measured(e, sql, control.Budget(), control.Budget(combiner=False))
    assert m["matches"] and m["base_ms"] > 0


def test_task_metrics(spark, sf):
    spark.sparkContext.setJobGroup("metrics", "metrics")
    entry.own.engine(spark, sf, "lineitem").sql("SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag").collect()
    t = analyze.task_metrics(spark, "metrics")
    rows = t.collect()
    assert sum(r.rows_scanned for r in rows if r.bytes_scanned) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert all(r.status == "completed" and r.wall_ms >= 0 for r in rows) and analyze.autopsy(t).first()["attempts"] == len(rows) > 1
    with pytest.raises(ValueError, match="attempts"):
        analyze.task_metrics(spark, "metrics", most=0)


def test_workers(spark):
    w = [control.Worker(i, c) for i, c in (("zeta", ("scan",)), ("worker-10", ("scan", "join")), ("worker-2", ("scan", "join", "shuffle")), ("alpha", ("scan", "join")))]
    assert [x.id for x in control.scheduling_order(w)] == ["worker-2", "worker-10", "alpha", "zeta"]
    assert [x.id for x in control.scheduling_order(w, ("join",), 2)] == ["worker-2", "worker-10"]
    assert [x.id for x in control.scheduling_order(w, ("join", "shuffle"))] == ["worker-2"]
    assert [x.cores for x in control.registered(spark)] == [4]


def test_policies():
    assert control.speculation_threshold([]) is None
    assert control.speculation_threshold([400, 400, 400]) == 600
    f = control.Feedback()
    assert f.record("k", 10, 1)["rows"] == 10 and f.record("k", 20, 1, buckets=4, hot=True) == {"rows": 13.0, "straggler": 1.0, "buckets": 8, "runs": 2}
    assert control.fingerprint("a  b", "d") == control.fingerprint("a b", "d") != control.fingerprint("a b", "e")


def test_jobs_survive_their_process(spark, sf):
    root, e = workspace(spark, "jobs"), entry.own.engine(spark, sf, "region")
    j = control.Jobs(spark, root)
    j.submit("x", "SELECT r_name FROM region ORDER BY r_name")
    j.submit("x", "SELECT r_regionkey FROM region")  # known already
    later = control.Jobs(spark, root)
    assert later.resume(e) == ["x"] and control.Jobs(spark, root).resume(e) == [] and later.get("x")["attempts"] == 1
    rows = later.run(e, "x").orderBy("row_index").collect()
    assert len(rows) == 5 and "AFRICA" in rows[0].row
    with pytest.raises(ValueError, match="id"):
        j.submit("../x", "SELECT r_name FROM region")


def test_autopsy(spark):
    t = entry.own.tasks(spark)
    a = analyze.autopsy(t).first().asDict()
    assert (a["straggler_ratio"], a["bottleneck"], a["median_ms"]) == (10.0, "straggler", 100.0)
    assert "salt" in analyze.suggestions(a)[0]
    assert [r.task_id for r in analyze.longest_tasks(t).collect()] == ["t2", "t1", "t3"]
    spilled = t.withColumn("spill_bytes", F.lit(5).cast("long"))
    assert analyze.autopsy(spilled).first()["bottleneck"] == "memory_spill"
    assert analyze.autopsy(t.limit(0)).first()["bottleneck"] == "balanced"
    cancelled = t.withColumn("status", F.when(F.col("task_id") == "t2", "cancelled").otherwise("failed"))
    c = analyze.autopsy(cancelled).first()
    assert (c["failed"], c["recomputation"]) == (2, 100.0)
    assert analyze.autopsy(t.where("task_id <> 't3'")).first()["median_ms"] == 550.0
    busy = t.withColumns({"wall_ms": F.lit(100.0), "cpu_micros": F.lit(100_000).cast("long")})
    assert [analyze.autopsy(busy, ms).first()["bottleneck"] for ms in (100.0, 200.0)] == ["cpu_parallel", "balanced"]
    (o,) = analyze.operator_rollup(t).collect()
    assert (o.attempts, o.wall_ms, o.rows_produced, o.bytes_scanned, o.peak_memory_bytes, o.spill_bytes) == (3, 1200.0, 40, 400, 64, 0) and o.rows_per_second == 40 * 1000 / 1200


def test_what_if():
    w = analyze.what_if(1000, 2, 4)
    assert w["predicted_ms"] == 575 and w["confidence"] == "low"
    with pytest.raises(ValueError, match="workers"):
        analyze.what_if(1, 1, 33)
    same = {"combiner": True, "strategy": "auto"}
    assert analyze.what_if(1000, 2, **same)["predicted_ms"] == 1000 == analyze.what_if(1000, 2, warm_cache=True, cache_level="MEMORY")["predicted_ms"]
    assert analyze.what_if(1000, 2, combiner=True, current_combiner=False)["predicted_ms"] == 700


def test_bucket_bytes():
    assert analyze.bucket_bytes({0: 1, 1: 1, 2: 1, 3: 0}, 100) == {0: 33, 1: 33, 2: 34}


def test_explain(spark, sf):
    e = entry.own.engine(spark, sf, "orders")
    sql = "SELECT COUNT(*) AS n FROM orders WHERE o_custkey > 5"
    x = analyze.explain(e, sql)
    assert x["operation"] == "aggregate" and x["pushed"] == ["o_custkey>5"] and "FileScan" in x["physical"] or "Scan parquet" in x["physical"]
    assert analyze.explain_measured(e, sql, {"sql": sql, "tables": ["orders"], "ms": 3})["measured"]["ms"] == 3
    assert analyze.explain_measured(e, sql, {"sql": "SELECT 1", "tables": ["orders"]})["measured"] is None
    path = workspace(spark, "evidence")
    spark.createDataFrame([('{"sql": "SELECT 1", "ms": 4}',)], "value string").coalesce(1).write.text(path)
    assert analyze.evidence(spark, path)["ms"] == 4
    with pytest.raises(ValueError, match="overrides"):
        analyze.Workload(e).replay(colour="red")


def test_lazy(spark, sf):
    e = entry.own.engine(spark, sf, "orders")
    p = LazyPlan(e, "SELECT o_orderkey FROM orders WHERE o_orderkey < 10", ("filter", "select"))
    assert p.status == "lazy" and p.count() == len(p.collect()) and p.status == "executed"
    with pytest.raises(UnsupportedSQL):
        LazyPlan(e, "SELECT 1")
    with pytest.raises(ValueError, match="transformations"):
        LazyPlan(e, "SELECT o_orderkey FROM orders", ("explode",))


def test_cache(spark):
    c = Cache(budget=100)
    f = lambda: spark.range(3)
    a = c.get("a", f, 40)
    assert c.get("a", f, 40) is a
    c.get("b", f, 40, pinned=True)
    c.get("c", f, 40)
    assert list(c.entries) == ["b", "c"]
    c.get("d", f, 26, "MEMORY"), c.get("e", f, 500)
    assert c.counters == {"hits": 1, "misses": 5, "evictions": 1, "bypasses": 2}
    c.clear()


def test_recovery(spark):
    g = Lineage(spark)
    df = spark.range(10)
    step = lambda x: x.select("id", (F.col("id") % 2).cast("int").alias("part"))
    g.add("src", "source", "scan", frame=df)
    g.add("out", "transformation", "project", ["src"], frame=step(df), step=step)
    g.add_partitions("out", step(df), "part", [0, 1])
    with pytest.raises(ValueError, match="available"):
        g.recover("out/1")
    g.invalidate("out/1")
    g.frames["src"] = spark.range(99)  # not read: the parent is nearer
    assert g.recover("out/1").count() == 5
    g.frames["src"] = df
    g.invalidate("out/1")
    g.lose("out")
    assert g.recover("out/1").count() == 5  # by way of the source
    g.invalidate("out/0")
    g.frames["src"] = spark.range(11)
    with pytest.raises(RuntimeError, match="differs"):
        g.recover("out/0")
    g.lose("src")
    with pytest.raises(RuntimeError, match="ancestor"):
        g.recover("out/0")
    with pytest.raises(ValueError, match="partition"):
        g.invalidate("src")


def test_one_load_at_a_time(spark):
    import threading
    import time

    c, loads = Cache(), []

    def load():
        loads.append(1)
        time.sleep(0.3)
        return spark.range(3)

    threads = [threading.Thread(target=lambda: c.get("a", load, 10)) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(loads) == 1 and c.counters["hits"] == 5
    c.clear()


def test_checksum_does_not_depend_on_partitions(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    assert semantic_checksum(df).first() == semantic_checksum(df.repartition(7)).first()
