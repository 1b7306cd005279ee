"""Explain, the partition explorer, query autopsy, what-if analysis and workload replay."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .control import Budget, execute
from .operators.checksum import semantic_checksum
from .operators.joins import bucket_of, size_of
from .plans.compile import Engine

TASKS = "task_id string, worker_id string, status string, attempt int, is_winner boolean, wall_ms double, rows_scanned bigint, bytes_scanned bigint, transferred_bytes bigint, cpu_micros bigint, peak_memory_bytes bigint, spill_bytes bigint, operator string, estimated_rows bigint, actual_rows bigint"


def cost(scan_bytes: int, shuffle_bytes: int, rows: int, partitions: int, combiner: bool = True, state_width: int = 32) -> dict[str, int]:
    """scan bytes + shuffle bytes + combiner output rows x state width."""
    out = min(rows, partitions * 1000) if combiner else rows
    return {"scan_bytes": scan_bytes, "shuffle_bytes": shuffle_bytes, "combiner_rows": out, "cost": scan_bytes + shuffle_bytes + out * state_width}


def explain(engine: Engine, sql: str, partitions: int = 8, combiner: bool = True) -> dict:
    """What a statement would do; nothing is run."""
    plan = engine.plan(sql)
    df = engine.sql(sql)
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tables = [plan.table.name, *([plan.join.table.name] if plan.join else [])]
    sizes = {t: size_of(engine.tables[next(n for n in engine.tables if n.lower() == t.lower())]) for t in tables}
    return {
        "operation": plan.operation, "tables": sizes, "pushed": [str(p.name) + p.op + str(p.value) for p in plan.predicates],
        "map": "filter and project, then a partial state a group" if plan.aggregates else "filter and project", "reduce": "merge states by group" if plan.aggregates else "append",
        "cost": cost(sum(sizes.values()), min(sizes.values()) if plan.join else 0, sum(sizes.values()) // 64, partitions, combiner), "physical": text,
    }


def explain_measured(engine: Engine, sql: str, evidence: dict | None) -> dict:
    """The explanation, with the measurements of a run if they are of the same statement and data."""
    out = explain(engine, sql)
    same = evidence is not None and " ".join(evidence["sql"].split()) == " ".join(sql.split()) and evidence.get("tables") == sorted(out["tables"])
    return out | {"measured": evidence if same else None}


def evidence(spark, path: str) -> dict:
    """A recorded run (a JSON object of sql, tables and measurements), from any store that Spark reads."""
    import json

    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def partition_explorer(df: DataFrame, column: str, buckets: int = 8, factor: float = 1.5) -> DataFrame:
    """(bucket, n_rows, share, is_hot, cv, skew_ratio) of the buckets that have rows; empty ones count in the mean."""
    if not 2 <= buckets <= 32:
        raise ValueError("buckets must be from 2 to 32")
    n = df.groupBy(bucket_of(F.col(column), buckets).alias("bucket")).agg(F.count("*").alias("n_rows"))
    all_ = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(n), "bucket", "left").select("bucket", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))  # as many rows as buckets
    w = Window.partitionBy()
    mean = F.avg("n_rows").over(w)
    return all_.select("bucket", "n_rows", (F.col("n_rows") / F.sum("n_rows").over(w)).alias("share"), (F.col("n_rows") > mean * factor).alias("is_hot"), (F.stddev_pop("n_rows").over(w) / mean).alias("cv"), (F.max("n_rows").over(w) / mean).alias("skew_ratio"))


def bucket_bytes(counts: dict[int, int], source_bytes: int) -> dict[int, int]:
    """Bytes by share of rows, rounded down; the last bucket with rows takes the rest, so they add up."""
    rows = sum(counts.values())
    some = sorted(b for b, n in counts.items() if n)
    out = {b: source_bytes * counts[b] // rows for b in some}
    if some:
        out[some[-1]] += source_bytes - sum(out.values())
    return out


def task_metrics(spark, group: str, most: int = 10_000) -> DataFrame:
    """The task attempts (columns of TASKS) of the jobs of a group, from Spark's status store, which the driver holds.

    The store keeps what spark.ui.retainedTasks allows; a group of more than ``most`` attempts is refused.
    """
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    tracker = sc.statusTracker()
    stages = sorted({s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds})
    rows = []
    for stage in stages:
        attempts = store.stageData(stage, False, jvm.java.util.ArrayList(), False, getattr(sc._gateway, "new_array")(jvm.double, 0))
        for a in range(attempts.size()):
            data = attempts.apply(a)
            name = "ShuffleMap" if data.shuffleWriteBytes() else "Result" if not data.shuffleReadBytes() else "Reduce"
            tasks = store.taskList(stage, data.attemptId(), most + 1)
            if len(rows) + tasks.size() > most:
                raise ValueError(f"group {group} has more than {most} task attempts")
            for i in range(tasks.size()):
                t = tasks.apply(i)
                if not t.taskMetrics().isDefined():
                    continue
                m = t.taskMetrics().get()
                status = {"SUCCESS": "completed", "KILLED": "cancelled", "FAILED": "failed"}.get(t.status(), "running")
                wall = float(t.duration().get()) if t.duration().isDefined() else float(m.executorRunTime())
                read = m.inputMetrics().recordsRead() + m.shuffleReadMetrics().recordsRead()
                made = m.outputMetrics().recordsWritten() + m.shuffleWriteMetrics().recordsWritten()
                rows.append((f"{stage}.{data.attemptId()}.{t.index()}.{t.attempt()}", t.executorId(), status, t.attempt() + 1, status == "completed", wall, read, m.inputMetrics().bytesRead(), m.shuffleWriteMetrics().bytesWritten() + m.resultSize(), m.executorCpuTime() // 1000, m.peakExecutionMemory(), m.memoryBytesSpilled(), name, 0, made))
    return spark.createDataFrame(rows, TASKS)


def accumulated(engine: Engine, sql: str, **how) -> tuple[list, dict[str, int]]:
    """The rows of a statement and its six accumulators, of committed task attempts only."""
    from uuid import uuid4

    from pyspark.sql import Observation

    spark, group, passed = engine.spark, f"accumulated-{uuid4().hex}", Observation()
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = engine.sql(sql, passed=passed, **how).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    shuffled = F.when(F.col("operator") == "ShuffleMap", F.col("transferred_bytes"))
    scanned = F.when(F.col("bytes_scanned") > 0, F.col("rows_scanned"))
    t = task_metrics(spark, group).where("is_winner").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("rows_scanned", scanned), ("bytes_shuffled_total", shuffled), ("bytes_scanned", F.col("bytes_scanned")), ("cpu_time_micros", F.col("cpu_micros")))]).first()
    return rows, {"rows_returned": len(rows), "rows_passed_filter": passed.get["rows"], **t.asDict()}


def autopsy(tasks: DataFrame, elapsed_ms: float | None = None) -> DataFrame:
    """One row on a run from its task attempts (columns of TASKS): counts, the straggler ratio, seven costs, the bottleneck.

    elapsed_ms: the run's own time; the longest task's where it is not given. Cancelled attempts are no failures.
    """
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    wall = F.sort_array(F.collect_list(F.when(done, F.col("wall_ms"))))  # a job's tasks
    a = tasks.agg(
        F.count("*").alias("attempts"), F.count_if(failed).alias("failed"), F.count_if(F.col("attempt") > 1).alias("retried"), wall.alias("w"), F.coalesce(F.max(F.when(done, F.col("wall_ms"))), F.lit(0.0)).alias("critical_ms"),
        F.coalesce(F.sum("bytes_scanned"), F.lit(0)).alias("storage"), F.coalesce(F.sum("transferred_bytes"), F.lit(0)).alias("communication"), (F.coalesce(F.sum("cpu_micros"), F.lit(0)) / 1000).alias("computation"),
        F.greatest(F.lit(0.0), F.coalesce(F.sum("wall_ms"), F.lit(0.0)) - F.coalesce(F.sum("cpu_micros"), F.lit(0)) / 1000).alias("waiting"), F.coalesce(F.max("peak_memory_bytes"), F.lit(0)).alias("memory"),
        F.coalesce(F.sum("spill_bytes"), F.lit(0)).alias("spill"), (F.coalesce(F.sum(F.when(failed, F.col("cpu_micros"))), F.lit(0)) / 1000).alias("recomputation"),
        F.avg(F.when(F.col("estimated_rows") > 0, F.abs(F.col("actual_rows") - F.col("estimated_rows")) / F.col("estimated_rows"))).alias("cardinality_error"),
    )
    n = F.size("w")
    median = F.when(n % 2 == 1, F.get("w", F.floor(n / 2).cast("int"))).otherwise((F.get("w", (n / 2 - 1).cast("int")) + F.get("w", (n / 2).cast("int"))) / 2)
    a = a.withColumn("median_ms", F.coalesce(median, F.lit(0.0))).withColumn("straggler_ratio", F.when(F.col("median_ms") > 0, F.col("critical_ms") / F.col("median_ms")).otherwise(1.0))
    elapsed = F.lit(elapsed_ms) if elapsed_ms is not None else F.col("critical_ms")
    slow = (F.col("median_ms") > 0) & (F.col("straggler_ratio") >= 2)
    kind = F.when(F.col("spill") > 0, "memory_spill").when(slow, "straggler").when(F.col("communication") > 0.5 * F.col("storage"), "network_shuffle").when(F.col("computation") > 2 * elapsed, "cpu_parallel").otherwise("balanced")
    return a.withColumn("bottleneck", kind).drop("w")


def operator_rollup(tasks: DataFrame) -> DataFrame:
    """By operator, the longest first: attempts, times, rows and bytes in and out, CPU, memory, spill and rates."""
    sums = {"wall_ms": "wall_ms", "rows_scanned": "rows_scanned", "rows_produced": "actual_rows", "bytes_scanned": "bytes_scanned", "transferred_bytes": "transferred_bytes", "cpu_micros": "cpu_micros", "spill_bytes": "spill_bytes"}
    out = tasks.groupBy("operator").agg(F.count("*").alias("attempts"), *[F.sum(c).alias(n) for n, c in sums.items()], F.max("peak_memory_bytes").alias("peak_memory_bytes"))
    rate = lambda c: F.when(F.col("wall_ms") > 0, F.col(c) * 1000 / F.col("wall_ms")).otherwise(0.0)
    return out.withColumns({"rows_per_second": rate("rows_scanned"), "bytes_per_second": rate("bytes_scanned")}).orderBy(F.desc("wall_ms"), "operator")


def longest_tasks(tasks: DataFrame, n: int = 3) -> DataFrame:
    return tasks.orderBy(F.desc("wall_ms"), "task_id").limit(n).select("task_id", "operator", "wall_ms")


def suggestions(a: dict) -> list[str]:
    """Advice on an autopsy row."""
    out = []
    if a["straggler_ratio"] >= 2:
        out.append("split or salt the skewed partition, or allow speculation")
    if a["failed"]:
        out.append("look into failed attempts")
    if a["storage"] and a["communication"] / a["storage"] > 0.5:
        out.append("combine before the shuffle")
    if a["spill"]:
        out.append("give tasks more memory or more partitions")
    if (a["cardinality_error"] or 0) > 0.5:
        out.append("refresh statistics")
    return out or ["no dominant pathology"]


def what_if(base_ms: float, workers: int, target_workers: int | None = None, combiner: bool | None = None, warm_cache: bool = False, strategy: str | None = None, current_strategy: str | None = "auto", winners: int = 0, current_combiner: bool = True, cache_level: str = "NONE") -> dict:
    """A projection by Amdahl's law with a parallel share of 0.85 and fixed factors for what differs from the run: the combiner, a
    warm cache where the run kept nothing, the join strategy."""
    target_workers = workers if target_workers is None else target_workers
    if not (1 <= target_workers <= 32 and 1 <= workers <= 32):
        raise ValueError("workers must be from 1 to 32")
    if strategy not in (None, "auto", "local", "broadcast", "hash_shuffle"):
        raise ValueError("unknown strategy")
    ratio = 0.15 + 0.85 * workers / target_workers
    if combiner is not None and combiner != current_combiner:
        ratio *= 0.7 if combiner else 1.35
    if warm_cache and cache_level == "NONE":
        ratio *= 0.78
    if strategy is not None and strategy != current_strategy:
        ratio *= 0.9
    return {"predicted_ms": max(1, round(base_ms * ratio)), "speedup": 1 / ratio, "confidence": "medium" if winners >= 4 else "low"}


def measured(engine: Engine, sql: str, base: Budget, changed: Budget) -> dict:
    """The run and its alternative, both measured: milliseconds of each, and whether their rows are the same."""
    one, two = execute(engine, sql, base), execute(engine, sql, changed)
    row = lambda r: tuple(sorted(r.asDict().items(), key=str))
    return {"base_ms": one.millis, "changed_ms": two.millis, "matches": sorted(map(row, one.rows), key=str) == sorted(map(row, two.rows), key=str)}


#: Overrides of a replay, by the fields of a budget.
OVERRIDES = ("worker_limit", "combiner", "speculation", "cache_level", "cache_bytes", "join_strategy", "skew_factor", "max_execution_ms")


@dataclass
class Workload:
    """Statements with the checksums and times of their first runs, to be run again under other settings."""

    engine: Engine
    steps: list[dict] = field(default_factory=list)

    def record(self, sql: str) -> dict:
        self.steps.append(self._run(sql, {}))
        return self.steps[-1]

    def replay(self, **overrides) -> list[dict]:
        if bad := [k for k in overrides if k not in OVERRIDES]:
            raise ValueError(f"unknown overrides: {', '.join(bad)}")
        out = []
        for s in self.steps:
            now = self._run(s["sql"], overrides)
            out.append({"sql": s["sql"], "matches": now["checksum"] == s["checksum"], "delta_ms": now["millis"] - s["millis"]})
        return out

    def _run(self, sql: str, how: dict) -> dict:
        run = execute(self.engine, sql, Budget(**how))
        spark, schema = self.engine.spark, self.engine.sql(sql).schema
        return {"sql": sql, "checksum": semantic_checksum(spark.createDataFrame(run.rows, schema)).first()["checksum"], "millis": run.millis}


@dataclass
class Metrics:
    """Counters and a histogram of query times."""

    bounds: tuple[float, ...] = (10, 50, 100, 500, 1_000, 5_000, 30_000)
    counts: list[int] = field(default_factory=lambda: [0] * 8)
    queries: int = 0
    rows: int = 0

    def timed(self, run: Callable[[], list]) -> list:
        began = time.perf_counter()
        out = run()
        ms = (time.perf_counter() - began) * 1e3
        self.counts[sum(ms > b for b in self.bounds)] += 1
        self.queries += 1
        self.rows += len(out)
        return out
