"""Runtime control: admission, budgets, retries and speculation, fault injection, feedback between runs."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import math
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import workspace


class QueueFull(RuntimeError):
    """More queries wait than may."""


@dataclass
class Admission:
    """At most ``slots`` queries run and ``queue`` wait; a higher priority goes first, then the earlier arrival."""

    slots: int = 4
    queue: int = 100
    running: set[int] = field(default_factory=set)
    waiting: list[tuple[int, int]] = field(default_factory=list)
    _serial: itertools.count = field(default_factory=itertools.count)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def submit(self, priority: int = 0) -> tuple[int, bool]:
        """(ticket, whether it runs at once)."""
        if not -10 <= priority <= 10:
            raise ValueError("priority must be from -10 to 10")
        with self._lock:
            if len(self.running) >= self.slots and len(self.waiting) >= self.queue:
                raise QueueFull("the admission queue is full")
            ticket = next(self._serial)
            if len(self.running) < self.slots:
                self.running.add(ticket)
                return ticket, True
            heapq.heappush(self.waiting, (-priority, ticket))
            return ticket, False

    def release(self, ticket: int) -> int | None:
        """Free a slot; the ticket that runs next, if any."""
        with self._lock:
            self.running.discard(ticket)
            if not self.waiting:
                return None
            _, nxt = heapq.heappop(self.waiting)
            self.running.add(nxt)
            return nxt


@dataclass(frozen=True)
class Budget:
    max_execution_ms: int = 30_000
    max_rows: int = 100_000
    worker_limit: int = 0
    skew_factor: float = 1.5
    combiner: bool = True
    speculation: bool = False
    cache_level: str = "NONE"
    cache_bytes: int = 256 << 20
    join_strategy: str = "auto"

    def __post_init__(self):
        for name, low, high in (("max_execution_ms", 100, 300_000), ("max_rows", 1, 1_000_000), ("worker_limit", 0, 32), ("skew_factor", 1, 100), ("cache_bytes", 1 << 20, 4 << 30)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if self.join_strategy not in ("auto", "local", "broadcast", "hash_shuffle"):
            raise ValueError("join_strategy must be auto, local, broadcast or hash_shuffle")
        if self.cache_level not in ("NONE", "MEMORY", "DISK", "MEMORY_AND_DISK"):
            raise ValueError("unknown cache_level")

    def settings(self) -> dict[str, str]:
        """Session settings of this budget. A worker limit bounds the tasks that a stage has, and so those that run at once."""
        out = {"spark.sql.adaptive.skewJoin.skewedPartitionFactor": str(self.skew_factor)}
        if self.worker_limit:
            out |= {"spark.sql.shuffle.partitions": str(self.worker_limit), "spark.sql.files.maxPartitionNum": str(self.worker_limit), "spark.sql.files.minPartitionNum": str(self.worker_limit)}
        return out


def within(spark: SparkSession, run: Callable[[], object], budget: Budget, group: str) -> object:
    """run() in a job group of its own, which is cancelled when its time is up. Speculation can't be turned on in a running
    application: a budget that asks for it where the cluster has none is refused."""
    sc = spark.sparkContext
    if budget.speculation and sc.getConf().get("spark.speculation", "false") != "true":
        raise ValueError("speculation is a setting that the application starts with; see cluster_settings()")
    timer = threading.Timer(budget.max_execution_ms / 1e3, lambda: sc.cancelJobGroup(group))
    old = {k: spark.conf.get(k, None) for k in budget.settings()}
    sc.setJobGroup(group, group, interruptOnCancel=True)
    for k, v in budget.settings().items():
        spark.conf.set(k, v)
    timer.start()
    try:
        return run()
    finally:
        timer.cancel()
        sc._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@dataclass
class Run:
    """What one statement did under a budget."""

    rows: list
    millis: float
    group: str


def execute(engine, sql: str, budget: Budget, cache=None, feedback: Feedback | None = None) -> Run:
    """Run a statement with every field of the budget applied: time, rows, tasks, skew factor, combiner, speculation, join strategy,
    and the level at which its tables are kept in ``cache`` (of cache_bytes). With ``feedback``, the shuffle has as many
    buckets as earlier runs of the statement advise, and this run is recorded."""
    from .analyze import autopsy, task_metrics
    from .operators.joins import size_of
    from .plans.compile import Engine
    from .plans.lazy import Cache

    spark, group = engine.spark, f"run-{uuid.uuid4().hex}"
    tables = dict(engine.tables)
    if budget.cache_level != "NONE":
        cache = cache if cache is not None else Cache(budget.cache_bytes)
        tables = {n: cache.get(n, lambda df=df: df, size_of(df), budget.cache_level) for n, df in tables.items()}
    key = fingerprint(sql, ",".join(sorted(tables)), strategy=budget.join_strategy)
    advice = feedback.known.get(key) if feedback else None
    old = spark.conf.get("spark.sql.shuffle.partitions")
    if advice and not budget.worker_limit:
        spark.conf.set("spark.sql.shuffle.partitions", str(advice["buckets"]))
    began = time.perf_counter()
    try:
        rows = within(spark, lambda: Engine(spark, tables).collect(sql, budget.max_rows, strategy=budget.join_strategy, combiner=budget.combiner), budget, group)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    out = Run(rows, (time.perf_counter() - began) * 1e3, group)
    if feedback:
        ratio = autopsy(task_metrics(spark, group)).first()["straggler_ratio"]
        feedback.record(key, len(rows), ratio, buckets=int(advice["buckets"]) if advice else min(8, int(old)), hot=ratio >= 2)
    return out


@dataclass(frozen=True)
class Worker:
    """An executor."""

    id: str
    capabilities: tuple[str, ...] = ("scan", "join", "shuffle")
    host: str = ""
    cores: int = 0


_FIXED = re.compile(r"worker-(\d+)")


def scheduling_order(workers: list[Worker], needs: tuple[str, ...] = (), limit: int = 0) -> list[Worker]:
    """The workers that have what is needed, those with a fixed number first by number, the others by name; ``limit`` of them, or all."""
    order = lambda w: (0, int(m[1]), "") if (m := _FIXED.fullmatch(w.id)) else (1, 0, w.id)
    some = sorted((w for w in workers if set(needs) <= set(w.capabilities)), key=order)
    return some[:limit] if limit else some


def registered(spark: SparkSession) -> list[Worker]:
    """The executors that are registered now and alive (in local mode, the driver), from Spark's status store."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    live = [found.apply(i) for i in range(found.size())]
    workers = [Worker(x.id(), host=x.hostPort(), cores=x.totalCores()) for x in live if x.isActive()]
    return [w for w in workers if w.id != "driver"] or workers


def speculation_threshold(siblings: list[float]) -> float | None:
    """Milliseconds after which a task may be run a second time: max(250, 1.5 x the third quartile of its siblings)."""
    if not siblings:
        return None
    s = sorted(siblings)
    return max(250.0, float(math.ceil(1.5 * s[min(len(s) - 1, math.floor(0.75 * len(s)))])))


def cluster_settings() -> dict[str, str]:
    """Settings that a cluster starts with: three attempts a task, speculation by the third quartile."""
    return {"spark.task.maxFailures": "3", "spark.speculation": "true", "spark.speculation.quantile": "0.75", "spark.speculation.multiplier": "1.5", "spark.speculation.minTaskRuntime": "250ms"}


FAULTS = ("delay", "network_loss", "corrupted_input", "duplicate", "skew")


class InjectedFault(RuntimeError):
    """A fault that was asked for."""


@dataclass
class Chaos:
    """One fault rule at a time, for a partition or all, so many times."""

    kind: str | None = None
    partition: int | None = None
    left: int = 0
    delay_ms: int = 0
    log: list[str] = field(default_factory=list)

    def arm(self, kind: str, partition: int | None = None, occurrences: int = 1, delay_ms: int = 0) -> None:
        if kind not in FAULTS:
            raise ValueError(f"kind must be one of {', '.join(FAULTS)}")
        if not 0 <= delay_ms <= 30_000 or occurrences < 1:
            raise ValueError("delay_ms must be from 0 to 30000, occurrences 1 at least")
        self.kind, self.partition, self.left, self.delay_ms = kind, partition, occurrences, delay_ms

    def clear(self) -> None:
        self.kind, self.left = None, 0

    def injected(self, df: DataFrame) -> DataFrame:
        """df whose first attempts in the partition meet the fault; what is retried gives the same rows.

        delay and skew sleep; network_loss and corrupted_input fail before any row; duplicate fails behind the last one, as where
        a finished attempt is not heard of: its rows are made twice and committed once. Faults that fail need retries
        (spark.task.maxFailures over 1).
        """
        if self.kind is None or self.left < 1:
            return df
        workspace.ship(df.sparkSession)
        kind, partition, delay, times = self.kind, self.partition, self.delay_ms / 1e3, self.left
        self.log.append(kind)
        self.clear()

        def run(batches):
            task = TaskContext.get()
            hit = (partition is None or task.partitionId() == partition) and task.attemptNumber() < times
            if hit and kind in ("delay", "skew"):
                time.sleep(delay)
            if hit and kind in ("network_loss", "corrupted_input"):
                raise InjectedFault(kind)
            yield from batches
            if hit and kind == "duplicate":
                raise InjectedFault(kind)

        return df.mapInArrow(run, df.schema)


def fingerprint(sql: str, dataset: str, bindings: str = "", strategy: str = "auto") -> str:
    """SHA-256 of the statement with white space collapsed, its data and its strategy."""
    return hashlib.sha256("\0".join([" ".join(sql.split()), dataset, bindings, strategy]).encode()).hexdigest()


@dataclass
class Feedback:
    """Moving averages (0.7 old, 0.3 new) of result rows and straggler ratios by fingerprint, and bucket advice."""

    known: dict[str, dict[str, float]] = field(default_factory=dict)

    def record(self, key: str, rows: float, straggler: float, buckets: int = 8, hot: bool = False) -> dict[str, float]:
        old = self.known.get(key)
        mix = lambda name, v: v if old is None else 0.7 * old[name] + 0.3 * v
        self.known[key] = {"rows": mix("rows", rows), "straggler": mix("straggler", straggler), "buckets": min(8, 2 * buckets) if hot else buckets, "runs": (old or {"runs": 0})["runs"] + 1}
        return self.known[key]


@dataclass
class Jobs:
    """Submitted statements by id, each a small file in the shared folder, and their results, which are written once.

    A job that was cut off is found as interrupted by the next process, and is run again under the same id.
    """

    spark: SparkSession
    root: str

    def _put(self, job: dict) -> None:
        workspace.put_bytes(self.spark, f"{self.root}/jobs/{job['id']}.json", json.dumps(job).encode())

    def get(self, id: str) -> dict:
        return json.loads(workspace.get_bytes(self.spark, f"{self.root}/jobs/{id}.json"))

    def all(self) -> list[dict]:
        return [self.get(n.removesuffix(".json")) for n in workspace.names(self.spark, f"{self.root}/jobs") if n.endswith(".json")]

    def submit(self, id: str, sql: str, strategy: str = "auto") -> dict:
        """Note a job; one that is known already stays as it is."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", id):
            raise ValueError("an id has letters, digits, - and _")
        if not workspace.exists(self.spark, f"{self.root}/jobs/{id}.json"):
            self._put({"id": id, "sql": sql, "strategy": strategy, "status": "interrupted", "attempts": 0})
        return self.get(id)

    def run(self, engine, id: str) -> DataFrame:
        """The result, by running the job unless that is done. Rows come as JSON with their places."""
        from .sources import sinks

        job, out = self.get(id), f"{self.root}/results/{id}"
        if job["status"] != "completed":
            self._put(job | {"attempts": job["attempts"] + 1})
            if workspace.exists(self.spark, out):  # what a cut-off attempt left
                workspace.remove(self.spark, out)
            sinks.durable(engine.sql(job["sql"], strategy=job["strategy"]), out)
            self._put(job | {"attempts": job["attempts"] + 1, "status": "completed"})
        return self.spark.read.schema("row_index bigint, row string").parquet(out)

    def resume(self, engine) -> list[str]:
        """Run all interrupted jobs; their ids."""
        some = [j["id"] for j in self.all() if j["status"] == "interrupted"]
        for id in some:
            self.run(engine, id)
        return some
