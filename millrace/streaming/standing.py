"""Standing queries with exactly-once window state, an audit of late events, a ledger of batches and snapshots.

Each micro-batch of a Structured Streaming query reads the open windows of the last committed batch, adds its events and writes
the next version of them, the windows that it closed, its late events and, last, its ledger row. A batch is committed once its
ledger row is there, so a batch that is run again does nothing, and one that was cut off is done anew. A closed window is
written once and not read again: an event that could change it is late. Versions before the last two are deleted. Distinct
values and frequent items are sketches of bounded size; with ``exact``, exact counts are kept beside them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from ..functions.sketches import top_merged, top_of, top_sketch
from . import windows as W
from .config import DAY, StreamConfig, parse_statement

LEDGER = "batch_id bigint, events bigint, accepted bigint, accepted_late bigint, late bigint, first_seq bigint, last_seq bigint, top bigint, watermark bigint, offsets string, open_windows bigint, closed_windows bigint"
TOP = "struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"
STATE = f"window_start bigint, window_end bigint, group_key string, event_count bigint, total double, users binary, items {TOP}"
SHADOW = "window_start bigint, window_end bigint, group_key string, kind string, value string, n bigint"
KEYS = ["window_start", "window_end", "group_key"]
MAX_ITEMS = 10_000


def _states(c: StreamConfig) -> list:
    """Of events."""
    total = F.col(c.total).cast("double") if c.total else F.lit(0.0)
    v = F.col(c.distinct).cast("string") if c.distinct else F.lit(None).cast("string")
    return [
        F.count("*").alias("event_count"),
        F.sum(F.coalesce(total, F.lit(0.0))).alias("total"),
        F.hll_sketch_agg(F.when(v != "", v), c.precision).alias("users"),
        top_sketch("__item", MAX_ITEMS, c.sql_nulls).alias("items"),
    ]


def _merged() -> list:
    """Of states."""
    return [F.sum("event_count").alias("event_count"), F.sum("total").alias("total"), F.hll_union_agg("users").alias("users"), top_merged("items", MAX_ITEMS).alias("items")]


def _left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys, where a missing key equals itself."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(named, reduce(and_, [left[k].eqNullSafe(named[f"__{k}"]) for k in keys]), "left").drop(*[f"__{k}" for k in keys])


def _iso(column: str) -> Column:
    """Milliseconds as ISO-8601 text in UTC, in sessions of any time zone."""
    t = F.col(column)
    day = F.date_from_unix_date(F.floor(t / DAY).cast("int")).cast("string")
    part = lambda unit, n: F.floor(F.pmod(t, F.lit(unit * n)) / unit).cast("int")
    return F.when(t.isNotNull(), F.format_string("%sT%02d:%02d:%02d.%03dZ", day, part(3_600_000, 24), part(60_000, 60), part(1_000, 60), part(1, 1_000)))


@dataclass
class StandingQuery:
    """A registered query over events (seq, t, columns); ``t`` are milliseconds and ``seq`` places of arrival, unique together with
    the configuration's ``tie``, if it has one."""

    spark: SparkSession
    config: StreamConfig
    root: str
    listeners: list[Callable[[DataFrame], None]] = field(default_factory=list)
    _running = None

    # state on disk -------------------------------------------------------------------------------------------------

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/*") if self._exists("ledger") else self.spark.createDataFrame([], LEDGER)

    def late_events(self) -> DataFrame | None:
        done = [r["batch_id"] for r in self.ledger().where("late > 0").select("batch_id").collect()]
        return self.spark.read.parquet(*[f"{self.root}/late/{b}" for b in sorted(done)]) if done else None

    def _exists(self, name: str) -> bool:
        return workspace.exists(self.spark, f"{self.root}/{name}")

    def committed(self) -> tuple[int, int | None]:
        """The last committed batch (-1: none) and the greatest event time so far."""
        row = self.ledger().agg(F.max("batch_id").alias("b"), F.max("top").alias("t")).first()
        return (-1 if row["b"] is None else row["b"]), row["t"]

    def _read(self, kind: str, batch: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{batch}") if batch >= 0 and self._exists(f"{kind}/{batch}") else self.spark.createDataFrame([], schema)

    # one batch -----------------------------------------------------------------------------------------------------

    def process(self, events: DataFrame, batch: int) -> None:
        """Add a micro-batch. Batches come in order; one that is committed already is left out."""
        last, top = self.committed()
        if batch <= last:
            return
        c = self.config
        marked = W.lateness(events, c.lateness, before=top, tie=c.tie).persist()
        try:
            kept = marked.where(~F.col("late"))
            key = F.col(c.group_by).cast("string") if c.group_by else F.lit("")
            key = key if c.sql_nulls else F.coalesce(key, F.lit(""))
            item = F.col(c.frequent).cast("string") if c.frequent else F.lit(None).cast("string")
            spans = W.assigned(kept.withColumns({"group_key": key, "__item": item}), c)
            n = marked.agg(F.count("*").alias("events"), F.count_if(~F.col("late")).alias("accepted"), F.count_if("accepted_late").alias("accepted_late"), F.count_if("late").alias("late"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.greatest(F.max("t"), F.lit(top)).alias("top"))
            counts = n.first()
            mark = None if counts["top"] is None else counts["top"] - c.lateness
            state = self._read("state", last, STATE)
            if c.window == "SESSION":
                width = max(64 * c.gap, 3_600_000)
                fresh = W.session_states(spans, ["group_key"], _states(c), _merged(), width).select(*state.columns)
                merged = W.session_states(state.unionByName(fresh), ["group_key"], _merged(), _merged(), width)
            else:
                fresh = spans.groupBy(*KEYS).agg(*_states(c))
                merged = state.unionByName(fresh).groupBy(*KEYS).agg(*_merged())
            closed = (F.col("window_end") <= F.lit(mark)) & F.lit(mark is not None and mark > 0)
            merged = merged.select(*state.columns).withColumn("closed", F.coalesce(closed, F.lit(False)))
            path = f"{self.root}/merged/{batch}"
            merged.write.mode("overwrite").partitionBy("closed").parquet(path)
            both = self.spark.read.schema(f"{STATE}, closed boolean").parquet(path)
            done = both.where("closed").drop("closed")
            both.where("NOT closed").drop("closed").write.mode("overwrite").parquet(f"{self.root}/state/{batch}")
            done.write.mode("overwrite").parquet(f"{self.root}/closed/{batch}")
            sizes = {r["closed"]: r["count"] for r in both.groupBy("closed").count().collect()}
            if c.exact:
                self._shadow(spans, last, batch)
            marked.where("late").write.mode("overwrite").parquet(f"{self.root}/late/{batch}")
            part = F.col("partition").cast("int") if "partition" in marked.columns else F.lit(0)
            ends = marked.groupBy(part.alias("p")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))  # a row a partition of the source
            offsets = ends.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("p").cast("string"), F.array("first", "last")))))).alias("offsets")).first()["offsets"]
            row = (batch, counts["events"], counts["accepted"], counts["accepted_late"], counts["late"], counts["first_seq"], counts["last_seq"], counts["top"], mark, offsets, sizes.get(False, 0), sizes.get(True, 0))
            self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/{batch}")  # the commit
            for old in ("state", "shadow"):
                workspace.remove(self.spark, f"{self.root}/{old}/{last - 1}")
            workspace.remove(self.spark, path)
        finally:
            marked.unpersist()
        for tell in self.listeners:
            tell(self.snapshot())

    # results -------------------------------------------------------------------------------------------------------

    def _shadow(self, spans: DataFrame, last: int, batch: int) -> None:
        """Exact counts of values and items by window, beside the sketches."""
        c = self.config
        value = lambda kind, column: F.struct(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("value"))
        kinds = [value("distinct", c.distinct)] * bool(c.distinct) + [value("frequent", c.frequent)] * bool(c.frequent)
        if not kinds or c.window == "SESSION":
            return
        counted = F.col("v.value") != ""
        if c.sql_nulls:
            counted = (F.col("v.kind") == "frequent") | counted
        each = spans.select(*KEYS, F.explode(F.array(*kinds)).alias("v")).where(counted).groupBy(*KEYS, "v.kind", "v.value").agg(F.count("*").alias("n"))
        old = self._read("shadow", last, SHADOW)
        old.unionByName(each).groupBy(*KEYS, "kind", "value").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.root}/shadow/{batch}")

    def _windows(self) -> DataFrame:
        """The states of all windows as of the last committed batch."""
        batch, _ = self.committed()
        closed = [f"{self.root}/closed/{r['batch_id']}" for r in self.ledger().where("closed_windows > 0").select("batch_id").collect()]
        out = self._read("state", batch, STATE)
        return out.unionByName(self.spark.read.schema(STATE).parquet(*closed)) if closed else out

    def snapshot(self) -> DataFrame:
        """The windows of the last committed batch: bounds, key, counts, estimates, errors, status and epoch."""
        batch, top = self.committed()
        c = self.config
        mark = None if top is None else top - c.lateness
        status = F.when(F.col("window_end") <= F.lit(mark), "finalized").otherwise("open")
        return self._windows().select(*KEYS, "event_count", "total", F.hll_sketch_estimate("users").alias("distinct_users"), F.lit(1.04 / (2**c.precision) ** 0.5).alias("distinct_error"), status.alias("status"), F.lit(batch).cast("long").alias("epoch"))

    def top_items(self) -> DataFrame:
        """(window_start, group_key, item, n): the most frequent items of each window, count descending, then item, by their sketch."""
        from pyspark.sql import Window

        by = Window.partitionBy("window_start", "group_key").orderBy(F.desc("n"), "item")
        each = self._windows().select("window_start", "group_key", F.explode(top_of("items", self.config.top_k)).alias("e"))
        each = each.select("window_start", "group_key", F.col("e.item").alias("item"), F.col("e.count").alias("n"))
        return each.withColumn("r", F.row_number().over(by)).where(F.col("r") <= self.config.top_k).drop("r")

    def evaluation(self) -> DataFrame:
        """(window_start, window_end, group_key, exact_distinct, distinct_users, distinct_observed_error, frequency_observed_error) where
        exact counts are kept: the error of the distinct estimate, relative, and the largest one of an item's count, as a share
        of the events."""
        batch, _ = self.committed()
        shadow = self._read("shadow", batch, SHADOW)
        exact = shadow.where("kind = 'distinct'").groupBy(*KEYS).agg(F.count("*").alias("exact_distinct"))
        out = self._windows().select(*KEYS, "event_count", F.hll_sketch_estimate("users").alias("distinct_users"))
        items = self._windows().select(*KEYS, F.explode(top_of("items", self.config.top_k)).alias("e")).select(*KEYS, F.col("e.item").alias("value"), F.col("e.count").alias("n2"))
        gaps = _left(items, shadow.where("kind = 'frequent'"), [*KEYS, "value"]).groupBy(*KEYS).agg(F.max(F.abs(F.col("n2") - F.coalesce("n", F.lit(0)))).alias("gap"))
        both = _left(_left(out, exact, KEYS), gaps, KEYS)
        relative = F.when(F.col("exact_distinct") > 0, F.abs(F.col("distinct_users") - F.col("exact_distinct")) / F.col("exact_distinct"))
        return both.select(*KEYS, "exact_distinct", "distinct_users", relative.alias("distinct_observed_error"), (F.col("gap") / F.col("event_count")).alias("frequency_observed_error"))

    def materialize(self, path: str) -> DataFrame:
        """The snapshot as an immutable dataset, times as ISO text."""
        top = self.top_items().groupBy("window_start", "group_key").agg(F.max_by("item", F.struct("n", "item")).alias("top_item"))
        s = _left(self.snapshot(), top, ["window_start", "group_key"])
        s.select(_iso("window_start").alias("window_start"), _iso("window_end").alias("window_end"), "group_key", "event_count", "status", "distinct_users", "distinct_error", F.col("total").alias("revenue"), "top_item").write.parquet(path)
        return self.spark.read.parquet(path)

    # life ----------------------------------------------------------------------------------------------------------

    def start(self, stream: DataFrame, available_now: bool = False):
        """Start, or go on from the checkpoint. stream: a streaming DataFrame with seq and t."""
        writer = stream.writeStream.queryName(self.config.name).option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self.process)
        self._running = (writer.trigger(availableNow=True) if available_now else writer).start()
        return self._running

    def stop(self) -> None:
        if self._running is not None:
            self._running.stop()
            self._running = None


@dataclass
class Registry:
    """Standing queries by name; statements and configurations register and unregister them."""

    spark: SparkSession
    root: str
    queries: dict[str, StandingQuery] = field(default_factory=dict)

    def register(self, what: StreamConfig | str) -> StandingQuery | None:
        got = parse_statement(what) if isinstance(what, str) else what
        if isinstance(got, str):
            return self.unregister(got)
        if got.name in self.queries:
            raise ValueError(f"query {got.name} is registered already")
        self.queries[got.name] = q = StandingQuery(self.spark, got, f"{self.root}/{got.name}")
        return q

    def unregister(self, name: str) -> None:
        self.queries.pop(name).stop()
