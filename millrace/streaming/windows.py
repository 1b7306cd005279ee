"""Event-time windows and event-level lateness, as batch operators. Times are milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import StreamConfig, StreamConfigError


def event_millis(column: str) -> Column:
    """Milliseconds of a timestamp (UTC). A value that is no time is null; :func:`checked` refuses it."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def checked(df: DataFrame, column: str, text: str) -> DataFrame:
    """df with ``column`` in milliseconds from ISO-8601 text; a value that is no time fails the batch."""
    t = F.expr(f"try_to_timestamp(`{text}`)")
    return df.withColumn(column, F.when(t.isNull(), F.raise_error(F.concat(F.lit("not an event time: "), F.coalesce(F.col(text), F.lit("null"))))).otherwise(F.unix_millis(t)))


def tumble_start(t: Column, size: int) -> Column:
    return F.floor(t / F.lit(size)) * F.lit(size)


def hop_starts(t: Column, slide: int, size: int) -> Column:
    """Starts of all windows that hold t: multiples of the slide in (t - size, t]; the size need be no multiple of it."""
    last = F.floor(t / F.lit(slide)) * F.lit(slide)
    n = -(-size // slide)
    starts = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: last - i * F.lit(slide))
    return F.filter(starts, lambda s: s > t - F.lit(size)).cast("array<bigint>")


def assigned(df: DataFrame, c: StreamConfig, t: str = "t") -> DataFrame:
    """df with window_start and window_end, a row for each window that an event is in. Sessions: the event's own span."""
    if c.window == "TUMBLE":
        out = df.withColumn("window_start", tumble_start(F.col(t), c.size).cast("long"))
    elif c.window == "HOP":
        out = df.withColumn("window_start", F.explode(hop_starts(F.col(t), c.slide, c.size)))
    elif c.window == "SESSION":
        return df.withColumn("window_start", F.col(t)).withColumn("window_end", F.col(t) + F.lit(c.gap))
    else:
        raise StreamConfigError(c.window)
    return out.withColumn("window_end", F.col("window_start") + F.lit(c.size))


def sessions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, window_start, window_end, ...) with ``session``: spans of a key that meet or touch have one.

    A session's number is its start. A key's spans are sorted in one task, as its sessions are; keys are dealt out.
    """
    by = Window.partitionBy(*keys).orderBy("window_start", "window_end")
    before = F.max("window_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("__new", F.when(before.isNull() | (F.col("window_start") > before), F.col("window_start")))
    return new.withColumn("session", F.last("__new", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def session_states(spans: DataFrame, keys: list[str], states: list[Column], merged: list[Column], width: int) -> DataFrame:
    """(keys, window_start, window_end, states) of the sessions of spans: first within blocks of ``width`` milliseconds of a key, then
    between these. So a task sorts a block's spans, or a key's local sessions, but never all spans of a key.

    states: aggregates of spans; merged: the same names from those, both mergeable in any order.
    """
    block = spans.withColumn("__block", F.floor(F.col("window_start") / F.lit(width)).cast("long"))
    local = sessions(block, [*keys, "__block"]).groupBy(*keys, "__block", "session").agg(F.max("window_end").alias("window_end"), *states)
    whole = sessions(local.withColumnRenamed("session", "window_start"), keys)
    return whole.groupBy(*keys, "session").agg(F.max("window_end").alias("window_end"), *merged).withColumnRenamed("session", "window_start")


def aggregates(c: StreamConfig) -> list[Column]:
    """event_count, total (missing values as 0), distinct_users (estimate) as the configuration asks."""
    out = [F.count("*").alias("event_count")]
    if c.total:
        out.append(F.sum(F.coalesce(F.col(c.total).cast("double"), F.lit(0.0))).alias("total"))
    if c.distinct:
        v = F.col(c.distinct).cast("string")
        out.append(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(v != "", v), c.precision)).alias("distinct_users"))
    return out


def windowed(events: DataFrame, c: StreamConfig, t: str = "t") -> DataFrame:
    """(window_start, window_end, group_key, ...) of accepted events, in batch. Missing group values are the empty key."""
    key = F.coalesce(F.col(c.group_by).cast("string"), F.lit("")) if c.group_by else F.lit("")
    spans = assigned(events.withColumn("group_key", key), c, t)
    if c.window != "SESSION":
        return spans.groupBy("window_start", "window_end", "group_key").agg(*aggregates(c))
    states, merged = [F.count("*").alias("event_count")], [F.sum("event_count").alias("event_count")]
    if c.total:
        states.append(F.sum(F.coalesce(F.col(c.total).cast("double"), F.lit(0.0))).alias("total"))
        merged.append(F.sum("total").alias("total"))
    if c.distinct:
        v = F.col(c.distinct).cast("string")
        states.append(F.hll_sketch_agg(F.when(v != "", v), c.precision).alias("users"))
        merged.append(F.hll_union_agg("users").alias("users"))
    out = session_states(spans, ["group_key"], states, merged, max(64 * c.gap, 3_600_000))
    names = ["window_start", "window_end", "group_key", "event_count", *(["total"] if c.total else [])]
    return out.select(*names, *([F.hll_sketch_estimate("users").alias("distinct_users")] if c.distinct else []))


def lateness(events: DataFrame, allowed: int, seq: str = "seq", t: str = "t", width: int = 100_000, before: int | None = None, tie: str | None = None) -> DataFrame:
    """events with watermark (before the event), late and accepted_late, by arrival order.

    An event is late where its time is at or before the greatest time of all earlier arrivals less ``allowed``, if that is
    over 0; accepted-late where it isn't late but earlier than that greatest time. ``seq`` is the place of arrival, ``before``
    the greatest time of earlier batches, and ``tie`` a column by which events of one place follow each other; places have to be
    unique without it, as the marks would depend on the order of rows. The running maximum is taken within blocks of
    ``width`` places and, over one row a block, between them, so no task holds all events.
    """
    block = F.floor(F.col(seq) / F.lit(width)).cast("long")
    tagged = events.withColumn("__b", block)
    tops = tagged.groupBy("__b").agg(F.max(t).alias("__top"))
    start = F.lit(before).cast("long")
    earlier = tops.select("__b", F.max("__top").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__was"))  # a row a block
    inner = F.max(t).over(Window.partitionBy("__b").orderBy(seq, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1))
    out = tagged.withColumn("__in", inner).join(earlier, "__b")
    top = F.greatest(F.col("__in"), F.col("__was"), start)
    mark = top - F.lit(allowed)
    late = F.coalesce((mark > 0) & (F.col(t) <= mark), F.lit(False))
    return out.select(*events.columns, mark.alias("watermark"), late.alias("late"), (~late & F.coalesce(F.col(t) < top, F.lit(False))).alias("accepted_late"))


def native(stream: DataFrame, c: StreamConfig, event_time: str = "ts") -> DataFrame:
    """The same windows with Spark's own watermark: late by window, and the watermark moves between batches only."""
    ms = lambda n: f"{n} milliseconds"
    e = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, ms(c.lateness))
    w = F.session_window(event_time, ms(c.gap)) if c.window == "SESSION" else F.window(event_time, ms(c.size), ms(c.slide)) if c.window == "HOP" else F.window(event_time, ms(c.size))
    key = F.coalesce(F.col(c.group_by).cast("string"), F.lit("")) if c.group_by else F.lit("")
    out = e.groupBy(w.alias("w"), key.alias("group_key")).agg(F.count("*").alias("event_count"), *([F.sum(F.coalesce(F.col(c.total).cast("double"), F.lit(0.0))).alias("total")] if c.total else []))
    return out.select(F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), *[x for x in out.columns if x != "w"])
