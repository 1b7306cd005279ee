"""Mergeable aggregate states: the map-side combiner, the same without it, and the final reduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("n", "s", "c", "lo", "hi")  # rows, sum, values, least, greatest


def _state(value: str) -> list[Column]:
    v = F.col(value)
    return [F.count("*").alias("n"), F.sum(v).alias("s"), F.count(v).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi")]


def partial_states(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One state for each group and input partition: what a map task with a combiner sends."""
    return df.groupBy(F.spark_partition_id().alias("part"), *keys).agg(*_state(value))


def uncombined_states(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One state for each row: what a map task without a combiner sends."""
    v = F.col(value)
    return df.select(*keys, F.lit(1).cast("long").alias("n"), v.alias("s"), F.when(v.isNotNull(), 1).otherwise(0).cast("long").alias("c"), v.alias("lo"), v.alias("hi"))


def exchanged(states: DataFrame, keys: list[str]) -> DataFrame:
    """States moved to the tasks of their keys, each row by itself; without keys, dealt out. What comes after combines behind the exchange."""
    n = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return states.repartition(n, *keys) if keys else states.repartition(n)


def legacy_states(partials: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Final values from states of an old form: count (rows of a group) and sums, a map from ``x`` to its sum, ``__max__x`` to its
    greatest and ``__min__x`` to its least value. Returns n_rows and sum_x, avg_x, min_x, max_x of each column; sums over no
    state are null, and means are by rows, as that form has it.
    """
    at = lambda name: F.element_at("sums", F.lit(name))
    aggs = [F.sum("count").cast("long").alias("n_rows")]
    for c in columns:
        aggs += [F.sum(at(c)).alias(f"sum_{c}"), F.min(at(f"__min__{c}")).alias(f"min_{c}"), F.max(at(f"__max__{c}")).alias(f"max_{c}")]
    out = partials.groupBy(*keys).agg(*aggs)
    means = [F.when(F.col("n_rows") > 0, F.col(f"sum_{c}") / F.col("n_rows")).alias(f"avg_{c}") for c in columns]
    return out.select(*keys, "n_rows", *[x for c, m in zip(columns, means, strict=True) for x in (f"sum_{c}", m, f"min_{c}", f"max_{c}")])


def final_reduce(states: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, total, mean, least and greatest of each group, from its states. Of no values, all but the count are null."""
    merged = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    count = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return merged.select(*keys, count.alias("n_rows"), F.col("s").alias("total"), F.when(F.col("c") > 0, F.col("s") / F.col("c")).alias("mean"), F.col("lo").alias("least"), F.col("hi").alias("greatest"))


def observed(df: DataFrame, name: str, **metrics: Column):
    """(df with counters, their Observation): accumulators that count committed tasks only."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in metrics.items()]), o
