"""Join strategies: choice by size, hints, Bloom reduction of the probe side, hot buckets and salted joins."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1 << 20
LOCAL_LIMIT, BROADCAST_LIMIT = 2 * MIB, 16 * MIB


class Strategy(StrEnum):
    AUTO = "auto"
    LOCAL = "local"
    BROADCAST = "broadcast"
    HASH_SHUFFLE = "hash_shuffle"


def choose_strategy(left_bytes: int, right_bytes: int, local_limit: int = LOCAL_LIMIT, broadcast_limit: int = BROADCAST_LIMIT, broadcast_ratio: float = 0.35) -> Strategy:
    """Local where both sides together are tiny, broadcast where one is small and much the smaller, else a shuffle."""
    small, large = sorted((max(0, left_bytes), max(0, right_bytes)))
    if small + large <= local_limit:
        return Strategy.LOCAL
    if small <= broadcast_limit and small <= broadcast_ratio * large:
        return Strategy.BROADCAST
    return Strategy.HASH_SHUFFLE


def strategy_of(left_bytes: Column, right_bytes: Column, local_limit: int = LOCAL_LIMIT, broadcast_limit: int = BROADCAST_LIMIT, broadcast_ratio: float = 0.35) -> Column:
    """:func:`choose_strategy` for columns of sizes, so that tables of sizes need not come to the driver."""
    left, right = F.greatest(F.lit(0), left_bytes.cast("long")), F.greatest(F.lit(0), right_bytes.cast("long"))
    small, large = F.least(left, right), F.greatest(left, right)
    local = small <= F.lit(local_limit).cast("long") - large  # their sum can be over 64 bits
    broadcast = (small <= F.lit(broadcast_limit)) & (small <= F.lit(float(broadcast_ratio)) * large)
    return F.when(local, F.lit(str(Strategy.LOCAL))).when(broadcast, F.lit(str(Strategy.BROADCAST))).otherwise(F.lit(str(Strategy.HASH_SHUFFLE)))


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of df."""
    return min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 62)


def affordable(strategy: Strategy, left_bytes: int, right_bytes: int) -> Strategy:
    """The strategy asked for where the sizes allow it; else the next that they allow, with a warning."""
    small = min(left_bytes, right_bytes)
    if strategy == Strategy.LOCAL and left_bytes + right_bytes > LOCAL_LIMIT:
        warnings.warn(f"a local join of {left_bytes + right_bytes} bytes is over {LOCAL_LIMIT}: broadcast or shuffle instead", stacklevel=3)
        strategy = Strategy.BROADCAST
    if strategy == Strategy.BROADCAST and small > BROADCAST_LIMIT:
        warnings.warn(f"a broadcast of {small} bytes is over {BROADCAST_LIMIT}: shuffle instead", stacklevel=3)
        strategy = Strategy.HASH_SHUFFLE
    return strategy


def joined(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, strategy: Strategy, reduce: bool = False, split: bool = False) -> DataFrame:
    """The inner equi-join; the smaller side is built, and moved whole only within the limits of :func:`affordable`.

    reduce: the larger side of a shuffle is filtered by a Bloom filter of the smaller one's keys before it moves; split: its hot
    keys are dealt to several tasks.
    """
    sizes = size_of(left), size_of(right)
    strategy = affordable(strategy, *sizes)
    on = left_key == right_key
    right_small = sizes[1] <= sizes[0]
    if strategy in (Strategy.BROADCAST, Strategy.LOCAL):
        if strategy == Strategy.LOCAL:
            left, right = left.coalesce(1), right.coalesce(1)
        return left.join(F.broadcast(right), on) if right_small else F.broadcast(left).join(right, on)
    if reduce:
        left, right = (bloom_reduced(left, right, left_key, right_key), right) if right_small else (left, bloom_reduced(right, left, right_key, left_key))
    if split:
        return salted(left, right, left_key, right_key) if right_small else salted(right, left, right_key, left_key)
    if strategy == Strategy.HASH_SHUFFLE:
        return left.join(right.hint("shuffle_hash"), on) if right_small else left.hint("shuffle_hash").join(right, on)
    return left.join(right, on)


def bloom_filter(build: DataFrame, key: Column, bits: int = 262_144, hashes: int = 5) -> Callable[[Column], Column]:
    """A test that all values of ``key`` pass, and few others; null never does. The filter, bits / 8 bytes however many keys there
    are, is the value of a subquery, which runs once before the rows that are tested."""
    from ..functions.sketches import bloom_bits, positions

    words = bloom_bits(build.select(key.alias("k")), "k", bits, hashes)
    dense = build.sparkSession.range(bits // 32).select(F.col("id").alias("word")).join(words, "word", "left")
    table = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("b")))), lambda w: w["b"]).alias("t")).scalar()

    def might(value: Column) -> Column:
        v = value.cast("string")
        hit = [F.get(table, F.shiftright(p, 5).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(31)).cast("int"))) != 0 for p in positions(v, bits, hashes)]
        out = v.isNotNull()
        for h in hit:
            out = out & h
        return out

    return might


def bloom_reduced(probe: DataFrame, build: DataFrame, probe_key: Column, build_key: Column, bits: int = 262_144, hashes: int = 5) -> DataFrame:
    """Probe rows that may have a partner: no partner is lost, and few others stay. The probe side does not move for it."""
    return probe.where(bloom_filter(build, build_key, bits, hashes)(probe_key))


def bucket_of(column: Column, buckets: int) -> Column:
    """A bucket that other engines can compute too: the first 32 bits of the MD5 of the value as text."""
    return F.pmod(F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class BucketStats:
    bucket: int
    rows: int
    sources: int


def hot_buckets(stats: list[BucketStats], factor: float = 1.5) -> list[int]:
    """Buckets with more than factor x the mean rows that come from more than one source, so that they can be split."""
    if not stats:
        return []
    mean = sum(s.rows for s in stats) / len(stats)
    return sorted(s.bucket for s in stats if s.rows > mean * factor and s.sources > 1)


def bucket_report(df: DataFrame, key: str, buckets: int = 8, factor: float = 1.5) -> DataFrame:
    """(bucket, n_rows, is_hot) for every bucket that has rows."""
    counts = df.groupBy(bucket_of(F.col(key), buckets).alias("bucket")).agg(F.count("*").alias("n_rows"))
    mean = counts.agg((F.sum("n_rows") / F.count("*")).alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).select("bucket", "n_rows", (F.col("n_rows") > F.col("mean") * F.lit(factor)).alias("is_hot"))  # mean: one row


def hot_salts(keys: DataFrame, key: str, factor: float = 1.5, buckets: int = 64, most: int = 1_024) -> dict[int, int]:
    """Into how many parts the rows of each hot bucket are to be dealt so that a part has about a mean bucket's rows.

    At most buckets / factor buckets can be hot, so the answer is bounded.
    """
    b = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    counts = {r["b"]: r["c"] for r in keys.where(F.col(key).isNotNull()).groupBy(b.alias("b")).agg(F.count("*").alias("c")).collect()}  # a row a bucket
    mean = sum(counts.values()) / buckets
    return {k: min(most, math.ceil(c / mean)) for k, c in counts.items() if c > factor * mean}


def salted(probe: DataFrame, build: DataFrame, probe_key: Column, build_key: Column, factor: float = 1.5, buckets: int = 64, turn: Column | None = None) -> DataFrame:
    """An inner join in which the rows of hot buckets are dealt to as many tasks as their measured share asks for.

    Build rows of hot buckets are repeated for each part, all others go once. Every pair is made once. turn: what deals the rows
    of a bucket; the rows' places where it is not given.
    """
    hot = hot_salts(probe.select(probe_key.alias("k")), "k", factor, buckets)
    if not hot:
        return probe.join(build, probe_key == build_key)
    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")
    table = F.create_map(*[F.lit(x) for pair in sorted(hot.items()) for x in pair])
    parts = lambda k: F.coalesce(F.element_at(table, bucket(k)), F.lit(1))
    by = F.xxhash64(turn) if turn is not None else F.monotonically_increasing_id()
    one = probe.withColumn("__salt1", F.pmod(by, parts(probe_key)).cast("int"))
    two = build.withColumn("__salt2", F.explode(F.sequence(F.lit(0), parts(build_key) - 1)))
    return one.join(two, (probe_key == build_key) & (F.col("__salt1") == F.col("__salt2"))).drop("__salt1", "__salt2")


def salted_join(probe: DataFrame, build: DataFrame, key: str, factor: float = 1.5, buckets: int = 64, salt_by: list[str] | None = None) -> DataFrame:
    """:func:`salted` on a key that both sides have."""
    turn = F.xxhash64(*[F.col(f"p.`{c}`") for c in salt_by]) if salt_by else None
    names = [F.col(f"p.`{c}`") for c in probe.columns] + [F.col(f"b.`{c}`") for c in build.columns if c != key]
    return salted(probe.alias("p"), build.alias("b"), F.col(f"p.`{key}`"), F.col(f"b.`{key}`"), factor, buckets, turn).select(*names)
