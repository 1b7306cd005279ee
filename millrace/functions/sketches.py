"""Approximate aggregates with their configured and observed errors; all of them merge."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workspace
from ..operators.joins import bucket_of


def _check(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def _text(column: str) -> Column:
    """Values as text; empty ones count as null."""
    c = F.col(column).cast("string")
    return F.when(c != "", c)


def hash64(column: Column, seed: int | str = 0) -> Column:
    """The first eight bytes of SHA-256(seed, a zero byte, value as text), as a whole number from 0 to 2^64 - 1."""
    text = F.concat(F.lit(f"{seed}").cast("binary"), F.unhex(F.lit("00")), column.cast("string").cast("binary"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def distinct_sketch(column: str, precision: int = 12) -> Column:
    """A HyperLogLog state: merge with ``F.hll_union_agg``, read with ``F.hll_sketch_estimate``."""
    return F.hll_sketch_agg(_text(column), _check("precision", precision, 4, 16))


def approx_distinct(column: str, precision: int = 12) -> Column:
    return F.hll_sketch_estimate(distinct_sketch(column, precision))


def approx_percentile(column: str, q: float, capacity: int = 200) -> Column:
    """The value at rank q, with a rank error of about 1 / accuracy; nulls and NaN are left out."""
    _check("capacity", capacity, 20, 5_000)
    x = F.col(column).cast("double")
    return F.percentile_approx(F.when(~F.isnan(x), x), q, 50 * capacity)


def percentile_sketch(column: str, capacity: int = 200) -> Column:
    """A KLL state of the values, nulls and NaN left out: merge with :func:`percentile_merged`, read with :func:`percentile_of`."""
    _check("capacity", capacity, 20, 5_000)
    x = F.col(column).cast("double")
    return F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(capacity))


def percentile_merged(column: str) -> Column:
    return F.kll_merge_agg_double(column)


def percentile_of(state: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(state, F.lit(q))


def top_sketch(column: str, max_items: int = 10_000, sql_nulls: bool = False) -> Column:
    """A frequent-items state: merge with :func:`top_merged`, read with :func:`top_of`. Empty values count as null, unless ``sql_nulls``."""
    if sql_nulls:
        return F.expr(f"approx_top_k_accumulate(cast(`{column}` AS string), {max_items})")
    return F.expr(f"approx_top_k_accumulate(CASE WHEN cast(`{column}` AS string) <> '' THEN cast(`{column}` AS string) END, {max_items})")


def top_merged(column: str, max_items: int = 10_000) -> Column:
    return F.expr(f"approx_top_k_combine(`{column}`, {max_items})")


def top_of(column: str, k: int = 10) -> Column:
    """An array of (item, count), the most frequent first."""
    return F.expr(f"approx_top_k_estimate(`{column}`, {k})")


def heavy_hitters(df: DataFrame, column: str, k: int = 10, max_items: int = 10_000) -> DataFrame:
    """(item, n_rows) of the k most frequent values, by a bounded frequent-items state; count descending, then value."""
    top = df.select(_text(column).alias("v")).where("v is not null").agg(F.expr(f"approx_top_k(v, {k}, {max_items})").alias("t"))
    return top.select(F.explode("t").alias("e")).select(F.col("e.item").alias("item"), F.col("e.count").alias("n_rows")).orderBy(F.desc("n_rows"), "item")


def frequency(df: DataFrame, column: str, width: int = 2_048, depth: int = 5, seed: int = 42) -> DataFrame:
    """(row, slot, n): a count-min table, as long as width x depth at most; read with :func:`frequency_of`, merged by adding."""
    _check("width", width, 64, 65_536), _check("depth", depth, 2, 10)
    v = df.select(_text(column).alias("v")).where("v is not null")
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64("v", F.lit(seed + r)), F.lit(width)).alias("slot")) for r in range(depth)]))
    return v.select(rows.alias("e")).groupBy("e.row", "e.slot").agg(F.count("*").alias("n"))  # a task sends width x depth rows at most


def frequency_of(table: DataFrame, values: DataFrame, width: int = 2_048, depth: int = 5, seed: int = 42) -> DataFrame:
    """(v, estimate): never below the true count."""
    keys = values.select("v", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64("v", F.lit(seed + r)), F.lit(width)).alias("slot")) for r in range(depth)])).alias("e")).select("v", "e.row", "e.slot")
    return keys.join(table, ["row", "slot"], "left").groupBy("v").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bottom_k(df: DataFrame, identity: str, k: int = 100) -> DataFrame:
    """A sample of k rows: those with the least SHA-256 of their identity. The same for any order or partitioning."""
    _check("size", k, 1, 10_000)
    h = F.sha2(F.col(identity).cast("string"), 256)
    return df.orderBy(h, F.col(identity)).limit(k)


def bloom_bits(df: DataFrame, column: str, bits: int = 262_144, hashes: int = 5) -> DataFrame:
    """(word, bits): a Bloom filter as 32-bit words, bits / 32 rows at most. Filters of one size merge by ``bit_or``."""
    _check("bits", bits, 1_024, 16_777_216), _check("hashes", hashes, 1, 12)
    v = df.select(F.col(column).cast("string").alias("v")).where("v is not null")
    pos = v.select(F.explode(F.array(*positions(F.col("v"), bits, hashes))).alias("p"))
    return pos.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 31))")).alias("bits"))


def positions(value: Column, bits: int, hashes: int) -> list[Column]:
    """The bits of a value in a Bloom filter."""
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) for i in range(hashes)]


def bloom_might_contain(values: DataFrame, column: str, words: DataFrame, bits: int = 262_144, hashes: int = 5) -> DataFrame:
    """(v, might): distinct values and whether the filter may hold them; no false negatives, null never."""
    v = values.select(F.col(column).cast("string").alias("v")).distinct()
    pos = v.select("v", F.explode(F.array(*positions(F.col("v"), bits, hashes))).alias("p")).withColumn("word", F.shiftright("p", 5))
    hit = pos.join(words, "word", "left").select("v", (F.coalesce("bits", F.lit(0)).bitwiseAND(F.expr("shiftleft(1L, int(p & 31))")) != 0).alias("h"))
    return hit.groupBy("v").agg((F.bool_and("h") & F.col("v").isNotNull()).alias("might"))


def partition_histogram(df: DataFrame, column: str, buckets: int = 8) -> DataFrame:
    """(bucket, n_rows): exact rows by bucket."""
    return df.groupBy(bucket_of(F.col(column), buckets).alias("bucket")).agg(F.count("*").alias("n_rows"))


def configured_error(operation: str, **p) -> float | None:
    """HyperLogLog 1.04 / sqrt(2^precision); percentile 2 / sqrt(capacity); heavy hitters e / width; none for samples."""
    return {
        "approx_count_distinct": lambda: 1.04 / math.sqrt(2 ** p.get("precision", 12)),
        "approx_percentile": lambda: 2 / math.sqrt(p.get("capacity", 200)),
        "heavy_hitters": lambda: math.e / p.get("width", 2_048),
        "sample": lambda: None,
    }[operation]()


def observed_error(operation: str, estimate: float | None, exact: float | None) -> float | None:
    """Relative for distinct counts (absolute where exact is 0), absolute otherwise; none without both values."""
    if estimate is None or exact is None:
        return None
    gap = abs(estimate - exact)
    return gap / abs(exact) if operation == "approx_count_distinct" and exact else gap


RUN = "operation string, value double, configured_error double, observed_error double, millis double, state_bytes bigint, rows bigint"


@dataclass
class Runs:
    """A log of approximate runs, the newest first, 200 at most; with ``path``, each run is a small file there, and a later process
    goes on with the log."""

    rows: list[tuple] = field(default_factory=list)
    spark: SparkSession | None = None
    path: str | None = None

    def __post_init__(self):
        if self.path:
            some = sorted(workspace.names(self.spark, self.path), reverse=True)[:200]
            self.rows = [tuple(json.loads(workspace.get_bytes(self.spark, f"{self.path}/{n}"))) for n in some] + self.rows

    def record(self, operation: str, run, exact: float | None = None, state_bytes: int | None = None, rows: int | None = None, **p):
        """state_bytes: of the merged state, where that is known; rows: that went into it."""
        began = time.perf_counter()
        value = run()
        number = value if isinstance(value, int | float) else None
        row = (operation, None if number is None else float(number), configured_error(operation, **p), observed_error(operation, number, exact), (time.perf_counter() - began) * 1e3, state_bytes, rows)
        self.rows.insert(0, row)
        del self.rows[200:]
        if self.path:
            workspace.put_bytes(self.spark, f"{self.path}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps(row).encode())
        return value

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, RUN)
