"""Checksums of results, alike for equal rows in any order, or in a given one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_text(df: DataFrame):
    """A row as text: columns by name, null apart from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in sorted(df.columns)]
    return F.concat_ws("|", *parts)


def canonical(df: DataFrame) -> DataFrame:
    """Columns in the form in which engines are compared: numbers, and text that is one, rounded to nine places and without zeros at
    the end, so that 1, 1.0 and '1.00' are equal; booleans as text; null apart from the empty string."""

    def form(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "boolean" or kind.startswith(("date", "timestamp", "binary")):
            return c.cast("string")
        number = F.expr(f"try_cast(trim(cast(`{name}` as string)) as double)")
        places = F.regexp_replace(F.format_string("%.9f", F.round(number, 9)), r"\.?0+$", "")
        text = F.when(places.isin("-0", ""), "0").otherwise(places)
        plain = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
        return F.when(plain, text).otherwise(c.cast("string"))

    return df.select(*[form(n, t).alias(n) for n, t in df.dtypes])


def semantic_checksum(df: DataFrame) -> DataFrame:
    """(n_rows, checksum): the sum of 60-bit hashes of the rows, as text. Order has no bearing, repeats count, and partial sums merge."""
    h = F.conv(F.substring(F.sha2(row_text(df), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("checksum"))


def ordered_checksum(df: DataFrame, order: str) -> DataFrame:
    """(checksum): as above, with each row's place by a unique column in its hash."""
    at = df.select(F.concat_ws("#", F.col(f"`{order}`").cast("string"), row_text(df)).alias("t"))
    h = F.conv(F.substring(F.sha2(F.col("t"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return at.agg(F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))


def legacy_strings(df: DataFrame) -> DataFrame:
    """All columns as text, null as the empty string."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
