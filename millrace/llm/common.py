"""Shared pieces of the training-data operators: shared folders, bounded samples, row keys, shipping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import remove, ship, workspace

__all__ = ["ship"]
BLANKS = bytes([0x20, *range(0x09, 0x0E)])  # the characters that part words: \x20 and \x09-\x0D


def new_folder(spark: SparkSession, name: str) -> str:
    return workspace(spark, name)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no other."""
    known, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in known:
            n = f"_{n}"
        known.add(n.lower())
        out.append(n)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives a lost executor.

    The path is kept at ``_millrace_path`` so that :func:`dropped` can delete a table that nothing reads any more.
    """
    spark = df.sparkSession
    path = workspace(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete written tables that are superseded."""
    for t in tables:
        path = getattr(t, "_millrace_path", None)
        if path:
            remove(t.sparkSession, path)


def swept(spark: SparkSession) -> None:
    """Have the driver collect what is dead: Spark then deletes the shuffle files of plans that nothing refers to any more, which
    would else stay on the executors' disks until the driver runs short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: bucket of the empty string)."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_bucket_py(value, n: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def hash_share(rows: int, wanted: int) -> int:
    """Of 63-bit hashes, how many to take for about half as many rows again as are wanted; precise for any number of rows."""
    return min(1 << 63, (3 * wanted * (1 << 63)) // (2 * max(1, rows)))


def hash63(by: list[str], seed: int = 20_011) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in by], F.lit(seed)), 1)


def within_share(h: Column, share: int) -> Column:
    return F.lit(True) if share >= 1 << 63 else h < F.lit(share)


def bounded_sample(df: DataFrame, by: list[str], bound: int, rows: int | None = None) -> DataFrame:
    """The ``bound`` rows with the least hashes of ``by``; all where there are no more. The same for any order or partitioning.

    ``by`` tells rows apart: rows equal in it are to be aggregated before. A filter by hash leaves about 1.5 x bound rows, which
    are sorted; no other row moves.
    """
    n = df.count() if rows is None else rows
    if n <= bound:
        return df
    h = hash63(by)
    return df.where(within_share(h, hash_share(n, bound))).orderBy(h, *by).limit(bound)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def text_chunks(texts: list, most: int = 4 << 20):
    """Runs of indices whose texts hold about ``most`` characters together; a longer text is a run of its own."""
    run, size = [], 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += n
    if run:
        yield run


class FlatTable:
    """Numbers distinct words and keeps a run of ids for each, end to end in one array.

    The words that were most frequent in the first many are in a small dictionary of their own, which stays in the processor's
    cache: most look-ups end there.
    """

    HOT, MANY = 1 << 15, 1 << 17

    def __init__(self, dtype):
        self.numbers: dict[str, int] = {}
        self.hot: dict[str, int] = {}
        self.count = 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype), 0

    def add(self, words: list[str], ids: np.ndarray, start: np.ndarray, length: np.ndarray, named: bool = True) -> None:
        """New words; word i has ids[start[i] : start[i] + length[i]]. Not named: another table numbers them."""
        n = self.count
        self.start, self.length = grown(self.start, n + len(words)), grown(self.length, n + len(words))
        self.flat = grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(words)] = start + self.used
        self.length[n : n + len(words)] = length
        self.used += len(ids)
        self.count += len(words)
        if named:
            self.numbers.update(zip(words, range(n, n + len(words)), strict=True))

    def numbered(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def found(self, words: list[str]) -> np.ndarray:
        """The numbers of words, -1 for unknown ones."""
        if not self.hot:
            return np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        kind = np.fromiter(map(self.hot.get, words, repeat(-1)), np.int64, len(words))
        rest = np.flatnonzero(kind < 0)
        kind[rest] = np.fromiter(map(self.numbers.get, map(words.__getitem__, rest.tolist()), repeat(-1)), np.int64, len(rest))
        return kind

    def warm(self, words: list[str], kind: np.ndarray) -> None:
        """Note the most frequent of these words, which have these numbers."""
        if self.hot or len(words) < self.MANY:
            return
        count, place = np.bincount(kind), np.zeros(self.count, np.int64)
        place[kind] = np.arange(len(kind))
        top = np.argsort(-count, kind="stable")[: self.HOT]
        top = top[count[top] > 1].tolist()
        self.hot = {words[i]: k for k, i in zip(top, place[top].tolist(), strict=True)}

    def joined(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers, end to end, and where each word's begin (and one more)."""
        length = self.length[kind]
        first = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(length, out=first[1:])
        small = np.int32 if max(self.used, int(first[-1])) < 1 << 31 else np.int64
        at = np.repeat((self.start[kind] - first[:-1]).astype(small), length)
        at += np.arange(first[-1], dtype=small)
        return self.flat[at], first


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n rows at least."""
    if n <= len(a):
        return a
    out = np.zeros((max(n, 2 * len(a)), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker."""
    return _CACHES.setdefault((os.getpid(), name), {})


def tidy() -> None:
    """Give memory that is free in this worker back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A function over batches that tidies up at the end of its task."""

    def whole(batches):
        yield from run(batches)
        tidy()

    return whole


def released(name: str) -> None:
    """Empty a worker's dictionary and give its memory back to the system."""
    worker_cache(name).clear()
    gc.collect()
    tidy()


_CACHES: dict = {}


def out_schema(df: DataFrame, names: list[str], new: dict[str, str]) -> T.StructType:
    """The columns ``names`` of df, then new ones by DDL type; all nullable."""
    kept = [T.StructField(n, df.schema[n].dataType, True) for n in names]
    return T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t), True) for n, t in new.items()])
