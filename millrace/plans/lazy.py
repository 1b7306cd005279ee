"""Lazy plans: validated and kept, run by an action; cache levels with counters; result accumulators."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .compile import Engine

TRANSFORMATIONS = ("filter", "map", "select", "groupBy", "aggregate", "join")
LEVELS = {"NONE": None, "MEMORY": StorageLevel.MEMORY_ONLY, "DISK": StorageLevel.DISK_ONLY, "MEMORY_AND_DISK": StorageLevel.MEMORY_AND_DISK}


@dataclass
class LazyPlan:
    """SQL that was checked but not run, with the names of its declared steps."""

    engine: Engine
    sql: str
    steps: tuple[str, ...] = ()
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "lazy"

    def __post_init__(self):
        if bad := [s for s in self.steps if s not in TRANSFORMATIONS]:
            raise ValueError(f"unknown transformations: {', '.join(bad)}")
        self.engine.plan(self.sql)

    def frame(self) -> DataFrame:
        return self.engine.sql(self.sql)

    def collect(self, max_rows: int = 100_000) -> list:
        rows = self.engine.collect(self.sql, max_rows)
        self.status = "executed"
        return rows

    def count(self) -> int:
        n = self.frame().count()
        self.status = "executed"
        return n

    def write(self, path: str) -> None:
        df = self.frame()
        if df.isEmpty():
            raise ValueError("an empty result can't be written")
        df.write.parquet(path)
        self.status = "executed"

    def materialize(self, catalog, name: str):
        out = catalog.materialize(name, self.frame())
        self.engine.register(name, catalog.table(name))
        self.status = "materialized"
        return out


@dataclass
class Cache:
    """Frames kept by name at a level, within a budget of bytes; the least recently used go, pinned ones stay.

    Threads that ask for one name at once load it once. Memory alone is used only for frames of a quarter of the budget at most; larger than the budget: not kept.
    """

    budget: int = 256 << 20
    entries: OrderedDict[str, tuple[DataFrame, int, bool]] = field(default_factory=OrderedDict)
    counters: dict[str, int] = field(default_factory=lambda: {"hits": 0, "misses": 0, "evictions": 0, "bypasses": 0})
    _lock: threading.RLock = field(default_factory=threading.RLock, repr=False)
    _loading: dict[str, threading.Event] = field(default_factory=dict, repr=False)

    def get(self, name: str, load: Callable[[], DataFrame], size: int, level: str = "MEMORY_AND_DISK", pinned: bool = False) -> DataFrame:
        if level not in LEVELS:
            raise ValueError(f"level must be one of {', '.join(LEVELS)}")
        while True:
            with self._lock:
                if name in self.entries:
                    self.counters["hits"] += 1
                    self.entries.move_to_end(name)
                    return self.entries[name][0]
                other = self._loading.get(name)
                if other is None:
                    self._loading[name] = threading.Event()
                    self.counters["misses"] += 1
                    break
            other.wait()  # one load at a time: then look again
        try:
            df = load()
            storage = LEVELS[level]
            with self._lock:
                if storage is None:
                    return df
                if level == "MEMORY" and size > self.budget // 4 or not self._room(size):
                    self.counters["bypasses"] += 1
                    return df
                self.entries[name] = (df.persist(storage), size, pinned)
                return self.entries[name][0]
        finally:
            with self._lock:
                self._loading.pop(name).set()

    def _room(self, size: int) -> bool:
        if size > self.budget:
            return False
        loose = [n for n, (_, _, pinned) in self.entries.items() if not pinned]
        while sum(s for _, s, _ in self.entries.values()) + size > self.budget:
            if not loose:
                return False
            df, _, _ = self.entries.pop(loose.pop(0))
            df.unpersist()
            self.counters["evictions"] += 1
        return True

    def clear(self) -> None:
        for df, _, _ in self.entries.values():
            df.unpersist()
        self.entries.clear()
