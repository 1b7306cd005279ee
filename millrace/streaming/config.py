"""Standing queries: the REGISTER statement, and checked configurations."""

from __future__ import annotations

import re
from dataclasses import dataclass

UNITS = {"MILLISECOND": 1, "SECOND": 1_000, "MINUTE": 60_000, "HOUR": 3_600_000}
DAY = 86_400_000


class StreamConfigError(ValueError):
    """A configuration out of range, or a statement outside the grammar."""


@dataclass(frozen=True)
class StreamConfig:
    """Times in milliseconds. slide: of hops; gap: of sessions."""

    name: str
    topic: str
    window: str  # TUMBLE, HOP or SESSION
    size: int
    event_time: str = "ts"
    slide: int | None = None
    gap: int | None = None
    lateness: int = 0
    group_by: str | None = None
    distinct: str | None = None
    total: str | None = None
    frequent: str | None = None
    precision: int = 14
    top_k: int = 10
    tie: str | None = None  # the column that orders events of one place of arrival; places are unique without it
    sql_nulls: bool = False  # missing and empty groups and items stay apart and are counted, as in SQL; else both are the empty group
    exact: bool = False  # keep exact counts beside the sketches, for the errors observed

    def __post_init__(self):
        def within(what: str, v: int, low: int, high: int) -> None:
            if not isinstance(v, int) or not low <= v <= high:
                raise StreamConfigError(f"{what} must be from {low} to {high}")

        if not re.fullmatch(r"[A-Za-z_][A-Za-z_0-9]*", self.name or "") or not self.topic or not self.event_time:
            raise StreamConfigError("name, topic and event time are required")
        if self.window not in ("TUMBLE", "HOP", "SESSION"):
            raise StreamConfigError("window must be TUMBLE, HOP or SESSION")
        within("size", self.size, 100, DAY)
        if self.window == "HOP":
            within("slide", self.slide, 100, self.size)
        if self.window == "SESSION":
            object.__setattr__(self, "gap", self.size if self.gap is None else self.gap)
            within("gap", self.gap, 100, DAY)
        within("lateness", self.lateness, 0, DAY)
        within("precision", self.precision, 14, 16)
        within("top_k", self.top_k, 1, 1_000)


def interval(text: str) -> int:
    """Milliseconds of ``INTERVAL 'n' unit``."""
    m = re.fullmatch(r"\s*INTERVAL\s+'(\d+)'\s+(MILLISECOND|SECOND|MINUTE|HOUR)S?\s*", text, re.I)
    if not m:
        raise StreamConfigError(f"not an interval: {text.strip()}")
    return int(m[1]) * UNITS[m[2].upper()]


_REGISTER = re.compile(r"\s*REGISTER\s+QUERY\s+(?P<name>\w+)\s+AS\s+SELECT\s+(?P<select>.+?)\s+FROM\s+(?P<topic>[\w.\-]+)\s+WINDOW\s+(?P<kind>TUMBLE|HOP|SESSION)\s*\(\s*(?P<args>[^)]*)\)\s*(?:WATERMARK\s+(?P<mark>INTERVAL\s+'\d+'\s+\w+))?\s*;?\s*", re.I | re.S)
_UNREGISTER = re.compile(r"\s*UNREGISTER\s+QUERY\s+(\w+)\s*;?\s*", re.I)


def parse_statement(sql: str) -> StreamConfig | str:
    """The configuration that a REGISTER statement asks for, or the name in an UNREGISTER statement.

    HOP takes the event time, the slide and the size, in this order.
    """
    if m := _UNREGISTER.fullmatch(sql):
        return m[1]
    m = _REGISTER.fullmatch(sql)
    if not m:
        raise StreamConfigError("expected REGISTER QUERY name AS SELECT ... FROM topic WINDOW ... or UNREGISTER QUERY name")
    args = [a.strip() for a in m["args"].split(",")]
    kind = m["kind"].upper()
    if len(args) != (3 if kind == "HOP" else 2):
        raise StreamConfigError(f"{kind} takes {'event time, slide and size' if kind == 'HOP' else 'event time and size'}")
    times = [interval(a) for a in args[1:]]
    distinct = re.search(r"COUNT\s*\(\s*DISTINCT\s+(\w+)\s*\)", m["select"], re.I)
    total = re.search(r"SUM\s*\(\s*(\w+)\s*\)", m["select"], re.I)
    return StreamConfig(
        m["name"], m["topic"], kind, times[-1], args[0], slide=times[0] if kind == "HOP" else None, gap=times[-1] if kind == "SESSION" else None,
        lateness=interval(m["mark"]) if m["mark"] else 0, distinct=distinct[1] if distinct else None, total=total[1] if total else None,
    )
