"""From a bound plan to a DataFrame; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import exchanged
from ..operators.joins import Strategy, choose_strategy, joined, size_of
from .binder import bind, kinds
from .sqlgate import Aggregate, Name, Plan, Predicate, parse

_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
}


class ResultTooLarge(RuntimeError):
    """A result with more rows than the budget."""


def predicate(p: Predicate, column: Column) -> Column:
    return _COMPARE[p.op](column, F.lit(p.value))


def aggregate(a: Aggregate, column: Column | None) -> Column:
    """COUNT is a long, the rest are doubles, as on the wire."""
    f = {"COUNT": lambda: F.count("*") if column is None else F.count(column), "SUM": lambda: F.sum(column).cast("double"), "AVG": lambda: F.avg(column), "MIN": lambda: F.min(column), "MAX": lambda: F.max(column)}
    return f[a.function]().alias(a.alias)


def quoted(n: Name) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in (n.qualifier, n.column) if part)


def predicate_sql(p: Predicate) -> str:
    """The predicate as SQL text: names quoted, quotes in text doubled."""
    value = "'" + p.value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(p.value, str) else repr(p.value)
    return f"{quoted(p.name)} {p.op} {value}"


def compiled(plan: Plan, tables: dict[str, DataFrame], strategy: str = "auto", zero_nulls: bool = False, combiner: bool = True, reduce: bool = False, split: bool = False, passed: Observation | None = None) -> DataFrame:
    """zero_nulls: NULL sorts as 0 (or as the empty string). combiner: without it, rows move to their groups one by one, and nothing
    is aggregated before. reduce, split: of a shuffled join's larger side, see :func:`joined`. passed: counts the rows that all
    predicates hold for."""
    by_name = {k.lower(): v for k, v in tables.items()}
    left = by_name[plan.table.name.lower()].alias(plan.table.alias)
    if plan.join:
        right = by_name[plan.join.table.name.lower()].alias(plan.join.table.alias)
        column = lambda n: F.col(f"{n.qualifier}.`{n.column}`")
        kind = Strategy(strategy) if strategy != "auto" else choose_strategy(size_of(left), size_of(right))
        df = joined(left, right, column(plan.join.left), column(plan.join.right), kind, reduce, split)
    else:
        column = lambda n: F.col(f"`{n.column}`")
        df = left
    for p in plan.predicates:
        df = df.where(predicate(p, column(p.name)))
    if passed is not None:
        df = df.observe(passed, F.count(F.lit(1)).alias("rows"))
    outputs = [column(o.name).alias(o.alias) for o in plan.outputs]
    if plan.aggregates:
        if not combiner:
            needed = {str(n): column(n) for n in [*plan.group_by, *(a.name for a in plan.aggregates if a.name)]}
            df = exchanged(df.select(*needed.values()) if needed else df.select(F.lit(1).alias("one")), [column(g) for g in plan.group_by])
        made = [aggregate(a, column(a.name) if a.name else None) for a in plan.aggregates]
        if plan.group_by:
            keys = {_key(g, plan): column(g).alias(f"__g{i}") for i, g in enumerate(plan.group_by)}
            df = df.groupBy(*keys.values()).agg(*made)
            names = {k: f"__g{i}" for i, k in enumerate(keys)}
            df = df.select(*[F.col(names[_key(o.name, plan)]).alias(o.alias) for o in plan.outputs], *[F.col(f"`{a.alias}`") for a in plan.aggregates])
        else:
            df = df.agg(*made)
    elif not plan.star:
        df = df.select(*outputs)
    if plan.order_by is not None:
        c = F.col(f"`{plan.order_by}`")
        if zero_nulls:
            c = F.coalesce(c, F.lit("") if dict(df.dtypes)[plan.order_by] == "string" else F.lit(0))
        df = df.orderBy(c.desc() if plan.descending else c.asc())
    return df if plan.limit is None else df.limit(plan.limit)


def _key(n: Name, plan: Plan) -> tuple[str | None, str]:
    return (n.qualifier if plan.join else None, n.column)


@dataclass
class Engine:
    """SQL over named DataFrames: parse, bind, compile. Nothing runs until the result does."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def plan(self, sql: str) -> Plan:
        return bind(parse(sql), {n: kinds(df.schema) for n, df in self.tables.items()})

    def sql(self, sql: str, strategy: str = "auto", zero_nulls: bool = False, **how) -> DataFrame:
        return compiled(self.plan(sql), self.tables, strategy, zero_nulls, **how)

    def collect(self, sql: str, max_rows: int = 100_000, **how) -> list:
        """The rows, or :class:`ResultTooLarge` where there are more than max_rows."""
        rows = self.sql(sql, **how).limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ResultTooLarge(f"result exceeds {max_rows} rows")
        return rows
