"""The engine's own queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analyze, control
from .functions import sketches
from .operators import aggregates, checksum, joins
from .plans.compile import Engine
from .plans.lazy import Cache, LazyPlan
from .plans.lineage import Lineage, available_ancestors, descendants
from .plans.sqlgate import parse
from .sources import ingest, sinks
from .streaming import windows
from .streaming.config import StreamConfig, parse_statement
from .streaming.standing import StandingQuery
from .workspace import workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    return Engine(spark, {n: table(spark, sf_dir, n) for n in names})


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places: sums of doubles depend on their order."""
    return df.select(*[F.round(F.col(f"`{c}`"), 4).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- the SQL gate ------------------------------------------------------------------------------------------------------

#: Statements that run as they are here and, with doubles rounded, in DuckDB. Doubles: D, else as they are.
STATEMENTS: dict[str, tuple[str, str]] = {
    "scan_star_limit": ("SELECT * FROM region ORDER BY r_regionkey LIMIT 3", ""),
    "scan_project": ("SELECT c_custkey, c_mktsegment FROM customer", ""),
    "filter_num_eq": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 25", ""),
    "filter_num_ne": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber != 1", ""),
    "filter_num_gt": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000", "o_totalprice"),
    "filter_num_ge": ("SELECT o_orderkey FROM orders WHERE o_custkey >= 100", ""),
    "filter_num_lt": ("SELECT o_orderkey FROM orders WHERE o_totalprice < 50000.5", ""),
    "filter_num_le": ("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <= 0.05", "l_discount"),
    "filter_str_eq": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", ""),
    "filter_str_ne": ("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'", ""),
    "filter_str_gt": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag > 'A'", ""),
    "filter_str_lt": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'FURNITURE'", ""),
    "filter_and_chain": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag = 'R' AND l_linestatus != 'O'", ""),
    "agg_global": ("SELECT COUNT(*) AS n, COUNT(l_quantity) AS n_qty, SUM(l_quantity) AS sum_qty, AVG(l_quantity) AS avg_qty, MIN(l_quantity) AS min_qty, MAX(l_quantity) AS max_qty FROM lineitem", "sum_qty avg_qty min_qty max_qty"),
    "agg_global_empty": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem WHERE l_quantity > 1000000", "s a lo hi"),
    "agg_default_names": ('SELECT COUNT(*), SUM(l_quantity), AVG(l_discount) FROM lineitem', "sum_l_quantity avg_l_discount"),
    "agg_group_one": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_extendedprice) AS total FROM lineitem GROUP BY l_returnflag", "total"),
    "agg_group_multi": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, AVG(o_totalprice) AS avg_price, MAX(o_totalprice) AS max_price FROM orders GROUP BY o_orderstatus, o_orderpriority", "avg_price max_price"),
    "agg_same_column_many": ("SELECT l_linestatus, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, COUNT(l_quantity) AS n FROM lineitem GROUP BY l_linestatus", "s a lo hi"),
    "order_num_asc": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50", ""),
    "order_num_desc": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50", ""),
    "order_str": ("SELECT c_name, c_custkey FROM customer ORDER BY c_name LIMIT 25", ""),
    "topk": ("SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_custkey < 50 GROUP BY o_custkey ORDER BY o_custkey DESC LIMIT 10", ""),
    "q1_grouped_scan": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_price, AVG(l_quantity) AS avg_qty, AVG(l_extendedprice) AS avg_price, AVG(l_discount) AS avg_disc FROM lineitem WHERE l_quantity <= 45 GROUP BY l_returnflag, l_linestatus", "sum_qty sum_price avg_qty avg_price avg_disc"),
    "q6_selective_revenue": ("SELECT SUM(l_extendedprice) AS revenue, COUNT(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24", "revenue"),
    "employees_rollup": ("SELECT c_mktsegment, COUNT(*) AS n, AVG(c_acctbal) AS avg_bal, MAX(c_acctbal) AS max_bal FROM customer GROUP BY c_mktsegment", "avg_bal max_bal"),
}

JOIN_AGG = "SELECT c.c_mktsegment AS segment, COUNT(*) AS n, SUM(o.o_totalprice) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"
JOINS: dict[str, tuple[str, str, str]] = {
    "join_auto": (JOIN_AGG, "total", "auto"),
    "join_local": (JOIN_AGG, "total", "local"),
    "join_broadcast": (JOIN_AGG, "total", "broadcast"),
    "join_hash_shuffle": (JOIN_AGG, "total", "hash_shuffle"),
    "join_filter_both_sides": ("SELECT c.c_custkey AS cust, o.o_orderkey AS ord FROM orders o INNER JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000 AND c.c_mktsegment = 'BUILDING'", "", "auto"),
    "join_project": ("SELECT l.l_orderkey AS l_key, l.l_linenumber AS line, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45", "", "auto"),
    "join_global_agg": ("SELECT COUNT(*) AS n, SUM(l.l_quantity) AS qty, MAX(o.o_totalprice) AS top FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'", "qty top", "auto"),
    "join_empty_side": ("SELECT c.c_custkey AS cust, o.o_orderkey AS ord FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 99999999", "", "auto"),
    "join_default_names": ("SELECT COUNT(*), AVG(o.o_totalprice) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "avg_o_totalprice", "auto"),
}


def _names(sql: str) -> list[str]:
    p = parse(sql)
    return [o.alias for o in p.outputs] + [a.alias for a in p.aggregates]


def _twin(sql: str, doubles: str) -> str:
    """The statement for DuckDB, default names given and doubles rounded."""
    p = parse(sql)
    if p.star:
        return sql
    body = sql
    for a in p.aggregates:
        call = f"{a.function}({a.name if a.name else '*'})"
        if f"{call} AS" not in body:
            body = body.replace(call, f'{call} AS "{a.alias}"', 1)
    some = set(doubles.split())
    return "SELECT " + ", ".join(f'round("{c}", 4) AS "{c}"' if c in some else f'"{c}"' for c in _names(sql)) + f" FROM ({body})"


def _tables(sql: str) -> list[str]:
    p = parse(sql)
    return [p.table.name, *([p.join.table.name] if p.join else [])]


for _n, (_s, _d) in STATEMENTS.items():
    QUERIES[_n] = lambda spark, sf, s=_s: rounded(engine(spark, sf, *_tables(s)).sql(s))
    SQL[_n] = _twin(_s, _d)
for _n, (_s, _d, _k) in JOINS.items():
    QUERIES[_n] = lambda spark, sf, s=_s, k=_k: rounded(engine(spark, sf, *_tables(s)).sql(s, strategy=k))
    SQL[_n] = _twin(_s, _d)


_REFUSED = {
    "or": "SELECT {0} FROM orders WHERE {0} = 1 OR {0} = 2", "distinct": "SELECT DISTINCT {0} FROM orders", "union": "SELECT {0} FROM orders UNION SELECT {0} FROM orders", "intersect": "SELECT {0} FROM orders INTERSECT SELECT {0} FROM orders",
    "except": "SELECT {0} FROM orders EXCEPT SELECT {0} FROM orders", "limit 0": "SELECT {0} FROM orders LIMIT 0", "offset": "SELECT {0} FROM orders LIMIT 5 OFFSET 2", "outer join": "SELECT a.{0} AS x FROM orders a LEFT JOIN customer b ON a.o_custkey = b.c_custkey",
    "having": "SELECT {0}, COUNT(*) AS n FROM orders GROUP BY {0} HAVING COUNT(*) > 1", "like": "SELECT {0} FROM orders WHERE {0} LIKE 'a'", "between": "SELECT {0} FROM orders WHERE {0} BETWEEN 1 AND 2", "in": "SELECT {0} FROM orders WHERE {0} IN (1, 2)",
    "with": "WITH t AS (SELECT {0} FROM orders) SELECT {0} FROM t", "two keys": "SELECT {0} FROM orders ORDER BY {0}, o_custkey", "plain": "SELECT {0} FROM orders ORDER BY {0} LIMIT 5",
}


@query("gate_rejections", f"SELECT column_name, form, form = 'plain' AS accepted FROM (DESCRIBE orders), (VALUES {', '.join(f'({k!r})' for k in _REFUSED)}) v(form)")
def _rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms outside the subset, over every column of a table."""
    e = engine(spark, sf_dir, "orders", "customer")
    return spark.createDataFrame([(c, n, _accepts(e, x.format(c))) for c in e.tables["orders"].columns for n, x in _REFUSED.items()], "column_name string, form string, accepted boolean")


@query("agg_count_nulls", "SELECT region, count(*) AS n, count(sales) AS n_sales, sum(sales) AS total FROM (VALUES ('east', 10.0::DOUBLE), ('east', NULL), ('west', 5.0), ('west', 7.0), (NULL, 1.0)) v(region, sales) GROUP BY region")
def _count_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("east", 10.0), ("east", None), ("west", 5.0), ("west", 7.0), (None, 1.0)], "region string, sales double")
    return Engine(spark, {"t": df}).sql("SELECT region, COUNT(*) AS n, COUNT(sales) AS n_sales, SUM(sales) AS total FROM t GROUP BY region")


@query("union_of_partitions", "SELECT o_orderkey FROM orders")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 2 <> 0 OR o_orderkey IS NULL"))


@query("result_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(chr(1), c_custkey::VARCHAR, c_name)), '42')")
def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.search(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "42")


# --- combiner ----------------------------------------------------------------------------------------------------------

_REDUCED = "SELECT l_returnflag, count(*) AS n_rows, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem GROUP BY l_returnflag"


@query("combiner_on", _REDUCED)
def _combiner_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.final_reduce(aggregates.partial_states(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), ["l_returnflag"]))


@query("combiner_off", _REDUCED)
def _combiner_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.final_reduce(aggregates.exchanged(aggregates.uncombined_states(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), ["l_returnflag"]), ["l_returnflag"]))


@query("combiner_final_reduce", "SELECT count(*) AS n_rows, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders")
def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregates.final_reduce(aggregates.partial_states(table(spark, sf_dir, "orders"), [], "o_totalprice"), []))


@query("accumulators", "SELECT count(*) AS rows_scanned, count(*) FILTER (l_quantity > 25) AS rows_passed_filter FROM lineitem")
def _accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, seen = aggregates.observed(table(spark, sf_dir, "lineitem").select("l_quantity"), "scan", rows_scanned=F.count("*"), rows_passed_filter=F.count_if(F.col("l_quantity") > 25))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows_scanned"], seen.get["rows_passed_filter"])], "rows_scanned bigint, rows_passed_filter bigint")


# --- joins -------------------------------------------------------------------------------------------------------------


@query("join_strategy_table", "SELECT c_custkey, n_nationkey, CASE WHEN a + b <= 2097152 THEN 'local' WHEN least(a, b) <= 16777216 AND least(a, b) <= 0.35 * greatest(a, b) THEN 'broadcast' ELSE 'hash_shuffle' END AS strategy FROM (SELECT c_custkey, n_nationkey, c_custkey * 100003 AS a, n_nationkey * 1000003 AS b FROM customer, nation)")
def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy for sides of many sizes."""
    pairs = table(spark, sf_dir, "customer").select("c_custkey").crossJoin(table(spark, sf_dir, "nation").select("n_nationkey"))
    return pairs.select(F.col("c_custkey").cast("bigint"), F.col("n_nationkey").cast("bigint"), joins.strategy_of(F.col("c_custkey") * 100_003, F.col("n_nationkey") * 1_000_003).alias("strategy"))


@query("join_bloom_reduced", "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_brand")
def _bloom_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey", "p_brand")
    line = joins.bloom_reduced(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"), part, F.col("l_partkey"), F.col("p_partkey"))
    return rounded(line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")))


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which four fifths are of user 1."""
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 < 4, 1).otherwise(F.col("user_id")).cast("bigint").alias("user_id"))


@query("join_skew_split", "SELECT e.u AS user_id, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 < 4 THEN 1 ELSE user_id END AS u FROM events) e JOIN (SELECT DISTINCT user_id FROM events UNION SELECT 1) d ON e.u = d.user_id GROUP BY e.u")
def _skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the engine: the hot users' rows are dealt to several tasks, as many as their share asks for."""
    users = table(spark, sf_dir, "events").select("user_id").unionByName(spark.range(1, 2).select(F.col("id").alias("user_id"))).distinct()
    e = Engine(spark, {"events": _skewed(spark, sf_dir), "users": users})
    return e.sql("SELECT u.user_id, COUNT(*) AS n FROM events e JOIN users u ON e.user_id = u.user_id GROUP BY u.user_id", strategy="hash_shuffle", split=True)


@query("join_uncombined", _twin(JOIN_AGG, "total"))
def _join_uncombined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir, "orders", "customer").sql(JOIN_AGG, combiner=False))


@query("join_bloom_engine", _twin(JOIN_AGG, "total"))
def _join_bloom_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir, "orders", "customer").sql(JOIN_AGG, strategy="hash_shuffle", reduce=True))


@query("agg_uncombined", _twin(*STATEMENTS["agg_group_multi"]))
def _agg_uncombined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(engine(spark, sf_dir, "orders").sql(STATEMENTS["agg_group_multi"][0], combiner=False))


@query("agg_legacy_states", "SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 4) AS sum_price, round(sum(o_totalprice) / count(*), 4) AS avg_price, round(min(o_totalprice), 4) AS min_price, round(max(o_totalprice), 4) AS max_price FROM orders GROUP BY o_orderstatus")
def _legacy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of an old form, one a partition and group, merged and read."""
    o = table(spark, sf_dir, "orders")
    x = F.col("o_totalprice").cast("double")
    sums = F.map_from_arrays(F.array(*[F.lit(n) for n in ("price", "__min__price", "__max__price")]), F.array(F.sum(x), F.min(x), F.max(x)))
    partials = o.groupBy("o_orderstatus", (F.col("o_orderkey") % 5).alias("part")).agg(F.count("*").alias("count"), sums.alias("sums"))
    return rounded(aggregates.legacy_states(partials, ["o_orderstatus"], ["price"]))


_BUCKET = "(('0x' || substr(md5({0}::VARCHAR), 1, 8))::BIGINT % {1})::INTEGER"


@query("hot_bucket_report", f"WITH e AS (SELECT {_BUCKET.format('CASE WHEN event_id % 5 < 4 THEN 1 ELSE user_id END', 8)} AS bucket FROM events), n AS (SELECT bucket, count(*) AS n_rows FROM e GROUP BY bucket) SELECT bucket, n_rows, n_rows > 1.5 * (SELECT sum(n_rows) / count(*) FROM n) AS is_hot FROM n")
def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.bucket_report(_skewed(spark, sf_dir), "user_id", 8)


@query("join_null_keys", "SELECT a.k AS k, a.v AS v, b.w AS w FROM (VALUES (1, 'a'), (NULL, 'b'), (2, 'c')) a(k, v) JOIN (VALUES (1, 'x'), (NULL, 'y')) b(k, w) ON a.k = b.k")
def _null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(1, "x"), (None, "y")], "k int, w string")
    return Engine(spark, {"a": a, "b": b}).sql("SELECT a.k AS k, a.v AS v, b.w AS w FROM a JOIN b ON a.k = b.k")


# --- the gate and the binder over real schemas -------------------------------------------------------------------------


def _accepts(e: Engine, sql: str) -> bool:
    from .plans.binder import BindError
    from .plans.sqlgate import UnsupportedSQL

    try:
        e.plan(sql)
    except (BindError, UnsupportedSQL):
        return False
    return True


_TYPES = "SELECT column_name, column_type IN ('VARCHAR', 'DATE', 'TIMESTAMP', 'TIMESTAMP_NS', 'TIMESTAMP WITH TIME ZONE') AS is_text FROM (DESCRIBE lineitem)"


@query("bind_literal_types", f"SELECT column_name, is_text AS text_literal, NOT is_text AS number_literal FROM ({_TYPES})")
def _bind_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which literals each column of a table can be compared with."""
    e = engine(spark, sf_dir, "lineitem")
    rows = [(c, _accepts(e, f"SELECT {c} FROM lineitem WHERE {c} = 'x'"), _accepts(e, f"SELECT {c} FROM lineitem WHERE {c} = 1")) for c in e.tables["lineitem"].columns]
    return spark.createDataFrame(rows, "column_name string, text_literal boolean, number_literal boolean")


@query("bind_aggregate_types", f"SELECT column_name, true AS counts, NOT is_text AS sums, NOT is_text AS averages, false AS unknown FROM ({_TYPES})")
def _bind_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which aggregates each column of a table takes, and that a misspelt one takes none."""
    e = engine(spark, sf_dir, "lineitem")
    rows = [(c, *(_accepts(e, f"SELECT {f}({c}{x}) AS v FROM lineitem") for f, x in (("COUNT", ""), ("SUM", ""), ("AVG", ""), ("SUM", "_")))) for c in e.tables["lineitem"].columns]
    return spark.createDataFrame(rows, "column_name string, counts boolean, sums boolean, averages boolean, unknown boolean")


@query("bind_join_keys", "SELECT a.column_name AS left_key, b.column_name AS right_key, (a.column_type = 'VARCHAR') = (b.column_type = 'VARCHAR') AS accepted FROM (DESCRIBE nation) a, (DESCRIBE region) b")
def _bind_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of two tables can be joined on each other."""
    e = engine(spark, sf_dir, "nation", "region")
    rows = [(a, b, _accepts(e, f"SELECT n.n_name AS x FROM nation n JOIN region r ON n.{a} = r.{b}")) for a in e.tables["nation"].columns for b in e.tables["region"].columns]
    return spark.createDataFrame(rows, "left_key string, right_key string, accepted boolean")


_CALLS = ("upper({0})", "length({0})", "{0} || 'x'", "coalesce({0}, 'x')", "row_number() OVER (ORDER BY {0})", "count(*) OVER ()", "max({0}) FILTER (WHERE true)", "(SELECT {0})", "CASE WHEN true THEN {0} END", "{0}")


@query("gate_functions", "SELECT column_name, call, call = 'plain' AS accepted FROM (DESCRIBE customer), (VALUES ('upper'), ('length'), ('concat'), ('coalesce'), ('row_number'), ('count over'), ('filter'), ('subquery'), ('case'), ('plain')) v(call) WHERE column_type = 'VARCHAR'")
def _gate_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar and window functions, subqueries and CASE over every text column are refused; the plain column is not."""
    e = engine(spark, sf_dir, "customer")
    names = ("upper", "length", "concat", "coalesce", "row_number", "count over", "filter", "subquery", "case", "plain")
    rows = [(c, n, _accepts(e, f"SELECT {x.format(c)} FROM customer")) for c, t in e.tables["customer"].dtypes if t == "string" for n, x in zip(names, _CALLS, strict=True)]
    return spark.createDataFrame(rows, "column_name string, call string, accepted boolean")


@query("predicate_rendering", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 1000.5 AND o_orderstatus <> 'F' AND o_orderpriority != 'it''s' AND o_custkey < 900")
def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates of a plan as SQL text, names and quotes as they must be, read back by the SQL parser."""
    from .plans.compile import predicate_sql

    plan = engine(spark, sf_dir, "orders").plan("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 1000.5 AND o_orderstatus <> 'F' AND o_orderpriority != 'it''s' AND o_custkey < 900")
    return table(spark, sf_dir, "orders").where(" AND ".join(map(predicate_sql, plan.predicates))).select("o_orderkey", "o_orderstatus")


@query("row_budget", "SELECT max_rows, n > max_rows AS refused, CASE WHEN n > max_rows THEN NULL ELSE n END AS n_rows FROM (SELECT count(*) AS n FROM orders), (VALUES (100::BIGINT), (1000000)) v(max_rows)")
def _row_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.compile import ResultTooLarge

    def rows(most: int) -> int | None:
        try:
            return len(engine(spark, sf_dir, "orders").collect("SELECT o_orderkey FROM orders", max_rows=most))
        except ResultTooLarge:
            return None

    got = [(m, rows(m)) for m in (100, 1_000_000)]
    return spark.createDataFrame([(m, n is None, n) for m, n in got], "max_rows bigint, refused boolean, n_rows bigint")


# --- sources -----------------------------------------------------------------------------------------------------------


@query("ingest_types", "SELECT column_name, CASE WHEN column_type IN ('VARCHAR', 'DATE') OR column_type LIKE 'TIMESTAMP%' THEN 'string' ELSE 'number' END AS kind FROM (DESCRIBE lineitem) UNION ALL SELECT 'blank', 'number' UNION ALL SELECT 'mixed', 'string'")
def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types inferred from the text of a table's columns, of a blank column and of one in which a row is no number."""
    line = table(spark, sf_dir, "lineitem").limit(100)
    raw = line.select(*[F.col(c).cast("string").alias(c) for c in line.columns], F.lit(" ").alias("blank"), F.when(F.monotonically_increasing_id() == 3, "x").otherwise("1").alias("mixed"))
    return spark.createDataFrame(list(ingest.infer_types(raw).items()), "column_name string, kind string")


@query("ingest_partitions", "SELECT part, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, least((row_number() OVER (ORDER BY o_orderkey) - 1) // ceil(count(*) OVER () / 3.0)::BIGINT, 2)::INTEGER AS part FROM orders) GROUP BY part")
def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ingest.range_partitioned(table(spark, sf_dir, "orders").select("o_orderkey"), 3, ["o_orderkey"])
    return parts.groupBy("part").agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("column_stats", "SELECT 'o_orderkey' AS column_name, count(*) AS n_rows, count(*) - count(o_orderkey) AS n_null, min(o_orderkey)::VARCHAR AS least, max(o_orderkey)::VARCHAR AS greatest, true AS distinct_in_bound FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), min(o_orderstatus), max(o_orderstatus), true FROM orders")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    exact = o.agg(F.count_distinct("o_orderkey").alias("o_orderkey"), F.count_distinct("o_orderstatus").alias("o_orderstatus")).select(F.explode(F.create_map(F.lit("o_orderkey"), "o_orderkey", F.lit("o_orderstatus"), "o_orderstatus")).alias("column_name", "exact"))
    s = ingest.column_stats(o).join(exact, "column_name")
    return s.select("column_name", "n_rows", "n_null", "least", "greatest", (F.abs(F.col("approx_distinct") - F.col("exact")) <= 0.03 * F.col("exact")).alias("distinct_in_bound"))


@query("csv_roundtrip", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "nation") + ".csv"
    table(spark, sf_dir, "nation").coalesce(1).write.option("header", True).csv(path)
    catalog = ingest.Catalog(spark, workspace(spark, "catalog"))
    catalog.ingest_csv("nation", path)
    return catalog.table("nation")


@query("durable_result", "SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::BIGINT AS row_index, r_name FROM region")
def _durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.durable(table(spark, sf_dir, "region").orderBy("r_regionkey"), workspace(spark, "rows"))
    return rows.select("row_index", F.get_json_object("row", "$.r_name").alias("r_name"))


@query("shuffle_bucket_files", f"SELECT {_BUCKET.format('o_custkey', 4)} AS bucket, count(*) AS n_rows FROM orders GROUP BY 1")
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.write_buckets(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 4, workspace(spark, "buckets"))
    return out.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("n_rows"))


def _csv_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = workspace(spark, name) + ".csv"
    table(spark, sf_dir, name).coalesce(1).write.option("header", True).csv(path)
    return path


@query("csv_prescan", "SELECT count(*) AS n_rows, 'n_nationkey,n_name,n_regionkey' AS header, 64 AS checksum_digits, true AS checksum_repeats FROM nation")
def _prescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _csv_of(spark, sf_dir, "nation")
    one, two = ingest.scan_csv(spark, path), ingest.scan_csv(spark, path)
    return spark.createDataFrame([(one.rows, ",".join(one.columns), len(one.checksum), one.checksum == two.checksum)], "n_rows bigint, header string, checksum_digits int, checksum_repeats boolean")


@query("csv_row_groups", "SELECT part, count(*) AS n_rows, min(l_orderkey)::DOUBLE AS least, max(l_orderkey)::DOUBLE AS greatest, true AS groups_in_limit FROM (SELECT l_orderkey, least((row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // ceil(count(*) OVER () / 3.0)::BIGINT, 2)::INTEGER AS part FROM lineitem) GROUP BY part")
def _row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV becomes one Parquet file a range, in row groups of 10,000 rows at most, as their footers say."""
    path = workspace(spark, "lineitem") + ".csv"
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").coalesce(1).sortWithinPartitions("l_orderkey", "l_linenumber").write.option("header", True).csv(path)
    d = ingest.Catalog(spark, workspace(spark, "catalog")).ingest_csv("lineitem", path, 3)
    out = None
    for p in range(3):
        g = ingest.row_group_stats(spark, f"{d.path}/part={p}", "l_orderkey")
        one = g.agg(F.lit(p).alias("part"), F.sum("n_rows").alias("n_rows"), F.min(F.col("least").cast("double")).alias("least"), F.max(F.col("greatest").cast("double")).alias("greatest"), (F.max("n_rows") <= 10_000).alias("groups_in_limit"))
        out = one if out is None else out.unionByName(one)
    return out


@query("row_group_statistics", "SELECT count(*) AS n_rows, count(*) - count(o_orderkey) AS n_null, min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM orders")
def _group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.row_group_stats(spark, f"{sf_dir}/orders.parquet", "o_orderkey")
    return g.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min(F.col("least").cast("bigint")).alias("least"), F.max(F.col("greatest").cast("bigint")).alias("greatest"))


@query("pruned_row_groups", "SELECT count(*) AS n_rows, true AS adds_up, true AS skips FROM lineitem WHERE l_orderkey > (SELECT 0.8 * max(l_orderkey) FROM lineitem)")
def _pruned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted rows in small groups: a selective predicate skips bytes, and the rows it wants are in the groups that stay."""
    out = workspace(spark, "sorted")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    line.orderBy("l_orderkey").write.option("parquet.block.row.count.limit", 2_000).parquet(out)
    cut = 0.8 * line.agg(F.max("l_orderkey")).first()[0]
    groups = ingest.row_group_stats(spark, out, "l_orderkey")
    kept = groups.where(F.col("greatest").cast("double") > cut).agg(F.sum("n_rows")).first()[0] or 0
    read, skipped = ingest.pruned_scan(spark, out, "l_orderkey", ">", cut)
    total = groups.agg(F.sum("compressed_bytes")).first()[0]
    n = spark.read.parquet(out).where(F.col("l_orderkey") > cut).count()
    return spark.createDataFrame([(n, read + skipped == total and kept >= n, skipped > read)], "n_rows bigint, adds_up boolean, skips boolean")


@query("csv_row_scan", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation WHERE n_regionkey >= 2 AND n_name > 'F'")
def _row_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.scan_rows(spark, _csv_of(spark, sf_dir, "nation"), "n_regionkey >= 2 AND n_name > 'F'")


@query("csv_missing_column", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1 AND n_regionkey >= 0")
def _missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a column fail every predicate on it: here the even ones."""
    path = workspace(spark, "ragged") + ".csv"
    whole = F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey")
    lines = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat_ws(",", "n_nationkey", "n_name")).otherwise(whole).alias("value"), F.col("n_nationkey").alias("o"))
    head = spark.createDataFrame([("n_nationkey,n_name,n_regionkey", -1)], "value string, o bigint")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return ingest.scan_rows(spark, path, "n_regionkey >= 0", ragged=True).select("n_nationkey", "n_name")


@query("parquet_alternate_scan", "SELECT 'customer.parquet' AS file, true AS accepted, count(*) AS n_rows FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'customer.csv', false, 0")
def _alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of some columns that reads Parquet files and refuses others."""
    n = ingest.parquet_scan(spark, f"{sf_dir}/customer.parquet", ["c_custkey"], "c_acctbal > 0").count()
    try:
        ingest.parquet_scan(spark, _csv_of(spark, sf_dir, "region"), ["c_custkey"])
        refused = False
    except ingest.NotParquet:
        refused = True
    return spark.createDataFrame([("customer.parquet", True, n), ("customer.csv", not refused, 0)], "file string, accepted boolean, n_rows bigint")


@query("object_store", "SELECT n_nationkey, n_name FROM nation")
def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = workspace(spark, "store")
    source = sf_dir if "://" in sf_dir else f"file://{sf_dir}"
    sinks.put_object(spark, store, "datasets", "nation.parquet", f"{source}/nation.parquet")
    return sinks.get_object(spark, store, "datasets", "nation.parquet").select("n_nationkey", "n_name")


@query("storage_switch", "SELECT storage, r_regionkey::DOUBLE AS r_regionkey, r_name FROM region, (VALUES ('parquet'), ('csv')) v(storage)")
def _switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ingest.Catalog(spark, workspace(spark, "catalog"))
    c.ingest_csv("region", _csv_of(spark, sf_dir, "region"))
    one = c.table("region").select(F.lit("parquet").alias("storage"), "r_regionkey", "r_name")
    c.switch_storage("region", "csv")
    return one.unionByName(c.table("region").select(F.lit("csv").alias("storage"), "r_regionkey", "r_name"))


@query("catalog_list", "SELECT 'nation' AS name, count(*) AS n_rows, 3 AS n_partitions, 'parquet' AS storage FROM nation UNION ALL SELECT 'regions', count(*), 1, 'parquet' FROM region")
def _catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets as a later process finds them."""
    root = workspace(spark, "catalog")
    c = ingest.Catalog(spark, root)
    c.ingest_csv("nation", _csv_of(spark, sf_dir, "nation"))
    c.materialize("regions", table(spark, sf_dir, "region").coalesce(1))
    return ingest.Catalog(spark, root).list().select("name", "n_rows", "n_partitions", "storage")


@query("arrow_transport", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as an Arrow IPC stream of text columns, and back."""
    return spark.createDataFrame(sinks.from_ipc(sinks.to_ipc(table(spark, sf_dir, "nation"))).to_pandas())


@query("live_stream_messages", "SELECT type, n FROM (VALUES ('subscribed', 1::BIGINT), ('chaos', 1), ('complete', 1)) v(type, n) UNION ALL SELECT 'row', count(*) FROM nation UNION ALL SELECT 'progress', count(*) // 10 FROM nation")
def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = control.Chaos()
    c.arm("delay", delay_ms=1)
    seen: dict[str, int] = {}
    for m in sinks.live(table(spark, sf_dir, "nation"), "q", every=10, chaos=c):
        seen[m["type"]] = seen.get(m["type"], 0) + 1
    return spark.createDataFrame(list(seen.items()), "type string, n bigint")


@query("live_replay", "SELECT place, o_orderkey FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS place, o_orderkey FROM orders) WHERE place >= 100")
def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber that comes late gets: all rows from a place on, none lost."""
    path = workspace(spark, "rows")
    sinks.durable(table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey"), path)
    return sinks.replayed(path, spark, 100).select(F.col("row_index").alias("place"), F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query("result_resort", "SELECT (row_number() OVER (ORDER BY c_name DESC) - 1)::BIGINT AS place, c_custkey, c_name FROM customer")
def _resort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.resorted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", descending=True)


@query("result_export", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders WHERE o_custkey < 100")
def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "export")
    sinks.export_csv(table(spark, sf_dir, "orders").where("o_custkey < 100").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.option("header", True).csv(path)


# --- approximate -------------------------------------------------------------------------------------------------------


def _distinct(name: str, expr: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "lineitem").select(F.expr(expr).alias("v"))
        a = e.agg(sketches.approx_distinct("v", 14).alias("est"), F.count_distinct("v").alias("exact"))
        bound = sketches.configured_error("approx_count_distinct", precision=14)
        return a.select("exact", (F.abs(F.col("est") - F.col("exact")) <= F.lit(2 * bound) * F.col("exact")).alias("within_bound"))

    QUERIES[name] = run
    SQL[name] = f"SELECT count(DISTINCT {sql}) AS exact, true AS within_bound FROM lineitem"


_distinct("approx_distinct_uniform", "l_orderkey * 10 + l_linenumber", "l_orderkey * 10 + l_linenumber")
_distinct("approx_distinct_zipf", "CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_partkey END", "CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_partkey END")
_distinct("approx_distinct_adversarial", "l_orderkey * 65536", "l_orderkey * 65536")


@query("approx_percentile", "SELECT q, true AS within_bound FROM (VALUES (0.5::DOUBLE), (0.95), (0.99)) v(q)")
def _percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    qs = [0.5, 0.95, 0.99]
    est = x.agg(*[sketches.approx_percentile("l_extendedprice", q).alias(f"p{i}") for i, q in enumerate(qs)])
    ranks = x.crossJoin(F.broadcast(est)).agg(F.count("*").alias("n"), *[F.count_if(F.col("l_extendedprice") <= F.col(f"p{i}")).alias(f"r{i}") for i in range(3)])  # est: one row
    bound = 0.005
    return ranks.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.abs(F.col(f"r{i}") / F.col("n") - q) <= bound).alias("within_bound")) for i, q in enumerate(qs)])).alias("e")).select("e.*")


@query("heavy_hitters", "SELECT event_type AS item, count(*) AS n_rows FROM events GROUP BY event_type")
def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.heavy_hitters(table(spark, sf_dir, "events"), "event_type", 10)


@query("count_min", "SELECT event_type AS v, true AS within_bound FROM events GROUP BY event_type")
def _count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    exact = e.groupBy(F.col("event_type").alias("v")).agg(F.count("*").alias("n"))
    est = sketches.frequency_of(sketches.frequency(e, "event_type"), exact.select("v"))
    total = e.agg(F.count("*").alias("total"))
    return est.join(exact, "v").crossJoin(F.broadcast(total)).select("v", ((F.col("estimate") >= F.col("n")) & (F.col("estimate") - F.col("n") <= F.lit(sketches.configured_error("heavy_hitters", width=2048)) * F.col("total"))).alias("within_bound"))  # total: one row


@query("sample_bottom_k", "SELECT c_custkey, c_name FROM customer ORDER BY sha256(c_custkey::VARCHAR), c_custkey LIMIT 40")
def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.bottom_k(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 40)


@query("bloom_no_false_negatives", "SELECT count(DISTINCT o_custkey) AS n_keys, 0::BIGINT AS n_missed FROM orders")
def _bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey")
    found = sketches.bloom_might_contain(o, "o_custkey", sketches.bloom_bits(o, "o_custkey"))
    return found.agg(F.count("*").alias("n_keys"), F.count_if(~F.col("might")).alias("n_missed"))


@query("partition_histogram", f"SELECT {_BUCKET.format('o_custkey', 8)} AS bucket, count(*) AS n_rows FROM orders GROUP BY 1")
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.partition_histogram(table(spark, sf_dir, "orders"), "o_custkey", 8)


@query("sketch_merge_percentile", "SELECT q, true AS within_bound FROM (VALUES (0.5::DOUBLE), (0.95), (0.99)) v(q)")
def _merged_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile states of three parts of a table, merged; rank errors against the exact ranks."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    state = x.groupBy(F.col("l_orderkey") % 3).agg(sketches.percentile_sketch("l_extendedprice", 800).alias("s")).agg(sketches.percentile_merged("s").alias("s"))
    qs = [0.5, 0.95, 0.99]
    est = state.select(*[sketches.percentile_of(F.col("s"), q).alias(f"p{i}") for i, q in enumerate(qs)])
    ranks = x.crossJoin(F.broadcast(est)).agg(F.count("*").alias("n"), *[F.count_if(F.col("l_extendedprice") <= F.col(f"p{i}")).alias(f"r{i}") for i in range(3)])  # est: one row
    return ranks.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), (F.abs(F.col(f"r{i}") / F.col("n") - q) <= 0.006).alias("within_bound")) for i, q in enumerate(qs)])).alias("e")).select("e.*")


@query("sketch_merge_top", "SELECT event_type AS item, count(*) AS n_rows FROM events GROUP BY event_type")
def _merged_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "events").groupBy(F.col("event_id") % 3).agg(sketches.top_sketch("event_type").alias("s")).agg(sketches.top_merged("s").alias("s"))
    return state.select(F.explode(sketches.top_of("s", 50)).alias("e")).select(F.col("e.item").alias("item"), F.col("e.count").alias("n_rows"))


@query("sketch_merge_distinct", "SELECT count(DISTINCT o_custkey) AS exact, true AS within_bound FROM orders")
def _merged_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    est = o.groupBy(F.col("o_orderkey") % 3).agg(sketches.distinct_sketch("o_custkey", 14).alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("est"))
    exact = o.agg(F.count_distinct("o_custkey").alias("exact"))
    return exact.crossJoin(F.broadcast(est)).select("exact", (F.abs(F.col("est") - F.col("exact")) <= 0.01625 * F.col("exact")).alias("within_bound"))  # one row each


@query("sketch_merge_bloom", "SELECT count(*) AS n_parts, true AS equal FROM (VALUES (1), (2), (3)) v(p)")
def _merged_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter of a table is the union of the filters of its parts."""
    o = table(spark, sf_dir, "orders").select("o_custkey")
    parts = [sketches.bloom_bits(o.where(F.col("o_custkey") % 3 == p), "o_custkey") for p in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = sketches.bloom_bits(o, "o_custkey")
    gap = merged.join(whole.withColumnRenamed("bits", "b2"), "word", "full").where("NOT bits <=> b2").limit(1)
    return spark.createDataFrame([(len(parts), gap.isEmpty())], "n_parts bigint, equal boolean")


@query("hash64_seeded", "SELECT c_custkey, ('0x' || substr(sha256('42'::BLOB || '\\x00'::BLOB || c_custkey::VARCHAR::BLOB), 1, 16))::UBIGINT::DECIMAL(20, 0) AS h FROM customer")
def _hash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", sketches.hash64(F.col("c_custkey"), 42).alias("h"))


@query("checksum_canonical", "SELECT count(*) AS n_rows, true AS equal FROM lineitem")
def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as whole ones, doubles and text with zeros have one checksum in canonical form."""
    line = table(spark, sf_dir, "lineitem")
    forms = [line.select(F.col("l_orderkey").cast(t).alias("k"), F.col("l_quantity").cast(u).alias("q")) for t, u in (("bigint", "double"), ("double", "decimal(12,4)"), ("string", "string"))]
    sums = {tuple(checksum.semantic_checksum(checksum.canonical(f)).first()) for f in forms}
    return spark.createDataFrame([(max(s[0] for s in sums), len(sums) == 1)], "n_rows bigint, equal boolean")


@query("approx_runs_log", "SELECT 'approx_count_distinct' AS operation, round(1.04 / 64, 6) AS configured_error, true AS observed_small, count(*) AS n_rows, true AS state_is_small FROM orders UNION ALL SELECT 'sample', NULL, NULL, count(*), NULL FROM orders")
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, as a later process reads them from the log."""
    path, o = workspace(spark, "runs"), table(spark, sf_dir, "orders")
    log, n = sketches.Runs(spark=spark, path=path), o.count()
    exact = o.select("o_custkey").distinct().count()
    size = o.agg(F.octet_length(sketches.distinct_sketch("o_custkey")).alias("b")).first()["b"]
    log.record("sample", lambda: sketches.bottom_k(o.select("o_orderkey"), "o_orderkey", 10).collect(), rows=n)
    log.record("approx_count_distinct", lambda: o.agg(sketches.approx_distinct("o_custkey").alias("d")).first()["d"], exact, state_bytes=size, rows=n, precision=12)
    return sketches.Runs(spark=spark, path=path).table(spark).select("operation", F.round("configured_error", 6).alias("configured_error"), (F.col("observed_error") <= 0.0325).alias("observed_small"), F.col("rows").alias("n_rows"), (F.col("state_bytes") <= 16_524).alias("state_is_small"))


@query("partition_explorer", f"WITH n AS (SELECT {_BUCKET.format('o_custkey', 8)} AS bucket, count(*) AS c FROM orders GROUP BY 1), a AS (SELECT range::INTEGER AS bucket, coalesce(c, 0) AS n_rows FROM range(8) LEFT JOIN n ON n.bucket = range) SELECT bucket, n_rows, round(n_rows / (SELECT sum(n_rows) FROM a), 4) AS share, n_rows > 1.5 * (SELECT avg(n_rows) FROM a) AS is_hot, round((SELECT stddev_pop(n_rows) / avg(n_rows) FROM a), 4) AS cv, round((SELECT max(n_rows) / avg(n_rows) FROM a), 4) AS skew_ratio FROM a")
def _explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyze.partition_explorer(table(spark, sf_dir, "orders"), "o_custkey", 8))


# --- streams, replayed in batch ----------------------------------------------------------------------------------------

_T = "(epoch_ns(ts) // 1000000)"
_ARRIVAL = "((event_id * 7919) % 1000003)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with t (milliseconds), and seq, a permuted order of arrival. Where there are more than 1,000,003 events, places are shared:
    their events come in the order of event_id (``TIE``), one of the orders that the SQL leaves open."""
    zero = F.unix_micros(F.expr("cast(timestamp_ntz'1970-01-01 00:00:00' as timestamp)"))
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - zero) / 1000).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t.alias("t"), ((F.col("event_id") * 7919) % 1000003).alias("seq"))


HOUR = 3_600_000
TUMBLE = StreamConfig("q", "events", "TUMBLE", 6 * HOUR, group_by="event_type", total="value")
HOP = StreamConfig("q", "events", "HOP", 6 * HOUR, slide=2 * HOUR, group_by="event_type")
UNEVEN = StreamConfig("q", "events", "HOP", 5 * HOUR, slide=2 * HOUR)
SESSION = StreamConfig("q", "events", "SESSION", 6 * HOUR, gap=6 * HOUR, group_by="user_id")
LATE = 24 * HOUR
TIE = "event_id"


@query("stream_tumble", f"SELECT ({_T} // {6 * HOUR}) * {6 * HOUR} AS window_start, ({_T} // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR} AS window_end, event_type AS group_key, count(*) AS event_count, round(sum(coalesce(value, 0)), 4) AS total FROM events GROUP BY 1, 2, 3")
def _tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.windowed(events(spark, sf_dir), TUMBLE))


def _hop_sql(slide: int, size: int, key: str) -> str:
    n = -(-size // slide)
    return f"SELECT ws AS window_start, ws + {size} AS window_end, {key} AS group_key, count(*) AS event_count FROM (SELECT *, ({_T} // {slide}) * {slide} - i.range * {slide} AS ws FROM events, range({n + 1}) i) WHERE ws > {_T} - {size} GROUP BY 1, 2, 3"


@query("stream_hop", _hop_sql(2 * HOUR, 6 * HOUR, "event_type"))
def _hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(events(spark, sf_dir), HOP)


@query("stream_hop_uneven", _hop_sql(2 * HOUR, 5 * HOUR, "''"))
def _hop_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(events(spark, sf_dir), UNEVEN)


@query("stream_session", f"WITH e AS (SELECT user_id, {_T} AS t FROM events), m AS (SELECT *, max(t + {6 * HOUR}) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e), s AS (SELECT *, count(*) FILTER (b IS NULL OR t > b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT min(t) AS window_start, max(t) + {6 * HOUR} AS window_end, user_id::VARCHAR AS group_key, count(*) AS event_count FROM s GROUP BY user_id, k")
def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(events(spark, sf_dir), SESSION)


def _late_sql(allowed: int) -> str:
    return f"SELECT event_id, t, seq, coalesce(top - {allowed} > 0 AND t <= top - {allowed}, false) AS late, coalesce(t < top, false) AND NOT coalesce(top - {allowed} > 0 AND t <= top - {allowed}, false) AS accepted_late FROM (SELECT event_id, t, seq, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT event_id, {_T} AS t, {_ARRIVAL} AS seq FROM events))"


@query("stream_late_audit", f"SELECT event_id, t FROM ({_late_sql(LATE)}) WHERE late")
def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lateness(events(spark, sf_dir), LATE, tie=TIE).where("late").select("event_id", "t")


@query("stream_accepted_late", f"SELECT count(*) AS n, count(*) FILTER (late) AS late, count(*) FILTER (accepted_late) AS accepted_late FROM ({_late_sql(LATE)})")
def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lateness(events(spark, sf_dir), LATE, width=1_000, tie=TIE).agg(F.count("*").alias("n"), F.count_if("late").alias("late"), F.count_if("accepted_late").alias("accepted_late"))


@query("stream_lateness_zero", f"SELECT count(*) FILTER (late) AS late, count(*) FILTER (accepted_late) AS accepted_late FROM ({_late_sql(0)})")
def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lateness(events(spark, sf_dir), 0, tie=TIE).agg(F.count_if("late").alias("late"), F.count_if("accepted_late").alias("accepted_late"))


@query("stream_finalized", f"SELECT (t // {6 * HOUR}) * {6 * HOUR} AS window_start, count(*) AS event_count, (t // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR} <= (SELECT max({_T}) FROM events) - {LATE} AS finalized FROM ({_late_sql(LATE)}) WHERE NOT late GROUP BY t // {6 * HOUR}")
def _finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = windows.lateness(events(spark, sf_dir), LATE, tie=TIE)
    top = e.agg(F.max("t").alias("top"))
    w = windows.windowed(e.where("NOT late"), StreamConfig("q", "events", "TUMBLE", 6 * HOUR))
    return w.crossJoin(F.broadcast(top)).select("window_start", "event_count", (F.col("window_end") <= F.col("top") - LATE).alias("finalized"))  # top: one row


@query("stream_distinct", f"SELECT ({_T} // {24 * HOUR}) * {24 * HOUR} AS window_start, count(DISTINCT user_id) AS exact_users, true AS within_bound FROM events GROUP BY 1")
def _stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = StreamConfig("q", "events", "TUMBLE", 24 * HOUR, distinct="user_id")
    e = events(spark, sf_dir)
    est = windows.windowed(e, c).select("window_start", "distinct_users")
    exact = windows.assigned(e, c).groupBy("window_start").agg(F.count_distinct("user_id").alias("exact_users"))
    return est.join(exact, "window_start").select("window_start", "exact_users", (F.abs(F.col("distinct_users") - F.col("exact_users")) <= 0.01625 * F.col("exact_users") + 0.5).alias("within_bound"))


def _replayed(spark: SparkSession, sf_dir: str, batches: int = 3, **how) -> StandingQuery:
    """A standing query over the events in as many micro-batches, by arrival; places below 0 (of negative ids) are in the first."""
    c = StreamConfig("replay", "events", "TUMBLE", 24 * HOUR, lateness=LATE, group_by="event_type", total="value", distinct="user_id", frequent="event_type", tie=TIE, sql_nulls=True, **how)
    q = StandingQuery(spark, c, workspace(spark, "standing"))
    e = events(spark, sf_dir)
    for b in range(batches):
        q.process(e.where(F.greatest(F.lit(0), F.floor(F.col("seq") * batches / 1000003)) == b), b)
    return q


@query("stream_epoch_snapshot", f"SELECT (t // {24 * HOUR}) * {24 * HOUR} AS window_start, e.event_type AS group_key, count(*) AS event_count, round(sum(coalesce(value, 0)), 4) AS total, 2::BIGINT AS epoch FROM ({_late_sql(LATE)}) l JOIN events e USING (event_id) WHERE NOT late GROUP BY 1, 2")
def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_replayed(spark, sf_dir).snapshot().select("window_start", "group_key", "event_count", "total", "epoch"))


@query("stream_batch_ledger", f"SELECT (seq * 3 // 1000003)::BIGINT AS batch_id, count(*) AS events, count(*) FILTER (NOT late) AS accepted, count(*) FILTER (accepted_late) AS accepted_late, count(*) FILTER (late) AS late FROM ({_late_sql(LATE)}) GROUP BY 1")
def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).ledger().select("batch_id", "events", "accepted", "accepted_late", "late")


@query("stream_heavy_hitters", f"SELECT (t // {24 * HOUR}) * {24 * HOUR} AS window_start, e.event_type AS group_key, e.event_type AS item, count(*) AS n FROM ({_late_sql(LATE)}) l JOIN events e USING (event_id) WHERE NOT late GROUP BY 1, 2")
def _stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).top_items()


@query("stream_materialize", f"SELECT strftime(make_timestamp((t // {24 * HOUR}) * {24 * HOUR} * 1000), '%Y-%m-%dT%H:%M:%S.000Z') AS window_start, e.event_type AS group_key, count(*) AS event_count, e.event_type AS top_item FROM ({_late_sql(LATE)}) l JOIN events e USING (event_id) WHERE NOT late GROUP BY 1, 2, t // {24 * HOUR}")
def _materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).materialize(workspace(spark, "materialized")).select("window_start", "group_key", "event_count", "top_item")


@query("stream_exact_eval", f"SELECT count(DISTINCT user_id) AS exact_distinct, 0.0::DOUBLE AS frequency_error FROM events")
def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    exact = e.groupBy("event_type").agg(F.count("*").alias("n"))
    est = sketches.heavy_hitters(e, "event_type").withColumnRenamed("item", "event_type")
    gap = exact.join(est, "event_type", "left").agg((F.max(F.abs(F.coalesce("n_rows", F.lit(0)) - F.col("n"))) / F.sum("n")).alias("frequency_error"))
    return e.agg(F.count_distinct("user_id").alias("exact_distinct")).crossJoin(F.broadcast(gap))  # one row each


@query("stream_statement", "SELECT 'q' || n_nationkey AS name, n_name AS topic, CASE n_nationkey % 3 WHEN 0 THEN 'TUMBLE' WHEN 1 THEN 'HOP' ELSE 'SESSION' END AS kind, CASE WHEN n_nationkey % 3 = 1 THEN 1000 * (1 + n_regionkey) END AS slide, 60000 * (1 + n_nationkey) AS size, 1000 * n_regionkey AS lateness, 'user_id' AS distinct_column, 'amount' AS total_column FROM (SELECT n_nationkey, n_regionkey, replace(n_name, ' ', '_') AS n_name FROM nation)")
def _statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A REGISTER statement for each nation, parsed."""
    out = []
    for k, n, r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        kind = ("TUMBLE", "HOP", "SESSION")[k % 3]
        slide = f"INTERVAL '{1 + r}' SECOND, " if kind == "HOP" else ""
        c = parse_statement(f"REGISTER QUERY q{k} AS SELECT COUNT(DISTINCT user_id), SUM(amount) FROM {n.replace(' ', '_')} WINDOW {kind}(ts, {slide}INTERVAL '{1 + k}' MINUTE) WATERMARK INTERVAL '{r}' SECOND")
        out.append((c.name, c.topic, c.window, c.slide, c.size, c.lateness, c.distinct, c.total))
    return spark.createDataFrame(out, "name string, topic string, kind string, slide bigint, size bigint, lateness bigint, distinct_column string, total_column string")


# --- lazy plans, lineage, runtime, analysis ----------------------------------------------------------------------------

_LAZY = "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"


@query("lazy_collect", _LAZY)
def _lazy_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = LazyPlan(engine(spark, sf_dir, "orders"), _LAZY, ("groupBy", "aggregate"))
    return spark.createDataFrame(plan.collect(), "o_orderstatus string, n bigint")


@query("lazy_count", f"SELECT count(*) AS n_rows FROM ({_LAZY})")
def _lazy_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(LazyPlan(engine(spark, sf_dir, "orders"), _LAZY).count(),)], "n_rows bigint")


@query("lazy_materialize", f"SELECT o_orderstatus, n FROM ({_LAZY}) WHERE n > 0")
def _lazy_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    LazyPlan(e, _LAZY).materialize(ingest.Catalog(spark, workspace(spark, "catalog")), "by_status")
    return e.sql("SELECT o_orderstatus, n FROM by_status WHERE n > 0")


@query("cache_levels_checksum", "SELECT * FROM (VALUES ('NONE', true), ('MEMORY', true), ('DISK', true), ('MEMORY_AND_DISK', true)) v(level, equal)")
def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = lambda: engine(spark, sf_dir, "orders").sql(_LAZY)
    want = checksum.semantic_checksum(plan()).first()["checksum"]
    rows = []
    for level in ("NONE", "MEMORY", "DISK", "MEMORY_AND_DISK"):
        cache = Cache()
        sums = [checksum.semantic_checksum(cache.get("q", plan, 1_000, level)).first()["checksum"] for _ in range(2)]
        rows.append((level, sums == [want, want]))
        cache.clear()
    return spark.createDataFrame(rows, "level string, equal boolean")


def _graph(spark: SparkSession) -> Lineage:
    g = Lineage(spark)
    g.add("src", "source", "scan")
    g.add("filter", "transformation", "filter", ["src"])
    g.add("agg", "transformation", "aggregate", ["filter"])
    g.add("out", "materialization", "write", ["agg"])
    g.add("side", "transformation", "project", ["src"])
    return g


@query("lineage_descendants", "SELECT * FROM (VALUES ('filter', 1), ('agg', 2), ('out', 3), ('side', 1)) v(id, depth)")
def _descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(*_graph(spark).tables(), "src")


@query("lineage_nearest_ancestor", "SELECT * FROM (VALUES ('agg', 1), ('filter', 2), ('src', 3)) v(id, depth)")
def _ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available_ancestors(*_graph(spark).tables(), "out")


@query("lineage_recover_partition", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 2")
def _recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, orders = Lineage(spark), table(spark, sf_dir, "orders")
    step = lambda df: df.select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("part"))
    g.add("orders", "source", "scan", frame=orders)
    g.add("out", "transformation", "project", ["orders"], frame=step(orders), step=step)
    g.add_partitions("out", step(orders), "part", [0, 1, 2, 3])
    g.invalidate("out/2")
    g.lose("out")  # the nearest ancestor is gone, the next one serves
    return g.recover("out/2").select("o_orderkey")


@query("checksum_semantic", "SELECT count(*) AS n_rows, sum(('0x' || substr(sha256(concat_ws('|', coalesce('=' || n_name, '~'), coalesce('=' || n_nationkey::VARCHAR, '~'), coalesce('=' || n_regionkey::VARCHAR, '~'))), 1, 15))::BIGINT)::VARCHAR AS checksum FROM nation")
def _checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum.semantic_checksum(table(spark, sf_dir, "nation"))


@query("checksum_ordered", "SELECT sum(('0x' || substr(sha256(concat_ws('#', r_regionkey::VARCHAR, concat_ws('|', coalesce('=' || r_name, '~'), coalesce('=' || r_regionkey::VARCHAR, '~')))), 1, 15))::BIGINT)::VARCHAR AS checksum FROM region")
def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum.ordered_checksum(table(spark, sf_dir, "region"), "r_regionkey")


@query("legacy_strings", "SELECT coalesce(o_orderkey::VARCHAR, '') AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus FROM orders")
def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum.legacy_strings(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@query("feedback_ema", "SELECT o_orderstatus, count(*) AS runs, round(list_reduce(list(o_totalprice::DOUBLE ORDER BY o_orderkey), lambda x, y: 0.7 * x + 0.3 * y), 4) AS rows_ema FROM orders WHERE o_custkey < 20 GROUP BY o_orderstatus")
def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average of many runs of a few statements."""
    f = control.Feedback()
    for r in table(spark, sf_dir, "orders").where("o_custkey < 20").orderBy("o_orderkey").select("o_orderstatus", "o_totalprice").collect():
        f.record(r["o_orderstatus"], float(r["o_totalprice"]), 1.0)
    return rounded(spark.createDataFrame([(k, v["runs"], v["rows"]) for k, v in f.known.items()], "o_orderstatus string, runs bigint, rows_ema double"))


@query("speculation_threshold", "SELECT l_orderkey, greatest(250.0, ceil(1.5 * w[1 + least(len(w) - 1, floor(0.75 * len(w))::INTEGER)])) AS threshold FROM (SELECT l_orderkey, list_sort(list(20 * l_quantity::DOUBLE)) AS w FROM lineitem WHERE l_orderkey < 500 GROUP BY l_orderkey)")
def _speculation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as sibling tasks, with times by quantity."""
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey < 500").groupBy("l_orderkey").agg(F.collect_list(20 * F.col("l_quantity").cast("double")).alias("w")).collect()
    return spark.createDataFrame([(r["l_orderkey"], control.speculation_threshold(r["w"])) for r in rows], "l_orderkey bigint, threshold double")


@query("admission_order", "SELECT ticket, (row_number() OVER (ORDER BY ticket <> 0, -priority, ticket))::BIGINT AS place FROM (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS ticket, n_nationkey * 7 % 21 - 10 AS priority FROM nation)")
def _admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each nation, with priorities: the first runs at once, the others by priority, then arrival."""
    a = control.Admission(slots=1)
    for k in sorted(r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()):
        a.submit(k * 7 % 21 - 10)
    order, now = [0], 0
    while (now := a.release(now)) is not None:
        order.append(now)
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(order)], "ticket bigint, place bigint")


@query("chaos_checksum", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _chaos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = control.Chaos()
    c.arm("delay", partition=0, delay_ms=50)
    return c.injected(table(spark, sf_dir, "lineitem").select("l_returnflag")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def tasks(spark: SparkSession) -> DataFrame:
    """Three task attempts, one of them slow."""
    some = [("t1", 100.0, 10, 100, 10), ("t2", 1000.0, 20, 200, 20), ("t3", 100.0, 10, 100, 10)]
    return spark.createDataFrame([(i, "w", "completed", 1, True, w, r, b, x, int(w * 500), 64, 0, "scan", r, r) for i, w, r, b, x in some], analyze.TASKS)


def _line_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a table as task attempts: operators by flag, failed ones by number, times and bytes by quantity and price."""
    q, p = F.col("l_quantity").cast("double"), F.floor("l_extendedprice").cast("bigint")
    status = F.when(F.col("l_linenumber") == 7, "failed").when(F.col("l_linenumber") == 6, "cancelled").otherwise("completed")
    columns = [F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit("w"), status, (F.col("l_linenumber") % 2 + 1).cast("int"), status == "completed", q, F.col("l_linenumber").cast("bigint"), p, (p % 100).cast("bigint"), (q * 500).cast("bigint"), p, F.lit(0).cast("bigint"), F.col("l_returnflag"), F.lit(4).cast("bigint"), F.col("l_linenumber").cast("bigint")]
    names = [c.split()[0] for c in analyze.TASKS.split(", ")]
    return table(spark, sf_dir, "lineitem").select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])


_TASK_SQL = "(SELECT CASE l_linenumber WHEN 7 THEN 'failed' WHEN 6 THEN 'cancelled' ELSE 'completed' END AS status, l_linenumber AS line, l_linenumber % 2 + 1 AS attempt, l_quantity::DOUBLE AS q, floor(l_extendedprice)::BIGINT AS p, l_returnflag AS operator FROM lineitem)"


@query("autopsy_totals", f"SELECT count(*) AS attempts, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (attempt > 1) AS retried, sum(p)::BIGINT AS storage, sum(p % 100)::BIGINT AS communication, round(sum((q * 500)::BIGINT) / 1000, 4) AS computation, max(q) FILTER (status = 'completed') AS critical_ms, max(p) AS memory, round(sum((q * 500)::BIGINT) FILTER (status = 'failed') / 1000, 4) AS recomputation, round(max(q) FILTER (status = 'completed') / median(q) FILTER (status = 'completed'), 4) AS straggler_ratio, round(avg(abs(line - 4) / 4), 4) AS cardinality_error FROM {_TASK_SQL}")
def _autopsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyze.autopsy(_line_tasks(spark, sf_dir)).select("attempts", "failed", "retried", "storage", "communication", "computation", "critical_ms", "memory", "recomputation", "straggler_ratio", "cardinality_error"))


@query("autopsy_bottleneck", f"SELECT operator, CASE WHEN max(q) FILTER (status = 'completed') >= 2 * median(q) FILTER (status = 'completed') THEN 'straggler' WHEN sum(p % 100) > 0.5 * sum(p) THEN 'network_shuffle' WHEN sum((q * 500)::BIGINT) / 1000 > 2 * max(q) FILTER (status = 'completed') THEN 'cpu_parallel' ELSE 'balanced' END AS bottleneck FROM {_TASK_SQL} GROUP BY operator")
def _bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the attempts of each operator alone."""
    t, out = _line_tasks(spark, sf_dir), None
    for o in sorted(r["operator"] for r in t.select("operator").distinct().collect()):  # three flags
        one = analyze.autopsy(t.where(F.col("operator") == o)).select(F.lit(o).alias("operator"), "bottleneck")
        out = one if out is None else out.unionByName(one)
    return out


@query("autopsy_operators", f"SELECT operator, count(*) AS attempts, round(sum(q), 4) AS wall_ms, sum(line)::BIGINT AS rows_scanned, sum(line)::BIGINT AS rows_produced, sum(p)::BIGINT AS bytes_scanned, sum(p % 100)::BIGINT AS transferred_bytes, sum((q * 500)::BIGINT)::BIGINT AS cpu_micros, 0::BIGINT AS spill_bytes, max(p) AS peak_memory_bytes, round(sum(line) * 1000 / sum(q), 4) AS rows_per_second, round(sum(p) * 1000 / sum(q), 4) AS bytes_per_second FROM {_TASK_SQL} GROUP BY operator")
def _operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyze.operator_rollup(_line_tasks(spark, sf_dir)))


@query("what_if_projection", "SELECT workers, target, off, warm, round(greatest(1, 1000003.17::DOUBLE * (0.15 + 0.85 * workers / target) * CASE WHEN off THEN 1.35 ELSE 1 END * CASE WHEN warm THEN 0.78 ELSE 1 END))::BIGINT AS predicted_ms FROM (SELECT a.n_nationkey + 1 AS workers, b.n_nationkey + 1 AS target FROM nation a, nation b), (VALUES (true), (false)) x(off), (VALUES (true), (false)) y(warm)")
def _what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections from many numbers of workers to others, without the combiner or with a warm cache or both."""
    keys = sorted(r[0] + 1 for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    rows = [(a, b, off, warm, analyze.what_if(1_000_003.17, a, b, combiner=not off, warm_cache=warm)["predicted_ms"]) for a in keys for b in keys for off in (True, False) for warm in (True, False)]
    return spark.createDataFrame(rows, "workers bigint, target bigint, off boolean, warm boolean, predicted_ms bigint")


@query("pruned_bytes", "WITH g AS (SELECT o_orderkey % 7 AS g, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS b FROM orders WHERE o_custkey % 5 < o_orderkey % 7 GROUP BY 1), v AS (SELECT n_nationkey * 6 AS v FROM nation), x AS (SELECT op, v, coalesce(sum(b) FILTER (CASE op WHEN '=' THEN v BETWEEN lo AND hi WHEN '<>' THEN NOT (lo = hi AND hi = v) WHEN '>' THEN hi > v WHEN '>=' THEN hi >= v WHEN '<' THEN lo < v ELSE lo <= v END), 0) AS r, sum(b) AS a FROM g, v, (VALUES ('='), ('<>'), ('>'), ('>='), ('<'), ('<=')) o(op) GROUP BY op, v) SELECT op, v AS value, r::BIGINT AS read_bytes, (a - r)::BIGINT AS skipped_bytes FROM x")
def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of orders as row groups: which of them each predicate has to read."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 5 < o_orderkey % 7").groupBy(F.col("o_orderkey") % 7)
    groups = [r.asDict() for r in o.agg(F.min("o_custkey").alias("min"), F.max("o_custkey").alias("max"), F.count("*").alias("bytes")).collect()]
    values = sorted(r[0] * 6 for r in table(spark, sf_dir, "nation").select("n_nationkey").collect())
    return spark.createDataFrame([(op, v, *ingest.pruned_bytes(groups, op, v)) for op in ("=", "<>", ">", ">=", "<", "<=") for v in values], "op string, value bigint, read_bytes bigint, skipped_bytes bigint")


@query("explain_cost_model", "SELECT 'aggregate' AS operation, true AS pushed, true AS planned")
def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = analyze.explain(engine(spark, sf_dir, "lineitem"), STATEMENTS["q6_selective_revenue"][0])
    return spark.createDataFrame([(x["operation"], "PushedFilters: [IsNotNull" in x["physical"], x["cost"]["cost"] > 0)], "operation string, pushed boolean, planned boolean")


@query("workload_replay", "SELECT * FROM (VALUES ('auto', true), ('local', true), ('broadcast', true), ('hash_shuffle', true)) v(strategy, matches)")
def _workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = analyze.Workload(engine(spark, sf_dir, "orders", "customer"))
    w.record("SELECT c.c_mktsegment AS segment, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
    return spark.createDataFrame([(s, all(r["matches"] for r in w.replay(join_strategy=s))) for s in ("auto", "local", "broadcast", "hash_shuffle")], "strategy string, matches boolean")


# --- standing queries and the runtime, over the tables -------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf_dir: str, batches: int) -> list[DataFrame]:
    e = events(spark, sf_dir)
    return [e.where(F.floor(F.col("seq") * batches / 1000003) == b) for b in range(batches)]


_ACCEPTED = f"(SELECT e.event_id, e.user_id, e.event_type, e.value, l.t FROM ({_late_sql(LATE)}) l JOIN events e USING (event_id) WHERE NOT late)"
_SESSIONS = f"WITH e AS {_ACCEPTED}, m AS (SELECT *, max(t + {6 * HOUR}) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e), s AS (SELECT *, count(*) FILTER (b IS NULL OR t > b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m)"


@query("stream_session_merge", f"{_SESSIONS} SELECT min(t) AS window_start, max(t) + {6 * HOUR} AS window_end, coalesce(user_id::VARCHAR, '') AS group_key, count(*) AS event_count FROM s GROUP BY user_id, k")
def _session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that grow and meet over four micro-batches are those of all accepted events together."""
    c = StreamConfig("sessions", "events", "SESSION", 6 * HOUR, gap=6 * HOUR, lateness=LATE, group_by="user_id", tie=TIE)
    q = StandingQuery(spark, c, workspace(spark, "standing"))
    for b, part in enumerate(_arrivals(spark, sf_dir, 4)):
        q.process(part, b)
    return q.snapshot().select("window_start", "window_end", "group_key", "event_count")


@query("stream_session_global", f"WITH e AS (SELECT {_T} AS t FROM events), m AS (SELECT t, max(t + 600000) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e), s AS (SELECT t, count(*) FILTER (b IS NULL OR t > b) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT min(t) AS window_start, max(t) + 600000 AS window_end, count(*) AS event_count FROM s GROUP BY k")
def _session_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a group column: blocks of time are sorted by themselves, and only their sessions together."""
    return windows.windowed(events(spark, sf_dir), StreamConfig("q", "events", "SESSION", 600_000, gap=600_000)).select("window_start", "window_end", "event_count")


@query("stream_observed_error", f"SELECT (t // {24 * HOUR}) * {24 * HOUR} AS window_start, event_type AS group_key, count(DISTINCT user_id) AS exact_distinct, true AS distinct_in_bound, 0.0::DOUBLE AS frequency_observed_error FROM {_ACCEPTED} GROUP BY 1, 2")
def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts beside the sketches of a standing query, and the errors they show."""
    q = _replayed(spark, sf_dir, exact=True)
    bound = 3 * sketches.configured_error("approx_count_distinct", precision=14)
    return q.evaluation().select("window_start", "group_key", "exact_distinct", ((F.col("distinct_observed_error") <= bound) | (F.abs(F.col("distinct_users") - F.col("exact_distinct")) <= 1)).alias("distinct_in_bound"), "frequency_observed_error")


@query("stream_ledger_offsets", "SELECT (event_id * 7919 % 1000003 * 3 // 1000003)::BIGINT AS batch_id, min(event_id * 7919 % 1000003) AS first_seq, max(event_id * 7919 % 1000003) AS last_seq, '{\"0\":[' || min(event_id * 7919 % 1000003) || ',' || max(event_id * 7919 % 1000003) || ']}' AS offsets FROM events GROUP BY 1")
def _ledger_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir).ledger().select("batch_id", "first_seq", "last_seq", "offsets")


@query("stream_windows_closed", f"SELECT count(*) AS n_windows, count(*) FILTER (ws + {24 * HOUR} <= (SELECT max({_T}) FROM events) - {LATE}) AS n_closed FROM (SELECT DISTINCT (t // {24 * HOUR}) * {24 * HOUR} AS ws, event_type FROM {_ACCEPTED})")
def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows leave the state, and are told once: their number in the ledger, and what the state still holds."""
    q = _replayed(spark, sf_dir)
    s = q.ledger().agg(F.sum("closed_windows").alias("n_closed"))
    last = q.ledger().orderBy(F.desc("batch_id")).limit(1).select("open_windows")
    return s.crossJoin(F.broadcast(last)).select((F.col("n_closed") + F.col("open_windows")).alias("n_windows"), "n_closed")  # one row each


@query("stream_push", "SELECT b.range AS epoch, count(*) AS events FROM events, range(3) b WHERE event_id * 7919 % 1000003 * 3 // 1000003 <= b.range GROUP BY b.range")
def _push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener is told after each batch: the epoch, and the events of all windows and the late ones so far."""
    c = StreamConfig("pushed", "events", "TUMBLE", 24 * HOUR, lateness=LATE)
    q, told = StandingQuery(spark, c, workspace(spark, "standing")), []
    q.listeners.append(lambda s: told.append(s.agg(F.max("epoch").alias("epoch"), F.sum("event_count").alias("n")).first()))
    for b, part in enumerate(_arrivals(spark, sf_dir, 3)):
        q.process(part, b)
    late = {r["batch_id"]: r["late"] for r in q.ledger().collect()}
    return spark.createDataFrame([(r["epoch"], r["n"] + sum(n for b, n in late.items() if b <= r["epoch"])) for r in told], "epoch bigint, events bigint")


_HALF = "event_id < (SELECT max(event_id) // 2 FROM events)"


@query("stream_resume", f"SELECT ({_T} // {24 * HOUR}) * {24 * HOUR} AS window_start, count(*) AS event_count FROM events GROUP BY 1")
def _resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file topic read by Structured Streaming: registered by a statement, stopped, registered anew by another process and gone on
    with from its checkpoint."""
    from .streaming.standing import Registry

    drop, root, schema = workspace(spark, "drop"), workspace(spark, "streams"), "event_id bigint, seq bigint, t bigint"
    e = events(spark, sf_dir).select("event_id", F.col("event_id").alias("seq"), "t")
    statement = f"REGISTER QUERY days AS SELECT COUNT(*) FROM events WINDOW TUMBLE(ts, INTERVAL '24' HOUR) WATERMARK INTERVAL '{24}' HOUR"
    half = e.agg(F.max("event_id")).first()[0] // 2
    for first in (True, False):
        e.where(F.col("event_id") < half if first else F.col("event_id") >= half).coalesce(1).sortWithinPartitions("seq").write.mode("append").parquet(drop)
        q = Registry(spark, root).register(statement)
        q.start(spark.readStream.schema(schema).parquet(drop), available_now=True).awaitTermination()
        q.stop()
    late = q.late_events()
    accepted = q.snapshot().select("window_start", "event_count")
    if late is None:
        return accepted
    lost = late.groupBy((F.floor(F.col("t") / F.lit(24 * HOUR)) * F.lit(24 * HOUR)).cast("bigint").alias("window_start")).agg(F.count("*").alias("event_count"))
    return accepted.unionByName(lost).groupBy("window_start").agg(F.sum("event_count").alias("event_count"))


@query("stream_topic_events", "SELECT r_regionkey AS seq, r_name FROM region")
def _topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published to a topic of files and read from its beginning by Structured Streaming."""
    folder, out = workspace(spark, "topics"), workspace(spark, "read")
    sinks.publish_files(table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name"), folder, "regions")
    s = sinks.file_source(spark, folder, "regions", "r_name string").select("seq", "r_name")
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", workspace(spark, "point")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("stream_unregister", "SELECT event_type AS name, event_type <> (SELECT min(event_type) FROM events) AS registered FROM events GROUP BY event_type")
def _unregister(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One standing query for each type of event, by JSON registration; the first by name is unregistered by a statement."""
    from .streaming.standing import Registry

    types = sorted(r["event_type"] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())  # a row a type
    registry = Registry(spark, workspace(spark, "streams"))
    for t in types:
        registry.register(StreamConfig(f"q_{t}", "events", "TUMBLE", HOUR))
    registry.register(f"UNREGISTER QUERY q_{types[0]}")
    return spark.createDataFrame([(t, f"q_{t}" in registry.queries) for t in types], "name string, registered boolean")


@query("stream_config_bounds", "SELECT v.n AS size, v.n BETWEEN 100 AND 86400000 AS accepted, v.n BETWEEN 100 AND 5000 AS slides, v.n BETWEEN 0 AND 86400000 AS lateness FROM (SELECT DISTINCT o_custkey * 97 AS n FROM orders UNION SELECT 86400000 UNION SELECT 86400001 UNION SELECT 99) v")
def _config_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many numbers are accepted as a window's size, as the slide of a window of 5 s, and as lateness."""
    from .streaming.config import StreamConfigError

    def fits(**how) -> bool:
        try:
            StreamConfig(**({"name": "q", "topic": "t", "window": "TUMBLE", "size": 5_000} | how))
        except StreamConfigError:
            return False
        return True

    keys = {r["n"] for r in table(spark, sf_dir, "orders").select((F.col("o_custkey") * 97).cast("bigint").alias("n")).distinct().collect()} | {86_400_000, 86_400_001, 99}
    return spark.createDataFrame([(n, fits(size=n), fits(window="HOP", slide=n), fits(lateness=n)) for n in sorted(keys)], "size bigint, accepted boolean, slides boolean, lateness boolean")


@query("budget_overrides", f"SELECT * FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus), (VALUES ('none'), ('worker_limit'), ('combiner'), ('skew_factor'), ('cache_level'), ('join_strategy'), ('max_execution_ms'), ('cache_bytes')) v(override)")
def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a statement under each field of a budget."""
    e = engine(spark, sf_dir, "orders")
    some = {"none": {}, "worker_limit": {"worker_limit": 2}, "combiner": {"combiner": False}, "skew_factor": {"skew_factor": 2.0}, "cache_level": {"cache_level": "MEMORY_AND_DISK"}, "join_strategy": {"join_strategy": "hash_shuffle"}, "max_execution_ms": {"max_execution_ms": 200_000}, "cache_bytes": {"cache_level": "DISK", "cache_bytes": 1 << 20}}
    rows = [(*r, name) for name, how in some.items() for r in control.execute(e, _LAZY, control.Budget(**how)).rows]
    return spark.createDataFrame(rows, "o_orderstatus string, n bigint, override string")


@query("jobs_resumed", "SELECT 'status' AS job, 1::BIGINT AS attempts, count(DISTINCT o_orderstatus) AS n_rows FROM orders UNION ALL SELECT 'regions', 1, count(*) FROM region")
def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that were noted and cut off are found by another process, run once under their ids, and not again."""
    root, e = workspace(spark, "jobs"), engine(spark, sf_dir, "orders", "region")
    first = control.Jobs(spark, root)
    first.submit("status", _LAZY), first.submit("regions", "SELECT r_name FROM region")
    later = control.Jobs(spark, root)
    later.resume(e), control.Jobs(spark, root).resume(e)
    return spark.createDataFrame([(j["id"], j["attempts"], later.run(e, j["id"]).count()) for j in later.all()], "job string, attempts bigint, n_rows bigint")


@query("autopsy_measured", "SELECT count(*) AS rows_scanned, 0::BIGINT AS failed, true AS has_tasks, true AS ordered FROM lineitem")
def _autopsy_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task attempts of a run, as Spark's status store has them: what they scanned is the table."""
    run = control.execute(engine(spark, sf_dir, "lineitem"), "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag", control.Budget())
    t = analyze.task_metrics(spark, run.group)
    a = analyze.autopsy(t, run.millis).select("failed", (F.col("attempts") > 1).alias("has_tasks"), (F.col("critical_ms") >= F.col("median_ms")).alias("ordered"))
    return t.where("bytes_scanned > 0").agg(F.sum("rows_scanned").alias("rows_scanned")).crossJoin(F.broadcast(a))  # one row each


@query("combiner_transfer", "SELECT count(DISTINCT l_returnflag) AS n_groups, true AS combined_is_less FROM lineitem")
def _transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the shuffle moves with the combiner and without it: groups x tasks against all rows."""
    e, sql = engine(spark, sf_dir, "lineitem"), "SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag"
    runs = [control.execute(e, sql, control.Budget(combiner=c)) for c in (True, False)]
    moved = [analyze.task_metrics(spark, r.group).where("operator = 'ShuffleMap'").agg(F.sum("actual_rows")).first()[0] for r in runs]
    return spark.createDataFrame([(len(runs[0].rows), moved[0] < 0.05 * moved[1])], "n_groups bigint, combined_is_less boolean")


@query("what_if_measured", "SELECT 'combiner off' AS change, true AS matches UNION ALL SELECT 'two workers', true UNION ALL SELECT 'shuffled join', true")
def _what_if_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives that were run: they give the same rows."""
    e = engine(spark, sf_dir, "orders", "customer")
    sql = "SELECT c.c_mktsegment AS segment, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"
    some = {"combiner off": {"combiner": False}, "two workers": {"worker_limit": 2}, "shuffled join": {"join_strategy": "hash_shuffle"}}
    return spark.createDataFrame([(n, analyze.measured(e, sql, control.Budget(), control.Budget(**how))["matches"]) for n, how in some.items()], "change string, matches boolean")


@query("explain_measured", "SELECT 'same' AS statement, count(*) AS measured_rows FROM orders WHERE o_custkey > 5 UNION ALL SELECT 'other', NULL")
def _explain_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a run, written and read back, is bound to the statement that it is of, and to no other."""
    import json

    from .workspace import put_bytes

    e, sql = engine(spark, sf_dir, "orders"), "SELECT COUNT(*) AS n FROM orders WHERE o_custkey > 5"
    path = workspace(spark, "evidence") + ".json"
    put_bytes(spark, path, json.dumps({"sql": sql, "tables": ["orders"], "rows": e.sql(sql).first()["n"]}).encode())
    seen = analyze.evidence(spark, path)
    other = "SELECT COUNT(*) AS n FROM orders WHERE o_custkey > 6"
    found = [(n, analyze.explain_measured(e, s, seen)["measured"]) for n, s in (("same", sql.replace(" FROM", "  FROM")), ("other", other))]
    return spark.createDataFrame([(n, m and m["rows"]) for n, m in found], "statement string, measured_rows bigint")


@query("query_metrics", "SELECT 2::BIGINT AS queries, 2::BIGINT AS timed, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n_rows")
def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = analyze.Metrics(), engine(spark, sf_dir, "region", "nation")
    m.timed(lambda: e.collect("SELECT r_name FROM region")), m.timed(lambda: e.collect("SELECT n_name FROM nation"))
    return spark.createDataFrame([(m.queries, sum(m.counts), m.rows)], "queries bigint, timed bigint, n_rows bigint")


@query("cache_counters", "SELECT count(*) + 1 AS hits, count(*) AS misses, count(*) - 2 AS evictions, 1::BIGINT AS bypasses FROM region")
def _cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of five regions in a budget for two: each is loaded once, asked for twice, and pushes the least recent one out; the
    last is pinned and stays, a frame over the budget is not kept."""
    c, names = Cache(budget=100), sorted(r["r_name"] for r in table(spark, sf_dir, "region").collect())
    for n in names[:-1]:
        c.get(n, lambda n=n: table(spark, sf_dir, "region").where(F.col("r_name") == n), 50)
        c.get(n, lambda: table(spark, sf_dir, "region"), 50)
    c.get(names[-1], lambda: table(spark, sf_dir, "region"), 50, pinned=True)
    c.get(names[-1], lambda: table(spark, sf_dir, "region"), 50)
    c.get(names[-1], lambda: table(spark, sf_dir, "region"), 50)
    got = dict(c.counters)
    c.get("large", lambda: table(spark, sf_dir, "region"), 500)
    bypasses = c.counters["bypasses"]
    c.clear()
    return spark.createDataFrame([(got["hits"], got["misses"], got["evictions"], bypasses)], "hits bigint, misses bigint, evictions bigint, bypasses bigint")


@query("lazy_transformations", "SELECT name, name IN ('filter', 'map', 'select', 'groupBy', 'aggregate', 'join') AS accepted FROM (VALUES ('filter'), ('map'), ('select'), ('groupBy'), ('aggregate'), ('join'), ('explode'), ('window'), ('Filter')) v(name) UNION ALL SELECT r_name, false FROM region")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")

    def fits(name: str) -> bool:
        try:
            LazyPlan(e, _LAZY, (name,))
        except ValueError:
            return False
        return True

    some = ["filter", "map", "select", "groupBy", "aggregate", "join", "explode", "window", "Filter", *(r["r_name"] for r in table(spark, sf_dir, "region").collect())]
    return spark.createDataFrame([(n, fits(n)) for n in some], "name string, accepted boolean")


@query("lazy_accumulators", "SELECT 'rows_scanned' AS name, count(*) AS value FROM lineitem UNION ALL SELECT 'rows_passed', count(*) FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT 'rows_out', count(DISTINCT l_returnflag) FROM lineitem WHERE l_quantity > 25")
def _run_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters at three places of a plan, of committed tasks."""
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    one, scanned = aggregates.observed(line, "scanned", n=F.count("*"))
    two, passed = aggregates.observed(one.where("l_quantity > 25"), "passed", n=F.count("*"))
    three, out = aggregates.observed(two.groupBy("l_returnflag").agg(F.count("*").alias("n")), "out", n=F.count("*"))
    three.collect()
    return spark.createDataFrame([("rows_scanned", scanned.get["n"]), ("rows_passed", passed.get["n"]), ("rows_out", out.get["n"])], "name string, value bigint")


@query("workers_in_order", "SELECT n_name AS worker, (row_number() OVER (ORDER BY n_nationkey % 2 <> 0, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, n_name) - 1)::BIGINT AS place FROM nation WHERE n_nationkey % 3 <> 0")
def _workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers named after nations: the even ones are fixed by number and come first, every third can't join and is left out."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()
    named = {(f"worker-{k}" if k % 2 == 0 else n): n for k, n in rows}
    some = [control.Worker(f"worker-{k}" if k % 2 == 0 else n, ("scan",) if k % 3 == 0 else ("scan", "join")) for k, n in rows]
    return spark.createDataFrame([(named[w.id], i) for i, w in enumerate(control.scheduling_order(some, ("join",)))], "worker string, place bigint")


@query("workers_registered", "SELECT true AS alive, true AS has_cores")
def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = control.registered(spark)
    return spark.createDataFrame([(len(w) > 0, all(x.cores > 0 for x in w))], "alive boolean, has_cores boolean")


@query("feedback_buckets", "SELECT 2::BIGINT AS runs, count(DISTINCT o_orderstatus)::DOUBLE AS rows_ema, true AS buckets_in_range FROM orders")
def _feedback_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a statement feed what the next one reads."""
    f, e = control.Feedback(), engine(spark, sf_dir, "orders")
    for _ in range(2):
        control.execute(e, _LAZY, control.Budget(), feedback=f)
    (k,) = f.known.values()
    return rounded(spark.createDataFrame([(k["runs"], k["rows"], 1 <= k["buckets"] <= 8)], "runs bigint, rows_ema double, buckets_in_range boolean"))


@query("job_accumulators", "SELECT (SELECT count(*) FROM lineitem) AS rows_scanned, count(*) AS rows_passed_filter, count(DISTINCT l_returnflag) AS rows_returned, true AS others FROM lineitem WHERE l_quantity >= 25")
def _job_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six accumulators of a statement, over lines written without statistics to skip by."""
    path = workspace(spark, "lines")
    table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity").write.option("parquet.block.row.count.limit", 100_000_000).parquet(path)
    e = Engine(spark, {"lineitem": spark.read.parquet(path)})
    _, a = analyze.accumulated(e, "SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem WHERE l_quantity >= 25 GROUP BY l_returnflag")
    others = all(a[n] > 0 for n in ("bytes_shuffled_total", "bytes_scanned", "cpu_time_micros"))
    return spark.createDataFrame([(a["rows_scanned"], a["rows_passed_filter"], a["rows_returned"], others)], "rows_scanned bigint, rows_passed_filter bigint, rows_returned bigint, others boolean")
