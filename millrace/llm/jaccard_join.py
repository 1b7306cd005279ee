"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

1. Documents with equal sets collapse into one class, and classes with equal prefix and size into one group. The prefix holds
   the first ``n - ceil(t n) + 1`` shingles in an order that puts frequent shingles last; two sets of similarity t or more
   share a shingle of their prefixes in any such order.
2. Group pairs are filtered by size and by the place of their first common shingle. To find connected documents, not
   all pairs of a shingle's list are made: each group is first paired with the most central one (with the fewest rarer shingles)
   of its lists, that of most lists. After that only lists that hold several components are looked at, and in these only pairs
   of groups of different components are made: components of a list are numbered, two numbers differ first in one binary
   digit, and at that digit the rows with a 0 meet those with a 1. So a list of one component, however long, costs nothing.
3. Pairs of groups are expanded to their classes, and each pair is verified on the whole sets.

The order needs no exact counts: long shingles come before short ones, and frequent ones last. A task reports the shingles that
occur ``least`` times or more in one of its batches, so by the pigeonhole principle every shingle in more than
``(least - 1) x batches`` documents is known to be frequent. Lists of frequent shingles are handled by pre-aggregation and
splittable joins, and only the others by windows. Shingles are 56-bit hashes behind a byte of their length; a class is known by a
126-bit hash of its set, a group by a 64-bit one, so that different sets are not taken for equal at any size of corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, dropped, fresh, hash63, ship, swept, tidied, within_share, written

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRIME = np.uint64(0x9E3779B185EBCA87)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if n > len(_powers[0]):
        m = max(n, 1 << 16)
        both = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, x, np.uint64)])) for x in (_BASE, _INVERSE)]
        if m > 1 << 18:  # of long texts: not kept
            return both[0][:n], both[1][:n]
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bytes of the text's words: A-Z are lower-cased, and words are parted by \\x20 and \\x09-\\x0D.

    All at once: a word's hash is its part of a polynomial over the text's bytes, moved to the origin.
    """
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    b = np.frombuffer(text.encode().translate(_LOWER), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_BLANK[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * power[1:], out=total[1:])
    size = end - start
    return _mixed((total[end] - total[start]) * inverse[start] + size.astype(np.uint64)), size


def shingles(text: str | None, k: int) -> np.ndarray:
    """Hashes of the text's k-word shingles, in place order, with repeats; of fewer words, one of them all; of none, nothing.

    The first byte falls with the shingle's length in bytes, so that long shingles, which hardly recur by chance, sort first.
    """
    w, size = word_hashes(text)
    n = len(w)
    if not n:
        return w
    m = max(1, n - k + 1)
    h, length = np.full(m, min(n, k), np.uint64), np.zeros(m, np.int64)
    for i in range(min(n, k)):
        h *= _PRIME
        h += w[i : i + m]
        length += size[i : i + m]
    first = np.uint64(255) - np.minimum(length, 255).astype(np.uint64)
    return (_mixed(h) >> np.uint64(8)) | (first << np.uint64(56))


def least_shared(n, percent: int):
    """The least size of an intersection with a set of size n or more."""
    return (percent * n + 99) // 100


def _int(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def frequent_shingles(docs: DataFrame, text: str, k: int, least: int = 2, most: int = 1_000_000) -> np.ndarray:
    """Frequent shingles, the least frequent first. At most ``most`` (of the highest counts) are returned: it bounds what is sent
    to the driver and the tasks, 16 bytes each, and has no bearing on the result, as any order is valid."""

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            got = [s for i in range(len(column)) if len(s := shingles(column[i].as_py(), k))]
            if got:
                value, count = np.unique(np.concatenate(got), return_counts=True)
                some = count >= least
                yield pa.RecordBatch.from_arrays([_int(value[some]), pa.array(count[some].astype(np.int64))], names=["token", "c"])

    counts = written(docs.select(F.col(text).alias("t")).mapInArrow(tidied(run), "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c")), "frequent")
    step = F.when(F.col("c") < 10_000, F.col("c")).otherwise((F.lit(10_000) + F.floor(1_000 * F.log2(F.col("c") / 10_000))).cast("long"))  # keeps the order of counts
    chosen, total = None, 0
    for r in counts.groupBy(step.alias("c")).count().orderBy(F.desc("c")).collect():  # 70,000 rows at most
        if total + r["count"] > most:
            if not total:  # even the most frequent are too many: some of them, by hash
                chosen = (step == r["c"]) & within_share(hash63(["token"]), most * (1 << 63) // r["count"])
            break
        total += r["count"]
        chosen = step >= r["c"]
    if chosen is None:
        dropped(counts)
        return np.empty(0, np.uint64)
    table = counts.where(chosen).toArrow()
    dropped(counts)
    token = table.column("token").to_numpy()
    return token[np.lexsort((token, table.column("c").to_numpy()))].view(np.uint64)


#: A class: a hash of its set as a decimal, which Spark holds as a number of 16 bytes.
CLASS = "decimal(38,0)"
_CLASS = pa.decimal128(38, 0)


def _classes(digests: list[int]) -> pa.Array:
    return pa.Array.from_buffers(_CLASS, len(digests), [None, pa.py_buffer(b"".join(d.to_bytes(16, "little") for d in digests))])


def prefixes(docs: DataFrame, key: str, text: str, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """A row a document: id, tk (a hash of its text), n (size of its set), gid (class), grp (group) and the prefix.

    A task gives the prefix of a group once. ``cold`` is the number of leading prefix shingles that are not frequent.
    """
    order = np.argsort(frequent)
    known = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # bounded: 16 bytes each

    def run(batches):
        seen: set[int] = set()
        values, ranks = known.value
        for batch in batches:
            column = batch.column(2)
            size, gid, grp, cold, prefix = [], [], [], [], []
            for i in range(len(column)):
                s = np.unique(shingles(column[i].as_py(), k))
                n = len(s)
                size.append(n)
                if not n:
                    gid.append(0), grp.append(0), cold.append(0), prefix.append(None)
                    continue
                gid.append(xxhash.xxh3_128_intdigest(s.tobytes()) >> 2)
                p = n - least_shared(n, percent) + 1
                first = s
                m = n
                if len(values):
                    at = np.searchsorted(values, s)
                    at[at == len(values)] = 0
                    hot = values[at] == s
                    if hot.any():
                        late = np.argsort(ranks[at[hot]])
                        first = np.concatenate([s[~hot], s[hot][late]])
                        m = n - int(hot.sum())
                first = first[:p]
                g = xxhash.xxh3_64_intdigest(first.tobytes(), n) - (1 << 63)
                grp.append(g)
                cold.append(min(m, p))
                prefix.append(None if g in seen else first.view(np.int64))
                seen.add(g)
                if len(seen) > 250_000:
                    seen.clear()
            arrays = [pa.array(size, pa.int32()), _classes(gid), pa.array(grp, pa.int64()), pa.array(cold, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "tk", "n", "gid", "grp", "cold", "prefix"])

    source = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("tk"), F.col(text).alias("t"))
    return source.mapInArrow(tidied(run), f"id {docs.schema[key].dataType.simpleString()}, tk bigint, n int, gid {CLASS}, grp bigint, cold int, prefix array<bigint>")


def _near(n1: str, n2: str, percent: int):
    """Size filter."""
    return F.lit(100) * F.least(n1, n2) >= F.lit(percent) * F.greatest(n1, n2)


def _fits(percent: int, n1: str, j1: str, n2: str, j2: str):
    """Size and place filter: from their first common shingle, at places j1 and j2, on, two sets can share what is left at most."""
    need = F.ceil(F.lit(percent) * (F.col(n1) + F.col(n2)) / F.lit(100 + percent))
    return _near(n1, n2, percent) & (F.least(F.col(n1) - F.col(j1), F.col(n2) - F.col(j2)) >= need)


def _lists(table: DataFrame) -> DataFrame:
    """(token, grp, n, j, rep, rep_n, rep_j) of every shingle in the prefixes of two groups or more."""
    rows = table.where("prefix is not null").select("grp", "n", "cold", F.posexplode("prefix").alias("j", "token"))
    cold = rows.where("j < cold").select("token", "grp", "n", "j")
    hot = rows.where("j >= cold").select("token", "grp", "n", "j")
    by = Window.partitionBy("token").orderBy(F.col("j") / F.col("n"), "grp")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rep = F.struct((F.col("j") / F.col("n")).alias("q"), F.col("grp"), F.col("n"), F.col("j"))
    short = cold.withColumns({"lo": F.min("grp").over(whole), "hi": F.max("grp").over(whole), "rep": F.first("grp").over(whole), "rep_n": F.first("n").over(whole), "rep_j": F.first("j").over(whole)})
    best = hot.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min(rep).alias("r")).where("lo < hi").select("token", F.col("r.grp").alias("rep"), F.col("r.n").alias("rep_n"), F.col("r.j").alias("rep_j"))
    long = hot.join(best, "token")
    columns = ["token", "grp", "n", "j", "rep", "rep_n", "rep_j"]
    return short.where("lo < hi").select(*columns).unionByName(long.select(*columns))


def _counted(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Count filter. Pairs (x, y) of groups whose prefixes share enough; groups: (grp, n, tokens), the shared shingles of each.

    Of two prefixes, the one that ends first in the order holds all common shingles up to there; so the sets share what the
    prefixes do and, at most, what is left of that set.
    """
    one, two = groups.select(F.col("grp").alias("x"), F.col("n").alias("n1"), F.col("tokens").alias("t1")), groups.select(F.col("grp").alias("y"), F.col("n").alias("n2"), F.col("tokens").alias("t2"))
    both = pairs.join(one, "x").join(two, "y")
    rest = F.ceil(F.lit(percent) * F.greatest("n1", "n2") / F.lit(100)) - 1
    need = F.ceil(F.lit(percent) * (F.col("n1") + F.col("n2")) / F.lit(100 + percent))
    return both.where(F.size(F.array_intersect("t1", "t2")) + rest >= need).select("x", "y")


def _fetched(source: DataFrame, needed: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """(needed's columns, t): rows of source (id2, tk2, t) that needed (id, tk, ...) asks for, by a shuffle of hardly more than these.

    A Bloom filter of needed keeps back other rows. It has 16 bits a row and ``most_bits`` at most, which bounds what is sent to
    the driver and the tasks; with more rows it keeps back fewer.
    """
    spark, n = source.sparkSession, needed.count()
    bits = 1 << min(most_bits.bit_length() - 1, max(12, (16 * n).bit_length()))
    at = lambda c: [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(3)]
    words = needed.select(F.explode(F.array(*at("tk"))).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 31))")).alias("b")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    known = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        t, out = known.value, np.ones(len(a), bool)
        for x in (a, b, c):
            v = x.to_numpy()
            out &= (t[v >> 5] >> (v & 31).astype(np.uint32)) & 1 == 1
        return pd.Series(out)

    some = source.where(may(*at("tk2")))
    return some.join(needed.hint("merge"), F.col("id2").eqNullSafe(F.col("id")) & (F.col("tk2") == F.col("tk"))).drop("id2", "tk2")


def _verify(pairs: DataFrame, places: DataFrame, source: DataFrame, k: int, percent: int, per_unit: int = 64) -> DataFrame:
    """The pairs (a, b) of classes that link. places: (gid, id, tk) of a document of each class; source: the documents' texts.

    A pair goes to its class with more partners. A class's partners are cut into units of about ``per_unit``, and units are dealt
    to the tasks in turn, so that no task holds much more than its share.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid"))).groupBy("gid").agg(F.count("*").alias("d"))
    ends = written(ends, "degrees")
    heavy = F.broadcast(ends.where(F.col("d") > max(per_unit, pairs.count() // 1_000)))  # 2,000 classes at most

    def with_degree(rows: DataFrame, column: str) -> DataFrame:
        """rows with the partners of a class; those of classes with very many don't move."""
        known = rows.join(heavy.select(F.col("gid").alias(column), F.col("d").alias(f"d{column}")), column)
        others = rows.join(heavy.select(F.col("gid").alias(column)), column, "left_anti")
        return known.unionByName(others.join(ends.select(F.col("gid").alias(column), F.col("d").alias(f"d{column}")), column))

    both = with_degree(with_degree(pairs, "a"), "b")
    turn = F.struct("da", "a") < F.struct("db", "b")
    salts = F.ceil(F.greatest("da", "db") / F.lit(per_unit)).cast("int")
    turned = both.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), salts.alias("salts"))
    turned = written(turned.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")), "turned")
    units = written(turned.select("a", "salt").distinct().withColumn("task", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")), "units")
    right = turned.join(units, ["a", "salt"]).select(F.col("b").alias("gid"), F.struct("a", "salt", "task", F.lit(1).alias("kind")).alias("to"))
    left = units.select(F.col("a").alias("gid"), F.struct("a", "salt", "task", F.lit(0).alias("kind")).alias("to"))
    needed = left.unionByName(right).groupBy("gid").agg(F.collect_list("to").alias("to")).join(places, "gid")  # a class's list is the square root of the pairs at most
    rows = _fetched(source, written(needed, "needed")).select("gid", "t", F.explode("to").alias("to")).select("to.a", "to.salt", "to.kind", F.col("gid").alias("b"), "t", "to.task")
    dealt = rows.repartitionById(n, "task").sortWithinPartitions("a", "salt", "kind").drop("task")

    def run(batches):
        now, own = None, None
        for batch in batches:
            found = []
            t = batch.column(4)
            for i, (a, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if kind == 0:
                    if a != now:
                        now, own = a, np.unique(shingles(t[i].as_py(), k))
                elif a == now:
                    s = np.unique(shingles(t[i].as_py(), k))
                    small, large = (s, own) if len(s) < len(own) else (own, s)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        found.append(i)
            rows = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(3).take(rows)], names=["a", "b"])

    return dealt.mapInArrow(tidied(run), f"a {CLASS}, b {CLASS}")


def mixed_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of groups that share a list and have classes of different components. rows: (token, grp, n, j, comp), a row for
    each component of a group.

    Lists of one component are left out by pre-aggregation. The components of the others are numbered, and rows meet once for
    each pair, at the first binary digit in which their numbers differ.
    """
    mixed = written(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token"), "mixed")
    if mixed.isEmpty():
        dropped(mixed)
        return rows.select(F.col("grp").alias("x"), F.col("grp").alias("y")).limit(0)
    some = written(rows.join(mixed, "token"), "mixed-rows")
    by = Window.partitionBy("token").orderBy("comp")
    number = some.select("token", "comp").distinct().withColumn("c", F.row_number().over(by) - 1).withColumn("most", F.count("*").over(Window.partitionBy("token")) - 1)
    digits = F.length(F.bin("most"))
    levels = number.withColumn("level", F.explode(F.sequence(F.lit(0), digits - 1)))
    levels = levels.select("token", "comp", "level", F.expr("shiftright(c, level + 1)").alias("head"), F.expr("shiftright(c, level) & 1").alias("bit"))
    placed = some.join(levels, ["token", "comp"]).select("token", "level", "head", "bit", "grp", "n", "j")
    p, q = placed.where("bit = 0").alias("p"), placed.where("bit = 1").alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("token", "level", "head")]
    return p.join(q, same).where(_fits(percent, "p.n", "p.j", "q.n", "q.j")).select(F.least("p.grp", "q.grp").alias("x"), F.greatest("p.grp", "q.grp").alias("y"))


def components(edges: DataFrame) -> DataFrame:
    """(gid, comp) for every end of an edge (a, b); comp is the same for all that are connected.

    In each round every node takes the least label among its neighbours and itself, and the edges are contracted to these
    labels. Labels are hashes, so a constant share of them goes each round.
    """
    graph = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        if labels is None:
            new = step.select(F.col("a").alias("gid"), F.col("to").alias("comp"))
        else:
            new = labels.join(step.withColumnRenamed("a", "comp"), "comp", "left").select("gid", F.coalesce("to", "comp").alias("comp"))
        new = written(new, "labels")
        a = graph.join(step, "a").select(F.col("to").alias("x"), "b")
        b = a.join(step.withColumnsRenamed({"a": "b", "to": "y"}), "b").select("x", "y")
        nxt = written(b.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(graph, step, labels)
        graph, labels = nxt, new
        if graph.isEmpty():
            return labels


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, least: int = 2) -> DataFrame:
    """A row a document: key, tk (a hash of its text), n_shingles, class_id and component_id (the smallest key that links reach).

    Texts without words (null, empty, blank) have no shingles and link with nothing; their component is their own key. Null
    keys are no candidates for the smallest key: a component of null keys only is null. Rows equal in key and text are one
    document and both returned. A similarity of exactly ``percent`` is a link. Texts of any length are compared whole; an empty
    table gives an empty one. Other columns of docs are not read, so that names may clash.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    frequent = frequent_shingles(docs, text, k, least)
    table = written(prefixes(docs, key, text, k, percent, frequent), "prefixes")
    members = written(table.where("n > 0").select("grp", "gid", "n").distinct(), "members")
    lists = written(_lists(table), "lists")
    swept(spark)
    groups = written(lists.groupBy("grp").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"), F.collect_list("j").alias("js")), "groups")
    near = lists.where("grp <> rep").where(_fits(percent, "n", "j", "rep_n", "rep_j")).groupBy("grp", "rep").agg(F.count("*").alias("c"))
    star = near.groupBy(F.col("grp").alias("y")).agg(F.max(F.struct("c", "rep")).alias("b")).select(F.col("b.rep").alias("x"), "y")
    first = members.groupBy("grp").agg(F.min("gid").alias("a"), F.max("gid").alias("z"))
    inside = members.join(first.where("a < z").select("grp", "a"), "grp").where("gid <> a").select("a", F.col("gid").alias("b"))  # of groups of several classes
    places = table.where("n > 0").groupBy("gid").agg(F.min(F.struct("id", "tk")).alias("d")).select("gid", F.col("d.id").alias("id"), F.col("d.tk").alias("tk"))
    source = docs.select(F.col(key).alias("id2"), F.xxhash64(text).alias("tk2"), F.col(text).alias("t"))

    # a star: the first class of each group with the first class of its most central one, and the classes of a group with its first
    met = _counted(star, groups, percent).join(first.select(F.col("grp").alias("x"), "a"), "x").join(first.select(F.col("grp").alias("y"), F.col("a").alias("b")), "y").select("a", "b")
    pairs = written(met.where("a <> b").unionByName(inside).distinct(), "pairs")
    swept(spark)
    edges = written(_verify(pairs, places, source, k, percent), "links")
    labels = components(edges)
    swept(spark)

    # lists and groups that are not one component yet: all pairs of groups across components, expanded to their classes
    dropped(lists)
    comp = members.join(labels, "gid", "left").select("grp", "gid", "n", F.xxhash64(F.coalesce("comp", "gid")).alias("comp"))
    comp = written(comp, "comp")  # 64 bits tell the components of a list apart
    parts = comp.select("grp", "comp").distinct()
    rows = groups.select("grp", "n", F.explode(F.arrays_zip("tokens", "js")).alias("e")).join(parts, "grp")
    rows = rows.select(F.col("e.tokens").alias("token"), "grp", "n", F.col("e.js").alias("j"), "comp")
    apart = parts.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("grp")
    own = comp.join(apart, "grp")
    within = own.select(F.col("grp").alias("token"), F.col("gid").alias("grp"), "n", F.lit(0).alias("j"), "comp")  # a group is a list of its classes
    cross = written(mixed_pairs(rows, percent).distinct(), "across")
    across = _counted(cross.where("x < y"), groups, percent)
    one, two = comp.select(F.col("grp").alias("x"), F.col("gid").alias("a"), F.col("comp").alias("c1")), comp.select(F.col("grp").alias("y"), F.col("gid").alias("b"), F.col("comp").alias("c2"))
    expanded = across.join(one, "x").join(two, "y").where("c1 <> c2").select("a", "b")
    inner = mixed_pairs(within, percent).select(F.col("x").alias("a"), F.col("y").alias("b"))
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = expanded.unionByName(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = written(more.join(tried, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        extra = written(_verify(more, places, source, k, percent), "links")
        final = components(edges.unionByName(extra))
        dropped(labels, extra)
        labels = final
    dropped(groups, pairs, edges, cross, more, comp)

    docs_ = table.select("id", "tk", "n", "gid").join(labels, "gid", "left").select("id", "tk", "n", "gid", F.coalesce("comp", "gid").alias("comp"))
    least_id = written(docs_.where("n > 0").groupBy("comp").agg(F.min("id").alias("component_id")), "least")  # so that the join can split large components
    out = docs_.where("n > 0").join(least_id, "comp").select("id", "tk", "n", "gid", "component_id").unionByName(docs_.where("n = 0").select("id", "tk", "n", "gid", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "tk", F.col("n").cast("long").alias("n_shingles"), F.col("gid").alias("class_id"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with one of each component: the smallest by key, then by a hash of the text. All without words stay.

    Rows equal in key and text are one document, of which one row stays.
    """
    names = docs.columns
    i, tk, h = fresh(names, "id", "tk", "h")
    found = join_documents(docs.select(key, text), key, text, **how)
    least = F.min(F.struct(F.col(key).isNull().alias("o"), F.col(key).alias("id"), F.col("tk"))).alias("d")
    kept = found.where("n_shingles > 0").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("class_id")).alias("c")).agg(least).select(F.col("d.id").alias(i), F.col("d.tk").alias(tk))
    marked = docs.withColumn(h, F.xxhash64(text))
    words = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    stay = marked.where(words).join(kept.hint("merge"), F.col(key).eqNullSafe(F.col(i)) & (F.col(h) == F.col(tk))).dropDuplicates([i, tk])
    return stay.select(*names).unionByName(marked.where(~words).select(*names))
