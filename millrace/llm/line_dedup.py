"""Line dedup: a suffix array over line-ID sequences, built by distributed prefix doubling, with DataFrame functions only.

A line goes if it lies in a run of consecutive lines (blank ones don't count), of ``min_words`` words or more together, that
also stands at an earlier place, by document key, then by a hash of the text, then by line.

1. Lines that occur once can't be in such a run. What is left of a document are islands of consecutive recurring lines;
   those with too few words can't hold one either. Equal islands collapse into the first; the others go whole.
2. Prefix doubling ranks the suffixes of the islands by their first 1, 2, 4, ... lines: each round sorts the distinct pairs
   (rank of the suffix, rank of the suffix h lines on) over all tasks, and a pair's place is the next rank. Rounds go on until
   no two suffixes share a rank or the longest island is spanned: the last ranks are the order of the suffix array.
3. The longest common prefix of neighbours in the array is put together from the ranks of all rounds, the largest equal power
   of two first. A suffix's maximal repeated run is as long as the larger of its two neighbours' common prefixes.
4. All suffixes that share their first n lines are an interval of the suffix array whose common prefix is n lines or longer.
   It is known by two ranks that overlap: those of the first and of the last 2^k of the n lines. Of each maximal repeated run,
   the shortest runs with enough words that start or end at a line are grouped by interval; all but an interval's first are
   later copies. Together these cover every run that goes.

No step gathers more than one document's lines in a row, hot lines are counted by pre-aggregation, and lines and ranks are
written to the shared folder once, so that a lost executor costs no more than its tasks. Lines are compared by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, written

BLANK = r"[ \t\n\x0B\f\r]+"


def _words(line: Column) -> Column:
    return F.size(F.split(F.regexp_replace(line, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), BLANK))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tk, r, pos, i, a, b, w): row, place in the text, place among lines with a word, two hashes, words."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("tk"), F.monotonically_increasing_id().alias("r"), F.split(text, "\n").alias("lines"))
    placed = F.filter(F.transform("lines", lambda x, p: F.struct(p.alias("pos"), x.alias("line"))), lambda e: e["line"].rlike(r"[^\x20\x09-\x0D]"))
    each = rows.select("id", "tk", "r", F.posexplode(placed).alias("i", "e"))
    line = F.col("e.line")
    return each.select("id", "tk", "r", "e.pos", "i", F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(17)).alias("b"), _words(line).alias("w"))


def _islands(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(id, tk, start, lines): islands of recurring lines with min_words words or more; lines: (pos, a, b, w) in order.

    Rows equal in key and text are one document: the lines of all but the first are left out.
    """
    lines = written(lines_of(docs, key, text), "lines")
    often = written(lines.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b"), "often")  # so that the join can split hot lines
    again = lines.join(often, ["a", "b"])
    twice = lines.groupBy("id", "tk").agg(F.min("r").alias("one"), F.max("r").alias("last")).where("one < last")
    twice = written(twice.select(F.col("id").alias("id2"), F.col("tk").alias("tk2"), "one"), "repeated-rows")
    if not twice.isEmpty():
        same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("tk") == F.col("tk2"))
        again = again.join(twice, same & (F.col("r") > F.col("one")), "left_anti")
    marked = again.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("id", "tk").orderBy("i")))
    grouped = marked.groupBy("id", "tk", "island").agg(F.sum("w").alias("words"), F.sort_array(F.collect_list(F.struct("pos", "a", "b", "w"))).alias("lines"))
    out = written(grouped.where(F.col("words") >= min_words).select("id", "tk", F.col("lines")[0]["pos"].alias("start"), "lines"), "islands")
    dropped(lines, often, twice)
    return out


def _ranked(pairs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct rows with a number ``r`` that keeps their order: a sort over all tasks, in which the place is the rank."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(pairs.select(*columns).distinct().repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("r", F.monotonically_increasing_id()), name)


def suffix_ranks(sequences: DataFrame) -> DataFrame:
    """(g, i, w, rest, ranks) for every place i of the sequences (g, i, a, b, w, rest); rest: lines from there to the sequence's end.

    ranks[k] orders the suffixes by their first 2^k lines; one with fewer lines comes before those it is a prefix of. The last
    ranks tell all suffixes apart that differ.
    """
    first = _ranked(sequences, ["a", "b"], "ranks")
    places = written(sequences.join(first, ["a", "b"]).select("g", "i", "w", "rest", F.array("r").alias("ranks")), "places")
    n, depth = places.agg(F.count("*"), F.max("rest")).first()
    ranks, h = first.count(), 1
    dropped(first)
    while h < (depth or 0) and ranks < n:
        own = places.select("g", "i", "w", "rest", "ranks", F.element_at("ranks", -1).alias("x"), F.lead(F.element_at("ranks", -1), h, -1).over(Window.partitionBy("g").orderBy("i")).alias("y"))
        own = written(own, "pairs")
        rank = _ranked(own, ["x", "y"], "ranks")
        nxt = written(own.join(rank, ["x", "y"]).select("g", "i", "w", "rest", F.concat("ranks", F.array("r")).alias("ranks")), "places")
        ranks = rank.count()
        dropped(places, own, rank)
        places = nxt
        h *= 2
    return places


def suffix_array(sequences: DataFrame) -> DataFrame:
    """(g, i, w, rest, ranks, place, lcp, longest) for every suffix of the sequences (g, i, a, b, w, rest).

    place: from 0 on in the order of the suffix array, equal suffixes by g and i; lcp: lines shared with the suffix before;
    longest: those of the longest run from there that is found elsewhere, too.
    """
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = suffix_ranks(sequences)
    order = [F.element_at("ranks", -1), F.col("g"), F.col("i")]
    numbered = written(places.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("p", F.monotonically_increasing_id()), "order")
    part = F.shiftright("p", 33)
    ends = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("part")) - F.col("c")).select("part", "before")  # a row a task
    array = numbered.join(F.broadcast(ends), part == F.col("part")).withColumn("place", F.col("before") + F.col("p").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "part", "before")
    array = written(array, "array")
    one = array.select("place", F.col("g").alias("g1"), F.col("i").alias("i1"), F.col("rest").alias("rest1"), F.col("ranks").alias("ranks1"))
    two = array.select((F.col("place") + 1).alias("place"), F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("rest").alias("rest2"), F.col("ranks").alias("ranks2"))

    def further(pairs: DataFrame) -> DataFrame:
        """From both suffixes' ranks: as many lines more as the largest equal power of two has; go: whether more may follow."""
        equal = F.size(F.filter(F.zip_with("ranks1", "ranks2", lambda x, y: x == y), lambda e: e))
        power = F.expr("shiftleft(1, equal - 1)")
        step = F.when(F.col("equal") > 0, F.least(power, "rest1", "rest2")).otherwise(0)
        out = pairs.withColumn("equal", equal).withColumn("step", step)
        go = (F.col("equal") > 1) & (F.col("rest1") > F.col("step")) & (F.col("rest2") > F.col("step"))
        return out.select("place", "g1", (F.col("i1") + F.col("step")).alias("i1"), "g2", (F.col("i2") + F.col("step")).alias("i2"), (F.col("n") + F.col("step")).alias("n"), go.alias("go"))

    found = [written(further(one.join(two, "place").withColumn("n", F.lit(0))), "common")]
    while not (going := found[-1].where("go")).isEmpty():
        at = array.select(F.col("g").alias("g1"), F.col("i").alias("i1"), F.col("rest").alias("rest1"), F.col("ranks").alias("ranks1"))
        to = array.select(F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("rest").alias("rest2"), F.col("ranks").alias("ranks2"))
        found.append(written(further(going.join(at, ["g1", "i1"]).join(to, ["g2", "i2"])), "common"))
    common = found[0].where("not go").select("place", "n")
    for f in found[1:]:
        common = common.unionByName(f.where("not go").select("place", "n"))
    near = common.unionByName(common.select((F.col("place") - 1).alias("place"), (-F.col("n")).alias("n")))  # below 0: with the next one
    lcp = near.groupBy("place").agg(F.max("n").alias("lcp"), F.max(F.abs("n")).alias("longest"))
    out = written(array.join(lcp, "place", "left").withColumn("lcp", F.greatest(F.coalesce("lcp", F.lit(0)), F.lit(0))).withColumn("longest", F.coalesce("longest", F.lit(0))), "suffixes")
    dropped(places, numbered, array, *found)
    return out


def _shortest(places: DataFrame, min_words: int) -> DataFrame:
    """(g, i, n): the shortest runs of min_words words or more that start, or that end, at each place."""

    def reach(side: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))
        step = lambda acc, w: F.when(acc["s"] >= min_words, acc).otherwise(F.struct((acc["s"] + w).alias("s"), (acc["n"] + 1).alias("n")))
        return F.aggregate(side, zero, step)

    by = Window.partitionBy("g").orderBy("i")
    on, back = by.rowsBetween(0, min_words - 1), Window.partitionBy("g").orderBy(F.desc("i")).rowsBetween(0, min_words - 1)
    both = places.select("g", "i", reach(F.collect_list("w").over(on)).alias("f"), reach(F.collect_list("w").over(back)).alias("e"))
    starts = both.where(F.col("f.s") >= min_words).select("g", "i", F.col("f.n").alias("n"))
    ends = both.where(F.col("e.s") >= min_words).select("g", (F.col("i") - F.col("e.n") + 1).alias("i"), F.col("e.n").alias("n"))
    return starts.union(ends).distinct()


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(id, tk, gone): for each document that loses lines, their places in its text (split at newlines)."""
    islands = _islands(docs, key, text, min_words)
    lines = F.col("lines")
    marks = islands.select("id", "tk", "start", F.xxhash64(lines["a"]).alias("s1"), F.xxhash64(lines["b"]).alias("s2"), F.size("lines").alias("m"))
    firsts = written(marks.groupBy("s1", "s2", "m").agg(F.min(F.struct("id", "tk", "start")).alias("f")).select("f.id", "f.tk", "f.start").withColumn("g", F.monotonically_increasing_id()), "firsts")
    same = [islands["id"].eqNullSafe(firsts["id"]), islands["tk"] == firsts["tk"], islands["start"] == firsts["start"]]
    heads = islands.join(firsts, same).select("g", islands["id"], islands["tk"], islands["start"], "lines")
    sequences = heads.select("g", F.size("lines").alias("m"), F.posexplode("lines").alias("i", "l")).select("g", "i", "l.a", "l.b", "l.w", (F.col("m") - F.col("i")).alias("rest"))
    places = suffix_array(sequences)

    runs = written(_shortest(places, min_words), "runs")
    k = F.length(F.bin("n")) - 1  # 2^k <= n
    at = places.select("g", "i", "ranks", "longest")
    with_first = runs.withColumn("k", k).join(at, ["g", "i"]).where("n <= longest").select("g", "i", "n", "k", F.element_at("ranks", F.col("k") + 1).alias("x"), (F.col("i") + F.col("n") - F.expr("shiftleft(1, k)")).alias("j"))
    interval = with_first.join(at.select("g", F.col("i").alias("j"), "ranks"), ["g", "j"]).select("g", "i", "n", "x", F.element_at("ranks", F.col("k") + 1).alias("y"))
    place = interval.join(firsts, "g").select("n", "x", "y", "g", "i", F.struct("id", "tk", "start", "i").alias("p"))
    place = written(place, "intervals")
    first = place.groupBy("n", "x", "y").agg(F.min("p").alias("f"))
    later = place.join(first, ["n", "x", "y"]).where("f < p").groupBy("g", "i").agg(F.max(F.col("i") + F.col("n")).alias("end"))
    covered = places.select("g", "i").join(later, ["g", "i"], "left").withColumn("to", F.max("end").over(Window.partitionBy("g").orderBy("i"))).where("i < to").select("g", "i")
    in_heads = heads.select("g", "id", "tk", F.posexplode("lines").alias("i", "l")).select("g", "i", "id", "tk", "l.pos").join(covered, ["g", "i"]).select("id", "tk", "pos")
    copies = islands.join(firsts.select("id", "tk", "start"), same, "left_anti").select("id", "tk", F.explode("lines.pos").alias("pos"))
    gone = written(in_heads.unionByName(copies).groupBy("id", "tk").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    dropped(islands, firsts, places, runs, place)
    return gone


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """docs with the later copies of recurring runs of lines taken out of ``text``, and n_lines, n_removed (lines).

    The documents are joined with their removed lines by a shuffle at every size, as these have no bound to be broadcast by.

    Null and empty texts stay as they are, an empty table gives an empty one. Null keys come before others, documents of one key
    in the order of a hash of their texts. Rows equal in key and text are one document and lose the same lines. Blank lines
    stay. Of texts of any length all lines are compared. Columns of docs named n_lines or n_removed are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    i, tk, out, h = fresh(docs.columns, "id", "tk", "gone", "h")
    gone = removed_lines(docs, key, text, min_words).select(F.col("id").alias(i), F.col("tk").alias(tk), F.col("gone").alias(out))
    marked = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(F.col(f"`{text}`")).alias(h))
    joined = marked.join(gone.hint("merge"), F.col(f"`{key}`").eqNullSafe(F.col(i)) & (F.col(h) == F.col(tk)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out))
    cut = F.when(F.col(out).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.transform(left, lambda x: F.get(lines, x)), "\n"))
    return joined.select(*[cut.alias(c) if c == text else F.col(f"`{c}`") for c in names], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(out), F.lit(0)).cast("long").alias("n_removed"))
