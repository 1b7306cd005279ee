"""Benchmark decontamination: every training passage queries a BM25 inverted index of the test items by block-max WAND.

Scores are shares of the item's own score, so that one threshold serves all items. Terms in many items are left out of the
cursors as long as all of them together can't lift an item by more than ``common`` (their exact share is added for the
candidates). The entries of the index are dealt into blocks of neighbours, with the largest share of every term in each. A
document's passages are first held against all block maxima at once; a WAND over the short lists then runs in the blocks
that can reach the threshold, and returns every item that does. A candidate is a leak if the passage with its surroundings
holds enough of the item's question and of its answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, out_schema, ship, tidied, written

K1, B = 1.2, 0.75
BLOCKS = 64  # of an index, at most
CHUNK = 64  # words of an index entry; longer items have several, the last of which is their last words
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_PARTS).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; of a single sentence, its last third."""
    parts = [w for p in _SENTENCE.split(text) if (w := words_of(p))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    cut = len(w) - max(1, len(w) // 3)
    return w[:cut], w[cut:]


def parts_of(words: list[bytes]) -> list[list[bytes]]:
    """The index entries of an item: runs of CHUNK words, and its last CHUNK words if these are in no run; a short item is one."""
    whole = len(words) // CHUNK * CHUNK
    return [words[at : at + CHUNK] for at in range(0, whole, CHUNK)] + ([words[-CHUNK:]] if whole < len(words) else [])


def shingles(words: list[bytes], n: int = 5) -> set[tuple]:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if n else set()


def held(part: list[bytes], there: dict[int, set], region: list[bytes]) -> float:
    """The share of the part's five-word shingles (of a shorter part: of it as a whole) that the region holds; 1 for no words."""
    own = shingles(part)
    if not own:
        return 1.0
    n = len(next(iter(own)))
    if n not in there:
        there[n] = set(zip(*(region[i:] for i in range(n)), strict=False))
    return len(own & there[n]) / len(own)


@dataclass
class Index:
    vocab: dict[bytes, int]
    upper: np.ndarray  # by term and block: the largest share, 0 for terms left out; one more row for unknown words
    block: int  # entries in a block
    lists: dict[int, tuple[list[int], list[float]]]  # entries and shares of each term of the cursors
    shares: list[dict[int, float]]  # of each entry, by term
    item_of: list[int]
    items: list[tuple[object, list[bytes], list[bytes]]]  # id, question, answer
    need: float  # what cursors must reach
    threshold: float

    @classmethod
    def build(cls, items: list[tuple[object, str]], threshold: float, common: float = 0.2, counts: tuple[int, float, dict[bytes, int]] | None = None) -> Index:
        """counts: number of entries, their mean length and the entries that hold each term, where the index is one of several."""
        entries, item_of, kept = [], [], []
        for key, text in items:
            w = words_of(text)
            if not w:
                continue
            for part in parts_of(w):
                entries.append(part)
                item_of.append(len(kept))
            kept.append((key, *question_and_answer(text)))
        n, mean, seen = counts or (len(entries), sum(map(len, entries)) / max(1, len(entries)), Counter(w for e in entries for w in set(e)))
        idf = lambda w: math.log1p((n - seen.get(w, 1) + 0.5) / (seen.get(w, 1) + 0.5))
        vocab: dict[bytes, int] = {}
        shares: list[dict[int, float]] = []
        for e in entries:
            own = {vocab.setdefault(w, len(vocab)): idf(w) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(e) / mean)) for w, tf in Counter(e).items()}
            total = sum(own.values())
            shares.append({t: s / total for t, s in own.items()})
        many = Counter(t for s in shares for t in s)
        left = [0.0] * len(shares)
        where: dict[int, list[int]] = defaultdict(list)
        for d, s in enumerate(shares):
            for t in s:
                where[t].append(d)
        out = set()
        for t, _ in many.most_common():
            if any(left[d] + shares[d][t] > common for d in where[t]):
                continue
            out.add(t)
            for d in where[t]:
                left[d] += shares[d][t]
        block = max(1, -(-len(shares) // BLOCKS))
        upper = np.zeros((len(vocab) + 1, max(1, -(-len(shares) // block))), np.float32)
        lists = {}
        for t, some in where.items():
            if t not in out:
                lists[t] = (some, [shares[d][t] for d in some])
                for d, share in zip(*lists[t], strict=True):
                    upper[t, d // block] = max(upper[t, d // block], np.nextafter(np.float32(share), np.float32(2)))
        return cls(vocab, upper, block, lists, shares, item_of, kept, threshold - max(left, default=0.0) - 1e-4, threshold)

    def search(self, terms: np.ndarray, b: int) -> list[tuple[int, float]]:
        """Entries of block b with a share of the threshold or more, for the passage's distinct terms."""
        lists, need = self.lists, self.need
        upper = self.upper[terms, b]
        first, end = b * self.block, (b + 1) * self.block
        cursors = []
        for t, u in zip(terms[upper > 0].tolist(), upper[upper > 0].tolist(), strict=True):
            pos = bisect_left(lists[t][0], first)
            cursors.append([lists[t][0][pos], pos, t, u])
        found, whole = [], None
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[3]
                if total >= need:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            to = at
            if cursors[0][0] == at:
                to = at + 1
                if sum(lists[c[2]][1][c[1]] for c in cursors if c[0] == at) >= need:
                    whole = set(terms.tolist()) if whole is None else whole
                    full = sum(s for t, s in self.shares[at].items() if t in whole)
                    if full >= self.threshold:
                        found.append((at, full))
            for c in cursors:
                if c[0] < to:
                    entries = lists[c[2]][0]
                    c[1] = pos = bisect_left(entries, to, c[1])
                    c[0] = entries[pos] if pos < len(entries) else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def leaks(self, text: str | None, question: float, answer: float) -> dict[int, tuple[float, float, float, int]]:
        """By item number: score, the shares of question and answer held, and the passage, for the best passage of a whole text."""
        words = words_of(text)
        n = len(words)
        if not n or not self.items:
            return {}
        ids = np.fromiter(map(self.vocab.get, words, repeat(len(self.vocab))), np.int64, n)
        step = 1024 * CHUNK  # of a very long text at a time
        half = np.concatenate([np.add.reduceat(self.upper[part], np.arange(0, len(part), CHUNK), axis=0) for part in (ids[i : i + step] for i in range(0, n, step))])
        bound = half.copy()
        bound[:-1] += half[1:]  # of passages of two halves; words that recur only raise it
        out: dict[int, tuple[float, float, float, int]] = {}
        for h, b in zip(*(x.tolist() for x in np.nonzero(bound >= self.need)), strict=True):
            lo = h * CHUNK
            for entry, score in self.search(np.unique(ids[lo : lo + 2 * CHUNK]), b):
                k = self.item_of[entry]
                key, q, a = self.items[k]
                if k in out and out[k][1] >= 1 and out[k][2] >= 1:
                    continue
                around = len(q) + len(a)
                region = words[max(0, lo - around) : lo + 2 * CHUNK + around]
                there: dict[int, set] = {}
                found = (score, held(q, there, region), held(a, there, region), h)
                if found[1] >= question and found[2] >= answer and (k not in out or found[:3] > out[k][:3]):
                    out[k] = found
        return out


def indexes(items: DataFrame, key: str, text: str, threshold: float, shard_chars: int):
    """Indexes of at most about ``shard_chars`` characters of items each, with counts over all items."""
    ship(items.sparkSession)
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-size // shard_chars))
    if shards == 1:
        yield Index.build(sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), threshold)
        return
    dealt = rows.withColumn("s", F.pmod(F.xxhash64("k", "t"), F.lit(shards)).cast("int"))

    def entries(batches):
        for batch in batches:
            got = [(s, w) for s, t in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True) if (x := words_of(t)) for part in parts_of(x) for w in set(part)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=["s", "w"])

    def lengths(batches):
        for batch in batches:
            got = [(len(e), sum(map(len, e))) for t in batch.column(0).to_pylist() if (e := parts_of(words_of(t)))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["n", "l"])

    n, total = dealt.select("t").mapInArrow(lengths, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
    words = dealt.select("t", "s").mapInArrow(entries, "s int, w binary").groupBy("s", "w").agg(F.count("*").alias("n"))
    by_shard = written(words.withColumn("all", F.sum("n").over(Window.partitionBy("w"))).select("s", "w", "all"), "item-words")  # a word has a row a shard at most
    for s in range(shards):
        counts = {bytes(r["w"]): r["all"] for r in by_shard.where(F.col("s") == s).collect()}
        yield Index.build(sorted(map(tuple, dealt.where(F.col("s") == s).select("k", "t").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), threshold, counts=(n, total / n, counts))
    dropped(by_shard)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, shard_chars: int = 16 << 20) -> DataFrame:
    """(key, item_id, score, question_held, answer_held, passage) for every leak of an item into a document.

    Passages are 128 words, one every 64, over the whole text, of any length. The index travels with the tasks, so it is bounded:
    ``shard_chars`` characters of items make one, and more items take more passes over the documents. Null or empty texts
    and items without words have no leaks; an empty table of either has none. Of passages that hold an item equally well, the
    later one is told. Rows equal in key are searched each, and so are repeated items. Only the key and text columns are read,
    by their names in each table, so that names may clash. No shuffle of documents.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = None
    for ix in indexes(items, item_key, item_text, threshold, shard_chars):
        one = source.mapInArrow(tidied(_searcher(ix, question, answer, items.schema[item_key].dataType)), out_schema_pairs(docs, key, items, item_key))
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("k", key)


def out_schema_pairs(docs, key, items, item_key):
    from pyspark.sql import types as T

    base = out_schema(docs, [key], {})
    return T.StructType([T.StructField("k", base[key].dataType), T.StructField("item_id", items.schema[item_key].dataType), *T._parse_datatype_string("score double, question_held double, answer_held double, passage bigint").fields])


def _searcher(ix: Index, question: float, answer: float, kind):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            column, rows = batch.column(1), []
            for i in range(batch.num_rows):
                for k, found in ix.leaks(column[i].as_py(), question, answer).items():
                    rows.append((i, ix.items[k][0], *found))
            if rows:
                at = pa.array([r[0] for r in rows], pa.int64())
                kinds = [item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(kinds))], names=["k", "item_id", "score", "question_held", "answer_held", "passage"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = 0.5, question: float = 0.5, answer: float = 0.5, shard_chars: int = 16 << 20) -> DataFrame:
    """The documents that hold no item, with all their columns, repeated rows each. One pass for each index, no shuffle."""
    ship(docs.sparkSession)
    out, at = docs, docs.columns.index(text)
    for ix in indexes(items, item_key, item_text, threshold, shard_chars):
        out = out.mapInArrow(tidied(_filter(ix, at, question, answer)), docs.schema)
    return out


def _filter(ix: Index, at: int, question: float, answer: float):
    def run(batches):
        for batch in batches:
            column = batch.column(at)
            yield batch.filter(pa.array([not ix.leaks(column[i].as_py(), question, answer) for i in range(batch.num_rows)], pa.bool_()))

    return run
