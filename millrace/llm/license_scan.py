"""Licence scans by a positional index of rare words.

Every word of the licence texts has an IDF, from its document frequency over all files scanned. Of each text, the ANCHORS distinct
words with the highest IDF are indexed with their places. A file's words that are in the index are looked up, the rarest first;
a text is looked for only where the anchors that the file holds weigh ``threshold`` of all its anchors. Postings are then
intersected by relative position (place in the file less place in the text): an alignment stands where anchors of that weight
agree on it within some words' slack. There each mandatory key phrase must stand in the file, and the share of the whole text's
words, by IDF, that stand at their places is its score.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, out_schema, ship
from .licence_texts import PHRASES, TEMPLATES

ANCHORS = 12
#: Words are maximal runs of other bytes than these; A-Z are lower-cased. Bytes over 127 belong to words.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_PARTS).split() if text else []


def idf(n: int, held: int) -> float:
    """Of a word that ``held`` of n files hold."""
    return math.log1p((n - held + 0.5) / (held + 0.5))


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]
    weight: np.ndarray  # of the word at each place
    anchors: list[tuple[bytes, float, np.ndarray]]  # rarest first: the word, its IDF and its places
    slack: int

    @property
    def most(self) -> float:
        return sum(a[1] for a in self.anchors)


@dataclass
class Index:
    templates: list[Template]
    by_anchor: dict[bytes, list[tuple[int, float]]]  # the texts that a word is an anchor of
    base: dict[bytes, list[tuple[list[bytes], str]]]

    @classmethod
    def build(cls, templates: list[tuple[str, str, list[str]]] = TEMPLATES, phrases: dict[str, str] = PHRASES, files: int = 0, held: dict[bytes, int] | None = None) -> Index:
        """held: how many of the files hold each word."""
        held = held or {}
        out, by_anchor = [], defaultdict(list)
        for k, (label, text, keys) in enumerate(templates):
            words = words_of(text)
            weight = {w: idf(max(files, 1), held.get(w, 0)) for w in words}
            rare = sorted(weight, key=lambda w: (-weight[w], w))[:ANCHORS]
            anchors = [(w, weight[w], np.flatnonzero([x == w for x in words])) for w in rare]
            out.append(Template(label, words, [words_of(p) for p in keys], np.array([weight[w] for w in words]), anchors, max(3, len(words) // 10)))
            for w, x, _ in anchors:
                by_anchor[w].append((k, x))
        base: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for phrase, label in phrases.items():
            p = words_of(phrase)
            base[p[0]].append((p, label))
        return cls(out, dict(by_anchor), dict(base))


def vocabulary(templates: list[tuple[str, str, list[str]]]) -> set[bytes]:
    return {w for _, text, _ in templates for w in words_of(text)}


def near(places: np.ndarray, at: np.ndarray, slack: int) -> np.ndarray:
    """For each number, whether a place (in ascending order) is at most ``slack`` away."""
    i = np.searchsorted(places, at - slack)
    return (i < len(places)) & (places[np.minimum(i, len(places) - 1)] <= at + slack)


def matched(t: Template, words: list[bytes], at: dict[bytes, np.ndarray], threshold: float) -> float:
    """The best score of a text in a file, or 0. at: the places of words in the file, in ascending order."""
    slack, size = t.slack, len(t.words)
    shifts = [(x, np.unique((at[w][:, None] - places[None]).ravel())) for w, x, places in t.anchors if w in at]
    lines = np.unique(np.concatenate([d for _, d in shifts]))
    support = np.zeros(len(lines))
    for x, d in shifts:
        support += x * near(d, lines, slack)
    lines = lines[support >= threshold * t.most - 1e-9]
    for key in t.keys:
        if not len(lines):
            return 0.0
        places = np.array(_places(words, key), np.int64)
        i = np.searchsorted(places, lines - slack)
        lines = lines[(i < len(places)) & (places[np.minimum(i, len(places) - 1)] + len(key) <= lines + size + slack)] if len(places) else lines[:0]
    if not len(lines):
        return 0.0
    score = np.zeros(len(lines))
    for j, (w, x) in enumerate(zip(t.words, t.weight.tolist(), strict=True)):
        if w in at:
            score += x * near(at[w], lines + j, slack)
    return float(score.max() / t.weight.sum())


def scan(text: str | None, ix: Index, threshold: float = 0.6) -> tuple[int, list[int], set[str], dict[str, float]]:
    """Number of words, base places in order, base labels, and the score of every label found."""
    words = words_of(text)
    places: list[int] = []
    base: set[str] = set()
    have = set(words)
    for first, phrases in ix.base.items():
        if first in have:
            for phrase, label in phrases:
                if all(w in have for w in phrase):
                    at = _places(words, phrase)
                    if at:
                        places += at
                        base.add(label)
    weight: dict[int, float] = defaultdict(float)
    for w in have.intersection(ix.by_anchor):
        for k, x in ix.by_anchor[w]:
            weight[k] += x
    looked = [t for k, x in weight.items() if x >= threshold * (t := ix.templates[k]).most - 1e-9 and all(w in have for p in t.keys for w in p)]
    found: dict[str, float] = {}
    if looked:
        need = {w for t in looked for w in t.words}
        where: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in need:
                where[w].append(i)
        at = {w: np.array(x, np.int64) for w, x in where.items()}
        for t in looked:
            score = matched(t, words, at, threshold)
            if score >= threshold:
                found[t.label] = max(found.get(t.label, 0.0), min(1.0, score))
    return len(words), sorted(places), base, found


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    out, i, n = [], -1, len(phrase)
    try:
        while True:
            i = words.index(phrase[0], i + 1)
            if words[i : i + n] == phrase:
                out.append(i)
    except ValueError:
        return out


def document_frequencies(docs: DataFrame, vocab: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of files, and of those that hold each word, over all files. A row a word comes to the driver."""
    ship(docs.sparkSession)

    def run(batches):
        seen: dict[bytes, int] = defaultdict(int)
        files = 0
        for batch in batches:
            column = batch.column(0)
            files += len(column)
            for i in range(len(column)):
                for w in vocab.intersection(words_of(column[i].as_py())):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([files, *seen.values()], pa.int64())], names=["w", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    held = {None if r.w is None else bytes(r.w): r.n for r in rows}
    return held.pop(None, 0), held


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list | None = None, phrases: dict | None = None, threshold: float = 0.6) -> DataFrame:
    """The columns ``keep`` (all by default) with n_words, n_base, first_word, last_word, base_labels, labels, score and places.

    Null and empty texts have no words, no labels and score 0; whole texts of any length are scanned. ``labels`` joins the base
    labels and the texts found, distinct and sorted; ``score`` is the best text's (1 where only a base phrase was found);
    ``places`` holds the base places. Words of equal IDF are taken by name. Repeated rows count each in the document
    frequencies and get equal rows; an empty table gives an empty one. Columns of docs with the names of new ones are replaced.
    Two passes over the texts, one for the frequencies, no shuffle of texts; the index is bounded by the licence texts.
    """
    ship(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    ix = Index.build(templates, PHRASES if phrases is None else phrases, *document_frequencies(docs, vocabulary(templates), text))
    new = {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double", "places": "array<bigint>"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(fresh(names, "t")[0]))
    schema = out_schema(docs, names, new)
    k = len(names)

    def run(batches):
        for batch in batches:
            column = batch.column(k)
            out: dict[str, list] = {n: [] for n in new}
            for i in range(len(column)):
                n, places, base, found = scan(column[i].as_py(), ix, threshold)
                out["n_words"].append(n)
                out["n_base"].append(len(places))
                out["first_word"].append(places[0] if places else None)
                out["last_word"].append(places[-1] if places else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | set(found))))
                out["score"].append(max(found.values(), default=1.0 if base else 0.0))
                out["places"].append(places)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(k)), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=[*names, *new])

    return source.mapInArrow(run, schema)
