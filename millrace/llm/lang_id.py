"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte n-grams of the lower-cased whole text, as square roots of their shares, so that all texts have
length one. Families are told apart, and the languages of one, by machines for each pair that vote; margins break ties.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hash63, hash_share, out_schema, ship, sigmoid, within_share

DIMS = 4096
ORDERS = (1, 2, 3, 4)
_WORDLIKE = re.compile(r"[^\W\d_]")
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)

#: Families of common languages; a learned language outside of them is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "cs", "sk", "pl"],
    "turkic": ["tr", "az", "kk", "uz"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "mr", "ne", "bn", "ur", "pa", "gu"],
    "semitic": ["ar", "he", "am"],
}


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter (Unicode category L); signs of number such as \u00bd and \u00b2 are none."""
    return bool(text) and any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def features(texts: list[str | None], block: int = 1 << 20) -> np.ndarray:
    """A row of DIMS + 1 numbers for each text; the last is a constant. Long texts are counted block by block."""
    out = np.zeros((len(texts), DIMS + 1), np.float32)
    flat = out.reshape(-1)
    data = [b" " + (t or "").lower().encode() + b" " for t in texts]
    i = 0
    while i < len(data):
        j, size = i, 0
        while j < len(data) and (j == i or size + len(data[j]) <= block):
            size += len(data[j])
            j += 1
        if size > block:  # one long text: blocks that overlap by the longest n-gram less one byte
            d = data[i]
            for at in range(0, len(d), block):
                _count(flat, d[at : at + block + max(ORDERS) - 1], np.zeros(min(len(d) - at, block + max(ORDERS) - 1), np.int64) + i * (DIMS + 1), min(block, len(d) - at))
        else:
            owner = np.repeat(np.arange(i, j) * (DIMS + 1), [len(d) for d in data[i:j]])
            _count(flat, b"".join(data[i:j]), owner, len(owner))
        i = j
    norm = out[:, :DIMS].sum(1, keepdims=True)
    out[:, :DIMS] = np.sqrt(out[:, :DIMS] / np.maximum(norm, 1))
    out[:, DIMS] = 1
    return out


def _count(flat: np.ndarray, data: bytes, owner: np.ndarray, starts: int) -> None:
    """Count the n-grams that start in the first ``starts`` bytes and end in the text they start in."""
    b = _KEEP[np.frombuffer(data, np.uint8)].astype(np.uint32)
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            code = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            k = min(m, starts)
            if n > 1:
                ok = owner[:k] == owner[n - 1 : n - 1 + k]
                where = owner[:k][ok] + code[:k][ok]
            else:
                where = owner[:k] + code[:k]
            if len(where):
                low = int(where.min())
                add = np.bincount(where - low)
                flat[low : low + len(add)] += add


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent; y is -1 or 1."""
    w, a = np.zeros(x.shape[1], np.float32), np.zeros(len(y))
    q = (x.astype(np.float32) ** 2).sum(1) + 1 / (2 * c)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            g = y[i] * float(x[i] @ w) - 1 + a[i] / (2 * c)
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                a[i] = new
    return w


@dataclass
class Voting:
    """Machines for each pair of classes."""

    classes: list[str]
    weights: np.ndarray  # a column a pair

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Voting:
        classes = sorted(set(labels.tolist()))
        w = [train_svm(x[m], np.where(labels[m] == a, 1.0, -1.0)) for a, b in combinations(classes, 2) if (m := (labels == a) | (labels == b)).any()]
        return cls(classes, np.stack(w, 1) if w else np.zeros((x.shape[1], 0), np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and the confidence: the least one over the pairs that the winner is in."""
        if len(self.classes) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights
        votes, least = np.zeros((len(x), len(self.classes))), np.full((len(x), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            m = margin[:, k]
            soft = np.tanh(m) / 4  # breaks ties of votes
            votes[:, a] += (m > 0) + soft
            votes[:, b] += (m <= 0) - soft
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        return best, sigmoid(3 * least[np.arange(len(x)), best])


@dataclass
class LangModel:
    families: Voting | None
    within: dict[str, Voting]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], families: dict[str, list[str]] | None = None) -> LangModel:
        if not len(x):
            return cls(None, {})
        of = {lang: f for f, some in (FAMILIES if families is None else families).items() for lang in some}
        langs_, fams = np.array(langs, dtype=object), np.array([of.get(v, f"only {v}") for v in langs], dtype=object)
        return cls(Voting.fit(x, fams), {f: Voting.fit(x[fams == f], langs_[fams == f]) for f in sorted(set(fams.tolist()))})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.families is None:
            return ["und"] * len(x), np.zeros(len(x))
        f, score = self.families.predict(x)
        out: list[str] = [""] * len(x)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(f == k)
            if len(rows):
                inner = self.within[name]
                best, s = inner.predict(x[rows])
                score[rows] *= s
                for r, b in zip(rows, best, strict=True):
                    out[r] = inner.classes[b]
        return out, score


def fit_languages(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 500, families: dict[str, list[str]] | None = None) -> LangModel:
    """Fit on at most ``per_language`` whole texts of each language, those with the least hashes of id and text; null languages are
    left out, and rows equal in id, text and language are one."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null")
    h, some = hash63(["k", "t"]), F.lit(False)
    for r in rows.groupBy("l").agg(F.approx_count_distinct(h).alias("n")).collect():  # a row a language; texts are hashed, not moved
        some = F.when(F.col("l") == r["l"], within_share(h, hash_share(r["n"], per_language))).otherwise(some)
    distinct = rows.where(some).withColumn("h", h).groupBy("l", "h").agg(F.min("t").alias("t"))
    chosen = distinct.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= per_language).select("t", "l")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                t = part.column(0).to_pylist()
                some = [i for i, v in enumerate(t) if has_letter(v)]
                x = features([t[i] for i in some])
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(some, pa.int64())), pa.array([v.tobytes() for v in x], pa.binary())], names=["l", "x"])

    got = sorted(chosen.mapInArrow(run, "l string, x binary").collect())
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), DIMS + 1)
    return LangModel.fit(x, [r.l for r in got], families)


def identify(docs: DataFrame, model: LangModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with lang_pred and score for every document.

    ``und`` with score 0 where the text is null, empty or has no letter, or no language was learned. Whole texts of any length
    are counted, block by block. A tie of votes goes to the larger margin, then to the first language by name. Repeated rows
    get equal rows, and an empty table an empty one. Columns of docs with the names of new ones are replaced. One pass, no
    shuffle.
    """
    ship(docs.sparkSession)
    new = {"lang_pred": "string", "score": "double"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(fresh(names, "t")[0]))
    k = len(names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                t = part.column(k).to_pylist()
                pred, score = model.predict(features(t))
                some = [has_letter(v) for v in t]
                arrays = [pa.array([p if s else "und" for p, s in zip(pred, some, strict=True)], pa.string()), pa.array([float(v) if s else 0.0 for v, s in zip(score, some, strict=True)], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(k)), *arrays], names=[*names, *new])

    return source.mapInArrow(run, out_schema(docs, names, new))
