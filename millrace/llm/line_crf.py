"""Quality by lines: a linear-chain conditional random field labels every line good or bad.

A line's features are indicators over its own shape and its neighbours'. The chain has two states; its weights are fitted on
a bounded sample of labelled documents, whose lines take their document's label. Scoring runs forward-backward over every
line of a document; the marginals, weighted by line length, give the document's quality, which a logistic curve fitted on
the same sample brings to a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fresh, out_schema, ship, sigmoid

#: (value, thresholds): an indicator for each threshold that the value exceeds.
SHAPE = (
    ("symbols", (0.0, 0.02, 0.06, 0.12)), ("marks", (0.0, 0.02, 0.06)), ("upper", (0.05, 0.2, 0.5, 0.8)), ("digits", (0.0, 0.1, 0.3)), ("again", (0.3, 0.5, 0.7, 0.85)),
    ("word_length", (3.0, 5.0, 7.0, 10.0)), ("words", (2.0, 5.0, 15.0, 50.0)), ("pipes", (0.0, 0.03, 0.08)), ("unended", (0.5,)), ("seen", (0.5,)),
)
VALUES = len(SHAPE)
OWN = sum(len(t) for _, t in SHAPE)
WIDTH = 3 * OWN + 3  # own, previous and next line's, first line, last line, constant
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>{}[]\\^~=+@_"


def line_values(line: bytes, seen: bool) -> tuple[float, ...]:
    """The raw values of a line that has a word."""
    words = line.split()
    n, m = len(words), len(line)
    chars = sum(map(len, words))
    return (
        (m - len(line.translate(None, _SYMBOLS))) / m, line.count(b"!") / m, (m - len(line.translate(None, _UPPER))) / m, (m - len(line.translate(None, _DIGITS))) / m,
        1 - len(set(words)) / n if n > 3 else 0.0, chars / n, n, line.count(b"|") / m, float(line[-1:] not in b".!?:;\"')"), float(seen),
    )


def lines_of(text: str | None) -> tuple[list[tuple[float, ...]], list[int]]:
    """Values and lengths of a whole text's lines that have a word."""
    values, sizes, seen = [], [], set()
    for line in (text or "").encode().split(b"\n"):
        line = line.strip()
        if line:
            values.append(line_values(line, line in seen))
            seen.add(line)
            sizes.append(len(line))
    return values, sizes


def design(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of the lines of several documents that follow each other."""
    n = len(values)
    own = np.concatenate([values[:, j : j + 1] > np.array(t) for j, (_, t) in enumerate(SHAPE)], 1).astype(np.float32) if n else np.zeros((0, OWN), np.float32)
    ends = np.cumsum(lengths)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[(ends - lengths)[lengths > 0]] = True
    last[(ends - 1)[lengths > 0]] = True
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1] * ~first[1:, None]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:] * ~last[:-1, None]
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return x


def _products(m: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the 2 x 2 matrices of each document from its first line to every line, and the logarithms of their scales.

    By doubling: after a round, a line has the product of the last 2^k lines; lines that have reached their document's first
    are done. So there are as many rounds as the longest document's length has binary digits.
    """
    place = np.arange(len(m)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    scale = np.zeros(len(m))
    step, at = 1, np.flatnonzero(place >= 1)
    while len(at):
        before = at - step
        both = m[before] @ m[at]
        top = both.max((1, 2))
        sums = scale[before] + scale[at] + np.log(top)
        m[at], scale[at] = both / top[:, None, None], sums
        step *= 2
        at = at[place[at] >= step]
    return m, scale


def forward_backward(node: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of the good state of every line, expected transition counts (2 x 2) and the sum of the documents' log-partitions.

    node: log-odds of each line. All lines of all documents are treated together, see :func:`_products`.
    """
    n = len(node)
    if not n:
        return np.zeros(n), np.zeros((2, 2)), 0.0
    t = np.exp(trans - trans.max())
    clipped = np.clip(node, -30, 30)
    emit = np.stack([1 - sigmoid(clipped), sigmoid(clipped)], 1)
    ends = np.cumsum(lengths)
    some = lengths > 0
    first, last = (ends - lengths)[some], ends[some] - 1
    m = t[None] * emit[:, None, :]
    m[first] = emit[first][:, None, :] * np.eye(2)[None]  # the first line has no step before it
    forward, scale = _products(m.copy(), lengths)
    alpha = forward.sum(1)
    log = float((np.log(alpha[last].sum(1)) + scale[last]).sum())
    alpha /= alpha.sum(1, keepdims=True)
    step = np.broadcast_to(np.eye(2), m.shape).copy()  # of each line: the step to the next one, its emission included
    step[:-1] = m[1:]
    step[last] = np.eye(2)
    tail, _ = _products(step[::-1].transpose(0, 2, 1).copy(), lengths[::-1])
    beta = tail[::-1].sum(1)
    beta /= beta.sum(1, keepdims=True)
    both = alpha * beta
    p = both[:, 1] / both.sum(1)
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    joint = alpha[at - 1][:, :, None] * t[None] * (emit[at] * beta[at])[:, None, :]
    return p, (joint / joint.sum((1, 2), keepdims=True)).sum(0), log


def minimized(f, x: np.ndarray, rounds: int, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """The least point of a convex f (value and gradient), by L-BFGS with backtracking; stops where the gradient is small."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() < tolerance:
            break
        d, coefficients = -g, []
        for s, y, r in reversed(steps):
            c = r * (s @ d)
            coefficients.append(c)
            d = d - c * y
        if steps:
            s, y, _ = steps[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.abs(g).sum()))
        for (s, y, r), c in zip(steps, reversed(coefficients), strict=True):
            d = d + s * (c - r * (y @ d))
        size, slope = 1.0, float(g @ d)
        while True:
            new = x + size * d
            value2, g2 = f(new)
            if value2 <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / float(s @ y))][-memory:]
        done = value - value2 < 1e-9 * max(1.0, abs(value))
        x, value, g = new, value2, g2
        if done:
            break
    return x


@dataclass
class Crf:
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    empty: float  # the probability of a text without words

    @classmethod
    def fit(cls, documents: list[tuple[list, list[int], int]], rounds: int = 100, ridge: float = 2.0) -> Crf:
        """documents: values and sizes of the lines, and the label (0 or 1)."""
        labels = np.array([d[2] for d in documents], float)
        prior = float((labels.sum() + 1) / (len(labels) + 2))
        none = labels[[not d[0] for d in documents]] if documents else labels
        empty = float((none.sum() + 2 * prior) / (len(none) + 2))
        some = [d for d in documents if d[0]]
        w, trans = np.zeros(WIDTH), np.zeros((2, 2))
        if not some:
            return cls(w, trans, (0.0, float(np.log(prior / (1 - prior)))), empty)
        lengths = np.array([len(d[0]) for d in some])
        x = design(np.concatenate([np.array(d[0]) for d in some]), lengths)
        y = np.repeat(np.array([d[2] for d in some], float), lengths)
        weight = 1.0 / len(some)
        steps = np.array([float((d[2] == s) * (len(d[0]) - 1)) for d in some for s in (0, 1)]).reshape(-1, 2).sum(0)
        seen = np.diag(steps)

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            w, trans = v[:WIDTH], v[WIDTH:].reshape(2, 2)
            node = np.clip(x @ w, -30, 30)
            p, pair, log = forward_backward(node, lengths, trans)
            path = float(np.log(sigmoid(np.where(y > 0, node, -node))).sum() + (seen * (trans - trans.max())).sum())
            g = np.concatenate([x.T @ (y - p), (seen - pair).ravel()])
            return weight * (log - path + ridge / 2 * float(v @ v)), weight * (ridge * v - g)

        v = minimized(loss, np.zeros(WIDTH + 4), rounds)
        w, trans = v[:WIDTH], v[WIDTH:].reshape(2, 2)
        out = cls(w, trans, (1.0, 0.0), empty)
        q = out._raw(x, lengths, np.concatenate([d[1] for d in some]))
        out.curve = _logistic(q, np.array([d[2] for d in some], float))
        return out

    def _raw(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        p, _, _ = forward_backward(x @ self.weights, lengths, self.trans)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return np.bincount(owner, p * sizes, len(lengths)) / np.maximum(np.bincount(owner, sizes, len(lengths)), 1)

    def score(self, documents: list[tuple[list, list[int]]]) -> np.ndarray:
        lengths = np.array([len(d[0]) for d in documents], np.int64)
        values = [np.array(d[0]) for d in documents if d[0]]
        if not values:
            return np.full(len(documents), self.empty)
        x = design(np.concatenate(values), lengths)
        q = self._raw(x, lengths, np.concatenate([d[1] for d in documents if d[0]]))
        return np.where(lengths > 0, sigmoid(self.curve[0] * q + self.curve[1]), self.empty)


def _logistic(q: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of y on q, by Newton's steps."""
    x = np.stack([q, np.ones(len(q))], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = sigmoid(x @ b)
        g = x.T @ (y - p) - ridge * b
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit_crf(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = 4_000, longest: int = 500, **how) -> Crf:
    """Fit on at most ``bound`` labelled documents of ``longest`` lines at most each, those with the least hashes of the id.

    Null ids and labels are left out; of several labels of one id the lowest counts, of several texts the one with the least hash.
    What comes to the driver is bounded by bound x longest lines of 48 bytes.
    """
    ship(docs.sparkSession)
    chosen = bounded_sample(labels.select(F.col(key).cast("string").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.min("y").alias("y")), ["k"], bound)
    own = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.coalesce(F.regexp_count("t", F.lit("\n")), F.lit(0)) < longest)
    rows = own.join(chosen, "k").groupBy("k").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("d")).select("k", "d.t", "d.y")

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lines = [lines_of(column[i].as_py()) for i in range(batch.num_rows)]
            values = pa.array([np.array(v, np.float32).tobytes() for v, _ in lines], pa.binary())
            sizes = pa.array([np.array(s, np.int64).tobytes() for _, s in lines], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values, sizes], names=["k", "y", "v", "s"])

    got = sorted(rows.mapInArrow(run, "k string, y int, v binary, s binary").collect())
    return Crf.fit([(np.frombuffer(r.v, np.float32).reshape(-1, VALUES).tolist(), np.frombuffer(r.s, np.int64).tolist(), r.y) for r in got], **how)


def score_quality(docs: DataFrame, model: Crf, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with score (0 to 1) for every document.

    Null and empty texts take the prior of texts without words. Whole texts of any length are scored, in as many rounds as the
    number of lines has binary digits. Repeated rows and ties get equal scores, an empty table gives an empty one. Columns of
    docs with the names of new ones are replaced. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    new = {"score": "double"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(fresh(names, "t")[0]))
    k = len(names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(k)
                score = model.score([lines_of(column[i].as_py()) for i in range(part.num_rows)])
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(k)), pa.array(score, pa.float64())], names=[*names, *new])

    return source.mapInArrow(run, out_schema(docs, names, new))
