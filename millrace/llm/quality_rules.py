"""Quality rules with risk-controlled cutoffs.

Each rule is a statistic of a text that is high in bad documents. Labelled documents are dealt into a design half and a
holdout half by their ids. On the design half, a strictness (a share of good documents) gives each rule a cutoff. On the
holdout, stratum by stratum, growing strictness is tested in a fixed sequence: it is valid while the exact (Clopper-Pearson)
upper bound on the share of good documents that the rules reject together is at most ``risk``. A fixed sequence needs no
correction within a stratum; between strata the error is divided (Bonferroni). So with probability 1 - error, the false
rejections of every stratum stay under ``risk``. A stratum without a valid strictness of its own has no cutoffs: no rule rejects
in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, crc_bucket, dropped, fresh, out_schema, ship, tidied, written

SYMBOLS = "#*$%&|<>"
BLANK_CHARS = BLANKS.decode()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a cutoff is set for: shares, so that they mean the same at every length.
RULES = ("symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "longest_word")
#: Strictnesses, in the order tested.
STEPS = (0, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; words are parted by \\x20 and \\x09-\\x0D."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANK_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(BLANK_CHARS):
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return n, chars, symbols, again, repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words in a window of three words that is found twice or more, the first place included."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n - 2:
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(n)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i] = hit[i + 1] = hit[i + 2] = 1
            if j >= 0:
                hit[j] = hit[j + 1] = hit[j + 2] = 1
    return hit.count(1)


def statistics(text: str | None, c: tuple[int, int, int, int, int]) -> list[float]:
    """The rules' values for a text with these counts."""
    n, chars, symbols, again, repeat = c
    if not n:
        return [0.0] * len(RULES)
    letters, upper = letter_counts(text)
    lines = text.count("\n") + 1
    marks = text.count("!") + text.count("?")
    return [symbols / chars, repeat / n, again / lines, upper / max(1, letters), marks / n, math.log1p(chars / n)]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter (Unicode category L), and whether an upper-case Latin one up to U+00FF."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    upper = np.zeros(0x110000, bool)
    upper[[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] = True
    return letter, upper


def letter_counts(text: str, block: int = 1 << 20) -> tuple[int, int]:
    """Letters and upper-case letters of a whole text, counted alike at every length."""
    letter, upper = _letters()
    n = m = 0
    for at in range(0, len(text), block):
        codes = np.frombuffer(text[at : at + block].encode("utf-32-le", "surrogatepass"), "<u4")
        n += int(np.count_nonzero(letter[codes]))
        m += int(np.count_nonzero(upper[codes]))
    return n, m


def base_failed(c: tuple[int, int, int, int, int]) -> bool:
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p for which k or fewer of n have probability delta or more."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)])
    i = np.arange(k + 1)
    for _ in range(60):
        p = (low + high) / 2
        terms = logs + i * math.log(p) + (n - i) * math.log1p(-p) if 0 < p < 1 else np.full(k + 1, -np.inf)
        if float(np.exp(terms).sum()) >= delta:
            low = p
        else:
            high = p
    return high


#: The stratum of documents that have none, apart from one named by the empty string.
NULL = "\0null"


@dataclass
class Cutoffs:
    """By stratum: a cutoff for each rule, or infinity. Null is a stratum of its own. No rule rejects in strata that are missing."""

    by: dict[str, list[float]]
    bounds: dict[str, float]

    def of(self, stratum: str | None) -> list[float]:
        return self.by.get(NULL if stratum is None else stratum, [math.inf] * len(RULES))

    def rejects(self, stratum: str | None, values: list[float]) -> list[str]:
        return [name for name, v, cut in zip(RULES, values, self.of(stratum), strict=True) if v > cut]

    @classmethod
    def calibrate(cls, strata: list[str | None], values: np.ndarray, good: np.ndarray, holdout: np.ndarray, risk: float = 0.02, error: float = 0.05, steps: tuple[float, ...] = STEPS, least_bad: int = 5) -> Cutoffs:
        """strata, values (rows x rules), good (0 or 1) and holdout (bool) of the labelled documents.

        Of the valid strictnesses of a stratum, the one that rejects most bad design documents is taken, the least strict of
        equals. A rule that would reject fewer than ``least_bad`` of them is left out. A stratum that lacks good or bad design
        documents takes its candidates from all strata's, and tests them on its own holdout. In one without a valid strictness,
        nothing is rejected.
        """
        strata = [NULL if s is None else s for s in strata]
        where = np.array(strata, dtype=object)
        design: Design = {}
        for s in set(strata):
            for y in (0, 1):
                rows = values[(where == s) & (good == y) & ~holdout]
                if len(rows):
                    design[s, y] = [np.unique(rows[:, j], return_counts=True) for j in range(len(RULES))]
        cuts, lent = candidates(design, set(strata), steps, least_bad)
        return cls.chosen(set(strata), cuts, lent, tally(where, values, good, holdout, cuts), risk, error)

    @classmethod
    def chosen(cls, strata: set[str], cuts: dict[str | None, np.ndarray], lent: set[str], found: dict[str | None, np.ndarray], risk: float, error: float) -> Cutoffs:
        """From the candidates and their tallies."""
        by, bounds = {}, {}
        for s in sorted(strata):
            best: tuple[float, float, list[float]] | None = None
            if s in cuts and found[s][0]:
                held, hits = int(found[s][0]), found[s][2:]
                bad = found[None if s in lent else s]
                for i, row in enumerate(cuts[s]):
                    bound = upper_bound(int(hits[i]), held, error / len(strata))
                    if bound > risk:
                        break
                    gain = float(bad[2 + len(cuts[s]) + i] / bad[1])
                    if best is None or gain > best[0] + 0.005:
                        best = (gain, bound, row.tolist())
            if best:
                by[s], bounds[s] = best[2], best[1]
        return cls(by, bounds)


#: By stratum and label (0 or 1): for each rule, the values of the design documents in order and how often each is found.
Design = dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]]


def candidates(design: Design, strata: set[str], steps: tuple[float, ...], least_bad: int) -> tuple[dict[str | None, np.ndarray], set[str]]:
    """Cutoffs by step and rule for each stratum and, under None, for all; and the strata that take those of all."""

    def cuts_of(good: list, bad: list) -> np.ndarray:
        return np.array([[_cut(g, b, step, least_bad) for g, b in zip(good, bad, strict=True)] for step in steps])

    pool = [[_merged([d[j] for (_, y), d in design.items() if y == label]) for j in range(len(RULES))] if any(y == label for _, y in design) else None for label in (1, 0)]
    if None in pool:
        return {}, set()
    every = cuts_of(*pool)
    lent = {s for s in strata if (s, 0) not in design or (s, 1) not in design}
    return {None: every} | {s: every if s in lent else cuts_of(design[s, 1], design[s, 0]) for s in strata}, lent


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _cut(good: tuple[np.ndarray, np.ndarray], bad: tuple[np.ndarray, np.ndarray], step: float, least_bad: int) -> float:
    """Half way between the value that a share ``step`` of the good exceed and the next higher bad one."""
    ends = np.cumsum(good[1])
    low = float(good[0][np.searchsorted(ends, math.ceil((1 - step) * (int(ends[-1]) - 1)), side="right")])
    first = int(np.searchsorted(bad[0], low, side="right"))
    return (low + float(bad[0][first])) / 2 if bad[1][first:].sum() >= max(1, least_bad) else math.inf


def tally(strata: np.ndarray, values: np.ndarray, good: np.ndarray, holdout: np.ndarray, cuts: dict[str | None, np.ndarray]) -> dict[str | None, np.ndarray]:
    """By stratum (None: all): good holdout and bad design documents, then of each of them those that each step's cutoffs reject."""
    out = {}
    for s in [None, *set(strata.tolist())]:
        if s not in cuts:
            continue
        rows = strata == s if s is not None else np.ones(len(good), bool)
        parts = [values[rows & (good == 1) & holdout], values[rows & (good == 0) & ~holdout]]
        out[s] = np.array([*map(len, parts), *(int((v > row).any(1).sum()) for v in parts for row in cuts[s])], np.int64)
    return out


def rounded(values: np.ndarray, up: bool) -> np.ndarray:
    """Values (0 or more) with ten binary places after the first."""
    low = (1 << 42) - 1
    bits = np.ascontiguousarray(values, np.float64).view(np.int64) + (low if up else 0)
    return (bits & ~np.int64(low)).view(np.float64)


def fit_cutoffs(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", stratum: str = "lang", risk: float = 0.02, error: float = 0.05, steps: tuple[float, ...] = STEPS, least_bad: int = 5) -> Cutoffs:
    """Calibrate on all labelled documents, as :meth:`Cutoffs.calibrate` does; the statistics are taken over whole texts.

    Rows with a null id or label are left out, and documents that the base rule rejects, as no cutoff matters to them; of several
    labels of one id the lowest counts, and repeated rows of one id count each. Only counts come to the driver: candidates are made from counts of
    rounded values, good ones up and bad ones down by 0.1 percent at most, and tested on the holdout's exact values. Texts
    don't move; statistics are joined with the labels and written once.
    """
    ship(docs.sparkSession)
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("good")).where("k is not null and good is not null").groupBy("k").agg(F.min("good").alias("good"))
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(stratum).cast("string"), F.lit(NULL)).alias("s"), F.col(text).alias("t")).where("k is not null")

    def measure(batches):
        for batch in batches:
            column = batch.column(2)
            some, values = [], []
            for i in range(batch.num_rows):
                t = column[i].as_py()
                if not base_failed(c := counts(t)):
                    some.append(i)
                    values += statistics(t, c)
            at = pa.array(some, pa.int64())
            v = pa.ListArray.from_arrays(pa.array(range(0, len(values) + 1, len(RULES)), pa.int32()), pa.array(values, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), v], names=["k", "s", "v"])

    known = source.mapInArrow(tidied(measure), out_schema(source, ["k", "s"], {"v": "array<double>"}))
    table = written(known.join(marks, "k").select("s", "v", "good", (crc_bucket(F.col("k"), 2) == 1).alias("held")), "quality-statistics")

    def arrays(batch):
        return np.array(batch.column(0).to_pylist(), object), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RULES)), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)

    def sketch(batches):
        """Counts of rounded values of design documents; rule -1: of all documents."""
        for batch in batches:
            s, v, good, held = arrays(batch)
            out: list[list] = [[], [], [], [], []]
            for name in set(s.tolist()):
                rows = s == name
                found = [(0, -1, np.zeros(1), np.array([rows.sum()]))]
                found += [(y, j, *np.unique(rounded(v[rows & (good == y) & ~held, j], y == 1), return_counts=True)) for y in (0, 1) for j in range(len(RULES))]
                for y, j, value, n in found:
                    for column, x in zip(out, ([name] * len(n), [y] * len(n), [j] * len(n), value.tolist(), n.tolist()), strict=True):
                        column += x
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["s", "good", "rule", "value", "n"])

    got = table.mapInArrow(sketch, "s string, good int, rule int, value double, n bigint").groupBy("s", "good", "rule", "value").agg(F.sum("n").alias("n")).toPandas()
    strata = set(got["s"])
    design: Design = {}
    for (s, y, _), part in got[got["rule"] >= 0].sort_values(["rule", "value"]).groupby(["s", "good", "rule"]):
        design.setdefault((s, int(y)), []).append((part["value"].to_numpy(), part["n"].to_numpy()))
    cuts, lent = candidates(design, strata, steps, least_bad)

    def test(batches):
        for batch in batches:
            rows = [(s, i, int(n)) for s, x in tally(*arrays(batch), cuts).items() for i, n in enumerate(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["s", "i", "n"])

    found = {s: np.zeros(2 + 2 * len(steps), np.int64) for s in cuts}
    for r in table.mapInArrow(test, "s string, i int, n bigint").groupBy("s", "i").agg(F.sum("n").alias("n")).collect() if cuts else ():
        found[r.s][r.i] = r.n
    dropped(table)
    return Cutoffs.chosen(strata, cuts, lent, found, risk, error)


def apply_rules(docs: DataFrame, cutoffs: Cutoffs, text: str = "text", stratum: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with the counts, base_failed, failed_rules (array) and kept for every document.

    Null and empty texts have no words and fail the base rule. Null strata are a stratum of their own. A value equal to its
    cutoff is kept. Whole texts of any length are counted; repeated rows get equal rows, an empty table an empty one. Columns of
    docs with the names of new ones are replaced. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    new = [*COUNTS, "base_failed", "failed_rules", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").alias(n) for c, n in zip((text, stratum), fresh(names, "t", "s"), strict=True)])
    schema = out_schema(docs, names, {c: "bigint" for c in COUNTS} | {"base_failed": "boolean", "failed_rules": "array<string>", "kept": "boolean"})
    k = len(names)

    def run(batches):
        for batch in batches:
            strata = batch.column(k + 1).to_pylist()
            column = batch.column(k)
            out = []
            for i, s in enumerate(strata):
                t = column[i].as_py()
                c = counts(t)
                out.append((c, base_failed(c), cutoffs.rejects(s, statistics(t, c))))
            arrays = [pa.array([o[0][j] for o in out], pa.int64()) for j in range(5)]
            arrays += [pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.list_(pa.string())), pa.array([not o[1] and not o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(k)), *arrays], names=[*names, *new])

    return source.mapInArrow(tidied(run), schema)
