"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees are fitted on a bounded sample of labelled URLs on the driver (``bound`` distinct URLs at most, chosen by a hash of
the URL) and scored on the executors in one pass over the URL column, without a shuffle. Statistics of host suffixes are taken,
for each URL that is learned from, over the URLs of other hosts' folds only, so that no label tells itself.

Where no URL labels exist, :func:`label_pages` makes them from what stands on the pages: a page whose main text fails the base
rule of the quality rules (too few words, or too many in repeated windows) is a bad one. No URL rule has a part in that.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import bounded_sample, fresh, hash63, hash_share, out_schema, ship, sigmoid, within_share

UPPER = {c: c + 32 for c in range(65, 91)}
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy",
    "parameters", "query_length", "fragment", "hyphens", "longest_label", "vowel_ratio", "other_ratio", "https", "suffix_1", "suffix_2", "suffix_3",
)


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and the rest. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    if url is None or (at := url.find("://")) < 0:
        return "", "", ""
    rest = url[at + 3 :]
    cut = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    host, rest = rest[:cut].translate(UPPER), rest[cut:]
    end = min((p for p in map(rest.find, "?#") if p >= 0), default=len(rest))
    return host, rest[:end], rest[end:]


@dataclass
class Rules:
    """(verdict, "host/path") pairs. A rule fits its host and all subdomains where the URL's path starts with its own."""

    rules: list[tuple[str, str]]
    by_host: dict[str, list[tuple[str, str, str]]] = field(init=False, repr=False)

    def __post_init__(self):
        self.by_host = {}
        for verdict, rule in sorted(self.rules, key=lambda r: (-len(r[1]), r[1])):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(UPPER), []).append((slash + path, verdict, rule))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits and its verdict, or two None."""
        best = (None, None)
        labels = host.split(".")
        for i in range(len(labels)):
            for prefix, verdict, rule in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(prefix) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str, str]:
    labels = host.split(".")
    return tuple(".".join(labels[-k:]) for k in (1, 2, 3))


def lexical(url: str | None, host: str, path: str, rest: str, stats: dict[str, float], prior: float) -> list[float]:
    u = url or ""
    query, _, fragment = rest.partition("#")
    n, h = max(1, len(u)), max(1, len(host))
    letters = sum(map(str.isalpha, u))
    return [
        len(u), len(host), len(path), path.count("/"), host.count(".") + (host != ""), sum(map(str.isdigit, u)) / n, sum(map(str.isdigit, host)) / h, entropy(u), entropy(host),
        query.count("=") + query.count("&"), len(query), float(bool(fragment)), host.count("-"), max(map(len, host.split("."))), sum(c in "aeiouAEIOU" for c in u) / n, 1 - letters / n, float(u.startswith("https")),
        *(stats.get(s, prior) for s in suffixes(host)),
    ]


class Trees:
    """Gradient-boosted regression trees on the logistic loss, grown level by level over histograms of binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.base, self.cuts, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n = len(y)
        p = (y.sum() + 1) / (n + 2)
        self.base, self.trees = math.log(p / (1 - p)), []
        if n == 0 or y.min() == y.max():
            self.cuts = [np.empty(0)] * x.shape[1]
            return self
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        f = np.full(n, self.base)
        size, many = self.bins + 1, x.shape[1]
        for _ in range(self.rounds):
            p = sigmoid(f)
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                width = 1 << level
                split = []
                sums = []
                for j in range(many):
                    key = node * size + b[:, j]
                    sums.append((np.bincount(key, g, width * size).reshape(width, size).cumsum(1), np.bincount(key, h, width * size).reshape(width, size).cumsum(1)))
                for k in range(width):
                    best = (1e-9, 0, self.bins + 1)  # no gain: all go left
                    for j, (cg, ch) in enumerate(sums):
                        gl, hl, gt, ht = cg[k, :-1], ch[k, :-1], cg[k, -1], ch[k, -1]
                        gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (float(gain[at]), j, at)
                    split.append(best[1:])
                tree.append(split)
                which, at = np.array(split).T
                node = 2 * node + (b[np.arange(n), which[node]] > at[node])
            leaf = self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            self.trees.append((tree, leaf))
            f += leaf[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.trees and len(x):
            b, rows = self._binned(x), np.arange(len(x))
            for tree, leaf in self.trees:
                node = np.zeros(len(x), np.int64)
                for split in tree:
                    which, at = np.array(split).T
                    node = 2 * node + (b[rows, which[node]] > at[node])
                f += leaf[node]
        return sigmoid(f)


@dataclass
class UrlModel:
    trees: Trees
    stats: dict[str, float]
    prior: float

    @classmethod
    def fit(cls, urls: list[str | None], bad: np.ndarray, smoothing: float = 20.0, folds: int = 5, **trees) -> UrlModel:
        """Suffix statistics are smoothed shares of bad URLs by the last one, two and three host labels.

        Rows are learned from with statistics of the other folds (by a hash of the host), new URLs are judged with those of all.
        """
        bad = np.asarray(bad, float)
        prior = float((bad.sum() + 1) / (len(bad) + 2))
        parts = [split_url(u) for u in urls]
        fold = np.array([xxhash.xxh64_intdigest(host) % folds for host, _, _ in parts], np.int64)
        seen = [Counter() for _ in range(folds)]
        hits = [Counter() for _ in range(folds)]
        for (host, _, _), y, f in zip(parts, bad.tolist(), fold.tolist(), strict=True):
            for s in set(suffixes(host)):
                seen[f][s] += 1
                hits[f][s] += y

        def shares(some: list[int]) -> dict[str, float]:
            n, m = sum((seen[f] for f in some), Counter()), Counter()
            for f in some:
                m.update(hits[f])
            return {s: (m[s] + smoothing * prior) / (c + smoothing) for s, c in n.items()}

        without = [shares([g for g in range(folds) if g != f]) for f in range(folds)]
        x = np.array([lexical(u, *p, without[f], prior) for u, p, f in zip(urls, parts, fold.tolist(), strict=True)], float).reshape(len(urls), len(FEATURES))
        return cls(Trees(**trees).fit(x, bad), shares(list(range(folds))), prior)

    def score(self, urls: list[str | None], parts: list[tuple[str, str, str]]) -> np.ndarray:
        return self.trees.score(np.array([lexical(u, *p, self.stats, self.prior) for u, p in zip(urls, parts, strict=True)], float).reshape(len(urls), len(FEATURES)))


def fit_urls(labelled: DataFrame, url: str = "url", bad: str = "bad", bound: int = 20_000, **trees) -> UrlModel:
    """Fit on at most ``bound`` distinct labelled URLs (``bad`` is 0 or 1), those with the least hashes; of a URL with several labels
    the mean counts, and null labels are left out."""
    distinct = labelled.select(F.col(url).alias("u"), F.col(bad).cast("double").alias("b")).where("b is not null").groupBy("u").agg(F.avg("b").alias("b"))
    rows = bounded_sample(distinct, ["u"], bound).collect()
    rows.sort(key=lambda r: (r.u is not None, r.u or ""))
    return UrlModel.fit([r.u for r in rows], np.array([float(r.b >= 0.5) for r in rows]), **trees)


def judge_urls(df: DataFrame, model: UrlModel, rules: list[tuple[str, str]] = (), url: str = "url", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns ``keep`` (all of df's by default) with host, path, rule, verdict and score for every row.

    The verdict is the longest fitting rule's, else ``block`` where the model's score exceeds ``threshold``, else ``allow``.
    Rules of equal length can't both fit, unless they are the same twice: then the first by verdict wins. Null URLs and those
    without ``://`` have empty host and path and are judged by the model; URLs of any length are read whole. Repeated rows get
    equal rows, and an empty table an empty one. Columns of df with the names of new ones are replaced. One pass, no shuffle;
    only ``url`` and ``keep`` are read.
    """
    ship(df.sparkSession)
    names = [c for c in (df.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict", "score")]
    table = Rules(list(rules))
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{url}`").alias(fresh(names, "t")[0]))
    schema = out_schema(df, names, {"host": "string", "path": "string", "rule": "string", "verdict": "string", "score": "double"})

    def run(batches):
        for batch in batches:
            urls = batch.column(len(names)).to_pylist()
            parts = [split_url(u) for u in urls]
            found = [table.match(h, p) for h, p, _ in parts]
            score = model.score(urls, parts)
            verdict = [v or ("block" if s > threshold else "allow") for (_, v), s in zip(found, score, strict=True)]
            new = [pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *new], names=[*names, "host", "path", "rule", "verdict", "score"])

    return source.mapInArrow(run, schema)


_GONE = re.compile(r"<!--.*?-->|<(script|style|nav|footer|header|aside)\b.*?</\1\s*>", re.S | re.I)
_PARAGRAPH = re.compile(r"<(?:p|li|pre|td|blockquote)\b[^>]*>(.*?)(?=</?(?:p|li|pre|td|blockquote|article|body|div|h[1-6])\b|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def main_text(html: str | None) -> str:
    """The text of a page's paragraphs, list items and cells outside of menus, scripts and footers, a line each."""
    return "\n".join(_TAG.sub(" ", p) for p in _PARAGRAPH.findall(_GONE.sub(" ", html or "")))


def label_pages(pages: DataFrame, url: str = "url", html: str = "html", bound: int = 20_000) -> DataFrame:
    """(url, bad) for :func:`fit_urls`: 1 where the page's main text fails the base rule of the quality rules.

    Only pages are read whose URL's hash is in a share that holds about 1.5 x ``bound`` of them. Null pages have no words.
    """
    ship(pages.sparkSession)
    n = pages.count()
    some = pages.select(F.col(f"`{url}`").alias("u"), F.col(f"`{html}`").alias("h")).where(within_share(hash63(["u"]), hash_share(n, bound)))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            bad = [float(quality_rules.base_failed(quality_rules.counts(main_text(column[i].as_py())))) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bad, pa.float64())], names=["url", "bad"])

    return some.mapInArrow(run, "url string, bad double")
