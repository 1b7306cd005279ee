"""Operators that judge each row: URL filter, quality rules, licences, line CRF, language."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.llm import lang_id, license_scan, line_crf, quality_rules, url_filter
from millrace.llm.common import bounded_sample, crc_bucket, crc_bucket_py, hash_share
from millrace.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- URL filter --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", "")), ("", ("", "", "")), ("example.org/a", ("", "", "")), ("http://Ex.ORG", ("ex.org", "", "")), ("https://a.b/c/D?x#y", ("a.b", "/c/D", "?x#y")),
        ("x://h?q", ("h", "", "?q")), ("x://h#f/g", ("h", "", "#f/g")), ("a://b://c/d", ("b:", "//c/d", "")), ("http://É.org/", ("É.org", "/", "")),
    ],
)
def test_split(url, want):
    assert url_filter.split_url(url) == want


def test_rules_brute_force():
    rules = url_filter.Rules(URL_RULES)
    hosts = ["org", "a.org", "example.org", "x.example.org", "notexample.org", "com", "b.com", "com.b", "net", "", "org.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/ES/"]
    for h in hosts:
        for p in paths:
            fit = [(len(r), r, v) for v, r in URL_RULES if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith(r[r.index("/") :])]
            want = max(fit)[1:] if fit else (None, None)
            assert rules.match(h, p) == want, (h, p)


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    t = url_filter.Trees(rounds=60).fit(x[:3000], y[:3000])
    assert ((t.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert url_filter.Trees().fit(np.zeros((0, 4)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0.5, 0.5]


def test_urls_on_held_out_labels(spark):
    rows = [(f"http://{'spam-farm' if i % 3 == 0 else 'news'}{i % 7}.example.{'biz' if i % 3 == 0 else 'org'}/a/{i}{'?x=1&y=2&z=3' if i % 3 == 0 else ''}", i, i % 3 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "url string, page_id int, bad boolean")
    model = url_filter.fit_urls(df.where("page_id < 400"))
    got = url_filter.judge_urls(df.where("page_id >= 400"), model, keep=["page_id", "bad"]).collect()
    assert sum((r.verdict == "block") == r.bad for r in got) / len(got) > 0.97


def test_op1(spark, sf):
    rows = entry.queries()["op1_url_filter"](spark, sf).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    rules = url_filter.Rules(URL_RULES)
    for r in rows:
        host, path, _ = url_filter.split_url(pages[r.page_id])
        rule, verdict = rules.match(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_labels_come_from_pages(spark):
    """What stands on a page makes its label: menus, scripts and tags don't count, the URL has no part in it."""
    words = " ".join(f"w{i}" for i in range(60))
    html = {
        "http://a.org/1": f"<html><nav><li>x</li></nav><article><h1>t</h1><p>{words}</p></article></html>", "http://b.org/1": f"<script>{words}</script><p>few <b>words</b></p><footer><p>{words}</p></footer>",
        "http://c.org/1": f"<p>{'one two three ' * 40}</p>", "http://d.org/1": None, "http://e.org/1": "", "http://f.org/1": f"<!-- <p>{words}</p> --><ul><li>{words[:100]}<li>{words[100:]}</ul>", None: f"<P>{words}",
    }
    got = {r.url: r.bad for r in url_filter.label_pages(spark.createDataFrame(list(html.items()), "url string, html string")).collect()}
    assert got == {"http://a.org/1": 0, "http://b.org/1": 1, "http://c.org/1": 1, "http://d.org/1": 1, "http://e.org/1": 1, "http://f.org/1": 0, None: 0}
    assert url_filter.main_text("<p>a<br>b</p><p>c") == "a b\nc"


def test_suffixes_do_not_tell_their_own_labels():
    """Each host has one kind of page at random: statistics of its own rows would tell it, those of other folds can't."""
    rng = np.random.default_rng(5)
    hosts = [f"h{i}.example.net" for i in range(300)]
    kind = {h: int(rng.random() < 0.5) for h in hosts}
    urls = [f"http://{h}/{j}" for h in hosts for j in range(4)]
    m = url_filter.UrlModel.fit(urls, np.array([kind[u.split("/")[2]] for u in urls]), rounds=10)
    score = m.score([f"http://new{i}.example.net/1" for i in range(50)], [url_filter.split_url(f"http://new{i}.example.net/1") for i in range(50)])
    assert 0.3 < score.min() and score.max() < 0.7


def test_one_url_a_million_times(spark):
    df = spark.range(1_000_000).select(F.lit("http://a.b/c").alias("url"), (F.col("id") % 3 == 0).alias("bad")).unionByName(spark.createDataFrame([("http://x.y/z", True)], "url string, bad boolean"))
    seen, old = [], url_filter.UrlModel.fit
    url_filter.UrlModel.fit = classmethod(lambda cls, urls, bad, **how: seen.append((urls, bad.tolist())) or old(urls, bad, **how))
    try:
        url_filter.fit_urls(df)
    finally:
        url_filter.UrlModel.fit = old
    assert seen == [(["http://a.b/c", "http://x.y/z"], [0.0, 1.0])]


def test_urls_odd(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "no scheme", None), (None, "http://" + "a" * 50_000, "h")], "page_id int, url string, host string")
    model = url_filter.fit_urls(df.withColumn("bad", F.lit(1)).limit(0))
    assert url_filter.judge_urls(df, model, URL_RULES).count() == 4
    assert url_filter.judge_urls(df.limit(0), model).columns == ["page_id", "url", "host", "path", "rule", "verdict", "score"][:2] + ["host", "path", "rule", "verdict", "score"]


# --- quality rules -----------------------------------------------------------------------------------------------------


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts(docs, odd):
    texts = [r.text for r in docs.limit(150).collect()] + [r.text for r in odd.collect()] + ["a a a a", "a b a b a b", "x\x1cy z", "a b c\na b c\n a b c"]
    for t in texts:
        assert quality_rules.counts(t) == brute_counts(t)


def test_letters_are_counted_alike_at_every_length():
    for unit in ("½² ", "aB", "ÀÞ×÷ß ", "日本1", "_9é"):
        for n in (1, 399, 400, 401, 5_000):
            t = (unit * n)[:n]
            assert quality_rules.letter_counts(t, block=700) == (sum(c.isalpha() for c in t), len(re.findall("[A-ZÀ-ÖØ-Þ]", t)))
    short, long = ("½²" * 30 + " abc", "½²" * 300 + " abc")
    assert [quality_rules.letter_counts(t)[0] for t in (short, long)] == [3, 3]


def test_null_is_a_stratum_of_its_own():
    n = 3_000
    strata, good = [None, ""] * n, np.tile([1, 1, 1, 1, 0, 0], n // 3)
    values = np.zeros((2 * n, len(quality_rules.RULES)))
    values[:, 0] = np.where(good == 1, 0.1, [0.5, 0.9] * n)
    c = quality_rules.Cutoffs.calibrate(strata, values, good, np.arange(2 * n) // 6 % 2 == 0)
    high = [0.6, *[0.0] * (len(quality_rules.RULES) - 1)]
    assert c.rejects(None, high) == ["symbol_share"] and len(c.by) == 2 and c.of(None) != c.of("") and c.rejects("unseen", high) == []


def test_upper_bound_is_exact():
    for k, n, d in ((0, 100, 0.05), (3, 50, 0.01), (10, 20, 0.1), (1, 1, 0.05), (0, 0, 0.05)):
        p = quality_rules.upper_bound(k, n, d)
        if k >= n:
            assert p == 1
            continue
        below = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(below - d) < 1e-6


def test_calibration_controls_risk():
    """Over many draws, the false rejections of new good documents exceed the risk in few, as the error allows."""
    rng = np.random.default_rng(3)
    over = 0
    for _ in range(40):
        n = 1500
        good = (rng.random(n) < 0.8).astype(int)
        values = rng.random((n, len(quality_rules.RULES))) * 0.3
        values[:, 0] = np.where(good == 1, rng.normal(0, 1, n), rng.normal(2.0, 1, n))
        c = quality_rules.Cutoffs.calibrate(["a"] * n, values, good, rng.random(n) < 0.5, risk=0.05, error=0.1, steps=(0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1))
        cut = c.of("a")[0]
        over += 0.5 * math.erfc(cut / math.sqrt(2)) > 0.05
    assert over <= 6


def test_strata_without_a_certificate_reject_nothing():
    """Small strata don't take cutoffs that were tested on others; one without bad documents takes those that pass on its own."""
    rng = np.random.default_rng(4)
    parts = [("big", 20_000, 1, 0.1), ("big", 4_000, 0, 0.9), ("odd", 506, 1, 0.9), ("odd", 60, 0, 0.95), ("few", 100, 1, 0.1), ("few", 50, 0, 0.9), ("clean", 2_000, 1, 0.1), ("", 300, 1, 0.9)]
    strata = [s for s, n, _, _ in parts for _ in range(n)]
    good = np.array([g for _, n, g, _ in parts for _ in range(n)])
    values = np.zeros((len(good), len(quality_rules.RULES)))
    values[:, 0] = np.concatenate([m + rng.random(n) * 0.05 for _, n, _, m in parts])
    c = quality_rules.Cutoffs.calibrate(strata, values, good, np.arange(len(good)) % 2 == 1)
    high = [0.97, *[0.0] * (len(quality_rules.RULES) - 1)]
    assert [c.rejects(s, high) for s in ("big", "few", "", None, "unseen", "clean")] == [["symbol_share"], [], [], [], [], ["symbol_share"]]
    assert not c.rejects("odd", [0.92, *high[1:]]) and set(c.bounds) == set(c.by) and max(c.bounds.values()) <= 0.02


def test_small_strata_keep_their_labels_in_large_tables(spark):
    """A language with 1.5 percent of the labels is certified, whatever the size of the others; counts merge over any partitions."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(55)), lambda x: F.concat(F.lit("w"), x.cast("string"))), F.repeat(F.when(F.col("quality") == 0, F.lit("! ")).otherwise(F.lit("")), 30))
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 67 == 0, "xx").otherwise("en").alias("lang"), F.when(F.hash("id") % 8 == 0, 0).otherwise(1).alias("quality"))
    docs, marks = rows.withColumn("text", text), rows.select("doc_id", "quality")
    c = quality_rules.fit_cutoffs(docs, marks)
    assert set(c.by) == {"en", "xx"} and 0 < c.bounds["en"] < c.bounds["xx"] <= 0.02
    assert c == quality_rules.fit_cutoffs(docs.repartition(7), marks.repartition(3))
    assert quality_rules.apply_rules(docs, c).where("kept <> (quality = 1)").count() == 0


def test_cutoffs_from_counts_are_those_from_all_values(spark):
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(r, c) for r in wide.join(lab, "doc_id").collect() if not quality_rules.base_failed(c := quality_rules.counts(r.text))]
    args = [r.lang for r, _ in rows], np.array([quality_rules.statistics(r.text, c) for r, c in rows]), np.array([r.quality for r, _ in rows]), np.array([crc_bucket_py(r.doc_id, 2) == 1 for r, _ in rows])
    for risk in (0.1, 0.3):
        want, got = quality_rules.Cutoffs.calibrate(*args, risk=risk), quality_rules.fit_cutoffs(wide, lab, risk=risk)
        assert want.by.keys() == got.by.keys() and got.by
        assert all(np.allclose(want.of(s), got.of(s), rtol=2e-3) for s in [*want.by, "unseen"])


def test_rules_on_documents(spark, docs, labels):
    wide = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    cut = quality_rules.fit_cutoffs(wide, lab, risk=0.3)  # few labels: only a large risk can be certified
    got = quality_rules.apply_rules(wide, cut).join(lab, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.03 * n[(1, True)] and n.get((0, True), 0) <= 0.2 * n[(0, False)]  # strata with few labels keep theirs


def test_op4(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op4_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and (not r.base_failed or not r.kept)


def test_op4_verdicts(spark):
    """Beyond the base rule, op4 rejects what cutoffs calibrated on all labelled values one by one reject."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").collect()
    stats = [(r, brute_counts(r.text)) for r in rows]
    own = [(r, quality_rules.statistics(r.text, c)) for r, c in stats if not (c[0] < 50 or 100 * c[4] > 50 * c[0])]
    marked = [(r, v) for r, v in own if r.quality is not None]
    cut = quality_rules.Cutoffs.calibrate([r.lang for r, _ in marked], np.array([v for _, v in marked]), np.array([r.quality for r, _ in marked]), np.array([crc_bucket_py(r.doc_id, 2) == 1 for r, _ in marked]))
    assert cut.by
    want = {r.doc_id: not cut.rejects(r.lang, v) for r, v in own}
    got = {r.doc_id: r.kept for r in entry.queries()["op4_quality_rules"](spark, sf).collect()}
    assert sum(got[d] != want.get(d, False) for d in got) <= 0.001 * len(got)  # candidates are made from rounded values


def test_rules_odd(odd, none, labels):
    cut = quality_rules.fit_cutoffs(none, labels)
    assert cut.by == {}
    out = quality_rules.apply_rules(odd, cut)
    assert out.count() == 10 and out.where("text is null and (not base_failed or kept)").count() == 0
    assert out.columns.count("kept") == 1 and quality_rules.apply_rules(none, cut).count() == 0


# --- licences ----------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licence(text):
    words = TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_templates(text, templates, files, held, threshold=0.6):
    """Labels and scores by trying every place of a text in the file, word by word."""
    words = TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = {}
    for label, body, keys in templates:
        t = TOKEN.findall(body.lower())
        weight = {w: math.log(1 + (max(files, 1) - held.get(w.encode(), 0) + 0.5) / (held.get(w.encode(), 0) + 0.5)) for w in t}
        anchors = sorted(weight, key=lambda w: (-weight[w], w.encode()))[:12]
        slack = max(3, len(t) // 10)
        if not set(anchors) & set(words):
            continue
        for d in range(-len(t), len(words)):
            stands = [any(words[i] == w for i in range(max(0, d + j - slack), min(len(words), d + j + slack + 1))) for j, w in enumerate(t)]
            if not any(words[i] == w and i - j == d for j, w in enumerate(t) if w in anchors for i in [d + j] if 0 <= i < len(words)):
                continue
            if sum(weight[a] for a in anchors if any(x for x, w in zip(stands, t, strict=True) if w == a)) < threshold * sum(weight[a] for a in anchors) - 1e-9:
                continue
            low, high = max(0, d - slack), d + len(t) + slack
            if not all(any(words[i : i + len(p)] == p for i in range(low, high - len(p) + 1)) for p in (k.split() for k in keys)):
                continue
            score = sum(weight[w] for x, w in zip(stands, t, strict=True) if x) / sum(weight[w] for w in t)
            if score >= threshold:
                out[label] = max(score, out.get(label, 0))
    return out


def test_op6(spark, sf):
    """Base columns, labels and scores of every document against brute force."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op6_license_scan"](spark, sf).collect()
    assert len(rows) == len(texts)
    held = Counter(w for t in texts.values() for w in set(license_scan.words_of(t)))
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licence(texts[r.doc_id])
        found = brute_templates(texts[r.doc_id], license_scan.TEMPLATES, len(texts), held) if r.n_words < 400 else None
        base = set(filter(None, r.base_labels.split(",")))
        if found is not None:
            assert r.labels == ",".join(sorted(base | set(found))) and math.isclose(r.score, max(found.values(), default=1.0 if base else 0.0), rel_tol=1e-9)


def test_templates_brute_force():
    """Texts with words left out, put in and changed, in other words, whole and cut, against brute force."""
    import random

    rng = random.Random(2)
    some = [license_scan.TEMPLATES[i] for i in (0, 2, 4, 8, 10, 17, 22)]
    noise = "some lines of a file that the authors wrote under no license of any kind for use as is".split()
    texts = []
    for _ in range(60):
        w = rng.choice(some)[1].split()
        w = w[rng.choice((0, 0, len(w) // 4)) : rng.choice((len(w), len(w), 3 * len(w) // 4))]
        rate = rng.choice((0, 0.02, 0.1, 0.3))
        changed = lambda y, u: [] if u < rate / 3 else [y, rng.choice(noise)] if u < 2 * rate / 3 else [rng.choice(noise)] if u < rate else [y]  # noqa: B023, E731
        w = [x for y in w for x in changed(y, rng.random())]
        texts.append(" ".join([*rng.choices(noise, k=rng.randrange(30)), *w, *rng.choices(noise, k=rng.randrange(30)), *(w if rng.random() < 0.2 else [])]))
    held = Counter(w for t in texts for w in set(license_scan.words_of(t)))
    ix = license_scan.Index.build(some, {}, len(texts), held)
    hits = 0
    for t in texts:
        want = brute_templates(t, some, len(texts), held)
        got = license_scan.scan(t, ix)[3]
        assert got.keys() == want.keys() and all(math.isclose(got[k], min(1.0, want[k]), rel_tol=1e-9) for k in got), t
        hits += bool(got)
    assert 20 < hits < 60


def test_templates_are_found_in_noise(spark):
    noise = "lorem ipsum dolor sit amet consectetur " * 30
    rows = [(i, label, f"{noise} {text.upper()}; {noise}") for i, (label, text, _) in enumerate(license_scan.TEMPLATES)]
    rows += [(-i, None, "the terms of this are for any use and you may see it in that file " * 5 + noise) for i in range(1, 200)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "i int, label string, text string").repartition(3)).collect()
    for r in got:
        assert r.labels == "" if r.label is None else r.label in r.labels.split(",") and r.score > 0.99, (r.label, r.labels, r.score)


def test_licences_odd(odd, none):
    out = license_scan.scan_licenses(odd)
    assert out.count() == 10 and out.where("text is null").select("n_words", "labels", "score").distinct().collect()[0] == (0, "", 0.0)
    assert license_scan.scan_licenses(none).count() == 0
    t = "Apache License apache license MIT LICENSE cc by\u00e9 cc by GNU General Public License"
    assert license_scan.scan(t, license_scan.Index.build())[1:3] == ([0, 2, 4, 8, 10], {"apache", "mit", "cc-by", "gpl"})


# --- line CRF ----------------------------------------------------------------------------------------------------------


def test_forward_backward_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 5, 2])
    node, trans = rng.normal(size=11) * 2, rng.normal(size=(2, 2))
    p, pair, log = line_crf.forward_backward(node, lengths, trans)
    at, want, pairs, logs = 0, [], np.zeros((2, 2)), 0.0
    for n in lengths:
        z, m, q = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(node[at + i] for i in range(n) if s[i]) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False)))
            z += w
            m += w * np.array(s)
            for a, b in zip(s, s[1:], strict=False):
                q[a, b] += w
        want += (m / z).tolist()
        pairs += q / z
        logs += math.log(z) - np.log1p(np.exp(node[at : at + n])).sum() - (n - 1) * trans.max()
        at += n
    assert np.allclose(p, want) and np.allclose(pair, pairs) and math.isclose(log, logs)


def test_fit_finds_the_least_loss():
    """The gradient of the likelihood is null at the weights found, by differences."""
    rng = np.random.default_rng(8)
    documents = [([tuple(rng.random(line_crf.VALUES) * (0.1 if y else 0.3)) for _ in range(int(rng.integers(1, 9)))], None, y) for y in rng.integers(0, 2, 80).tolist()]
    documents = [(v, [1] * len(v), y) for v, _, y in documents]
    seen = []
    old = line_crf.minimized
    line_crf.minimized = lambda f, x, rounds: seen.append((f, old(f, x, rounds))) or seen[0][1]
    try:
        line_crf.Crf.fit(documents)
    finally:
        line_crf.minimized = old
    f, v = seen[0]
    value, g = f(v)
    assert value < f(np.zeros(len(v)))[0] and np.abs(g).max() < 1e-3
    for j in rng.integers(0, len(v), 12).tolist():
        e = np.zeros(len(v))
        e[j] = 1e-4
        u = v + rng.normal(size=len(v)) * 0.1
        assert math.isclose((f(u + e)[0] - f(u - e)[0]) / 2e-4, f(u)[1][j], rel_tol=1e-3, abs_tol=1e-6)


def test_long_documents_are_scored_and_not_learned_from(spark):
    text = "\n".join(f"line {i} of a long one." for i in range(100_000))
    docs = spark.createDataFrame([(i, text if i == 0 else f"a line {i}.\nanother!" if i % 2 else "### ||| $$$\n### ||| $$$") for i in range(200)], "doc_id int, text string")
    marks = docs.selectExpr("doc_id", "doc_id % 2 as quality").unionByName(docs.selectExpr("doc_id", "1 as quality"))
    model = line_crf.fit_crf(docs, marks.where("doc_id > 0 or quality = 0"))
    got = {r.doc_id: r.score for r in line_crf.score_quality(docs, model).collect()}
    assert len(got) == 200 and 0 <= got[0] <= 1 and got[1] > 0.9 > 0.1 > got[2]


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op7_quality_classifier"](spark, sf)
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(lab, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert all(r.held_out == (crc_bucket_py(r.doc_id, 5) == 0) for r in got.collect())


def test_crf_ignores_held_out_labels(spark, docs, labels):
    flipped = labels.withColumn("quality", F.when(crc_bucket(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (line_crf.fit_crf(docs, t.where(crc_bucket(F.col("doc_id"), 5) != 0), rounds=20) for t in (labels, flipped))
    assert np.array_equal(a.weights, b.weights)


def test_crf_odd(odd, none, labels):
    model = line_crf.fit_crf(none, labels)
    out = line_crf.score_quality(odd, model)
    assert out.count() == 10 and out.where("score is null").count() == 0 and line_crf.score_quality(none, model).count() == 0
    long = line_crf.lines_of("\n".join(f"line {i} of many." for i in range(30_000)))
    assert len(long[0]) == 30_000 and 0 <= model.score([long])[0] <= 1


# --- language ----------------------------------------------------------------------------------------------------------


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["op8_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.held_out == (crc_bucket_py(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)


def test_language_odd(odd, none):
    model = lang_id.fit_languages(odd)
    rows = lang_id.identify(odd, model).collect()
    letter = lambda t: any(c.isalpha() for c in t or "")
    assert {r.lang_pred for r in rows if not letter(r.text)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "es") for r in rows if letter(r.text))
    signs = odd.sparkSession.createDataFrame([("½",), ("²³ 12 _",), ("½ a",), ("Ⅷ",)], "text string")
    assert [r.lang_pred == "und" for r in lang_id.identify(signs, model).collect()] == [True, True, False, True]
    empty = lang_id.fit_languages(none)
    assert lang_id.identify(odd, empty).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert lang_id.identify(none, model).count() == 0


def test_features_do_not_depend_on_batches():
    texts = ["Hello world", None, "a" * 3_000_000 + " bcd " * 10, "été ñandú", ""]
    together = lang_id.features(texts)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(lang_id.features([t])[0], row)
    assert np.allclose(lang_id.features([texts[2]], block=1 << 16)[0], together[2])


def test_svm_separates():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 3)).astype(np.float32), np.ones((400, 1), np.float32)], 1)
    y = np.where(x @ np.array([1.0, -2.0, 0.5, 0.3]) > 0, 1.0, -1.0)
    assert (np.sign(x @ lang_id.train_svm(x, y)) == y).mean() > 0.97


def test_bounded_sample(spark):
    df = spark.range(20_000)
    a = bounded_sample(df, ["id"], 1_000)
    assert a.count() == 1_000 and a.exceptAll(bounded_sample(df.repartition(7), ["id"], 1_000)).count() == 0
    assert bounded_sample(df, ["id"], 20_000).count() == 20_000


def test_shares_of_large_tables():
    """A language of 6e8 rows keeps its sample, and no table is too large for one."""
    for rows in (1, 500, 600_000_000, 10**12, 10**16):
        assert 0.99 * min(rows, 1.5 * 500) <= rows * hash_share(rows, 500) / (1 << 63) <= 1.01 * 1.5 * 500


def test_languages_are_sampled_within_their_bound(spark):
    rows = [(i % 50 if i % 3 else None, f"text number {i % 40} ábc", "xx" if i % 10 else "yy") for i in range(6_000)]
    seen = []
    old, lang_id.LangModel.fit = lang_id.LangModel.fit, classmethod(lambda cls, x, langs, families=None: seen.append(Counter(langs)) or cls(None, {}))
    try:
        lang_id.fit_languages(spark.createDataFrame(rows, "doc_id int, text string, lang string"), per_language=20)
    finally:
        lang_id.LangModel.fit = old
    assert seen[0]["xx"] <= 20 and 0 < seen[0]["yy"] <= 20
