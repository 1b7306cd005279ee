"""Operators that match rows: line dedup, decontamination, the Jaccard join."""

import math
import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from millrace.llm import decontaminate, jaccard_join, line_dedup

BLANK = " \t\n\x0b\f\r"

# --- line dedup --------------------------------------------------------------------------------------------------------


def brute_lines(docs, least):
    """docs: (id, text) in order. The lines that go: those in any run of ``least`` words or more that occurs earlier, all runs tried."""
    rows = {d: [(p, x, len(x.encode().split())) for p, x in enumerate((t or "").split("\n")) if x.strip(BLANK)] for d, t in docs}
    first, gone = {}, defaultdict(set)
    for d in sorted(rows):
        s = rows[d]
        for i in range(len(s)):
            words = 0
            for j in range(i, len(s)):
                words += s[j][2]
                if words >= least:
                    run = tuple(x[1] for x in s[i : j + 1])
                    if first.setdefault(run, (d, i)) < (d, i):
                        gone[d].update(x[0] for x in s[i : j + 1])
    return gone


def cut(text, gone):
    return text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def made_lines(seed, n=40):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(9)]
    docs = []
    for d in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own line {d} {rng.random()}" for _ in range(rng.randint(0, 14))]
        lines = [x if rng.random() > 0.1 else "  " for x in lines]
        docs.append((d, "\n".join(lines) if rng.random() > 0.03 else None))
        if rng.random() < 0.2 and docs[-1][1]:
            docs[-1] = (d, docs[rng.randrange(len(docs))][1])
    return docs


@pytest.mark.parametrize(("seed", "least"), [(1, 6), (2, 10), (3, 3)])
def test_lines_brute_force(spark, seed, least):
    docs = made_lines(seed)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=least).collect()}
    gone = brute_lines(docs, least)
    assert got == {d: cut(t, gone.get(d)) for d, t in docs}


def test_op2(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    gone = brute_lines(docs, 50)
    rows = entry.queries()["op2_line_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == {d: (cut(t, gone.get(d)), len(gone.get(d, ()))) for d, t in docs}


def test_lines_odd(odd, none):
    out = line_dedup.dedup_lines(odd, min_words=5)
    rows = out.collect()
    assert len(rows) == 10 and out.columns.count("n_lines") == 1
    assert [r.text for r in rows if r.doc_id == 1] == ["The quick brown fox jumps over the lazy dog again and again."] * 2  # one document
    assert line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_suffix_array(spark, seed):
    """Ranks, order, common prefixes and maximal repeated runs against a naive suffix array."""
    rng = random.Random(seed)
    pool = ["a" * 60, "ab" * 20, "abc" * 9] if seed == 7 else None  # periods: long common prefixes
    seqs = [list(rng.choice(pool)[: rng.randint(5, 60)]) if pool else [rng.choice("ab") for _ in range(rng.randint(1, 9))] for _ in range(12)]
    df = spark.createDataFrame([(g, i, c, c, 1, len(s) - i) for g, s in enumerate(seqs) for i, c in enumerate(s)], "g int, i int, a string, b string, w int, rest int")
    rows = {(r.g, r.i): r for r in line_dedup.suffix_array(df).collect()}
    assert len(rows) == sum(map(len, seqs))
    suffix = {(g, i): s[i:] for g, s in enumerate(seqs) for i in range(len(s))}
    for k in range(len(next(iter(rows.values())).ranks)):
        by = sorted({tuple(x[: 1 << k]) for x in suffix.values()})
        known = {}
        for x, s in suffix.items():
            known.setdefault(tuple(s[: 1 << k]), set()).add(rows[x].ranks[k])
        assert all(len(v) == 1 for v in known.values())
        order = [min(known[x]) for x in by]
        assert order == sorted(set(order))
    shared = lambda x, y: next((n for n, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    array = sorted(suffix, key=lambda x: (suffix[x], x))
    for p, x in enumerate(array):
        before = shared(suffix[array[p - 1]], suffix[x]) if p else 0
        assert (rows[x].place, rows[x].lcp) == (p, before)
        assert rows[x].longest == max((shared(suffix[x], suffix[y]) for y in suffix if y != x), default=0)


# --- decontamination ---------------------------------------------------------------------------------------------------


def test_search_is_exact(spark, sf):
    """Block-max WAND returns what scoring every entry does."""
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for threshold in (0.2, 0.5):
        ix = decontaminate.Index.build(items, threshold)
        found = 0
        for t in texts + [x for _, x in items]:
            words = decontaminate.words_of(t)
            ids = [ix.vocab.get(w, len(ix.vocab)) for w in words]
            for lo in range(0, len(words), 64):
                terms = set(ids[lo : lo + 128])
                import numpy as np

                want = {(d, round(sum(s for u, s in own.items() if u in terms), 9)) for d, own in enumerate(ix.shares) if sum(s for u, s in own.items() if u in terms) >= threshold}
                got = {(d, round(s, 9)) for b in range(ix.upper.shape[1]) for d, s in ix.search(np.array(sorted(terms)), b)}
                assert got == want
                found += len(want)
        assert found >= len(items)


def test_planted_items_are_found(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = "plain prose that no test holds with many words in it " * 40
    some = items.orderBy("item_id").limit(20).collect()
    rows = [(i, f"{clean[: 37 * (i % 9)]} {r.text} {clean}" if i % 2 else clean) for i, r in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(i, some[i].item_id) for i in range(1, 20, 2)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == list(range(0, 20, 2))
    parts = decontaminate.find_leaks(docs, items, shard_chars=1_500).collect()  # several indexes
    assert {(r.doc_id, r.item_id) for r in parts} == got


def test_later_parts_of_long_items_are_found(spark):
    """Items of 65 to 160 words, of which a document holds the latter part of the question and the answer, against brute force."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nprstvwxz"]
    some = lambda n: [rng.choice(words) + rng.choice(words) for _ in range(n)]
    other = lambda n: [f"{rng.choice(words)}q" for _ in range(n)]
    items, docs = [], []
    for n in range(65, 161):
        q, a = some(n - 16), some(16)
        items.append((n, f"{' '.join(q)}? {' '.join(a)}"))
        for d, share in enumerate((0.4, 0.55)):
            docs.append((2 * n + d, " ".join([*other(rng.randint(0, 200)), *q[int((1 - share) * len(q)) :], *a, *other(150)])))
    want = set()
    for d, text in docs:
        own = decontaminate.shingles(decontaminate.words_of(text))
        for n, t in items:
            parts = [decontaminate.shingles(x) for x in decontaminate.question_and_answer(t)]
            if all(len(x & own) >= 0.5 * len(x) for x in parts):
                want.add((d, n))
    assert len(want) == len(items)
    df, bench = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    rows = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    parts = decontaminate.find_leaks(df, bench, shard_chars=30_000).collect()  # several indexes with the same counts
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in parts} == {(r.doc_id, r.item_id, round(r.score, 9)) for r in rows}
    assert {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def brute_leaks(docs, items, threshold=0.5, least=0.5):
    """Every passage against every index entry by the BM25 formula, word by word, then question and answer in the region."""
    word = lambda t: "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    known = {k: word(t) for k, t in items.items() if word(t)}
    entries = [(k, e) for k, w in known.items() for e in [*(w[i : i + 64] for i in range(0, len(w) // 64 * 64, 64)), *([w[-64:]] if len(w) % 64 else [])]]
    n, mean = len(entries), sum(len(e) for _, e in entries) / len(entries)
    df = Counter(x for _, e in entries for x in set(e))
    weights = []
    for _, e in entries:
        w = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(e) / mean)) for x, c in Counter(e).items()}
        weights.append({x: v / sum(w.values()) for x, v in w.items()})
    holders = defaultdict(list)
    for i, w in enumerate(weights):
        for x in w:
            holders[x].append(i)
    grams = lambda w, m: {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    out = set()
    for d, text in docs.items():
        w = word(text)
        for lo in range(0, len(w), 64):
            score = defaultdict(float)
            for x in set(w[lo : lo + 128]):
                for i in holders.get(x, ()):
                    score[i] += weights[i][x]
            for i, v in score.items():
                k = entries[i][0]
                if v >= threshold and (d, k) not in out:
                    q, a = ([b.decode() for b in part] for part in decontaminate.question_and_answer(items[k]))
                    region = w[max(0, lo - len(q) - len(a)) : lo + 128 + len(q) + len(a)]
                    if all(len(own & grams(region, min(5, len(p)))) >= least * len(own) for p in (q, a) if (own := grams(p, min(5, len(p))))):
                        out.add((d, k))
    return out


def test_op5(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in entry.queries()["op5_decontamination"](spark, sf).collect()}
    assert got == brute_leaks(docs, items) and got


def test_leaks_odd(spark, odd, none, sf):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog again and again."), (2, None), (None, ""), (3, "word1 word2 word3 word4 word5 word6. word7 word8 word9")], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, items).collect()}
    assert got == {(1, 1), (5, 3)}
    assert decontaminate.find_leaks(odd, items.limit(0)).count() == 0 and decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.without_leaks(odd, items.limit(0)).count() == 10
    assert math.isclose(decontaminate.held([b"a"] * 3, {}, [b"a"] * 3), 1.0)


# --- Jaccard join ------------------------------------------------------------------------------------------------------


def sets_of(docs, k=5):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    out = []
    for d, t in docs:
        w = (t or "").encode().translate(low).split()
        out.append((d, frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute_components(docs, percent=75):
    sets = sets_of(docs)
    at = list(range(len(sets)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                at[root(i)] = root(j)
    least = {}
    for i, (d, a) in enumerate(sets):
        if d is not None and a:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(a), least.get(root(i)) if a else d) for i, (d, a) in enumerate(sets))


def made_copies(seed, groups=6, size=14):
    """Groups of copies with more and more words changed, exact copies, a passage that many share, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    passage = [word() for _ in range(30)]
    docs, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(6, 120))]
        for c in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[word()], [], [w[i], word()]])
            if rng.random() < 0.3:
                w += passage
            text = " ".join(w)
            docs.append((n, text.upper() if rng.random() < 0.1 else text))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one two three"), (0, docs[0][1]), (None, docs[0][1]), (None, "only null words here to see now")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "least"), [(1, 2), (2, 4), (3, 1_000_000)])
def test_components_brute_force(spark, seed, least):
    """With all recurring shingles held frequent, some, and none."""
    docs = made_copies(seed)
    out = jaccard_join.join_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), least=least)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute_components(docs)


def test_long_chain(spark):
    """A chain whose ends are far from alike is one component."""
    w = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(w[2 * i : 2 * i + 100])) for i in range(30)]
    got = jaccard_join.join_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_op9(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = entry.queries()["op9_jaccard_join"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(docs)


def test_join_odd(odd, none):
    out = jaccard_join.one_of_each(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sum(r.doc_id == 1 for r in rows) == 1 and sum(not (r.text or "").strip(BLANK) for r in rows) == 4 and len(rows) == 9
    assert jaccard_join.one_of_each(none).count() == 0 and jaccard_join.join_documents(none).count() == 0


def test_pairs_are_made_across_components_only(spark):
    """A list of one component gives none, and a list of several each pair across them once, however many rows one has."""
    rows = [(1, g, 10, 0, 5) for g in range(4_000)] + [(2, g, 10, 0, 5) for g in range(4_000)] + [(2, 4_000 + g, 10, 0, 6 + g) for g in range(3)]
    got = jaccard_join.mixed_pairs(spark.createDataFrame(rows, "token bigint, grp bigint, n int, j int, comp bigint"), 75)
    assert got.count() == got.distinct().count() == 4_000 * 3 + 3
    rng = random.Random(7)
    rows = list({(rng.randrange(6), rng.randrange(40), rng.randrange(9)) for _ in range(150)})
    got = {(r.x, r.y) for r in jaccard_join.mixed_pairs(spark.createDataFrame([(t, g, 10, 0, c) for t, g, c in rows], "token bigint, grp bigint, n int, j int, comp bigint"), 75).collect()}
    assert got == {(min(g, h), max(g, h)) for t, g, c in rows for u, h, d in rows if t == u and c != d}


def test_many_near_copies(spark):
    """4,000 near copies and some strangers that hold their passage: what is verified grows with the copies, not with their pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(4_000):
        w = list(base)
        w[rng.randrange(60)] = f"x{d}"
        docs.append((d, " ".join(w)))
    docs += [(4_000 + d, " ".join([*base[:30], *(f"y{d}z{i}" for i in range(60))])) for d in range(20)]
    sizes, old = [], jaccard_join._verify
    jaccard_join._verify = lambda pairs, *how: sizes.append(pairs.count()) or old(pairs, *how)
    try:
        got = {r.doc_id: r.component_id for r in jaccard_join.join_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)).collect()}
    finally:
        jaccard_join._verify = old
    assert {got[d] for d in range(4_000)} == {0} and all(got[d] == d for d in range(4_000, 4_020))
    assert sum(sizes) <= 30 * 4_000


def test_frequent_shingles_are_known_at_any_number(spark):
    """Where more shingles are frequent than may be known, some of the most frequent are."""
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(300)),)] * 50, "text string").coalesce(1)
    assert len(jaccard_join.frequent_shingles(df, "text", 5, most=1_000)) == 296
    assert 50 < len(jaccard_join.frequent_shingles(df, "text", 5, most=100)) < 150


def test_word_hashes_are_of_words():
    for text in ("", " ", "a", " a b  a\tB\n", "x" * 70_000 + " y " + "x" * 70_000, "é é e\u0301"):
        words = text.encode().translate(jaccard_join._LOWER).split()
        h = jaccard_join.word_hashes(text)[0].tolist()
        assert len(h) == len(words) and len(set(h)) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(i))


def test_components_of_edges(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.gid: r.comp for r in jaccard_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    at = {}
    root = lambda x: x if at.setdefault(x, x) == x else root(at[x])
    for a, b in edges:
        at[root(a)] = root(b)
    for x in got:
        for y in got:
            assert (got[x] == got[y]) == (root(x) == root(y))
