from collections import Counter

import numpy as np
import sentencepiece

import corpus_pipeline
import public_tokenizers
from millrace.llm import decontaminate
from millrace.llm.common import written

from .test_matching import brute_components, brute_lines, cut
from .test_scoring import brute_counts


def test_stages_brute_force(spark, sf):
    """Each stage against what it should do to its own input; run() gives the same rows as the stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    out = written(corpus_pipeline.STAGES[0][1](spark, docs, sf), "stage")
    kept = {r.doc_id: r for r in out.collect()}
    base = {d for d, r in rows.items() if (c := brute_counts(r.text))[0] < 50 or 100 * c[4] > 50 * c[0]}
    assert set(kept) <= set(rows) - base and out.columns == columns
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert len((bad - base) - set(kept)) <= 0.05 * len(bad)

    two = written(corpus_pipeline.STAGES[1][1](spark, out, sf), "stage")
    gone = brute_lines([(d, r.text) for d, r in kept.items()], 50)
    want = {d: cut(r.text, gone.get(d)) for d, r in kept.items()}
    want = {d: t for d, t in want.items() if d not in gone or t.split()}
    got = {r.doc_id: r for r in two.collect()}
    assert {d: r.text for d, r in got.items()} == want and two.columns == columns
    assert all(r.n_chars == len(r.text) for d, r in got.items() if d in gone)

    three = written(corpus_pipeline.STAGES[2][1](spark, two, sf), "stage")
    comps = brute_components([(d, r.text) for d, r in got.items()])
    assert sorted(r.doc_id for r in three.collect()) == sorted({c for _, _, c in comps}) and three.columns == columns

    four = written(corpus_pipeline.STAGES[3][1](spark, three, sf), "stage")
    items = [decontaminate.shingles(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in four.collect()}
    for r in three.collect():
        own = decontaminate.shingles(decontaminate.words_of(r.text))
        share = max(len(i & own) / len(i) for i in items)
        assert not (share >= 0.95 and r.doc_id in left) and not (share <= 0.4 and r.doc_id not in left)

    five = corpus_pipeline.STAGES[4][1](spark, four, sf).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in four.collect()}
    assert {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in five} == {d: sp.encode(t) for d, t in texts.items()}
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted(again) == sorted(five)


def test_empty(spark, sf, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_odd(spark, sf, odd):
    """Nulls, odd texts, a repeated row and clashing names: which rows each stage keeps of its own input, and their columns."""
    rows = odd.collect()
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    every = Counter(r.doc_id for r in rows)
    rules, dedup, join, leaks, tokens = (stage(spark, odd, sf) for _, stage in corpus_pipeline.STAGES)
    assert all(x.columns == odd.columns for x in (rules, dedup, join, leaks))
    assert ids(rules) == {d: n for d, n in Counter(r.doc_id for r in rows if r.text and len(r.text.split()) >= 50 and not 100 * brute_counts(r.text)[4] > 50 * brute_counts(r.text)[0]).items()}
    assert ids(dedup) == every and {r.text for r in dedup.collect()} == {r.text for r in rows}
    assert ids(join) == {**every, 1: 1}
    assert ids(leaks) == every
    got = tokens.collect()
    assert ids(tokens) == every and all(r.decoded for r in got) and sum(r.n_ids == 0 for r in got) == sum(not r.text for r in rows)
