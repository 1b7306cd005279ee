"""Operators that write tokens, and the pipeline."""

import io
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

import __spark_entry__ as entry
from millrace.llm import pieces, token_output
from millrace.llm.common import new_folder

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

ODD_TEXTS = ["", " ", "\n", " a", "\na", "a\n", "a \n b", "x  y", "don't it's\n's", "a\tb", "<|endoftext|> b", "a <|endoftext|> b", "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "\n<|endoftext|>", "日本 語\nэто ✓", "a\u00a0b \u2028c", "q\x1cr s", "w w\nw w", "\n\n", "a\n b"]


def direct(texts):
    """The library as it is."""
    t = Tokenizer.from_file(BPE)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_equals_the_library(docs):
    texts = ODD_TEXTS + [r.text for r in docs.collect()]
    for cached in (1_000_000, 10):
        coder = token_output.WordEncoder(BPE, cached=cached)
        got = [np.frombuffer(x, coder.dtype).tolist() for half in (texts[::2], texts[1::2]) for x in coder.encode(half)]
        assert got == direct(texts[::2] + texts[1::2])


def test_op3(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    ids = [x + [0] for x in direct([t for _, t in docs])]
    start = [0, *itertools.accumulate(map(len, ids))]
    want = {(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), s, x in zip(docs, start, ids, strict=False)}
    assert {tuple(r) for r in entry.queries()["op3_token_output"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_files(spark, docs):
    folder = new_folder(spark, "tokens")
    files = token_output.write_tokens(docs, folder, BPE, file_chars=100_000)
    assert files.count() > 1
    some = sorted(r.doc_id for r in docs.collect())[5::50]
    got = {r.doc_id: list(r.ids) for r in token_output.read_tokens(files, ids=some).collect()}
    want = {r.doc_id: r.text for r in docs.collect()}
    assert got == {d: x + [0] for d, x in zip(some, direct([want[d] for d in some]), strict=True)}
    path = files.orderBy("part").first()["path"]
    fs, at = pafs.FileSystem.from_uri(path)
    raw = fs.open_input_file(at).read()
    reader = token_output.Reader(io_file(raw))
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()  # any reader reads it
    assert plain.startswith(reader.frame(0) + reader.frame(1))
    broken = bytearray(raw)
    broken[int(reader.offsets[1]) + 9] ^= 0xFF
    with pytest.raises(Exception):  # noqa: B017  the frame's or the table's checksum
        token_output.Reader(io_file(bytes(broken))).frame(1)
    with pytest.raises(ValueError, match="seek|seekable"):
        token_output.Reader(io_file(raw[:-3] + b"abc"))


def test_hot_keys_are_dealt_to_several_files(spark):
    """A key and the null key with a third of the rows each; files stay in key order and hold every row once."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} of the table") for i in range(3_000)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "greatest")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    files = token_output.write_tokens(docs, new_folder(spark, "tokens"), BPE, file_chars=8_000)
    most = max(r.n_docs for r in files.collect())
    assert most < 400
    got = token_output.read_tokens(files).orderBy("start").collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda d: (d is not None, d or 0))
    ids = direct([t for _, t in rows])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, (*x, 0)) for (d, _), x in zip(rows, ids, strict=True))
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]


def io_file(data):
    import pyarrow as pa

    return pa.BufferReader(data)


def test_token_files_odd(spark, odd, none):
    files = token_output.write_tokens(odd, new_folder(spark, "tokens"), BPE)
    rows = token_output.read_tokens(files).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert sorted(r.n_tokens for r in rows if r.doc_id in (2, 3)) == [1, 1]
    by_start = sorted(rows, key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in by_start] == sorted([r.doc_id for r in rows], key=lambda d: (d is not None, d or 0))
    empty = token_output.write_tokens(none, new_folder(spark, "tokens"), BPE)
    assert token_output.read_tokens(empty).count() == 0


# --- SentencePiece -----------------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS + ["x" * 100 + " y", "▁ a", "a ▁b"])], "doc_id int, text string")
    both = [(r.text or "", list(r.ids), r.decoded) for d in (df, docs.limit(80)) for r in pieces.encode(d, MODEL, k=1).collect()]
    for text, ids, decoded in both:
        assert ids == sp.encode(text) and decoded == (sp.decode(ids) == text)


def all_segmentations(lat, unit):
    """(log-probability, pieces) of all segmentations of a unit, by brute force, with the lattice's weights."""
    out = []
    ids, _ = lat.tables([unit])
    for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(unit)]
        p, seg = 1.0, []
        for a, b in zip(at, at[1:], strict=False):
            x = int(ids[0, a, b - a - 1]) if b - a <= ids.shape[2] else -1
            w = lat.byte_weight ** len(unit[a].encode()) if x == -2 else lat.weight[x] if x >= 0 else 0.0
            p *= w
            seg.append(x)
        if p:
            out.append((p, tuple(seg), tuple(at)))
    total = sum(p for p, _, _ in out)
    return {(s, a): p / total for p, s, a in out}


def test_tables_give_path_probabilities():
    lat = pieces.Lattice(MODEL)
    for unit in ("▁there", "▁日本x", "ing", "▁", "▁αβ\u3400z"):
        ids, cum = lat.tables([unit])
        for (_seg, at), p in all_segmentations(lat, unit).items():
            q = 1.0
            for a, b in zip(at, at[1:], strict=False):
                q *= cum[0, a, b - a - 1] - (cum[0, a, b - a - 2] if b - a > 1 else 0)
            assert math.isclose(p, q, rel_tol=1e-3, abs_tol=1e-6)


def test_samples_are_draws_without_replacement():
    """Over many keys: first samples follow the lattice, and pairs follow sampling without replacement; samples are distinct."""
    known = pieces.units(MODEL)
    text = "then"
    probs = {s: p for (s, _), p in all_segmentations(known.lattice, "▁then").items()}
    n = 4000
    chunk = pieces.Chunk(known, [text] * n, [str(i) for i in range(n)])
    drawn = pieces.samples(chunk, 3)
    firsts, pairs, weight = Counter(), Counter(), Counter()
    for i in range(n):
        got = drawn[i]
        ids = [tuple(int(x) for x in g[0]) for g in got]
        assert len(set(ids)) == len(ids) == min(3, len(probs))
        for x, log, q in got:
            assert math.isclose(log, math.log(probs[tuple(int(v) for v in x)]), abs_tol=2e-3) and 0 < q <= 1
            weight[tuple(int(v) for v in x)] += math.exp(log) / q
        firsts[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
    for s, p in probs.items():
        assert abs(firsts[s] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 0.003
        assert abs(weight[s] / n - p) < 0.1 * p + 0.01  # inclusion scores make unbiased estimates
        for u, v in probs.items():
            if u != s:
                want = p * v / (1 - p)
                assert abs(pairs[s, u] / n - want) < 4 * math.sqrt(want / n) + 0.004


def test_samples_of_several_units_brute_force():
    """A text of three units: firsts and pairs follow the products of the units' probabilities, without replacement."""
    known = pieces.units(MODEL)
    text = "an it\nso"
    units = known.lattice.units_of(known.lattice.sp.normalize(text))
    assert len(units) == 4
    some = [all_segmentations(known.lattice, u) for u in units]
    probs = Counter()
    for way in itertools.product(*(x.items() for x in some)):
        ids = tuple(x for u, ((seg, at), _) in zip(units, way, strict=True) for i, a in zip(seg, at, strict=False) for x in ([i] if i >= 0 else known.lattice.spelled(u[a])))
        probs[ids] += math.prod(p for _, p in way)
    assert abs(sum(probs.values()) - 1) < 1e-9 and len(probs) > 20
    n = 6000
    drawn = pieces.samples(pieces.Chunk(known, [text] * n, [f"k{i}" for i in range(n)]), 3)
    firsts, pairs, weight = Counter(), Counter(), Counter()
    for row in drawn:
        ids = [tuple(map(int, x)) for x, _, _ in row]
        assert len(set(ids)) == 3 and all(math.isclose(log, math.log(probs[i]), abs_tol=1e-6) for i, (_, log, _) in zip(ids, row, strict=True))
        firsts[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
        for i, (_, log, q) in zip(ids, row, strict=True):
            weight[i] += math.exp(log) / q / n
    for a, p in probs.most_common(12):
        assert abs(firsts[a] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 0.002
        assert abs(weight[a] - p) < 0.15 * p + 0.01
        for b, q in probs.most_common(6):
            if a != b:
                want = p * q / (1 - p)
                assert abs(pairs[a, b] / n - want) < 4 * math.sqrt(want / n) + 0.003


def test_all_segmentations_come_back():
    """With k at or over their number, however unlikely the last ones are."""
    known = pieces.units(MODEL)
    for text in ("then", "the", "a b", "\u3400", "x\u3400y", "international"):
        units = known.lattice.units_of(known.lattice.sp.normalize(text))
        ways = [all_segmentations(known.lattice, u) for u in units]
        number = math.prod(map(len, ways))
        if number > 3_000:
            continue
        row = pieces.samples(pieces.Chunk(known, [text], ["7"]), number + 5)[0]
        assert len(row) == number and len({tuple(map(int, x)) for x, _, _ in row}) == number
        assert math.isclose(sum(math.exp(p) for _, p, _ in row), 1, rel_tol=1e-6) and row[-1][2] == 1


def test_long_unspaced_texts_have_the_whole_lattice():
    """A text of 200 characters without spaces: log-probabilities are those of the uncut lattice, by sums over all ways."""
    known = pieces.Units(pieces.Lattice(MODEL))
    lat = known.lattice
    rng = np.random.default_rng(9)
    for text in ("".join(rng.choice(list("abcdefghijklmnopqrst"), 200)), "internationalization" * 10, "日本語の文章です" * 25):
        normal = lat.sp.normalize(text)
        weight = lambda s: lat.weight[i] if (i := lat.sp.piece_to_id(s)) != lat.unknown else lat.byte_weight ** len(s.encode()) if len(s) == 1 else 0.0  # noqa: B023, E731
        total = [-math.inf] * len(normal) + [0.0]
        for s in range(len(normal) - 1, -1, -1):
            parts = [math.log(w) + total[e] for e in range(s + 1, min(len(normal), s + lat.longest) + 1) if (w := weight(normal[s:e]))]
            top = max(parts)
            total[s] = top + math.log(sum(math.exp(x - top) for x in parts))
        for ids, log, _ in pieces.samples(pieces.Chunk(known, [text], ["3"]), 3)[0]:
            at, own, i = 0, 0.0, 0
            ids = [int(x) for x in ids]
            while i < len(ids):
                if lat.sp.is_byte(ids[i]):
                    n = len(normal[at].encode())
                    own += math.log(weight(normal[at]))
                    i, at = i + n, at + 1
                else:
                    p = lat.sp.id_to_piece(ids[i])
                    own += math.log(weight(p))
                    i, at = i + 1, at + len(p)
            assert at == len(normal) and math.isclose(log, own - total[0], rel_tol=1e-6, abs_tol=1e-6)


def test_samples_decode_and_do_not_depend_on_batches(docs):
    known = pieces.units(MODEL)
    rows = docs.limit(30).collect()
    texts, keys = [r.text for r in rows], [str(r.doc_id) for r in rows]
    whole = pieces.samples(pieces.Chunk(known, texts, keys), 3)
    for i, (t, k) in enumerate(zip(texts, keys, strict=True)):
        alone = pieces.samples(pieces.Chunk(pieces.Units(known.lattice), [t], [k]), 3)[0]
        got = whole[i]
        assert [list(map(int, g[0])) for g in got] == [list(map(int, g[0])) for g in alone]
        for ids, _, _ in got:
            assert known.lattice.sp.decode([int(x) for x in ids]) == t
        logs = [g[1] for g in got]
        assert len({tuple(map(int, g[0])) for g in got}) == len(logs)


def test_every_piece_of_the_model_is_in_the_lattice(docs):
    """No piece of the library's own segmentation crosses units: runs of spaces, and long words cut only where no piece spans."""
    known = pieces.Units(pieces.Lattice(MODEL))
    lat = known.lattice
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 700))
    texts = ["def f():\n   return 1", "a" + " " * 40 + "b \n  c  ", "internationalization" * 9, "https://example.org/" + long[:90], long, "日本語の文章です。" * 30, "\u3400" * 200, *[r.text for r in docs.limit(80).collect()]]
    for t in texts:
        normal = lat.sp.normalize(t)
        units = lat.units_of(normal)
        assert "".join(units) == normal
        ends = set(itertools.accumulate(map(len, units)))
        for length in range(2, lat.longest + 1):
            for at in range(len(normal) - length + 1) if len(normal) < 3_000 else ():
                if lat.sp.piece_to_id(normal[at : at + length]) != lat.unknown:
                    assert not any(e in ends for e in range(at + 1, at + length)), normal[at : at + length]
    drawn = pieces.samples(pieces.Chunk(known, texts, [str(i) for i in range(len(texts))]), 4)
    for i, (t, row) in enumerate(zip(texts, drawn, strict=True)):
        assert len({tuple(map(int, ids)) for ids, _, _ in row}) == len(row) and (len(row) == 4 or t[0] in "日\u3400")  # no piece holds two of these characters
        assert all(lat.sp.decode([int(x) for x in ids]) == t and math.isfinite(log) and 0 <= q <= 1 for ids, log, q in row)
        alone = pieces.samples(pieces.Chunk(pieces.Units(lat), [t], [str(i)]), 4)[0]
        assert [list(map(int, x[0])) for x in alone] == [list(map(int, x[0])) for x in row]


def test_round_trips_are_of_the_ids():
    """Ids that are in the wrong place or order don't give the text back."""
    texts = ["one two three", "four five six", "", "a  b\n c", "\u3400x", "▁ a", "plain"]
    c = pieces.Chunk(pieces.units(MODEL), texts, list(texts))
    ids = c.encoded()
    assert c.decoded(ids) == [c.lattice.sp.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
    assert c.decoded([ids[1], ids[0], *ids[2:]])[:2] == [False, False] and c.decoded([ids[0][::-1], *ids[1:]])[0] is False


def test_pieces_odd(spark, odd, none):
    out = pieces.encode(odd, MODEL, k=2)
    rows = out.collect()
    assert len(rows) == 10 and all(r.decoded for r in rows) and all(len(r.samples) == 1 for r in rows if not r.text)
    back = pieces.decode(out.select("doc_id", "ids"), MODEL).collect()
    assert Counter(r.text for r in back) == Counter(r.text or "" for r in rows)
    assert pieces.encode(none, MODEL).count() == 0
    packed = pieces.encode(odd, MODEL, k=1, packed=True)
    assert Counter(r.text for r in pieces.decode(packed.select("ids"), MODEL, packed=True).collect()) == Counter(r.text or "" for r in rows)


def test_op10(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op10_pieces"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = sp.encode(docs[r.doc_id])
        assert (r.n_ids, r.ids_crc32, r.decoded) == (len(ids), zlib.crc32(np.array(ids, "<u2").tobytes()), True)
