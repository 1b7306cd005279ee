"""Token-ID output: independent zstandard frames, one a document, with a trailing seek table and a checksum for each frame.

A file holds the frames of its documents in ascending id order, an index frame (ids and lengths), and the seek table of the
seekable zstandard format: a skippable frame with an entry (compressed size, decompressed size, low 32 bits of the XXH64 of
the content) for every frame, and a footer. So any zstandard reader reads a file, and a reader of single documents
decompresses only these. Token ids are unsigned little-endian integers of 2 bytes where the vocabulary allows, else of 4.
"""

from __future__ import annotations

import gc
import json
import os
import string
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FlatTable, hash_share, new_folder, ship, within_share, worker_cache

#: Fixed values of the seekable zstandard format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

#: White space other than spaces and newlines.
OTHER_ASCII = [c for c in map(chr, range(128)) if c.isspace() and c not in " \n"]
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def plain(text: str, special: tuple[str, ...] = ()) -> bool:
    """Whether the text's white space is single spaces and newlines between words, and it holds none of the special strings."""
    if any(s in text for s in special):
        return False
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in (OTHER_ASCII if text.isascii() else OTHER_SPACE))


class WordEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library.

    Its pre-tokenizer never joins over a single space or newline, so the tokens of a word with the space before it don't
    depend on its neighbours. Each such word is encoded once and kept; new ones are encoded together, a newline between
    them. Texts in which that isn't plain to see (also those that hold the string of a special token, which the library makes
    that token), and all texts of other tokenizers, are encoded whole. The cache is bounded and lives as long as the worker.
    """

    def __init__(self, path: str, cached: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        shape = json.loads(self.tokenizer.to_str())
        pre = shape.get("pre_tokenizer") or {}
        self.special = tuple(t["content"] for t in shape.get("added_tokens") or ())
        line = self._whole("\n")
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not shape.get("normalizer") and len(line) == self.dtype.itemsize
        self.line = int(np.frombuffer(line, self.dtype)[0]) if self.by_word else -1
        self.cached, self.table = cached, None

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, words: set[str]) -> None:
        """Words that begin with a tab have no space before them, those with a newline have it instead.

        The pre-tokenizer parts letters from punctuation behind them, so such words are put together from both.
        """
        known = self.table.numbers
        both, heads, ends, need = [], [], [], set()
        for w in words:
            head = w.rstrip(string.punctuation)
            if len(head) < len(w) and head.lstrip("\t\n").isalpha():
                both.append(w)
                heads.append(head)
                ends.append("\t" + w[len(head) :])
            else:
                need.add(w)
        need.update(heads, ends)
        self._add(list(need.difference(known)))
        if both:
            pairs = np.stack([self.table.numbered(heads), self.table.numbered(ends)], 1).ravel()
            ids, first = self.table.joined(pairs)
            self.table.add(both, ids, first[:-1:2], first[2::2] - first[:-1:2])

    def _add(self, words: list[str]) -> None:
        if not words:
            return
        ids = self._ids("\n" + "\n".join([w[1:] if w[0] in "\t\n" else " " + w for w in words]))
        cuts = np.flatnonzero(ids == self.line)
        bare = np.fromiter((w[0] != "\n" for w in words), np.int64, len(words))
        ends = np.append(cuts[1:], len(ids))
        self.table.add(words, ids, cuts + bare, ends - cuts - bare)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text, as bytes; null: none."""
        words: list[str] = []
        bounds: list[tuple[int, int] | None] = []
        for t in texts:
            if t and self.by_word and plain(t, self.special):
                own = t.replace("\n", " \n").split(" ")
                own[0] = "\t" + own[0]
                bounds.append((len(words), len(words) + len(own)))
                words += own
            else:
                bounds.append(None)
        if self.table is None or len(self.table.numbers) > self.cached:
            self.table = FlatTable(self.dtype)
        kind = self.table.found(words)
        new = np.flatnonzero(kind < 0).tolist()
        if new:
            fresh = [words[i] for i in new]
            self._learn(set(fresh))
            kind[new] = self.table.numbered(fresh)
        self.table.warm(words, kind)
        ids, first = self.table.joined(kind)
        return [ids[first[b[0]] : first[b[1]]].tobytes() if b else self._whole(t) if t else b"" for t, b in zip(texts, bounds, strict=True)]


def encoder(path: str) -> WordEncoder:
    cache = worker_cache("token_output")
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


class FrameWriter:
    """Writes one file of frames."""

    def __init__(self, out, width: int, level: int = 1):
        self.out, self.width, self.level = out, width, level
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    @staticmethod
    def frame(data: bytes, level: int = 1) -> bytes:
        return zstandard.ZstdCompressor(level=level, write_checksum=True).compress(data)

    def add(self, key: int | None, frame: bytes, size: int, checksum: int) -> None:
        self.out.write(frame)
        self.table.append((len(frame), size, checksum))
        self.ids.append(key)
        self.lengths.append(size // self.width)

    def close(self) -> None:
        n = len(self.ids)
        index = struct.pack("<BQ", self.width, n) + np.array([k if k is not None else 0 for k in self.ids], "<i8").tobytes() + np.array([k is None for k in self.ids], "u1").tobytes() + np.array(self.lengths, "<u8").tobytes()
        frame = self.frame(index, self.level)
        self.out.write(frame)
        self.table.append((len(frame), len(index), xxhash.xxh64_intdigest(index) & 0xFFFFFFFF))
        entries = np.array(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))


@dataclass
class Reader:
    """Random access to one file: only the seek table, the index and the requested frames are read."""

    source: object

    def __post_init__(self):
        self.unpack = zstandard.ZstdDecompressor()
        size = self.source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        start = size - 9 - 12 * n
        mark, length = struct.unpack("<II", self._at(start - 8, 8))
        if mark != SKIPPABLE or length != 12 * n + 9:
            raise ValueError("broken seek table")
        self.table = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(n - 1)
        self.width, many = struct.unpack_from("<BQ", index)
        keys = np.frombuffer(index, "<i8", many, 9)
        null = np.frombuffer(index, "u1", many, 9 + 8 * many)
        self.ids = [None if m else int(k) for k, m in zip(keys, null, strict=True)]
        self.lengths = np.frombuffer(index, "<u8", many, 9 + 9 * many).astype(np.int64)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        return self._content(i, self._at(int(self.offsets[i]), int(self.table[i, 0])))

    def _content(self, i: int, raw) -> bytes:
        data = self.unpack.decompress(raw, max_output_size=int(self.table[i, 1]) or 1)
        if len(data) != self.table[i, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"checksum of frame {i} does not hold")
        return data

    def tokens(self, i: int) -> np.ndarray:
        return self._tokens(self.frame(i))

    def _tokens(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def several(self, some: list[int]) -> list[np.ndarray]:
        """The tokens of frames in ascending order; frames that follow each other are read at once."""
        out, at = [], 0
        while at < len(some):
            end = at + 1
            while end < len(some) and some[end] == some[end - 1] + 1:
                end += 1
            first = int(self.offsets[some[at]])
            raw = memoryview(self._at(first, int(self.offsets[some[end - 1] + 1]) - first))
            for i in some[at:end]:
                low = int(self.offsets[i]) - first
                out.append(self._tokens(self._content(i, raw[low : low + int(self.table[i, 0])])))
            at = end
        return out


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def _edges(rows: DataFrame, n: int, file_chars: int, least: int, sample: int) -> tuple[int, np.ndarray]:
    """Parts that hold the null keys, and the keys at which the other parts begin (a hot key as often as it has parts to itself).

    By a hash sample of keys with the sizes of their texts, of ``sample`` rows or one in 20,000 at least: parts are cut by size.
    """
    share = hash_share(n, max(sample, n // 20_000))
    some = rows.select("k", F.coalesce(F.octet_length("t"), F.lit(0)).cast("long").alias("b"), F.xxhash64("k", F.octet_length("t"), F.lit(7)).alias("h"))
    got = some.where(within_share(F.shiftrightunsigned("h", 1), share)).select("k", "b").toArrow()  # bounded by the sample
    null = got.column("k").is_null().to_numpy()
    size = got.column("b").to_numpy() + 64
    scale = n / max(1, len(size))
    parts = max(1, int(-(-size.sum() * scale // file_chars)), least)
    for_null = int(round(parts * size[null].sum() / max(1, size.sum()))) if null.any() else 0
    keys, size = got.column("k").fill_null(0).to_numpy()[~null], size[~null]
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(size[order])
    own = max(1, parts - for_null)
    cuts = np.searchsorted(ends, np.arange(1, own) * (ends[-1] / own)) if len(ends) else np.empty(0, np.int64)
    return for_null, keys[order][cuts].astype(np.int64)


def parts_of(keys: list[int | None], checksums: list[int], for_null: int, edges: np.ndarray) -> np.ndarray:
    """The part of each row: by its key and, where several parts hold that key, by the checksum of its ids."""
    null = np.array([k is None for k in keys], bool)
    known = np.array([0 if k is None else k for k in keys], np.int64)
    turn = np.array(checksums, np.int64)
    low, high = np.searchsorted(edges, known, side="left"), np.searchsorted(edges, known, side="right")
    own = np.where(high - low > 1, low + (turn * (high - low + 1) >> 32), high) + for_null
    return np.where(null, turn * for_null >> 32, own)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text", file_chars: int = 128 << 20, level: int = 1, sample: int = 50_000) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the files ``part-NNNNNN.zst`` to ``folder`` in ascending key order.

    Returns the manifest, a row a file: part, path, n_docs, n_ids and start (ids of all files before it). Null texts are
    empty; null keys come first; rows equal in key follow each other by a checksum of their ids, and repeated rows are written
    each. An empty table gives no file. Only key and text are read, so other columns may have any name. A text of any length is
    encoded whole, in a task of its own size. Encoding and compression run before the only shuffle, which moves compressed
    frames to key ranges of about ``file_chars`` bytes of text; a key that holds more is dealt to several files by checksum. The
    ranges come from a sample of keys and text sizes. A file is written under a name of its own and moved in place whole, so a
    repeated task does no harm.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    n = docs.count()
    for_null, edges = _edges(rows, n, file_chars, min(2 * spark.sparkContext.defaultParallelism, -(-n // 500)), sample) if n else (0, np.empty(0, np.int64))
    parts = for_null + len(edges) + 1

    def encode(batches):
        gc.disable()  # millions of strings and no cycles: passes over them find nothing
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches):
        coder = encoder(tokenizer)
        width = coder.dtype.itemsize
        pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        end = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for run in _runs(sizes):
                texts = [column[i].as_py() for i in run]
                data = [d + end for d in coder.encode(texts)]
                sums = [xxhash.xxh64_intdigest(d) & 0xFFFFFFFF for d in data]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts_of([keys[i] for i in run], sums, for_null, edges), pa.int32()),
                        pa.array([keys[i] for i in run], pa.int64()),
                        pa.array([len(d) for d in data], pa.int64()),
                        pa.array([width] * len(run), pa.int32()),
                        pa.array(sums, pa.int64()),
                        pa.array([pack(d) for d in data], pa.binary()),
                    ],
                    names=["part", "k", "size", "width", "checksum", "frame"],
                )

    def write(batches):
        fs, root = _open(folder)
        now, out, done, name = None, None, [], ""

        def finish():
            writer.close()
            out.close()
            final = f"{root}/part-{now:06d}.zst"
            fs.move(name, final)
            done.append((now, f"{folder}/part-{now:06d}.zst", len(writer.ids), int(sum(writer.lengths))))

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for part, k, size, width, checksum, frame in zip(*cols, strict=True):
                if part != now:
                    if out is not None:
                        finish()
                    now, name = part, f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(name)
                    writer = FrameWriter(out, width, level)
                writer.add(k, frame, size, checksum)
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "n_docs", "n_ids"])

    frames = rows.mapInArrow(encode, "part int, k bigint, size bigint, width int, checksum bigint, frame binary")
    dealt = frames.repartitionById(parts, "part")
    files = dealt.sortWithinPartitions("part", F.asc_nulls_first("k"), "checksum", "size").mapInArrow(write, "part int, path string, n_docs bigint, n_ids bigint").collect()  # a row a file
    manifest, start = [], 0
    for f in sorted(files):
        manifest.append((f.part, f.path, f.n_docs, f.n_ids, start))
        start += f.n_ids
    return spark.createDataFrame(manifest, "part int, path string, n_docs bigint, n_ids bigint, start bigint")


def _runs(sizes: list[int], most: int = 4 << 20):
    run, total = [], 0
    for i, s in enumerate(sizes):
        if run and total + s > most:
            yield run
            run, total = [], 0
        run.append(i)
        total += s
    if run:
        yield run


def read_tokens(manifest: DataFrame, ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Per document in the files: doc_id, start, n_tokens, ids_crc32 and (with_ids) the token ids. ``ids``: only these are decompressed.

    Every frame read is checked against its checksum; a file whose frames don't hold fails the query.
    """
    ship(manifest.sparkSession)
    wanted = None if ids is None else set(ids)
    n = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _open(path)
                with fs.open_input_file(at) as f:
                    r = Reader(f)
                    starts = start + np.concatenate([[0], np.cumsum(r.lengths)])
                    chosen = [i for i, k in enumerate(r.ids) if wanted is None or k in wanted]
                    for lo in range(0, len(chosen), 256):
                        some = chosen[lo : lo + 256]
                        tokens = r.several(some)
                        arrays = [pa.array([r.ids[i] for i in some], pa.int64()), pa.array([int(starts[i]) for i in some], pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([zlib.crc32(t.tobytes()) for t in tokens], pa.int64())]
                        if with_ids:
                            arrays.append(pa.array([t.tolist() for t in tokens], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return manifest.select("path", "start").repartition(n).mapInArrow(run, schema)


def token_folder(spark) -> str:
    """A new folder for files that only one query reads."""
    return new_folder(spark, "tokens")
