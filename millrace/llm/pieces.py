"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

``encode`` gives the model's own ids, ``decode`` the text. ``sample`` draws k distinct segmentations of a whole text from the
lattice of its pieces by perturbed A* search: the tree's nodes are prefixes of a segmentation (of whole units), a node's bound
is the largest Gumbel-perturbed log-probability below it, and the search always opens the node with the highest bound. The
first sample is an exact draw; each further one is the best leaf of the best sibling left, so the k samples are drawn without
replacement. A sample's inclusion score is the probability that its perturbed value exceeds the best bound left. All random
numbers are hashes of the row's key, the sample and the place, so results depend on nothing else.

Where a unit has several segmentations taken, or hardly any mass beside the first, the search goes on with whole numbers (weights
scaled by the same power of two for each character), so that no segmentation is lost to rounding: k samples come back wherever
there are k segmentations.

A piece's weight falls with its rank in the model: ln p = -ln(rank + 20). A unit of the lattice is a run of spaces with what
follows up to the next space or newline, or a newline. Units of over 32 characters are cut, but only where no piece of the
model spans the cut, and stay whole where there is no such place. So no piece crosses units, equal units share their tables,
and units of one length are treated together, as arrays.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FlatTable, fresh, grown, out_schema, released, ship, worker_cache

LONGEST = 32  # characters of a unit, where it can be cut
_UNIT = re.compile("▁*[^▁\n]+|▁+|\n")
EXACT = 96  # binary places for each character, where masses are whole numbers
SPARE = 1e-6  # mass beside a unit's main segmentation below which whole numbers are used
_PRIME = np.uint64(0x9E3779B185EBCA87)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def uniform(seed, counter) -> np.ndarray:
    """Numbers in (0, 1) that depend on seed and counter alone (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.asarray(seed, np.uint64) + (np.asarray(counter).astype(np.uint64) + np.uint64(1)) * _GOLD
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


_M = (1 << 64) - 1


def uniform_one(seed: int, counter: int) -> float:
    """One number of :func:`uniform`."""
    z = (seed + (counter + 1) * 0x9E3779B97F4A7C15) & _M
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
    z ^= z >> 31
    return ((z >> 12) + 0.5) * 2.0**-52


def units_of(normal: str) -> list[str]:
    """The units of a normalized text, before long ones are cut."""
    return _UNIT.findall(normal)


def row_seed(key, stream: int) -> int:
    return xxhash.xxh64_intdigest("" if key is None else str(key), stream)


class Lattice:
    """The pieces of a model by the hash of their characters."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.bytes = {}
        normal = []
        for i in range(n):
            if self.sp.is_byte(i):
                self.bytes[int(self.sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)):
                normal.append(i)
        self.bytes_of = FlatTable(np.uint8)  # of each piece
        raw = [bytes([int(x[1:-1], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else x.encode() for i, x in enumerate(map(self.sp.id_to_piece, range(n)))]
        size = np.fromiter(map(len, raw), np.int64, n)
        self.bytes_of.add([str(i) for i in range(n)], np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
        normal.sort(key=lambda i: (-self.sp.get_score(i), i))
        self.weight = np.zeros(n + 2)  # the last two are for no piece
        for rank, i in enumerate(normal):
            self.weight[i] = 1 / (rank + 20)
        self.byte_weight = 1 / (n + 20)
        self.unknown = self.sp.unk_id()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        text = [self.sp.id_to_piece(i) for i in normal]
        self.longest = max(map(len, text), default=1)
        self.lift = min(12.0, 1e200 ** (1 / self.longest)) ** np.arange(1, self.longest + 1)  # the same factor for all paths of a unit: keeps numbers in range
        size = np.fromiter(map(len, text), np.int64, len(text))
        codes = np.frombuffer("".join(t.ljust(self.longest, "\0") for t in text).encode("utf-32-le"), np.uint32).reshape(len(text), self.longest).astype(np.uint64)
        self.bits, self.begun = np.uint64(45), np.zeros(1 << 19, bool)  # slots of the beginnings of pieces
        hashes, h = np.zeros(len(text), np.uint64), np.zeros(len(text), np.uint64)
        for k in range(self.longest):
            h = self._next(h, codes[:, k])
            hashes[size == k + 1] = h[size == k + 1]
            self.begun[(h[size > k] >> self.bits).astype(np.int64)] = True
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(normal, np.int32)[order]
        slots = (self.keys >> self.bits).astype(np.int64)
        self.slot = np.full(1 << 19, -1, np.int32)  # the first piece of each slot
        self.slot[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.run = int(np.bincount(slots, minlength=1).max()) if len(slots) else 0  # pieces in a slot, at most

    @staticmethod
    def _next(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h + c + np.uint64(1)) * _PRIME
        return h ^ (h >> np.uint64(29))

    def units_of(self, normal: str) -> list[str]:
        """The units of a normalized text."""
        units = units_of(normal)
        if max(map(len, units), default=0) > LONGEST:
            units = [part for u in units for part in ([u] if len(u) <= LONGEST else self.cut(u))]
        return units

    def cut(self, unit: str) -> list[str]:
        """The parts of a long unit: as long as LONGEST allows, cut where no piece spans the place, longer where there is none."""
        _, ids = self.pieces([unit])
        m, top = len(unit), ids.shape[1]
        spans = np.zeros(m + top + 1, np.int64)
        for length in range(2, top + 1):
            s = np.flatnonzero(ids[:, length - 1, 0] >= 0)
            spans[s + 1] += 1
            spans[s + length] -= 1
        free = [*np.flatnonzero(np.cumsum(spans[:m]) == 0).tolist(), m]
        out, start, last = [], 0, 0
        for at in free:
            if at - start > LONGEST and last > start:
                out.append(unit[start:last])
                start = last
            last = at
        return [*out, unit[start:]]

    def pieces(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For units of one length: their characters, and ids[unit, place, length - 1] of the pieces (-1: none, -2: the character's bytes)."""
        n, m = len(units), len(units[0])
        top = min(m, self.longest)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(n, m).T.astype(np.uint64)
        ids = np.full((m, top, n), -1, np.int32)
        if m > LONGEST:  # few units: all places at once
            h = np.zeros((m, n), np.uint64)
            for length in range(1, top + 1):
                h = self._next(h[: m - length + 1], chars[length - 1 :])
                at = self.slot[(h >> self.bits).view(np.int64)]
                rows = np.nonzero(at >= 0)
                at, key = at[rows], h[rows]
                for _ in range(self.run):
                    hit = self.keys[at] == key
                    ids[rows[0][hit], length - 1, rows[1][hit]] = self.ids[at[hit]]
                    at = np.minimum(at + 1, len(self.keys) - 1)
            ids[:, 0][ids[:, 0] < 0] = -2
            return chars, ids
        for s in range(m):
            h, going = np.zeros(n, np.uint64), None  # going: the units of which some piece begins so; None: all
            for length in range(1, min(top, m - s) + 1):
                c = chars[s + length - 1]
                h = self._next(h, c if going is None else c[going])
                slot = (h >> self.bits).view(np.int64)
                at = self.slot[slot]
                rows = np.flatnonzero(at >= 0)
                if len(rows):
                    at, key = at[rows], h[rows]
                    out = ids[s, length - 1]
                    if going is not None:
                        rows = going[rows]
                    for _ in range(self.run):
                        hit = self.keys[at] == key
                        out[rows[hit]] = self.ids[at[hit]]
                        at = np.minimum(at + 1, len(self.keys) - 1)
                left = np.flatnonzero(self.begun[slot])
                if len(left) < 0.7 * len(h):
                    going, h = left if going is None else going[left], h[left]
                    if not len(left):
                        break
            lone = ids[s, 0] < 0
            ids[s, 0, lone] = -2
        return chars, ids

    def _steps(self, chars: np.ndarray, ids: np.ndarray):
        """From the last place on: (place, probabilities of the next piece's lengths there, by length and unit)."""
        m, top, n = ids.shape
        z = np.ones((m + 1, n))
        for s in range(m - 1, -1, -1):
            k = min(top, m - s)
            p = self.weight[ids[s, :k]]
            lone = np.flatnonzero(ids[s, 0] == -2)
            if len(lone):
                c = chars[s, lone]
                p[0, lone] = self.byte_weight ** (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            p *= self.lift[:k, None]
            p *= z[s + 1 : s + 1 + k]
            z[s] = p.sum(0)
            p /= z[s]
            if m > LONGEST or len(lone):  # by powers of two, which changes no digit
                z[s : s + top] = np.ldexp(z[s : s + top], -np.frexp(z[s])[1])
            yield s, p

    def tables(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For units of one length m: ids[unit, place, length - 1] as :meth:`pieces`, and cum[unit, place, length - 1], the summed
        probabilities of the next piece's lengths given that the place is reached."""
        chars, ids = self.pieces(units)
        m, top, n = ids.shape
        cum = np.ones((n, m, top))
        for s, p in self._steps(chars, ids):
            c = np.cumsum(p, axis=0)
            c /= c[-1]
            cum[:, s, : len(p)] = c.T
        return ids.transpose(2, 0, 1), cum

    def main(self, units: list[str], block: int = 20_000) -> tuple[Walks, np.ndarray]:
        """The main segmentation of each unit, and the probability of all others together, summed up place by place."""
        out, spare = _Parts(self, units), np.zeros(len(units))
        for m, some in _by_length(np.fromiter(map(len, units), np.int64, len(units)), block):
            chars, ids = self.pieces([units[i] for i in some.tolist()])
            n = len(some)
            x = np.arange(n)
            length, piece, rest, other = np.zeros((m, n), np.int64), np.zeros((m, n), np.int32), np.zeros((m + 1, n)), np.zeros((m + 1, n))
            for s, p in self._steps(chars, ids):
                best = p.argmax(0)
                length[s], piece[s] = best + 1, ids[s, best, x]
                here, after = p[best, x], s + length[s]
                rest[s] = np.log(here) + rest[after, x]
                p[best, x] = 0
                other[s] = p.sum(0) + here * other[after, x]
            starts, place = np.zeros((n, m), bool), np.zeros(n, np.int64)
            while len(x):
                starts[x, place] = True
                place = place + length[place, x]
                left = np.flatnonzero(place < m)
                x, place = x[left], place[left]
            spare[some] = other[0]
            out.add(some, starts, piece.T, rest[0])
        return out.walks(), spare

    def encode_units(self, some: list[str]) -> tuple[list[list[int]], list[bool]]:
        """The model's ids of units, and whether a text with the unit is to be encoded as a whole: for lone and
        several spaces, long units, and units whose ids behind a newline don't stand alone."""
        lead = self.sp.encode("\n")
        n = len(lead)
        ids = self.sp.encode([u[1:] if u[0] == "▁" else "\n" + u for u in some], num_threads=1)
        odd = [len(u) >= LONGEST or u[:2] in ("▁", "▁▁") for u in some]
        for i in [i for i, u in enumerate(some) if u[0] != "▁"]:
            odd[i] = odd[i] or ids[i][:n] != lead
            ids[i] = ids[i][n:]
        return ids, odd

    def walk(self, text: list[str], kinds: np.ndarray, seeds: np.ndarray, masks: np.ndarray, block: int = 20_000) -> Walks:
        """A segmentation of the unit text[k] for each k of kinds, drawn from all but that of its mask.

        A mask has a bit for each place where a piece starts. On the way along the barred segmentation, its remaining
        probability is taken off the piece that it goes on with.
        """
        distinct, which = np.unique(kinds, return_inverse=True)
        names = [text[k] for k in distinct.tolist()]
        size = np.fromiter(map(len, names), np.int64, len(names))
        out = _Parts(self, names, which)
        for m, some in _by_length(size[which], block):
            here, row = np.unique(which[some], return_inverse=True)
            ids, cum = self.tables([names[i] for i in here.tolist()])
            n, top = len(some), cum.shape[2]
            going, rest = _along(cum, row, masks[some], m)
            starts, piece, log = np.zeros((n, m), bool), np.zeros((n, m), np.int32), np.zeros(n)
            line, place, seed, on = np.arange(n), np.zeros(n, np.int64), seeds[some], np.ones(n, bool)
            if m > LONGEST:  # a unit has 63 numbers of the row's stream: long ones begin their own
                seed = np.array([xxhash.xxh64_intdigest(int(x).to_bytes(8, "little")) for x in seed], np.uint64)
            lengths = np.arange(top)
            while len(line):
                c = cum[row, place]
                d = np.where(on, rest[line, place], 0.0)
                star = going[line, place] - 1
                u = uniform(seed, place) * (1 - d)
                length = (c < u[:, None]).sum(1)  # as if nothing were barred
                past = np.flatnonzero(on & (length >= star))
                if len(past):  # from the barred way's piece on, its rest is off
                    length[past] = (c[past] - d[past, None] * (lengths >= star[past, None]) < u[past, None]).sum(1)
                np.minimum(length, np.minimum(top, m - place) - 1, out=length)
                x = np.arange(len(line))
                p = c[x, length]
                p -= np.where(length > 0, c[x, length - 1], 0.0)
                with np.errstate(divide="ignore"):
                    log[line] += np.log(p)
                starts[line, place] = True
                piece[line, place] = ids[row, place, length]
                on = on & (length == star)
                place = place + length + 1
                left = np.flatnonzero(place < m)
                line, row, place, seed, on = line[left], row[left], place[left], seed[left], on[left]
            out.add(some, starts, piece, log)
        return out.walks()

    def exact(self, unit: str) -> Exact:
        """The unit's lattice in whole numbers."""
        _, ids = self.pieces([unit])
        m, top, _ = ids.shape
        step: list[list[int]] = []
        for s in range(m):
            row = []
            for x in range(min(top, m - s)):
                i = int(ids[s, x, 0])
                w = 0.0 if i == -1 else self.weight[i] if i >= 0 else self.byte_weight ** len(unit[s].encode())
                row.append(int(w * 2.0**EXACT) << (EXACT * x) if w else 0)
            step.append(row)
        return Exact(step, ids[:, :, 0])

    def walk_besides(self, unit: str, masks: list[int], seed: int) -> tuple[Walks, float]:
        """A segmentation of one unit drawn from all but those of the masks, and the logarithm of what is left beside it and them.

        There must be one left.
        """
        x = self.exact(unit)
        m, s, mask, mass, tokens = len(unit), 0, 0, 1, []
        barred = [(b, x.mass(b)) for b in masks]
        while s < m:
            mask |= 1 << s
            weight = [max(0, mass * w * x.below[s + j + 1] - sum(q for b, q in barred if _starts(b, mask, s + j + 1, m))) for j, w in enumerate(x.step[s])]
            left, length = int(uniform_one(seed, s) * (1 << 53)) * sum(weight), -1
            for j, v in enumerate(weight):
                left -= v << 53
                if v and (left < 0 or not any(weight[j + 1 :])):
                    length = j
                    break
            mass *= x.step[s][length]
            piece = int(x.ids[s, length])
            tokens += [piece] if piece >= 0 else self.spelled(unit[s])
            s += length + 1
        rest = x.below[0] - mass - sum(q for _, q in barred)
        w = Walks(np.array(tokens, self.dtype), np.zeros(1, np.int64), np.array([len(tokens)]), np.array([_log(mass) - _log(x.below[0])]), np.array([mask], object))
        return w, _log(rest) - _log(x.below[0]) if rest > 0 else -math.inf

    def left(self, unit: str, masks: list[int]) -> float:
        """The logarithm of the probability of all segmentations but these; none: minus infinity."""
        x = self.exact(unit)
        rest = x.below[0] - sum(map(x.mass, masks))
        return _log(rest) - _log(x.below[0]) if rest > 0 else -math.inf

    def spelled(self, char: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in char.encode()] if self.bytes else [self.unknown]


def _log(n: int) -> float:
    return math.log(n) if n.bit_length() < 1000 else math.log(n >> (n.bit_length() - 900)) + (n.bit_length() - 900) * math.log(2)


class Exact:
    """A unit's lattice in whole numbers: step[place][length - 1] of the pieces, below[place]: the mass of all ways on from there.

    Every way through the unit has the same power of two as a factor, EXACT binary places for each character.
    """

    def __init__(self, step: list[list[int]], ids: np.ndarray):
        self.step, self.ids = step, ids
        m = len(step)
        self.below = [0] * m + [1]
        for s in range(m - 1, -1, -1):
            self.below[s] = sum(w * self.below[s + j + 1] for j, w in enumerate(step[s]))

    def mass(self, mask: int) -> int:
        """Of one segmentation."""
        m = len(self.step)
        starts, out = [i for i in range(m) if mask >> i & 1], 1
        for a, b in zip(starts, [*starts[1:], m], strict=True):
            out *= self.step[a][b - a - 1]
        return out


def _starts(barred: int, mask: int, end: int, m: int) -> bool:
    """Whether the barred segmentation starts with the pieces of mask, the last of which ends at ``end``."""
    below = (1 << end) - 1
    return barred & below == mask & below and (end == m or barred >> end & 1 == 1)


def _along(cum: np.ndarray, row: np.ndarray, masks: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """By row and place on the way along a row's mask: the length of its piece there, and the probability of its rest."""
    n = len(row)
    length, rest = np.zeros((n, m), np.int64), np.zeros((n, m + 1))
    rest[:, m] = 1.0
    end = np.full(n, m, np.int64)
    lines = np.arange(n)
    if m > LONGEST:
        bits = np.array([np.unpackbits(np.frombuffer(x.to_bytes(-(-m // 8), "little"), np.uint8), bitorder="little")[:m] for x in masks.tolist()], bool)
    else:
        masks = masks.astype(np.int64)
    for s in range(m - 1, -1, -1):
        x = lines[bits[:, s] if m > LONGEST else (masks >> s) & 1 == 1]
        size = end[x] - s
        c = cum[row[x], s].astype(np.float64)
        here = np.arange(len(x))
        p = c[here, size - 1] - np.where(size > 1, c[here, size - 2], 0.0)
        length[x, s], rest[x, s] = size, p * rest[x, end[x]]
        end[x] = s
    return length, rest


@dataclass
class Walks:
    """Segmentations of some units: their token ids, where each's begin and how many, its log-probability and its mask."""

    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    log: np.ndarray
    mask: np.ndarray


class _Parts:
    """Collects the segmentations of units of several lengths."""

    def __init__(self, lattice: Lattice, units: list[str], which: np.ndarray | None = None):
        """which: the unit of each segmentation, where it isn't one for each unit."""
        n = len(units) if which is None else len(which)
        self.lattice, self.units, self.which, self.used, self.ids = lattice, units, which, 0, [np.empty(0, lattice.dtype)]
        self.start, self.length, self.log, self.mask = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, object)

    def add(self, some: np.ndarray, starts: np.ndarray, piece: np.ndarray, log: np.ndarray) -> None:
        """starts[unit, place]: whether a piece starts there; piece[unit, place]: which."""
        unit, place = np.nonzero(starts)
        ids, count = piece[unit, place], np.ones(len(unit), np.int64)
        rare = np.flatnonzero(ids < 0)
        if len(rare):  # the bytes of characters that no piece holds
            own = some[unit[rare]] if self.which is None else self.which[some[unit[rare]]]
            spelled = [self.lattice.spelled(self.units[a][b]) for a, b in zip(own.tolist(), place[rare].tolist(), strict=True)]
            count[rare] = [len(x) for x in spelled]
            ids = np.repeat(ids, count)
            ids[ids < 0] = list(chain.from_iterable(spelled))
        length = np.bincount(unit, count, len(some)).astype(np.int64)
        self.length[some], self.start[some] = length, np.cumsum(length) - length + self.used
        self.log[some] = log
        if starts.shape[1] <= LONGEST:
            self.mask[some] = starts @ (np.int64(1) << np.arange(starts.shape[1]))
        else:
            self.mask[some] = np.array([int.from_bytes(x.tobytes(), "little") for x in np.packbits(starts, axis=1, bitorder="little")], object)
        self.ids.append(ids.astype(self.lattice.dtype))
        self.used += len(ids)

    def walks(self) -> Walks:
        return Walks(np.concatenate(self.ids), self.start, self.length, self.log, self.mask)


def _by_length(size: np.ndarray, block: int):
    """(length, numbers of units) for all lengths, a block at a time."""
    order = np.argsort(size, kind="stable")
    for m in np.unique(size).tolist():
        lo, hi = np.searchsorted(size[order], (m, m + 1)).tolist()
        step = block if m <= LONGEST else max(1, block * LONGEST // m)
        for at in range(lo, hi, step):
            yield m, order[at : min(at + step, hi)]


class Units:
    """The distinct units seen so far: the model's encoding of each, and its main segmentation, whose pieces are each the likeliest
    next one, with its log-probability. The lattice's tables are made anew where they are drawn from, and so take no room."""

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.text: list[str] = []
        self.whole, self.log, self.mask = np.zeros(1 << 12, bool), np.zeros(1 << 12), np.zeros(1 << 12, object)
        self.spare = np.zeros(1 << 12)  # the probability of all other segmentations together; 0 where there is none
        self.ids, self.main = FlatTable(lattice.dtype), FlatTable(lattice.dtype)

    def learn(self, units: list[str]) -> None:
        if not units:
            return
        n = len(self.text)
        self.whole, self.log, self.mask, self.spare = (grown(x, n + len(units)) for x in (self.whole, self.log, self.mask, self.spare))
        ids, whole = self.lattice.encode_units(units)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.lattice.dtype, int(length.sum()))
        self.ids.add(units, flat, np.cumsum(length) - length, length)
        self.whole[n : n + len(units)] = whole
        w, self.spare[n : n + len(units)] = self.lattice.main(units)
        self.main.add(units, w.ids, w.start, w.length, named=False)
        self.log[n : n + len(units)], self.mask[n : n + len(units)] = w.log, w.mask
        self.text += units


class Chunk:
    """Several texts, the numbers of their units, and the segmentations of units drawn for them besides the main ones.

    A unit's segmentation is known by a number: the unit's own for its main one, or one from ``base`` on for one drawn here.
    """

    def __init__(self, known: Units, texts: list[str], keys: list):
        self.known, self.lattice, self.keys, self.texts = known, known.lattice, keys, texts
        words: list[str] = []
        self.bounds, self.plain = [0], []
        for t in texts:
            normal = known.lattice.sp.normalize(t) if t else ""
            words += known.lattice.units_of(normal)
            self.bounds.append(len(words))
            self.plain.append(normal.replace("▁", " ")[1:] == t)
        self.kind = known.ids.found(words)
        new = np.flatnonzero(self.kind < 0).tolist()
        if new:
            fresh = [words[i] for i in new]
            known.learn(list(dict.fromkeys(fresh)))
            self.kind[new] = known.ids.numbered(fresh)
        known.ids.warm(words, self.kind)
        self.log = known.log[self.kind]
        self.spare = known.spare[self.kind]
        self.size = np.diff(self.bounds)
        self.within = np.arange(len(words)) - np.repeat(np.array(self.bounds[:-1], np.int64), self.size)
        self.base = len(known.text)
        self.drawn: list[Walks] = []
        self.count = 0

    def encoded(self) -> list[np.ndarray]:
        """The model's ids of each text, by unit; of texts with a unit for which that isn't plain to see, as a whole."""
        ids, first = self.known.ids.joined(self.kind)
        odd = np.concatenate([[0], np.cumsum(self.known.whole[self.kind])])
        out = []
        for t, a, b in zip(self.texts, self.bounds, self.bounds[1:], strict=False):
            out.append(ids[first[a] : first[b]] if odd[a] == odd[b] else np.array(self.lattice.sp.encode(t), self.lattice.dtype))
        return out

    def decoded(self, ids: list[np.ndarray]) -> list[bool]:
        """Whether the ids of each text give it back: by the bytes that they spell, or where these differ, by the library."""
        lattice = self.lattice
        raw, first = lattice.bytes_of.joined(np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64))
        ends = first[np.cumsum([0, *map(len, ids)])].tolist()
        return [plain and raw[a:b].tobytes() == (("▁" + t.replace(" ", "▁")) if t else "").encode() or lattice.sp.decode(x.tolist()) == t for t, x, plain, a, b in zip(self.texts, ids, self.plain, ends, ends[1:], strict=False)]

    def other(self, kinds: np.ndarray, seeds: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and log-probabilities of segmentations of these units, drawn from all but the given ones."""
        w = self.lattice.walk(self.known.text, kinds, seeds, masks)
        at = self.base + self.count + np.arange(len(kinds))
        self.drawn.append(w)
        self.count += len(kinds)
        return at, w.log

    def draws(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """k times, numbers and log-probabilities of an independent segmentation of every unit."""
        out, prob = [(self.kind.copy(), self.log.copy()) for _ in range(k)], 1.0 - self.spare
        step = self.within.astype(np.uint64) * (_GOLD << np.uint64(6))
        where, seeds = [], []
        for r in range(k):
            seed = np.repeat(np.array([row_seed(key, r) for key in self.keys], np.uint64), self.size) + step
            rare = np.flatnonzero((uniform(seed, 63) >= prob) & (self.spare > 0))
            where.append(rare)
            seeds.append(seed[rare])
        kinds = self.kind[np.concatenate(where)]
        if len(kinds):
            at, log = self.other(kinds, np.concatenate(seeds), self.known.mask[kinds])
            ends = np.cumsum([0, *map(len, where)]).tolist()
            for (number, logs), rare, x, y in zip(out, where, ends, ends[1:], strict=False):
                number[rare], logs[rare] = at[x:y], log[x:y]
        return out

    def masks(self, numbers: np.ndarray) -> np.ndarray:
        out = self.known.mask[np.minimum(numbers, self.base - 1)]
        new = numbers >= self.base
        if new.any():
            out[new] = np.concatenate([w.mask for w in self.drawn])[numbers[new] - self.base]
        return out

    def tokens(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """Token ids of runs of segmentations."""
        main = self.known.main
        table = FlatTable(main.flat.dtype)
        shift = main.used + np.cumsum([0, *(len(w.ids) for w in self.drawn)])
        table.start = np.concatenate([main.start[: self.base], *(w.start + x for w, x in zip(self.drawn, shift.tolist(), strict=False))])
        table.length = np.concatenate([main.length[: self.base], *(w.length for w in self.drawn)])
        table.flat = np.concatenate([main.flat[: main.used], *(w.ids for w in self.drawn)])
        table.used = len(table.flat)
        out, first = table.joined(np.concatenate([np.empty(0, np.int64), *numbers]))
        ends = first[np.cumsum([0, *map(len, numbers)])].tolist()
        return [out[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _bounds(log: np.ndarray, before: np.ndarray, top, u: np.ndarray, spare: np.ndarray, main: np.ndarray) -> np.ndarray:
    """Bounds of the siblings of some units' segmentations: Gumbels of their mass, below top. spare: the mass beside the main one."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        mass = before + np.where(main, np.log(spare), np.log1p(-np.minimum(np.exp(log), 1.0)))
        g = mass - np.log(np.exp(mass - top) - np.log(u))
    g[spare == 0] = -np.inf
    return g


def samples(chunk: Chunk, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text of a chunk: (ids, log-probability, inclusion score) of k distinct segmentations in the order drawn, of all
    where there are fewer; of a text without units, an empty one.

    The tree: a text's units in order, each with its segmentations. In each round every text opens the sibling subtree with the
    highest bound; the new leaf shares the path up to that unit, takes another segmentation of it, and draws the rest afresh.
    """
    n = len(chunk.keys)
    draws = chunk.draws(k)
    number, log = draws[0]
    lo, size = np.array(chunk.bounds[:-1], np.int64), chunk.size
    total = np.concatenate([[0.0], np.cumsum(log)])
    tops = np.array([-math.log(-math.log(uniform_one(row_seed(key, 1_000), 0))) for key in chunk.keys])
    u = uniform(np.repeat(np.array([row_seed(key, 2_000) for key in chunk.keys], np.uint64), size), chunk.within)
    bound = _bounds(log, total[:-1] - np.repeat(total[lo], size), np.repeat(tops, size), u, chunk.spare, number < chunk.base)
    cut = chunk.bounds
    paths = [[number[cut[i] : cut[i + 1]]] for i in range(n)]
    logs = [[log[cut[i] : cut[i + 1]]] for i in range(n)]
    frontier = [[bound[cut[i] : cut[i + 1]].copy()] for i in range(n)]
    barred: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(n)]  # (path, unit) -> masks that are taken

    def best(i: int) -> tuple[float, int, int]:
        at = [int(f.argmax()) for f in frontier[i]]
        r = max(range(len(at)), key=lambda x: frontier[i][x][at[x]])
        return float(frontier[i][r][at[r]]), r, at[r]

    for r in range(1, k):
        going = [(i, *best(i)) for i in range(n) if size[i] and len(paths[i]) == r]
        going = [g for g in going if g[1] > -math.inf]
        if not going:
            break
        fresh, fresh_log = draws[r]
        old = chunk.masks(np.array([paths[i][b][j] for i, _, b, j in going], np.int64))
        single, double = [], []
        for g, m in zip(going, old.tolist(), strict=True):
            i, _, b, j = g
            taken = barred[i].setdefault((b, j), [m])
            (single if len(taken) == 1 and chunk.spare[cut[i] + j] > SPARE else double).append((g, taken))
        picked: dict[int, tuple[int, float]] = {}
        beside: dict[int, float] = {}
        if single:
            kinds = np.array([chunk.kind[cut[i] + j] for (i, _, _, j), _ in single], np.int64)
            seeds = np.array([row_seed(chunk.keys[i], 3_000 + r) for (i, _, _, _), _ in single], np.uint64)
            at, ps = chunk.other(kinds, seeds, np.array([t[0] for _, t in single], object))
            picked |= {g[0]: (int(x), float(y)) for (g, _), x, y in zip(single, at, ps, strict=True)}
        for (i, _, _, j), taken in double:
            w, beside[i] = chunk.lattice.walk_besides(chunk.known.text[int(chunk.kind[cut[i] + j])], taken, row_seed(chunk.keys[i], 3_000 + r))
            picked[i] = (chunk.base + chunk.count, float(w.log[0]))
            chunk.drawn.append(w)
            chunk.count += 1
        new_masks = chunk.masks(np.array([picked[i][0] for i, _, _, _ in going], np.int64)).tolist()
        for (i, top, b, j), m in zip(going, new_masks, strict=True):
            taken = barred[i][b, j]
            if i not in beside:
                rest = 1.0 - math.exp(logs[i][b][j]) - math.exp(picked[i][1])
                beside[i] = math.log(rest) if rest > SPARE else chunk.lattice.left(chunk.known.text[int(chunk.kind[cut[i] + j])], [*taken, m])
            taken.append(m)
            x, p = picked[i]
            path = np.concatenate([paths[i][b][:j], [x], fresh[cut[i] + j + 1 : cut[i + 1]]])
            lg = np.concatenate([logs[i][b][:j], [p], fresh_log[cut[i] + j + 1 : cut[i + 1]]])
            before = np.cumsum(lg) - lg
            frontier[i][b][j] = -math.inf
            if beside[i] > -math.inf:
                mass = float(before[j]) + beside[i]
                frontier[i][b][j] = mass - math.log(math.exp(min(700.0, mass - top)) - math.log(uniform_one(row_seed(chunk.keys[i], 4_000 + r), j)))
            g = np.full(len(lg), -math.inf)
            g[j + 1 :] = _bounds(lg[j + 1 :], before[j + 1 :], top, uniform(row_seed(chunk.keys[i], 2_000 + r), np.arange(j + 1, len(lg))), chunk.spare[cut[i] + j + 1 : cut[i + 1]], path[j + 1 :] < chunk.base)
            paths[i].append(path), logs[i].append(lg), frontier[i].append(g)

    ids = iter(chunk.tokens([p for some in paths for p in some]))
    out = []
    for i in range(n):
        if not size[i]:
            next(ids)
            out.append([(np.empty(0, chunk.lattice.dtype), 0.0, 1.0)])
            continue
        left = best(i)[0]
        row = []
        for lg in logs[i]:
            p = float(lg.sum())
            row.append((next(ids), p, 1.0 if left == -math.inf else -math.expm1(-math.exp(min(50.0, p - left)))))
        out.append(row)
    return out


def units(path: str, cached: int = 700_000) -> Units:
    """The worker's units of a model; begun anew when there are many."""
    cache = worker_cache("pieces")
    if path not in cache:
        cache[path] = Units(Lattice(path))
    elif len(cache[path].text) > cached:
        cache[path] = Units(cache[path].lattice)
    return cache[path]


def encode(docs: DataFrame, model: str, k: int = 2, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, packed: bool = False, chunk: int = 5_000_000, cached: int = 700_000, release: bool = False) -> DataFrame:
    """The columns ``keep`` (all by default) with ids, decoded and samples for every document.

    ids: the model's encoding of the whole text; decoded: whether ids give the text back; samples: up to k distinct
    segmentations as (ids, log_prob, inclusion), of all where the lattice has fewer. Ids are arrays, or with ``packed``
    little-endian binary of 2 bytes each (4 for large vocabularies). Null texts are empty and have one empty sample. Rows
    equal in key and text get equal samples. Whole texts of any length are encoded; an empty table gives an empty one. ``chunk`` characters are treated together and about ``cached`` units kept by a worker,
    0.5 GB in all as they are; ``release``: a task gives the worker's memory back at its end. Neither has a bearing on the
    results. Columns of docs with the names of new ones are replaced. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    kind = "binary" if packed else "array<int>"
    new = {"ids": kind, "decoded": "boolean", "samples": f"array<struct<ids: {kind}, log_prob: double, inclusion: double>>"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in names], *[c.alias(x) for c, x in zip((F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")), fresh(names, "k", "t"), strict=True)])
    n = len(names)
    arrow = pa.binary() if packed else pa.list_(pa.int32())
    struct = pa.struct([("ids", arrow), ("log_prob", pa.float64()), ("inclusion", pa.float64())])

    def run(batches):
        dtype = units(model, cached).lattice.dtype
        show = (lambda x: np.asarray(x, dtype).tobytes()) if packed else (lambda x: [int(v) for v in x])
        for batch in batches:
            column, keys = batch.column(n + 1), batch.column(n).to_pylist()
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and (not texts or size < chunk):
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                part = batch.slice(at, len(texts))
                c = Chunk(units(model, cached), texts, keys[at : at + len(texts)])
                ids = c.encoded()
                same = c.decoded(ids)
                some = [[(show(t), p, q) for t, p, q in row] for row in samples(c, k)]
                arrays = [pa.array([show(x) for x in ids], arrow), pa.array(same, pa.bool_()), pa.array([[dict(zip(("ids", "log_prob", "inclusion"), s, strict=True)) for s in row] for row in some], pa.list_(struct))]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(n)), *arrays], names=[*names, *new])
                at += len(texts)
                del c, ids, some, arrays
        if release:
            released("pieces")

    return source.mapInArrow(run, out_schema(docs, names, new))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text", packed: bool = False) -> DataFrame:
    """df with the text of its ids (an array, or packed binary); null ids: null."""
    ship(df.sparkSession)
    names = [c for c in df.columns if c != text]

    def run(batches):
        lat = units(model).lattice
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = part.column(len(names)).to_pylist()
                rows = [None if r is None else np.frombuffer(r, lat.dtype).tolist() if packed else r for r in rows]
                back = lat.sp.decode([r or [] for r in rows], num_threads=1)
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(names))), pa.array([None if r is None else b for r, b in zip(rows, back, strict=True)], pa.string())], names=[*names, text])

    return df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias(fresh(names, "ids")[0])).mapInArrow(run, out_schema(df, names, {text: "string"}))
