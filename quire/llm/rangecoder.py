"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Phrases. Up to PHRASES pairs of neighbours that are frequent in a frame become symbols of their own, so a block takes about
half as many coding steps. Below, an id stands for any symbol: an id or a phrase.

Coder. Symbols are cut into blocks of BLOCK. Every block starts from the same state and is coded by itself, so all
blocks of a frame are coded in lock step, one numpy lane each. Three predictions of the next id share the range of each
coding step, by weights that adapt in the block:
- order 2: the id last seen in the block after this pair, with a hit rate learnt for each length of its run of hits;
- order 1: the successors of the last id, with shares of 256; its weight is a hit rate learnt for each grade of how much
  of what follows the id they cover. The shares are part of the state that a block starts from;
- order 0: a class of ids from a distribution over at most CLASSES classes that moves toward every id coded, then the id
  among its class with equal shares, as a second step. Classes are ids of like frequency that prefer like texts.
The range coder has 64-bit low and range, emits 32-bit words, and shortens the range where it straddles a word instead of
carrying.

Format. A frame is one row (shard int, frame int, n_ids long, data binary) of a Parquet folder, so any store that Spark
writes will do. `data`, little endian: magic `QIDS3\0`, counts of documents and blocks uint32, bytes of the packed head
and of the phrases uint32; doc_id int64[], null flags uint8[] and ids of each document uint32[]; symbols, words and crc32
(of its ids) of each block uint32[]; the head (zlib: the state that blocks start from, see Start.packed); the phrases (see
Phrases.packed); the blocks' 32-bit words. Frames hold
whole documents; shards follow each other in ascending doc_id order.

Defined cases: null texts count as empty and have their end id; null doc_ids come first; rows that repeat a doc_id are
kept, in order of their text's hash; an empty table makes no frames and reads back as no rows. A block whose ids do not
match its checksum raises ValueError. A frame may hold any number of distinct ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import bpe as B
from quire.llm.common import arrow, shared_dir, table

BLOCK = 1024  # symbols
LANES = 8192
FRAME = 15 << 19  # ids of a frame
PHRASES = 1 << 14
OFTEN = 48  # times that a phrase must be seen in the frame
MAGIC = b"QIDS3\0"
GROUPS = 2  # of ids by the texts that they prefer
SEGMENT = 256  # ids that are grouped together when groups are found
CLASSES = 31
SHARE = 12  # bits of the shares of classes
WEIGHT = 10  # bits of the weights of the three predictions
SLOTS = 64  # of each block's order-2 table
AFTER = 256  # shares of an order-1 context
CONTEXTS = 8192  # with order-1 successors
SEEN = 6  # times that a successor must have been seen in the frame
RATE = 5  # of the classes' distribution
_U32, _LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)
_RATIO = np.array([0, *(-(-(1 << 32) // w) for w in range(1, (1 << WEIGHT) + 1))], np.int64)  # v * _RATIO[w] >> 32 is v // w


def _groups(dense: np.ndarray, n: int) -> np.ndarray:
    """The group of each id: segments are clustered by hashed histograms, an id goes where its share is largest."""
    segments = len(dense) // SEGMENT
    if segments < 64 * GROUPS:
        return np.zeros(n, np.int64)
    bins = (np.arange(n) * 40503 % 1021 & 255).take(dense[: segments * SEGMENT].reshape(segments, SEGMENT))
    hist = np.bincount((bins + 256 * np.arange(segments)[:, None]).reshape(-1), minlength=256 * segments).reshape(-1, 256).astype(np.float32)
    far = [0]  # first centres: segments that the others explain least
    while len(far) < GROUPS:
        far.append(int((hist @ np.log(hist[far] + 0.5).T).max(1).argmin()))
    centre = hist[far]
    for _ in range(6):
        owner = (hist @ np.log((centre + 0.5) / (centre + 0.5).sum(1, keepdims=True)).T).argmax(1)
        centre = np.stack([hist[owner == j].sum(0) for j in range(GROUPS)])
    by = np.repeat(owner, SEGMENT)
    counts = np.bincount(by * n + dense[: len(by)], minlength=GROUPS * n).reshape(GROUPS, n)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).argmax(0)


def _shares(counts: np.ndarray, of: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whole shares of `total` for the entries of each of n owners, in proportion to their counts, at least one each."""
    spare = total - np.bincount(of, minlength=n)
    whole = np.bincount(of, counts, n)
    out = 1 + np.floor(counts * (spare / np.maximum(whole, 1))[of]).astype(np.int64)
    left = total - np.bincount(of, out, n).astype(np.int64)
    order = np.lexsort((-counts, of))
    first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    out[first] += left[of[first]]
    return out


def _pairs(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs a * n + b of neighbours among numbers below n, ascending, and how often each occurs."""
    kind = np.uint32 if n <= 1 << 16 else np.int64
    x = x.astype(kind)
    found, times = np.unique(x[:-1] * kind(n) + x[1:], return_counts=True)
    return found.astype(np.int64), times


class Phrases:
    """Pairs a * base + b of ids, ascending; the k-th is the symbol base + k, and all ids are below base."""

    def __init__(self, base: int, pairs: np.ndarray):
        self.base, self.pairs = base, pairs

    @classmethod
    def fit(cls, ids: np.ndarray) -> Phrases:
        base = int(ids.max(initial=0)) + 1
        if len(ids) < 2 or base > 1 << 20:
            return cls(base, np.zeros(0, np.int64))
        found, times = _pairs(ids, base)
        good = np.flatnonzero(times >= OFTEN)
        pairs = found[good[np.argsort(times[good], kind="stable")[-PHRASES:]]]
        slots = np.zeros(1 << 17, np.int32)
        slots[cls._slot(pairs)] = np.arange(len(pairs))  # the more frequent one stays
        return cls(base, np.sort(pairs[slots[cls._slot(pairs)] == np.arange(len(pairs))]))

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(47)).astype(np.int64)

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """The symbols of ids: from left to right, two that are a phrase become one."""
        if not len(self.pairs):
            return ids
        slots = np.zeros(1 << 17, np.int32)
        slots[self._slot(self.pairs)] = np.arange(len(self.pairs))
        out, keep, step = ids.astype(np.int32), np.ones(len(ids), bool), 1 << 17
        hit, at = np.zeros(len(ids) - 1, bool), np.empty(len(ids) - 1, np.int32)
        for k in range(0, len(hit), step):
            pair = ids[k : k + step + 1].astype(np.int64)
            pair = pair[:-1] * self.base + pair[1:]
            at[k : k + step] = slots.take(self._slot(pair))
            hit[k : k + step] = self.pairs.take(at[k : k + step]) == pair
        i = np.arange(len(hit), dtype=np.int32)
        begin = hit.copy()
        begin[1:] &= ~hit[:-1]
        i -= np.maximum.accumulate(np.where(begin, i, 0))  # every other one of a run
        taken = np.flatnonzero(hit & (i & 1 == 0))
        out[taken] = self.base + at[taken]
        keep[taken + 1] = False
        return out[keep]

    def widths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        return 1 + (symbols >= self.base).astype(np.int64) if len(self.pairs) else np.ones(len(symbols), np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return symbols.astype(np.uint32)
        first, second = np.divmod(self.pairs, self.base)
        ends = np.cumsum(self.widths(symbols))
        two = np.flatnonzero(symbols >= self.base)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[ends - 1] = symbols
        which, ends = symbols[two] - self.base, ends[two]
        out[ends - 2], out[ends - 1] = first[which], second[which]
        return out

    def packed(self) -> bytes:
        """zlib of planes of 64-bit numbers: base, and the pairs' differences."""
        flat = np.concatenate([[self.base], np.diff(self.pairs, prepend=0)]).astype("<u8")
        return zlib.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T).tobytes(), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Phrases:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        flat = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<i8")
        return cls(int(flat[0]), np.cumsum(flat[1:]))


class Start:
    """The state that every block of a frame starts from. Ids are numbered from 0 in the order of their classes."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, shares: np.ndarray, contexts: np.ndarray, spans: np.ndarray, after: np.ndarray, parts: np.ndarray, grades: np.ndarray):
        self.names, self.sizes, self.shares, self.contexts, self.spans, self.after, self.parts, self.grades = names, sizes, shares, contexts, spans, after, parts, grades
        self.first = np.cumsum(sizes) - sizes
        self.cls = np.repeat(np.arange(len(sizes)), sizes).astype(np.int32)
        edges = np.concatenate(([0], np.cumsum(shares)))
        self.edges = np.full(CLASSES + 1, 1 << SHARE, np.int16)
        self.edges[: len(edges)] = edges
        k = len(sizes)
        steps = np.arange(CLASSES + 1)
        # where the distribution moves when class c is coded: all but a little for c, none of the others lost
        room = (1 << SHARE) - 2 * k
        goal = np.where(steps[None] > np.arange(max(k, 1))[:, None], room, 0) + 2 * np.minimum(steps, k)[None]
        self.goal = goal.astype(np.int16)
        self.row = np.full(max(1, len(names)), -1, np.int32)
        self.row[contexts] = np.arange(len(contexts))
        self.grade = np.zeros(max(1, len(names)), np.int32)
        self.grade[contexts] = grades
        ends = np.cumsum(parts)
        owner = np.repeat(np.arange(len(spans)), spans)
        base = np.cumsum(np.concatenate(([0], spans)))[:-1]
        self.begin = (ends - parts - owner * AFTER).astype(np.int32)  # of each successor among its context's shares
        self.part, self.next = parts.astype(np.int32), after.astype(np.int32)
        self.slot = np.repeat(np.arange(len(after), dtype=np.int32), parts)  # by context * AFTER + share
        self.owner, self.base = owner, base

    @classmethod
    def fit(cls, ids: np.ndarray) -> tuple[Start, np.ndarray]:
        """The state for these ids, and the ids in its numbers."""
        if not len(ids):
            return cls(*(np.zeros(0, np.int64) for _ in range(8))), np.zeros(0, np.int32)
        if int(ids.max()) < 1 << 22:  # ids of a vocabulary, counted in place
            counts = np.bincount(ids)
            names = np.flatnonzero(counts)
            number = np.zeros(len(counts), np.int64)
            number[names] = np.arange(len(names))
            counts, dense = counts[names], number.take(ids)
        else:
            names, dense, counts = np.unique(ids, return_inverse=True, return_counts=True)
        group = _groups(dense, len(names))
        band = np.minimum(np.log2(len(ids) / counts).astype(np.int64), CLASSES // GROUPS - 1)
        kind = group * (CLASSES // GROUPS) + band
        order = np.lexsort((names, kind))
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        names, counts, kind, dense = names[order], counts[order], kind[order], place[dense]
        cut = np.flatnonzero(np.diff(kind, prepend=-1))
        sizes = np.diff(np.append(cut, len(kind)))
        weight = np.add.reduceat(counts, cut)
        shares = _shares(weight.astype(np.float64), np.zeros(len(cut), np.int64), 1, 1 << SHARE)

        n = len(names)
        pairs, times = _pairs(dense, n) if len(dense) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        of, after = np.divmod(pairs, n)
        total = np.bincount(of, times, n)
        good = (times >= SEEN) & (times * 1.5 * AFTER >= total[of])
        of, after, times = of[good], after[good], times[good]
        covered = np.bincount(of, times, n)
        contexts = np.sort(np.argsort(-covered, kind="stable")[: min(CONTEXTS, int((covered > 0).sum()))])
        row = np.full(n, -1, np.int64)
        row[contexts] = np.arange(len(contexts))
        rank = np.empty(len(of), np.int64)  # at most half as many successors as shares
        by = np.lexsort((-times, of))
        rank[by] = np.arange(len(of)) - np.searchsorted(of[by], of[by])
        keep = (row[of] >= 0) & (rank < AFTER // 2)
        of, after, times = row[of[keep]], after[keep], times[keep]
        spans = np.bincount(of, minlength=len(contexts))
        parts = _shares(times.astype(np.float64), of, len(contexts), AFTER) if len(of) else np.zeros(0, np.int64)
        held = np.bincount(of, times, len(contexts)) / np.maximum(total[contexts], 1)
        grades = 1 + np.minimum((held * 15).astype(np.int64), 14)
        return cls(names, sizes, shares, contexts, spans, after, parts, grades), dense.astype(np.int32)

    def packed(self) -> bytes:
        """zlib of planes of 32-bit numbers: how many of each, then the ids (differences inside a class), class sizes and
        shares, contexts (differences), their numbers of successors, successors (differences inside a context), their
        shares, and grades."""
        steps = lambda x, starts: np.where(np.isin(np.arange(len(x)), starts), x, np.diff(x, prepend=0)) if len(x) else x
        arrays = [steps(self.names.astype(np.int64), self.first), self.sizes, self.shares, np.diff(self.contexts, prepend=0), self.spans, steps(self.after, self.base), self.parts, self.grades]
        flat = np.concatenate([np.array([len(x) for x in arrays]), *arrays]).astype("<u4")
        return zlib.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes(), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Start:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        flat = np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)
        names, sizes, shares, contexts, spans, after, parts, grades = np.split(flat[8:], np.cumsum(flat[:7]))

        def whole(steps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            total = np.cumsum(steps)
            starts = np.cumsum(lengths) - lengths
            return total - np.repeat(total[starts] - steps[starts], lengths) if len(steps) else steps

        return cls(whole(names, sizes), sizes, shares, np.cumsum(contexts), spans, whole(after, spans), parts, grades)

    def places(self, before: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Where ids stand among the successors of the ids before them, or -1."""
        n = max(1, len(self.names))
        keys = self.owner * n + self.next
        size = 1 << max(4, int(len(keys)).bit_length() + 1)
        hashed = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (size - 1)
        slots, rest, at = np.full(size, -1, np.int32), np.arange(len(keys), dtype=np.int32), hashed(keys)
        while len(rest):  # linear probing, all at once
            free = slots[at] < 0
            slots[at[free]] = rest[free]
            lost = slots[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & (size - 1)
        out = np.full(len(x), -1, np.int32)
        for k in range(0, len(x), 1 << 16):
            row = self.row.take(before[k : k + (1 << 16)])
            todo = np.flatnonzero(row >= 0)
            want = row.take(todo).astype(np.int64) * n + x[k : k + (1 << 16)].take(todo)
            at, todo = hashed(want), todo + k
            while len(todo):
                found = slots.take(at)
                hit = (keys.take(found, mode="clip") == want) & (found >= 0) if len(keys) else np.zeros(len(at), bool)
                out[todo[hit]] = found[hit]
                on = np.flatnonzero(~hit & (found >= 0))
                todo, want, at = todo.take(on), want.take(on), (at.take(on) + 1) & (size - 1)
        return out


class _Lanes:
    """The state of all lanes; the same calls in the same order make the same state in coder and decoder.

    An order-2 entry packs the id and, in the low 4 bits, how sure it is (0: empty)."""

    def __init__(self, lanes: int, start: Start):
        self.start = start
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
        self.two = np.zeros(lanes * SLOTS, np.int32)
        self.off, self.row = np.arange(lanes, dtype=np.int32) * SLOTS, np.arange(lanes, dtype=np.int32) * 16
        rates = np.concatenate(([0], 6000 + 3500 * np.arange(15))).astype(np.int32)  # of 2^16; bucket 0: no prediction
        self.hit2 = np.tile(rates, lanes)
        self.hit1 = np.tile(np.concatenate(([0], 1500 + 4200 * np.arange(15))).astype(np.int32), lanes)
        self.edges = np.tile(start.edges, (lanes, 1))
        self.flat = self.edges.reshape(-1)
        self.at = np.arange(lanes, dtype=np.int32) * (CLASSES + 1)

    def weigh(self, slot: np.ndarray, grade: np.ndarray) -> None:
        """The order-2 entries of this step, and the ends of the weights of order 2 and order 1."""
        self.slot = slot
        self.held = self.two.take(slot)
        self.k2, self.k1 = self.row + (self.held & 15), self.row + grade
        self.p2, self.p1 = self.hit2.take(self.k2), self.hit1.take(self.k1)
        self.w2 = self.p2 * 1000 >> 16
        self.w1 = self.w2 + (self.p1 * (1000 - self.w2) >> 16)

    def learn(self, x: np.ndarray, second: np.ndarray, first: np.ndarray) -> None:
        """Adapt to id x of every lane; whether order 2, or else order 1, has coded it."""
        sure = self.held & 15
        lower = np.where(sure > 4, self.held - (sure - (sure >> 1)), (x << 4) + 1)
        self.two[self.slot] = np.where(second, self.held + (sure < 15), lower)
        self.hit2[self.k2] = np.where(self.p2 > 0, np.maximum(self.p2 + (second * np.int32(65535) - self.p2 >> 4), 128), 0)
        asked = ~second & (self.w1 > self.w2)
        told = np.where(asked, first * np.int32(65535) - self.p1 >> 5, 0)
        self.hit1[self.k1] = np.where(self.p1 > 0, np.maximum(self.p1 + told, 256), 0)
        self.edges += self.start.goal.take(self.start.cls.take(x), 0) - self.edges >> RATE

    def narrow(self, lanes, low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set the range of lanes (None: all); those that must emit or take a word, and the words of a coder."""
        due = np.flatnonzero(span <= _LOW32)
        lo, sp = low[due], span[due]
        cut = (lo >> _U32) != ((lo + sp - np.uint64(1)) >> _U32)
        sp = np.where(cut, np.uint64(1 << 32) - (lo & _LOW32), sp)
        low[due], span[due] = lo << _U32, sp << _U32
        if lanes is None:
            self.low, self.span = low, span
            return due, lo >> _U32
        self.low[lanes], self.span[lanes] = low, span
        return lanes[due], lo >> _U32


_TOTAL = np.uint64(SHARE + WEIGHT)
_FINE = SHARE - 8  # bits from a share of AFTER to one of 2^SHARE


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.int32(40503) + b * np.int32(52711) >> 4) & np.int32(SLOTS - 1)


def _sizes(n: int) -> np.ndarray:
    return np.array([min(BLOCK, n - k) for k in range(0, n, BLOCK)], np.int64)


def encode_lanes(dense: np.ndarray, start: Start) -> list[np.ndarray]:
    """The words of each block of ids in the numbers of `start`."""
    sizes = _sizes(len(dense))
    n, steps = len(sizes), int(sizes[0])
    grid = np.zeros(n * BLOCK, np.int32)
    grid[: len(dense)] = dense
    grid = np.ascontiguousarray(grid.reshape(n, BLOCK).T)[:steps]
    zero = np.zeros((1, n), np.int32)
    a = np.concatenate((zero, grid[:-1]))
    b = np.concatenate((zero, a[:-1]))
    m = _Lanes(n, start)
    slots = _slots(a, b) + m.off
    grades = start.grade.take(a)
    places = start.places(a.reshape(-1), grid.reshape(-1)).reshape(grid.shape)
    kinds = start.cls.take(grid)
    out, pos, short = np.zeros((2 * BLOCK + 2, n), np.uint32), np.zeros(n, np.int64), int(sizes[-1])

    def put(due: np.ndarray, words: np.ndarray) -> None:
        if len(due):
            out[pos[due], due] = words
            pos[due] += 1

    for t in range(steps):
        x, place, kind = grid[t], places[t], kinds[t]
        m.weigh(slots[t], grades[t])
        w2, w1 = m.w2, m.w1
        second = ((m.held >> 4) == x) & (w2 > 0)
        held = place >= 0
        first = held & ~second & (w1 > w2)
        place = np.maximum(place, 0)
        k = m.at + kind
        lo, hi = m.flat.take(k).astype(np.int32), m.flat.take(k + 1).astype(np.int32)
        rest = (1 << WEIGHT) - w1
        begin, size = (w1 << SHARE) + lo * rest, (hi - lo) * rest
        i = np.flatnonzero(first)
        if len(i):
            p, share = place[i], w1[i] - w2[i]
            begin[i] = (w2[i] << SHARE) + (start.begin.take(p) << _FINE) * share
            size[i] = (start.part.take(p) << _FINE) * share
        begin, size = np.where(second, 0, begin), np.where(second, w2 << SHARE, size)
        if t >= short:  # the last block has ended
            begin[-1], size[-1] = 0, 1 << (SHARE + WEIGHT)
        r = m.span >> _TOTAL
        put(*m.narrow(None, m.low + begin.astype(np.uint64) * r, size.astype(np.uint64) * r))
        alone = ~(first | second)
        if t >= short:
            alone[-1] = False
        j = np.flatnonzero(alone)
        if len(j):
            c = kind[j]
            r = m.span[j] // start.sizes.take(c).astype(np.uint64)
            put(*m.narrow(j, m.low[j] + (x[j] - start.first.take(c)).astype(np.uint64) * r, r))
        m.learn(x, second, first)
    final = np.stack([(m.low >> _U32).astype(np.uint32), (m.low & _LOW32).astype(np.uint32)], 1)  # a point of what is left
    out = np.ascontiguousarray(out[: int(pos.max())].T)
    return [np.concatenate((out[i, : pos[i]], final[i])) for i in range(n)]


def decode_lanes(sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, start: Start) -> np.ndarray:
    """The ids of blocks of these sizes; `words` holds `counts` words of each, one block after another."""
    n, short, steps = len(sizes), int(sizes[-1]), int(sizes[0])
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    pos = np.cumsum(counts) - counts
    m = _Lanes(n, start)
    value = (words[pos] << _U32) | words[pos + 1]
    pos = pos + 2
    grid = np.zeros((steps, n), np.int32)
    a = b = np.zeros(n, np.int32)

    def take(due: np.ndarray, _) -> None:
        if len(due):
            value[due] = (value[due] << _U32) | words[np.minimum(pos[due], len(words) - 1)]
            pos[due] += 1

    for t in range(steps):
        m.weigh(_slots(a, b) + m.off, start.grade.take(a))
        w2, w1 = m.w2, m.w1
        r = m.span >> _TOTAL
        v = np.minimum((value - m.low) // r, np.uint64((1 << (SHARE + WEIGHT)) - 1)).astype(np.int64)
        e2, e1 = w2 << SHARE, w1 << SHARE
        second = v < e2
        first = ~second & (v < e1)
        alone = v >= e1
        if t >= short:
            second[-1] = first[-1] = alone[-1] = False
        x = np.where(second, m.held >> 4, 0)
        begin, size = np.zeros(n, np.int32), np.where(second, e2, 1 << (SHARE + WEIGHT))
        i = np.flatnonzero(first)
        if len(i):
            share = w1[i] - w2[i]
            p = start.slot.take(start.row.take(a[i]) * AFTER + ((v[i] - e2[i]) * _RATIO.take(share) >> 32 + _FINE))
            x[i] = start.next.take(p)
            begin[i] = e2[i] + (start.begin.take(p) << _FINE) * share
            size[i] = (start.part.take(p) << _FINE) * share
        j = np.flatnonzero(alone)
        if len(j):
            rest = (1 << WEIGHT) - w1[j]
            u = (v[j] - e1[j]) * _RATIO.take(rest) >> 32
            c = (m.edges[j, 1:] <= np.minimum(u, (1 << SHARE) - 1)[:, None]).sum(1)
            lo, hi = m.edges[j, c].astype(np.int32), m.edges[j, c + 1].astype(np.int32)
            begin[j], size[j] = e1[j] + lo * rest, (hi - lo) * rest
        take(*m.narrow(None, m.low + begin.astype(np.uint64) * r, size.astype(np.uint64) * r))
        if len(j):
            n_c = start.sizes.take(c)
            r = m.span[j] // n_c.astype(np.uint64)
            place = np.minimum((value[j] - m.low[j]) // r, (n_c - 1).astype(np.uint64))
            x[j] = start.first.take(c) + place.astype(np.int64)
            take(*m.narrow(j, m.low[j] + place * r, r))
        grid[t] = x
        m.learn(x, second, first)
        a, b = x, a
    return grid.T.reshape(-1)[: (n - 1) * steps + short]


# -- frames --------------------------------------------------------------------------------------------------------


def frame(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    phrases = Phrases.fit(ids)
    symbols = phrases.merge(ids)
    sizes = _sizes(len(symbols))
    crc = _crcs(ids, phrases.widths(symbols))
    start, dense = Start.fit(symbols)
    words = [w for k in range(0, len(dense), BLOCK * LANES) for w in encode_lanes(dense[k : k + BLOCK * LANES], start)]
    packed, pairs = start.packed(), phrases.packed()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    tables = [np.asarray(x, "<u4").tobytes() for x in (counts, sizes, [len(w) for w in words], crc)]
    return b"".join([_HEAD.pack(MAGIC, len(doc_ids), len(sizes), len(packed), len(pairs)), names, null, *tables, packed, pairs, *(w.astype("<u4").tobytes() for w in words)])


def _crcs(ids: np.ndarray, widths: np.ndarray) -> list[int]:
    """The crc32 of the ids of each block."""
    ends = np.append(np.cumsum(widths)[BLOCK - 1 :: BLOCK], len(ids))
    starts = np.concatenate(([0], ends[:-1]))
    return [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(starts, ends) if a < z]


_HEAD = struct.Struct("<6sIIII")


def unframe(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids of each, and all ids of a frame."""
    magic, docs, blocks, packed, pairs = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    at = _HEAD.size

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    names, null = read("<i8", docs), read("u1", docs)
    counts, sizes, lengths, crc = read("<u4", docs), read("<u4", blocks), read("<u4", blocks), read("<u4", blocks)
    start, phrases = Start.unpacked(read("u1", packed).tobytes()), Phrases.unpacked(read("u1", pairs).tobytes())
    words = read("<u4", int(lengths.sum()))
    ends, parts = np.cumsum(lengths, dtype=np.int64), [np.empty(0, np.int64)]
    for i in range(0, blocks, LANES):
        j = min(i + LANES, blocks)
        dense = decode_lanes(sizes[i:j].astype(np.int64), words[ends[i] - lengths[i] : ends[j - 1]], lengths[i:j].astype(np.int64), start)
        parts.append(start.names[dense])
    symbols = np.concatenate(parts)
    ids = phrases.expand(symbols)
    for i, told in enumerate(_crcs(ids, phrases.widths(symbols))):
        if told != crc[i]:
            raise ValueError(f"block {i}: its ids do not match its checksum")
    return [None if z else i for i, z in zip(names.tolist(), null)], counts.astype(np.int64), ids


def write_ids(df: DataFrame, path: str, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, `end_id` after each, and write frames in ascending id order."""
    ordered = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def frames(bpe, rows):
        shard, number = TaskContext.get().partitionId(), 0
        own, parts, sizes, total = [], [], [], 0

        def made():
            ids = np.concatenate(parts)
            return [[0], [shard], [number], [len(ids)], [frame(own, np.concatenate(sizes), ids)]]

        for names, ids, offs in rows:
            n = np.diff(offs)
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            own, parts, sizes, total = own + names, [*parts, out], [*sizes, n + 1], total + len(out)
            if total >= FRAME:
                yield made()
                own, parts, sizes, total, number = [], [], [], 0, number + 1
        if own:
            yield made()

    coded = B.encode(ordered, vocab, "doc_id", "text", then=frames, schema="shard int, frame int, n_ids long, data binary", piece=None)
    coded.drop("doc_id").write.option("compression", "none").option("parquet.block.size", str(8 << 20)).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, per document: doc_id, start (ids before it), n_tokens, ids (unsigned 32-bit, binary)."""
    return _read(spark, path, lambda ids: ids.tobytes(), "ids binary")


def _read(spark: SparkSession, path: str, value, column: str) -> DataFrame:
    files = spark.read.schema("shard int, frame int, n_ids long, data binary").parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "frame", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("frame_start"))
    starts = starts.join(shards, "shard").select("shard", "frame", (F.col("shard_start") + F.col("frame_start")).alias("base"))
    fields = B.pa_schema(f"shard int, frame int, doc_id long, at long, n_tokens long, {column}")

    def rows(batches):
        for b in batches:
            for shard, number, data in zip(b["shard"].to_pylist(), b["frame"].to_pylist(), b["data"]):
                names, counts, ids = unframe(data.as_buffer())
                ends = np.cumsum(counts)
                made = [value(ids[a:z]) for a, z in zip(ends - counts, ends)]
                columns = [[shard] * len(names), [number] * len(names), names, ends - counts, counts, made]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    docs = arrow(files, rows, f"shard int, frame int, doc_id long, at long, n_tokens long, {column}")
    name = column.split()[0]
    return docs.join(starts, ["shard", "frame"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", name)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents (id 2 after each) and read them back."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/quire-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return _read(spark, path, lambda ids: zlib.crc32(ids), "ids_crc32 long")
