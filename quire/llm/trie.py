"""A compact order-3 n-gram trie: Elias-Fano levels in one memory-mapped buffer, with quantised log probabilities.

Contexts v stand in ascending order. Monotone pointers lead from each to its successors w (order 2) and to the words u
before it; pointers of these contexts u v lead to their successors w (order 3). Entries of a range are stored plus the
last value of the range before, so a whole level ascends, and an entry is searched inside its context's range, relative
to that base: one select finds the entries with its high bits, and their low bits decide. Each successor has an 8-bit
code of its smoothed log10 probability, each context one of its backoff weight.
"""

from __future__ import annotations

import mmap

import numpy as np

WORDS = 8  # 64-bit words of a block that has its count of bits before
CHUNK = 1 << 15  # queries that are answered at once


def _ranks() -> np.ndarray:
    """The place of the r-th set bit of each byte."""
    out = np.zeros((256, 8), np.int64)
    for b in range(256):
        places = [i for i in range(8) if b >> i & 1]
        out[b, : len(places)] = places
    return out


_RANK = _ranks()


class EliasFano:
    """An ascending sequence in about 2 + log2(universe / n) bits an entry."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high.reshape(-1, WORDS)
        ones = np.bitwise_count(self.high).astype(np.int64).sum(1)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(ones)) * (64 * WORDS) - self.ones
        self.top = len(ones) * 64 * WORDS - int(ones.sum()) - 1  # the last zero

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        block = 64 * WORDS
        flags = np.zeros(-(-(n + (top >> bits) + 2) // block) * block, np.uint8)
        flags[(values >> bits) + np.arange(n)] = 1
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            rest = (values & ((1 << bits) - 1)).astype(np.uint64)
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, rest << off)
            over = off + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - off[over]))
        return n, bits, low, np.packbits(flags, bitorder="little").view(np.uint64)

    def _select(self, i: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        block = np.searchsorted(before, i, "right") - 1
        rest = i - before[block]
        words = self.high[block] ^ flip
        upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int16)
        word = (upto <= rest[:, None]).sum(1)
        rows = np.arange(len(i))
        rest = rest - np.where(word > 0, upto[rows, word - 1], 0)
        octets = words[rows, word].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), 1, dtype=np.int8)
        octet = (upto <= rest[:, None]).sum(1)
        rest = rest - np.where(octet > 0, upto[rows, octet - 1], 0)
        return (block * WORDS + word) * 64 + octet * 8 + _RANK[octets[rows, octet], rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        low = self.low[word] >> off
        low |= np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (low & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        parts = [i[k : k + CHUNK] for k in range(0, len(i), CHUNK)]
        out = [((self._select(p, self.ones, np.uint64(0)) - p) << self.bits) | self._low(p) for p in parts]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def search(self, target: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The successor of each target: the first index of [lo, hi) whose value is at least the target (or hi), and
        whether it is the target."""
        parts = [self._search(target[k : k + CHUNK], lo[k : k + CHUNK], hi[k : k + CHUNK]) for k in range(0, len(target), CHUNK)]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, bool)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, target: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket, low = np.minimum(target >> self.bits, self.top), target & ((1 << self.bits) - 1)
        stop = self._select(bucket, self.zeros, np.uint64(0xFFFFFFFFFFFFFFFF)) - bucket
        start = np.zeros_like(stop)
        some = bucket > 0
        start[some] = self._select(bucket[some] - 1, self.zeros, np.uint64(0xFFFFFFFFFFFFFFFF)) - bucket[some] + 1
        at, end = np.clip(start, lo, hi), np.clip(stop, lo, hi)
        last = end.copy()
        while True:
            open_ = np.flatnonzero(at < end)
            if not len(open_):
                break
            mid = (at[open_] + end[open_]) >> 1
            less = self._low(mid) < low[open_]
            at[open_] = np.where(less, mid + 1, at[open_])
            end[open_] = np.where(less, end[open_], mid)
        hit = at < last
        hit[hit] = self._low(at[hit]) == low[hit]
        return at, hit


def _rising(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """The values of ranges, each plus the last of the range before."""
    if not len(values):
        return values
    size = np.diff(pointers)
    last = np.where(size > 0, values[pointers[1:] - 1] + 1, 0)
    return values + 1 + np.repeat(np.cumsum(last) - last, size)


def _codes(logs: np.ndarray, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    if least is not None:
        lo, hi, logs = least, 0.0, np.clip(logs, least, 0.0)
    return np.linspace(lo, hi, 256), np.rint((logs - lo) * (255 / (hi - lo) if hi > lo else 0)).astype(np.uint8)


LEVELS, BOOKS = 7, 4
HEAD = 8 * 4 * LEVELS


class Trie:
    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 4 * LEVELS)
        self.buffer, at, levels = buffer, HEAD + 8 * 256 * BOOKS, []
        self.books = np.frombuffer(buffer, np.float64, 256 * BOOKS, HEAD).reshape(BOOKS, 256)
        for k in range(LEVELS):
            n, bits, low, high = (int(x) for x in head[4 * k : 4 * k + 4])
            levels.append(EliasFano(n, bits, np.frombuffer(buffer, np.uint64, low, at), np.frombuffer(buffer, np.uint64, high, at + 8 * low)))
            at += 8 * (low + high)
        self.contexts, self.to_words, self.words, self.to_before, self.before, self.to_third, self.third = levels
        self.codes = []
        for n in (self.contexts.n, self.words.n, self.before.n, self.third.n):
            self.codes.append(np.frombuffer(buffer, np.uint8, n, at))
            at += n

    @staticmethod
    def build(v: np.ndarray, weight: np.ndarray, pair: tuple, context: tuple, triple: tuple, least: float | None = None) -> Trie:
        """From contexts v (ascending) with log10 backoff weights; pairs (index of v, w, log10 P); contexts u v (index of
        v, u, log10 backoff weight); triples (index of the context u v, w, log10 P). All ascend."""
        ends = lambda of, n: np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int64)
        to_words, to_before, to_third = ends(pair[0], len(v)), ends(context[0], len(v)), ends(triple[0], len(context[0]))
        levels = [v, to_words, _rising(pair[1], to_words), to_before, _rising(context[1], to_before), to_third, _rising(triple[1], to_third)]
        coded = [_codes(x, least) for x in (weight, pair[2], context[2], triple[2])]
        parts = [EliasFano.parts(x.astype(np.int64)) for x in levels]
        head = np.array([x for n, bits, low, high in parts for x in (n, bits, len(low), len(high))], np.int64)
        data = b"".join([head.tobytes(), *(b.tobytes() for b, _ in coded), *(x.tobytes() for p in parts for x in p[2:]), *(c.tobytes() for _, c in coded)])
        mapped = mmap.mmap(-1, len(data))
        mapped[:] = data
        return Trie(mapped)

    @staticmethod
    def open(path: str) -> Trie:
        """A trie kept as a file, mapped read-only."""
        with open(path, "rb") as f:
            return Trie(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(bytes(self.buffer))

    def value(self, kind: int, at: np.ndarray) -> np.ndarray:
        return self.books[kind][self.codes[kind][at]]

    def _range(self, pointers: EliasFano, level: EliasFano, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end of the ranges of these entries, and the base of their values."""
        lo, hi = pointers[at], pointers[at + 1]
        base = np.zeros(len(at), np.int64)
        some = lo > 0
        base[some] = level[lo[some] - 1]
        return lo, hi, base

    def _inside(self, pointers: EliasFano, level: EliasFano, owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of values in their owners' ranges, and whether they are held; owner -1: not held."""
        at, held = np.zeros(len(owner), np.int64), np.zeros(len(owner), bool)
        some = np.flatnonzero(owner >= 0)
        if len(some):
            own, of = np.unique(owner[some], return_inverse=True)
            lo, hi, base = self._range(pointers, level, own)
            at[some], held[some] = level.search(base[of] + value[some] + 1, lo[of], hi[of])
        return at, held

    def score(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """log10 P(w | u v) of n-grams in ascending order of (v, u); `unknown`: log10 P of the words alone."""
        own, of = _runs(v)
        n = self.contexts.n
        at, held = self.contexts.search(own, np.zeros(len(own), np.int64), np.full(len(own), n, np.int64))
        context = np.where(held, at, -1)[of]
        first = np.flatnonzero(_changes(v) | _changes(u))
        at, held = self._inside(self.to_before, self.before, context[first], u[first])
        spread = np.cumsum(_changes(v) | _changes(u)) - 1 if len(v) else np.empty(0, np.int64)
        both = np.where(held, at, -1)[spread]
        at, found = self._inside(self.to_third, self.third, both, w)
        out = np.zeros(len(v))
        out[found] = self.value(3, at[found])
        rest = np.flatnonzero(~found)
        at, held = self._inside(self.to_words, self.words, context[rest], w[rest])
        low = unknown[rest] + np.where(context[rest] >= 0, self.value(0, np.maximum(context[rest], 0)) if n else 0.0, 0.0)
        low[held] = self.value(1, at[held])
        seen = both[rest] >= 0
        low[seen] += self.value(2, both[rest][seen])
        out[rest] = low
        return out


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = _changes(x)
    return x[new], np.cumsum(new) - 1 if len(x) else np.empty(0, np.int64)
