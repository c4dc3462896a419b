"""BPE encoding and decoding by tree concatenation.

A text is halved, wherever that falls, down to leaves of at most STRETCH characters, and all leaves of many texts are
encoded side by side as if each were a whole text. At every join a window of pretokens around it, twice as wide each
time, is encoded again until its first and last pretokens are those that both sides have there. A pretoken depends on
what follows its start only, and but for the last one of a leaf none reaches the leaf's end; so agreement on both sides
proves that the joined ids are those of a run over the whole. Where the join stands beside white space no pretoken can
cross it and both sides agree at once. `Bpe.joins` counts joins of each kind.

The same is done inside an unsplit pretoken of more than LEAF symbols: halves are encoded, then windows of tokens around
the join, until both sides agree. A leaf's pretokens of up to 60 characters are encoded by the tokenizers library's
model, each distinct one once; looked up by hash, they are compared by their characters.

Texts longer than PIECE characters are dealt out: their pieces, cut beside white space, and the halves of pretokens of
more than PIECE characters, are encoded as rows of their own in parallel tasks and joined by document. Texts with
special tokens, combining marks or scripts outside the class table are cut at white space only.

Defined cases: a null text encodes as the empty text (no ids); a null or repeated doc_id keeps its row (rows are
told apart by their own key, not by doc_id); only the id and text columns are read, others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import KEPT, arrow, grouped, mix64, polynomial, slices, strings, table

LEAF = 256  # symbols of an unsplit pretoken that are merged in one run
STRETCH = 1024  # characters of a leaf of a text
PIECE = 1 << 16  # characters of a text that one task encodes at once
CACHE = 100_000  # entries of each chunk table in a worker
MEMO = 1_000_000  # distinct pretokens that a worker remembers


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


LETTER, NUMBER, OTHER, SPACES, ODD = range(5)


@functools.lru_cache(2)
def _classes(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Character classes up to U+FFFF, and lower-case letters. ODD: characters left to encode(), which are all those
    that a normal form may join to others or that Unicode versions may class otherwise."""
    kind, low = np.full(65536, ODD, np.uint8), np.arange(65536, dtype=np.uint32)
    for i in [*range(0x300), *range(0x370, 0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20B0)]:
        ch = chr(i)
        if unicodedata.category(ch) == "Cn" or unicodedata.combining(ch) or unicodedata.category(ch)[0] == "M" or not unicodedata.is_normalized("NFC", ch) or 0x1C <= i <= 0x1F or len(ch.lower()) > 1:
            continue
        kind[i] = LETTER if regex.match(r"\p{L}", ch) else NUMBER if regex.match(r"\p{N}", ch) else SPACES if ch.isspace() else OTHER
        if lower:
            low[i] = ord(ch.lower())
    return kind, low


class _Table(dict):
    """A bounded memo: what is missing is made, and a full table starts anew."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Bpe:
    """A tokenizers-library BPE file with a byte-level pretokenizer, with or without word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.words = bool(self.end)
        self.lower = bool(spec.get("normalizer"))
        self.joined = spec.get("decoder") is None
        self._lib = Tokenizer.from_file(path)
        self._model = self._lib.model
        quotes = r"'s|'t|'re|'ve|'m|'ll|'d"
        pattern = regex.compile(quotes + (r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.words else r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"))
        self._pretokens, self._matches = pattern.findall, pattern.finditer
        self.most = MEMO
        self.joins = {"beside white space": 0, "by a window": 0, "by wider windows": 0, "of long pretokens": 0}
        self._forget()
        self._spaced = None
        self._pre = _Table(self._pretoken)
        self._bare = _Table(self._chunk)
        self._space = _Table(lambda w: self._chunk(" " + w))
        self._line = _Table(lambda w: self._chunk("\n" + w), CACHE // 4)
        size = max(self.tokens) + 1
        self._bytes = [b""] * size
        back = {c: b for b, c in LETTERS.items()}
        for i, t in self.tokens.items():
            plain = self.joined or i in self.added.values()
            self._bytes[i] = t.encode() if plain else bytes(back[c] for c in t)
        self._base = [self._spell(t) if i not in self.added.values() else [] for i, t in sorted(self.tokens.items())] if len(self.tokens) == size else None

    # -- one pretoken ------------------------------------------------------------------------------------------

    def _spell(self, token: str) -> list[int]:
        """A token's first symbols."""
        end = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
        letters = list(token[: -len(self.end)] if end else token)
        if end:
            letters[-1] += self.end
        return [self.vocab[c] for c in letters if c in self.vocab]

    def symbols(self, mapped: str, closed: bool = True) -> list[int]:
        """The first symbols of byte-level letters; `closed`: the last one ends its word."""
        out = [self.vocab[c] for c in mapped]
        if self.end and closed and mapped:
            out[-1] = self.vocab[mapped[-1] + self.end]
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """One BPE run: always the pair of least rank, the leftmost of equals."""
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        ids, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := merges.get((ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (m[0], k, ids[k], ids[after[k]], m[1]))
        return [x for x in ids if x >= 0]

    def spelled(self, ids: list[int]) -> list[int]:
        return [s for i in ids for s in self._base[i]]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' text: wider windows until both sides agree."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.merge(self.spelled(a + b))
            if (len(left) <= k or window[0] == a[0]) and (len(right) <= k or window[-1] == b[-1]):
                return left[:-k] + window + right[k:]
            k *= 2

    def tree(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def mapped(self, pretoken: str) -> str:
        return pretoken.encode().decode("latin-1").translate(LETTERS)

    def _pretoken(self, pretoken: str) -> bytes:
        mapped = self.mapped(pretoken)
        if len(mapped) > 64:
            return np.array(self.tree(self.symbols(mapped)), "<u4").tobytes()
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    # -- chunks and texts --------------------------------------------------------------------------------------

    def pretokens(self, chunk: str) -> list[str]:
        """Normalised pretokens; letters outside the common Latin blocks take the library's own tables."""
        if self.lower:
            if chunk.isascii():
                chunk = chunk.lower()
            else:
                chunk = self._lib.normalizer.normalize_str(chunk)
        if chunk.isascii() or max(chunk) < "ɐ":
            return self._pretokens(chunk)
        back = {c: b for b, c in LETTERS.items()}
        return [bytes(back[c] for c in p).decode() for p, _ in self._lib.pre_tokenizer.pre_tokenize_str(chunk)]

    def _chunk(self, chunk: str) -> bytes:
        pre = self._pre
        if len(chunk) > 4096:  # not worth a place in the tables
            return b"".join([pre[p] if len(p) < 256 else self._pretoken(p) for p in self.pretokens(chunk)])
        return b"".join([pre[p] for p in self.pretokens(chunk)])

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if "<|" in text and (parts := list(self._added.finditer(text))):
            out, at = [], 0
            for m in parts:
                out += [self.encode(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self.encode(text[at:])])
        words = text.split()
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return self._chunk(text)  # white space for Python, not for the pattern
        if self.words:
            if len(words) == 1 and len(text) > 4096:
                return self._chunk(text)
            return b"".join(map(self._bare.__getitem__, words))
        breaks = text.count(" ") + text.count("\n")
        if len(words) != 1 + breaks or sum(map(len, words)) + breaks != len(text):
            return self._whole(text)  # runs, ends or other kinds of white space
        lines, out = text.split("\n"), []
        for k, line in enumerate(lines):
            head, *rest = line.split(" ")
            out.append((self._line if k else self._bare)[head])
            out += map(self._space.__getitem__, rest)
        return b"".join(out)

    _stretches = regex.compile(r"\s*\S+|\s+").findall

    def _whole(self, text: str) -> bytes:
        """Byte-level texts with runs of white space: cut only before a run, where one pattern match always ends."""
        return b"".join(map(self._bare.__getitem__, Bpe._stretches(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; special tokens stay. Without a decoder the tokens are joined by spaces."""
        tokens = map(self._bytes.__getitem__, array("I", ids))
        if self.joined:
            return b" ".join(tokens)
        data = b"".join(tokens)
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()

    # -- many texts at once ------------------------------------------------------------------------------------

    def encode_many(self, column, leaf: int | None = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column one after another, and each row's offsets.

        Pretoken bounds come from a table of character classes over whole buffers; each distinct pretoken is encoded
        once and kept in a bounded table. Texts with special tokens, combining marks or scripts outside the class
        table take encode() instead; without `leaf` texts are not halved. A row of more than 4 MB goes by pieces."""
        data, offs, _ = strings(column)
        found, sizes = [], []
        for _, _, part, po in slices(data, offs, 2 << 20):
            if len(po) == 2 and len(part) > 4 << 20:
                parts = self.pieces(part.tobytes().decode(), 1 << 20)
                whole = self.joined_pieces((c, f, z, self.piece(f, z, x) if c else self.encode_many(pa.array([x]), leaf)[0].tobytes()) for c, f, z, x in parts)
                ids = np.frombuffer(whole, np.uint32)
                n = np.array([len(ids)])
            else:
                ids, n = self._encode_slice(part, po, leaf)
            found.append(ids)
            sizes.append(n)
        ids = np.concatenate(found) if found else np.empty(0, np.uint32)
        return ids, np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else []))).astype(np.int64)

    def _encode_slice(self, data: np.ndarray, offs: np.ndarray, leaf: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(offs) - 1
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = offs if len(cp) == len(data) else np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
        kind, low = _classes(self.words and self.lower)
        c = kind[np.minimum(cp, 0xFFFF)]
        odd = np.flatnonzero(c == ODD)
        odd = np.concatenate((odd, np.flatnonzero((cp[:-1] == 60) & (cp[1:] == 124)))) if self.added else odd
        slow = np.unique(np.searchsorted(at, odd, "right") - 1)
        if self.lower:
            cp = low[np.minimum(cp, 0xFFFF)]
        edges, cuts = _leaves(at, leaf)
        start = self._starts(cp, c, edges)
        starts = np.flatnonzero(start)
        counts = np.zeros(n, np.int64)
        ids = np.empty(0, np.uint32)
        if len(starts):
            space = c == SPACES
            if self.words:
                size = np.add.reduceat((~space).astype(np.int32), starts)
            else:
                size = np.diff(np.append(starts, len(cp)))
            keys = mix64(polynomial(cp, starts, space if self.words else None, 1) + size.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
            u, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
            text = _Lazy(cp)
            spot, other = self._known(u, starts[where], size[where], cp, text)
            row = np.searchsorted(at, starts, "right") - 1
            new = {int(i): (int(i) + 1, self._pre[text.cut(starts[i], size[i])]) for i in np.flatnonzero(_differ(cp, starts, size, where[inverse]) | other[inverse])}
            if len(cuts):
                cuts = cuts[~np.isin(np.searchsorted(at, cuts, "right") - 1, slow)]
                self._join(cuts, c, at, row, starts, size, text, new)
            spot = spot[inverse]
            length, source = self._len[spot], self._at[spot]
            made = np.zeros(len(starts), bool)
            parts = []
            for i in sorted(new):
                j, blob = new[i]
                length[i:j] = 0
                length[i], made[i] = len(blob) // 4, True
                parts.append(blob)
            ends_at = np.cumsum(length)
            index = np.repeat(source - (ends_at - length), length) + np.arange(ends_at[-1])
            if parts:
                fresh = np.repeat(made, length)
                index[fresh] = 0
                ids = self._flat[index]
                ids[fresh] = np.frombuffer(b"".join(parts), np.uint32)
            else:
                ids = self._flat[index]
            counts = np.bincount(row, length, n).astype(np.int64)
        if len(slow):
            raw, bounds = data.tobytes(), np.concatenate(([0], np.cumsum(counts)))
            whole = [ids[bounds[i] : bounds[i + 1]] for i in range(n)]
            for i in slow:
                whole[i] = np.frombuffer(self.encode(raw[offs[i] : offs[i + 1]].decode()), np.uint32)
                counts[i] = len(whole[i])
            ids = np.concatenate(whole)
        return ids, counts

    def _starts(self, cp: np.ndarray, c: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pretokens start, each leaf being a text of its own."""
        first = np.zeros(len(cp) + 1, bool)
        first[edges] = True
        first = first[:-1]
        space = c == SPACES
        prev = np.empty_like(c)
        prev[1:], prev[:1] = c[:-1], ODD
        start = first | (c != prev)
        if self.words:
            start |= c == NUMBER
        else:
            nxt = np.empty_like(c)
            nxt[:-1], nxt[-1:] = c[1:], SPACES
            ends = np.zeros(len(cp), bool)
            ends[edges[edges > 0] - 1] = True
            ends[-1:] = True
            last = space & (nxt != SPACES) & ~ends
            start |= last
            held = np.zeros(len(cp), bool)
            held[1:] = last[:-1] & (cp[:-1] == 32)
            start &= ~held
        stops = np.append(edges, len(cp))
        for q in np.flatnonzero((cp == 39) & start & ~space):  # contractions
            stop = stops[np.searchsorted(stops, q, "right")]
            w = cp[q + 1 : min(q + 3, stop)].tolist()
            size = 2 if w and w[0] in (115, 116, 109, 100) else 3 if w in ([114, 101], [118, 101], [108, 108]) else 0
            if size:
                start[q + 1 : q + size] = False
                if q + size < stop:
                    start[q + size] = True
        return start & ~space if self.words else start

    def _join(self, cuts, c, at, row, starts, size, text, new: dict) -> None:
        """Join leaves at the cuts: `new` gets, by a window's first pretoken, the one after its last and its ids."""
        before, after = c[cuts - 1] == SPACES, c[cuts] == SPACES
        apart = before | after if self.words else after & ~before
        self.joins["beside white space"] += int(apart.sum())
        cuts = cuts[~apart]
        rows = np.searchsorted(at, cuts, "right") - 1
        first, stop = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
        taken, hard = 0, set()
        for q, r, r0, r1 in zip(np.searchsorted(starts, cuts).tolist(), rows.tolist(), first.tolist(), stop.tolist()):
            if r in hard:
                continue
            k = 1
            while True:
                a, b = max(q - k, r0), min(q + k, r1)
                if a < taken:
                    hard.add(r)
                    break
                begin = int(starts[a])
                piece = text.cut(begin, int(starts[b - 1] + size[b - 1]) - begin) if b > a else ""
                spans = [m.span() for m in self._matches(piece)]
                if (a == r0 or spans[0][1] == size[a]) and (b == r1 or spans[-1][0] == starts[b - 1] - begin):
                    pre = self._pre
                    new[a] = (b, b"".join([pre[piece[x:y]] for x, y in spans]))
                    taken = b
                    self.joins["by a window" if k == 1 else "by wider windows"] += 1
                    break
                k *= 2
        for r in hard:  # windows that meet: pretokens as long as leaves
            r0, r1 = (int(np.searchsorted(row, r, side)) for side in ("left", "right"))
            for i in [i for i in new if r0 <= i < r1]:
                del new[i]
            new[r0] = (r1, self._halves(text.cut(at[r], at[r + 1] - at[r])))

    def _halves(self, text: str) -> bytes:
        """The ids of a normalised text by halves, whatever the length of its pretokens."""

        def node(begin: int, end: int) -> list[tuple[int, int]]:
            if end - begin <= STRETCH:
                return [(begin + m.start(), begin + m.end()) for m in self._matches(text[begin:end])]
            half = (begin + end) // 2
            left, right = node(begin, half), node(half, end)
            k = 1
            while left and right:
                a, b = max(0, len(left) - k), min(k, len(right))
                base = left[a][0]
                window = [(base + m.start(), base + m.end()) for m in self._matches(text[base : right[b - 1][1]])]
                if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1][0] == right[b - 1][0]):
                    self.joins["of long pretokens"] += 1
                    return left[:a] + window + right[b:]
                k *= 2
            return left + right

        return b"".join([self._pre[text[a:b]] for a, b in node(0, len(text))])

    def _known(self, keys: np.ndarray, starts: np.ndarray, size: np.ndarray, cp: np.ndarray, text: _Lazy) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of distinct pretokens (sorted keys), new ones being encoded and added; and which of them
        hold other characters under the same key."""
        if len(self._keys) > self.most:
            self._forget()
        spot = np.searchsorted(self._keys, keys)
        held = self._keys[np.minimum(spot, len(self._keys) - 1)] == keys
        other = np.zeros(len(keys), bool)
        old, new = np.flatnonzero(held), np.flatnonzero(~held)
        if len(old):
            place, n = spot[old], size[old].astype(np.int64)
            other[old] = self._size[place] != n
            old, place, n = old[~other[old]], place[~other[old]], n[~other[old]]
            first = np.cumsum(n) - n
            steps = np.arange(int(n.sum()))
            same = self._letters[np.repeat(self._from[place] - first, n) + steps] == cp[np.repeat(starts[old] - first, n) + steps]
            other[old] = ~np.logical_and.reduceat(same, first) if len(first) else False
        if len(new):
            tokenize, end = self._model.tokenize, self._used
            made = []
            for a, k in zip(starts[new].tolist(), size[new].tolist()):
                p = text.cut(a, k)
                if k > 60:
                    made.append(array("I", self._pretoken(p)))
                else:
                    p = p.translate(LETTERS) if p.isascii() else self.mapped(p)
                    made.append([t.id for t in tokenize(p)])
            length = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter((i for m in made for i in m), np.uint32, int(length.sum()))
            n = size[new].astype(np.int64)
            first = np.cumsum(n) - n
            letters = cp[np.repeat(starts[new] - first, n) + np.arange(int(n.sum()))]
            self._flat = _room(self._flat, end, flat)
            self._letters = _room(self._letters, self._held, letters)
            self._keys = np.insert(self._keys, spot[new], keys[new])
            self._at = np.insert(self._at, spot[new], end + np.cumsum(length) - length)
            self._len = np.insert(self._len, spot[new], length)
            self._size = np.insert(self._size, spot[new], n)
            self._from = np.insert(self._from, spot[new], self._held + first)
            self._used += len(flat)
            self._held += len(letters)
            spot = np.searchsorted(self._keys, keys)
        return spot, other

    def _forget(self) -> None:
        self._keys = np.array([np.iinfo(np.uint64).max], np.uint64)
        self._at, self._len, self._size, self._from = np.zeros((4, 1), np.int64)
        self._flat, self._used = np.empty(1 << 16, np.uint32), 0
        self._letters, self._held = np.empty(1 << 16, np.uint32), 0

    def decode_many(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Each row's decoded text."""
        if not self.joined:
            return [self.decode(ids[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])]
        if self._spaced is None:
            size = np.array([len(b) + 1 for b in self._bytes], np.int64)
            self._spaced = np.frombuffer(b" ".join(self._bytes) + b" ", np.uint8), np.cumsum(size) - size, size
        text, at, size = self._spaced
        out = []
        for a in range(0, len(offs) - 1, 256):
            o = offs[a : a + 257]
            part = ids[o[0] : o[-1]]
            length = size[part]
            ends = np.cumsum(length)
            raw = text[np.repeat(at[part] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            stop = np.concatenate(([0], ends))[o - o[0]]
            out += [raw[x : max(x, y - 1)] for x, y in zip(stop[:-1], stop[1:])]
        return out

    # -- pieces of very long texts -----------------------------------------------------------------------------

    def pieces(self, text: str, most: int = PIECE) -> Iterator[tuple[bool, bool, bool, str]]:
        """(cut, first, last, text): stretches of text, or if `cut` byte-level letters of a part of a pretoken."""
        done = 0
        for m in self._added.finditer(text):
            yield from self._cut(text[done : m.start()], most)
            yield False, True, True, m[0]
            done = m.end()
        yield from self._cut(text[done:], most)

    def _cut(self, text: str, most: int) -> Iterator[tuple[bool, bool, bool, str]]:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > most:
                near = [m.start() for m in _CUT.finditer(text, max(at + 1, at + most - 4096), at + most)]
                m = None if near else _CUT.search(text, at + most)
                end = near[-1] if near else m.start() if m else len(text)
            stretch, at = text[at:end], end
            parts = self.pretokens(stretch) if len(stretch) > 2 * most else []
            if all(len(p) <= most for p in parts):
                yield False, True, True, stretch
                continue
            for mapped in map(self.mapped, parts):
                n = -(-len(mapped) // most)
                size = -(-len(mapped) // n)
                for k in range(n):
                    yield True, k == 0, k == n - 1, mapped[k * size : (k + 1) * size]

    def piece(self, first: bool, last: bool, text: str) -> bytes:
        return np.array(self.tree(self.symbols(text, last)), "<u4").tobytes()

    def joined_pieces(self, pieces: Iterable[tuple[bool, bool, bool, bytes]]) -> bytes:
        """Pieces in order, (cut, first, last, ids): halves of one pretoken are joined pairwise up the tree."""
        out, run = [], []
        for cut, _, last, ids in pieces:
            if not cut:
                out.append(ids)
                continue
            run.append(list(array("I", ids)))
            if last:
                while len(run) > 1:
                    run = [self.join(run[i], run[i + 1]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
                out.append(np.array(run[0], "<u4").tobytes())
                run = []
        return b"".join(out)


_CUT = regex.compile(r"(?<=\S)(?=[ \n])")


class _Lazy:
    """A buffer's text, decoded when it is first cut."""

    def __init__(self, cp: np.ndarray):
        self.cp, self.text = cp, None

    def cut(self, start: int, size: int) -> str:
        if self.text is None:
            self.text = self.cp.tobytes().decode("utf-32-le", "surrogatepass")
        return self.text[start : start + size]


def _leaves(at: np.ndarray, leaf: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all leaves of rows that start at `at`, and of those that begin no row: rows are halved until no part
    holds more than `leaf`."""
    if leaf is None:
        return at[:-1], np.empty(0, np.int64)
    size = np.diff(at)
    parts = 1 << np.ceil(np.log2(np.maximum(size / leaf, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(size)), parts)
    i = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    edges = at[row] + i * size[row] // parts[row]
    return edges, edges[i > 0]


def _differ(cp: np.ndarray, starts: np.ndarray, size: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which spans do not hold the characters of the span that they are taken for."""
    out = size[like] != size
    n = np.where(out, 0, size).astype(np.int32)
    first = np.cumsum(n, dtype=np.int32) - n
    at = np.repeat(starts.astype(np.int32) - first, n)
    at += np.arange(len(at), dtype=np.int32)
    unlike = cp.take(at) != cp.take(at + np.repeat((starts[like] - starts).astype(np.int32), n))
    if unlike.any():
        out[np.repeat(np.arange(len(n)), n)[unlike]] = True
    return out


def _room(flat: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """`flat` with `more` put in from `used` on, in twice the room when it is full."""
    while used + len(more) > len(flat):
        flat = np.concatenate((flat, np.empty_like(flat)))
    flat[used : used + len(more)] = more
    return flat


@functools.lru_cache(4)
def load(path: str) -> Bpe:
    """One table per worker process and file."""
    return Bpe(path)


KEPT.append(load.cache_clear)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", then=None, schema: str = "ids binary", piece: int | None = PIECE, leaf: int | None = None, memo: int = MEMO) -> DataFrame:
    """Encode every whole text: the id column and `ids` (little-endian unsigned 32-bit).

    `then(bpe, rows)` may make other columns of each partition's rows: from an iterator of (id values, all ids, each
    row's offsets) it yields lists of columns, the id first, as `schema` says. Texts of more than `piece` characters
    are encoded in pieces by other tasks and joined by document; with None all rows stay in place and order. With `leaf`
    texts are halved down to that many characters and joined (the dealt method); without, each text is one leaf. A worker
    remembers up to `memo` distinct pretokens."""
    then = then or _ids
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out_schema = f"id {kind}, {schema}"
    fields = pa_schema(out_schema)
    part_schema = f"key long, id {kind}, seq long, cut boolean, first boolean, last boolean"

    def made(bpe: Bpe, rows) -> Iterator[pa.RecordBatch]:
        for columns in then(bpe, rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    def in_place(batches):
        bpe = load(path)
        bpe.most = memo
        cut = (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024))
        yield from made(bpe, ((b["id"].to_pylist(), *bpe.encode_many(b["text"], leaf)) for b in cut))

    def cut_rows(batches):
        fields = pa_schema(part_schema + ", text string")
        for b in batches:
            bpe = load(path)
            for key, i, t in zip(b["key"].to_pylist(), b["id"].to_pylist(), b["text"].to_pylist()):
                for k, x in enumerate(bpe.pieces(t, piece)):
                    yield pa.RecordBatch.from_pylist([dict(zip(fields.names, (key, i, k, *x)))], schema=fields)

    def encode_pieces(batches):
        fields = pa_schema(part_schema + ", ids binary")
        for b in batches:
            bpe = load(path)
            ids = [bpe.piece(f, z, t) if c else bpe.encode_many(pa.array([t]), leaf)[0].tobytes() for c, f, z, t in zip(*(b[n].to_pylist() for n in ("cut", "first", "last", "text")))]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in fields.names[:-1]), pa.array(ids, pa.binary())], schema=fields)

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        ids = load(path).joined_pieces(list(zip(*(t[n].to_pylist() for n in ("cut", "first", "last", "ids")))))
        return pa.table([t["id"][:1], pa.array([ids], pa.binary())], names=["id", "ids"])

    def after(batches):
        for first in batches:  # without rows nothing is loaded
            yield from made(load(path), ((b["id"].to_pylist(), *_flat(b["ids"])) for b in chain([first], batches)))

    if piece is None:
        return arrow(base, in_place, out_schema, True).withColumnRenamed("id", id_col)
    plain = arrow(base.where(F.length("text") <= piece), in_place, out_schema, True)
    long = base.where(F.length("text") > piece).withColumn("key", F.monotonically_increasing_id())
    parts = arrow(long, cut_rows, part_schema + ", text string", True)
    dealt = arrow(parts.repartition(F.col("key"), F.col("seq")), encode_pieces, part_schema + ", ids binary", True)
    whole = arrow(grouped(dealt, ["key"], joined, f"id {kind}, ids binary", True), after, out_schema, True)
    return plain.unionByName(whole).withColumnRenamed("id", id_col)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, np.uint32) for x in column.to_pylist()]
    return np.concatenate([np.empty(0, np.uint32), *parts]), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)


def _ids(bpe: Bpe, rows):
    for own, ids, offs in rows:
        yield own, [ids[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])]


def pa_schema(ddl: str) -> pa.Schema:
    """A Spark schema string of plain types as Arrow fields."""
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of `documents`."""
    import public_tokenizers

    def digests(bpe: Bpe, rows):
        for own, ids, offs in rows:
            sha = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(offs[:-1], offs[1:])]
            yield own, np.diff(offs), sha, [hashlib.sha256(t).hexdigest() for t in bpe.decode_many(ids, offs)]

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), then=digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string", leaf=STRETCH)
