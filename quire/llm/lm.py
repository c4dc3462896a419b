"""Language-model scoring with a sharded Elias-Fano n-gram trie of order 3.

Model. Tokens are words and an end. P(w) is absolute discounting over the training tokens, the freed mass going to
unknown words. P(w | v) = (1 - g) c(v w) / c(v) + g P(w) and P(w | u v) = (1 - g) c(u v w) / c(u v) + g P(w | v), where
g = d / (d + c) and d = BACK * c^b estimates, as in Witten-Bell smoothing, the number of different successors of a
context of count c (b from the corpus's vocabulary growth, ln V / ln N). All training texts are counted; nothing is
pruned. Probabilities and weights are stored in 8 bits.

Counts are exact sums over the whole corpus, however it is cut: a text's score is the same for any size of batches, shards
and cells. Tokens of a frequent context v (about SPLIT tokens or more) are dealt to cells by the word u before it; those of
a pair u v of more than SPLIT tokens by the word w as well, and those of such a triple by the batch too. So no shard holds
much more than SPLIT tokens of one context. What a cell cannot sum by itself comes with its n-grams: c(v), c(v w), and c(u v)
and c(u v w) where they are over SPLIT.

Flow. No table of the model is broadcast or collected but lists of at most 2 * HOT words, HOT pairs and HOT triples:
1. Batches of texts become arrays of local word numbers (a stored table). A text of more than TOKENS words goes on in
   the next batch, with the two words before.
2. Frequent words are found (a list of bounded size, which all tasks get). Distinct words of each batch go to word shards,
   which return their counts and dense ids (small for frequent words). With each word go the frequent words before it, whose
   pairs are counted there; pairs of two frequent words go to shards of their own. Pairs and triples of more than SPLIT
   tokens are lists of bounded size as well.
3. Each batch scores the base, and sends its distinct n-grams, with the documents they occur in, to n-gram shards by
   their context v. Beyond FAN shards, parts for a group of shards are first merged over batches.
4. An n-gram shard sums its counts, builds its trie, looks up all its n-grams by successor search and returns sums by
   document.
5. A batch's parts are summed by document, and a text's batches by text.
What moves is packed. The number of shards follows the number of tokens, so that tasks stay of one size.

Defined cases: a null text is empty (one token, the end); ids may be null (never held out) or repeat; if nothing is left
to learn from, all probabilities are taken as of an empty corpus (N = V = 0) and the model's are those of an unknown
word, 1; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import pa_schema
from quire.llm.common import LOWER, arrow, grouped, id_bucket, mix64, portions, separated, slices, stored, strings, table, word_hashes
from quire.llm.trie import Trie

BATCH = 8 << 20  # bytes of text in a batch
TOKENS = 1 << 21  # words of one text in a batch
WORDS = 400_000  # distinct words of batches in a word shard
GRAMS = 1_200_000  # tokens in an n-gram shard
SPLIT = GRAMS // 8  # tokens of a context in one cell
HOT = 1 << 16  # a frequent word, pair or triple has more than this part of all tokens
PAIRS = 8 * GRAMS  # tokens for each shard of pairs of frequent words
FAN = 2048  # shards that a batch sends to
BUNDLE = 64  # batches that are merged on the way to more shards
CELL = 28  # bits of a cell's number
DISCOUNT = 0.75
BACK = 4.0
BACK_3 = 1.0
STEP = 1 << 16  # log10 probabilities are whole multiples of 1 / STEP, so sums do not depend on their order

_PACK = "batch long, rows binary, n_tokens long, n_words long, docs binary, stream binary, words binary, counts binary"


def _squash(x: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes, as many as the largest needs; high planes compress to nearly nothing."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + zlib.compress(planes, 1)


def _unsquash(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zlib.decompress(data[9:]), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<i8")


def _framed(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _unframed(data: bytes) -> list[bytes]:
    k = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, k, 8)
    ends = 8 * (k + 1) + np.cumsum(sizes)
    return [data[e - s : e] for s, e in zip(sizes, ends)]


def _rows(values: list[list], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields)], schema=fields)


def _each(batches):
    """One row after another."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


# -- batches of texts ------------------------------------------------------------------------------------------------


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and words of each text."""
    data, offs, _ = strings(column)
    found, sizes = [np.empty(0, np.uint64)], []
    for i, j, part, po in slices(data, offs):
        buf, bounds = separated(LOWER[part], po)
        h, starts, _ = word_hashes(buf)
        found.append(h)
        sizes.append(np.bincount(np.searchsorted(bounds, starts, "right") - 1, minlength=j - i))
    return np.concatenate(found), np.concatenate(sizes) if sizes else np.empty(0, np.int64)


def _batches(bytes_: int, most: int):
    """docs: of each text or part of one, its row's number, words, words that only lead it in, whether it ends here and
    whether it is learnt from; stream: local word numbers; words: hashes, in descending use; counts: of learnt words."""

    def run(batches):
        fields = pa_schema(_PACK)
        base, made, row = TaskContext.get().partitionId() << 32, 0, TaskContext.get().partitionId() << 36
        hashes, docs, ids, size = [], [], [], 0

        def packed():
            nonlocal made
            h, d = np.concatenate(hashes), np.concatenate(docs, 1)
            u, inverse, use = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-use, kind="stable")
            rank = np.empty(len(u), np.int64)
            rank[order] = np.arange(len(u))
            stream = rank[inverse]
            learnt = np.repeat(d[4] > 0, d[1])
            leads = np.flatnonzero(d[2])
            for k in range(2):
                learnt[(np.cumsum(d[1]) - d[1])[leads] + k] = False
            names = pa.concat_arrays(ids)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", names.type)])) as w:
                w.write_batch(pa.record_batch([names], names=["id"]))
            tokens = int((d[1] - d[2] + d[3]).sum())
            values = [base + made, zlib.compress(sink.getvalue(), 1), tokens, len(u), zlib.compress(d.astype(np.int64).tobytes(), 1), _squash(stream), u[order].tobytes(), _squash(np.bincount(stream[learnt], minlength=len(u)))]
            made += 1
            hashes.clear(), docs.clear(), ids.clear()
            return _rows([[v] for v in values], fields)

        for b in batches:
            for part in portions(b, "text"):
                h, n = _tokens(part["text"])
                trains = np.asarray(part["trains"]).astype(np.int64)
                begin = np.cumsum(n) - n
                for i, j in _uncut(n, most):
                    if n[i] > most:
                        for k in range(0, int(n[i]), most):
                            lead = 2 if k else 0
                            if hashes:
                                yield packed()
                            stop = min(k + most, int(n[i]))
                            hashes.append(h[begin[i] + k - lead : begin[i] + stop])
                            docs.append(np.array([[row + i], [stop - k + lead], [lead], [int(stop == n[i])], [trains[i]]]))
                            ids.append(part["id"][i : i + 1])
                            yield packed()
                        size = 0
                        continue
                    hashes.append(h[begin[i] : begin[j - 1] + n[j - 1]])
                    docs.append(np.stack([row + np.arange(i, j), n[i:j], np.zeros(j - i, np.int64), np.ones(j - i, np.int64), trains[i:j]]))
                    ids.append(part["id"][i:j])
                row += part.num_rows
                size += part["text"].nbytes
                if size >= bytes_ and hashes:
                    yield packed()
                    size = 0
        if hashes:
            yield packed()

    return run


def _uncut(n: np.ndarray, most: int):
    """Ranges of texts that go whole, and texts of more than `most` words alone."""
    at = 0
    for i in np.flatnonzero(n > most):
        if at < i:
            yield at, int(i)
        yield int(i), int(i) + 1
        at = int(i) + 1
    if at < len(n):
        yield at, len(n)


# -- words -----------------------------------------------------------------------------------------------------------


def _shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(x.view(np.uint64) ^ np.uint64(0x51ED270B)) % np.uint64(shards)).astype(np.int64)


def _walk(docs: bytes, stream: bytes, size: int) -> tuple:
    """Of each text: key, words that only lead it in, whether it is learnt from, tokens; of each token: itself, the two before
    it (nearest first), its text, whether it is scored. Number `size` is the end, `size` + 1 the start."""
    key, n, lead, last, trains = np.frombuffer(zlib.decompress(docs), np.int64).reshape(5, -1)
    words = _unsquash(stream).astype(np.int32)
    total = n + last
    first = np.cumsum(total) - total
    w = np.full(int(total.sum()), size, np.int32)
    w[np.arange(len(words)) + np.repeat(np.cumsum(last) - last, n)] = words
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], v[first] = w[:-1], size + 1
    u[1:], u[first] = v[:-1], size + 1
    doc = np.repeat(np.arange(len(n), dtype=np.int32), total)
    scored = np.ones(len(w), bool)
    for k in range(2):
        scored[first[lead > 0] + k] = False
    return key, lead, trains, total, w, v, u, doc, scored


def _ranks(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Places of a batch's words in the ascending list of frequent words, or -1; then those of the end and the start."""
    at = np.searchsorted(hot, words)
    held = at < len(hot)
    held[held] = hot[at[held]] == words[held]
    return np.concatenate((np.where(held, at, -1), [len(hot) + 1, len(hot)]))


def _hot_pairs(w: np.ndarray, v: np.ndarray, rank: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens whose context v is frequent, their distinct pairs (w * ranks + rank of v), and each token's pair."""
    hot = np.flatnonzero(rank[v] >= 0)
    return hot, *np.unique(w[hot].astype(np.int64) * ranks + rank[v[hot]], return_inverse=True)


def _dealt(pairs: np.ndarray, rank: np.ndarray, ranks: int, shard: np.ndarray, word_shards: int, pair_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in the order of the shards that count them, where each shard begins, and the ranks of both words (v * ranks +
    w, if w is frequent too). A pair is counted with its word w, unless w is frequent."""
    w, v = np.divmod(pairs, ranks)
    both = v * ranks + rank[w]
    to = np.where(rank[w] >= 0, word_shards + _shard_of(both, pair_shards), shard[w])
    order = np.lexsort((np.where(rank[w] >= 0, both, pairs), to))
    return order, np.searchsorted(to[order], np.arange(word_shards + pair_shards + 1)), both


def _frequent(packed: DataFrame, level: int, batches: int) -> np.ndarray:
    """Hashes of words, ascending: all of more than `level` learnt tokens, none of level / 2 or fewer."""
    least = max(1, level // (2 * max(1, batches)))

    def run(rows):
        fields = pa_schema("word long, n long")
        for x in _each(rows):
            h, c = np.frombuffer(x["words"], np.int64), _unsquash(x["counts"])
            yield _rows([h[c >= least], c[c >= least]], fields)

    summed = arrow(packed.select("words", "counts"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["word"] for r in summed.where(F.col("n") > level // 2).collect()], np.int64).view(np.uint64))


def _send_words(hot: np.ndarray, shards: int, pair_shards: int):
    ranks = len(hot) + 2

    def send(batches):
        fields = pa_schema("shard long, batch long, place binary, words binary, counts binary, pairs binary")
        for x in _each(batches):
            h, c, size = np.frombuffer(x["words"], np.uint64), _unsquash(x["counts"]), x["n_words"]
            _, _, trains, _, w, v, _, doc, scored = _walk(x["docs"], x["stream"], size)
            w, v, learnt = w[scored], v[scored], trains[doc[scored]]
            rank = _ranks(h, hot)
            at, pairs, of = _hot_pairs(w, v, rank, ranks)
            times = np.bincount(of, learnt[at], len(pairs)).astype(np.int64)
            shard = np.append(_shard_of(h, shards), [0, 0])
            deal, ends, both = _dealt(pairs, rank, ranks, shard, shards, pair_shards)
            word, before = np.divmod(pairs, ranks)
            each = np.bincount(word[rank[word] < 0], minlength=size)
            order = np.argsort(shard[:size], kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(cut)):
                i, k = order[cut[s] : cut[s + 1]], deal[ends[s] : ends[s + 1]]
                out.append([int(s), x["batch"], _squash(np.diff(i, prepend=0)), h[i].tobytes(), _squash(c[i]), _framed([_squash(each[i]), _squash(before[k]), _squash(times[k])])])
            for s in shards + np.flatnonzero(np.diff(ends[shards:])):
                k = deal[ends[s] : ends[s + 1]]
                out.append([int(s), x["batch"], b"", b"", b"", _framed([_squash(np.diff(both[k], prepend=0)), _squash(times[k])])])
            yield _rows([list(y) for y in zip(*out)] if out else [[]] * 6, fields)

    return send


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their summed counts, and of each part its keys' sums."""
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(inverse, np.concatenate(counts), len(u)).astype(np.int64)
    return u, c, np.split(c[inverse], np.cumsum([len(k) for k in keys])[:-1])


def _count_words(hot: np.ndarray, word_shards: int, level: int):
    def count(t: pa.Table) -> pa.Table:
        """Places, counts, numbers (by descending count), ranks and counts of pairs of a shard's words, or counts of a shard's
        pairs, back to the batches; sums for N and V; pairs of more than `level` tokens."""
        pairs = [[_unsquash(p) for p in _unframed(x)] for x in t["pairs"].to_pylist()]
        tokens, types, heavy = 0, 0, b""
        if t["shard"][0].as_py() < word_shards:
            h = [np.frombuffer(x, np.uint64) for x in t["words"].to_pylist()]
            u, inverse = np.unique(np.concatenate(h), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([_unsquash(x) for x in t["counts"].to_pylist()]), len(u)).astype(np.int64)
            number = np.empty(len(u), np.int64)
            number[np.argsort(-c, kind="stable")] = np.arange(len(u))
            rank = _ranks(u, hot) + 1
            parts = np.split(inverse, np.cumsum([len(x) for x in h])[:-1])
            _, _, times = _summed([np.repeat(i, n) * (len(hot) + 2) + v for i, (n, v, _) in zip(parts, pairs)], [n for _, _, n in pairs])
            told = [_framed([p, _squash(c[i]), _squash(number[i]), _squash(rank[i]), _squash(n)]) for p, i, n in zip(t["place"].to_pylist(), parts, times)]
            tokens, types = int(c.sum()), int((c > 0).sum())
        else:
            u, c, times = _summed([np.cumsum(k) for k, _ in pairs], [n for _, n in pairs])
            told = [_framed([_squash(n)]) for n in times]
            heavy = np.stack([u[c > level], c[c > level]], 1).tobytes()
        once = lambda x, none: [x, *[none] * (t.num_rows - 1)]
        return pa.table({"batch": t["batch"], "shard": t["shard"], "told": pa.array(told, pa.binary()), "tokens": pa.array(once(tokens, 0), pa.int64()), "types": pa.array(once(types, 0), pa.int64()), "heavy": pa.array(once(heavy, b""), pa.binary())})

    return count


def _counted(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of keys by a table of ascending keys and counts; 0: not in it."""
    if not len(table_):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table_[:, 0], keys), len(table_) - 1)
    return np.where(table_[at, 0] == keys, table_[at, 1], 0)


def _heavy(u: np.ndarray, v: np.ndarray, w: np.ndarray, pairs: np.ndarray, ranks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(u v) of tokens of these ranks where it is heavy, or 0; the tokens whose v w is heavy too, and their triples."""
    two = np.where((u >= 0) & (v >= 0), _counted(pairs, u * ranks + v), 0)
    some = np.flatnonzero((two > 0) & (w >= 0))
    some = some[_counted(pairs, v[some] * ranks + w[some]) > 0]
    return two, some, (u[some] * ranks + v[some]) * ranks + w[some]


def _heavy_triples(packed: DataFrame, hot: np.ndarray, pairs: np.ndarray, level: int) -> np.ndarray:
    """Triples of more than `level` learnt tokens, ascending, with their counts. Both their pairs are heavy."""
    ranks = len(hot) + 2
    if not len(np.intersect1d(pairs[:, 0] // ranks, pairs[:, 0] % ranks)):
        return np.zeros((0, 2), np.int64)

    def run(rows):
        fields = pa_schema("triple long, n long")
        for x in _each(rows):
            _, _, trains, _, w, v, u, doc, scored = _walk(x["docs"], x["stream"], x["n_words"])
            scored &= trains[doc] > 0
            rank = _ranks(np.frombuffer(x["words"], np.uint64), hot)
            yield _rows(list(np.unique(_heavy(rank[u[scored]], rank[v[scored]], rank[w[scored]], pairs, ranks)[2], return_counts=True)), fields)

    summed = arrow(packed.select("n_words", "docs", "stream", "words"), run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    return np.array(sorted(map(tuple, summed.where(F.col("n") > level).collect())), np.int64).reshape(-1, 2)


# -- n-grams ---------------------------------------------------------------------------------------------------------


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the entry before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def pack_grams(batches: list[int], context, word, count, before, joint, entries, own, doc, of_v=None, of_vw=None, of_uv=None, of_uvw=None) -> bytes:
    """Distinct n-grams, ascending by (context, word), in few bytes. By n-gram: context (word id, then CELL bits of a cell),
    word, code of the word's count, the word before the context, learnt occurrences, occurrences; by occurrence: the
    batch (of `batches`) and its document; by n-gram again: learnt occurrences in the corpus of the context (0: all are in
    its shard), of context and word, of the word before and the context, and of all three (0: all are in one shard)."""
    of_v, of_vw, of_uv, of_uvw = (np.zeros(len(context), np.int64) if x is None else x for x in (of_v, of_vw, of_uv, of_uvw))
    pair = np.flatnonzero(_new(context, word))
    of = context[pair]
    head = np.flatnonzero(_new(of))
    sizes = lambda starts, n: _squash(np.diff(np.append(starts, n)))
    return _framed([np.array(batches, np.int64).tobytes(), _squash(np.diff(of[head] >> CELL, prepend=0)), _squash(of[head] & ((1 << CELL) - 1)), sizes(head, len(pair)), _squash(word[pair]), _squash(count[pair]), sizes(pair, len(context)), *map(_squash, (before, joint, entries, own, doc)), _squash(of_v[pair][head]), _squash(of_vw[pair]), _squash(of_uv), _squash(of_uvw)])


def unpack_grams(data: bytes) -> tuple:
    names, *parts = _unframed(data)
    steps, cell, pairs, word, count, triples, before, joint, entries, own, doc, of_v, of_vw, of_uv, of_uvw = map(_unsquash, parts)
    context = np.repeat(np.repeat((np.cumsum(steps) << CELL) | cell, pairs), triples)
    return np.frombuffer(names, np.int64).tolist(), context, np.repeat(word, triples), np.repeat(count, triples), before, joint, entries, own, doc, np.repeat(np.repeat(of_v, pairs), triples), np.repeat(of_vw, triples), of_uv, of_uvw


def _logcode(c: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: exact below 2^15, then to 1 part in 1,300 on a logarithmic scale."""
    large = (1 << 15) + np.rint((np.log(np.maximum(c, 1 << 15)) - np.log(1 << 15)) * 1300)
    return np.where(c < 1 << 15, c, np.minimum(large, 65535)).astype(np.int64)


def _logvalue(code: np.ndarray) -> np.ndarray:
    x = code.astype(np.float64)
    return np.where(code < 1 << 15, x, np.exp((x - (1 << 15)) / 1300 + np.log(1 << 15)))


def _mod(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (mix64(x.astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)


def _cells(v: np.ndarray, u: np.ndarray, w: np.ndarray, uv: np.ndarray, uvw: np.ndarray, batch: int, split: int) -> np.ndarray:
    """Cells of tokens: by their words' ids u and w, and the counts of v, and of u v and u v w where they are over `split`."""
    cell = _mod(u, -(-v // split)) + 1
    two = np.flatnonzero(uv)
    cell[two] = (mix64(u[two].astype(np.uint64)) & np.uint64((1 << 62) - 1)).astype(np.int64) + _mod(w[two], -(-uv[two] // split))
    three = np.flatnonzero(uvw)
    cell[three] += _mod(np.full(len(three), batch), -(-uvw[three] // split)) << np.int64(32)
    return (mix64(cell.astype(np.uint64)) & np.uint64((1 << CELL) - 1)).astype(np.int64)


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of n > 0 values, each group by itself."""
    return np.add.reduceat(x, np.cumsum(n) - n) if len(n) else np.zeros(0)


def _send_grams(stats: dict, hot: int, heavy: np.ndarray, triples: np.ndarray, word_shards: int, pair_shards: int, shards: int, split: int):
    n_all, types, ends, ranks = stats["N"], stats["V"], stats["ends"], hot + 2
    fan = min(shards, FAN)

    def send(batches):
        fields = pa_schema("route long, batch long, data binary")
        for x in _each(batches):
            yield from one(x, fields)

    def one(x: dict, fields: pa.Schema):
        size = x["n_words"]
        c, ids, rank, shard = (np.zeros(size + 2, np.int64) for _ in range(4))  # then the end, and the start
        times = {}
        for r in x.pop("back"):
            *told, times[r["shard"]] = map(_unsquash, _unframed(r["told"]))
            if told:
                place, count, number, ranked = told
                place = np.cumsum(place)
                c[place], ids[place], rank[place], shard[place] = count, number * word_shards + r["shard"], ranked - 1, r["shard"]
        end, start = size, size + 1
        c[end] = c[start] = ends
        ids[:end] += 2
        ids[end], ids[start] = 0, 1
        rank[end], rank[start] = hot + 1, hot
        key, lead, trains, total, w, v, u, doc, scored = _walk(x["docs"], x["stream"], size)
        base = _sums(np.log10((c + 0.1) / (n_all + 0.1 * (types + 1)))[w] * scored, total)
        known = _sums(((c > 0)[w] & scored).astype(np.int64), total)
        told = zlib.compress(np.stack([key, total - lead, known, base.view(np.int64)]).tobytes(), 1)
        yield _rows([[-1 - x["batch"]], [x["batch"]], [told]], fields)

        if not scored.all():
            w, v, u, doc = w[scored], v[scored], u[scored], doc[scored]
        at, distinct, of = _hot_pairs(w, v, rank, ranks)
        deal, cut, _ = _dealt(distinct, rank, ranks, shard, word_shards, pair_shards)
        summed = np.empty(len(distinct), np.int64)
        for s in np.flatnonzero(np.diff(cut)):
            summed[deal[cut[s] : cut[s + 1]]] = times[int(s)]
        of_vw, of_uv, of_uvw = (np.zeros(len(w), np.int64) for _ in range(3))
        of_vw[at] = summed[of]
        a, b, z = v[at], u[at], w[at]
        two, some, triple = _heavy(rank[b], rank[a], rank[z], heavy, ranks)
        of_uv[at], of_uvw[at[some]] = two, _counted(triples, triple)
        cell = _cells(np.maximum(c[a], 1), ids[b], ids[z], two, of_uvw[at], x["batch"], split)
        split_, inverse = np.unique((a.astype(np.int64) << CELL) | cell, return_inverse=True)
        context = v.astype(np.int64)
        context[at] = size + 2 + inverse
        of_v = np.where(rank[v] >= 0, c[v], 0)
        named = np.concatenate((ids << CELL, (ids[split_ >> CELL] << CELL) | (split_ & ((1 << CELL) - 1))))
        route = _shard_of(named, shards) % fan
        order = np.lexsort((named, route))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        named, route = named[order], route[order]
        width = size + 2
        pairs, of = np.unique(place[context] * width + w, return_inverse=True)
        of *= width
        of += u
        order = np.argsort(of, kind="stable")
        of = of[order]
        at = np.flatnonzero(_new(of))
        pair, before = np.divmod(of[at], width)
        head, word = np.divmod(pairs[pair], width)
        entries = np.diff(np.append(at, len(of)))
        joint = np.add.reduceat(trains[doc[order]], at) if len(at) else np.empty(0, np.int64)
        given = [y[order[at]] for y in (of_v, of_vw, of_uv, of_uvw)]
        doc = doc[order]
        code = _logcode(c)
        cut = np.searchsorted(route[head], np.arange(fan + 1))
        for s in np.flatnonzero(np.diff(cut)):
            i = slice(cut[s], cut[s + 1])
            a, b = at[cut[s]], at[cut[s + 1]] if cut[s + 1] < len(at) else len(of)
            data = pack_grams([x["batch"]], named[head[i]], ids[word[i]], code[word[i]], ids[before[i]], joint[i], entries[i], np.zeros(b - a, np.int64), doc[a:b], *(y[i] for y in given))
            yield _rows([[int(s)], [x["batch"]], [data]], fields)

    return send


def _gathered(parts: list[bytes]) -> tuple[list[int], list[np.ndarray]]:
    """Several parts as one: their batches and columns."""
    names, columns, told = [], [], 0
    for data in parts:
        batches, *columns_ = unpack_grams(data)
        columns_[6] = columns_[6] + told
        told += len(batches)
        names += batches
        columns.append(columns_)
    return names, [np.concatenate(x) for x in zip(*columns)]


def _spread(entries: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The order of occurrences when n-grams take this order."""
    first = np.cumsum(entries) - entries
    n = entries[order]
    return np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _merge(shards: int, most: int = 32 << 20):
    """Parts for a group of shards, of several batches, as parts for single shards."""

    def run(batches):
        fields = pa_schema("route long, batch long, data binary")
        held: dict[int, list[bytes]] = {}
        size = 0

        def flush():
            for parts in held.values():
                names, (context, word, count, before, joint, entries, own, doc, *given) = _gathered(parts)
                shard = _shard_of(context, shards)
                order = np.lexsort((before, word, context, shard))
                tokens = _spread(entries, order)
                ends = np.concatenate(([0], np.cumsum(entries[order])))
                cut = np.flatnonzero(_new(shard[order]))
                for a, b in zip(cut, np.append(cut[1:], len(order))):
                    i, k = order[a:b], tokens[ends[a] : ends[b]]
                    data = pack_grams(names, context[i], word[i], count[i], before[i], joint[i], entries[i], own[k], doc[k], *(x[i] for x in given))
                    yield _rows([[int(shard[i[0]])], [names[0]], [data]], fields)
            held.clear()

        for x in _each(batches):
            if x["route"] < 0:
                yield _rows([[x["route"]], [x["batch"]], [x["data"]]], fields)
                continue
            held.setdefault(x["route"], []).append(x["data"])
            size += len(x["data"])
            if size > most:
                yield from flush()
                size = 0
        yield from flush()

    return run


def unigram(c: np.ndarray, stats: dict) -> np.ndarray:
    """P(w) of words of these counts; count 0 is the unknown word."""
    n, v = max(1, stats["N"]), stats["V"]
    return np.where(c > 0, (c - DISCOUNT) / n, DISCOUNT * v / n if v else 1.0)


def backoff(c: np.ndarray, stats: dict, back: float = BACK) -> np.ndarray:
    """g of contexts of these counts."""
    c = c.astype(np.float64)
    power = np.log(max(2, stats["V"])) / np.log(max(3, stats["N"]))
    d = back * c**power
    return np.where(c > 0, d / np.maximum(d + c, 1e-300), 1.0)


def build(context: np.ndarray, before: np.ndarray, word: np.ndarray, joint: np.ndarray, alone: np.ndarray, stats: dict, given: list[np.ndarray] | None = None) -> Trie:
    """The trie of n-grams in ascending order of (context, before, word), none twice, with learnt occurrences `joint`; alone: P
    of the words. `given`: learnt occurrences of the context, of context and word, and of the word before and the context;
    the first is 0 if the n-grams have all of the context and word, the last if they have all of the other two."""
    of_v, of_vw, of_uv = (np.zeros(len(context), np.int64) for _ in range(3)) if given is None else given
    sums = lambda x, at: np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64)
    either = lambda told, own: np.where(told > 0, told, own)
    by_pair = np.lexsort((before, word, context))
    first = np.flatnonzero(_new(context[by_pair], word[by_pair]))
    lead = by_pair[first]
    head = np.flatnonzero(_new(context))
    v = context[head]
    pair_v, pair_w = np.searchsorted(v, context[lead]), word[lead]
    c2 = np.where(of_v[lead] > 0, of_vw[lead], sums(joint[by_pair], first))
    c1 = either(of_v[head], np.bincount(pair_v, c2, len(v)))
    g1 = backoff(c1, stats)
    p2 = (1 - g1)[pair_v] * c2 / np.maximum(c1, 1)[pair_v] + g1[pair_v] * alone[lead]
    second = np.empty(len(context))  # P(w | v) of each triple
    second[by_pair] = np.repeat(p2, np.diff(np.append(first, len(context))))
    start = np.flatnonzero(_new(context, before))
    size = np.diff(np.append(start, len(context)))
    cuv = either(of_uv[start], sums(joint, start))
    g2 = backoff(cuv, stats, BACK_3)
    p3 = np.repeat(1 - g2, size) * joint / np.repeat(np.maximum(cuv, 1), size) + np.repeat(g2, size) * second
    in_v, in_pair, in_uv, in_all = c1 > 0, c2 > 0, cuv > 0, joint > 0  # only what is learnt is kept
    place = np.cumsum(in_v) - 1
    pairs = (place[pair_v[in_pair]], pair_w[in_pair], np.log10(p2[in_pair]))
    contexts = (place[np.searchsorted(v, context[start][in_uv])], before[start][in_uv], np.log10(g2[in_uv]))
    triples = (np.repeat(np.cumsum(in_uv) - 1, size)[in_all], word[in_all], np.log10(p3[in_all]))
    return Trie.build(v[in_v], np.log10(g1[in_v]), pairs, contexts, triples, -1 - np.log10(max(1, stats["N"])))


def _score_shard(stats: dict):
    def score(t: pa.Table) -> pa.Table:
        """A shard's trie, and the sums of log10 P by batch and document; a negative route only passes its row on."""
        if t["route"][0].as_py() < 0:
            return pa.table({"batch": t["batch"], "kind": pa.array([0] * t.num_rows, pa.int64()), "data": t["data"]})
        parts = t["data"].to_pylist()
        names, (context, word, count, before, joint, entries, own, doc, *given) = _gathered(parts)
        order = np.lexsort((word, before, context))
        context, word, before = context[order], word[order], before[order]
        new = _new(context, before, word)
        at = np.flatnonzero(new)
        context, word, before = context[at], word[at], before[at]
        total = np.add.reduceat(joint[order], at) if len(at) else np.empty(0, np.int64)
        alone = unigram(_logvalue(count[order][at]), stats)
        *given, all_ = (x[order][at] for x in given)
        trie = build(context, before, word, np.where(all_ > 0, all_, total), alone, stats, given)
        units = np.rint(np.maximum(-trie.score(context, before, word, np.log10(alone)), 0) * STEP)
        each = np.empty(len(order))
        each[order] = units[np.cumsum(new) - 1]
        each = np.repeat(each, entries)
        docs = np.bincount(own, minlength=len(names))
        by = np.argsort(own, kind="stable") if len(names) > 1 else slice(None)
        each, doc, at, out = each[by], doc[by], 0, []
        for n in docs:
            out.append(_squash(np.bincount(doc[at : at + n], each[at : at + n]).astype(np.int64)))
            at += n
        return pa.table({"batch": pa.array(names, pa.int64()), "kind": pa.array([1] * len(out), pa.int64()), "data": pa.array(out, pa.binary())})

    return score


def _finish(fields: pa.Schema):
    def finish(t: pa.Table) -> pa.Table:
        kinds, data = t["kind"].to_pylist(), t["data"].to_pylist()
        key, tokens, known, base = np.frombuffer(zlib.decompress(data[kinds.index(0)]), np.int64).reshape(4, -1)
        units = np.zeros(len(key), np.int64)
        for x in (x for k, x in zip(kinds, data) if k == 1):
            x = _unsquash(x)
            units[: len(x)] += x
        rows = next(x for x in t["rows"].to_pylist() if x is not None)
        ids = pa.ipc.open_stream(zlib.decompress(rows)).read_all()["id"].combine_chunks()
        values = [pa.array(key), ids, pa.array(tokens), pa.array(known), pa.array(base.copy().view(np.float64)), pa.array(-units / STEP)]
        return pa.table([v.cast(f.type) for v, f in zip(values, fields)], schema=fields)

    return finish


def score(df: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS, split: int = SPLIT, batch: int = BATCH, tokens: int = TOKENS) -> DataFrame:
    """Per row: the id column, n_tokens, n_known, train_tokens, base_score, score. `trains`: rows to learn from."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    packed = stored(arrow(rows, _batches(batch, tokens), _PACK))
    sizes = packed.agg(F.sum("n_tokens"), F.sum("n_words"), F.count("*")).first()
    word_shards, shards = max(1, -(-(sizes[1] or 0) // WORDS)), max(1, -(-(sizes[0] or 0) // grams))
    pair_shards, split = max(1, -(-(sizes[0] or 0) // PAIRS)), max(split, (sizes[0] or 0) // HOT)
    hot = _frequent(packed, split, sizes[2])
    fields = "shard long, batch long, place binary, words binary, counts binary, pairs binary"
    sent = arrow(packed.select("batch", "n_words", "docs", "stream", "words", "counts"), _send_words(hot, word_shards, pair_shards), fields)
    back = stored(grouped(sent, ["shard"], _count_words(hot, word_shards, split), "batch long, shard long, told binary, tokens long, types long, heavy binary"))
    sums = back.agg(F.sum("tokens"), F.sum("types")).first()
    ends = rows.where("trains").count()
    stats = {"N": (sums[0] or 0) + ends, "V": (sums[1] or 0) + (1 if ends else 0), "ends": ends}
    found = [np.frombuffer(r["heavy"], np.int64).reshape(-1, 2) for r in back.where("length(heavy) > 0").select("heavy").collect()]
    if ends > split:  # the start stands for both words before a text
        found.append(np.array([[len(hot) * (len(hot) + 3), ends]]))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    pairs = pairs[np.argsort(pairs[:, 0])]
    triples = _heavy_triples(packed, hot, pairs, split)
    met = packed.select("batch", "n_words", "docs", "stream").join(back.groupBy("batch").agg(F.collect_list(F.struct("shard", "told")).alias("back")), "batch", "left").withColumn("back", F.coalesce("back", F.array()))
    routed = arrow(met, _send_grams(stats, len(hot), pairs, triples, word_shards, pair_shards, shards, split), "route long, batch long, data binary")
    if shards > FAN:
        bundle = F.pmod(F.xxhash64("batch"), F.lit(-(-sizes[2] // BUNDLE)))
        routed = arrow(routed.repartition(F.col("route"), bundle), _merge(shards), "route long, batch long, data binary")
    scored = grouped(routed, ["route"], _score_shard(stats), "batch long, kind long, data binary")
    parts = scored.select("batch", "kind", "data", F.lit(None).cast("binary").alias("rows"))
    names = packed.select("batch", F.lit(2).cast("long").alias("kind"), F.lit(b"").alias("data"), "rows")
    schema = f"key long, id {kind}, n_tokens long, n_known long, base_score double, score double"
    told = grouped(parts.unionByName(names), ["batch"], _finish(pa_schema(schema)), schema)
    whole = told.groupBy("key").agg(F.first("id").alias(id_col), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select(id_col, "n_tokens", "n_known", F.lit(stats["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from those outside the held-out tenth."""
    docs = table(spark, sf_dir, "documents")
    held = id_bucket(F.col("doc_id"), 10) == 0
    out = score(docs, ~held)
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
