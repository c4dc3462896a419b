"""Packing token ids into windows by minimum bin slack.

A document of n ids fills n // WINDOW windows by itself; only the remainders (0 < r < WINDOW) are packed. Each window
starts with the longest remainder left; a subset-sum over a bitset of reachable fills, with counts of each length split
in powers of two, finds the multiset of remaining lengths that comes closest to the capacity, and backtracking over the
kept bitsets gives its counts. The same multiset is used again while its counts last. A partition's windows are solved
for GROUP tokens at a time, so memory is bounded and no task waits for others. A window that stays short of the
capacity by more than SLACK is cut into power-of-two sequences, which need no padding.

Defined cases: a null text is empty and still has its end id, so every document has a piece; repeated rows are packed
once each; an empty table gives no rows; columns other than the id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quire.llm import bpe as B
from quire.llm.common import table

WINDOW = 2048
GROUP = 8_000_000  # tokens whose remainders are packed together
SLACK = 32
MEMO = 400_000  # distinct pretokens that a worker remembers, beside a group's tokens


def best_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, count) of the multiset whose sum is the greatest up to `capacity`; long lengths are tried first."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> capacity:
            break
    fill, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> fill & 1:
            used[length] += k
            fill -= length * k
    return list(used.items())


def windows(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Groups of indices of `lengths` (each below the capacity), one group a window."""
    at: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        if lengths[i]:
            at[lengths[i]].append(i)
    counts, out = {k: len(v) for k, v in at.items()}, []

    def take(length: int, k: int) -> list[int]:
        counts[length] -= k
        if not counts[length]:
            del counts[length]
        return [at[length].pop() for _ in range(k)]

    while counts:
        longest = max(counts)
        counts[longest] -= 1
        fill = best_fill({k: v for k, v in counts.items() if v}, capacity - longest)
        counts[longest] += 1
        need = defaultdict(int, fill)
        need[longest] += 1
        for _ in range(min(counts[k] // v for k, v in need.items())):
            out.append([i for k, v in need.items() for i in take(k, v)])
    return out


def pack_rows(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts, and the number of
    sequences."""
    pieces, seq = [], 0
    for d, n in enumerate(counts.tolist()):
        for k in range(n // WINDOW):
            pieces.append((d, k * WINDOW, WINDOW, seq, 0))
            seq += 1
    rest = (counts % WINDOW).tolist()
    for group in windows(rest):
        total, at, room, offset = sum(rest[i] for i in group), 0, WINDOW, 0
        short = WINDOW - total > SLACK
        if short:
            room = 1 << (total.bit_length() - 1)
        for i in group:
            start, left = int(counts[i]) - rest[i], rest[i]
            while left:
                k = min(left, room - offset)
                pieces.append((i, start, k, seq, offset))
                start, left, offset, at = start + k, left - k, offset + k, at + k
                if offset == room and at < total:
                    seq, offset = seq + 1, 0
                    room = 1 << ((total - at).bit_length() - 1)
        seq += 1
    return np.array(pieces, np.int64).reshape(-1, 5), seq


def pack(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence id is the partition's number times 2^40 plus a count, so tasks need no agreement."""

    def pieces(bpe, rows):
        base, own, parts, sizes, total = TaskContext.get().partitionId() << 40, [], [], [], 0
        seq = 0

        def solved():
            nonlocal seq
            counts = np.concatenate(sizes)
            p, n = pack_rows(counts)
            begin = np.concatenate([np.cumsum(x) - x for x in sizes])[p[:, 0]] + p[:, 1]
            part = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])[p[:, 0]]
            data = [memoryview(x).cast("B") for x in parts]
            crc = [zlib.crc32(data[q][4 * a : 4 * (a + k)]) for q, a, k in zip(part.tolist(), begin.tolist(), p[:, 2].tolist())]
            seq += n
            return [[own[i] for i in p[:, 0].tolist()], p[:, 1], p[:, 2], crc, counts[p[:, 0]], base + seq - n + p[:, 3], p[:, 4]]

        for names, ids, offs in rows:
            n = np.diff(offs)
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            own += names
            parts.append(out)
            sizes.append(n + 1)
            total += len(out)
            if total >= GROUP:
                yield solved()
                own, parts, sizes, total = [], [], [], 0
        if own:
            yield solved()

    return B.encode(df, path, id_col, text_col, then=pieces, schema="start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", memo=MEMO)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Pack every document, id 1 at its end, into sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
