"""Near duplicates: SetSketch registers, banded; likelihood estimates; exact verification; connected components.

1. Each text gives the set of its five-word shingles (64-bit hashes; with fewer words one shingle of all). Texts of
   equal sets are one class, known by its size and two independent 64-bit sums of the set, whatever their doc_ids.
2. A class has REGISTERS registers: floor(1 - log_b of the least exponential hash), truncated minima that merge by
   maximum. Bands of ROWS registers are hashed to buckets. At a similarity of 0.85 no bucket is shared with a
   probability of (1 - 0.85^5)^24 < 1e-6.
3. In buckets of up to SMALL classes all pairs are candidates, in larger ones all pairs with the least class. Candidates
   whose likelihood (of the registers, given both sizes) peaks MARGIN or more below the threshold, about six deviations, go. The
   rest are verified on their full sets.
4. Larger buckets whose classes are then not all of one component are settled exactly: classes outside the bucket's
   most frequent component are compared with all classes of the buckets led by the same class whose size allows a link,
   in blocks of bounded bytes dealt over tasks. No pair is emitted but found links.
5. Components of all links; a component is named by the smallest doc_id of its classes.

Defined cases: null texts and texts without words have an empty set and are their own component; a null doc_id keeps
its row, links with nothing and has a null component_id (kept is then true); rows that repeat a doc_id are taken row by
row, so each links by its own text and names its component by the shared doc_id; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import pa_schema
from quire.llm.common import LOWER, arrow, grouped, mix64, portions, separated, slices, stored, strings, table, word_hashes
from quire.llm.graph import components

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
SMALL = 16
BLOCK = 2 << 20  # bytes of text of each side of a block
MARGIN = 0.2  # below the threshold; estimates lower than that cannot be links
WORDS = 5

_ODD = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, one row after another, and the rows' offsets."""
    data, offs, _ = strings(column)
    found, sizes = [], []
    for i, j, part, po in slices(data, offs):
        n = j - i
        buf, bounds = separated(LOWER[part], po)
        h, starts, _ = word_hashes(buf)
        row = np.searchsorted(bounds, starts, "right") - 1
        words = np.bincount(row, minlength=n)
        first = np.cumsum(words) - words
        x, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(h) >= WORDS:
            x = h[: len(h) - WORDS + 1].copy()
            for q in range(1, WORDS):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[q : len(h) - WORDS + 1 + q])
            whole = row[: len(x)] == row[WORDS - 1 :]
            x, owner = x[whole], row[: len(whole)][whole]
        short = np.flatnonzero((words > 0) & (words < WORDS))
        few = np.zeros(len(short), np.uint64)
        for q in range(WORDS - 1):
            more = words[short] > q
            few[more] = mix64(few[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[short[more]] + q] + np.uint64(q + 1))
        x, owner = np.concatenate((x, few)), np.concatenate((owner, short))
        order = np.lexsort((x, owner))
        x, owner = x[order], owner[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
        found.append(x[new])
        sizes.append(np.bincount(owner[new], minlength=n))
    flat = np.concatenate(found) if found else np.empty(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else []))).astype(np.int64)


def registers(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set, uint16; empty sets have zeros."""
    n = np.diff(offs)
    out = np.zeros((len(n), REGISTERS), np.uint16)
    some = np.flatnonzero(n)
    for a in range(0, len(some), 256):
        rows = some[a : a + 256]
        part, starts = flat[offs[rows[0]] : offs[rows[-1] + 1]], offs[rows] - offs[rows[0]]
        for k in range(REGISTERS):
            least = np.minimum.reduceat(part * _ODD[k], starts)
            x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
            out[rows, k] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-25)) / np.log(BASE)), 0, 65535)
    return out


def buckets(regs: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each row and band."""
    r = regs.astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    x = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(regs), BANDS)).copy()
    for k in range(ROWS):
        x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k] + np.uint64(1))
    return x.view(np.int64)


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity at which the registers' order is likeliest, given both sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None] * np.minimum(u / v, v / u)
    p = lambda x: np.clip(-np.log(np.clip(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE, 1e-12, 1)) / np.log(BASE), 1e-9, 1)
    up, down = p(u - v * j), p(v - u * j)
    same = np.clip(1 - up - down, 1e-9, 1)
    logs = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (a.shape[1] - more - less)[:, None] * np.log(same)
    return j[np.arange(len(j)), logs.argmax(1)]


SIGNATURE = "doc_id long, mark long, n long, f1 long, f2 long, regs binary"


def _signatures(batches):
    fields = pa_schema(SIGNATURE)
    for b in batches:
        for part in portions(b, "text", 1 << 20, 2048):
            flat, offs = shingles(part["text"])
            n = np.diff(offs)
            has = np.flatnonzero(n)
            sums = np.zeros((2, len(n)), np.uint64)
            if len(has):
                sums[0, has] = np.add.reduceat(flat, offs[has])
                sums[1, has] = np.add.reduceat(mix64(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offs[has])
            regs = registers(flat, offs)
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["mark"], pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), pa.array([x.tobytes() for x in regs], pa.binary())], schema=fields)


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _places(batches):
    fields = pa_schema("key long, doc long")
    for t in batches:
        for k in range(0, t.num_rows, 4096):
            part = t.slice(k, 4096)
            keys = buckets(_registers_of(part["regs"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part["doc"].to_numpy(), BANDS))], schema=fields)


def _likely(percent: int):
    least = percent / 100 - MARGIN

    def likely(batches):
        fields = pa_schema("a long, b long")
        for t in batches:
            for k in range(0, t.num_rows, 4096):
                part = t.slice(k, 4096)
                a, b = _registers_of(part["ra"]), _registers_of(part["rb"])
                keep = pa.array(likeliest(a, b, part["na"].to_numpy(), part["nb"].to_numpy()) >= least)
                yield pa.RecordBatch.from_arrays([part["a"].filter(keep), part["b"].filter(keep)], schema=fields)

    return likely


def _linked(x: int, y: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both)


def _verifier(percent: int):
    def verify(batches):
        fields = pa_schema("a long, b long")
        last, own = None, np.empty(0, np.uint64)
        for t in batches:
            out = []
            flat, offs = shingles(t["ta"])
            for i, (a, b, text) in enumerate(zip(t["a"].to_pylist(), t["b"].to_pylist(), t["tb"])):
                if b != last:
                    own, last = shingles(pa.array([text.as_py()]))[0], b
                x = flat[offs[i] : offs[i + 1]]
                spot = np.minimum(np.searchsorted(own, x), max(len(own) - 1, 0))
                if len(own) and _linked(len(x), len(own), int((own[spot] == x).sum()), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=fields)

    return verify


def _block_links(percent: int):
    def links(t: pa.Table) -> pa.Table:
        """Links of a block of rows outside the main component (side 0) with a block of any rows (side 1)."""
        flat, offs = shingles(t["text"])
        doc, comp, side, n = t["doc"].to_numpy(), t["comp"].to_numpy(), t["side"].to_numpy(), np.diff(offs)
        right = np.flatnonzero((side == 1) & (n > 0))
        right = right[np.argsort(n[right], kind="stable")]
        _, dense = np.unique(flat, return_inverse=True)
        parts = [dense[offs[i] : offs[i + 1]] for i in right]
        joined = np.concatenate(parts) if parts else np.empty(0, np.int64)
        size = n[right]
        begin = np.cumsum(size) - size
        mark, out = np.zeros(len(flat) + 1, np.int32), set()
        for i in np.flatnonzero((side == 0) & (n > 0)):
            lo, hi = np.searchsorted(size, -(-percent * n[i] // 100)), np.searchsorted(size, 100 * n[i] // percent, "right")
            if lo >= hi:
                continue
            own = dense[offs[i] : offs[i + 1]]
            mark[own] = 1
            stop = begin[hi - 1] + size[hi - 1]
            both = np.add.reduceat(mark[joined[begin[lo] : stop]], begin[lo:hi] - begin[lo])
            mark[own] = 0
            good = right[lo:hi][100 * both >= percent * (n[i] + size[lo:hi] - both)]
            good = good[comp[good] != comp[i]]
            out |= {(int(doc[i]), int(c)) for c in np.unique(comp[good])}
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return links


def near_duplicates(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: the id column, n_shingles, component_id, kept."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    sig = stored(arrow(docs, _signatures, SIGNATURE))
    same = ["f1", "f2", "n"]
    real = sig.where("n > 0 and doc_id is not null")
    one_of = real.groupBy(*same).agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.first("regs").alias("regs"))
    classes = stored(one_of.select(F.monotonically_increasing_id().alias("doc"), *same, F.col("first.doc_id").alias("least"), F.col("first.mark").alias("mark"), "regs"))
    placed = arrow(classes.select("doc", "regs"), _places, "key long, doc long")
    full = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("doc").alias("leader")).where("size > 1")
    members = stored(placed.join(full, "key"))

    small = members.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    left = small.select(F.posexplode("docs").alias("i", "b"), "docs").select("b", F.explode(F.slice("docs", F.col("i") + 2, SMALL)).alias("a"))
    star = members.where((F.col("size") > SMALL) & (F.col("doc") != F.col("leader"))).select(F.col("leader").alias("b"), F.col("doc").alias("a"))
    pairs = left.select("a", "b").unionByName(star.select("a", "b")).distinct()
    one = classes.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = classes.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    near = pairs.join(one, "a").join(two, "b").where(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
    likely = stored(arrow(near, _likely(percent), "a long, b long"))

    big = members.where(F.col("size") > SMALL).select("leader", "doc").distinct()
    needed = likely.select(F.col("a").alias("doc")).union(likely.select("b")).union(big.select("doc")).distinct()
    wanted = classes.join(needed, "doc", "left_semi").select(F.col("least").alias("doc_id"), "mark", "doc", "n")
    texts = stored(docs.join(wanted, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc", "n", "text"))
    sides = likely.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    first = stored(arrow(sides, _verifier(percent), "a long, b long"))
    label = components(first)
    second = _settled(big, label, texts, percent, block)

    link = label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second.select("a", "b"))
    final = components(stored(link))
    held = classes.join(final, classes.doc == final.node, "left").select(*same, "least", F.coalesce("component", "doc").alias("component"))
    names = held.groupBy("component").agg(F.min("least").alias("component_id"))
    rows = real.select("doc_id", *same).join(held.join(names, "component").select(*same, "component_id"), same).select("doc_id", "n", "component_id")
    alone = sig.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = rows.unionByName(alone)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _settled(big: DataFrame, label: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of classes in large buckets that lie outside the most frequent component of the classes with their leader.

    Sizes fall into bands so wide that linked classes are in the same band or in neighbouring ones; each band is cut
    into blocks of about `block` bytes of text, and a block of outsiders meets each block of all classes."""
    told = big.join(label, big.doc == label.node, "left").select("leader", "doc", F.coalesce("component", "doc").alias("comp"))
    counts = told.groupBy("leader", "comp").agg(F.count("*").alias("k"))
    main = counts.groupBy("leader").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("total")).where("top.k < total").select("leader", F.col("top.comp").alias("main"))
    band = F.floor(F.ln("n") / F.lit(1.001 * math.log(100 / percent)))
    sizes = texts.select("doc", band.alias("band"), F.octet_length("text").alias("bytes"))
    open_ = stored(told.join(main, "leader").join(sizes, "doc"))
    whole = open_.select("leader", "doc", "comp", "band", "bytes")
    out = open_.where("comp <> main").select("leader", "doc", "comp", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), "bytes")
    cells = whole.groupBy("leader", "band").agg(F.ceil(F.sum("bytes") / block).alias("nv"))
    cells = cells.join(out.groupBy("leader", "band").agg(F.ceil(F.sum("bytes") / block).alias("nu")), ["leader", "band"])
    mine = lambda n: F.pmod(F.xxhash64("doc"), F.greatest(F.col(n), F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1))
    us = out.join(cells, ["leader", "band"]).select("leader", "band", "doc", "comp", F.lit(0).alias("side"), mine("nu").alias("ub"), every("nv").alias("vb"))
    vs = whole.join(cells, ["leader", "band"]).select("leader", "band", "doc", "comp", F.lit(1).alias("side"), every("nu").alias("ub"), mine("nv").alias("vb"))
    dealt = us.unionByName(vs.select(us.columns)).join(texts.select("doc", "text"), "doc")
    return grouped(dealt, ["leader", "band", "ub", "vb"], _block_links(percent), "a long, b long")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of `documents` at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"))
