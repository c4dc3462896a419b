"""Exact top-k search: exhaustive term-at-a-time accumulation over blocks.

Vectors become integer weights by dimension, floor(scale * x). Candidates and queries are cut into blocks; a block of
candidates keeps, for each dimension (term), the postings of its non-zero weights. Each pair of blocks meets in one
task: for every term the query rows that hold it scatter weight times posting into a dense array of scores, and partition
selection (argpartition, with all ties at the edge) keeps each query's best. A window by query merges the blocks' lists.
The blocks meet by an equi-join on dealt numbers, as many as the counts of both sides ask for, so neither side is
collected or broadcast and a task has at most about SIDE * SIDE pairs of blocks.

Defined cases: null vectors and vectors with null or non-finite components take no part, as query or candidate; vectors
of other lengths score over the dimensions both have; null ids take no part; rows that repeat an id are candidates each,
except for a query of the same id; fewer than k candidates are all returned; ties go to the smaller id. Scores are exact
integers whatever the components; one beyond 64 bits is given, and compared, as the nearest 64-bit number.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.bpe import pa_schema
from quire.llm.common import arrow, table

CANDIDATES = 4096  # of a block, fewer if they are long
QUERIES = 512
WEIGHTS = 1 << 19  # of a block
SIDE = 8  # blocks of each side that meet in a task
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(column: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that take part, and their integer weights: 16, 32 or 64 bits, or Python integers where these are too few."""
    lengths = column.value_lengths()
    if not column.null_count and len(column) and lengths.to_numpy().min() == lengths.to_numpy().max() and not column.flatten().null_count:
        x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
        fine = np.isfinite(x).all(1)
        y = np.floor(scale * x[fine])
        if np.abs(y).max(initial=0) < 1 << 53:
            return np.flatnonzero(fine), list(y.astype(np.int64))
    good, out = [], []
    for i, v in enumerate(column):
        if v.is_valid and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                y = np.floor(scale * x)
                if np.abs(y).max(initial=0) < 1 << 53:
                    y = y.astype(np.int64)
                else:  # beyond what a double holds exactly
                    y = np.array([math.floor(Fraction(z) * Fraction(scale)) for z in x.tolist()], object)
                good.append(i)
                out.append(y)
    return np.array(good, np.int64), out


def grid(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of weights side by side, short ones padded with 0, as narrow as they allow."""
    wide = max(map(len, rows), default=0)
    top = max((max(map(abs, r.tolist()), default=0) for r in rows), default=0) if any(r.dtype == object for r in rows) else max((int(np.abs(r).max(initial=0)) for r in rows), default=0)
    kind = next((k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max), object)
    out = np.zeros((len(rows), max(1, wide)), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _kept(x: np.ndarray) -> tuple[int, bytes]:
    """A grid's width of numbers in bytes (0: text) and its data."""
    return (0, " ".join(map(str, x.reshape(-1))).encode()) if x.dtype == object else (x.dtype.itemsize, x.tobytes())


def _taken(width: int, dims: int, data: bytes) -> np.ndarray:
    flat = np.array([int(v) for v in data.split()], object) if not width else np.frombuffer(data, f"<i{width}")
    return flat.reshape(-1, dims)


_BLOCK = "block long, width int, dims int, ids binary, weights binary"


def _blocks(scale: float, size: int):
    fields = pa_schema(_BLOCK)

    def cut(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            good, rows = quantised(b["v"], scale)
            ids = b["id"].to_numpy()[good]
            order = np.argsort([len(r) for r in rows], kind="stable")  # a long vector pads its own block only
            k = 0
            while k < len(order):
                n = max(1, min(size, WEIGHTS // max(1, len(rows[order[min(k + size, len(order)) - 1]]))))
                some = order[k : k + n]
                x = grid([rows[i] for i in some])
                width, data = _kept(x)
                yield pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([width], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([data], pa.binary())], schema=fields)
                made += 1
                k += n

    return cut


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores, a term at a time: postings of the term, scattered by the weight of each query row that has it."""
    terms = min(queries.shape[1], candidates.shape[1])
    most = lambda x: max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    top = most(queries) * most(candidates) * terms
    kind = np.int32 if top < 1 << 31 else np.int64 if top <= MOST else object
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    out = np.zeros((len(queries), len(candidates)), kind)
    for t in range(terms):
        rows, column = np.flatnonzero(queries[:, t]), candidates[:, t]
        postings = np.flatnonzero(column)
        if len(postings) == len(column) and len(rows) == len(queries):
            out += queries[:, t, None] * column[None]
        elif len(postings) and len(rows):
            out[np.ix_(rows, postings)] += queries[rows, t, None] * column[postings][None]
    return np.clip(out, LEAST, MOST).astype(np.int64) if kind is object else out.astype(np.int64, copy=False)


def best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query's scores, ties to the smaller id, without its own row."""
    if len(score) > 4 * k:  # partition selection: everything not under the (k+1)-th best, ties included
        edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
        pick = np.flatnonzero(score >= edge)
        if (ids[pick] != own).sum() < k:
            pick = np.arange(len(score))
    else:
        pick = np.arange(len(score))
    pick = pick[ids[pick] != own]
    pick = pick[np.lexsort((ids[pick], -score[pick]))][:k]
    return ids[pick], score[pick]


def top_k(candidates: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the candidate's id as `vec_id`, and its score."""

    def rows(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))

    def deal(df: DataFrame, size: int) -> int:
        return max(1, -(-df.select("id").count() // (size * SIDE)))

    some_q, some_c = rows(queries), rows(candidates)
    n_q, n_c = deal(some_q, QUERIES), deal(some_c, CANDIDATES)
    mine = lambda n, seed: F.pmod(F.xxhash64("block", F.lit(seed)), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own: Column = mine(n_q, 1)
    q = arrow(some_q, _blocks(scale, QUERIES), _BLOCK).select(own.alias("g"), every(n_c).alias("p"), F.col("width").alias("qk"), F.col("dims").alias("qd"), F.col("ids").alias("qi"), F.col("weights").alias("qw"))
    c = arrow(some_c, _blocks(scale, CANDIDATES), _BLOCK).select(every(n_q).alias("g"), mine(n_c, 3).alias("p"), "width", "dims", "ids", "weights")
    schema = "query_id long, vec_id long, score long"
    fields = pa_schema(schema)

    def search(batches):
        for b in batches:
            for i in range(b.num_rows):
                x = {n: b[n][i].as_py() for n in b.schema.names}
                qi, ci = np.frombuffer(x["qi"], np.int64), np.frombuffer(x["ids"], np.int64)
                s = scores(_taken(x["qk"], x["qd"], x["qw"]), _taken(x["width"], x["dims"], x["weights"]))
                found = [best(s[r], ci, own, k) for r, own in enumerate(qi)]
                n = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], schema=fields)

    met = arrow(c.join(q, ["g", "p"]), search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
