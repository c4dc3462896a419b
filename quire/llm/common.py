"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by a path that any Hadoop file system can serve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share. A cluster must name it (spark.checkpoint.dir); only a session
    that runs in one process gets a local one of its own."""
    ctx = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if ctx.getCheckpointDir() is None:
        if path is None and not re.fullmatch(r"local(\[.*\])?", ctx.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        ctx.setCheckpointDir(path or "/tmp/checkpoints/quire")
    return (path or ctx.getCheckpointDir()).rstrip("/")


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that stored() makes inside are deleted at the end, but for those taken off the yielded list."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.remove(made)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, so a lost executor costs one reread."""
    path = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """Arrow batches of 8 MB, as both the JVM and the worker hold one; a session that has its own bound keeps it."""
    if spark.conf.get(ARROW) == "67108864b":
        spark.conf.set(ARROW, "8m")


def release() -> None:
    """Give back to the system what this worker no longer uses, as it stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


KEPT: list[Callable[[], None]] = []  # what empties the tables that a worker keeps between its tasks


def let_go() -> None:
    """Empty what tasks of other operators left in this worker."""
    for empty in KEPT:
        empty()


def arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow over batches of bounded bytes. `keeps`: it uses what tasks before left in the worker."""
    lean(df.sparkSession)

    def freed(batches):
        if not keeps:
            let_go()
        yield from run(batches)
        release()

    return df.mapInArrow(freed, schema)


def grouped(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str, keeps: bool = False) -> DataFrame:
    """applyInArrow by key; large groups are given back at once."""
    lean(df.sparkSession)

    def freed(t: pa.Table) -> pa.Table:
        if not keeps:
            let_go()
        size, out = t.nbytes, run(t)
        del t
        if size > 1 << 20:
            release()
        return out

    return df.groupBy(*keys).applyInArrow(freed, schema)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id is in bucket -1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
WINDOW = 1 << 17  # entries that are weighted at once


def _powers(base: np.uint64) -> np.ndarray:
    steps = np.full(WINDOW, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INV)


def polynomial(x: np.ndarray, starts: np.ndarray, zero: np.ndarray | None = None, plus: int = 0) -> np.ndarray:
    """For ascending starts, the sum of (x[k] + plus) * BASE^(k - start) from each start to before the next (the last to
    the end), modulo 2^64; entries flagged in `zero` count nothing. Only WINDOW entries are widened at once, and a span
    may be of any length."""
    out = np.zeros(len(starts), np.uint64)
    for a in range(int(starts[0]) // WINDOW * WINDOW if len(starts) else len(x), len(x), WINDOW):
        b = min(a + WINDOW, len(x))
        i, j = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b))
        i = max(i, 0)
        part = x[a:b].astype(np.uint64)
        if plus:
            part += np.uint64(plus)
        if zero is not None:
            part[zero[a:b]] = 0
        part *= _UP[: b - a]
        at = np.maximum(starts[i:j] - a, 0)
        sums = np.add.reduceat(part, at) * _DOWN[at]
        if starts[i] < a:  # began in a window before
            sums[:1] *= np.uint64(pow(int(_BASE), a - int(starts[i]), 1 << 64))
        out[i:j] += sums
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, with their starts and ends."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    return mix64(polynomial(data, starts, space) + (ends - starts).astype(np.uint64) * _M2), starts, ends


def strings(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The bytes of a string column without copying, and each row's offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offs, column


def slices(data: np.ndarray, offs: np.ndarray, most: int = 2 << 20):
    """Row ranges of about `most` bytes at once, so that temporary arrays stay small: (first, last, bytes, offsets)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n), data[offs[i] : offs[min(j, n)]], offs[i : min(j, n) + 1] - offs[i]
        i = min(j, n)


def separated(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after another with a line break after each, so that no word joins two rows."""
    n = len(offs) - 1
    out = np.full(len(data) + n, 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offs))] = data
    return out, offs + np.arange(n + 1)



def portions(batch: pa.RecordBatch, name: str, most: int = 2 << 20, rows: int = 4096):
    """Row ranges of a batch that hold about `most` bytes of a string column."""
    _, offs, _ = strings(batch[name])
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1), i + rows, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j
