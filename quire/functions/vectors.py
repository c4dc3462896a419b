"""Vectors: products in binary64, truncation, storage as f32, f16 and i8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def truncated(v: Column, dims: int) -> Column:
    """The first `dims` components, scaled to unit length."""
    cut = F.slice(v, 1, dims)
    n = norm(cut)
    return F.when(n > 0, F.transform(cut, lambda x: x / n)).otherwise(cut)


def i8(v: Column) -> Column:
    """Signed bytes: v * 127 rounded half away from zero, within +-127, of the single-precision value."""
    x32 = lambda x: x.cast("float").cast("double")
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.signum(x32(x)) * F.floor(F.abs(x32(x)) * 127 + 0.5))))


def encode(values, dtype: str) -> bytes:
    """Little-endian storage; what does not fit raises ValueError."""
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        raise ValueError("not finite")
    if dtype == "i8":
        single = x.astype(np.float32).astype(np.float64)
        return (np.sign(single) * np.floor(np.abs(single) * 127 + 0.5)).clip(-127, 127).astype(np.int8).tobytes()
    with np.errstate(over="ignore"):
        out = x.astype({"f32": "<f4", "f16": "<f2"}[dtype]) if dtype == "f32" else x.astype("<f4").astype("<f2")
    if not np.isfinite(out).all():
        raise ValueError(f"does not fit {dtype}")
    return out.tobytes()


def decode(data: bytes, dtype: str) -> np.ndarray:
    if dtype == "i8":
        return np.frombuffer(data, np.int8) / 127
    return np.frombuffer(data, {"f32": "<f4", "f16": "<f2"}[dtype]).astype(np.float64)


SAME = ("provider", "model", "dims", "normalized", "truncated_from", "task_prefixes")


def compatibility(a: Column, b: Column) -> Column:
    """Whether one query vector serves two spaces (structs): `same`, `approximate` for engine variants of one version, or
    `incompatible`; the storage type may differ."""
    equal = F.lit(True)
    for k in SAME:
        equal = equal & a[k].eqNullSafe(b[k])
    base = lambda s: F.substring_index(s["version"], "+", 1)
    kind = F.when(~equal, "incompatible").when(a["version"].eqNullSafe(b["version"]), "same")
    return kind.when(F.coalesce(base(a) == base(b), F.lit(False)), "approximate").otherwise("incompatible")


def prefixed(text: Column, prefixes: Column, task: str) -> Column:
    """The text that a model is given for a task, by the prefixes (a map) of its space."""
    return F.concat(F.coalesce(prefixes[task], F.lit("")), text)


def fake_vectors(texts: list[str], dims: int = 64) -> np.ndarray:
    """Unit vectors that depend on the text alone, for tests: FNV-1a seeds splitmix64."""
    out = np.empty((len(texts), dims))
    step, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for i, t in enumerate(texts):
        seed = 0xCBF29CE484222325
        for b in t.encode():
            seed = (seed ^ b) * 0x100000001B3 & mask
        z = np.uint64(seed) + np.arange(1, dims + 1, dtype=np.uint64) * np.uint64(step)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
        out[i] = (z >> np.uint64(11)).astype(np.float64) / 2.0**53 * 2 - 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
