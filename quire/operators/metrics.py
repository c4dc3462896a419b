"""Quality metrics of rankings, judges and transcriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.corpus import running


def average_rank(df: DataFrame, value: str, name: str, part: str | None = None) -> DataFrame:
    """Ranks from 1 with ties sharing their mean; without a part, no single task sorts all values."""
    keys = [part] if part else []
    by = df.groupBy(*keys, value).agg(F.count("*").alias("__k"))
    if part:
        below = by.withColumn("__b", F.sum("__k").over(Window.partitionBy(part).orderBy(value)) - F.col("__k"))
    else:
        below = running(by, value, "__k", "__b")
    ranks = below.select(*keys, value, (F.col("__b") + (F.col("__k") + 1) / 2).alias(name))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(a, b), a, "__ra"), b, "__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("spearman"), F.count("*").alias("n"))


def calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of the prediction."""
    bin_ = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    by = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"), F.avg(p).alias("p"), F.avg(y).alias("y"))
    return by.agg((F.sum(F.col("k") * F.abs(F.col("p") - F.col("y"))) / F.sum("k")).alias("ece"), F.sum("k").alias("n"))


def log_loss(df: DataFrame, p: str, y: str) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    return df.agg(F.avg(-F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q))).alias("nll"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean share of each query's first k results (qid, n, rank) that both lists hold."""
    both = a.where(F.col("rank") <= k).select("qid", "n").join(b.where(F.col("rank") <= k).select("qid", "n"), ["qid", "n"]).groupBy("qid").agg(F.count("*").alias("k"))
    return a.select("qid").distinct().join(both, "qid", "left").agg((F.avg(F.coalesce("k", F.lit(0))) / k).alias("overlap"))


def character_error(df: DataFrame, text: str, reference: str) -> DataFrame:
    """Edit distance by character of all rows, of all reference characters."""
    return df.agg((F.sum(F.levenshtein(text, reference)) / F.sum(F.length(reference))).alias("cer"))


def word_error(df: DataFrame, text: str, reference: str) -> DataFrame:
    """Edit distance by word of all rows, of all reference words (folded). Words become letters of a private alphabet by
    rank in their row, so the built-in distance by character counts words."""
    from quire.functions.text import tokens

    own, other = tokens(F.col(text)), tokens(F.col(reference))
    rows = df.select(own.alias("a"), other.alias("b"), F.array_distinct(F.concat(own, other)).alias("words"))
    sign = lambda c: F.array_join(F.transform(c, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position("words", w) + 0x4E00), 8, "0")), "UTF-32")), "")
    return rows.agg((F.sum(F.levenshtein(sign("a"), sign("b"))) / F.sum(F.size("b"))).alias("wer"))


def cosine_spread(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cosines of pairs of vectors: n, mean, p5 (interpolated), least."""
    from quire.functions import vectors as V

    c = V.cosine(V.doubles(F.col(a)), V.doubles(F.col(b)))
    return df.select(c.alias("c")).agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.percentile("c", 0.05).alias("p5"), F.min("c").alias("least"))


def best_kept(a: DataFrame, b: DataFrame, few: int = 3, depth: int = 10) -> DataFrame:
    """Mean share of each query's first `few` results (qid, n, rank) in a that b has among its first `depth`."""
    first, held = a.where(F.col("rank") <= few).select("qid", "n"), b.where(F.col("rank") <= depth).select("qid", "n", F.lit(1).alias("k"))
    return first.join(held, ["qid", "n"], "left").groupBy("qid").agg((F.sum(F.coalesce("k", F.lit(0))) / few).alias("s")).agg(F.avg("s").alias("kept"))


def fitted_temperature(df: DataFrame, logit: str, label: str, steps: int = 120, least: float = 0.2, most: float = 5.0) -> DataFrame:
    """The temperature, of `steps` on a logarithmic grid, with the least loss of sigmoid(logit / temperature), and that
    loss. One pass sums all of the grid."""
    grid = [least * (most / least) ** (k / (steps - 1)) for k in range(steps)]
    z = F.col(logit)
    loss = lambda t: F.avg(F.when(F.col(label) == 1, F.log1p(F.exp(-z / t))).otherwise(F.log1p(F.exp(z / t))))
    sums = df.agg(*[loss(t).alias(f"l{k}") for k, t in enumerate(grid)])
    best = F.array_min(F.array(*[F.struct(F.col(f"l{k}").alias("nll"), F.lit(t).alias("temperature")) for k, t in enumerate(grid)]))
    return sums.select(best["temperature"].alias("temperature"), best["nll"].alias("nll"))
