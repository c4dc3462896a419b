"""Quality rules with risk-controlled thresholds.

Each text has counts (words, symbols, repeated lines and word triples) and from them RULES, where high is bad. Labelled
documents that the base rules keep are split by a hash of their id. The first half makes one score of the rules: of
each rule, how far it is above the median of good documents, in units of the way to their 99th percentile; the score is
the largest of those rules that single out bad documents. It also proposes cutoffs, from far above all good documents
down into them. The second half tests these in that order: a cutoff passes if the exact (Clopper-Pearson) upper bound
of the rate of good documents that it rejects is at most LIMIT, and the first that fails ends the sequence, so testing
many cutoffs costs no confidence. The confidence is corrected by Bonferroni for the strata tested. Of the cutoffs that
pass, the mildest one that rejects as many labelled bad documents as the strictest is used.

Strata whose second half is too small for any cutoff to pass are tested together; the bound then holds over them
together, and strata without labels take the same cutoff. If they are too few even so, nothing beyond the base rules is
rejected. At most STRATA strata are tested by themselves, the largest. All labelled rows take part in fitting and stay where they are: medians
and quantiles are exact order statistics, found byte by byte from counts, and the driver gets sums by stratum only.

Defined cases: a null text has no words and fails the base rules; a null stratum is a stratum of its own; null labels
and labels without a document take no part; a document labelled both good and bad counts as good; ids that repeat are
judged row by row; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import pa_schema
from quire.llm.common import SPACE, arrow, mix64, polynomial, separated, slices, stored, strings, table, word_hashes

LIMIT = 0.01  # of good documents, by stratum
CONFIDENCE = 0.95
ABOVE = (8.0, 4.0, 2.0, 1.5, 1.2, 1.0)  # cutoffs as multiples of the greatest score of good documents,
INSIDE = (0.001, 0.002, 0.005, 0.01)  # and as the share of them that is above
STRATA = 256
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "n_words / greatest(word_chars, 1)",
}
UNIT = np.array([0.02, 0.02, 0.02, 0.01, 0.01, 0.2, 0.01])  # least unit of each rule
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits")

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal key in their row: any, and those not the first."""
    order = np.lexsort((key, row))
    same = np.zeros(len(key) + 1, bool)
    if len(key) > 1:
        same[1:-1] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order], later[order] = same[:-1] | same[1:], same[:-1]
    return any_, later


def counts(column) -> list[np.ndarray]:
    """COUNTS of each text."""
    data, offs, _ = strings(column)
    out = [[] for _ in COUNTS]
    for i, j, part, po in slices(data, offs, 2 << 20):
        n = j - i
        buf, bounds = separated(part, po)
        h, starts, _ = word_hashes(buf)
        row = np.searchsorted(bounds, starts, "right") - 1
        total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])
        solid = ~SPACE[buf]
        cover = np.zeros(len(h), bool)
        if len(h) > 2:
            tri = mix64(mix64(h[:-2] * _STEP + h[1:-1]) * _STEP + h[2:])
            whole = np.flatnonzero(row[:-2] == row[2:])
            again = whole[_repeated(row[whole], tri[whole])[0]]
            for k in range(3):
                cover[again + k] = True
        ends = np.flatnonzero(buf == 10)
        begin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        lines = np.empty(0, np.int64)
        later = np.empty(0, bool)
        if len(begin):
            key = polynomial(buf, begin, None, 1)
            has = np.add.reduceat(solid.astype(np.int32), begin) > 0
            lines = (np.searchsorted(bounds, begin, "right") - 1)[has]
            later = _repeated(lines, mix64(key[has] + (ends - begin)[has].astype(np.uint64)))[1]
        made = (
            np.bincount(row, minlength=n),
            total(solid & ((buf & 0xC0) != 0x80)),
            total(_SYMBOL[buf]),
            np.bincount(lines[later], minlength=n),
            np.bincount(row[cover], minlength=n),
            np.bincount(lines, minlength=n),
            total((buf >= 65) & (buf <= 90)),
            total((buf >= 48) & (buf <= 57)),
        )
        for x, y in zip(out, made):
            x.append(y.astype(np.int64))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


def upper_bound(k: int, n: int, alpha: float) -> float:
    """The exact binomial upper bound of a rate of which k of n were seen, at confidence 1 - alpha."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    tail = lambda p: sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid >= 1 or tail(mid) <= alpha:
            hi = mid
        else:
            lo = mid
    return hi


class Cutoff(NamedTuple):
    middle: np.ndarray  # of each rule
    unit: np.ndarray  # infinite for a rule that takes no part
    most: float

    def score(self, rules: np.ndarray) -> np.ndarray:
        return ((rules - self.middle) / self.unit).max(1)


def cutoff(rules: np.ndarray, good: np.ndarray, proposes: np.ndarray, alpha: float) -> Cutoff | None:
    """The cutoff of one stratum from the rules of its labelled documents, or None if none passes."""
    fit, bad, test = rules[good & proposes], rules[~good & proposes], rules[good & ~proposes]
    if not len(fit) or not len(test):
        return None
    middle, edge = np.median(fit, 0), np.quantile(fit, 0.99, axis=0)
    unit = np.maximum(edge - middle, UNIT[: rules.shape[1]])
    if len(bad):
        unit = _telling(unit, (bad > middle + unit).mean(0), (fit > middle + unit).mean(0))
    made = Cutoff(middle, unit, 0.0)
    own = made.score(fit)
    grid = _grid(float(own.max()), [float(np.quantile(own, 1 - q, method="higher")) for q in INSIDE])
    wrongs, caught = made.score(test), made.score(rules[~good])
    most = _mildest(grid, [int((wrongs > t).sum()) for t in grid], len(wrongs), [int((caught > t).sum()) for t in grid], alpha)
    return None if most is None else made._replace(most=most)


def _telling(unit: np.ndarray, bad: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Units of the rules that single out bad documents, by the shares of bad and good ones above; all, if none does."""
    tells = bad > 3 * fit + 0.01
    return np.where(tells, unit, np.inf) if tells.any() else unit


def _grid(greatest: float, inside: list[float]) -> list[float]:
    """The cutoffs to test, in order."""
    return sorted({*(max(greatest, 0.1) * k for k in ABOVE), *inside}, reverse=True)


def _mildest(grid: list[float], wrongs: list[int], n: int, caught: list[int], alpha: float) -> float | None:
    """Of the cutoffs that pass, the mildest that rejects as many bad documents as the strictest. wrongs, of n: good
    documents above each cutoff; caught: bad ones."""
    held = 0
    for k in wrongs:
        if k > LIMIT * n or upper_bound(k, n, alpha) > LIMIT:
            break
        held += 1
    return next((t for t, k in zip(grid, caught[:held]) if k == caught[held - 1]), None)


def cutoffs(strata: list, rules: np.ndarray, good: np.ndarray, proposes: np.ndarray) -> tuple[dict, Cutoff | None]:
    """The cutoffs of strata that are tested by themselves, and the one of all the others together."""
    test = Counter(s for s, g, p in zip(strata, good, proposes) if g and not p)
    ranked = sorted(test, key=lambda s: (-test[s], str(s)))[:STRATA]
    number, alpha = _alone([(s, test[s]) for s in ranked])
    of = np.array([number.get(s, -1) for s in strata], np.int64)
    found = {s: cutoff(rules[of == i], good[of == i], proposes[of == i], alpha) for s, i in number.items()}
    return {s: c for s, c in found.items() if c}, cutoff(rules[of < 0], good[of < 0], proposes[of < 0], alpha)


def _alone(ranked: list[tuple]) -> tuple[dict, float]:
    """Numbers of the strata tested by themselves, from the largest with their tests, and the confidence left to each."""
    number: dict = {}
    for s, n in ranked:  # one more stratum makes the confidence of all higher
        if upper_bound(0, n, (1 - CONFIDENCE) / (len(number) + 2)) > LIMIT:
            break
        number[s] = len(number)
    return number, (1 - CONFIDENCE) / (len(number) + 1)


def order_statistics(df: DataFrame, ranks: dict[int, list[list[int]]]) -> dict[tuple[int, int, int], float]:
    """Exact values at ranks (from 0) of each cell's columns: df has cell and x (array of doubles), ranks the wanted ones
    by cell and column; the result is by (cell, column, rank). Each pass counts one more byte of the values that share
    the bytes found, so what is collected is bounded by the ranks asked for."""
    at = {(c, k, r): (0, r) for c, by in ranks.items() for k, of in enumerate(by) for r in of}  # prefix, rank in it
    for step in range(8):
        targets = sorted({(c, k, prefix) for (c, k, _), (prefix, _) in at.items()})
        place = {x: i for i, x in enumerate(targets)}
        part = df.where(F.col("cell").isin(sorted(ranks)))
        sums: dict[int, np.ndarray] = {i: np.zeros(256, np.int64) for i in range(len(targets))}
        for r in arrow(part, _digits(targets, step), "target int, digit int, n long").groupBy("target", "digit").agg(F.sum("n").alias("n")).collect():
            sums[r["target"]][r["digit"]] = r["n"]
        for (c, k, rank), (prefix, left) in at.items():
            ends = np.cumsum(sums[place[c, k, prefix]])
            digit = int(np.searchsorted(ends, left, "right"))
            at[c, k, rank] = (prefix << 8 | digit, left - (int(ends[digit - 1]) if digit else 0))
    keys = np.array([prefix for prefix, _ in at.values()], np.uint64) ^ _SIGN
    bits = keys.view(np.int64)
    return dict(zip(at, (bits ^ ((bits >> 63) & _REST)).view(np.float64).tolist()))


_SIGN, _REST = np.uint64(1 << 63), np.int64((1 << 63) - 1)


def _digits(targets: list[tuple[int, int, int]], step: int):
    """Counts of the next byte of the values under each target: (cell, column, leading bytes)."""

    def run(batches):
        found = np.zeros((len(targets), 256), np.int64)
        for b in batches:
            cell = b["cell"].to_numpy()
            bits = (b["x"].flatten().to_numpy().reshape(len(cell), -1) + 0.0).view(np.int64)  # one zero
            key = (bits ^ ((bits >> 63) & _REST)).view(np.uint64) ^ _SIGN
            digit = ((key >> np.uint64(56 - 8 * step)) & np.uint64(255)).astype(np.int64)
            prefix = key >> np.uint64(64 - 8 * step) if step else np.zeros_like(key)
            rows: dict[int, np.ndarray] = {}
            for i, (c, k, p) in enumerate(targets):
                if c not in rows:
                    rows = {c: np.flatnonzero(cell == c)}
                own = rows[c]
                found[i] += np.bincount(digit[own, k][prefix[own, k] == np.uint64(p)], minlength=256)
        i, d = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(found[i, d])], names=["target", "digit", "n"])

    return run


def fitted(rows: DataFrame) -> tuple[dict, Cutoff | None]:
    """cutoffs() of a table: stratum, good, proposes, and the rules as an array x."""
    spark, width = rows.sparkSession, len(RULES)
    wide = range(width)
    fit, bad = F.col("good") & F.col("proposes"), ~F.col("good")
    test = F.col("good") & ~F.col("proposes")
    n_of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    ranked = rows.where(test).groupBy("stratum").count().orderBy(F.desc("count"), F.coalesce("stratum", F.lit("None"))).limit(STRATA).collect()
    number, alpha = _alone([(r["stratum"], r["count"]) for r in ranked])
    cells = spark.createDataFrame(list(number.items()), "s string, c int")
    rows = rows.join(F.broadcast(cells), F.col("stratum").eqNullSafe(F.col("s")), "left").select(F.coalesce("c", F.lit(-1)).alias("cell"), "good", "proposes", "x")
    sizes = {r["cell"]: r for r in rows.groupBy("cell").agg(n_of(fit).alias("fit"), n_of(test).alias("test"), n_of(bad & F.col("proposes")).alias("bad")).collect()}
    sizes = {c: r for c, r in sizes.items() if r["fit"] and r["test"]}
    if not sizes:
        return {}, None

    def with_(values: dict[int, list[list[float]]], names: list[str]) -> DataFrame:
        told = spark.createDataFrame([(c, *([float(x) for x in v] for v in of)) for c, of in values.items()], "cell int, " + ", ".join(f"{n} array<double>" for n in names))
        return rows.join(F.broadcast(told), "cell")  # at most STRATA + 1 rows

    ends = {c: [(r["fit"] - 1) // 2, r["fit"] // 2, int((r["fit"] - 1) * 0.99), min(int((r["fit"] - 1) * 0.99) + 1, r["fit"] - 1)] for c, r in sizes.items()}
    got = order_statistics(rows.where(fit).select("cell", "x"), {c: [sorted(set(e))] * width for c, e in ends.items()})
    middle, unit = {}, {}
    for c, e in ends.items():
        a, b, low, high = (np.array([got[c, k, r] for k in wide]) for r in e)
        middle[c] = (a + b) / 2
        t = (sizes[c]["fit"] - 1) * 0.99 - e[2]
        edge = high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t
        unit[c] = np.maximum(edge - middle[c], UNIT)
    above = with_({c: [middle[c] + unit[c]] for c in sizes}, ["edge"])
    told = above.groupBy("cell").agg(*[n_of(who & (F.col("x")[k] > F.col("edge")[k])).alias(f"{name}{k}") for name, who in (("bad", bad & F.col("proposes")), ("fit", fit)) for k in wide]).collect()
    for r in told:
        n = sizes[r["cell"]]
        if n["bad"]:
            unit[r["cell"]] = _telling(unit[r["cell"]], *(np.array([r[f"{name}{k}"] for k in wide]) / n[name] for name in ("bad", "fit")))
    scored = with_({c: [middle[c], unit[c]] for c in sizes}, ["middle", "unit"]).withColumn("score", _score(F.col("x"), F.col("middle"), F.col("unit")))
    inside = {c: [math.ceil((r["fit"] - 1) * (1 - q)) for q in INSIDE] for c, r in sizes.items()}
    got = order_statistics(scored.where(fit).select("cell", F.array("score").alias("x")), {c: [sorted({*of, sizes[c]["fit"] - 1})] for c, of in inside.items()})
    grid = {c: _grid(got[c, 0, sizes[c]["fit"] - 1], [got[c, 0, r] for r in of]) for c, of in inside.items()}
    cut = spark.createDataFrame(list(grid.items()), "cell int, grid array<double>")
    most = len(ABOVE) + len(INSIDE)
    over = lambda who, i: n_of(who & (F.col("score") > F.get("grid", F.lit(i))))
    counted = scored.join(F.broadcast(cut), "cell").groupBy("cell").agg(F.array(*[over(test, i) for i in range(most)]).alias("wrongs"), F.array(*[over(bad, i) for i in range(most)]).alias("caught")).collect()
    found = {r["cell"]: _mildest(grid[r["cell"]], r["wrongs"][: len(grid[r["cell"]])], sizes[r["cell"]]["test"], r["caught"], alpha) for r in counted}
    made = {c: Cutoff(middle[c], unit[c], t) for c, t in found.items() if t is not None}
    return {s: made[i] for s, i in number.items() if i in made}, made.get(-1)


def _score(rules: Column, middle: Column, unit: Column) -> Column:
    return F.array_max(F.zip_with(F.zip_with(rules, middle, lambda x, m: x - m), unit, lambda x, u: x / u))


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, COUNTS, base_failed, kept. `labels` has doc_id and quality (1: good, 0: bad)."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    schema = f"id {kind}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
    fields = pa_schema(schema)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], b["stratum"], *map(pa.array, counts(b["text"]))], schema=fields)

    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    seen = stored(arrow(base, count, schema).withColumn("base_failed", failed))
    told = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg((F.max("quality") > 0).alias("good"))
    rules = F.array(*[F.expr(v).cast("double") for v in RULES.values()])
    rows = seen.where("not base_failed").join(told, F.col("id") == F.col("labelled")).select("stratum", "good", (F.pmod(F.xxhash64("id"), F.lit(2)) == 0).alias("proposes"), rules.alias("x"))
    found, rest = fitted(stored(rows))
    doubles = lambda c: (*(F.array(*[F.lit(float(x)) for x in v]) for v in (c.middle, c.unit)), F.lit(c.most))
    none = [F.lit(None).cast(t) for t in ("array<double>", "array<double>", "double")]
    cut = docs.sparkSession.createDataFrame([(k, [float(x) for x in c.middle], [float(x) for x in c.unit], c.most) for k, c in found.items()], "s string, middle array<double>, unit array<double>, most double")
    own = F.col("most").isNotNull()
    middle, unit, most = (F.when(own, F.col(n)).otherwise(x) for n, x in zip(("middle", "unit", "most"), doubles(rest) if rest else none))
    score = _score(rules, middle, unit)
    judged = seen.join(F.broadcast(cut), F.col("stratum").eqNullSafe(F.col("s")), "left")  # at most STRATA rows
    bad = F.coalesce(score > most, F.lit(False))
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of every document, with cutoffs by language learnt from `labels`."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
