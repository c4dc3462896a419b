"""Language identification by language-bitmask n-gram filters.

An n-gram is ORDER code points of lower-cased text with runs of non-letters as one blank, and a blank at either end. For
each language the n-grams of its training texts are counted; those that make up at least SHARE of the language's n-grams and are not MUCH rarer
there than in another language enter a bit-sliced Bloom filter: CELLS words of 64 bits, a bit for each language. The AND
of an n-gram's HASHES cells is the set of all languages that hold it, from one probe. A text's popcount for a language
is corrected for false positives, (hits - n f) / (1 - f) with f = filled share ^ HASHES; the largest decides.
The score is the winner's share of all corrected popcounts.

A text none of whose n-grams is held is told by its letters in the same way, and if none of these is held, it gets the
language with the most texts, with score 0.

Only texts with a non-null language are learnt from: of each language up to TEXTS, chosen by a hash of their id. The
filter is put together in tasks, cell by cell; it has a fixed size, which is all that the driver gets and all tasks
receive. Languages beyond 64 would need a wider word and raise ValueError.

Defined cases: null texts and texts without a letter (of category L; marks alone are none) are `und` with score 0; so are
all texts when no language could be learnt; ids may repeat or be null; other columns are not read.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import pa_schema
from quire.llm.common import arrow, id_bucket, mix64, slices, stored, strings, table

ORDER = 3
CELLS = 1 << 20
HASHES = 3
TEXTS = 5_000
SHARE = 2e-6
MUCH = 40.0
LEAST = 2  # texts in which an n-gram must occur,
FEW = 20  # in languages of this many texts or more

_STEP = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each letter or mark (0: neither), and whether a code point is a letter."""
    low, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        ch = chr(i)
        kind = unicodedata.category(ch)[0]
        if kind in "LM":
            x = ch.lower()
            low[i], letter[i] = ord(x) if len(x) == 1 else i, kind == "L"
    return low, letter


def grams(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes (of order 1: of letters) and their rows, and each row's number of letters."""
    n = len(offs) - 1
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = offs if len(cp) == len(data) else np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
    row = np.repeat(np.arange(n), np.diff(at))
    letters = np.bincount(row[_letters()[1][cp]], minlength=n)
    low = np.zeros(len(cp) + 2 * n, np.uint32)  # a blank before and after each row
    low[np.arange(len(cp)) + 2 * row + 1] = _letters()[0][cp]
    at = at + 2 * np.arange(n + 1)
    row = np.repeat(np.arange(n), np.diff(at))
    if order == 1:
        return mix64(low[low > 0].astype(np.uint64) + _STEP), row[low > 0], letters
    first = np.zeros(len(low), bool)
    first[at[:-1]] = True
    keep = (low > 0) | first
    keep[1:] |= (low[:-1] > 0) & ~first[1:]
    low, row = low[keep], row[keep]
    if len(low) < ORDER:
        return np.empty(0, np.uint64), np.empty(0, np.int64), letters
    x = low[: len(low) - ORDER + 1].astype(np.uint64)
    for k in range(1, ORDER):
        x = x * np.uint64(1 << 21) + low[k : len(low) - ORDER + 1 + k]
    whole = (row[: len(x)] == row[ORDER - 1 :]) & (x > np.uint64(1 << 21))
    return mix64(x[whole] + _STEP), row[: len(whole)][whole], letters


def cells(x: np.ndarray, k: int) -> np.ndarray:
    return (mix64(x + np.uint64(k * int(_STEP) % (1 << 64))) & np.uint64(CELLS - 1)).astype(np.int64)


class Filters:
    def __init__(self, languages: list[str], words: np.ndarray, usual: str = "und"):
        if len(languages) > 64:
            raise ValueError("a filter word holds 64 languages")
        self.languages, self.words, self.usual = languages, words, usual
        filled = np.array([np.count_nonzero(words >> np.uint64(i) & np.uint64(1)) for i in range(len(languages))]) / CELLS
        self.false = filled**HASHES

    def masks(self, x: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, as bits."""
        out = self.words[cells(x, 0)]
        for k in range(1, HASHES):
            out = out & self.words[cells(x, k)]
        return out

    def estimates(self, x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Each row's corrected popcount for each language."""
        mask, total = self.masks(x), np.bincount(row, minlength=n)
        est = np.zeros((n, max(1, len(self.languages))))
        for k in range(len(self.languages)):
            hits = np.bincount(row[(mask >> np.uint64(k) & np.uint64(1)).astype(bool)], minlength=n)
            est[:, k] = np.maximum(0, (hits - total * self.false[k]) / (1 - self.false[k]))
        return est

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        data, offs, _ = strings(column)
        names, scores = [], []
        for i, j, part, po in slices(data, offs, 1 << 20):
            x, row, letters = grams(part, po)
            est = self.estimates(x, row, j - i)
            lost = (est.max(1) <= 0) & (letters > 0)
            if lost.any():
                x, row, _ = grams(part, po, 1)
                est[lost] = self.estimates(x[lost[row]], row[lost[row]], j - i)[lost]
            best = est.argmax(1)
            top, all_ = est.max(1), est.sum(1)
            sure = (top > 0) & (letters > 0)
            names += [self.languages[b] if s else self.usual if k else "und" for b, s, k in zip(best.tolist(), sure, letters > 0)]
            scores.append(np.where(sure, top / np.maximum(all_, 1e-300), 0.0))
        return names, np.concatenate(scores) if scores else np.empty(0)


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from the rows of `df` with a language."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if len(sizes) > 64:
        raise ValueError("a filter word holds 64 languages")
    languages = sorted(sizes)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, TEXTS / v) * (1 << 30)))) for k, v in sizes.items()], F.lit(0)) if sizes else F.lit(0)

    def count(batches):
        for b in batches:
            names = np.array([languages.index(x) for x in b["lang"].to_pylist()])
            data, offs, _ = strings(b["text"])
            for i, j, part, po in slices(data, offs):
                for size in (ORDER, 1):
                    x, row, _ = grams(part, po, size)
                    lang = names[i:j][row]
                    order = np.lexsort((row, x, lang))
                    x, row, lang = x[order], row[order], lang[order]
                    if not len(x):
                        continue
                    new = np.ones(len(x), bool)
                    new[1:] = (x[1:] != x[:-1]) | (lang[1:] != lang[:-1])
                    text = new.copy()
                    text[1:] |= row[1:] != row[:-1]
                    at = np.flatnonzero(new)
                    yield pa.RecordBatch.from_pydict({"size": np.full(len(at), size), "lang": lang[at], "gram": x[at].view(np.int64), "n": np.diff(np.append(at, len(x))), "texts": np.add.reduceat(text.astype(np.int64), at)})

    counted = arrow(rows.where(place < share), count, "size long, lang long, gram long, n long, texts long").groupBy("size", "lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counted = stored(counted)
    totals = {r["lang"]: r["n"] for r in counted.where(F.col("size") == ORDER).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    words = np.zeros(CELLS, np.uint64)
    if totals:
        rate = F.col("n") / F.coalesce(*[F.when(F.col("lang") == k, F.lit(float(v))) for k, v in totals.items()])
        few = [k for k, x in enumerate(languages) if sizes[x] < FEW]
        rated = counted.withColumn("rate", rate)
        by = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate", "texts")).alias("of"))
        held = by.select("gram", "most", F.explode("of").alias("x")).where((F.col("x.rate") >= SHARE) & (F.col("x.rate") * MUCH >= F.col("most")) & (F.col("x.lang").isin(few) | (F.col("x.texts") >= LEAST)))
        parts = arrow(held.select(F.col("x.lang").alias("lang"), "gram"), _filled, "cell long, bits long")
        found = parts.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most CELLS rows
        words[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Filters(languages, words, min(languages, key=lambda x: (-sizes[x], x)) if languages else "und")


def _filled(batches):
    """The cells that n-grams fill, with the bits of their languages; combined for a whole partition."""
    words = np.zeros(CELLS, np.uint64)
    for b in batches:
        bits = np.uint64(1) << b["lang"].to_numpy().astype(np.uint64)
        for k in range(HASHES):
            np.bitwise_or.at(words, cells(b["gram"].to_numpy().view(np.uint64), k), bits)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["cell", "bits"])


def identify(df: DataFrame, filters: Filters, carry: dict | None = None, text_col: str = "text") -> DataFrame:
    """The columns `carry` ({name: Column}), lang_pred and score of every row."""
    carry = carry or {"doc_id": F.col("doc_id")}
    base = df.select(*[c.alias(k) for k, c in carry.items()], F.col(text_col).alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    fields = pa_schema(schema + ", lang_pred string, score double")
    names = list(carry)
    shipped = df.sparkSession.sparkContext.broadcast((filters.languages, filters.words, filters.usual))

    def predict(batches):
        own = Filters(*shipped.value)
        for b in batches:
            told, scores = own.predict(b["__text"])
            yield pa.RecordBatch.from_arrays([*(b[k].cast(fields.field(k).type) for k in names), pa.array(told, pa.string()), pa.array(scores)], schema=fields)

    return arrow(base, predict, schema + ", lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    held = id_bucket(F.col("doc_id"), 3) == 1
    filters = learn(docs.where(~held))
    return identify(docs, filters, {"doc_id": F.col("doc_id"), "held_out": held})
