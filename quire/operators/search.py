"""Search over passages (docref, n, text, ...): lexical (BM25), substring, vector, hybrid and library search.

Statistics are those of each document (docref). Queries are parsed once on the driver; scoring is one pass over the
passages, or over the postings of the query's terms alone if there is an Index, an aggregate by document, and a top-k
window with a partial limit before its shuffle.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import anchors as A
from quire.functions import text as T
from quire.functions import vectors as V

K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF = 10
WEIGHTS = {"text": 1.0, "context": 0.5, "section": 0.5, "search_text": 1.0}  # of the columns of a full index
# Phrases between quotation marks, words, and blocks of Chinese, Japanese and Korean letters.
PHRASE = re.compile("[\"“«]([^\"”»]*)[\"”»]|„([^“”]*)[“”]")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
CJK = "⺀-⿟぀-ヿ㄀-ㄯ㄰-㆏ㆠ-ㇿ㐀-䶿一-鿿ꥠ-꥿가-힯豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"


def _unmarked(text: str) -> str:
    return regex.sub(r"\p{Mn}", "", unicodedata.normalize("NFD", text)).lower()


def parse(query: str) -> tuple[list[str], bool]:
    """Terms, and whether all of them are needed (phrases) or any will do (words)."""
    q = unicodedata.normalize("NFC", query)
    quoted = [" ".join(WORD.findall("".join(m.groups("")))) for m in PHRASE.finditer(q)]
    phrases = list(filter(None, quoted))
    first = {}
    for term in phrases or WORD.findall(q):
        first.setdefault(_unmarked(term), term)
    return list(first.values()), bool(phrases)


def route(query: str, trigram: bool = False) -> str:
    """`none`, `fts`, `trigram` or `substring`."""
    terms, _ = parse(query)
    if not terms:
        return "none"
    if not re.search(f"[{CJK}]", unicodedata.normalize("NFC", query)):
        return "fts"
    return "trigram" if trigram and min(map(len, terms)) >= 3 else "substring"


def match(query: str) -> str:
    """The match string of a full-text index."""
    terms, every = parse(query)
    return (" AND " if every else " OR ").join('"' + t.replace('"', '""') + '"' for t in terms)


def _fold(term: str) -> list[str]:
    """The tokens of a term as the index has them."""
    return regex.findall(r"[\p{L}\p{N}]+", _unmarked(term))


def _occurrences(line: Column, phrase: list[str]) -> Column:
    """How often a phrase starts in a token line, overlaps included."""
    rest = "".join(f" {re.escape(t)}" for t in phrase[1:])
    return F.regexp_count(line, F.lit(f"(?<= ){re.escape(phrase[0])}(?={rest} )"))


def lexical(passages: DataFrame, query: str, limit: int, columns: dict[str, float] | None = None, trigram: bool = False) -> DataFrame:
    """The best passages of each document: docref, n, score, rank. `columns`: searched columns and their weights."""
    columns = columns or {"text": 1.0}
    terms, every = parse(query)
    by = route(query, trigram)
    if by == "none":
        return passages.where("false").select("docref", "n", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    if by == "substring":
        return _top(substring(passages, terms, every), limit)
    if by == "trigram":
        lines = {"text": F.lower(F.coalesce(F.col("text"), F.lit("")))}
        columns, sizes = {"text": 1.0}, [F.greatest(F.length(lines["text"]) - 2, F.lit(0))]
        count = lambda line, t: F.regexp_count(line, F.lit(f"(?={re.escape(t.lower())})"))
    else:
        lines = {c: T.token_line(F.col(c)) for c in columns}
        sizes = [T.token_count(line) for line in lines.values()]
        terms = [p for p in map(_fold, terms) if p]
        count = _occurrences
    tf = [sum((F.lit(w) * count(lines[c], p) for c, w in columns.items()), F.lit(0.0)).alias(f"f{i}") for i, p in enumerate(terms)]
    counted = passages.select("docref", "n", sum(sizes, F.lit(0)).alias("size"), *tf)
    stats = counted.groupBy("docref").agg(F.count("*").alias("total"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    return _ranked(counted.join(stats, "docref"), len(terms), every, limit)


def _ranked(counted: DataFrame, n: int, every: bool, limit: int) -> DataFrame:
    """Top lists by BM25 from total, mean, size, and the frequencies f and document frequencies d of n terms."""
    has = [F.col(f"f{i}") > 0 for i in range(n)]
    hit = F.lit(every)
    for h in has:
        hit = (hit & h) if every else (hit | h)
    score = F.lit(0.0)
    for i in range(n):
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.ln((F.col("total") - d + 0.5) / (d + 0.5))
        score = score + F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return _top(counted.where(hit).select("docref", "n", score.alias("score")), limit)


class Index:
    """Postings of passages as tables: a query reads those of its terms, not the texts.

    postings (bucket, term, docref, n, column, positions) lie in folders by bucket of the term and are sorted by term;
    sizes (docref, n, size) has the length of each passage over all columns, documents (docref, total, mean) the sums."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, float], buckets: int):
        self.columns, self.buckets = columns, buckets
        self.postings, self.sizes, self.documents = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "sizes", "documents"))

    @classmethod
    def write(cls, passages: DataFrame, path: str, columns: dict[str, float] | None = None, buckets: int = 64) -> Index:
        columns = columns or {"text": 1.0}
        of = F.array(*[F.struct(F.lit(c).alias("column"), T.tokens(F.col(c)).alias("tokens")) for c in columns])
        words = passages.select("docref", "n", F.explode(of).alias("c")).select("docref", "n", "c.column", F.posexplode("c.tokens").alias("pos", "term"))
        held = words.groupBy("term", "docref", "n", "column").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        dealt = held.withColumn("bucket", bucket).repartition("bucket", "docref").sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        sizes = passages.select("docref", "n", sum((T.token_count(T.token_line(F.col(c))) for c in columns), F.lit(0)).cast("long").alias("size"))
        sizes.write.mode("overwrite").parquet(f"{path}/sizes")
        spark = passages.sparkSession
        spark.read.parquet(f"{path}/sizes").groupBy("docref").agg(F.count("*").alias("total"), F.avg("size").alias("mean")).write.mode("overwrite").parquet(f"{path}/documents")
        return cls(spark, path, columns, buckets)

    def lexical(self, query: str, limit: int) -> DataFrame:
        """The best passages of each document, as lexical() has them without an index (words and phrases)."""
        terms, every = parse(query)
        phrases = [p for p in map(_fold, terms) if p]
        if not phrases:
            return self.sizes.where("false").select("docref", "n", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        words = sorted({t for p in phrases for t in p})
        rows = self.postings.sparkSession.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).alias(f"b{i}") for i, t in enumerate(words)]).first()
        wanted = self.postings.where(F.col("bucket").isin(sorted({int(b) for b in rows})) & F.col("term").isin(words))
        by = wanted.groupBy("docref", "n", "column").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(words)])
        at = {t: F.coalesce(F.col(f"p{i}"), F.array().cast("array<int>")) for i, t in enumerate(words)}

        def starts(phrase: list[str]) -> Column:
            back = lambda t, k: F.transform(at[t], lambda x: x - k)
            out = at[phrase[0]]
            for k, t in enumerate(phrase[1:], 1):
                out = F.array_intersect(out, back(t, k))
            return F.size(out)

        weight = F.lit(0.0)
        for c, w in self.columns.items():
            weight = F.when(F.col("column") == c, F.lit(w)).otherwise(weight)
        found = by.select("docref", "n", *[(weight * starts(p)).alias(f"f{i}") for i, p in enumerate(phrases)])
        summed = found.groupBy("docref", "n").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(phrases))])
        df = summed.groupBy("docref").agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(phrases))])
        counted = summed.join(self.sizes, ["docref", "n"]).join(self.documents, "docref").join(df, "docref")
        return _ranked(counted, len(phrases), every, limit)


def substring(passages: DataFrame, terms: list[str], every: bool) -> DataFrame:
    """Passages that hold any or all of the terms literally; the score is how many."""
    hits = sum((F.when(F.contains(F.col("text"), F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return passages.select("docref", "n", hits.cast("double").alias("score")).where(F.col("score") >= (len(terms) if every else 1))


def _top(scored: DataFrame, limit: int, part: str = "docref", tie: str = "n") -> DataFrame:
    order = Window.partitionBy(part).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def vector(vectors: DataFrame, query: list[float], limit: int, normalized: bool = True, part: str = "docref", tie: str = "n") -> DataFrame:
    """The best vectors of each document: docref, n, score, rank. Vectors of another length raise an error."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = V.doubles(F.col("vector"))
    v = F.when(F.size(v) == len(query), v).otherwise(F.raise_error(F.lit("a vector of another length")))
    return _top(vectors.select(part, tie, (V.dot(v, q) if normalized else V.cosine(v, q)).alias("score")), limit, part, tie)


def fuse(lists: dict[str, DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: docref, n, score, via (methods in the given order), rank."""
    union = None
    for i, (name, ranked) in enumerate(lists.items()):
        part = ranked.select("docref", "n", F.lit(i).alias("place"), F.lit(name).alias("method"), (1.0 / (RRF + F.col("rank"))).alias("share"))
        union = part if union is None else union.unionByName(part)
    both = union.groupBy("docref", "n").agg(F.array_sort(F.collect_list(F.struct("place", "method", "share"))).alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["share"])
    return _top(both.select("docref", "n", score.alias("score"), F.array_join(F.col("parts.method"), "+").alias("via")), limit)


def hybrid(passages: DataFrame, vectors: DataFrame, text: str, query: list[float], limit: int) -> DataFrame:
    depth = max(limit, 50)
    return fuse({"lexical": lexical(passages, text, depth), "vector": vector(vectors, query, depth)}, limit)


def searched(passages: DataFrame, vectors: DataFrame | None, text: str, query: list[float] | None, limit: int) -> DataFrame:
    """Hybrid search where a document has vectors and there is a query vector, lexical search elsewhere: docref, n, score,
    via, rank and why the words alone decided (null if they did not)."""
    if vectors is None or query is None:
        reason = "no query vector" if query is None else "no vectors"
        return lexical(passages, text, limit).select("docref", "n", "score", F.lit("lexical").alias("via"), "rank", F.lit(reason).alias("fallback"))
    having = vectors.select("docref").distinct()
    both = hybrid(passages.join(having, "docref", "left_semi"), vectors, text, query, limit).withColumn("fallback", F.lit(None).cast("string"))
    alone = lexical(passages.join(having, "docref", "left_anti"), text, limit).withColumn("via", F.lit("lexical")).withColumn("fallback", F.lit("no vectors"))
    return both.unionByName(alone.select(both.columns))


def library(ranked: DataFrame, limit: int) -> DataFrame:
    """One list over all documents from each document's own list: by 1 / (RRF + rank), own score, docref, n."""
    order = [F.desc("fused"), F.desc("score"), "docref", "n"]
    best = ranked.withColumn("fused", 1.0 / (RRF + F.col("rank"))).orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most `limit` rows


def items(ranked: DataFrame, fragments: DataFrame, via: Column | None = None, scheme: str = A.SCHEME) -> DataFrame:
    """Result items of ranked passages: docref, rank, fragment_id, score, via, anchor, anchor_uri. Only these passages'
    rows of `fragments` (docref, n, id, anchor, anchor_end) are read into the join."""
    via = via if via is not None else (F.col("via") if "via" in ranked.columns else F.lit("lexical"))
    held = fragments.select("docref", "n", F.col("id").alias("fragment_id"), "anchor", "anchor_end")
    met = ranked.select("docref", "n", "rank", "score", F.split(via, r"\+").alias("via")).join(held, ["docref", "n"])
    uri = A.uri(F.col("docref"), A.parsed(F.col("anchor")), A.parsed(F.col("anchor_end")), scheme)
    return met.select("docref", "rank", "fragment_id", "score", "via", "anchor", uri.alias("anchor_uri"))


# -- many query vectors ----------------------------------------------------------------------------------------------

BLOCK = 2048  # vectors of a block
SIDE = 8  # blocks of each side that meet in a task


def _blocks(id_col: str, vec_col: str):
    fields = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

    def cut(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            b = pa.Table.from_batches([b]).filter(pa.compute.is_valid(b["v"])).combine_chunks()
            sizes = b["v"].combine_chunks().value_lengths().to_numpy() if b.num_rows else np.empty(0, int)
            for dims in np.unique(sizes):
                some = b.filter(pa.array(sizes == dims))
                flat = some["v"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, max(1, int(dims)))
                ids = some["id"].to_numpy()
                for k in range(0, len(ids), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([int(dims)], pa.int32()), pa.array([ids[k : k + BLOCK].tobytes()], pa.binary()), pa.array([flat[k : k + BLOCK].tobytes()], pa.binary())], schema=fields)
                    made += 1

    return cut


def batch_vectors(queries: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Top lists of many query vectors (qid, query) over vectors (n, vector) of the same length: qid, n, score, rank.

    Blocks of both sides meet by an equi-join on dealt numbers, as many as their counts ask for; each meeting is one
    table of scores that keeps its best `limit` of each query."""
    schema = "block long, dims int, ids binary, data binary"
    some_q = queries.select(F.col("qid").cast("long").alias("id"), V.doubles(F.col("query")).alias("v"))
    some_v = vectors.select(F.col("n").cast("long").alias("id"), V.doubles(F.col("vector")).alias("v"))
    n_q, n_v = (max(1, -(-x.count() // (BLOCK * SIDE))) for x in (some_q, some_v))
    mine = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = some_q.mapInArrow(_blocks("qid", "query"), schema).select(mine(n_q).alias("g"), every(n_v).alias("p"), "dims", F.col("ids").alias("qi"), F.col("data").alias("qd"))
    v = some_v.mapInArrow(_blocks("n", "vector"), schema).select(every(n_q).alias("g"), mine(n_v).alias("p"), "dims", "ids", "data")
    fields = pa.schema([("qid", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

    def search(batches):
        for b in batches:
            for x in b.to_pylist():
                d = max(1, x["dims"])
                qi, ids = np.frombuffer(x["qi"], np.int64), np.frombuffer(x["ids"], np.int64)
                left, right = np.frombuffer(x["qd"]).reshape(-1, d), np.ascontiguousarray(np.frombuffer(x["data"]).reshape(-1, d).T)
                s = np.zeros((len(qi), len(ids)))
                for k in range(d):  # in the order of the components, so equal vectors score alike wherever they stand
                    s += left[:, k, None] * right[k][None]
                for r, own in enumerate(qi):
                    edge = np.partition(s[r], len(ids) - limit)[len(ids) - limit] if len(ids) > limit else -np.inf
                    pick = np.flatnonzero(s[r] >= edge)
                    pick = pick[np.lexsort((ids[pick], -s[r, pick]))][:limit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), own)), pa.array(ids[pick]), pa.array(s[r, pick])], schema=fields)

    met = v.join(q, ["g", "p", "dims"]).mapInArrow(search, "qid long, n long, score double")
    return _top(met, limit, "qid")
