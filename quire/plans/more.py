"""More registered queries: locations, citations, keys, sections, folios, validation, metrics, readers, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import cite as C
from quire.functions import prose as P
from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import metrics as M
from quire.operators import search as S
from quire.operators import units as U
from quire.operators import validate as X
from quire.operators.folios import infer_folios
from quire.plans.queries import _GARBAGE, _TOKENS, _judged, _r, _round, _table
from quire.sources import files
from quire.streaming import library


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as paged documents: a page for each turn, the speaker as its matter of record."""
    t = _table(spark, sf, "conversations")
    page = (F.col("turn") + 1).cast("long")
    anchor = F.to_json(F.struct(F.lit("page").alias("type"), page.alias("physical"), page.cast("string").alias("printed")))
    return t.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("docref"), "conv_id", "turn", "role", "text", anchor.alias("anchor"))


def anchor_uris(spark, sf):
    t = _turns(spark, sf)
    return t.select("conv_id", "turn", U.anchor_uris(F.col("docref"), F.col("anchor")).alias("uri"))


def page_citations(spark, sf):
    item = F.to_json(F.struct(F.lit("interview").alias("type"), F.lit("A talk: notes").alias("title"), F.array(F.struct(F.col("role").alias("literal"))).alias("author")))
    t = _turns(spark, sf)
    return t.select("conv_id", "turn", U.citations(F.col("anchor"), None, item, "es").alias("citation"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as books by their brand, of a year by their size."""
    part = _table(spark, sf, "part")
    item = F.struct(F.lit("book").alias("type"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("family"))).alias("author"), F.struct(F.array(F.array(1900 + F.col("p_size"))).alias("date-parts")).alias("issued"), F.col("p_type").alias("publisher"))
    return part.select("p_partkey", F.col("p_partkey").cast("string").alias("docref"), F.col("p_partkey").alias("place"), F.to_json(item).alias("metadata"))


def export_keys(spark, sf):
    """Bibliographic keys of parts by brand and year, collisions told apart in the order of their number."""
    return C.keys(_parts(spark, sf)).select("p_partkey", "key")


def section_ends(spark, sf):
    t = _turns(spark, sf)
    s = t.select("docref", F.col("turn").cast("string").alias("id"), F.when(F.col("role") == "user", 1).otherwise(2).alias("level"), F.col("turn").alias("start"))
    return U.section_ends(s, t.groupBy("docref").agg(F.max("turn").alias("last_ord")))


def folios(spark, sf):
    t = _turns(spark, sf)
    read = F.when((F.col("turn") * 7 + F.col("conv_id")) % 3 != 0, F.col("turn") + 5)
    return infer_folios(t.select("docref", (F.col("turn") + 1).alias("physical"), read.alias("number"))).withColumn("folio", F.col("folio").cast("string"))


def validation(spark, sf):
    t = _turns(spark, sf)
    docs = t.select("docref").distinct()
    blobs = t.select("docref", F.col("turn").alias("key"), F.col("text").cast("binary").alias("data"), F.sha2(F.when(F.col("turn") % 5 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    order = t.select("docref", F.when(F.col("conv_id") % 4 == 0, F.col("turn") + 2).otherwise(F.col("turn") + 1).alias("ord"))
    out = X.verdicts(docs, X.bad_blobs(blobs), X.bad_order(order))
    return out.select("docref", "valid", F.array_join("errors", ",").alias("errors"), F.size("warnings").alias("n_warnings"))


def spearman(spark, sf):
    docs = _table(spark, sf, "documents").select(F.length("text").alias("chars"), T.count_tokens(F.col("text")).alias("tokens"))
    return M.spearman(docs, "chars", "tokens").select(_round(F.col("spearman")).alias("spearman"), "n")


def calibration(spark, sf):
    return M.calibration_error(_judged(spark, sf), "score", "quality").select(_round(F.col("ece")).alias("ece"), "n")


def _ranked(spark, sf, change) -> DataFrame:
    emb = _table(spark, sf, "embeddings")
    q = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), V.doubles(F.col("embedding")).alias("query"))
    return S.batch_vectors(q.withColumn("query", change(F.col("query"))), emb.select(F.col("vec_id").alias("n"), change(V.doubles(F.col("embedding"))).alias("vector")), 10)


def i8_overlap(spark, sf):
    same = _ranked(spark, sf, lambda v: v)
    small = _ranked(spark, sf, lambda v: F.transform(V.i8(v), lambda x: x / 127))
    return M.overlap(same, small, 10).select(_round(F.col("overlap")).alias("overlap"))


def matryoshka_overlap(spark, sf):
    return M.overlap(_ranked(spark, sf, lambda v: v), _ranked(spark, sf, lambda v: V.truncated(v, 32)), 10).select(_round(F.col("overlap")).alias("overlap"))


def library_first(spark, sf):
    docs = _table(spark, sf, "documents").select(F.sha2("text", 256).alias("docref"), F.col("doc_id").alias("path"), "source")
    return library.first_of_each(docs)


def event_windows(spark, sf):
    out = library.event_counts(_table(spark, sf, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", _round(F.col("total"), 1e2).alias("total"))


def html_units(spark, sf):
    return files.blocks(_table(spark, sf, "pages"), "page_id", "url", "html")


def sentence_counts(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.size(P.split_sentences(F.col("text"))).alias("sentences"))


def passages(spark, sf):
    lines = _table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("docref"), F.lit("").alias("section"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return U.chunks(lines.where("trim(text) <> ''").select("docref", "section", F.col("i").cast("long").alias("i"), "text", T.count_tokens(F.col("text")).alias("tokens")))


def row_hashes(spark, sf):
    """Hashes of rows as canonical JSON."""
    from quire.functions.canonical import json_hash

    return _table(spark, sf, "documents").select("doc_id", json_hash(F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))).alias("sha256"))


QUERIES = {f.__name__: f for f in (anchor_uris, page_citations, export_keys, section_ends, folios, validation, spearman, calibration, i8_overlap, matryoshka_overlap, library_first, event_windows, html_units, sentence_counts, passages, row_hashes)}

_RANK = "(SELECT {x}, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r FROM d)"
_TOP = "SELECT qid, n FROM (SELECT a.vec_id AS qid, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS r FROM {t} a, {t} b WHERE a.vec_id % 20 = 0) WHERE r <= 10"


def _overlap(change: str) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, {change} AS v FROM e),
one AS ({_TOP.format(t='e')}), two AS ({_TOP.format(t='s')})
SELECT {_r('count(*) / (SELECT count(DISTINCT qid) FROM one) / 10.0')} AS overlap FROM one JOIN two USING (qid, n)"""


SQL = {
    "anchor_uris": "SELECT conv_id, turn, 'cite:conv-' || conv_id || '#p=' || (turn + 1) || '&f=' || (turn + 1) AS uri FROM conversations",
    "page_citations": "SELECT conv_id, turn, '(' || role || ', s. f., p. ' || (turn + 1) || ')' AS citation FROM conversations",
    "export_keys": "SELECT p_partkey, g || CASE WHEN n = 1 THEN '' WHEN k <= 26 THEN chr(CAST(96 + k AS INTEGER)) ELSE chr(CAST(97 + (k - 27) // 26 AS INTEGER)) || chr(CAST(97 + (k - 27) % 26 AS INTEGER)) END AS key FROM (SELECT p_partkey, g, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS k FROM (SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || (1900 + p_size) AS g FROM part))",
    "section_ends": "WITH s AS (SELECT 'conv-' || conv_id AS docref, CAST(turn AS VARCHAR) AS id, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS level, turn AS start FROM conversations) SELECT a.docref, a.id, a.level, a.start, coalesce((SELECT min(b.start) - 1 FROM s b WHERE b.docref = a.docref AND b.start > a.start AND b.level <= a.level), (SELECT max(c.start) FROM s c WHERE c.docref = a.docref)) AS \"end\" FROM s a",
    "folios": """WITH p AS (SELECT 'conv-' || conv_id AS docref, turn + 1 AS physical, CASE WHEN (turn * 7 + conv_id) % 3 <> 0 THEN turn + 5 - (turn + 1) END AS d FROM conversations),
h AS (SELECT docref, physical, CASE WHEN (SELECT count(*) FROM p b WHERE b.docref = a.docref AND b.d = a.d AND abs(b.physical - a.physical) <= 4) >= 2 THEN d END AS d FROM p a),
t AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY docref ORDER BY physical ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(d IGNORE NULLS) OVER (PARTITION BY docref ORDER BY physical ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM h)
SELECT docref, physical, CAST(physical + CASE WHEN d IS NOT NULL THEN d WHEN b = f THEN b END AS VARCHAR) AS folio, CASE WHEN d IS NOT NULL THEN 'read' WHEN b = f THEN 'inferred' ELSE 'none' END AS source FROM t""",
    "validation": """WITH c AS (SELECT 'conv-' || conv_id AS docref, max(turn % 5 = 4) AS blob, max(CASE WHEN conv_id % 4 = 0 THEN turn + 2 ELSE turn + 1 END <> rn) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id)
SELECT docref, NOT (blob OR gap) AS valid, concat_ws(',', CASE WHEN blob THEN 'E080' END, CASE WHEN gap THEN 'E090' END) AS errors, CAST(0 AS INTEGER) AS n_warnings FROM c""",
    "spearman": f"WITH d AS (SELECT row_number() OVER () AS i, length(text) AS chars, {_TOKENS} AS tokens FROM documents), r AS (SELECT rank() OVER (ORDER BY chars) + (count(*) OVER (PARTITION BY chars) - 1) / 2.0 AS x, rank() OVER (ORDER BY tokens) + (count(*) OVER (PARTITION BY tokens) - 1) / 2.0 AS y FROM d) SELECT {_r('corr(x, y)')} AS spearman, count(*) AS n FROM r",
    "calibration": f"WITH j AS (SELECT floor((1 - ({_GARBAGE})) * 1e4 + 0.5) / 1e4 AS p, quality AS y FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS k, avg(p) AS p, avg(y) AS y FROM j GROUP BY 1) SELECT {_r('sum(k * abs(p - y)) / sum(k)')} AS ece, CAST(sum(k) AS BIGINT) AS n FROM b",
    "i8_overlap": _overlap("list_transform(v, lambda x: greatest(-127.0, least(127.0, sign(x) * floor(abs(CAST(CAST(x AS FLOAT) AS DOUBLE)) * 127 + 0.5))) / 127)"),
    "matryoshka_overlap": _overlap("list_transform(v[1:32], lambda x: x / sqrt(list_inner_product(v[1:32], v[1:32])))"),
    "library_first": "SELECT sha256(text) AS docref, min(doc_id) AS path, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
    "event_windows": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {_r('sum(value)', '1e2')} AS total FROM events GROUP BY ALL",
}
