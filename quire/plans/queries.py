"""Registered queries over the shared tables, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import corpus as C
from quire.operators import metrics as M
from quire.operators import search as S

QUERY, PHRASE, LITERAL = "license the version", '"the and"', "of the"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _round(x: Column, scale: float = 1e6) -> Column:
    return F.floor(x * scale + 0.5) / scale


def _r(x: str, scale: str = "1e6") -> str:
    return f"floor(({x}) * {scale} + 0.5) / {scale}"


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("source").alias("docref"), F.col("doc_id").alias("n"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("docref"), F.col("vec_id").alias("n"), F.col("embedding").alias("vector"))


QVEC = [((k * 37) % 11 - 5) / 16 for k in range(64)]


def lexical_bm25_or(spark, sf):
    out = S.lexical(_passages(spark, sf), QUERY, 10)
    return out.select("docref", "n", _round(F.col("score")).alias("score"), "rank")


def lexical_bm25_phrase(spark, sf):
    out = S.lexical(_passages(spark, sf), PHRASE, 10)
    return out.select("docref", "n", _round(F.col("score")).alias("score"), "rank")


def lexical_substring(spark, sf):
    out = S._top(S.substring(_passages(spark, sf), LITERAL.split(), False), 10)
    return out.select("docref", "n", "score", "rank")


def vector_topk_dot(spark, sf):
    return S.vector(_vectors(spark, sf), QVEC, 10).select("docref", "n", _round(F.col("score")).alias("score"), "rank")


def vector_topk_cosine(spark, sf):
    return S.vector(_vectors(spark, sf), QVEC, 10, normalized=False).select("docref", "n", _round(F.col("score")).alias("score"), "rank")


def hybrid_rrf(spark, sf):
    """Passages and vectors of equal number; the vector takes its passage's document."""
    passages = _passages(spark, sf)
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("vector")).join(passages.select("docref", "n"), "n")
    out = S.hybrid(passages, vectors, QUERY, QVEC, 10)
    return out.select("docref", "n", _round(F.col("score")).alias("score"), "via", "rank")


def library_fusion(spark, sf):
    out = S.library(S.lexical(_passages(spark, sf), QUERY, 10), 25)
    return out.select("docref", "n", _round(F.col("score")).alias("score"), "rank", "place")


def batch_topk(spark, sf):
    emb = _table(spark, sf, "embeddings")
    queries = emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    out = S.batch_vectors(queries, emb.select(F.col("vec_id").alias("n"), F.col("embedding").alias("vector")), 5)
    return out.select("qid", "n", _round(F.col("score")).alias("score"), "rank")


def quantize_i8_error(spark, sf):
    return C.storage_loss(_table(spark, sf, "embeddings"), "embedding").select("vec_id", _round(F.col("i8_cosine")).alias("i8_cosine"))


def matryoshka_share(spark, sf):
    return C.storage_loss(_table(spark, sf, "embeddings"), "embedding").select("vec_id", _round(F.col("half_share")).alias("half_share"))


def language_vote(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.language_vote(F.col("text")).alias("vote"))


def count_tokens(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


def garbage_ratio(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", _round(T.garbage_ratio(F.col("text"))).alias("garbage"), T.letters(F.col("text")).cast("long").alias("letters"))


def repeated_lines(spark, sf):
    return C.repeated_lines(_table(spark, sf, "documents"), "source", "text", 3)


def exact_dup_keep_first(spark, sf):
    docs = _table(spark, sf, "documents")
    return C.keep_first(docs, [F.col("source"), F.sha2("text", 256)], "doc_id", F.length("text") > 200).select("doc_id", "source")


def html_title_meta(spark, sf):
    return C.html_head(_table(spark, sf, "pages"), "html", ["page_id", "url"])


def find_ids(spark, sf):
    text = F.col("text")
    return _table(spark, sf, "documents").select("doc_id", T.isbn13(text).alias("isbn"), T.isbn10(text).alias("isbn10"), T.arxiv(text).alias("arxiv"), T.doi(text).alias("doi"), F.size(T.emails(text)).cast("long").alias("emails"))


def conversation_contiguity(spark, sf):
    return C.contiguity(_table(spark, sf, "conversations"), "conv_id", "turn", 0)


def neighbours(spark, sf):
    out = C.neighbours(_table(spark, sf, "conversations"), "conv_id", "turn", "role")
    return out.select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def speaker_share(spark, sf):
    out = C.leading_speaker(_table(spark, sf, "conversations"), "conv_id", "role", F.length("text"))
    return out.select("conv_id", "speaker", _round(F.col("share")).alias("share"))


def sheet_blocks(spark, sf):
    orders = _table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("row"), "n_nationkey", "n_name", "n_regionkey")
    out = C.sheet_blocks(orders, "row", ["n_nationkey", "n_name", "n_regionkey"], 10)
    return out.select(F.col("block").cast("long").alias("block"), F.col("row_from").cast("long").alias("row_from"), F.col("row_to").cast("long").alias("row_to"), "body")


def _judged(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", _round(1 - T.garbage_ratio(F.col("text")), 1e4).alias("score"))
    return docs.join(_table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def rank_metrics(spark, sf):
    rows = _judged(spark, sf)
    both = C.auc(rows, "score", "quality").crossJoin(C.brier(rows, "score", "quality"))  # one row each
    return both.select("positives", "negatives", _round(F.col("auc")).alias("auc"), _round(F.col("brier")).alias("brier"), "n")


def _earlier(spark, sf):
    """Benchmark texts with the one before, as a transcription and its reference."""
    items = _table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    return items.join(items.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("reference")), "item_id")


def cer_levenshtein(spark, sf):
    """Error rate by character of benchmark texts against those before them."""
    return M.character_error(_earlier(spark, sf), "text", "reference").select(_round(F.col("cer")).alias("cer"))


def content_hash_rows(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def library_summary(spark, sf):
    return C.summary(_table(spark, sf, "documents"), "source", "text")


def dice_similarity(spark, sf):
    """Each benchmark text and the next."""
    items = _table(spark, sf, "benchmark")
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return C.dice_pairs(items.join(nxt, "item_id"), "item_id", "text", "other").select("item_id", _round(F.col("dice")).alias("dice"))


def page_positions(spark, sf):
    """Space-separated words of each text, cut from it again by code points at a third of its length."""
    third = F.floor(F.length("text") / 3).cast("int")
    return _table(spark, sf, "documents").select("doc_id", F.substring(F.col("text"), third + 1, F.lit(24)).alias("piece"), F.length("text").cast("long").alias("size"))


QUERIES = {f.__name__: f for f in (lexical_bm25_or, lexical_bm25_phrase, lexical_substring, vector_topk_dot, vector_topk_cosine, hybrid_rrf, library_fusion, batch_topk, quantize_i8_error, matryoshka_share, language_vote, count_tokens, garbage_ratio, repeated_lines, exact_dup_keep_first, html_title_meta, find_ids, conversation_contiguity, neighbours, speaker_share, sheet_blocks, rank_metrics, cer_levenshtein, content_hash_rows, library_summary, dice_similarity, page_positions)}


# -- the same in DuckDB SQL ------------------------------------------------------------------------------------------


def _fold_sql(x: str) -> str:
    a, b = T._latin()
    return f"translate(lower(regexp_replace({x}, '\\p{{Mn}}', '', 'g')), '{a}', '{b}')"


def _bm25(tf: dict[str, str], every: bool, limit: int = 10) -> str:
    """CTEs up to `ranked` (docref, n, score, rank) from frequency expressions over the array `toks`."""
    hit = (" AND " if every else " OR ").join(f"{k} > 0" for k in tf)
    score = " + ".join(f"(CASE WHEN ln((total - d_{k} + 0.5) / (d_{k} + 0.5)) <= 0 THEN {S.FLOOR} ELSE ln((total - d_{k} + 0.5) / (d_{k} + 0.5)) END) * ({k} * {S.K1 + 1}) / ({k} + {S.K1} * (1 - {S.B} + {S.B} * size / mean))" for k in tf)
    return f"""
toks AS (SELECT source AS docref, doc_id AS n, regexp_extract_all({_fold_sql('text')}, '[\\p{{L}}\\p{{N}}]+') AS toks FROM documents),
counted AS (SELECT docref, n, len(toks) AS size, {', '.join(f'CAST({x} AS DOUBLE) AS {k}' for k, x in tf.items())} FROM toks),
stats AS (SELECT docref, count(*) AS total, avg(size) AS mean, {', '.join(f'count(*) FILTER ({k} > 0) AS d_{k}' for k in tf)} FROM counted GROUP BY docref),
scored AS (SELECT docref, n, {score} AS score FROM counted JOIN stats USING (docref) WHERE {hit}),
ranked_{limit} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY docref ORDER BY score DESC, n) AS INTEGER) AS rank FROM scored) WHERE rank <= {limit})"""


def _terms() -> dict[str, str]:
    return {f"f{i}": f"len(list_filter(toks, lambda t: t = '{w}'))" for i, w in enumerate(QUERY.split())}


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


_Q = "CAST([" + ", ".join(map(repr, QVEC)) + "] AS DOUBLE[])"
_V = "CAST(embedding AS DOUBLE[])"


def _vec(score: str) -> str:
    return f"SELECT docref, n, {_r('score')} AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY docref ORDER BY score DESC, n) AS INTEGER) AS rank FROM (SELECT CAST(label AS VARCHAR) AS docref, vec_id AS n, {score} AS score FROM embeddings)) WHERE rank <= 10"


_LETTERS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
_GARBAGE = f"CASE WHEN length(text) = 0 THEN 1.0 ELSE least(1.0, len(regexp_extract_all(text, '{T.BROKEN}')) * {T.BROKEN_WEIGHT} / CAST(length(text) AS DOUBLE) + CASE WHEN {_LETTERS} / CAST(length(text) AS DOUBLE) < {T.FEW_LETTERS} THEN {T.FEW_LETTERS_COST} ELSE 0.0 END) END"
_I8 = f"list_transform({_V}, lambda x: greatest(-127.0, least(127.0, sign(x) * floor(abs(CAST(CAST(x AS FLOAT) AS DOUBLE)) * 127 + 0.5))) / 127)"
_TOKENS = r"CAST(greatest(ceil(length(text) / 4.0), floor((len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 13 + 9) / 10.0)) AS BIGINT)"


def _votes() -> str:
    words = "regexp_extract_all(lower(text), '\\p{L}+')[1:20000]"
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in sorted(set(v)))}))) AS {k}_" for k, v in T.STOP_WORDS.items())
    pick = " ".join(f"WHEN {k}_ = best THEN '{k}'" for k in T.STOP_WORDS)
    return f"SELECT doc_id, CASE WHEN n >= 20 AND best >= 5 AND best * 100 >= n * 8 THEN CASE {pick} END END AS vote FROM (SELECT *, greatest({', '.join(k + '_' for k in T.STOP_WORDS)}) AS best FROM (SELECT doc_id, len(w) AS n, {counts} FROM (SELECT doc_id, {words} AS w FROM documents)))"


_META = lambda name: f"nullif(regexp_extract(html, '<meta\\s+name=[\"'']{name}[\"'']\\s+content=[\"'']([^\"'']*)[\"'']', 1), '')"
_ISBN = "list_filter(list_transform(regexp_extract_all(text, '97[89][0-9-]{10,14}'), lambda x: replace(x, '-', '')), lambda x: length(x) = 13 AND list_sum(list_transform(range(1, 14), lambda i: CAST(substr(x, i, 1) AS INTEGER) * (1 + 2 * ((i + 1) % 2)))) % 10 = 0)[1]"
_ISBN10 = "list_filter(list_transform(regexp_extract_all(text, '(?i)ISBN(?:-10)?:?\\s*((?:[0-9][ -]?){9}[0-9Xx])', 1), lambda x: upper(regexp_replace(x, '[ -]', '', 'g'))), lambda x: list_sum(list_transform(range(1, 11), lambda i: (11 - i) * CASE WHEN substr(x, i, 1) = 'X' THEN 10 ELSE CAST(substr(x, i, 1) AS INTEGER) END)) % 11 = 0)[1]"


def _flat(x: str) -> str:
    return f"regexp_replace({_fold_sql(x)}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_PAIR = {"f0": "len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'the' AND toks[i + 1] = 'and'))"}

SQL = {
    "lexical_bm25_or": f"WITH {_bm25(_terms(), False)} SELECT docref, n, {_r('score')} AS score, rank FROM ranked_10",
    "lexical_bm25_phrase": f"WITH {_bm25(_PAIR, True)} SELECT docref, n, {_r('score')} AS score, rank FROM ranked_10",
    "lexical_substring": f"SELECT docref, n, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY docref ORDER BY score DESC, n) AS INTEGER) AS rank FROM (SELECT source AS docref, doc_id AS n, CAST({' + '.join(f'(CASE WHEN contains(text, {w!r}) THEN 1 ELSE 0 END)' for w in LITERAL.split())} AS DOUBLE) AS score FROM documents) WHERE score >= 1) WHERE rank <= 10",
    "vector_topk_dot": _vec(_dot(_V, _Q)),
    "vector_topk_cosine": _vec(f"{_dot(_V, _Q)} / (sqrt({_dot(_V, _V)}) * sqrt({_dot(_Q, _Q)}))"),
    "hybrid_rrf": f"""WITH {_bm25(_terms(), False, 50)},
vec AS (SELECT source AS docref, vec_id AS n, row_number() OVER (PARTITION BY source ORDER BY {_dot(_V, _Q)} DESC, vec_id) AS rank FROM embeddings JOIN documents ON vec_id = doc_id),
parts AS (SELECT docref, n, 0 AS place, 'lexical' AS method, 1.0 / CAST({S.RRF} + rank AS DOUBLE) AS share FROM ranked_50 UNION ALL SELECT docref, n, 1, 'vector', 1.0 / CAST({S.RRF} + rank AS DOUBLE) FROM vec WHERE rank <= 50),
fused AS (SELECT docref, n, sum(share ORDER BY place) AS score, string_agg(method, '+' ORDER BY place) AS via FROM parts GROUP BY ALL)
SELECT docref, n, {_r('score')} AS score, via, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY docref ORDER BY score DESC, n) AS INTEGER) AS rank FROM fused) WHERE rank <= 10""",
    "library_fusion": f"WITH {_bm25(_terms(), False)} SELECT docref, n, {_r('score')} AS score, rank, place FROM (SELECT *, CAST(row_number() OVER (ORDER BY rank, score DESC, docref, n) AS INTEGER) AS place FROM ranked_10) WHERE place <= 25",
    "batch_topk": f"SELECT qid, n, {_r('score')} AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, n) AS INTEGER) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS n, list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5",
    "quantize_i8_error": f"SELECT vec_id, {_r(f'list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))')} AS i8_cosine FROM (SELECT vec_id, {_V} AS v, {_I8} AS q FROM embeddings)",
    "matryoshka_share": f"SELECT vec_id, {_r('sqrt(list_inner_product(v[1:32], v[1:32])) / sqrt(list_inner_product(v, v))')} AS half_share FROM (SELECT vec_id, {_V} AS v FROM embeddings)",
    "language_vote": _votes(),
    "count_tokens": f"SELECT doc_id, {_TOKENS} AS n_tokens FROM documents",
    "garbage_ratio": f"SELECT doc_id, {_r(_GARBAGE)} AS garbage, {_LETTERS} AS letters FROM documents",
    "repeated_lines": "SELECT source, line, count(*) AS times FROM (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY ALL HAVING count(*) >= 3",
    "exact_dup_keep_first": "SELECT doc_id, source FROM (SELECT doc_id, source, length(text) AS k, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR k <= 200",
    "html_title_meta": f"SELECT page_id, url, nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '') AS title, {_META('description')} AS description, {_META('author')} AS author FROM pages",
    "find_ids": f"SELECT doc_id, {_ISBN} AS isbn, {_ISBN10} AS isbn10, nullif(regexp_extract(text, 'arXiv:\\s?([0-9]{{4}}\\.[0-9]{{4,5}})(?:v[0-9]+)?', 1), '') AS arxiv, nullif(regexp_extract(text, '(10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9])', 1), '') AS doi, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS emails FROM documents",
    "conversation_contiguity": "SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id",
    "neighbours": "SELECT conv_id, turn, coalesce(lag(role) OVER w, '') AS before, coalesce(lead(role) OVER w, '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "speaker_share": f"SELECT conv_id, role AS speaker, {_r('w / total')} AS share FROM (SELECT conv_id, role, CAST(w AS DOUBLE) AS w, sum(w) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY w DESC, role) AS r FROM (SELECT conv_id, role, sum(length(text)) AS w FROM conversations GROUP BY ALL)) WHERE r = 1",
    "sheet_blocks": "SELECT CAST(n_nationkey // 10 AS BIGINT) AS block, CAST(min(n_nationkey) + 2 AS BIGINT) AS row_from, CAST(max(n_nationkey) + 2 AS BIGINT) AS row_to, string_agg(concat_ws(' | ', n_nationkey, n_name, n_regionkey), chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY 1",
    "rank_metrics": f"WITH j AS (SELECT floor((1 - ({_GARBAGE})) * 1e4 + 0.5) / 1e4 AS s, quality AS y FROM documents JOIN labels USING (doc_id)), by_s AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM j GROUP BY s), b AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_s) SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, {_r('CAST(sum(p * (below + q / 2.0)) AS DOUBLE) / (sum(p) * sum(q))')} AS auc, (SELECT {_r('avg((s - y) ** 2)')} FROM j) AS brier, (SELECT count(*) FROM j) AS n FROM b",
    "cer_levenshtein": f"WITH i AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM benchmark) SELECT {_r('sum(levenshtein(a.text, b.text)) / CAST(sum(length(b.text)) AS DOUBLE)')} AS cer FROM i a JOIN i b ON a.item_id = b.item_id + 1",
    "content_hash_rows": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "library_summary": f"SELECT source, CAST(sum(k) AS BIGINT) AS passages, CAST(sum(c) AS BIGINT) AS characters, min(t) FILTER (upto > total // 2) AS median_tokens, max(t) AS max_tokens FROM (SELECT source, t, k, c, sum(k) OVER (PARTITION BY source ORDER BY t) AS upto, sum(k) OVER (PARTITION BY source) AS total FROM (SELECT source, {_TOKENS} AS t, count(*) AS k, sum(length(text)) AS c FROM documents GROUP BY ALL)) GROUP BY source",
    "dice_similarity": f"""WITH p AS (SELECT a.item_id, a.t AS x, b.t AS y FROM (SELECT item_id, {_flat('text')} AS t FROM benchmark) a JOIN (SELECT item_id, {_flat('text')} AS t FROM benchmark) b ON b.item_id = a.item_id + 1),
g AS (SELECT item_id, substr(t, i, 2) AS g, side FROM (SELECT item_id, x AS t, 0 AS side, unnest(range(1, length(x))) AS i FROM p UNION ALL SELECT item_id, y, 1, unnest(range(1, length(y))) FROM p)),
c AS (SELECT item_id, sum(least(m, n)) AS common FROM (SELECT item_id, g, count(*) FILTER (side = 0) AS m, count(*) FILTER (side = 1) AS n FROM g GROUP BY ALL) GROUP BY item_id)
SELECT item_id, {_r("CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 ELSE 2 * coalesce(common, 0) / CAST(length(x) + length(y) - 2 AS DOUBLE) END")} AS dice FROM p LEFT JOIN c USING (item_id)""",
    "page_positions": "SELECT doc_id, substr(text, CAST(floor(length(text) / 3.0) AS INTEGER) + 1, 24) AS piece, length(text) AS size FROM documents",
}
