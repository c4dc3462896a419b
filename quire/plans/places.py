"""Registered queries over places in documents: URIs, locations, citations, exports, containers, folios, metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import anchors as A
from quire.functions import canonical as K
from quire.functions import cite as C
from quire.functions import vectors as V
from quire.operators import export as E
from quire.operators import folios as P
from quire.operators import metrics as M
from quire.operators import resolve as R
from quire.operators import search as S
from quire.operators import units as U
from quire.operators import validate as X
from quire.plans.more import _parts, _ranked
from quire.plans.queries import PHRASE, QUERY, _bm25, _fold_sql, _judged, _passages, _r, _round, _table, _PAIR, _terms
from quire.sources import container


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").withColumn("docref", F.concat(F.lit("conv-"), F.col("conv_id")))


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), {"ignoreNullFields": "false"})


def _shapes() -> Column:
    """An anchor of each type, by turn."""
    n = F.col("turn").cast("long")
    kinds = [
        _json(type=F.lit("page"), physical=n + 1, printed=(n + 3).cast("string")),
        _json(type=F.lit("page"), physical=n + 1, printed=F.lit(None).cast("string")),
        _json(type=F.lit("time"), t0=n * 1.5, t1=n * 1.5 + 2),
        _json(type=F.lit("section"), path=F.array("role", F.lit("a b/c")), paragraph=n),
        _json(type=F.lit("slide"), n=n + 1),
        _json(type=F.lit("sheet"), sheet=F.lit("Data 1"), row_from=n, row_to=n + 5),
        _json(type=F.lit("verse"), line_from=n, line_to=n + 2),
        _json(type=F.lit("canonical"), scheme=F.lit("cts"), ref=F.concat(F.lit("x:"), n.cast("string"))),
    ]
    out = F.lit(None).cast("string")
    for k, x in enumerate(kinds):
        out = F.when(n % 8 == k, x).otherwise(out)
    return out


def uri_round_trip(spark, sf):
    """URIs of anchors of every type, read and written again."""
    t = _turns(spark, sf).select("conv_id", "turn", A.uri(F.col("docref"), A.parsed(_shapes())).alias("uri"))
    back = t.withColumn("p", A.parse_uri(F.col("uri")))
    return back.select("conv_id", "turn", "uri", (A.format_uri(F.col("p.docref"), F.col("p.locator")) == F.col("uri")).alias("same"), F.col("p.error").alias("error"))


def uri_errors(spark, sf):
    """What is wrong with broken URIs."""
    n = F.col("turn")
    bad = ["http:x", "cite:#p=1", "cite:a#p=0", "cite:a#p=1&p=2", "cite:a#char=5,2", "cite:a#f=%E9", "cite:a#t=9,3", "cite:a#xywh=1,2,3,4", "cite:a#t=1:2", "cite:a#zz=1"]
    uri = F.element_at(F.array(*map(F.lit, bad)), (n % len(bad) + 1).cast("int"))
    return _table(spark, sf, "conversations").select("conv_id", "turn", A.parse_uri(uri)["error"].alias("error"))


def _book(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Conversations as paged documents, with a passage for each turn; every third goes on to the next page."""
    t = _turns(spark, sf)
    page = lambda k: _json(type=F.lit("page"), physical=(F.col("turn") + k).cast("long"), printed=F.when((F.col("turn") + k) % 4 != 0, (F.col("turn") + k).cast("string")), source=F.when((F.col("turn") + k) % 5 == 0, "inferred").otherwise("read"))
    printed = F.when((F.col("turn") + 1) % 4 != 0, (F.col("turn") + 1).cast("string"))
    units = t.select("docref", "conv_id", F.concat(F.lit("u"), "turn").alias("id"), (F.col("turn") + 1).alias("ord"), page(1).alias("anchor"), printed.alias("printed"), "text")
    fragments = t.select("docref", F.concat(F.lit("f"), "turn").alias("id"), (F.col("turn") + 1).alias("n"), F.concat(F.lit("u"), "turn").alias("unit"), page(1).alias("anchor"), F.when(F.col("turn") % 3 == 0, page(2)).alias("anchor_end"), "text")
    return units, fragments


def page_locations(spark, sf):
    """Every page by its URI: the unit there, and the passages that begin or end there."""
    units, fragments = _book(spark, sf)
    refs = units.select("docref", F.concat(F.lit("cite:"), "docref", F.lit("#p="), "ord").alias("reference"))
    out = U.locate(units, fragments, refs)
    return out.select("docref", "reference", F.array_join("units", ",").alias("units"), F.array_join("fragments", ",").alias("fragments"), "error")


def quotes_cited(spark, sf):
    """A piece of every turn, cited where it stands."""
    units, fragments = _book(spark, sf)
    items = units.select("docref", F.to_json(F.struct(F.lit("interview").alias("type"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string"), F.lit(": notes")).alias("title"))).alias("metadata")).distinct()
    quotes = fragments.where(F.length("text") > 30).select("docref", F.col("id").alias("fragment"), F.substring("text", 8, 20).alias("quote"))
    return U.cite_passages(quotes, units, fragments, items).select("docref", "fragment", "text", "uri", "error")


def passages_read(spark, sf):
    """Pages by folio, one more than there are: text, citation and warnings, or an error."""
    units, fragments = _book(spark, sf)
    docs = units.select("docref").distinct().select("docref", F.lit('{"type": "book", "title": "T", "issued": {"date-parts": [[1900]]}}').alias("metadata"))
    asked = units.select("docref", "ord").unionByName(units.groupBy("docref").agg((F.max("ord") + 1).alias("ord")))
    none = F.lit(None)
    requests = asked.select("docref", none.cast("string").alias("fragment_id"), F.col("ord").cast("string").alias("folio"), none.cast("long").alias("page"), none.cast("double").alias("time"))
    out = U.read_passages(requests, units, fragments, docs)
    return out.select("docref", "folio", "unit_id", "citation", F.array_join("warnings", "; ").alias("warnings"), "error")


def folio_queries(spark, sf):
    """What readers' ways of naming a page mean."""
    n = (F.col("turn") + 1).cast("string")
    forms = [n, F.concat(F.lit("p. "), n), F.concat(F.lit("["), n, F.lit("]")), F.concat(F.lit("#"), n), F.concat(F.lit("p="), n, F.lit("-"), n), F.concat(F.lit("f=x"), n), F.lit("#0"), F.lit(" ")]
    text = F.element_at(F.array(*forms), (F.col("turn") % len(forms) + 1).cast("int"))
    out = _table(spark, sf, "conversations").select("conv_id", "turn", U.folio_query(text).alias("q"))
    return out.select("conv_id", "turn", "q.kind", F.col("q.first").cast("string").alias("first"), F.col("q.last").cast("string").alias("last"), "q.value")


def result_items(spark, sf):
    """The best passages with their places."""
    docs = _table(spark, sf, "documents")
    fragments = docs.select(F.col("source").alias("docref"), F.col("doc_id").alias("n"), F.concat(F.lit("f"), "doc_id").alias("id"), _json(type=F.lit("page"), physical=F.col("doc_id") + 1, printed=F.lit(None).cast("string")).alias("anchor"), F.lit(None).cast("string").alias("anchor_end"))
    out = S.items(S.lexical(_passages(spark, sf), QUERY, 5), fragments)
    return out.select("docref", "rank", "fragment_id", _round(F.col("score")).alias("score"), F.array_join("via", "+").alias("via"), "anchor_uri")


def weighted_search(spark, sf):
    """Words in four columns with their weights."""
    docs = _table(spark, sf, "documents")
    rows = docs.select(F.col("source").alias("docref"), F.col("doc_id").alias("n"), "text", F.concat(F.lit("the "), "lang").alias("context"), F.concat(F.col("source"), F.lit(" version")).alias("section"), F.substring("text", 1, 40).alias("search_text"))
    out = S.lexical(rows, QUERY, 10, S.WEIGHTS)
    return out.select("docref", "n", _round(F.col("score")).alias("score"), "rank")


def _folder(spark: SparkSession) -> str:
    """A folder of its own where the session keeps shared files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/quire")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"


def index_phrase(spark, sf):
    """The phrase search of an index of postings."""
    out = S.Index.write(_passages(spark, sf), _folder(spark)).lexical(PHRASE, 10)
    return out.select("docref", "n", _round(F.col("score")).alias("score"), "rank")


def _containers(spark, sf) -> DataFrame:
    """Conversations as containers; of four one is good, one is no database, one has no index, one no metadata."""
    t = _turns(spark, sf)
    unit = F.to_json(F.struct(F.concat(F.lit("u"), "turn").alias("id"), F.col("docref").alias("document"), (F.col("turn") + 1).alias("ord"), F.lit('{"type":"image"}').alias("anchor"), "text", F.lit("human").alias("reader"), F.lit(1.0).alias("confidence")))
    passage = F.to_json(F.struct((F.col("turn") + 1).alias("n"), F.concat(F.lit("f"), "turn").alias("id"), F.col("docref").alias("document"), F.concat(F.lit("u"), "turn").alias("unit"), (F.col("turn") + 1).alias("ord"), "text", F.lit("").alias("context"), F.lit('{"type":"image"}').alias("anchor")))
    rows = t.select("docref", "conv_id", F.lit("units").alias("table"), unit.alias("row")).unionByName(t.select("docref", "conv_id", F.lit("fragments").alias("table"), passage.alias("row")))
    rows = rows.select("docref", "table", "row", "conv_id")
    whole = container.packed(rows.where("conv_id % 4 <> 2").drop("conv_id")).unionByName(container.packed(rows.where("conv_id % 4 = 2").drop("conv_id"), search=False))
    number = F.regexp_extract("docref", "([0-9]+)$", 1).cast("long")
    return whole.select(F.col("docref").alias("path"), F.when(number % 4 == 1, F.concat(F.lit(b"x"), F.col("content"))).otherwise(F.col("content")).alias("content"))


def container_issues(spark, sf):
    """What is wrong with containers, as rows."""
    return container.check(_containers(spark, sf)).select("docref", "code", "place")


def container_units(spark, sf):
    """The units of all containers that can be read."""
    return container.table(_containers(spark, sf), "units", "id string, ord long, text string, printed string")


def dump_hashes(spark, sf):
    """Content hashes of documents with units and metadata."""
    t = _turns(spark, sf)
    meta = t.select("docref", F.lit("created").alias("key"), F.lit("2020").alias("value")).distinct().unionByName(t.select("docref", F.lit("signer").alias("key"), F.lit("nobody").alias("value")).distinct())
    docs = t.select("docref").distinct().select("docref", F.to_json(F.struct(F.col("docref").alias("id"))).alias("document"))
    units = t.select("docref", F.concat(F.lit("u"), "turn").alias("id"), (F.col("turn") + 1).alias("ord"), F.lit('{"type": "image"}').alias("anchor"), "text", (F.col("turn") / 7).alias("t0"))
    return K.dumps(docs, meta, {"units": units}).select("docref", "content_sha256")


def page_sequences(spark, sf):
    """Page numbers as exports state them."""
    return E.page_sequence(_book(spark, sf)[0])


def bibtex_entries(spark, sf):
    keyed = C.keys(_parts(spark, sf))
    return keyed.select("p_partkey", C.bibtex(C.item_of(F.col("metadata")), F.col("key")).alias("entry"))


def csl_items(spark, sf):
    """CSL items with their keys and the place of a verse."""
    keyed = C.keys(_parts(spark, sf))
    place = C.csl_locator(A.parsed(_json(type=F.lit("verse"), line_from=F.col("p_partkey"))))
    return keyed.select("p_partkey", C.csl_item(F.col("metadata"), F.col("key"), "issued", place).alias("item"))


def page_continuity(spark, sf):
    """Whether each turn goes on where the one before ended."""
    t = _turns(spark, sf).select("docref", F.col("turn").alias("physical"), "text", F.lit(None).cast("string").alias("footer"))
    return R.continues(t)


def distinct_titles(spark, sf):
    """First words of documents that are no running heads of their source."""
    docs = _table(spark, sf, "documents").select(F.col("source").alias("docref"), F.col("doc_id").alias("unit"), F.substring_index("text", " ", 1).alias("text"))
    return R.distinct_titles(docs, docs)


def page_languages(spark, sf):
    return R.majority_language(_table(spark, sf, "documents").select(F.col("source").alias("docref"), F.col("lang").alias("language")))


def temperature(spark, sf):
    """The temperature that fits labels best to scores taken as logits."""
    out = M.fitted_temperature(_judged(spark, sf).withColumn("z", (F.col("score") - 0.5) * 4), "z", "quality", 30)
    return out.select(_round(F.col("temperature")).alias("temperature"), _round(F.col("nll")).alias("nll"))


def vector_fidelity(spark, sf):
    """Cosines of vectors with their copies in bytes."""
    emb = _table(spark, sf, "embeddings").select(V.doubles(F.col("embedding")).alias("a")).withColumn("b", F.transform(V.i8(F.col("a")), lambda q: q / 127))
    out = M.cosine_spread(emb, "a", "b")
    return out.select("n", *[_round(F.col(k)).alias(k) for k in ("mean", "p5", "least")])


def best_kept(spark, sf):
    """How many of the three nearest vectors half of the components keep among ten."""
    return M.best_kept(_ranked(spark, sf, lambda v: v), _ranked(spark, sf, lambda v: V.truncated(v, 32))).select(_round(F.col("kept")).alias("kept"))


def profile_checks(spark, sf):
    """Profiles without what they promise, and counts that are wrong."""
    t = _turns(spark, sf)
    units = t.select("docref", F.when(F.col("conv_id") % 2 == 0, '{"type": "time", "t0": 0, "t1": 1}').otherwise('{"type": "image"}').alias("anchor"))
    docs = t.groupBy("docref", "conv_id").agg(F.count("*").alias("k")).select("docref", F.lit("core media semantic").alias("profile"), F.when(F.col("conv_id") % 3 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("unit_count"))
    vectors = t.where("conv_id % 5 = 0").select("docref")
    return X.profile_warnings(docs, units, vectors)


def issue_histogram(spark, sf):
    return X.histogram(profile_checks(spark, sf)).select("code", "times", "documents", F.array_join("examples", ",").alias("examples"))


def anchor_checks(spark, sf):
    """Anchors of every type, some of them broken."""
    n = F.col("turn")
    bad = ['{"type":"page","physical":0,"printed":null}', '{"type":"page","physical":2}', '{"type":"time","t0":3,"t1":1}', '{"type":"zz"}', "[1]", '{"type":"image","chars":[0,999999]}', '{"type":"image","region":{"x":5,"y":0,"w":1,"h":1}}', '{"type":"section","path":["a",1]}']
    anchor = F.when(n % 2 == 0, _shapes()).otherwise(F.element_at(F.array(*map(F.lit, bad)), (F.floor(n / 2) % len(bad) + 1).cast("int")))
    return _table(spark, sf, "conversations").select("conv_id", "turn", A.problem(anchor, F.length("text")).alias("code"))


def folio_tokens(spark, sf):
    """Numbers read from tokens as they stand on pages."""
    n = (F.col("turn") % 9 + 1).cast("string")
    forms = [n, F.concat(F.lit("- "), n, F.lit(" -")), F.concat(n, F.lit("v")), F.lit("xiv"), F.lit("XIV"), F.lit("xIv"), F.lit("iij"), F.lit("1O"), F.lit("word")]
    text = F.element_at(F.array(*forms), (F.floor(F.col("turn") / 1) % len(forms) + 1).cast("int"))
    out = _table(spark, sf, "conversations").select("conv_id", "turn", P.token(text).alias("t"))
    return out.select("conv_id", "turn", F.col("t.value").cast("string").alias("value"), "t.roman", "t.side", "t.mended")


QUERIES = {f.__name__: f for f in (uri_round_trip, uri_errors, page_locations, quotes_cited, passages_read, folio_queries, result_items, weighted_search, index_phrase, container_issues, container_units, dump_hashes, page_sequences, bibtex_entries, csl_items, page_continuity, distinct_titles, page_languages, temperature, vector_fidelity, best_kept, profile_checks, issue_histogram, anchor_checks, folio_tokens)}


# -- the same in DuckDB SQL ------------------------------------------------------------------------------------------

_URI = """'cite:conv-' || conv_id || '#' || CASE turn % 8 WHEN 0 THEN 'p=' || (turn + 1) || '&f=' || (turn + 3) WHEN 1 THEN 'p=' || (turn + 1)
 WHEN 2 THEN 't=' || CASE WHEN turn % 2 = 0 THEN CAST(CAST(turn * 1.5 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(turn * 1.5 - 0.5 AS BIGINT) AS VARCHAR) || '.5' END || ',' || CASE WHEN turn % 2 = 0 THEN CAST(CAST(turn * 1.5 + 2 AS BIGINT) AS VARCHAR) ELSE CAST(CAST(turn * 1.5 + 1.5 AS BIGINT) AS VARCHAR) || '.5' END
 WHEN 3 THEN 's=' || role || '/a%20b%2Fc&para=' || turn WHEN 4 THEN 'sl=' || (turn + 1) WHEN 5 THEN 'sh=Data%201&rows=' || turn || '-' || (turn + 5) WHEN 6 THEN 'v=' || turn || '-' || (turn + 2) ELSE 'ref=cts:x%3A' || turn END"""
_PAGES = "SELECT 'conv-' || conv_id AS docref, conv_id, turn, role, text, turn + 1 AS p, CASE WHEN (turn + 1) % 4 <> 0 THEN CAST(turn + 1 AS VARCHAR) END AS printed, (turn + 1) % 5 = 0 AS inferred FROM conversations"
_CITED = "CASE WHEN printed IS NULL THEN 'n. pag.' WHEN inferred THEN 'p. [' || printed || ']' ELSE 'p. ' || printed END"


def _weighted() -> str:
    columns = {"text": ("text", 1.0), "context": ("'the ' || lang", 0.5), "section": ("source || ' version'", 0.5), "search_text": ("substr(text, 1, 40)", 1.0)}
    toks = ", ".join(f"regexp_extract_all({_fold_sql(x)}, '[\\p{{L}}\\p{{N}}]+') AS t_{c}" for c, (x, _) in columns.items())
    tf = ", ".join(" + ".join(f"{w} * len(list_filter(t_{c}, lambda t: t = '{word}'))" for c, (_, w) in columns.items()) + f" AS f{i}" for i, word in enumerate(QUERY.split()))
    base = _bm25(_terms(), False)
    rest = base[base.index("stats AS ") :]
    return f"WITH toks AS (SELECT source AS docref, doc_id AS n, {toks} FROM documents), counted AS (SELECT docref, n, {' + '.join(f'len(t_{c})' for c in columns)} AS size, {tf} FROM toks), {rest} SELECT docref, n, {_r('score')} AS score, rank FROM ranked_10"


_UNIT = """'{"anchor":{"type":"image"},"confidence":null,"footer":null,"header":null,"id":"u' || turn || '","image":null,"notes":null,"ord":' || (turn + 1) || ',"printed":null,"reader":null,"t0":' || CASE WHEN turn % 7 = 0 THEN CAST(turn // 7 AS VARCHAR) ELSE CAST(CAST(round(turn / 7.0, 6) AS DOUBLE) AS VARCHAR) END || ',"t1":null,"text":' || CAST(to_json(text) AS VARCHAR) || ',"thumbnail":null,"words":null}'"""
_HALF = "list_transform(v[1:32], lambda x: x / sqrt(list_inner_product(v[1:32], v[1:32])))"
_NEAR = "SELECT qid, n, r FROM (SELECT a.vec_id AS qid, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) AS r FROM {t} a, {t} b WHERE a.vec_id % 20 = 0) WHERE r <= 10"
_CHECKS = """SELECT docref, 'W100' AS code, 'vectors' AS place FROM d WHERE conv_id % 5 <> 0 UNION ALL SELECT docref, 'W101', 'units' FROM d WHERE conv_id % 2 = 1 UNION ALL SELECT docref, 'W102', 'unit_count' FROM d WHERE conv_id % 3 = 0"""
_KEYS = "SELECT *, g || CASE WHEN n = 1 THEN '' WHEN k <= 26 THEN chr(CAST(96 + k AS INTEGER)) ELSE chr(CAST(97 + (k - 27) // 26 AS INTEGER)) || chr(CAST(97 + (k - 27) % 26 AS INTEGER)) END AS key FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY p_partkey) AS k FROM (SELECT *, lower(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || (1900 + p_size) AS g FROM part))"
_TEMPERATURES = ", ".join(f"({0.2 * 25.0 ** (k / 29)!r})" for k in range(30))

SQL = {
    "uri_round_trip": f"SELECT conv_id, turn, {_URI} AS uri, true AS same, CAST(NULL AS VARCHAR) AS error FROM conversations",
    "uri_errors": "SELECT conv_id, turn, CASE turn % 10 WHEN 0 THEN 'another scheme' WHEN 1 THEN 'no document reference' WHEN 2 THEN 'a malformed value of p' WHEN 3 THEN 'a repeated parameter' WHEN 4 THEN 'a range that ends before it starts' WHEN 5 THEN 'percent-encoding that gives no UTF-8' WHEN 6 THEN 'a range that ends before it starts' WHEN 7 THEN 'a malformed value of xywh' WHEN 8 THEN 'a malformed value of t' END AS error FROM conversations",
    "page_locations": "SELECT 'conv-' || a.conv_id AS docref, 'cite:conv-' || a.conv_id || '#p=' || (a.turn + 1) AS reference, 'u' || a.turn AS units, CASE WHEN b.turn % 3 = 0 THEN 'f' || b.turn || ',' ELSE '' END || 'f' || a.turn AS fragments, CAST(NULL AS VARCHAR) AS error FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1",
    "quotes_cited": f"SELECT docref, 'f' || turn AS fragment, '(Talk ' || conv_id || ', n.d., ' || {_CITED} || ')' AS text, 'cite:' || docref || '#p=' || p || CASE WHEN printed IS NULL THEN '' ELSE '&f=' || printed END || '&char=' || (instr(text, substr(text, 8, 20)) - 1) || ',' || (instr(text, substr(text, 8, 20)) + 19) AS uri, CAST(NULL AS VARCHAR) AS error FROM ({_PAGES}) WHERE length(text) > 30",
    "passages_read": f"""WITH b AS ({_PAGES}), a AS (SELECT docref, p FROM b UNION ALL SELECT docref, max(p) + 1 FROM b GROUP BY docref)
SELECT a.docref, CAST(a.p AS VARCHAR) AS folio, CASE WHEN b.printed IS NOT NULL THEN 'u' || b.turn END AS unit_id, CASE WHEN b.printed IS NOT NULL THEN '(T, 1900, ' || {_CITED} || ')' END AS citation, CASE WHEN b.printed IS NOT NULL AND b.inferred THEN 'the folio is inferred, not read' ELSE '' END AS warnings, CASE WHEN b.printed IS NULL THEN 'there is no folio ' || a.p END AS error FROM a LEFT JOIN b ON a.docref = b.docref AND a.p = b.p""",
    "folio_queries": "SELECT conv_id, turn, CASE WHEN turn % 8 IN (0, 1, 2, 5) THEN 'printed' WHEN turn % 8 IN (3, 4) THEN 'physical' END AS kind, CASE WHEN turn % 8 IN (3, 4) THEN CAST(turn + 1 AS VARCHAR) END AS first, CAST(NULL AS VARCHAR) AS last, CASE WHEN turn % 8 IN (0, 1, 2) THEN CAST(turn + 1 AS VARCHAR) WHEN turn % 8 = 5 THEN 'x' || (turn + 1) END AS value FROM conversations",
    "result_items": f"WITH {_bm25(_terms(), False, 5)} SELECT docref, rank, 'f' || n AS fragment_id, {_r('score')} AS score, 'lexical' AS via, 'cite:' || docref || '#p=' || (n + 1) AS anchor_uri FROM ranked_5",
    "weighted_search": _weighted(),
    "index_phrase": f"WITH {_bm25(_PAIR, True)} SELECT docref, n, {_r('score')} AS score, rank FROM ranked_10",
    "container_issues": "SELECT DISTINCT 'conv-' || conv_id AS docref, CASE WHEN conv_id % 4 = 1 THEN 'E001' ELSE 'E010' END AS code, CASE WHEN conv_id % 4 = 1 THEN 'not a database' ELSE 'fragments_fts' END AS place FROM conversations WHERE conv_id % 4 IN (1, 2)",
    "container_units": "SELECT 'conv-' || conv_id AS docref, 'u' || turn AS id, turn + 1 AS ord, nfc_normalize(text) AS text, CAST(NULL AS VARCHAR) AS printed FROM conversations WHERE conv_id % 4 <> 1",
    "dump_hashes": f"""SELECT docref, sha256('{{"blobs":[],"document":{{"id":"' || docref || '"}},"extensions":[],"figures":[],"fragments":[],"meta":{{"created":"2020"}},"provenance":[],"sections":[],"spaces":[],"units":[' || string_agg(u, ',' ORDER BY turn) || ']}}') AS content_sha256 FROM (SELECT 'conv-' || conv_id AS docref, turn, {_UNIT} AS u FROM conversations) GROUP BY docref""",
    "page_sequences": f"SELECT docref, turn + 1 AS ord, CAST(p AS BIGINT) AS physical, CASE WHEN NOT inferred THEN printed END AS printed, CASE WHEN inferred THEN '[' || printed || ']' ELSE printed END AS n FROM ({_PAGES})",
    "bibtex_entries": f"""SELECT p_partkey, '@book{{' || key || ',' || chr(10) || '  author = {{{{' || p_brand || '}}}},' || chr(10) || '  title = {{' || regexp_replace(p_name, '(\\S*\\p{{Lu}}\\S*)', '{{\\1}}', 'g') || '}},' || chr(10) || '  year = {{' || (1900 + p_size) || '}},' || chr(10) || '  publisher = {{' || p_type || '}}' || chr(10) || '}}' AS entry FROM ({_KEYS})""",
    "csl_items": f"""SELECT p_partkey, '{{"id":"' || key || '","label":"verse","locator":"' || p_partkey || '","author":[{{"family":' || to_json(p_brand) || '}}],"publisher":' || to_json(p_type) || ',"title":' || to_json(p_name) || ',"type":"book"}}' AS item FROM ({_KEYS})""",
    "page_continuity": r"""SELECT docref, physical, coalesce(a <> '' AND b <> '', false) AND coalesce((regexp_matches(a, '\p{L}[-¬]$') AND regexp_matches(w, '^\p{Ll}')) OR (NOT regexp_matches(a, '[.!?:;»”")\]]$') AND (regexp_matches(w, '^\p{Ll}') OR regexp_matches(w, '^[,;]'))), false) AS continues FROM (SELECT *, regexp_extract(b, '^[#*\s«"(]*(\S*)', 1) AS w FROM (SELECT 'conv-' || conv_id AS docref, turn AS physical, ltrim(text, ' ') AS b, rtrim(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS a FROM conversations))""",
    "distinct_titles": f"WITH t AS (SELECT source AS docref, doc_id AS unit, string_split(text, ' ')[1] AS text FROM documents), k AS (SELECT *, array_to_string(regexp_extract_all({_fold_sql('text')}, '[\\p{{L}}\\p{{N}}]+'), ' ') AS key FROM t), n AS (SELECT docref, count(*) AS units FROM t GROUP BY docref), o AS (SELECT docref, key FROM k JOIN n USING (docref) GROUP BY docref, key, units HAVING count(*) >= greatest(3.0, units * 0.05)) SELECT docref, unit, text FROM k ANTI JOIN o USING (docref, key)",
    "page_languages": "SELECT docref, language FROM (SELECT *, row_number() OVER (PARTITION BY docref ORDER BY k DESC, language) AS r FROM (SELECT source AS docref, lang AS language, count(*) AS k FROM documents WHERE lang IS NOT NULL GROUP BY ALL)) WHERE r = 1",
    "temperature": "WITH j AS (SELECT (floor((1 - (GARBAGE)) * 1e4 + 0.5) / 1e4 - 0.5) * 4 AS z, quality AS y FROM documents JOIN labels USING (doc_id)), t AS (SELECT t, avg(CASE WHEN y = 1 THEN ln(1 + exp(-z / t)) ELSE ln(1 + exp(z / t)) END) AS nll FROM j, (VALUES TEMPERATURES) v(t) GROUP BY t) SELECT floor(t * 1e6 + 0.5) / 1e6 AS temperature, floor(nll * 1e6 + 0.5) / 1e6 AS nll FROM t ORDER BY t.nll, t LIMIT 1",
    "vector_fidelity": f"SELECT n, {_r('mean')} AS mean, {_r('p5')} AS p5, {_r('least')} AS least FROM (SELECT count(*) AS n, avg(c) AS mean, quantile_cont(c, 0.05) AS p5, min(c) AS least FROM (SELECT list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))) AS c FROM (SELECT v, list_transform(v, lambda x: greatest(-127.0, least(127.0, sign(x) * floor(abs(x) * 127 + 0.5))) / 127) AS q FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings))))",
    "best_kept": f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, {_HALF} AS v FROM e), one AS ({_NEAR.format(t='e')}), two AS ({_NEAR.format(t='s')}) SELECT {_r('avg(k)')} AS kept FROM (SELECT one.qid, count(two.n) / 3.0 AS k FROM one LEFT JOIN two ON one.qid = two.qid AND one.n = two.n WHERE one.r <= 3 GROUP BY one.qid)",
    "profile_checks": f"WITH d AS (SELECT DISTINCT 'conv-' || conv_id AS docref, conv_id FROM conversations) {_CHECKS}",
    "issue_histogram": f"WITH d AS (SELECT DISTINCT 'conv-' || conv_id AS docref, conv_id FROM conversations), i AS ({_CHECKS}) SELECT code, count(*) AS times, count(DISTINCT docref) AS documents, string_agg(docref || '/' || place, ',' ORDER BY r) FILTER (r <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY docref, place) AS r FROM i) GROUP BY code",
    "anchor_checks": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NULL ELSE CASE (turn // 2) % 8 WHEN 3 THEN 'E041' WHEN 5 THEN 'E042' WHEN 6 THEN NULL ELSE 'E040' END END AS code FROM conversations",
    "folio_tokens": "SELECT conv_id, turn, CAST(CASE WHEN turn % 9 <= 2 THEN turn % 9 + 1 WHEN turn % 9 IN (3, 4) THEN 14 WHEN turn % 9 = 6 THEN 3 WHEN turn % 9 = 7 THEN 10 END AS VARCHAR) AS value, CASE WHEN turn % 9 IN (5, 8) THEN NULL ELSE turn % 9 IN (3, 4, 6) END AS roman, CASE WHEN turn % 9 = 2 THEN 'v' END AS side, CASE WHEN turn % 9 IN (5, 8) THEN NULL ELSE turn % 9 = 7 END AS mended FROM conversations",
}
from quire.plans.queries import _GARBAGE  # noqa: E402

SQL["temperature"] = SQL["temperature"].replace("GARBAGE", _GARBAGE).replace("TEMPERATURES", _TEMPERATURES)
