"""Line dedup by a log-template tree.

A line's tokens are what stands between blanks; a token with a digit counts as the variable `<*>`. Lines of at least
MIN_TOKENS tokens fall to a leaf of a tree of fixed depth: token count, then the first DEPTH tokens. In a leaf of several
different lines, a position is constant if one token stands there in at least MODE of the leaf's distinct lines; a leaf
of SHAPED tokens or more with constants at SIMILAR of its positions, two of them beyond the first DEPTH, has a template
with variables elsewhere, taken by the lines that have all its constants. What is left of a leaf is split on the most
frequent token of its positions beyond the first DEPTH into lines with and without it, and searched again, SPLITS times;
so a leaf may have several templates. Besides, every line is a template of its own, its tokens with digits being
variables, and a line of LONG tokens or more one with its digits, too.

A template recurs if it is found in enough different texts: MIN_TEXTS; two for lines of LONG tokens or more without
variables; SHORT_TEXTS for lines of fewer than MIN_TOKENS tokens, which are taken literally. Its lines are dropped from
all documents but the first (least id) that has it.

Exact copies of a document count as one text, so they do not make each other's lines recur; removing them is the work of
near-duplicate detection. Only DataFrame functions run here. Whole tables are counted; keys that hold many rows
meet only in joins that adaptive execution splits, or in sums that are combined before the shuffle.

Defined cases: a null text stays null (no lines); an empty text stays empty; blank lines always stay; null ids are
ignored by min(), so a template seen only under null ids keeps all its lines; rows that repeat id and text are treated
alike; all other columns pass unchanged, of any name but those beginning with `__t_`. Lines are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, table

MIN_TOKENS = 3
MIN_TEXTS = 3
SHORT_TEXTS = 10
LONG = 10
DEPTH = 3
MODE = 0.8
SIMILAR = 0.6
SHAPED = 6  # tokens of a line that may have variables without digits
SPLITS = 2

_DIGITS = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"  # a token with a digit, in linear time


def _plain(line: Column) -> Column:
    """Tokens of a line with one space between them."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def _masked(plain: Column) -> Column:
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, _DIGITS, "<*>")).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """Each line with a token: id, text hash, position, its key and its leaf (null for short lines), its key with digits
    (null if it has no such template), and the texts that make it recur."""
    split = docs.select("__t_id", "__t_text", F.posexplode(F.split("__t_raw", "\n")).alias("__t_pos", "line"))
    lines = split.withColumn("plain", _plain(F.col("line"))).where("plain <> ''").drop("line").withColumn("masked", _masked(F.col("plain")))
    width = (F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1).alias("width")
    lines = lines.select("__t_id", "__t_text", "__t_pos", "plain", "masked", width, (F.col("masked") == F.col("plain")).alias("bare"))
    short = F.col("width") < MIN_TOKENS
    key = F.when(short, F.xxhash64(F.lit("s"), "plain")).otherwise(F.xxhash64(F.lit("m"), "masked"))
    leaf = F.when(~short, F.xxhash64("width", F.substring_index("masked", " ", DEPTH)))
    raw = F.when((F.col("width") >= LONG) & ~F.col("bare"), F.xxhash64(F.lit("r"), "plain"))
    bound = F.when(short, SHORT_TEXTS).when(F.col("bare") & (F.col("width") >= LONG), 2).otherwise(MIN_TEXTS)
    return lines.select("__t_id", "__t_text", "__t_pos", key.alias("key"), leaf.alias("leaf"), raw.alias("raw"), bound.cast("int").alias("bound"))


def _shapes(lines: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Of each group of distinct lines (key, tokens): its shape, an array of constants and nulls, if it has one; and the
    place and token that splits it."""
    spots = lines.select(group, F.posexplode("tokens").alias("pos", "token")).groupBy(group, "pos", "token").agg(F.count("*").alias("k"))
    fields = spots.groupBy(group, "pos").agg(F.max(F.struct("k", "token")).alias("top"), F.sum("k").alias("all"))
    fields = fields.select(group, "pos", F.when(F.col("top.k") >= MODE * F.col("all"), F.col("top.token")).alias("token"), F.col("top.k").alias("k"), F.col("top.token").alias("best"), "all")
    cut = F.when((F.col("pos") >= DEPTH) & (F.col("k") < F.col("all")), F.struct("k", (-F.col("pos")).alias("back"), "best"))
    grown = fields.groupBy(group).agg(F.count("token").alias("constants"), F.count("*").alias("width"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("fields"), F.max(cut).alias("cut"))
    shaped = (F.col("width") >= SHAPED) & (F.col("constants") >= F.greatest(SIMILAR * F.col("width"), F.lit(DEPTH + 2.0))) & (F.col("constants") < F.col("width"))
    return grown.select(group, F.when(shaped, F.col("fields.token")).alias("shape"), "cut")


def templates(docs: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, template): the lines that take a generalised template of their leaf. Tokens are cut again from one place of
    each line in question, so no others travel."""
    known = pairs.where("leaf is not null").groupBy("leaf", "key").agg(F.count("*").alias("texts"))
    leaves = known.groupBy("leaf").agg(F.sum("texts").alias("texts"), F.count("*").alias("distinct_lines")).where((F.col("texts") >= MIN_TEXTS) & (F.col("distinct_lines") > 1)).select("leaf")
    places = lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "key").agg(F.min(F.struct("__t_text", "__t_id", "__t_pos")).alias("at"))
    wanted = places.groupBy(F.col("at.__t_text").alias("hash"), F.col("at.__t_id").alias("of")).agg(F.collect_list(F.struct("leaf", "key", F.col("at.__t_pos").alias("pos"))).alias("found"))
    met = wanted.join(docs, (F.col("hash") == F.col("__t_text")) & F.col("of").eqNullSafe(F.col("__t_id"))).dropDuplicates(["hash", "of"])
    cut = met.select(F.split("__t_raw", "\n").alias("all"), F.explode("found").alias("f"))
    left = stored(cut.select(F.col("f.leaf").alias("group"), F.col("f.key").alias("key"), F.split(_masked(_plain(F.get("all", F.col("f.pos")))), " ").alias("tokens")))
    found = None
    for k in range(SPLITS + 1):
        shapes = _shapes(left, "group")
        fits = F.coalesce(F.forall(F.zip_with("tokens", "shape", lambda t, s: s.isNull() | (t == s)), lambda ok: ok) & F.col("shape").isNotNull(), F.lit(False))
        told = left.join(shapes, "group").withColumn("fits", fits)
        if k < SPLITS:
            told = stored(told)
        some = told.where("fits").select("key", F.xxhash64(F.lit("shape"), "group").alias("template"))
        found = some if found is None else found.unionByName(some)
        if k < SPLITS:
            side = F.when(F.get("tokens", -F.col("cut.back")) == F.col("cut.best"), F.xxhash64("group", "cut.back", "cut.best")).otherwise(F.xxhash64("group", F.lit("rest")))
            rest = told.where("not fits and cut is not null and cut.k > 1").select(side.alias("group"), "key", "tokens")
            several = rest.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
            left = stored(rest.join(several, "group", "left_semi"))
    return found


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` with recurring lines gone from the text, and __t_lines and __t_dropped, counts of lines."""
    docs = df.withColumn("__t_raw", F.col(text_col)).withColumn("__t_id", F.col(id_col)).withColumn("__t_text", F.xxhash64(text_col))
    texts = docs.select("__t_id", "__t_text", "__t_raw")
    lines = stored(_lines(texts))
    place = ["__t_id", "__t_text", "__t_pos"]
    raws = lines.where("raw is not null").select(*place, F.col("raw").alias("key"))
    keys = lines.select("leaf", "key", "bound", "__t_text", "__t_id").unionByName(raws.select(F.lit(None).cast("long").alias("leaf"), "key", F.lit(2).alias("bound"), "__t_text", "__t_id"))
    pairs = stored(keys.groupBy("leaf", "key", "bound", "__t_text").agg(F.min("__t_id").alias("least")))
    shaped = stored(templates(texts, lines, pairs))
    own = pairs.groupBy("key").agg(F.count("*").alias("texts"), F.max("bound").alias("bound"), F.min("least").alias("keeper")).where("texts >= bound").select("key", "keeper")
    seen = pairs.join(shaped, "key").groupBy("template", "__t_text").agg(F.min("least").alias("least"))
    grown = seen.groupBy("template").agg(F.count("*").alias("texts"), F.min("least").alias("keeper")).where(F.col("texts") >= MIN_TEXTS)
    both = own.unionByName(shaped.join(grown, "template").select("key", "keeper"))
    drops = both.groupBy("key").agg(F.min("keeper").alias("first"), F.max("keeper").alias("last"))
    here = lines.select(*place, "key").unionByName(raws).join(drops, "key")
    gone = here.where(~(F.col("__t_id").eqNullSafe(F.col("first")) & F.col("__t_id").eqNullSafe(F.col("last"))))
    gone = gone.groupBy("__t_id", "__t_text").agg(F.collect_set("__t_pos").alias("__t_gone")).select(F.col("__t_id").alias("__t_of"), F.col("__t_text").alias("__t_hash"), "__t_gone")
    met = docs.join(gone, docs["__t_id"].eqNullSafe(F.col("__t_of")) & (F.col("__t_text") == F.col("__t_hash")), "left")
    rest = F.filter(F.split("__t_raw", "\n"), lambda x, i: ~F.array_contains("__t_gone", i))
    text = F.when(F.col("__t_gone").isNull(), F.col("__t_raw")).otherwise(F.array_join(rest, "\n"))
    breaks = F.octet_length("__t_raw") - F.octet_length(F.replace("__t_raw", F.lit("\n"), F.lit("")))
    counts = [F.when(F.col("__t_raw").isNull(), 0).otherwise(breaks + 1).cast("long").alias("__t_lines"), F.coalesce(F.size("__t_gone"), F.lit(0)).cast("long").alias("__t_dropped")]
    return met.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], *counts)


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__t_lines").alias("n_lines"), F.col("__t_dropped").alias("n_dropped"), "text")


def _round_sql(k: int) -> str:
    """Round k of the search for templates: from t_left{k} (grp, v, tokens) the lines that fit, and what is left."""
    out = f"""
t_spots{k} AS (SELECT grp, pos, token, count(*) AS k FROM (SELECT grp, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM t_left{k}) GROUP BY ALL),
t_fields{k} AS (SELECT grp, pos, max({{'k': k, 'token': token}}) AS top, sum(k) AS total FROM t_spots{k} GROUP BY ALL),
t_named{k} AS (SELECT grp, pos, total, top.k AS k, top.token AS best, CASE WHEN top.k >= {MODE} * total THEN top.token END AS token FROM t_fields{k}),
t_shapes{k} AS (SELECT grp, count(token) AS constants, count(*) AS width, array_agg(coalesce(token, '') ORDER BY pos) AS shape, max({{'k': k, 'back': -pos, 'best': best}}) FILTER (pos >= {DEPTH} AND k < total) AS cut FROM t_named{k} GROUP BY grp),
t_told{k} AS (SELECT l.grp, l.v, l.tokens, s.cut, s.width >= {SHAPED} AND s.constants >= greatest({SIMILAR} * s.width, {DEPTH + 2}) AND s.constants < s.width
  AND len(list_filter(list_zip(l.tokens, s.shape), lambda z: z[2] <> '' AND z[1] <> z[2])) = 0 AS fits FROM t_left{k} l JOIN t_shapes{k} s USING (grp)),
t_found{k} AS (SELECT v, grp FROM t_told{k} WHERE fits),"""
    if k < SPLITS:
        out += f"""
t_rest{k} AS (SELECT CASE WHEN tokens[1 - cut.back] = cut.best THEN grp || chr(1) || (-cut.back) || chr(2) || cut.best ELSE grp || chr(3) END AS grp, v, tokens FROM t_told{k} WHERE NOT fits AND cut IS NOT NULL AND cut.k > 1),
t_left{k + 1} AS (SELECT * FROM t_rest{k} SEMI JOIN (SELECT grp FROM t_rest{k} GROUP BY grp HAVING count(*) > 1) USING (grp)),"""
    return out


def lines_sql(source: str, id_col: str = "doc_id") -> str:
    """The same as common table expressions for DuckDB, over a table or CTE with the id and text; the last is `deduped`."""
    masked = "array_to_string(list_transform(string_split(plain, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')"
    return f"""
t_split AS (SELECT {id_col} AS id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source}),
t_plain AS (SELECT id, text, pos, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS plain FROM t_split),
t_cut AS (SELECT *, {masked} AS masked, len(string_split(plain, ' ')) AS width FROM t_plain WHERE plain <> ''),
t_lines AS (SELECT id, text, pos, plain, masked, width, CASE WHEN width < {MIN_TOKENS} THEN 's' || plain ELSE 'm' || masked END AS v,
  CASE WHEN width >= {MIN_TOKENS} THEN width || ' ' || array_to_string(string_split(masked, ' ')[1:{DEPTH}], ' ') END AS leaf,
  CASE WHEN width < {MIN_TOKENS} THEN {SHORT_TEXTS} WHEN width >= {LONG} AND masked = plain THEN 2 ELSE {MIN_TEXTS} END AS bound FROM t_cut),
t_keys AS (SELECT id, text, pos, v, leaf, masked, bound FROM t_lines UNION ALL SELECT id, text, pos, 'r' || plain, NULL, masked, 2 FROM t_lines WHERE width >= {LONG} AND masked <> plain),
t_pairs AS (SELECT v, leaf, masked, bound, text, min(id) AS least FROM t_keys GROUP BY ALL),
t_known AS (SELECT v, leaf, any_value(masked) AS masked, count(*) AS texts FROM t_pairs WHERE leaf IS NOT NULL GROUP BY v, leaf),
t_leaves AS (SELECT leaf FROM t_known GROUP BY leaf HAVING sum(texts) >= {MIN_TEXTS} AND count(*) > 1),
t_left0 AS (SELECT leaf AS grp, v, string_split(masked, ' ') AS tokens FROM t_known SEMI JOIN t_leaves USING (leaf)),{"".join(map(_round_sql, range(SPLITS + 1)))}
t_shaped AS ({" UNION ALL ".join(f"SELECT v, grp FROM t_found{k}" for k in range(SPLITS + 1))}),
t_own AS (SELECT v, min(least) AS keeper FROM t_pairs GROUP BY v HAVING count(*) >= max(bound)),
t_seen AS (SELECT grp, text, min(least) AS least FROM t_pairs JOIN t_shaped USING (v) GROUP BY ALL),
t_grown AS (SELECT grp, min(least) AS keeper FROM t_seen GROUP BY grp HAVING count(*) >= {MIN_TEXTS}),
t_drops AS (SELECT v, keeper FROM t_own UNION ALL SELECT v, keeper FROM t_shaped JOIN t_grown USING (grp)),
t_gone AS (SELECT k.id, k.text, list(DISTINCT k.pos) AS gone FROM t_keys k JOIN t_drops d ON k.v = d.v WHERE k.id IS DISTINCT FROM d.keeper GROUP BY ALL),
deduped AS (SELECT s.* EXCLUDE (text), len(string_split(s.text, chr(10))) AS t_lines, coalesce(len(g.gone), 0) AS t_dropped,
  CASE WHEN g.gone IS NULL THEN s.text ELSE coalesce(list_aggregate(list_transform(list_filter(list_zip(string_split(s.text, chr(10)), range(1, len(string_split(s.text, chr(10))) + 1)), lambda z: NOT list_contains(g.gone, z[2])), lambda z: z[1]), 'string_agg', chr(10)), '') END AS text
  FROM {source} s LEFT JOIN t_gone g ON s.{id_col} IS NOT DISTINCT FROM g.id AND s.text = g.text)"""


SQL = f"WITH {lines_sql('documents')} SELECT doc_id, CAST(coalesce(t_lines, 0) AS BIGINT) AS n_lines, CAST(t_dropped AS BIGINT) AS n_dropped, text FROM deduped"
