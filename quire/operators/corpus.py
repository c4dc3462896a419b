"""Operators over documents, conversations, pages and sheets kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vectors as V


def keep_first(df: DataFrame, key: list[Column], order: str, where: Column | None = None) -> DataFrame:
    """Rows whose key appears for the first time in the order of a column that tells rows apart, or that `where` exempts.
    Only keys and numbers are grouped, copies of one key being combined before the shuffle."""
    tested = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    names = [f"__k{i}" for i in range(len(key))]
    light = df.select(F.col(order).alias("__o"), tested.alias("__t"), *[k.alias(n) for k, n in zip(key, names)])
    first = light.where("__t").groupBy(*names).agg(F.min("__o").alias("__o")).select("__o")
    kept = first.unionByName(light.where("not __t").select("__o"))
    return df.join(kept, df[order].eqNullSafe(kept["__o"]), "left_semi")


def repeated_lines(df: DataFrame, part: str, text: str, least: int) -> DataFrame:
    """Lines (running heads) seen in `least` passages or more of a document: part, line, times."""
    lines = df.select(part, F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).where(F.trim("line") != "")
    return lines.groupBy(part, "line").agg(F.count("*").alias("times")).where(F.col("times") >= least)


def contiguity(df: DataFrame, part: str, order: str, first: int = 1) -> DataFrame:
    """Whether each part's order runs first, first + 1, ...: part, n, contiguous. Combined before the shuffle."""
    n = F.count("*")
    whole = (F.min(order) == first) & (F.max(order) == first + n - 1) & (F.count_distinct(order) == n)
    return df.groupBy(part).agg(n.alias("n"), whole.alias("contiguous"))


def neighbours(df: DataFrame, part: str, order: str, text: str, k: int = 1) -> DataFrame:
    """Each row with its part's rows up to k before and after: part, order, before, after (arrays of text)."""
    w = Window.partitionBy(part).orderBy(order)
    back, ahead = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    return df.select(part, order, F.collect_list(text).over(back).alias("before"), F.collect_list(text).over(ahead).alias("after"))


def leading_speaker(df: DataFrame, part: str, speaker: str, weight: Column) -> DataFrame:
    """Who holds most of each part: part, speaker, share; ties go to the first name."""
    sums = df.groupBy(part, speaker).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(part).agg(F.max(F.col("w")).alias("most"), F.sum("w").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col(speaker).alias("who")))).alias("ranked"))
    return best.select(part, F.col("ranked")[0]["who"].alias("speaker"), (F.col("most") / F.col("all")).alias("share"))


def sheet_blocks(df: DataFrame, order: str, cells: list[str], size: int = 40, part: str | None = None) -> DataFrame:
    """Blocks of `size` rows of a sheet as lines of cells: block, row_from, row_to, body. Rows are numbered from 2, the
    header being row 1; with a dense `order` from 1 no global sort is needed."""
    number = F.col(order) + 1
    block = F.floor((F.col(order) - 1) / size)
    line = F.concat_ws(" | ", *[F.col(c).cast("string") for c in cells])
    keys = ([part] if part else []) + ["block"]
    rows = df.select(*([part] if part else []), block.alias("block"), number.alias("row"), line.alias("line"))
    made = rows.groupBy(*keys).agg(F.min("row").alias("row_from"), F.max("row").alias("row_to"), F.array_sort(F.collect_list(F.struct("row", "line"))).alias("lines"))
    return made.select(*keys, "row_from", "row_to", F.array_join(F.col("lines.line"), "\n").alias("body"))


def html_head(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Title and named meta values of pages."""
    meta = lambda name: F.nullif(F.regexp_extract(html, rf"""<meta\s+name=["']{name}["']\s+content=["']([^"']*)["']""", 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"<title[^>]*>([^<]*)</title>", 1), r"\s+", " ")), F.lit(""))
    return df.select(*keep, title.alias("title"), meta("description").alias("description"), meta("author").alias("author"))


# Names of meta elements that state a field, in the order in which they are trusted.
META = {
    "title": "citation_title dc.title og:title", "authors": "citation_author dc.creator author article:author",
    "date": "citation_publication_date citation_date dc.date article:published_time", "doi": "citation_doi dc.identifier",
    "publisher": "citation_publisher dc.publisher og:site_name", "container": "citation_journal_title", "language": "dc.language og:locale",
}


def html_meta(html: Column) -> Column:
    """Bibliographic fields that a page states in its meta elements, whatever the order of their attributes: a struct of
    META's fields, `authors` being an array; the language falls back to that of the page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s+[^>]*>"), F.lit(0))
    attribute = lambda t, n: F.trim(F.regexp_extract(t, rf"""(?i)(?:{n})\s*=\s*["']([^"']*)""", 1))
    held = F.filter(F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "name|property")).alias("name"), attribute(t, "content").alias("value"))), lambda x: x["value"] != "")
    of = lambda field: F.filter(held, lambda x: x["name"].isin(META[field].split()))
    first = lambda values: F.get(values, F.lit(0))["value"]
    doi = F.regexp_replace(first(F.filter(of("doi"), lambda x: x["value"].rlike(r"(?i)^(?:doi:)?10\.[0-9]{4,}/"))), "(?i)^doi:", "")
    page = F.nullif(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']([^"']+)""", 1), F.lit(""))
    language = F.coalesce(F.replace(first(of("language")), F.lit("_"), F.lit("-")), page)
    plain = [first(of(k)).alias(k) for k in ("title", "date", "publisher", "container")]
    return F.struct(*plain, F.transform(of("authors"), lambda x: x["value"]).alias("authors"), doi.alias("doi"), language.alias("language"))


def main_content(html: Column) -> Column:
    """The longest article or main element if it has over 500 characters of text, else the body, else the page."""
    text = lambda x: F.length(F.regexp_replace(x, "<[^>]+>", ""))
    parts = [F.regexp_extract_all(html, F.lit(rf"(?is)<{t}\b[^>]*>.*?</{t}>"), F.lit(0)) for t in ("article", "main")]
    best = lambda found: F.array_max(F.transform(found, lambda x: F.struct(text(x).alias("n"), x.alias("x"))))
    body = F.nullif(F.regexp_extract(html, r"(?is)<body\b[^>]*>.*</body>", 0), F.lit(""))
    return F.coalesce(*[F.when(best(p)["n"] > 500, best(p)["x"]) for p in parts], body, html)


def dice_pairs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Similarity of two texts of each row, of any length: key, dice. Twice the shared character pairs, each as often as
    both have it, of all pairs (folded, letters and numbers alone)."""
    flat = lambda c: F.regexp_replace(T.folded(F.col(c)), r"[^\p{L}\p{N}]", "")
    rows = df.select(key, flat(a).alias("x"), flat(b).alias("y"))
    both = rows.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("t")), F.struct(F.lit(1).alias("side"), F.col("y").alias("t")))).alias("s"))
    spots = both.where(F.length("s.t") > 1).select(key, "s.side", F.col("s.t").alias("t"), F.explode(F.sequence(F.lit(1), F.length("s.t") - 1)).alias("i"))
    counts = spots.groupBy(key, F.substring("t", F.col("i"), F.lit(2)).alias("g")).agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("q"))
    common = counts.groupBy(key).agg(F.sum(F.least("p", "q")).alias("common"))
    size = F.length("x") + F.length("y") - 2
    told = F.when((F.col("x") == "") | (F.col("y") == ""), 0.0).when(F.col("x") == F.col("y"), 1.0).when((F.length("x") < 2) | (F.length("y") < 2), 0.0).otherwise(2 * F.coalesce("common", F.lit(0)) / size)
    return rows.join(common, key, "left").select(key, told.alias("dice"))


def running(df: DataFrame, order: str, value: str, name: str, pieces: int = 64) -> DataFrame:
    """The sum of `value` over all rows with a lesser `order` (none twice): pieces of about equal size by value are summed
    each in its own window, and the sums of whole pieces, one number each, are added."""
    cuts = sorted(set(df.approxQuantile(order, [k / pieces for k in range(1, pieces)], 0.01)))
    piece = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = df.withColumn("__p", piece)
    w = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {r["__p"]: r["s"] for r in dealt.groupBy("__p").agg(F.sum(value).alias("s")).collect()}  # one row a piece
    before, total = F.lit(0), 0
    for p in sorted(sums):
        before = F.when(F.col("__p") == p, F.lit(total)).otherwise(before)
        total += sums[p] or 0
    return dealt.withColumn(name, before + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("__p")


def storage_loss(df: DataFrame, vec: str) -> DataFrame:
    """Cosine of each vector with its i8 copy, and with its own first half scaled to unit length and padded."""
    v = V.doubles(F.col(vec))
    return df.select("*", V.cosine(v, F.transform(V.i8(v), lambda q: q / 127)).alias("i8_cosine"), (V.norm(F.slice(v, 1, 32)) / V.norm(v)).alias("half_share"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums with average ties: positives, negatives, auc. Equal scores are combined
    first, and no single task sorts them all."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    below = running(by, "s", "q", "below")
    sums = below.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("u"))
    return sums.select("positives", "negatives", (F.col("u") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"), F.count("*").alias("n"))


def summary(df: DataFrame, part: str, text: str) -> DataFrame:
    """Per document: passages, characters, upper median and greatest of estimated tokens."""
    n = T.count_tokens(F.col(text))
    sizes = df.groupBy(part, n.alias("t")).agg(F.count("*").alias("k"), F.sum(F.length(text)).alias("c"))
    w = Window.partitionBy(part).orderBy("t")
    run = sizes.select(part, "t", "k", "c", F.sum("k").over(w).alias("upto"), F.sum("k").over(Window.partitionBy(part)).alias("all"))
    return run.groupBy(part).agg(F.sum("k").alias("passages"), F.sum("c").alias("characters"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("t"))).alias("median_tokens"), F.max("t").alias("max_tokens"))
