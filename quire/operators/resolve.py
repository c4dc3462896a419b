"""Finding documents and units, checking quotations, vectors of spaces, and metadata by confidence."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def by_title(docs: DataFrame, query: str) -> DataFrame:
    """Documents whose title or authors hold the words as written, whatever their case."""
    return docs.where(F.contains(F.lower(F.concat_ws(" ", "title", "authors")), F.lit(query.lower())))


def resolve(docs: DataFrame, reference: str) -> DataFrame:
    """The document of a full docref, a hash prefix of 8 digits or more, an id or a file name; more than one raises."""
    plain = reference.removeprefix("sha256-").lower()
    hit = (F.col("docref") == reference) | (F.col("id") == reference) | (F.element_at(F.split("path", "/"), -1) == reference)
    if len(plain) >= 8 and all(c in "0123456789abcdef" for c in plain):
        hit = hit | F.startswith(F.col("docref"), F.lit("sha256-" + plain))
    found = docs.where(hit).select("docref").distinct()
    many = found.limit(2).count()
    if many != 1:
        raise LookupError(f"{'no document' if not many else 'more than one document'}: {reference}")
    return docs.join(found, "docref", "left_semi")


def units_at(times: DataFrame, units: DataFrame) -> DataFrame:
    """Moments (docref, t) with the unit that holds each, t0 <= t < t1; a recording's very end is in its last unit. Units
    and moments are walked once, in their order."""
    upto = Window.partitionBy("docref").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = F.struct(F.col("id").cast("string").alias("id"), F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"))
    starts = units.select("docref", F.col("t0").cast("double").alias("at"), F.lit(0).alias("kind"), u.alias("u"))
    asked = times.select("docref", F.col("t").cast("double").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["u"].dataType).alias("u")).distinct()
    both = starts.unionByName(asked).withColumn("last", F.last("u", ignorenulls=True).over(upto))
    ends = units.groupBy("docref").agg(F.max("t1").cast("double").alias("end"))
    held = both.where("kind = 1").join(ends, "docref", "left")
    inside = (F.col("at") < F.col("last.t1")) | ((F.col("at") == F.col("end")) & (F.col("last.t1") == F.col("end")))
    found = held.where(inside).select("docref", F.col("at").alias("t"), F.col("last.id").alias("unit"))
    return times.join(found, ["docref", "t"], "left")


def quote_support(quote: Column, passage: Column) -> Column:
    """`literal` if the passage holds the quotation but for white space, `words` if it holds 80 % of its words, or none."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    own, other = F.array_distinct(T.tokens(quote)), F.array_distinct(T.tokens(passage))
    share = F.size(F.array_intersect(own, other)) / F.size(own)
    return F.when(F.length(flat(quote)) == 0, F.lit("none")).when(F.contains(flat(passage), flat(quote)), F.lit("literal")).when((F.size(own) > 0) & (share >= 0.8), F.lit("words")).otherwise(F.lit("none"))


def loops(text: Column, times: int = 7) -> Column:
    """Whether a text repeats itself like a stuck reader: a line, or 20 to 200 characters, `times` times in a row. A place
    is tried with 200 lengths at most, so the time is linear."""
    line = rf"(?:^|\n)([^\n]{{1,400}}+)(?:\n\1){{{times - 1}}}(?:\n|$)"
    return text.rlike(line) | text.rlike(rf"(?s)(.{{20,200}}?)\1{{{times - 1}}}")


def softmax(logits: Column, temperature: float = 1.0, prior: Column | None = None) -> Column:
    """Shares of an array of logits; with the shares of a content-free question, these are divided out."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    if prior is not None:
        powers = F.zip_with(powers, prior, lambda x, p: x / F.greatest(p, F.lit(1e-6)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def vector_digests(vectors: DataFrame) -> DataFrame:
    """Per document and space: the number of vectors, and SHA-256 of their data in the order of target and id. Spaces are
    hashed as they stream by, sorted inside a partition, so no space is held whole."""
    dealt = vectors.select(F.col("docref").cast("string"), F.col("space").cast("string"), F.col("target").cast("binary").alias("t"), F.col("id").cast("binary").alias("i"), "data")
    ordered = dealt.repartition("docref", "space").sortWithinPartitions("docref", "space", "t", "i")
    fields = pa.schema([("docref", pa.string()), ("space", pa.string()), ("count", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        own, count, digest = None, 0, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]]), pa.array([count]), pa.array([digest.hexdigest()])], schema=fields)

        for b in batches:
            for docref, space, data in zip(b["docref"].to_pylist(), b["space"].to_pylist(), b["data"]):
                if (docref, space) != own:
                    if own is not None:
                        yield told()
                    own, count, digest = (docref, space), 0, hashlib.sha256()
                count += 1
                digest.update(data.as_buffer() if data.is_valid else b"")
        if own is not None:
            yield told()

    return ordered.mapInArrow(run, "docref string, space string, count long, sha256 string")


def replace_space(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """Vectors with the spaces of `fresh` put in place of their older rows."""
    stale = fresh.select("docref", "space").distinct()
    return vectors.join(stale, ["docref", "space"], "left_anti").unionByName(fresh.select(vectors.columns))


def confident(values: DataFrame) -> DataFrame:
    """Metadata (docref, field, value, confidence, arrival): the surest value of each field, the first of equals."""
    best = F.min_by(F.struct("value", "confidence"), F.struct((-F.col("confidence")).alias("c"), "arrival"))
    return values.groupBy("docref", "field").agg(best.alias("b")).select("docref", "field", "b.value", "b.confidence")


def holding(docs: DataFrame, vectors: DataFrame, space: str) -> DataFrame:
    """Documents that have vectors of a space."""
    return docs.join(vectors.where(F.col("space") == space).select("docref").distinct(), "docref", "left_semi")


def with_figures(units: DataFrame, figures: DataFrame) -> DataFrame:
    """Units with an array of their figures (id, caption) in the order of their ids."""
    held = figures.groupBy("docref", F.col("unit").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("figure"), "caption"))).alias("figures"))
    return units.join(held, ["docref", "id"], "left")


def note_label(note: Column) -> Column:
    """The mark by which a footnote is called."""
    bracket, figure = F.regexp_extract(note, r"^\s*\[\^([^\]]+)\]", 1), F.regexp_extract(note, r"^\s*([0-9]{1,3})[.)]?\s", 1)
    raised, sign = F.translate(F.regexp_extract(note, "^\\s*([⁰¹²³⁴⁵⁶⁷⁸⁹]+)", 1), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"), F.regexp_extract(note, r"^\s*([*†‡§]+)", 1)
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(bracket), some(raised), some(figure), some(sign))


def note_calls(notes: DataFrame, fragments: DataFrame) -> DataFrame:
    """Footnotes (docref, unit, i, note) with the first passage (docref, n, unit, text) of their unit that calls them:
    docref, unit, i, n (null if none does)."""
    raised = F.transform(F.regexp_extract_all("text", F.lit("(?<=[\\p{L}.,;:!?»”\")])([⁰¹²³⁴⁵⁶⁷⁸⁹]+)"), F.lit(1)), lambda x: F.translate(x, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"))
    calls = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]+)\]"), F.lit(1)), raised))
    called = fragments.select("docref", "unit", "n", F.explode(calls).alias("label")).groupBy("docref", "unit", "label").agg(F.min("n").alias("n"))
    labelled = notes.select("docref", "unit", "i", note_label(F.col("note")).alias("label"))
    once = labelled.groupBy("docref", "unit", "label").agg(F.min("i").alias("i"))
    found = once.join(called, ["docref", "unit", "label"]).select("docref", "unit", "i", "n")
    return notes.select("docref", "unit", "i").join(found, ["docref", "unit", "i"], "left")


def annotated(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Items of sidecar files (sha256, ...) with the document (docref) of that hash, or null."""
    return items.join(docs.select(F.regexp_replace("docref", "^sha256-", "").alias("sha256"), "docref"), "sha256", "left")


def majority_language(pages: DataFrame) -> DataFrame:
    """The language of most pages (docref, language) of each document; ties go to the first name."""
    votes = pages.where("language is not null").groupBy("docref", "language").agg(F.count("*").alias("k"))
    return votes.groupBy("docref").agg(F.min_by("language", F.struct((-F.col("k")).alias("k"), "language")).alias("language"))


def distinct_titles(titles: DataFrame, units: DataFrame) -> DataFrame:
    """Titles (docref, unit, text) without those repeated like running heads: as often as 3 times and on 5 % of the units."""
    key = F.trim(T.token_line(F.col("text")))
    sizes = units.groupBy("docref").agg(F.count("*").alias("units"))
    seen = titles.withColumn("__key", key)
    often = seen.groupBy("docref", "__key").agg(F.count("*").alias("k")).join(sizes, "docref").where(F.col("k") >= F.greatest(F.lit(3.0), F.col("units") * 0.05))
    return seen.join(often.select("docref", "__key"), ["docref", "__key"], "left_anti").drop("__key")


def without_heads(paragraphs: DataFrame, heads: DataFrame, least: int = 3) -> DataFrame:
    """Paragraphs (docref, unit, para, text) without the running heads (docref, unit, text) that came into the body: short
    first or last paragraphs and headings whose words, numbers apart, are those of `least` heads or more."""
    from quire.functions.prose import markdown_title

    form = lambda x: F.trim(F.regexp_replace(F.regexp_replace(T.token_line(x), r"(?<= )(?:[0-9]+|[ivxlcdm]+)(?= )", ""), r"\s+", " "))
    often = heads.select("docref", form(F.col("text")).alias("form")).where(F.length("form") >= 4).groupBy("docref", "form").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    edge = Window.partitionBy("docref", "unit")
    title = markdown_title(F.col("text"))["text"]
    flagged = paragraphs.withColumn("__edge", (F.col("para") == F.min("para").over(edge)) | (F.col("para") == F.max("para").over(edge)))
    tried = flagged.withColumn("form", F.when(title.isNotNull(), form(title)).when(F.col("__edge") & (F.length("text") < 90), form(F.col("text"))))
    return tried.join(often.select("docref", "form"), ["docref", "form"], "left_anti").drop("__edge", "form")


def continues(pages: DataFrame) -> DataFrame:
    """Whether each page (docref, physical, text, footer) goes on with the text of the page before: docref, physical,
    continues. A catchword, a divided word, or an open sentence that a small letter follows."""
    w = Window.partitionBy("docref").orderBy("physical")
    before, foot = F.rtrim(F.lag("text").over(w)), F.lag("footer").over(w)
    rows = pages.select("docref", "physical", F.ltrim("text").alias("b"), before.alias("a"), F.element_at(F.split(F.trim(foot), r"\s+"), -1).alias("catch"))
    first = F.regexp_extract("b", r'^[#*\s«"(]*(\S*)', 1)
    letters = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]", "")
    caught = (F.length(letters(F.col("catch"))) >= 2) & F.startswith(letters(first), letters(F.col("catch")))
    small = first.rlike(r"^\p{Ll}")
    divided = F.col("a").rlike(r"\p{L}[-¬]$") & small
    open_ = ~F.col("a").rlike(r"[.!?:;»”\")\]]$") & (small | first.rlike("^[,;]"))
    both = F.coalesce((F.col("a") != "") & (F.col("b") != ""), F.lit(False))
    return rows.select("docref", "physical", (both & F.coalesce(caught | divided | open_, divided | open_, F.lit(False))).alias("continues"))
