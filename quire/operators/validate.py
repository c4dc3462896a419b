"""Validation of a corpus as a table of issues (docref, code, place), one rule each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import anchors as A
from quire.operators.units import end_units

REQUIRED_META = ("content_version", "created", "generator", "language", "title")
PROFILES = {"W100": "semantic", "W101": "media"}


def _issues(df: DataFrame, code: str, place) -> DataFrame:
    return df.select("docref", F.lit(code).alias("code"), place.cast("string").alias("place"))


def missing_meta(meta: DataFrame, docs: DataFrame, keys=REQUIRED_META) -> DataFrame:
    """E012: required keys a document lacks."""
    want = docs.select("docref", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    return _issues(want.join(meta.select("docref", "key"), ["docref", "key"], "left_anti"), "E012", F.col("key"))


def bad_json(docs: DataFrame) -> DataFrame:
    """E050: metadata that is not JSON; E051: without a type or title that is text."""
    parsed = docs.withColumn("v", F.try_parse_json("metadata"))
    text = lambda k: F.get_json_object("metadata", f"$.{k}").isNotNull() & (F.schema_of_variant(F.variant_get("v", f"$.{k}", "variant")) == "STRING")
    e50 = _issues(parsed.where("v is null"), "E050", F.lit("metadata"))
    return e50.unionByName(_issues(parsed.where(F.col("v").isNotNull() & ~(F.coalesce(text("type") & text("title"), F.lit(False)))), "E051", F.lit("metadata")))


def bad_vectors(vectors: DataFrame, spaces: DataFrame) -> DataFrame:
    """E030: data of a wrong length; E031: an undeclared space; E032: an unknown storage type."""
    width = F.when(F.col("dtype") == "f32", 4).when(F.col("dtype") == "f16", 2).when(F.col("dtype") == "i8", 1)
    known = spaces.select("docref", F.col("id").alias("space"), "dims", "dtype")
    met = vectors.join(known, ["docref", "space"])
    e30 = _issues(met.where(width.isNotNull() & (F.length("data") != F.col("dims") * width)), "E030", F.col("id"))
    e31 = _issues(vectors.join(known, ["docref", "space"], "left_anti"), "E031", F.col("id"))
    return e30.unionByName(e31).unionByName(_issues(known.where(width.isNull()), "E032", F.col("space")))


def bad_anchors(table: DataFrame, column: str = "anchor") -> DataFrame:
    """E040, E041."""
    found = table.select("docref", "id", A.problem(F.col(column)).alias("code")).where("code is not null")
    return found.select("docref", "code", F.col("id").cast("string").alias("place"))


def bad_chars(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """E042: characters that are not inside the text of the start unit, or of the end unit for an end anchor."""
    sizes = units.select("docref", "id", "ord", F.length("text").alias("size"))
    starts = fragments.join(sizes.withColumnRenamed("id", "unit").drop("ord"), ["docref", "unit"]).select("docref", "id", F.col("anchor").alias("a"), "size")
    if "anchor_end" in fragments.columns:
        ends = fragments.where("anchor_end is not null").join(end_units(fragments, units).withColumnRenamed("end_ord", "ord"), ["docref", "n"])
        starts = starts.unionByName(ends.select("docref", "id", "ord", F.col("anchor_end").alias("a")).join(sizes.select("docref", "ord", "size"), ["docref", "ord"]).select("docref", "id", "a", "size"))
    found = starts.where(A.problem(F.col("a"), F.col("size")) == "E042")
    return _issues(found.select("docref", "id").distinct(), "E042", F.col("id"))


def bad_blobs(blobs: DataFrame) -> DataFrame:
    """E080: a hash that is not that of the data."""
    return _issues(blobs.where(F.sha2("data", 256) != F.lower("sha256")), "E080", F.col("key"))


def bad_order(units: DataFrame) -> DataFrame:
    """E090: units that are not numbered 1, 2, ..."""
    n = F.row_number().over(Window.partitionBy("docref").orderBy("ord"))
    first = units.select("docref", "ord", n.alias("n")).where("ord <> n").groupBy("docref").agg(F.min("n").alias("n"))
    return _issues(first, "E090", F.col("n"))


def bad_extensions(extensions: DataFrame, known: list[str]) -> DataFrame:
    """E060: a required extension that is not known."""
    return _issues(extensions.where((F.col("required") == 1) & ~F.col("name").isin(known)), "E060", F.col("name"))


def crossings(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """W103: passages that end in a unit of another matter than they start in, or that join a page with a folio and one
    without."""
    a = A.parsed(F.col("anchor"))
    page = F.when(a["type"] == "page", a["printed"].isNotNull())
    by_ord = units.select("docref", F.col("ord").alias("end_ord"), A.matter(a).alias("last"), page.alias("last_numbered"))
    by_id = units.select("docref", F.col("id").alias("unit"), A.matter(a).alias("first"), page.alias("first_numbered"))
    met = fragments.join(end_units(fragments, units), ["docref", "n"]).join(by_ord, ["docref", "end_ord"]).join(by_id, ["docref", "unit"])
    return _issues(met.where("first <> last or coalesce(first_numbered <> last_numbered, false)"), "W103", F.col("id"))


def not_one_document(containers: DataFrame, documents: DataFrame) -> DataFrame:
    """E013: containers (docref) that do not hold exactly one row of `documents`."""
    counts = documents.groupBy("docref").agg(F.count("*").alias("k"))
    return _issues(containers.select("docref").join(counts, "docref", "left").where(F.coalesce("k", F.lit(0)) != 1), "E013", F.lit("documents"))


def bad_hash(meta: DataFrame, hashes: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """E081: a stated content hash (meta: docref, key, value) that is not that of the dump (docref, content_sha256);
    looked at only where there is no error so far."""
    stated = meta.where("key = 'content_sha256'").select("docref", F.col("value").alias("stated"))
    if issues is not None:
        stated = stated.join(issues.where(F.startswith("code", F.lit("E"))).select("docref").distinct(), "docref", "left_anti")
    return _issues(stated.join(hashes, "docref", "left").where(~F.col("stated").eqNullSafe(F.col("content_sha256"))), "E081", F.lit("content_sha256"))


def profile_warnings(docs: DataFrame, units: DataFrame, vectors: DataFrame) -> DataFrame:
    """W100, W101: a profile (docs: docref, profile, unit_count) whose vectors or time anchors are absent; W102: a stated
    count that is not the number of units."""
    timed = units.where(F.get_json_object("anchor", "$.type") == "time").select("docref").distinct()
    has = lambda name: F.array_contains(F.split("profile", r"\s+"), name)
    w100 = _issues(docs.where(has(PROFILES["W100"])).join(vectors.select("docref").distinct(), "docref", "left_anti"), "W100", F.lit("vectors"))
    w101 = _issues(docs.where(has(PROFILES["W101"])).join(timed, "docref", "left_anti"), "W101", F.lit("units"))
    counted = docs.join(units.groupBy("docref").agg(F.count("*").alias("k")), "docref", "left")
    return w100.unionByName(w101).unionByName(_issues(counted.where(F.col("unit_count") != F.coalesce("k", F.lit(0))), "W102", F.lit("unit_count")))


def histogram(issues: DataFrame, examples: int = 3) -> DataFrame:
    """How often each code occurs, with its first places in order: code, times, documents, examples."""
    w = Window.partitionBy("code").orderBy("docref", "place")
    first = issues.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("r", "docref", "place"))).alias("e"))
    counts = issues.groupBy("code").agg(F.count("*").alias("times"), F.count_distinct("docref").alias("documents"))
    return counts.join(first, "code").select("code", "times", "documents", F.transform("e", lambda x: F.concat_ws("/", x["docref"], x["place"])).alias("examples"))


def verdicts(docs: DataFrame, *issues: DataFrame) -> DataFrame:
    """Per document: whether it is valid, and the sets of error and warning codes."""
    all_ = reduce(DataFrame.unionByName, issues)
    codes = all_.groupBy("docref").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    of = lambda letter: F.coalesce(F.filter("codes", lambda c: c.startswith(letter)), F.array().cast("array<string>"))
    out = docs.select("docref").join(codes, "docref", "left")
    return out.select("docref", (F.size(of("E")) == 0).alias("valid"), of("E").alias("errors"), of("W").alias("warnings"))
