"""Flat records, quotation selectors, manifests, and page exports of documents, as columns of JSON, XML or plain values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import anchors as A
from quire.functions import cite as C

CONTEXT = 32  # characters before and after a quotation


def records(passages: DataFrame, docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows for a vector store: id, text, and a map of those `keep` columns of the passage's document that are not null."""
    named = docs.select("docref", F.map_filter(F.create_map(*[x for c in keep for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()).alias("metadata"))
    return passages.join(named, "docref", "left").select(F.concat_ws("#", "docref", "n").alias("id"), "docref", "n", "text", "metadata")


def quote_selector(text: Column, start: Column, end: Column) -> Column:
    """A text quotation with its context, for code points start (included) to end of a text."""
    before = F.greatest(start - CONTEXT, F.lit(0))
    return F.struct(
        F.lit("TextQuoteSelector").alias("type"),
        F.substring(text, start + 1, end - start).alias("exact"),
        F.substring(text, before + 1, start - before).alias("prefix"),
        F.substring(text, end + 1, F.lit(CONTEXT)).alias("suffix"),
    )


def annotations(quotes: DataFrame, units: DataFrame) -> DataFrame:
    """Web annotations of quotations (docref, unit, start, end, body, uri): docref, annotation as JSON."""
    met = quotes.join(units.select("docref", F.col("id").alias("unit"), "text"), ["docref", "unit"])
    target = F.struct(F.col("uri").alias("source"), quote_selector(F.col("text"), F.col("start"), F.col("end")).alias("selector"))
    motive = F.when(F.col("body").isNull(), F.lit("highlighting")).otherwise(F.lit("commenting"))
    body = F.when(F.col("body").isNotNull(), F.struct(F.lit("TextualBody").alias("type"), F.col("body").alias("value")))
    made = F.struct(F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"), F.lit("Annotation").alias("type"), motive.alias("motivation"), body.alias("body"), target.alias("target"))
    return met.select("docref", F.to_json(made).alias("annotation"))


_ANNOTATION = "type string, motivation string, body struct<value:string>, target struct<source:string,selector:struct<exact:string,prefix:string,suffix:string>>"


def read_annotations(rows: DataFrame, column: str = "annotation") -> DataFrame:
    """Web annotations (JSON, one a row) as columns: uri, exact, prefix, suffix, body, motivation."""
    a = F.from_json(F.col(column), _ANNOTATION)
    parts = [a["target"]["source"].alias("uri"), *[a["target"]["selector"][k].alias(k) for k in ("exact", "prefix", "suffix")], a["body"]["value"].alias("body"), a["motivation"].alias("motivation")]
    return rows.select("*", *parts)


def manifests(items: DataFrame) -> DataFrame:
    """Libraries (library, place, sha256, title) as JSON, items in their place; a hash that is none raises an error."""
    good = F.when(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.col("sha256")).otherwise(F.raise_error(F.lit("not a SHA-256")))
    held = items.select("library", F.struct("place", good.alias("sha256"), "title").alias("item"))
    by = held.groupBy("library").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return by.select("library", F.to_json(F.struct(F.col("library").alias("title"), F.transform("items", lambda x: F.struct(x["sha256"].alias("sha256"), x["title"].alias("title"))).alias("items"))).alias("manifest"))


def read_manifests(rows: DataFrame, column: str = "manifest") -> DataFrame:
    """Items of library manifests (JSON, one a row): library, place (from 1), sha256, title."""
    m = F.from_json(F.col(column), "title string, items array<struct<sha256:string,title:string>>")
    return rows.select(m["title"].alias("library"), F.posexplode(m["items"]).alias("i", "x")).select("library", (F.col("i") + 1).alias("place"), "x.sha256", "x.title")


# -- pages -----------------------------------------------------------------------------------------------------------


def escaped_xml(text: Column) -> Column:
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def page_sequence(units: DataFrame) -> DataFrame:
    """The page numbers that exports state, in order: docref, ord, physical, printed (as ALTO has it: none that is
    inferred), n (as TEI and IIIF have it: as cited)."""
    a = A.parsed(F.col("anchor"))
    read = F.when(~F.coalesce(a["source"] == "inferred", F.lit(False)), a["printed"])
    return units.where(a["type"] == "page").select("docref", "ord", a["physical"].cast("long").alias("physical"), read.alias("printed"), C.cited_folio(a).alias("n"))


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escaped_xml(value.cast("string")), F.lit('"'))).otherwise(F.lit(""))


def _whole(units: DataFrame, part: Column, head: Column, tail: str, docs: DataFrame | None = None) -> DataFrame:
    """One text for each document from the parts of its units in order."""
    held = units.select("docref", "ord", part.alias("part")).groupBy("docref").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    held = held.join(docs, "docref", "left") if docs is not None else held
    return held.select("docref", F.concat(head, F.array_join(F.col("p.part"), "\n"), F.lit(tail)).alias("text"))


def alto(units: DataFrame) -> DataFrame:
    """ALTO 4 of paged documents: docref, text. A block for each paragraph and a line for each line; no coordinates."""
    a = A.parsed(F.col("anchor"))
    read = F.when(~F.coalesce(a["source"] == "inferred", F.lit(False)), a["printed"])
    line = lambda x: F.concat(F.lit('<TextLine><String CONTENT="'), escaped_xml(F.trim(x)), F.lit('"/></TextLine>'))
    block = lambda p: F.concat(F.lit("<TextBlock>"), F.array_join(F.transform(F.filter(F.split(p, "\n"), lambda x: F.trim(x) != ""), line), ""), F.lit("</TextBlock>"))
    blocks = F.array_join(F.transform(F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != ""), block), "")
    page = F.concat(F.lit("<Page"), _attribute("ID", F.col("id")), _attribute("PHYSICAL_IMG_NR", a["physical"].cast("long")), _attribute("PRINTED_IMG_NR", read), F.lit("><PrintSpace>"), blocks, F.lit("</PrintSpace></Page>"))
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout>\n')
    return _whole(units.where(a["type"] == "page"), page, head, "\n</Layout></alto>")


def tei(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Minimal TEI of documents (docs: docref, metadata): docref, text. Page breaks carry the folio as cited; verse becomes
    lines, speaker turns utterances, other text paragraphs."""
    a, item = A.parsed(F.col("anchor")), C.item_of(F.col("metadata"))
    said = r"^\*\*([^*]+):\*\* (.*)$"
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "")
    speech = lambda p: F.concat(F.lit("<u"), _attribute("who", F.concat(F.lit("#"), F.regexp_replace(F.regexp_extract(p, f"(?s){said}", 1), r"\s+", "_"))), F.lit(">"), escaped_xml(F.regexp_extract(p, f"(?s){said}", 2)), F.lit("</u>"))
    para = lambda p: F.when(p.rlike(f"(?s){said}"), speech(p)).otherwise(F.concat(F.lit("<p>"), escaped_xml(F.trim(p)), F.lit("</p>")))
    first = a["line_from"].cast("long")
    verse = F.concat(F.lit("<lg>"), F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x, i: F.concat(F.lit("<l"), _attribute("n", first + i), F.lit(">"), escaped_xml(x), F.lit("</l>"))), ""), F.lit("</lg>"))
    body = F.when(a["type"] == "verse", verse).otherwise(F.array_join(F.transform(paragraphs, para), "\n"))
    facs = _attribute("facs", F.col("image")) if "image" in units.columns else F.lit("")
    part = F.concat(F.when(a["type"] == "page", F.concat(F.lit("<pb"), _attribute("n", C.cited_folio(a)), facs, F.lit("/>"))).otherwise(F.lit("")), body)
    names = F.array_join(F.transform(F.filter(F.transform(item["author"], C.person), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("<author>"), escaped_xml(x), F.lit("</author>"))), "")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), escaped_xml(F.coalesce(item["title"], F.lit(""))), F.lit("</title>"), F.coalesce(names, F.lit("")), F.lit("</titleStmt><publicationStmt><p/></publicationStmt><sourceDesc><p>"), escaped_xml(F.concat_ws(", ", item["publisher"], C.first_year(item).cast("string"))), F.lit("</p></sourceDesc></fileDesc></teiHeader><text><body>\n"))
    return _whole(units, part, head, "\n</body></text></TEI>", docs)


def iiif(units: DataFrame, docs: DataFrame, base: str) -> DataFrame:
    """IIIF 3 manifests of documents (docs: docref, metadata) under a base address: docref, manifest. A canvas for each
    unit; recordings have one canvas in time and a range for each unit."""
    a = A.parsed(F.col("anchor"))
    address = F.concat(F.lit(base.rstrip("/") + "/"), F.col("docref"))
    label = F.when(C.cited_folio(a).isNotNull(), F.struct(F.array(C.cited_folio(a)).alias("none")))
    place = F.concat(address, F.lit("/canvas/"), F.col("ord").cast("string"))
    text = F.struct(place.alias("id"), F.lit("Annotation").alias("type"), F.lit("supplementing").alias("motivation"), F.struct(F.lit("TextualBody").alias("type"), F.col("text").alias("value")).alias("body"), place.alias("target"))
    canvas = F.struct("ord", F.struct(place.alias("id"), F.lit("Canvas").alias("type"), label.alias("label"), F.array(F.struct(F.lit("AnnotationPage").alias("type"), F.array(text).alias("items"))).alias("annotations")).alias("x"))
    span = F.struct("ord", F.struct(F.lit("Range").alias("type"), F.concat(address, F.lit("/canvas/1#t="), a["t0"].cast("string"), F.lit(","), a["t1"].cast("string")).alias("id")).alias("x"))
    timed = F.coalesce(a["type"] == "time", F.lit(False))
    by = units.groupBy("docref").agg(F.array_sort(F.collect_list(F.when(~timed, canvas))).alias("c"), F.array_sort(F.collect_list(F.when(timed, span))).alias("r"), F.max(a["t1"]).alias("duration"))
    met = by.join(docs, "docref", "left")
    title = F.struct(F.array(F.coalesce(C.item_of(F.col("metadata"))["title"], F.col("docref"))).alias("none"))
    recording = F.struct(F.concat(address, F.lit("/canvas/1")).alias("id"), F.lit("Canvas").alias("type"), F.col("duration").alias("duration"))
    head = [F.lit("http://iiif.io/api/presentation/3/context.json").alias("@context"), address.alias("id"), F.lit("Manifest").alias("type"), title.alias("label")]
    pages = F.to_json(F.struct(*head, F.col("c.x").alias("items")))
    media = F.to_json(F.struct(*head, F.array(recording).alias("items"), F.array(F.struct(F.lit("Range").alias("type"), F.col("r.x").alias("items"))).alias("structures")))
    return met.select("docref", F.when(F.size("r") > 0, media).otherwise(pages).alias("manifest"))
