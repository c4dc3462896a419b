"""Operators over documents held as units, passages and sections, all keyed by docref.

Anchors are columns of JSON. References find units and passages by equi-joins on the keys of their rule, so a document's
references never meet all of its units. Folds whose steps depend on what went before run per document, in parallel over
documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import anchors as A
from quire.functions import cite as C
from quire.functions import prose as P


def anchor_uris(docref: Column, anchor: Column, end: Column | None = None, scheme: str = A.SCHEME) -> Column:
    """URIs of anchors held as JSON."""
    return A.uri(docref, A.parsed(anchor), None if end is None else A.parsed(end), scheme)


def citations(anchor: Column, end: Column | None, metadata: Column, locale: str = "en") -> Column:
    """Citations of anchors and CSL-JSON items held as JSON."""
    return C.cite(A.parsed(anchor), None if end is None else A.parsed(end), C.item_of(metadata), locale)


def end_units(fragments: DataFrame, units: DataFrame) -> DataFrame:
    """Each passage (docref, n) with the ord of its end unit: the first after its start whose identity is that of
    anchor_end."""
    ends = fragments.where("anchor_end is not null").select("docref", "n", "unit", A.identity(F.col("anchor_end")).alias("identity"))
    start = units.select("docref", F.col("id").alias("unit"), F.col("ord").alias("start_ord"))
    later = units.select("docref", A.identity(F.col("anchor")).alias("identity"), "ord")
    found = ends.join(start, ["docref", "unit"]).join(later, ["docref", "identity"]).where("ord > start_ord")
    return found.groupBy("docref", "n").agg(F.min("ord").alias("end_ord"))


# -- references ------------------------------------------------------------------------------------------------------


def references(refs: DataFrame, scheme: str = A.SCHEME, names: DataFrame | None = None) -> DataFrame:
    """Parsed references (docref, reference): document, locator, error. `names`: docref and other ids of documents."""
    text = F.col("reference")
    after = F.when(F.contains(text, F.lit("#")), F.substring(text, F.instr(text, F.lit("#")) + 1, F.length(text)))
    is_uri = F.startswith(text, F.lit(f"{scheme}:"))
    named = F.when(is_uri, A.plain(F.substring_index(F.substring(text, F.lit(len(scheme) + 2), F.length(text)), "#", 1)))
    both = refs.select("docref", "reference").distinct().select("docref", "reference", named.alias("named"), is_uri.alias("is_uri"), A.parse_parameters(after).alias("p"))
    own = F.col("named") == F.col("docref")
    if names is not None:
        both = both.join(names.select("docref", F.col("id").alias("__id")), "docref", "left")
        own = own | (F.col("named") == F.col("__id"))
    error = F.when(F.col("is_uri") & F.col("named").isNull(), "percent-encoding that gives no UTF-8").when(F.col("named") == "", "no document reference").otherwise(F.col("p.error"))
    return both.select("docref", "reference", F.coalesce(own, F.lit(True)).alias("own"), F.col("p.locator").alias("locator"), error.alias("error")).select("docref", "reference", (F.col("error").isNull() & F.col("own")).alias("document"), "locator", "error")


def locate(units: DataFrame, fragments: DataFrame, refs: DataFrame, scheme: str = A.SCHEME, names: DataFrame | None = None) -> DataFrame:
    """Units and passages that references (docref, reference) designate: docref, reference, document, units, fragments,
    char, xywh, error. Units and passages stand under the keys of their anchors, and references look under theirs."""
    told = references(refs, scheme, names)
    u = units.select("docref", "id", "ord", A.parsed(F.col("anchor")).alias("a"), "printed")
    of_doc = u.groupBy("docref").agg(F.max("a.physical").cast("long").alias("pages"), F.max(F.when(F.col("a.type") == "time", F.col("ord"))).alias("last_timed"))
    asked = told.where("document").join(of_doc.select("docref", "pages"), "docref", "left").withColumn("rule", A.rule(F.col("locator")))
    look = asked.where("rule is not null").select("docref", "reference", "locator", "rule", F.explode(A.reference_keys(F.col("locator"), F.col("pages"))).alias("key"))

    starts = units.select("docref", F.col("id").alias("unit"), F.col("ord").alias("start_ord"))
    f = fragments.join(starts, ["docref", "unit"], "left").join(end_units(fragments, units), ["docref", "n"], "left")
    f = f.withColumn("a", A.parsed(F.col("anchor"))).withColumn("e", A.parsed(F.col("anchor_end")))
    frag = F.struct("n", "id", "unit", F.col("start_ord").cast("long").alias("start_ord"), F.col("a.chars").alias("chars"), F.col("end_ord").cast("long").alias("end_ord"), F.col("e.chars").alias("end_chars"))
    f = f.select("docref", frag.alias("frag"), F.explode(F.array("a", "e")).alias("a")).where("a is not null")
    unit = F.struct(F.col("ord").cast("long").alias("ord"), "id")
    u_rows = u.join(of_doc.select("docref", "last_timed"), "docref").select("docref", "a", "printed", (F.col("ord") == F.col("last_timed")).alias("last"), unit.alias("unit"), F.lit(None).cast(f.schema["frag"].dataType).alias("frag"))
    f_rows = f.select("docref", "a", F.col("a.printed").alias("printed"), F.lit(False).alias("last"), F.lit(None).cast(u_rows.schema["unit"].dataType).alias("unit"), "frag")
    under = u_rows.unionByName(f_rows).withColumn("k", F.explode(A.place_keys(F.col("a"), F.col("printed")))).select("docref", "k.rule", "k.key", "a", "printed", "last", "unit", "frag")
    met = look.join(under, ["docref", "rule", "key"]).where(A.matches(F.col("locator"), F.col("a"), F.col("printed"), F.coalesce("last", F.lit(False))))
    found = met.groupBy("docref", "reference").agg(F.array_sort(F.collect_set("unit")).alias("u"), F.array_sort(F.collect_set("frag")).alias("f"))
    fallback = F.array_sort(F.array_distinct(F.transform(F.filter("f", lambda x: x["start_ord"].isNotNull()), lambda x: F.struct(x["start_ord"].alias("ord"), x["unit"].alias("id")))))
    found = found.withColumn("u", F.when(F.size("u") > 0, F.col("u")).otherwise(fallback))
    out = told.join(found, ["docref", "reference"], "left")
    first, wanted = F.get("u", F.lit(0)), F.col("locator.char")
    inside = lambda x: ((x["unit"] == first["id"]) & A.overlaps(x["chars"], wanted)) | F.coalesce((x["end_ord"] == first["ord"]) & A.overlaps(x["end_chars"], wanted), F.lit(False))
    kept = F.filter("f", lambda x: wanted.isNull() | first.isNull() | inside(x))
    none = F.array().cast("array<string>")
    return out.select("docref", "reference", "document", F.coalesce(F.col("u.id"), none).alias("units"), F.coalesce(F.transform(kept, lambda x: x["id"]), none).alias("fragments"), F.when(F.col("document"), wanted).alias("char"), F.when(F.col("document"), F.col("locator.xywh")).alias("xywh"), "error")


def _part(text: Column, chars: Column) -> tuple[Column, Column]:
    """The part of a unit's text between two characters (all of it without them), and where it begins."""
    begin = F.coalesce(F.get(chars, F.lit(0)), F.lit(0.0)).cast("int")
    end = F.coalesce(F.get(chars, F.lit(1)), F.length(text).cast("double")).cast("int")
    return F.substring(text, begin + 1, end - begin), begin


def cite_passages(quotes: DataFrame, units: DataFrame, fragments: DataFrame, items: DataFrame, locale: str = "en", scheme: str = A.SCHEME) -> DataFrame:
    """Quotations (docref, fragment, quote) with the place where they stand: text and uri, or an error.

    items: docref, metadata. The start part of a passage is looked at first, then its end part, then both together."""
    f = fragments.select("docref", F.col("id").alias("fragment"), "n", "unit", A.parsed(F.col("anchor")).alias("fa"), A.parsed(F.col("anchor_end")).alias("fe"), F.col("text").alias("ftext"))
    start = units.select("docref", F.col("id").alias("unit"), A.parsed(F.col("anchor")).alias("ua"), F.col("text").alias("utext"))
    end = units.select("docref", F.col("ord").alias("end_ord"), A.parsed(F.col("anchor")).alias("ea"), F.col("text").alias("etext"))
    met = quotes.join(f, ["docref", "fragment"], "left").join(start, ["docref", "unit"], "left").join(end_units(fragments, units), ["docref", "n"], "left").join(end, ["docref", "end_ord"], "left").join(items, "docref", "left")
    one, one_at = _part(F.col("utext"), F.col("fa.chars"))
    two, two_at = _part(F.col("etext"), F.col("fe.chars"))
    met = met.withColumn("i", F.instr(one, F.col("quote"))).withColumn("j", F.instr(two, F.col("quote")))
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    spans = F.col("ea").isNotNull() & (F.contains(flat(F.concat_ws(" ", one, two)), flat(F.col("quote"))) | F.contains(flat(F.coalesce("ftext", F.lit(""))), flat(F.col("quote"))))
    placed = lambda a, at, k: F.col(a).withField("chars", F.array((at + F.col(k) - 1).cast("double"), (at + F.col(k) - 1 + F.length("quote")).cast("double")))
    bare = lambda a: F.col(a).withField("chars", F.lit(None).cast("array<double>"))
    where = F.when((F.col("quote") == "") | F.col("quote").isNull(), "empty").when(F.col("i") > 0, "start").when(F.col("j") > 0, "end").when(spans, "both").otherwise("none")
    met = met.withColumn("where", where)
    anchor = F.when(F.col("where") == "start", placed("ua", one_at, "i")).when(F.col("where") == "end", placed("ea", two_at, "j")).when(F.col("where") == "both", bare("ua"))
    met = met.withColumn("anchor", anchor).withColumn("to", F.when(F.col("where") == "both", bare("ea")))
    error = F.when(F.col("n").isNull(), "no such passage").when(F.col("where") == "empty", "an empty quotation").when(F.col("where") == "none", "the quotation is not in the passage")
    return met.select("docref", "fragment", "quote", C.cite(F.col("anchor"), F.col("to"), C.item_of(F.col("metadata")), locale).alias("text"), A.uri(F.col("docref"), F.col("anchor"), F.col("to"), scheme).alias("uri"), error.alias("error"))


def folio_query(text: Column, scheme: str = A.SCHEME) -> Column:
    """What a reader means by the text of a place: a struct (kind, first, last, value), or null.

    `uri`; `physical` for `p=12`, `#12` and ranges of them; `printed` for all else, labels and brackets taken off."""
    s = F.trim(text)
    pages = r"(?i)^(?:p\s*=\s*|#\s*)([0-9]+)(?:\s*[-–]\s*([0-9]+))?$"
    first, last = F.regexp_extract(s, pages, 1).try_cast("long"), F.regexp_extract(s, pages, 2).try_cast("long")
    label = r"(?i)^(?:f\s*=\s*|(?:pp?|p[áa]gs?|p[áa]ginas?|pages?|fols?|folios?|f|cols?)\.?\s+|(?:pp?|fols?|f)\.\s*)"
    value = F.trim(F.regexp_replace(s, label, ""))
    value = F.when(value.rlike(r"^\[[^\]]+\]$"), F.trim(F.substring(value, F.lit(2), F.length(value) - 2))).otherwise(value)
    none = F.lit(None).cast("long")
    made = lambda kind, a, b, v: F.struct(F.lit(kind).alias("kind"), a.alias("first"), b.alias("last"), v.alias("value"))
    wrong = (first < 1) | F.coalesce(last < first, F.lit(False))
    out = F.when((s == "") | s.isNull(), None).when(F.startswith(F.lower(s), F.lit(f"{scheme}:")), made("uri", none, none, s))
    return out.when(s.rlike(pages) & ~wrong, made("physical", first, F.nullif(last, first), F.lit(None).cast("string"))).when(s.rlike(pages) | (value == ""), None).otherwise(made("printed", none, none, value))


def read_passages(requests: DataFrame, units: DataFrame, fragments: DataFrame, docs: DataFrame, locale: str = "en", scheme: str = A.SCHEME) -> DataFrame:
    """Passages asked for (docref, fragment_id, folio, page, time; one of the last four set): text, citation, anchor_uri,
    unit_id, warnings and error. A page that is not there is an error, never another page. docs: docref, metadata."""
    asked = requests.withColumn("reference", F.when(F.col("fragment_id").isNull(), F.coalesce(F.concat(F.lit("#f="), A.escaped(F.col("folio").cast("string"))), F.concat(F.lit("#p="), F.col("page").cast("string")), F.concat(F.lit("#t="), F.col("time").cast("string")))))
    found = locate(units, fragments, asked.where("reference is not null").select("docref", "reference"), scheme)
    found = found.select("docref", "reference", "units", F.get("units", F.lit(0)).alias("unit_id"))
    u = units.select("docref", F.col("id").alias("unit_id"), F.col("anchor").alias("ua"), F.col("text").alias("utext"), F.col("printed").alias("uprinted"))
    f = fragments.select("docref", F.col("id").alias("fragment_id"), "unit", F.col("anchor").alias("fa"), F.col("anchor_end").alias("fe"), F.col("text").alias("ftext"))
    met = asked.join(found, ["docref", "reference"], "left").join(u, ["docref", "unit_id"], "left")
    at = A.parsed(F.col("ua"))  # a unit found only through a passage that ends on the page is another page
    there = F.when(F.col("folio").isNotNull(), F.coalesce(F.col("uprinted") == F.col("folio").cast("string"), F.lit(False))).when(F.col("page").isNotNull(), at["physical"] == F.col("page")).otherwise(F.col("time").between(at["t0"], at["t1"]))
    met = met.withColumn("ua", F.when(there, F.col("ua"))).withColumn("unit_id", F.when(F.col("ua").isNotNull(), F.col("unit_id"))).withColumn("utext", F.when(F.col("ua").isNotNull(), F.col("utext"))).join(f, ["docref", "fragment_id"], "left").join(docs.select("docref", "metadata"), "docref", "left")
    a, e = A.parsed(F.coalesce("fa", "ua")), A.parsed(F.col("fe"))
    ask = F.coalesce(F.concat(F.lit("folio "), F.col("folio").cast("string")), F.concat(F.lit("page "), F.col("page").cast("string")), F.concat(F.lit("time "), F.col("time").cast("string")))
    error = F.when(F.col("fragment_id").isNotNull() & F.col("fa").isNull(), "no such passage").when(F.col("fragment_id").isNull() & F.col("reference").isNull(), "say which passage").when(F.col("fragment_id").isNull() & F.col("ua").isNull(), F.concat(F.lit("there is no "), ask))
    page = a["type"] == "page"
    warnings = F.array_compact(F.array(
        F.when(F.col("folio").isNotNull() & (F.size("units") > 1), F.concat(F.lit("the folio is on "), F.size("units").cast("string"), F.lit(" pages; the first is used"))),
        F.when(page & a["printed"].isNull(), F.lit("the page has no printed folio")),
        F.when(page & (a["source"] == "inferred"), F.lit("the folio is inferred, not read")),
    ))
    return met.select("docref", "fragment_id", "folio", "page", "time", F.coalesce("unit_id", "unit").alias("unit_id"), F.coalesce("ftext", "utext").alias("text"), C.cite(a, e, C.item_of(F.col("metadata")), locale).alias("citation"), A.uri(F.col("docref"), a, e, scheme).alias("anchor_uri"), warnings.alias("warnings"), error.alias("error"))


# -- sections --------------------------------------------------------------------------------------------------------


def section_paths(sections: DataFrame) -> DataFrame:
    """Each section with the titles from its root to itself: docref, id, path. Paths double their length each round, so
    any depth takes few; sections of a cycle have no root and are left out."""
    most = sections.groupBy("docref").count().agg(F.max("count")).first()[0] or 0
    state = sections.select("docref", "id", F.col("parent").alias("up"), F.array("title").alias("path"))
    for _ in range(int(most).bit_length()):
        above = state.select("docref", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        state = state.join(above, ["docref", "up"], "left").select("docref", "id", "next", F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path"), F.col("up").alias("was"), F.col("before").isNotNull().alias("met"))
        state = state.select("docref", "id", F.when(F.col("met"), F.col("next")).otherwise(F.col("was")).alias("up"), "path")
    return state.where("up is null").select("docref", "id", "path")


def _levels(sections: DataFrame) -> list[int]:
    return [r[0] for r in sections.select("level").distinct().orderBy("level").collect()]  # a handful of numbers


def section_ends(sections: DataFrame, last: DataFrame) -> DataFrame:
    """Each section's last unit: the one before the next section of the same or a higher level, or the document's last
    (`last`: docref, last_ord). Sections are (docref, id, level, start)."""
    ahead = Window.partitionBy("docref").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    end = F.lit(None).cast("long")
    for level in _levels(sections):
        nearest = F.min(F.when(F.col("level") <= level, F.col("start"))).over(ahead)
        end = F.when(F.col("level") == level, nearest).otherwise(end)
    found = sections.select("docref", "id", "level", "start", (end - 1).alias("__end"))
    return found.join(last, "docref").select("docref", "id", "level", "start", F.coalesce("__end", "last_ord").alias("end"))


def leaf_sections(units: DataFrame, sections: DataFrame) -> DataFrame:
    """Each unit with its innermost section: units (docref, id, ord), sections (docref, section, level, first, last)."""
    upto = Window.partitionBy("docref").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.lit(None)
    points = units.select("docref", F.col("ord").alias("at"), F.lit(1).alias("kind"), F.struct(*units.columns).alias("unit"), none.cast("int").alias("level"), none.cast("string").alias("section"), none.cast("long").alias("last"))
    begins = sections.select("docref", F.col("first").alias("at"), F.lit(0).alias("kind"), none.alias("unit"), F.col("level").cast("int").alias("level"), F.col("section").cast("string").alias("section"), F.col("last").cast("long").alias("last"))
    both = points.unionByName(begins.withColumn("unit", F.col("unit").cast(points.schema["unit"].dataType)))
    best = none.cast("string")
    for level in _levels(sections):
        open_ = F.last(F.when(F.col("level") == level, F.struct("section", "last")), ignorenulls=True).over(upto)
        best = F.when(open_["last"] >= F.col("at"), open_["section"]).otherwise(best)
    return both.select("kind", "unit", best.alias("section")).where("kind = 1").select("unit.*", "section")


def toc_matches(entries: DataFrame, paragraphs: DataFrame, reach: int = 1, sure: float = 0.6) -> DataFrame:
    """Entries of a table of contents (docref, entry, unit, title) with the paragraph (docref, unit, para, text) that their
    title resembles most, of the entry's unit and the `reach` next: docref, entry, unit, para, score. Entries without one
    that is `sure` stand at the first paragraph of their unit, with no score."""
    from quire.functions.text import dice

    near = entries.withColumn("at", F.explode(F.sequence(F.col("unit"), F.col("unit") + reach)))
    met = near.join(paragraphs.select("docref", F.col("unit").alias("at"), "para", F.substring("text", 1, 300).alias("text")), ["docref", "at"])
    title = P.markdown_title(F.col("text"))["text"]
    scored = met.withColumn("score", dice(F.coalesce(title, F.col("text")), F.col("title")))
    best = scored.where(F.col("score") >= sure).groupBy("docref", "entry").agg(F.max(F.struct("score", (-F.col("at")).alias("u"), (-F.col("para")).alias("p"))).alias("b"))
    out = entries.join(best, ["docref", "entry"], "left")
    return out.select("docref", "entry", F.coalesce(-F.col("b.u"), F.col("unit")).alias("unit"), F.coalesce(-F.col("b.p"), F.lit(0)).alias("para"), F.col("b.score").alias("score"))


# -- speech ----------------------------------------------------------------------------------------------------------

# Seconds and marks of sentences and segments.
PAUSE, LONG_PAUSE = 0.7, 2.5
SEGMENT = {"least": 30.0, "target": 45.0, "most": 60.0}
STOP = r"[.!?…][\"»”)]*$"


def speech_sentences(words: DataFrame) -> DataFrame:
    """Sentences of timed words (docref, i, word, t0, t1, speaker): docref, s, t0, t1, speaker, text, tokens.

    A sentence ends at a stop (in documents without any, at a pause), at a long pause, and where the speaker changes."""
    order = Window.partitionBy("docref").orderBy("i")
    stops = words.groupBy("docref").agg(F.max(F.col("word").rlike(STOP)).alias("stopped"))
    ahead = F.lead("t0").over(order) - F.col("t1")
    changes = F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & F.lag("i").over(order).isNotNull()
    flagged = words.join(stops, "docref").withColumn("pause", F.coalesce(ahead, F.lit(0.0))).withColumn("changes", changes)
    ends = F.when(F.col("stopped"), F.col("word").rlike(STOP)).otherwise(F.col("pause") > PAUSE) | (F.col("pause") > LONG_PAUSE)
    begins = F.coalesce(F.lag("ends").over(order), F.lit(False)) | F.col("changes")
    numbered = flagged.withColumn("ends", ends).withColumn("s", F.sum(begins.cast("long")).over(order))
    held = numbered.groupBy("docref", "s").agg(F.min("t0").alias("t0"), F.max_by("t1", "i").alias("t1"), F.min_by("speaker", "i").alias("speaker"), F.array_sort(F.collect_list(F.struct("i", "word", "t0", "t1"))).alias("tokens"))
    text = F.array_join(F.col("tokens.word"), " ")
    text = F.regexp_replace(F.regexp_replace(text, r" ([,.;:!?…»”)\]]+)(?= |$)", "$1"), r"(^| )([«“(¿¡\[]+) ", "$1$2")
    return held.select("docref", "s", "t0", "t1", "speaker", text.alias("text"), "tokens")


def segment_plan(rows: list[tuple], least: float = 30.0, target: float = 45.0, most: float = 60.0) -> list[int]:
    """Segment numbers of consecutive sentences (t0, t1, speaker).

    A segment closes once it has lasted `target`, before a sentence that would take it beyond `most`, and at a change of
    speaker from `least` on; a short last one joins the one before if that stays within a quarter beyond `most`."""
    out, starts = [], []
    begun = ended = said = None
    for t0, t1, speaker in rows:
        if begun is not None:
            held = ended - begun
            if t1 - begun > most or held >= target or (speaker is not None and speaker != said and held >= least):
                begun = None
        if begun is None:
            begun = t0
            starts.append(t0)
        out.append(len(starts) - 1)
        ended, said = t1, speaker
    if len(starts) > 1 and ended - starts[-1] < least / 2 and ended - starts[-2] <= 1.25 * most:
        out = [min(k, len(starts) - 2) for k in out]
    return out


def segments(words: DataFrame, least: float = 30.0, target: float = 45.0, most: float = 60.0) -> DataFrame:
    """Speech segments of timed words: docref, segment, t0, t1, speaker (who speaks longest), text. Where several speak,
    every turn is a paragraph with its speaker's label."""
    said = speech_sentences(words)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s")
        rows = zip(pdf["t0"], pdf["t1"], pdf["speaker"].where(pdf["speaker"].notna(), None))
        return pdf.assign(segment=segment_plan(list(rows), least, target, most))[["docref", "s", "segment"]]

    cut = said.select("docref", "s", "t0", "t1", "speaker").groupBy("docref").applyInPandas(plan, "docref string, s long, segment long")
    rows = said.join(cut, ["docref", "s"])
    spoken = rows.where("speaker is not null").groupBy("docref", "segment", "speaker").agg(F.sum(F.col("t1") - F.col("t0")).alias("d"), F.min("s").alias("from"))
    leads = spoken.groupBy("docref", "segment").agg(F.count("*").alias("voices"), F.max(F.struct("d", (-F.col("from")).alias("from"), "speaker"))["speaker"].alias("lead"))
    made = rows.groupBy("docref", "segment").agg(F.min("t0").alias("t0"), F.max_by("t1", "s").alias("t1"), F.array_sort(F.collect_list(F.struct("s", "speaker", "text"))).alias("x"))
    turn = lambda x, i: F.when((i > 0) & x["speaker"].eqNullSafe(F.get(F.col("x"), i - 1)["speaker"]), x["text"]).otherwise(F.concat(F.lit("\n\n**"), F.coalesce(x["speaker"], F.lit("?")), F.lit(":** "), x["text"]))
    several = F.regexp_replace(F.array_join(F.transform("x", turn), " "), r"\s*\n\n", "\n\n")
    text = F.when(F.col("voices") > 1, F.regexp_replace(several, r"^\n\n", "")).otherwise(F.array_join(F.col("x.text"), " "))
    return made.join(leads, ["docref", "segment"], "left").select("docref", "segment", F.bround("t0", 2).alias("t0"), F.bround("t1", 2).alias("t1"), F.col("lead").alias("speaker"), text.alias("text"))


def word_timings(tokens: Column, t0: Column) -> Column:
    """Timings of tokens (t0, t1) as JSON: centiseconds from the unit's start, a start and a duration for each."""
    base = F.rint(t0 * 100).cast("long")
    start = lambda x: F.greatest(F.lit(0).cast("long"), F.rint(x["t0"] * 100).cast("long") - base)
    pair = lambda x: F.array(start(x), F.greatest(F.lit(1).cast("long"), F.rint(x["t1"] * 100).cast("long") - base - start(x)))
    return F.to_json(F.struct(F.lit(1).alias("v"), (base / 100).alias("t0"), F.flatten(F.transform(tokens, pair)).alias("cs")))


# -- passages --------------------------------------------------------------------------------------------------------


def chunk_plan(sizes: list[int], titles: list[bool] | None = None, least: int = 250, target: int = 350, most: int = 450) -> list[int]:
    """Passage numbers of consecutive paragraphs by their tokens: a passage closes once it holds `target`, before a
    paragraph that would take it over `most`, and before a title once it holds most of `least`; a short last one joins the
    one before if both fit together."""
    out, held = [], []
    for i, size in enumerate(sizes):
        title = bool(titles and titles[i])
        close = held and (held[-1] >= (0.6 * least if title else target) or held[-1] + size > most)
        if close or not held:
            held.append(0)
        held[-1] += size
        out.append(len(held) - 1)
    if len(held) > 1 and held[-1] < 0.4 * least and held[-2] + held[-1] <= most:
        out = [min(k, len(held) - 2) for k in out]
    return out


def chunks(paragraphs: DataFrame, least: int = 250, target: int = 350, most: int = 450) -> DataFrame:
    """Passages of paragraphs (docref, section, i, text, tokens; perhaps title): docref, section, n, text. None crosses a
    section; to keep matters or numbered pages apart, tell them apart in `section`. Paragraphs over `most` are cut
    between sentences first."""
    titled = F.col("title") if "title" in paragraphs.columns else F.lit(False)
    rows = paragraphs.select("docref", "section", "i", "text", "tokens", titled.alias("title"))
    long = rows.where(F.col("tokens") > most)
    sentences = long.select("docref", "section", "i", F.posexplode(P.split_sentences(F.col("text"))).alias("k", "text"))
    from quire.functions.text import count_tokens

    cut = sentences.select("docref", "section", "i", "k", "text", count_tokens(F.col("text")).alias("tokens"), F.lit(False).alias("title"))
    whole = rows.where(F.col("tokens") <= most).select("docref", "section", "i", F.lit(0).alias("k"), "text", "tokens", "title").unionByName(cut)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "k"])
        return pdf.assign(n=chunk_plan(pdf["tokens"].tolist(), pdf["title"].tolist(), least, target, most))[["docref", "section", "i", "k", "n"]]

    numbered = whole.select("docref", "section", "i", "k", "tokens", "title").groupBy("docref", "section").applyInPandas(plan, "docref string, section string, i long, k int, n long")
    held = whole.join(numbered, ["docref", "section", "i", "k"])
    joined = held.groupBy("docref", "section", "n", "i").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "text")))["text"], " ").alias("text"))
    made = joined.groupBy("docref", "section", "n").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("p"))
    return made.select("docref", "section", "n", F.array_join(F.col("p.text"), "\n\n").alias("text"))


def char_ranges(fragments: DataFrame, units: DataFrame, edge: int = 40) -> DataFrame:
    """Passages (docref, n, unit, text) with the characters of their unit that they cover, where their first and last
    `edge` characters stand there exactly once: docref, n, chars (null if they do not)."""
    met = fragments.join(units.select("docref", F.col("id").alias("unit"), F.col("text").alias("whole")), ["docref", "unit"], "left")
    body = F.trim(F.col("text"))
    head, tail = F.substring(body, F.lit(1), F.lit(edge)), F.substring(body, F.length(body) - edge + 1, F.lit(edge))
    position = lambda part, start: F.call_function("locate", part, F.col("whole"), start)
    first = position(head, F.lit(1))
    last = position(tail, F.greatest(first, F.lit(1)))
    alone = (first > 0) & (position(head, first + 1) == 0) & (last > 0) & (position(tail, last + 1) == 0) & (F.length(body) >= edge)
    return met.select("docref", "n", F.when(alone, F.array(first - 1, last - 1 + edge)).alias("chars"))


def context_lines(fragments: DataFrame, docs: DataFrame) -> DataFrame:
    """One line that situates each passage (docref, n, section array): title, names, year and heading path."""
    item = C.item_of(F.col("metadata"))
    parts = F.concat_ws(", ", F.concat(F.lit("«"), item["title"], F.lit("»")), F.nullif(F.array_join(F.filter(F.transform(item["author"], C.person), lambda x: x.isNotNull()), ", "), F.lit("")), C.first_year(item).cast("string"), F.nullif(F.array_join("section", " › "), F.lit("")))
    return fragments.join(docs, "docref", "left").select("docref", "n", F.concat(parts, F.lit(".")).alias("context"))
