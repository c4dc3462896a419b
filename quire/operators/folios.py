"""Printed page numbers: reading them off lines, and deducing those of pages without a reading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.prose import from_roman, roman

# Trust in the places where a number stands, and what lowers it.
TRUST = {"reader": 0.9, "footer": 0.9, "header": 0.85, "text-end": 0.6, "text-start": 0.5}
LOWERED = {"mended": 0.8, "year": 0.4, "long roman": 0.6, "inside": 0.6, "edge": 0.8}
DECORATION = r"[\s\-–—~.,:;*·•_=|\[\](){}<>«»‹›\"'“”‘’/\\]"


def token(text: Column) -> Column:
    """A number read from one token: a struct (value, roman, side, mended), or null. Figures, figures with the side of a
    leaf, Roman numerals of one case (early ones may end in j), and figures with letters misread in them."""
    t = F.regexp_replace(text, f"^{DECORATION}+|{DECORATION}+$", "")
    plain, side = F.regexp_extract(t, "^([0-9]{1,4})[rvRV]?$", 1), F.lower(F.regexp_extract(t, "^[0-9]{1,4}([rvRV])$", 1))
    mended = F.when(t.rlike("^[0-9lIO|o]{2,4}$") & t.rlike("[0-9]"), F.translate(t, "lI|Oo", "11100"))
    cased = t.rlike("^[ivxlcdmj]+$") | t.rlike("^[IVXLCDMJ]+$")
    early = F.when((F.length(t) > 1) & t.rlike("[jJ]$"), F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.lit("i"))).otherwise(t)
    numeral = from_roman(F.when(cased & (F.length(t) <= 9), F.lower(early)))
    made = lambda v, r, s, m: F.struct(v.cast("int").alias("value"), F.lit(r).alias("roman"), s.alias("side"), F.lit(m).alias("mended"))
    none = F.lit(None).cast("string")
    return F.when(plain != "", made(plain.try_cast("int"), False, F.nullif(side, F.lit("")), False)).when(mended.isNotNull() & mended.rlike("^[0-9]+$"), made(mended.try_cast("int"), False, none, True)).when(numeral.isNotNull(), made(numeral, True, none, False))


def candidates(lines: DataFrame) -> DataFrame:
    """Numbers that lines (docref, physical, place, line) may state as their page's: docref, physical, value, roman, side,
    weight. The whole line, or the ends of a short one; of numbers found in several places the surest counts, a little
    more for each further place."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"<[^>]+>", " "), r"^\s*#+\s*|[*_`]+", " "), r"\s+", " "))
    words = F.filter(F.split(clean, " "), lambda x: F.regexp_replace(x, DECORATION, "") != "")
    cut = lines.withColumn("words", words).where((F.size("words") > 0) & ~F.col("line").rlike("^\\s*[¹²³⁴⁵⁶⁷⁸⁹⁰]"))
    inside = F.col("place").isin("text-start", "text-end")
    short = (F.size("words") <= 8) & (F.length("line") <= 90)
    tried = cut.where((F.size("words") == 1) | (short & (~inside | (F.size("words") <= 4)))).select("docref", "physical", "place", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    tried = tried.where((F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | (F.col("n") <= 4)).withColumn("r", token(F.col("word"))).where("r is not null")
    base = F.lit(0.0)
    for place, trust in TRUST.items():
        base = F.when(F.col("place") == place, F.lit(trust)).otherwise(base)
    edge = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    weight = base * F.when(F.col("n") == 1, 1.0).when(edge, LOWERED["edge"]).otherwise(LOWERED["inside"]) * F.when(F.col("r.mended"), LOWERED["mended"]).otherwise(1.0)
    weight = weight * F.when(~F.col("r.roman") & F.col("r.value").between(1400, 2099) & (F.col("place") != "reader"), LOWERED["year"]).otherwise(1.0) * F.when(F.col("r.roman") & (F.col("r.value") > 60), LOWERED["long roman"]).otherwise(1.0)
    read = tried.select("docref", "physical", "place", "r.value", "r.roman", "r.side", weight.alias("weight"))
    merged = read.groupBy("docref", "physical", "value", "roman", "side").agg(F.max("weight").alias("w"), F.count_distinct("place").alias("places"))
    return merged.select("docref", "physical", "value", "roman", "side", F.least(F.lit(1.0), F.round(F.col("w") + 0.05 * (F.col("places") - 1), 3)).alias("weight"))


def chain(rows: list[tuple], reach: int = 150) -> list[bool]:
    """Which of the candidates (physical, value, roman, weight), in order of their page, make the heaviest chain of
    readings: each link adds its fit to the weights of both. Numbers that advance with the pages fit; pages without a
    number, missing leaves and the change from Roman to Arabic figures cost a little; all else breaks."""

    def fit(a: tuple, b: tuple) -> float:
        pages, steps = b[0] - a[0], b[1] - a[1]
        if a[2] and not b[2]:
            return 0.3 if b[1] <= 1 + pages else -1.0
        if a[2] != b[2]:
            return -3.0
        if steps == pages:
            return 1.0
        behind = pages - steps
        if 0 < behind <= min(4, pages - 1):
            return -0.9 - 0.1 * behind
        return -1.0 if -2 <= behind < 0 else -3.0

    best, back = [], []
    for k, row in enumerate(rows):
        top, link = 0.0, -1
        for j in range(k - 1, -1, -1):
            if row[0] - rows[j][0] > reach:
                break
            if rows[j][0] < row[0] and (score := best[j] + fit(rows[j], row)) > top:
                top, link = score, j
        best.append(row[3] + top)
        back.append(link)
    held = [False] * len(rows)
    k = max(range(len(rows)), key=best.__getitem__, default=-1)
    while k >= 0:
        held[k] = True
        k = back[k]
    return held


def readings(found: DataFrame, reach: int = 150) -> DataFrame:
    """The candidates (docref, physical, value, roman, side, weight) that hold: at most one a page, on one chain."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["physical", "weight", "value"], ascending=[True, False, True])
        return pdf[chain(list(zip(pdf["physical"], pdf["value"], pdf["roman"], pdf["weight"])), reach)]

    schema = "docref string, physical long, value int, roman boolean, side string, weight double"
    return found.select("docref", F.col("physical").cast("long"), "value", "roman", "side", "weight").groupBy("docref").applyInPandas(pick, schema)


def infer_folios(pages: DataFrame, reach: int = 4, least: int = 2) -> DataFrame:
    """Folios of pages (docref, physical, number): number is what was read, or null.

    A reading holds if `least` readings within `reach` pages, itself included, have the same difference to the physical
    page. Pages without one take the difference of the nearest holding readings on both sides if these agree (source
    `inferred`), and have no folio otherwise (source `none`)."""
    near = Window.partitionBy("docref", "d").orderBy("physical").rangeBetween(-reach, reach)
    diff = pages.withColumn("d", F.col("number") - F.col("physical")).withColumn("votes", F.count("*").over(near))
    held = diff.withColumn("d", F.when(F.col("votes") >= least, F.col("d")))
    w = Window.partitionBy("docref").orderBy("physical")
    before = F.last("d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("d", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    told = held.withColumn("before", before).withColumn("after", after)
    source = F.when(F.col("d").isNotNull(), F.lit("read")).when(F.col("before") == F.col("after"), F.lit("inferred")).otherwise(F.lit("none"))
    folio = F.when(source == "read", F.col("physical") + F.col("d")).when(source == "inferred", F.col("physical") + F.col("before"))
    return told.select("docref", "physical", folio.alias("folio"), source.alias("source"))


def folio_anchors(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Anchors (JSON) of pages (docref, physical) from the readings that hold: pages between two readings of one kind that
    advance with them are inferred, others have no folio."""
    w = Window.partitionBy("docref").orderBy("physical")
    r = F.struct("physical", "value", "roman", "side")
    met = pages.select("docref", F.col("physical").cast("long").alias("physical")).join(read.select("docref", "physical", "value", "roman", "side"), ["docref", "physical"], "left").withColumn("r", F.when(F.col("value").isNotNull(), r))
    before = F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    told = met.withColumn("before", before).withColumn("after", after)
    even = (F.col("after.roman") == F.col("before.roman")) & (F.col("after.value") - F.col("before.value") == F.col("after.physical") - F.col("before.physical"))
    guessed = F.when(F.col("r").isNull() & even, F.col("before.value") + F.col("physical") - F.col("before.physical"))
    value = F.coalesce("value", guessed)
    is_roman = F.coalesce(F.col("r.roman"), F.col("before.roman"), F.lit(False))

    @F.pandas_udf("string")
    def numerals(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None or x != x else roman(int(x)))

    printed = F.concat(F.when(is_roman, numerals(value)).otherwise(value.cast("string")), F.coalesce(F.col("side"), F.lit("")))
    source = F.when(F.col("r").isNotNull(), "read").when(guessed.isNotNull(), "inferred").otherwise("none")
    made = F.to_json(F.struct(F.lit("page").alias("type"), "physical", printed.alias("printed"), F.when(value.isNotNull(), is_roman).otherwise(F.lit(False)).alias("roman"), source.alias("source")), {"ignoreNullFields": "false"})
    return told.select("docref", "physical", made.alias("anchor"))


# Words of calibration charts, covers and plates.
CHART = r"(?i)\b(?:kodak|color control patches|gr[ae]y\s*scale|colorchecker|x-?rite|golden thread)\b"
COVER = r"(?i)\b(?:spine|lomo|dust\s*jacket|cover|cubierta)\b"
PLATE = r"(?i)^\s*(?:l[áa]m(?:ina)?|plate|tav(?:ola)?|taf(?:el)?|planche|fig(?:ura|ure)?)\.?\s*[0-9ivxlc]+"


def page_class(text: Column, header: Column, footer: Column, figures: Column) -> Column:
    """What a page is: blank, chart, apparatus, cover, plate, short or text. `figures`: how many it has."""
    t = F.trim(F.coalesce(text, F.lit("")))
    around = F.concat_ws("\n", header, t, footer)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    prose = F.exists(F.split(t, r"\n\s*\n"), lambda x: (F.size(F.split(F.trim(x), r"\s+")) >= 15) & ~x.rlike(r"^\s*#"))
    apparatus = around.rlike(r"(?i)\b(?:library of|biblioth?[eè]que|biblioteca)\b") | around.rlike(r"(?<![0-9])[0-9](?:[\s-]?[0-9]){10,}(?![0-9])")
    kind = F.when(t == "", F.when(F.coalesce(figures, F.lit(0)) > 0, "plate").otherwise("blank")).when(around.rlike(CHART), "chart").when((F.length(t) < 800) & apparatus, "apparatus").when((letters < 40) & around.rlike(COVER), "cover")
    return kind.when((F.coalesce(figures, F.lit(0)) > 0) & (letters < 300) & ~prose, "plate").when(t.rlike(PLATE) & (letters < 400), "plate").when(letters < 40, "short").otherwise("text")


def page_matter(kind: Column) -> Column:
    """The matter of a page by its class."""
    return F.when(kind.isin("blank", "cover", "plate"), kind).when(kind.isin("apparatus", "chart"), "library").otherwise("body")
