"""Readers of document files into blocks: HTML, Markdown and plain text, CSV, and packed formats (office); over
`binaryFile` tables. A file that is not sound gives one block of kind `error`."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources import office

UNITS = "docref string, ord long, kind string, level int, text string"
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "form"}
BLOCKS = {"p", "li", "blockquote", "pre", "td", "th", "figcaption", "dd", "dt"}


# Classes of elements that mark where a printed page begins.
PAGE_MARKS = {"pagenum", "pageno", "x-ebookmaker-pageno", "pagebreak", "page-number", "page_number", "pagenumber", "pg-num", "pgnum", "page-num"}
OPEN_ENDED = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "br", "img", "hr", "meta", "link", "input"}


class _Blocks(HTMLParser):
    """Headings, page marks, verse and text blocks in order. A skipped element ends with itself or with an element that
    it stands in, so one that is never closed takes no more than its parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.open: list[str] = []
        self.skip_from, self.kind, self.level, self.text, self.mark = -1, "para", 0, [], ""

    def flush(self) -> None:
        lines = [" ".join(x.split()) for x in "".join(self.text).split("\n")]
        lines = [x for x in lines if x]
        if lines:
            verse = self.kind == "para" and len(lines) >= 3 and sum(len(x) < 60 for x in lines) >= 0.8 * len(lines)
            self.out.append(("verse" if verse else self.kind, self.level, ("\n" if verse else " ").join(lines)))
        self.kind, self.level, self.text = "para", 0, []

    def handle_starttag(self, tag, attrs):
        held = {k: v or "" for k, v in attrs}
        if tag not in OPEN_ENDED:
            self.open.append(tag)
        if self.skip_from >= 0:
            return
        if tag in SKIPPED:
            self.skip_from = len(self.open) - 1
        elif PAGE_MARKS & set(held.get("class", "").split()) or "pagebreak" in held.get("epub:type", "").split():
            self.flush()
            self.mark, self.kind = tag, "page"
            if held.get("title"):
                self.text = [held["title"]]
                self.flush()
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "title", int(tag[1])
        elif tag == "figcaption":
            self.flush()
            self.kind = "figure"
        elif tag == "br":
            self.text.append("\n")
        elif tag in BLOCKS or tag in ("div", "section", "article", "tr", "table", "ul", "ol"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if len(self.open) <= self.skip_from:
                self.skip_from = -1
        if self.skip_from < 0 and (re.fullmatch("h[1-6]", tag) or tag in BLOCKS or tag == "div" or tag == self.mark):
            self.flush()
            self.mark = ""

    def handle_data(self, data):
        if self.skip_from < 0:
            self.text.append(re.sub(r"\s+", " ", data))


def html_blocks(text: str) -> list[tuple[str, int, str]]:
    parser = _Blocks()
    title = re.search(r"(?is)<title[^>]*>.*?</title>", text)
    parser.feed(text.replace(title[0], "") if title else text)
    parser.close()
    parser.flush()
    return parser.out


def markdown_blocks(text: str) -> list[tuple[str, int, str]]:
    """Headings by # or underlining, and paragraphs; front matter between --- lines is left out."""
    text = re.sub(r"\A---\n.*?\n---\n", "", text.replace("\r\n", "\n"), flags=re.S)
    out = []
    for block in re.split(r"\n\s*\n", text):
        lines = [x.rstrip() for x in block.strip().split("\n") if x.strip()]
        if not lines:
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", lines[0]):
            out.append(("title", len(m[1]), m[2].strip(" #")))
            lines = lines[1:]
        elif len(lines) > 1 and re.fullmatch("=+|-+", lines[1]):
            out.append(("title", 1 if lines[1][0] == "=" else 2, lines[0]))
            lines = lines[2:]
        if lines:
            out.append(("para", 0, "\n".join(lines)))
    return out


def csv_blocks(text: str, size: int = 40) -> list[tuple[str, int, str]]:
    """Blocks of rows as Markdown tables under the first row's names; blank rows are dropped."""
    try:
        dialect = csv.Sniffer().sniff(text[:4096], ",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = [r for r in csv.reader(io.StringIO(text), dialect) if any(c.strip() for c in r)]
    head, body = (rows[0], rows[1:]) if rows else ([], [])
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return [("sheet", 0, "\n".join([line(head), line(["---"] * len(head)), *map(line, body[k : k + size])])) for k in range(0, len(body), size)]


def kind_of(name: str, data: bytes) -> str:
    """html, markdown, csv, epub, docx, odt, pptx, xlsx, zip, pdf, sqlite, gzip or text, by first bytes (of an archive, by
    its members) and then by name."""
    head = data[:512]
    for magic, kind in ((b"PK\x03\x04", "zip"), (b"%PDF-", "pdf"), (b"SQLite format 3\x00", "sqlite"), (b"\x1f\x8b", "gzip")):
        if head.startswith(magic):
            return office.kind_of_zip(data) if kind == "zip" else kind
    if re.match(rb"\s*(<!doctype html|<html)", head[:512].lower()) or name.lower().endswith((".html", ".htm", ".xhtml")):
        return "html"
    if name.lower().endswith((".csv", ".tsv")):
        return "csv"
    return "markdown" if name.lower().endswith((".md", ".markdown")) else "text"


READERS = {"html": html_blocks, "markdown": markdown_blocks, "text": markdown_blocks, "csv": csv_blocks}


def blocks(df: DataFrame, docref: str, name: str, content: str) -> DataFrame:
    """Units of files (name and content, binary or text); kinds without a reader give none."""

    def read(batches):
        for pdf in batches:
            rows = []
            for ref, path, data in zip(pdf["docref"], pdf["name"], pdf["content"]):
                if data is None:
                    continue
                raw = data.encode() if isinstance(data, str) else bytes(data)
                found = kind_of(path or "", raw)
                try:
                    made = office.READERS[found](raw) if found in office.READERS else READERS[found](raw.decode("utf-8", "replace")) if found in READERS else []
                except (KeyError, ValueError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError):
                    made = [("error", 0, f"not a sound {found} file")]
                rows += [(ref, k + 1, *x) for k, x in enumerate(made)]
            yield pd.DataFrame(rows, columns=["docref", "ord", "kind", "level", "text"])

    return df.select(F.col(docref).cast("string").alias("docref"), F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(read, UNITS)


def units(blocks_: DataFrame, by: str = "page") -> DataFrame:
    """Blocks (docref, ord, kind, level, text) gathered into units: docref, unit (from 1), label, text. A unit begins at
    each page mark, or with `title` at each heading; a running sum numbers them, so no document is held whole."""
    order = Window.partitionBy("docref").orderBy("ord")
    begins = F.col("kind") == by
    numbered = blocks_.withColumn("unit", F.sum(begins.cast("long")).over(order) + 1)
    body = F.when(F.col("kind") == "title", F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level"), F.lit(1))), F.lit(" "), F.col("text"))).when(F.col("kind") == "page", None).otherwise(F.col("text"))
    held = numbered.withColumn("body", body).groupBy("docref", "unit").agg(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("ord", "body")))).alias("b"), F.min_by(F.when(F.col("kind") == by, F.col("text")), "ord").alias("label"))
    return held.select("docref", "unit", "label", F.array_join(F.col("b.body"), "\n\n").alias("text"))


def folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder, hidden ones left out: path, name, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~F.col("path").rlike(r"/\.[^/]")).select("path", name.alias("name"), "content")
