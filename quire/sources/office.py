"""Readers of packed documents into blocks: EPUB, word processor files, slides and sheets, by zip and XML alone."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

MOST = 1 << 30  # bytes of a member after decompression
ROWS = 40  # of a sheet in a block


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(e: ElementTree.Element, *names: str):
    return (x for x in e.iter() if _tag(x) in names)


def _value(e: ElementTree.Element, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


class Packed:
    """A zip archive whose members are read within a limit."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes:
        if self.zip.getinfo(name).file_size > MOST:
            raise ValueError(f"{name} is over the limit")
        return self.zip.read(name)

    def xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.read(name))

    def linked(self, part: str) -> dict[str, str]:
        """Members that a part names in its relations, by their id."""
        folder, base = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", base + ".rels")
        if rels not in self.names:
            return {}
        return {_value(r, "Id"): posixpath.normpath(posixpath.join(folder, _value(r, "Target"))).lstrip("/") for r in _all(self.xml(rels), "Relationship")}


def _run_text(e: ElementTree.Element) -> str:
    """Text of a paragraph, with its tabs and breaks."""
    out = ""
    for x in e.iter():
        kind = _tag(x)
        if kind == "t":
            out += x.text or ""
        elif kind in ("br", "cr", "line-break"):
            out += "\n"
        elif kind == "tab":
            out += "\t"
    return out.strip()


def _table_text(rows: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) if rows else ""


def docx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Headings by style or outline level, paragraphs and tables of a .docx body, in order."""
    packed = Packed(data)
    levels: dict[str, int] = {}
    if "word/styles.xml" in packed.names:
        for style in _all(packed.xml("word/styles.xml"), "style"):
            name = next((_value(x, "val") for x in _all(style, "name")), "")
            outline = next((int(_value(x, "val", "9")) for x in _all(style, "outlineLvl")), 9)
            m = re.fullmatch(r"(?i)heading ([1-9])", name)
            if m or outline < 9 or name.lower() == "title":
                levels[_value(style, "styleId")] = int(m[1]) if m else outline + 1 if outline < 9 else 1
    out = []
    for e in next(_all(packed.xml("word/document.xml"), "body")):
        if _tag(e) == "p":
            text = _run_text(e)
            level = levels.get(next((_value(s, "val") for s in _all(e, "pStyle")), ""), 0)
            out += [("title" if level else "para", level, text)] if text else []
        elif _tag(e) == "tbl":
            rows = [[_run_text(c) for c in r if _tag(c) == "tc"] for r in _all(e, "tr")]
            out += [("table", 0, _table_text(rows))] if rows else []
    return out


def odt_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Headings and paragraphs of an OpenDocument text, in order."""

    def plain(e: ElementTree.Element) -> str:
        out = e.text or ""
        for x in e:
            kind = _tag(x)
            out += "\n" if kind == "line-break" else "\t" if kind == "tab" else " " * int(_value(x, "c", "1")) if kind == "s" else "" if kind == "note" else plain(x)
            out += x.tail or ""
        return out

    out = []
    body = next(_all(Packed(data).xml("content.xml"), "body"))
    for e in _all(body, "h", "p"):
        text = plain(e).strip()
        if text:
            out.append(("title", int(_value(e, "outline-level", "1")), text) if _tag(e) == "h" else ("para", 0, text))
    return out


def pptx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """One block for each slide, in the order of the show: its title first, then its other text."""
    packed = Packed(data)
    links = packed.linked("ppt/presentation.xml")
    order = [links.get(_value(s, "id") if "}" not in "".join(s.attrib) else next(v for k, v in s.attrib.items() if k.endswith("}id"))) for s in _all(packed.xml("ppt/presentation.xml"), "sldId")]
    out = []
    for name in filter(packed.names.__contains__, filter(None, order)):
        titles, rest = [], []
        for shape in _all(packed.xml(name), "sp"):
            text = "\n".join(filter(None, map(_run_text, _all(shape, "p"))))
            kind = next((_value(p, "type") for p in _all(shape, "ph")), "")
            (titles if kind in ("title", "ctrTitle") else rest).append(text)
        out.append(("slide", 0, "\n\n".join(filter(None, [*[f"# {t}" for t in titles if t], *rest]))))
    return out


def xlsx_rows(data: bytes) -> list[tuple[str, list[tuple[int, list[str]]]]]:
    """Sheets by name, each with its rows that are not blank: (number from 1, cells)."""
    packed = Packed(data)
    shared = []
    if "xl/sharedStrings.xml" in packed.names:
        shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(packed.xml("xl/sharedStrings.xml"), "si")]
    links, out = packed.linked("xl/workbook.xml"), []
    for sheet in _all(packed.xml("xl/workbook.xml"), "sheet"):
        part = links.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
        if part not in packed.names:
            continue
        rows = []
        for k, row in enumerate(_all(packed.xml(part), "row"), 1):
            cells: list[str] = []
            for c in _all(row, "c"):
                letters = re.match("[A-Z]*", _value(c, "r"))[0]
                column = 0
                for ch in letters:
                    column = 26 * column + ord(ch) - 64
                cells += [""] * (column - 1 - len(cells))
                raw = next((v.text or "" for v in _all(c, "v")), "")
                kind = _value(c, "t")
                cells.append(shared[int(raw)] if kind == "s" and raw else "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else raw)
            if any(x.strip() for x in cells):
                rows.append((int(_value(row, "r", str(k))), cells))
        out.append((_value(sheet, "name"), rows))
    return out


def xlsx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Blocks of ROWS rows of each sheet as tables under the names of its first row; the level is the block's first row."""
    out = []
    for name, rows in xlsx_rows(data):
        if not rows:
            continue
        (_, head), body = rows[0], rows[1:]
        for k in range(0, len(body), ROWS):
            part = body[k : k + ROWS]
            wide = max(len(head), *(len(r) for _, r in part))
            padded = [r + [""] * (wide - len(r)) for r in [head, *(r for _, r in part)]]
            out.append(("sheet", part[0][0], f"{name}\n{_table_text(padded)}"))
    return out


def epub_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """Blocks of an EPUB's documents, in the order of its spine."""
    from quire.sources.files import html_blocks

    packed = Packed(data)
    root = _value(next(_all(packed.xml("META-INF/container.xml"), "rootfile")), "full-path")
    book, folder = packed.xml(root), posixpath.dirname(root)
    items = {_value(i, "id"): posixpath.normpath(posixpath.join(folder, unquote(_value(i, "href")))) for i in _all(book, "item")}
    out = []
    for ref in _all(book, "itemref"):
        name = items.get(_value(ref, "idref"))
        if name in packed.names and _value(ref, "linear", "yes") != "no":
            out += html_blocks(packed.read(name).decode("utf-8", "replace"))
    return out


def kind_of_zip(data: bytes) -> str:
    """epub, docx, odt, pptx, xlsx or zip, by the members of an archive."""
    try:
        names = Packed(data).names
    except (zipfile.BadZipFile, ValueError):
        return "zip"
    for member, kind in (("META-INF/container.xml", "epub"), ("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx"), ("content.xml", "odt")):
        if member in names:
            return kind
    return "zip"


READERS = {"epub": epub_blocks, "docx": docx_blocks, "odt": odt_blocks, "pptx": pptx_blocks, "xlsx": xlsx_blocks}
