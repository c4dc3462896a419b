"""Document containers: one SQLite database a document, plain or gzipped, read from the bytes that Spark's own readers give.

    files = spark.read.format("binaryFile").load(folder)             # any store that Spark reads
    container.check(files, FORMAT)                                   # issues, one row each; a bad file is no exception
    container.table(files, "units", "id string, ord long, text string", FORMAT)

A container is opened in memory, read-only, after its size, header and schema are looked at. What a format calls its
tables, and the numbers in the header, are parameters (Format).
"""

from __future__ import annotations

import json
import re
import sqlite3
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC, GZIP = b"SQLite format 3\x00", b"\x1f\x8b"

# The tables of a container, and the columns that must be there.
TABLES = {
    "documents": "id kind metadata source_sha256 mime bytes unit_count created updated",
    "units": "id document ord anchor text reader confidence",
    "sections": "id document level title unit_from",
    "fragments": "n id document unit ord text context anchor",
    "figures": "id document unit image anchor",
    "spaces": "id provider model dims dtype normalized modalities",
    "vectors": "target id space document data",
    "blobs": "key mime sha256 data",
    "provenance": "document stage at",
    "extensions": "name version required",
}


@dataclass(frozen=True)
class Format:
    """What tells containers of a format: header numbers, names, and the names of an older flavour."""

    meta: str = "meta"
    application_id: int = 0
    major: int = 5
    search: str = "fragments_fts"  # full-text index over fragments
    max_bytes: int = 4 << 30  # after decompression
    max_blob: int = 512 << 20
    older: dict[str, str] = field(default_factory=dict)  # its tables by today's names; with it the flavour is read too
    older_columns: dict[str, dict[str, str]] = field(default_factory=dict)  # by table, its columns by today's names
    older_triggers: tuple[str, ...] = ()


FORMAT = Format()


class Refused(ValueError):
    """A container that cannot be read; `code` says why."""

    def __init__(self, code: str, place: str):
        super().__init__(f"{code}: {place}")
        self.code, self.place = code, place


def gunzip(data: bytes, most: int) -> bytes:
    """Decompressed bytes; more than `most`, or a broken stream, is refused."""
    stream, out, size = zlib.decompressobj(31), [], 0
    try:
        while data and not stream.eof:
            part = stream.decompress(data, 1 << 20)
            size += len(part)
            if size > most:
                raise Refused("E001", "more than the limit after decompression")
            out.append(part)
            data = stream.unconsumed_tail
            if not part and not data:
                break
    except zlib.error as e:
        raise Refused("E001", "broken gzip") from e
    if not stream.eof:
        raise Refused("E001", "broken gzip")
    return b"".join(out)


class Container:
    """An open container: flavour (`5` or `older`), minor version, and whether it was gzipped."""

    def __init__(self, data: bytes, fmt: Format = FORMAT):
        self.format, self.gzipped = fmt, data[:2] == GZIP
        if self.gzipped:
            data = gunzip(data, fmt.max_bytes)
        if data[:16] != MAGIC or len(data) > fmt.max_bytes:
            raise Refused("E001", "not a database")
        self.db = sqlite3.connect(":memory:")
        try:
            self.db.deserialize(data)
            self.db.execute("PRAGMA query_only = 1")
            self.db.execute("PRAGMA trusted_schema = 0")
            self.db.setlimit(sqlite3.SQLITE_LIMIT_LENGTH, fmt.max_blob)
            self.objects = self.db.execute("SELECT type, name, coalesce(sql, '') FROM sqlite_master").fetchall()
            own, version = (self.db.execute(f"PRAGMA {p}").fetchone()[0] for p in ("application_id", "user_version"))
        except sqlite3.DatabaseError as e:
            raise Refused("E001", "not a database") from e
        self.tables = {n for t, n, _ in self.objects if t == "table"}
        if own == fmt.application_id and version // 100 == fmt.major:
            self.flavour, self.minor = "5", version % 100
        elif fmt.older and fmt.older["documents"] in self.tables:
            self.flavour, self.minor = "older", 0
        else:
            raise Refused("E002", f"{own}/{version}")

    def close(self) -> None:
        self.db.close()

    def name(self, table: str) -> str:
        table = self.format.meta if table == "meta" else table
        return self.format.older.get(table, table) if self.flavour == "older" else table

    def columns(self, table: str) -> set[str]:
        return {r[1] for r in self.db.execute(f"PRAGMA table_info({_quoted(self.name(table))})")}

    def rows(self, table: str, names: list[str], where: str = "", order: str = "", limit: int | None = None) -> Iterator[tuple]:
        """Rows of a table by today's names of its columns; absent ones are None. `where` and `order` are SQL over the
        names; order and limit are the database's work, so only what is asked for is read."""
        held, renamed = self.columns(table), self.format.older_columns.get(table, {}) if self.flavour == "older" else {}
        if not held:
            return
        own = lambda n: _quoted(renamed.get(n, n)) if renamed.get(n, n) in held else "NULL"
        inner = ", ".join(f"{own(n)} AS {_quoted(n)}" for n in names)
        sql = f"SELECT * FROM (SELECT {inner or '1'} FROM {_quoted(self.name(table))})"
        sql += (f" WHERE {where}" if where else "") + (f" ORDER BY {order}" if order else "") + (f" LIMIT {int(limit)}" if limit is not None else "")
        yield from self.db.execute(sql)

    def problems(self) -> list[tuple[str, str]]:
        """(code, place) of what is wrong with the container itself, in the order in which it is looked at."""
        fmt, out = self.format, []
        odd = [n for t, n, sql in self.objects if t in ("trigger", "view") or re.match(r"(?i)\s*create\s+virtual", sql) and not re.search(r"(?i)using\s+fts5", sql)]
        if self.flavour == "older":
            out += [("W110", "older")] + [("E010", fmt.older[t]) for t in ("documents", "units", "fragments") if t in fmt.older and fmt.older[t] not in self.tables]
            return out + [("E020", n) for n in odd if n not in fmt.older_triggers]
        out += [("E003", "gzip")] if self.gzipped else []
        out += [("W105", str(self.minor))] if self.minor else []
        out += [("E020", n) for n in odd]
        for table, columns in {"meta": "key value", **TABLES}.items():
            if self.name(table) not in self.tables:
                out.append(("E010", table))
            else:
                out += [("E011", f"{table}.{c}") for c in columns.split() if c not in self.columns(table)]
        if fmt.search not in self.tables:
            out.append(("E010", fmt.search))
        elif not self.in_sync(fmt.search):
            out.append(("E070", fmt.search))
        return out

    def in_sync(self, index: str) -> bool:
        """Whether a full-text index matches its table, by its own check on a copy."""
        copy = sqlite3.connect(":memory:")
        try:
            copy.deserialize(self.db.serialize())
            copy.execute(f"INSERT INTO {_quoted(index)}({_quoted(index)}, rank) VALUES('integrity-check', 1)")
            return True
        except sqlite3.DatabaseError:
            return False
        finally:
            copy.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def check(files: DataFrame, fmt: Format = FORMAT) -> DataFrame:
    """Issues of containers (path, content): docref (the path), code, place; a good one has none."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    held = Container(bytes(data) if data is not None else b"", fmt)
                except Refused as e:
                    out.append((path, e.code, e.place))
                    continue
                out += [(path, *x) for x in held.problems()]
                held.close()
            yield pd.DataFrame(out, columns=["docref", "code", "place"])

    return files.select("path", "content").mapInPandas(run, "docref string, code string, place string")


def table(files: DataFrame, name: str, schema: str, fmt: Format = FORMAT, where: str = "", order: str = "", limit: int | None = None) -> DataFrame:
    """The rows of a table of all containers (path, content), with docref (the path) first; containers that cannot be read
    give none (see check). Values pass as text and bytes and are cast by Spark, so a wrong type is null."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    kinds = {x.split()[0].strip("`"): x.split(None, 1)[1] for x in schema.split(", ")}

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    held = Container(bytes(data) if data is not None else b"", fmt)
                except Refused:
                    continue
                for row in held.rows(name, names, where, order, limit):
                    rows.append((path, *[None if v is None else v if isinstance(v, bytes) else str(v).encode() for v in row]))
                held.close()
            yield pd.DataFrame(rows, columns=["docref", *names])

    raw = files.select("path", "content").mapInPandas(run, "docref string, " + ", ".join(f"`{n}` binary" for n in names))
    cast = lambda n: F.col(n) if kinds[n] == "binary" else F.col(n).cast("string") if kinds[n] == "string" else F.col(n).cast("string").try_cast(kinds[n])
    return raw.select("docref", *[cast(n).alias(n) for n in names])


def vectors(files: DataFrame, fmt: Format = FORMAT) -> DataFrame:
    """All vectors as arrays of doubles: docref, space, target, id, vector."""
    from quire.functions.vectors import decode

    raw = table(files, "vectors", "space string, target string, id string, data binary", fmt)
    spaces = table(files, "spaces", "id string, dtype string", fmt).select("docref", F.col("id").alias("space"), "dtype")

    @F.pandas_udf("array<double>")
    def decoded(data: pd.Series, dtype: pd.Series) -> pd.Series:
        return pd.Series([None if d is None or t not in ("f32", "f16", "i8") else decode(bytes(d), t) for d, t in zip(data, dtype)])

    return raw.join(spaces, ["docref", "space"]).select("docref", "space", "target", "id", decoded("data", "dtype").alias("vector"))


def blob(files: DataFrame, key: str, fmt: Format = FORMAT) -> DataFrame:
    """One blob (key, with or without `blob:`) of every container that has it: docref, mime, sha256, data."""
    name = key.removeprefix("blob:").replace("'", "''")
    return table(files, "blobs", "key string, mime string, sha256 string, data binary", fmt, where=f"key = '{name}'").drop("key")


def numbered(units: DataFrame, by: list[str]) -> DataFrame:
    """Units (docref, ord, ...) numbered anew from 1 in the given order, as those of the older flavour begin at 0."""
    from pyspark.sql import Window

    return units.withColumn("ord", F.row_number().over(Window.partitionBy("docref").orderBy(*by)).cast("long"))


def renamed_members(text: str | None, names: dict[str, str], values: dict[str, dict[str, str]] | None = None) -> str | None:
    """A JSON object with its members (and of some members the values) under today's names; others stay."""
    if text is None:
        return None
    try:
        old = json.loads(text)
    except ValueError:
        return text
    if not isinstance(old, dict):
        return text
    values = values or {}
    new = {names.get(k, k): v for k, v in old.items()}
    return json.dumps({k: values.get(k, {}).get(v, v) if isinstance(v, str) else v for k, v in new.items()}, ensure_ascii=False)


# -- writing ---------------------------------------------------------------------------------------------------------


def packed(docs: DataFrame, fmt: Format = FORMAT, search: bool = True) -> DataFrame:
    """Containers from the rows of their tables: docref, content (the bytes of a database).

    docs: docref, table (a name of TABLES or `meta`), row (JSON of a row; members that end in `_hex` are bytes). A
    container is made whole in memory and handed over as a value, so a lost task leaves nothing behind; write the column
    to files with any sink. Texts are put in normal form C."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["docref"].iloc[0], build(zip(pdf["table"], pdf["row"]), fmt, search))], columns=["docref", "content"])

    return docs.select("docref", "table", "row").groupBy("docref").applyInPandas(make, "docref string, content binary")


def build(rows, fmt: Format = FORMAT, search: bool = True) -> bytes:
    import unicodedata

    by: dict[str, list[dict]] = {}
    for name, row in rows:
        by.setdefault(name, []).append(json.loads(row))
    db = sqlite3.connect(":memory:")
    db.execute(f"PRAGMA application_id = {fmt.application_id}")
    db.execute(f"PRAGMA user_version = {100 * fmt.major}")
    plain = lambda k, v: bytes.fromhex(v) if k.endswith("_hex") and v is not None else unicodedata.normalize("NFC", v) if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v
    for name, columns in {"meta": "key value", **TABLES}.items():
        held = list(dict.fromkeys([*columns.split(), *(k.removesuffix("_hex") for r in by.get(name, []) for k in r), *(["context", "section", "search_text"] if name == "fragments" else [])]))
        own = fmt.meta if name == "meta" else name
        db.execute(f"CREATE TABLE {_quoted(own)} ({', '.join(_quoted(c) + (' INTEGER PRIMARY KEY' if (name, c) == ('fragments', 'n') else '') for c in held)})")
        for r in by.get(name, []):
            values = {k.removesuffix("_hex"): plain(k, v) for k, v in r.items()}
            db.execute(f"INSERT INTO {_quoted(own)} ({', '.join(map(_quoted, values))}) VALUES ({', '.join('?' * len(values))})", list(values.values()))
    if search:
        db.execute(f"CREATE VIRTUAL TABLE {_quoted(fmt.search)} USING fts5(text, context, section, search_text, content='fragments', content_rowid='n', tokenize='unicode61 remove_diacritics 2')")
        db.execute(f"INSERT INTO {_quoted(fmt.search)}({_quoted(fmt.search)}) VALUES('rebuild')")
    db.commit()
    data = db.serialize()
    db.close()
    return data
