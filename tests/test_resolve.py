"""Finding documents, units and sections, and checking quotations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.operators import resolve as R
from quire.operators import units as U


def test_documents(spark):
    docs = spark.createDataFrame([("sha256-" + "a" * 64, "one", "/x/a.sqlite", "Título", "Ann"), ("sha256-" + "ab" * 32, "two", "/x/b.sqlite", "Other", "Bob")], "docref string, id string, path string, title string, authors string")
    assert R.by_title(docs, "TÍTULO ann").count() == 1
    assert [R.resolve(docs, x).first()["id"] for x in ("a" * 8, "two", "b.sqlite", "sha256-" + "ab" * 32)] == ["one", "two", "b.sqlite" and "two", "two"]
    with pytest.raises(LookupError):
        R.resolve(docs, "abab")


def test_places(spark):
    units = spark.createDataFrame([("d", "a", 1, 0.0, 5.0), ("d", "b", 2, 5.0, 9.0)], "docref string, id string, ord long, t0 double, t1 double")
    times = spark.createDataFrame([("d", 0.0), ("d", 5.0), ("d", 9.0), ("d", 9.5), ("e", 1.0)], "docref string, t double")
    assert {(r["docref"], r["t"]): r["unit"] for r in R.units_at(times, units).collect()} == {("d", 0.0): "a", ("d", 5.0): "b", ("d", 9.0): "b", ("d", 9.5): None, ("e", 1.0): None}
    sections = spark.createDataFrame([("d", "s", 1, 1, 2), ("d", "t", 2, 2, 2)], "docref string, section string, level int, first long, last long")
    assert {r["id"]: r["section"] for r in U.leaf_sections(units, sections).collect()} == {"a": "s", "b": "t"}


def test_columns(spark):
    rows = [("a  b", "x a b y"), ("one two three four five", "one two three four"), ("none at all", "other"), ("", "x")]
    df = spark.createDataFrame(rows, "q string, p string")
    assert [r[0] for r in df.select(R.quote_support(F.col("q"), F.col("p"))).collect()] == ["literal", "words", "none", "none"]
    loops = spark.createDataFrame([("x\n" * 7,), ("abc def ghi jkl mno pqr " * 7,), ("all is well",)], "t string")
    assert [r[0] for r in loops.select(R.loops(F.col("t"))).collect()] == [True, True, False]
    p = spark.range(1).select(R.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))).first()[0]
    assert p == pytest.approx([1 / 3] * 3)


def test_vectors_and_metadata(spark):
    v = spark.createDataFrame([("d", "s", "fragment", "b", bytearray(b"2")), ("d", "s", "fragment", "a", bytearray(b"1")), ("d", "t", "unit", "a", bytearray(b"3"))], "docref string, space string, target string, id string, data binary")
    got = {r["space"]: (r["count"], r["sha256"]) for r in R.vector_digests(v).collect()}
    assert got == {"s": (2, hashlib.sha256(b"12").hexdigest()), "t": (1, hashlib.sha256(b"3").hexdigest())}
    assert R.replace_space(v, v.where("space = 's' and id = 'a'")).count() == 2
    m = spark.createDataFrame([("d", "title", "A", 0.5, 1), ("d", "title", "B", 0.9, 2), ("d", "title", "C", 0.9, 3)], "docref string, field string, value string, confidence double, arrival int")
    assert [r["value"] for r in R.confident(m).collect()] == ["B"]
