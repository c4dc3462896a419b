"""Anchors, citations, canonical JSON, search, units, validation, readers and streaming on small fixtures."""

import hashlib
import io
import json
import math
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import anchors as A
from quire.functions import canonical as K
from quire.functions import cite as C
from quire.functions import names as N
from quire.functions import prose as P
from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import corpus, export, folios, metrics, resolve, search, units, validate
from quire.sources import container, files, office

HASH = "sha256-" + "ab" * 32


def values(spark, column, *rows):
    """A column's values over rows of JSON or text `x` (and `y`)."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r, None))) for i, r in enumerate(rows)], "i int, x string, y string")
    return [r[1] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


PLACES = [
    ({"type": "page", "physical": 31, "printed": "23", "chars": [5, 17]}, None, "p=31&f=23&char=5,17"),
    ({"type": "page", "physical": 2, "printed": "x y"}, {"type": "page", "physical": 3, "printed": "xi"}, "p=2&pe=3&f=x%20y&fe=xi"),
    ({"type": "page", "physical": 7, "printed": None}, {"type": "page", "physical": 8, "printed": "1*"}, "p=7&pe=8&fe=1%2A"),
    ({"type": "time", "t0": 4160, "t1": 4175.5}, None, "t=4160,4175.5"),
    ({"type": "time", "t0": 1, "t1": 2}, {"type": "time", "t0": 5, "t1": 12345678.25}, "t=1,12345678.25"),
    ({"type": "section", "path": ["A/B", "é~+"], "paragraph": 4}, None, "s=A%2FB/%C3%A9~%2B&para=4"),
    ({"type": "slide", "n": 3}, None, "sl=3"),
    ({"type": "sheet", "sheet": "Data", "row_from": 4, "row_to": 9}, None, "sh=Data&rows=4-9"),
    ({"type": "verse", "line_from": 12, "line_to": 14}, None, "v=12-14"),
    ({"type": "verse", "line_from": 12, "line_to": 12}, None, "v=12"),
    ({"type": "canonical", "scheme": "bible", "ref": "Gn 1:1"}, None, "ref=bible:Gn%201%3A1"),
    ({"type": "image", "region": {"x": 0.125, "y": 0.3, "w": 0.75, "h": 0.333333}}, None, "xywh=percent:12.5,30,75,33.3333"),
]


def test_uris_round_trip(spark):
    rows = [(json.dumps(a), json.dumps(e) if e else None) for a, e, _ in PLACES]
    got = values(spark, A.uri(F.lit(HASH), A.parsed(F.col("x")), A.parsed(F.col("y"))), *rows)
    assert got == [f"cite:{HASH}#{text}" for *_, text in PLACES]
    parsed = A.parse_uri(F.col("x"))
    assert values(spark, A.format_uri(parsed["docref"], parsed["locator"]), *got) == got
    assert values(spark, parsed["error"], *got) == [None] * len(got)
    back = [json.loads(x) for x in values(spark, A.to_anchor(parsed["locator"]), *got)]
    assert back[0] == {"type": "page", "physical": 31, "printed": "23", "chars": [5, 17]}
    assert back[3] == PLACES[3][0] and back[5] == PLACES[5][0] and back[7:9] == [PLACES[7][0], PLACES[8][0]] and back[10:] == [PLACES[10][0], PLACES[11][0]]


def test_uris_of_all_kinds(spark):
    good = ["cite:a%20b", "cite:a#zz=1&t=npt:0:12,0:24.5", "cite:a#t=1:09:20", "cite:a#f=%c3%A9&p=2", "cite:é#f=ñ+1"]
    got = [r.asDict(True) for r in values(spark, A.parse_uri(F.col("x")), *good)]
    assert [r["docref"] for r in got] == ["a b", "a", "a", "a", "é"] and not any(r["error"] for r in got)
    assert (got[1]["locator"]["t"], got[2]["locator"]["t"], got[3]["locator"]["f"], got[4]["locator"]["f"]) == ([12, 24.5], [4160], "é", "ñ+1")
    bad = ["http:x", "cite:", "cite:a#p=0", "cite:a#p=1&p=2", "cite:a#char=5,2", "cite:a#t=9,3", "cite:a#xywh=1,2,3,4", "cite:a#f=%E9", "cite:a#p=01", "cite:a#f=%zz", "cite:a#t=1:2", "cite:a#sl", "cite:%FF#p=1", "cite:a#v=1-"]
    assert all(values(spark, A.parse_uri(F.col("x"))["error"], *bad))


def test_anchor_problems(spark):
    cases = [(a, None) for a, *_ in PLACES] + [
        ({"type": "page", "physical": 1.0, "printed": None}, None), ({"type": "page", "physical": 1}, "E040"), ({"type": "page", "physical": 0, "printed": "1"}, "E040"), ({"type": "page", "physical": "1", "printed": "1"}, "E040"),
        ({"type": "time", "t0": 2, "t1": 1}, "E040"), ({"type": "section", "path": ["a", None]}, "E040"), ({"type": "section", "path": []}, None), ({"type": "cloud"}, "E041"), ({"kind": 1}, "E040"), ([1], "E040"),
        ({"type": "image", "region": {"x": 5, "y": 0, "w": 1, "h": 1}}, None), ({"type": "image", "region": {"x": "5"}}, "E040"), ({"type": "image", "chars": [1]}, "E040"), ({"type": "image", "chars": [-1, 2]}, "E042"), ({"type": "image", "chars": [3, 99]}, "E042"), ({"type": "image", "chars": [3, 20]}, None),
    ]
    assert values(spark, A.problem(F.col("x"), F.lit(20)), *[json.dumps(a) for a, _ in cases[12:]], "{") == [c for _, c in cases[12:]] + ["E040"]
    assert values(spark, A.problem(F.col("x")), *[json.dumps(a) for a, _ in cases[:12]]) == [None] * 12


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12))
def test_canonical_json_is_stable(value):
    once = K.jcs(value)
    assert K.jcs(json.loads(once)) == once or any(c in once for c in "eE")


@pytest.mark.parametrize("x, text", [(1.0, "1"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (-0.0, "0"), (4175.5, "4175.5"), (5e-324, "5e-324"), (-1.5e300, "-1.5e+300"), (0.00123, "0.00123")])
def test_numbers(x, text):
    assert K.number(x) == text


def test_dumps(spark):
    docs = spark.createDataFrame([("d", '{"id": "d", "year": 1.0}'), ("e", None)], "docref string, document string")
    meta = spark.createDataFrame([("d", "b", "2"), ("d", "signer", "x"), ("d", "a", "é")], "docref string, key string, value string")
    u = spark.createDataFrame([("d", "u2", 2, "b", '{"type":"image"}', 0.1234567), ("d", "u1", 1, 'say "a"\n', None, None)], "docref string, id string, ord long, text string, anchor string, t0 double")
    got = {r["docref"]: r for r in K.dumps(docs, meta, {"units": u}).collect()}
    dump = json.loads(got["d"]["dump"])
    assert [x["id"] for x in dump["units"]] == ["u1", "u2"] and dump["units"][1]["t0"] == 0.123457 and dump["units"][0]["anchor"] is None and dump["meta"]["signer"] == "x" and dump["fragments"] == []
    assert got["d"]["content_sha256"] == K.content_hash(dump) == hashlib.sha256(K.jcs({**dump, "meta": {"a": "é", "b": "2"}}, 6).encode()).hexdigest()
    issues = validate.bad_hash(spark.createDataFrame([("d", "content_sha256", "0"), ("e", "content_sha256", got["e"]["content_sha256"])], "docref string, key string, value string"), K.dumps(docs, meta, {"units": u}))
    assert [(r["docref"], r["code"]) for r in issues.collect()] == [("d", "E081")]


OWEN = {"type": "book", "title": "A Book of Trees", "author": [{"family": "Owen", "given": "Ann"}], "issued": {"date-parts": [[1712]]}}


@pytest.mark.parametrize(
    "anchor, end, locale, text",
    [
        ({"type": "page", "physical": 9, "printed": "145"}, {"type": "page", "physical": 10, "printed": "146"}, "en", "(Owen, 1712, pp. 145-146)"),
        ({"type": "page", "physical": 9, "printed": "21", "source": "inferred"}, None, "es-ES", "(Owen, 1712, p. [21])"),
        ({"type": "page", "physical": 9, "printed": None}, None, "es", "(Owen, 1712, s. p.)"),
        ({"type": "page", "physical": 9, "printed": None}, {"type": "page", "physical": 10, "printed": "4r", "foliation": "leaf"}, "en", "(Owen, 1712, fol. 4r)"),
        ({"type": "page", "physical": 9, "printed": "xiv"}, {"type": "page", "physical": 10, "printed": "1r", "foliation": "leaf"}, "fr", "(Owen, 1712, p. xiv-fol. 1r)"),
        ({"type": "time", "t0": 12.9, "t1": 14}, {"type": "time", "t0": 20, "t1": 24.2}, "en", "(Owen, 1712, 0:12-0:24)"),
        ({"type": "time", "t0": 394488, "t1": 394489}, None, "en", "(Owen, 1712, 109:34:48)"),
        ({"type": "section", "path": ["1", "2 Oaks"], "paragraph": 4}, None, "es", "(Owen, 1712, § 2 Oaks, párr. 4)"),
        ({"type": "sheet", "sheet": "S", "row_from": 4, "row_to": 4}, None, "en", "(Owen, 1712, S, row 4)"),
        ({"type": "verse", "line_from": 3, "line_to": 5}, None, "en", "(Owen, 1712, vv. 3-5)"),
        ({"type": "slide", "n": 3}, None, "es", "(Owen, 1712, diap. 3)"),
        ({"type": "image"}, None, "en", "(Owen, 1712)"),
    ],
)
def test_citations(spark, anchor, end, locale, text):
    item = C.item_of(F.lit(json.dumps(OWEN)))
    assert values(spark, C.cite(A.parsed(F.col("x")), A.parsed(F.col("y")), item, locale), (json.dumps(anchor), json.dumps(end) if end else None)) == [text]


def test_names_years_and_exports(spark):
    items = [
        {"author": [{"family": "Gómez"}, {"family": "Hidalgo"}], "title": "El libro de Juan", "type": "book", "own": 1},
        {"author": [{"family": "Gómez"}, {"family": "Hierro"}], "title": "T", "issued": {"date-parts": [["1605"]]}},
        {"title": "Short: long", "issued": {"date-parts": [[-375]]}}, {"author": [{"literal": "A body"}, {"given": "B"}, {"family": "C"}], "title": "x", "issued": {"date-parts": [[True]]}}, OWEN, OWEN,
    ]
    texts = [json.dumps(i) for i in items]
    image = A.parsed(F.lit('{"type":"image"}'))
    got = values(spark, C.cite(image, None, C.item_of(F.col("x")), "es"), *texts)
    assert got == ["(Gómez e Hidalgo, s. f.)", "(Gómez y Hierro, 1605)", "(Short, 375 a. C.)", "(A body et al., s. f.)", "(Owen, 1712)", "(Owen, 1712)"]
    docs = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "docref string, place int, metadata string")
    keyed = {r["place"]: r["key"] for r in C.keys(docs).collect()}
    assert keyed == {0: "gomeznd", 1: "gomez1605", 2: "short-375", 3: "abodynd", 4: "owen1712a", 5: "owen1712b"}
    assert values(spark, C.suffix(F.col("x").cast("int")), "1", "26", "27", "702", "703", "18278") == ["a", "z", "aa", "zz", "aaa", "zzz"]
    entry = values(spark, C.bibtex(C.item_of(F.col("x")), F.lit("k")), texts[0], json.dumps({"type": "chapter", "title": "a {b} \\ c", "container-title": "In", "author": [{"literal": "X Y"}, {"family": "B", "non-dropping-particle": "de", "given": "A"}]}))
    assert entry[0] == "@book{k,\n  author = {{Gómez} and {Hidalgo}},\n  title = {{El} libro de {Juan}}\n}"
    assert entry[1] == "@incollection{k,\n  author = {{X Y} and de B, A},\n  title = {a \\{b\\} \\textbackslash{} c},\n  booktitle = {{In}}\n}"
    verse = C.csl_locator(A.parsed(F.lit('{"type": "verse", "line_from": 3}')))
    assert json.loads(values(spark, C.csl_item(F.col("x"), F.lit("k"), "own", verse), texts[0])[0]) == {"id": "k", "label": "verse", "locator": "3", **{k: v for k, v in items[0].items() if k != "own"}}


def test_vector_storage_and_spaces(spark):
    assert V.encode([1.5, -2, 0.1, -0.1], "i8").hex() == "7f810df3"
    with pytest.raises(ValueError):
        V.encode([1e6], "f16")
    assert V.decode(V.encode([0.5, -1], "f16"), "f16").tolist() == [0.5, -1.0]
    space = "struct<provider:string,model:string,version:string,dims:int,normalized:int,truncated_from:int,task_prefixes:string>"
    a, b = F.from_json("x", space), F.from_json("y", space)
    one = {"provider": "p", "model": "m", "version": "1+a", "dims": 4}
    rows = [(json.dumps(one), json.dumps({**one, **x})) for x in ({}, {"version": "1+b"}, {"version": "2"}, {"dims": 5})]
    assert values(spark, V.compatibility(a, b), *rows) == ["same", "approximate", "incompatible", "incompatible"]
    v = V.fake_vectors(["a", "b", "a"], 16)
    assert (v[0] == v[2]).all() and not (v[0] == v[1]).any() and (abs((v**2).sum(1) - 1) < 1e-12).all()


def test_query_parsing():
    assert search.parse('one "two  three" four') == (["two three"], True)
    assert search.parse("Árbol arbol b") == (["Árbol", "b"], False)
    assert search.parse('"open') == (["open"], False)
    assert search.parse("„a b“ «c» “d”") == (["a b", "c", "d"], True)
    assert (search.route("..."), search.route("學而", True), search.route("學而時習", True), search.route("learn")) == ("none", "substring", "trigram", "fts")
    assert search.match('a "b c"') == '"b c"'


def test_bm25_by_hand(spark, tmp_path):
    rows = [("d", 1, "the cat sat"), ("d", 2, "The dog"), ("d", 3, "a cat and a cat a cat"), ("e", 1, "cat"), ("e", 2, None)]
    df = spark.createDataFrame(rows, "docref string, n long, text string")
    got = {(r["docref"], r["n"]): r["score"] for r in search.lexical(df, "cat", 5).collect()}
    mean = 12 / 3
    want = 1e-6 * 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean))
    assert got["d", 1] == pytest.approx(want) and set(got) == {("d", 1), ("d", 3), ("e", 1)}
    assert [r["n"] for r in search.lexical(df, '"cat and a"', 5).collect()] == [3]
    assert search.lexical(df, "...", 5).count() == 0
    index = search.Index.write(df, str(tmp_path / "i"))
    for query in ("cat", '"a cat"', '"cat a cat"', "dog sat", '"cat" "sat"', "none"):
        a, b = ({(r["docref"], r["n"]): (r["rank"], round(r["score"], 12)) for r in x.collect()} for x in (search.lexical(df, query, 5), index.lexical(query, 5)))
        assert a == b
    lunyu = spark.createDataFrame([("d", 1, "學而時習之"), ("d", 2, "有朋自遠方來"), ("d", 3, "時習時習時習")], "docref string, n long, text string")
    assert [r["n"] for r in search.lexical(lunyu, "時習時", 5, trigram=True).collect()] == [3] and search.lexical(lunyu, "時習", 5).count() == 2


def test_vectors_of_documents_without(spark):
    rows = spark.createDataFrame([("d", 1, "cat"), ("d", 2, "dog"), ("e", 1, "cat"), ("e", 2, "x")], "docref string, n long, text string")
    vectors = spark.createDataFrame([("d", 1, [1.0, 0.0]), ("d", 2, [0.0, 1.0])], "docref string, n long, vector array<double>")
    got = {(r["docref"], r["n"]): (r["via"], r["fallback"]) for r in search.searched(rows, vectors, "cat", [0.0, 1.0], 5).collect()}
    assert got == {("d", 1): ("lexical+vector", None), ("d", 2): ("vector", None), ("e", 1): ("lexical", "no vectors")}
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, -1.0])], "qid long, query array<double>")
    top = search.batch_vectors(queries, spark.createDataFrame([(i, [float(i % 3), float(i)]) for i in range(30)], "n long, vector array<double>"), 2)
    assert sorted((r["qid"], r["rank"], r["n"]) for r in top.collect()) == [(7, 1, 29), (7, 2, 28), (8, 1, 0), (8, 2, 1)]


@pytest.fixture(scope="module")
def book(spark):
    page = lambda p, f, **k: json.dumps({"type": "page", "physical": p, "printed": f, **k})
    u = [("d", "u1", 1, page(1, None, matter="plate"), None, "A plate."), ("d", "u2", 2, page(2, "1"), "1", "First page text."), ("d", "u3", 3, page(3, "2"), "2", "Second page."), ("t", "a", 1, json.dumps({"type": "time", "t0": 0, "t1": 90}), None, "x"), ("t", "b", 2, json.dumps({"type": "time", "t0": 90, "t1": 200}), None, "y")]
    f = [("d", "f1", 1, "u1", page(1, None, matter="plate", chars=[0, 8]), page(2, "1", chars=[0, 5]), "A plate. First"), ("d", "f2", 2, "u3", page(3, "2", chars=[0, 99]), None, "Second page.")]
    return spark.createDataFrame(u, "docref string, id string, ord long, anchor string, printed string, text string"), spark.createDataFrame(f, "docref string, id string, n long, unit string, anchor string, anchor_end string, text string")


def test_locate_and_end_units(spark, book):
    u, f = book
    assert [tuple(r) for r in units.end_units(f, u).collect()] == [("d", 1, 2)]
    asked = ["cite:d#p=2", "cite:other#p=2", "x#p=0", "cite:d#p=1&pe=9", "https://a/b#f=2", "cite:d#p=2&char=1,3", "cite:d#p=2&char=9,12", "cite:d", "cite:d#p=99"]
    refs = spark.createDataFrame([("d", x) for x in asked] + [("t", f"cite:t#t={x}") for x in ("89", "90", "200", "201")], "docref string, reference string")
    got = {r["reference"]: r for r in units.locate(u, f, refs).collect()}
    assert (got["cite:d#p=2"]["units"], got["cite:d#p=2"]["fragments"]) == (["u2"], ["f1"])
    assert got["cite:other#p=2"]["units"] == [] and not got["cite:other#p=2"]["document"] and got["x#p=0"]["error"]
    assert (got["cite:d#p=1&pe=9"]["units"], got["cite:d#p=1&pe=9"]["fragments"]) == (["u1", "u2", "u3"], ["f1", "f2"])
    assert got["https://a/b#f=2"]["units"] == ["u3"] and got["cite:d"]["units"] == [] and got["cite:d#p=99"]["units"] == []
    assert got["cite:d#p=2&char=1,3"]["fragments"] == ["f1"] and got["cite:d#p=2&char=9,12"]["fragments"] == []
    assert [got[f"cite:t#t={x}"]["units"] for x in ("89", "90", "200", "201")] == [["a"], ["b"], ["b"], []]


def test_cite_passages(spark, book):
    u, f = book
    items = spark.createDataFrame([("d", json.dumps(OWEN))], "docref string, metadata string")
    quotes = spark.createDataFrame([("d", "f1", "plate"), ("d", "f1", "First"), ("d", "f1", "plate. First"), ("d", "f1", "absent"), ("d", "f9", "x"), ("d", "f1", "")], "docref string, fragment string, quote string")
    got = {(r["fragment"], r["quote"]): (r["text"], r["uri"], r["error"]) for r in units.cite_passages(quotes, u, f, items).collect()}
    assert got["f1", "plate"] == ("(Owen, 1712, n. pag.)", "cite:d#p=1&char=2,7", None)
    assert got["f1", "First"] == ("(Owen, 1712, p. 1)", "cite:d#p=2&f=1&char=0,5", None)
    assert got["f1", "plate. First"] == ("(Owen, 1712, p. 1)", "cite:d#p=1&pe=2&fe=1", None)
    assert got["f1", "absent"][2] == "the quotation is not in the passage" and got["f9", "x"][2] == "no such passage" and got["f1", ""][2] == "an empty quotation"


def test_validation(spark, book):
    u, f = (x.where("docref = 'd'") for x in book)
    docs = spark.createDataFrame([("d", '{"type": "book", "title": "T"}'), ("e", "{"), ("g", '{"type": 3}')], "docref string, metadata string")
    out = {r["docref"]: r for r in validate.verdicts(docs, validate.bad_json(docs), validate.bad_order(u.where("ord > 1")), validate.bad_chars(f, u), validate.crossings(f, u), validate.bad_anchors(u)).collect()}
    assert out["d"]["errors"] == ["E042", "E090"] and out["d"]["warnings"] == ["W103"]
    assert out["e"]["errors"] == ["E050"] and out["g"]["errors"] == ["E051"]
    spaces = spark.createDataFrame([("d", "s", 2, "f32"), ("d", "t", 2, "f64")], "docref string, id string, dims int, dtype string")
    vectors = spark.createDataFrame([("d", "s", "v1", bytearray(8)), ("d", "s", "v2", bytearray(9)), ("d", "q", "v3", bytearray(8))], "docref string, space string, id string, data binary")
    assert sorted(r["code"] for r in validate.bad_vectors(vectors, spaces).collect()) == ["E030", "E031", "E032"]
    meta = spark.createDataFrame([("d", k, "x") for k in validate.REQUIRED_META[1:]], "docref string, key string, value string")
    assert [r["place"] for r in validate.missing_meta(meta, docs.where("docref = 'd'")).collect()] == [validate.REQUIRED_META[0]]
    extensions = spark.createDataFrame([("d", "a", 1), ("d", "b", 1), ("d", "c", 0)], "docref string, name string, required int")
    assert [r["place"] for r in validate.bad_extensions(extensions, ["a"]).collect()] == ["b"]
    assert [r["docref"] for r in validate.not_one_document(docs, docs.where("docref <> 'g'").union(docs.where("docref = 'e'"))).orderBy("docref").collect()] == ["e", "g"]


def test_containers(spark):
    rows = [("documents", {"id": "d", "kind": "pdf", "metadata": {"title": "T"}, "unit_count": 1}), ("meta", {"key": "profile", "value": "core"}), ("units", {"id": "u", "document": "d", "ord": 1, "text": "é"}), ("spaces", {"id": "s", "dims": 2, "dtype": "f32"}), ("vectors", {"target": "unit", "id": "u", "space": "s", "document": "d", "data_hex": V.encode([0.5, 2.0], "f32").hex()}), ("fragments", {"n": 1, "id": "f", "document": "d", "unit": "u", "text": "hello"}), ("blobs", {"key": "k", "mime": "a/b", "data_hex": "00ff"})]
    packed = container.packed(spark.createDataFrame([("d", t, json.dumps(r)) for t, r in rows], "docref string, table string, row string")).first()["content"]
    import gzip
    import sqlite3

    def changed(*statements):
        db = sqlite3.connect(":memory:")
        db.deserialize(bytes(packed))
        for s in statements:
            db.execute(s)
        db.commit()
        return db.serialize()

    cases = {"good": bytes(packed), "gzip": gzip.compress(bytes(packed)), "cut": gzip.compress(bytes(packed))[:200], "none": b"", "other": changed("PRAGMA user_version = 900"), "newer": changed("PRAGMA user_version = 501"), "trigger": changed("CREATE TRIGGER t AFTER INSERT ON units BEGIN SELECT 1; END"), "column": changed("ALTER TABLE units DROP COLUMN reader"), "table": changed("DROP TABLE blobs"), "index": changed("UPDATE fragments SET text = 'bye'")}
    df = spark.createDataFrame(list(cases.items()), "path string, content binary")
    got = sorted((r["docref"], r["code"]) for r in container.check(df).collect())
    assert got == [("column", "E011"), ("cut", "E001"), ("gzip", "E003"), ("index", "E070"), ("newer", "W105"), ("none", "E001"), ("other", "E002"), ("table", "E010"), ("trigger", "E020")]
    two = df.where("path in ('gzip', 'none')")
    assert [tuple(r) for r in container.table(two, "units", "id string, ord int, text string, absent double").collect()] == [("gzip", "u", 1, "é", None)]
    assert [r["vector"] for r in container.vectors(two).collect()] == [[0.5, 2.0]] and container.blob(two, "blob:k").first()["data"] == b"\x00\xff"
    assert container.table(df, "units", "id string, ord int", where="ord > 1").count() == 0
    old = sqlite3.connect(":memory:")
    old.execute("CREATE TABLE docs (i, t)")
    old.execute("INSERT INTO docs VALUES ('x', 'Old')")
    fmt = container.Format(older={"documents": "docs", "units": "us", "fragments": "fs"}, older_columns={"documents": {"id": "i", "title": "t"}})
    older = spark.createDataFrame([("o", old.serialize())], "path string, content binary")
    assert [tuple(r) for r in container.table(older, "documents", "id string, title string", fmt).collect()] == [("o", "x", "Old")]
    assert sorted(r["code"] for r in container.check(older, fmt).collect()) == ["E010", "E010", "W110"]
    assert json.loads(container.renamed_members('{"tipo": "pagina", "x": 1}', {"tipo": "type"}, {"type": {"pagina": "page"}})) == {"type": "page", "x": 1}
    with pytest.raises(container.Refused):
        container.gunzip(gzip.compress(b"0" * 10_000), 100)


def test_sections_chunks_segments(spark):
    s = spark.createDataFrame([("d", "1", None, "A", 1, 1), ("d", "2", "1", "B", 2, 3), ("d", "3", None, "C", 1, 7)], "docref string, id string, parent string, title string, level int, start long")
    assert {r["id"]: r["path"] for r in units.section_paths(s).collect()} == {"1": ["A"], "2": ["A", "B"], "3": ["C"]}
    deep = spark.createDataFrame([("d", str(i), str(i - 1) if i else None, f"t{i}") for i in range(40)] + [("d", "x", "y", "X"), ("d", "y", "x", "Y")], "docref string, id string, parent string, title string")
    paths = {r["id"]: r["path"] for r in units.section_paths(deep).collect()}
    assert len(paths) == 40 and paths["39"] == [f"t{i}" for i in range(40)]
    last = spark.createDataFrame([("d", 9)], "docref string, last_ord long")
    assert {r["id"]: r["end"] for r in units.section_ends(s, last).collect()} == {"1": 6, "2": 6, "3": 9}
    assert units.chunk_plan([200, 200, 300, 10, 500]) == [0, 0, 1, 1, 2] and units.chunk_plan([200, 10, 100], [False, True, False]) == [0, 1, 1] and units.chunk_plan([300, 200, 90]) == [0, 1, 1]
    long = " ".join(f"Sentence number {i} has a few words." for i in range(200))
    p = spark.createDataFrame([("d", "", 0, "Head", 2, True), ("d", "", 1, long, 2000, False)], "docref string, section string, i long, text string, tokens long, title boolean")
    parts = [r["text"] for r in units.chunks(p).orderBy("n").collect()]
    assert len(parts) > 3 and parts[0].startswith("Head\n\nSentence number 0") and " ".join(parts).replace("\n\n", " ") == "Head " + long
    said = [(0, "Hello", 0.0, 0.5, "a"), (1, ",", 0.5, 0.5, "a"), (2, "you.", 0.6, 1.0, "a"), (3, "Yes", 1.2, 1.5, "b"), (4, "(", 1.5, 1.5, "b"), (5, "now", 1.5, 2.0, "b"), (6, ")", 2.0, 2.0, "b"), (7, "Late.", 50.0, 51.0, "b")]
    words = spark.createDataFrame([("d", *w) for w in said], "docref string, i long, word string, t0 double, t1 double, speaker string")
    assert [(r["text"], r["speaker"]) for r in units.speech_sentences(words).orderBy("s").collect()] == [("Hello, you.", "a"), ("Yes (now)", "b"), ("Late.", "b")]
    assert [(r["t0"], r["t1"], r["speaker"], r["text"]) for r in units.segments(words).orderBy("t0").collect()] == [(0.0, 51.0, "b", "**a:** Hello, you.\n\n**b:** Yes (now) Late.")]
    assert units.segment_plan([(0, 20, "a"), (20, 40, "a"), (40, 50, "a"), (50, 70, "b"), (70, 130, "b"), (131, 135, "b")]) == [0, 0, 0, 1, 2, 2]
    timing = units.word_timings(F.array(F.struct(F.lit(1.0).alias("t0"), F.lit(1.25).alias("t1")), F.struct(F.lit(1.25).alias("t0"), F.lit(1.25).alias("t1"))), F.lit(1.0))
    assert json.loads(spark.range(1).select(timing).first()[0]) == {"v": 1, "t0": 1.0, "cs": [0, 25, 25, 1]}


def test_folios(spark):
    seen = [None, 5, 6, None, 8, 99, 10, None]
    df = spark.createDataFrame([("d", i + 1, n) for i, n in enumerate(seen)], "docref string, physical long, number long")
    got = [(r["folio"], r["source"]) for r in folios.infer_folios(df).orderBy("physical").collect()]
    assert got == [(None, "none"), (5, "read"), (6, "read"), (7, "inferred"), (8, "read"), (9, "inferred"), (10, "read"), (None, "none")]
    lines = [(1, "header", "xii"), (2, "header", "THE TREES xiii"), (3, "footer", "- 1 -"), (4, "text-start", "In 1712 they came to the town"), (4, "header", "Chapter 9"), (5, "footer", "3"), (5, "header", "THE OAKS 3"), (6, "footer", "88"), (7, "footer", "5")]
    read = folios.readings(folios.candidates(spark.createDataFrame([("d", *x) for x in lines], "docref string, physical long, place string, line string")))
    held = {r["physical"]: (r["value"], r["roman"]) for r in read.collect()}
    assert held == {1: (12, True), 2: (13, True), 3: (1, False), 5: (3, False), 7: (5, False)}
    pages = spark.createDataFrame([("d", i) for i in range(1, 9)], "docref string, physical long")
    anchors = [json.loads(r["anchor"]) for r in folios.folio_anchors(pages, read).orderBy("physical").collect()]
    assert [(a["printed"], a["source"]) for a in anchors] == [("xii", "read"), ("xiii", "read"), ("1", "read"), ("2", "inferred"), ("3", "read"), ("4", "inferred"), ("5", "read"), (None, "none")]
    kinds = folios.page_class(F.col("x"), F.lit(None).cast("string"), F.col("y"), F.lit(0))
    assert values(spark, kinds, "", "Plate IV", ("Kodak Gray Scale", "x"), "few", "a long page " * 20, ("t", "9 780 123 456 789")) == ["blank", "plate", "chart", "short", "text", "apparatus"]


def test_metrics(spark):
    df = spark.createDataFrame([(0.1, 0, 1.0), (0.4, 0, 2.0), (0.35, 1, 2.0), (0.8, 1, 9.0)], "p double, y int, z double")
    assert metrics.log_loss(df, "p", "y").first()[0] == pytest.approx(-(math.log(0.9) + math.log(0.6) + math.log(0.35) + math.log(0.8)) / 4)
    assert metrics.spearman(df, "p", "z").first()[0] == pytest.approx(0.9486833)
    assert metrics.calibration_error(df, "p", "y").first()["n"] == 4
    assert corpus.auc(df, "p", "y").first()["auc"] == 0.75
    texts = spark.createDataFrame([("the cat sat", "The cat sat down"), ("a b", "b a")], "a string, b string")
    assert metrics.word_error(texts, "a", "b").first()[0] == pytest.approx(3 / 6)
    logits = spark.createDataFrame([(2.0, 1), (2.0, 0), (-2.0, 0), (-2.0, 0), (2.0, 1)], "z double, y int")
    best = metrics.fitted_temperature(logits, "z", "y").first()
    loss = lambda t: sum(math.log1p(math.exp(-z / t if y else z / t)) for z, y in ((2, 1), (2, 0), (-2, 0), (-2, 0), (2, 1))) / 5
    assert best["nll"] == pytest.approx(min(loss(0.2 * 25 ** (k / 119)) for k in range(120)))
    big = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("o"), F.lit(1).alias("v")).groupBy("o").agg(F.sum("v").alias("v"))
    rows = sorted((r["o"], r["v"], r["below"]) for r in corpus.running(big, "o", "v", "below", 8).collect())
    total = 0
    for o, v, below in rows:
        assert below == total
        total += v


def test_prose(spark):
    assert P.sentences("Dr. A. Smith came. He left! Why? \"Yes.\" No.5 is here. See e.g. Tom. End.[^2] Next.") == ["Dr. A. Smith came.", "He left!", "Why?", "\"Yes.\"", "No.5 is here.", "See e.g. Tom.", "End.[^2]", "Next."]
    assert P.joined_lines("exam-\nple of\nlines that go on and on for more than sixty characters in all") == "example of lines that go on and on for more than sixty characters in all"
    assert P.joined_lines("a rose\nis a rose\nis a rose") == "a rose\nis a rose\nis a rose" and P.joined_lines("- a\n- b") == "- a\n- b" and P.joined_lines("one\ntwo") == "one two"
    assert [P.roman_value(x) for x in ("xiv", "IIII", "", "mcmxc")] == [14, None, None, 1990]
    assert values(spark, P.markdown_title(F.col("x"))["text"], "## A *b* ##", "no", "# a\nb") == ["A b", None, None]
    assert values(spark, P.ends_sentence(F.col("x")), "a.", "a.[^1] ", "a,", "a”") == [True, True, False, True]
    assert values(spark, P.page_label(F.col("x")), "[Pg 23]", "<b>p. iv</b>", "Page 7", "a label far too long") == ["23", "iv", "7", ""]
    assert [[tuple(m) for m in v] for v in values(spark, P.highlight(F.col("x"), ["arbol", "de"]), "El Árbol de arboles", "x")] == [[(3, 8), (9, 11), (12, 17)], []]
    good, bad = "The old house stood on a hill, and all of its rooms were full of light in the morning. " * 4, "Th3 0ld h~use st|od 0n @ h!ll xkcdq zzzz bcdfg t h e r e ¦ ¦ ¬ " * 4
    q = [r.asDict() for r in values(spark, P.layer_quality(F.col("x"), F.lit(0.0)), good, bad, "")]
    assert [x["useful"] for x in q] == [True, False, False] and q[0]["quality_1000"] == 1000 and q[2]["origin"] == "none"


def test_text_functions(spark):
    assert values(spark, T.garbage_ratio(F.col("x")), "", "plain words", "12 34", "bad � word here") == [1.0, 0.0, 0.5, pytest.approx(4 / 15)]
    assert values(spark, T.dice(F.col("x"), F.col("y")), ("aaaa", "aa"), ("Árbol", "arbol!"), ("a", "b"), ("", "x")) == [0.5, 1.0, 0.0, 0.0]
    assert values(spark, T.isbn10(F.col("x")), "ISBN 0-306-40615-2 x", "ISBN 0-306-40615-3", "ISBN: 080442957X") == ["0306406152", None, "080442957X"]
    assert values(spark, T.arxiv(F.col("x")), "see arXiv:1706.03762v5.", "none") == ["1706.03762", None]
    names = {"Unamuno, Miguel de (1864-1936)": {"family": "Unamuno", "given": "Miguel", "dropping-particle": "de"}, "Ludwig van Beethoven": {"given": "Ludwig", "dropping-particle": "van", "family": "Beethoven"}, "Ana María López Ruiz": {"given": "Ana María", "family": "López Ruiz"}, "National Trust Agency": {"literal": "National Trust Agency"}, "Plato": {"family": "Plato"}, " ,": {}}
    assert {n: N.split_name(n, "es") for n in names} == names
    assert values(spark, N.parsed_name(F.col("x"), F.col("y"))["family"], ("Ann Owen", "en")) == ["Owen"]
    assert spark.range(1).select(N.region(F.lit(100.0), F.lit(-5.0), F.lit(950.0), F.lit(500.0))).first()[0].asDict() == {"x": 0.1, "y": 0.0, "w": 0.9, "h": 0.5}
    assert values(spark, N.read_text(F.col("x")), "a \r\nb\n\n\n\nﬁn") == ["a\nb\n\nfin"]


def test_titles_notes_and_heads(spark):
    u = spark.createDataFrame([("d", i) for i in range(1, 8)], "docref string, ord long")
    titles = spark.createDataFrame([("d", 1, "One"), ("d", 2, "The Trees"), ("d", 3, "the trees"), ("d", 4, "The  Trees!")], "docref string, unit long, text string")
    assert [r["text"] for r in resolve.distinct_titles(titles, u).collect()] == ["One"]
    heads = spark.createDataFrame([("d", i, f"THE TREES {i}") for i in range(1, 5)], "docref string, unit long, text string")
    p = spark.createDataFrame([("d", 1, 0, "The trees 12"), ("d", 1, 1, "Body text."), ("d", 1, 2, "## the Trees"), ("d", 1, 3, "End.")], "docref string, unit long, para int, text string")
    assert [r["text"] for r in resolve.without_heads(p, heads).orderBy("para").collect()] == ["Body text.", "End."]
    notes = spark.createDataFrame([("d", "u", 0, "[^a]: first"), ("d", "u", 1, "2. second"), ("d", "u", 2, "³ third"), ("d", "u", 3, "loose")], "docref string, unit string, i int, note string")
    f = spark.createDataFrame([("d", "u", 1, "word[^a] and end.³"), ("d", "u", 2, "more²[^a]")], "docref string, unit string, n int, text string")
    assert {r["i"]: r["n"] for r in resolve.note_calls(notes, f).collect()} == {0: 1, 1: 2, 2: 1, 3: None}
    entries = spark.createDataFrame([("d", 1, 1, "Oak trees"), ("d", 2, 2, "Nothing such")], "docref string, entry int, unit long, title string")
    paras = spark.createDataFrame([("d", 1, 0, "Intro"), ("d", 2, 3, "## Oak Trees"), ("d", 2, 4, "x")], "docref string, unit long, para int, text string")
    assert {r["entry"]: (r["unit"], r["para"]) for r in units.toc_matches(entries, paras).collect()} == {1: (2, 3), 2: (2, 0)}
    pages = spark.createDataFrame([("d", 1, "it goes on and", ""), ("d", 2, "on here. End.", "foot"), ("d", 3, "foot note", ""), ("d", 4, "New.", "")], "docref string, physical long, text string, footer string")
    assert [r["continues"] for r in resolve.continues(pages).orderBy("physical").collect()] == [False, True, True, False]
    figures = spark.createDataFrame([("d", "u", "g2", "b"), ("d", "u", "g1", "a")], "docref string, unit string, id string, caption string")
    assert [x["figure"] for x in resolve.with_figures(spark.createDataFrame([("d", "u")], "docref string, id string"), figures).first()["figures"]] == ["g1", "g2"]
    text = " ".join(f"word{i}" for i in range(40))
    whole = spark.createDataFrame([("d", "u", f"before {text} after {text[-50:]}")], "docref string, id string, text string")
    pieces = spark.createDataFrame([("d", 1, "u", text[:199]), ("d", 2, "u", text), ("d", 3, "u", "short")], "docref string, n int, unit string, text string")
    assert {r["n"]: r["chars"] for r in units.char_ranges(pieces, whole).collect()} == {1: [7, 206], 2: None, 3: None}


def test_page_exports(spark, book):
    import xml.etree.ElementTree as ET

    u, _ = book
    docs = spark.createDataFrame([("d", json.dumps(OWEN)), ("t", '{"title": "Talk <1>"}')], "docref string, metadata string")
    d = u.where("docref = 'd'")
    assert [(r["physical"], r["printed"], r["n"]) for r in export.page_sequence(d).orderBy("ord").collect()] == [(1, None, None), (2, "1", "1"), (3, "2", "2")]
    alto = ET.fromstring(export.alto(d).first()["text"].encode())
    assert [p.attrib.get("PRINTED_IMG_NR") for p in alto.iter() if p.tag.endswith("}Page")] == [None, "1", "2"]
    tei = {r["docref"]: ET.fromstring(r["text"].encode()) for r in export.tei(u, docs).collect()}
    assert [p.attrib.get("n") for p in tei["d"].iter() if p.tag.endswith("}pb")] == [None, "1", "2"] and any(p.text == "Talk <1>" for p in tei["t"].iter())
    iiif = {r["docref"]: json.loads(r["manifest"]) for r in export.iiif(u, docs, "https://x.test/iiif/").collect()}
    assert [c.get("label") for c in iiif["d"]["items"]] == [None, {"none": ["1"]}, {"none": ["2"]}] and iiif["t"]["items"][0]["duration"] == 200.0
    a = spark.createDataFrame([("d", "u2", 0, 5, None, "cite:d#p=2")], "docref string, unit string, start int, end int, body string, uri string")
    assert export.read_annotations(export.annotations(a, u)).first()["exact"] == "First"


def _zip(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def test_readers(spark):
    page = "<html><head><title>T</title></head><body><nav>skip<p>x</p></nav><h1>Head</h1><p>One <b>two</b></p><span class='pagenum'>[12]</span><div>Three<form>lost</div><p>Four</p></body></html>"
    rows = [("a", "a.html", page.encode()), ("b", "b.md", b"---\nx: 1\n---\n# Title\n\nPara one\nline\n\nUnder\n=====\n"), ("c", "c.csv", b"x;y\n1;2\n\n3;4\n"), ("d", "d.pdf", b"%PDF-1.4"), ("e", "e.txt", None)]
    w = 'xmlns:w="http://w"'
    rows.append(("f", "f.docx", _zip(word__document_DOT_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>A b</w:t></w:r></w:p></w:body></w:document>', word__styles_DOT_xml=f'<w:styles {w}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>')))
    rows.append(("g", "g.xlsx", _zip(xl__workbook_DOT_xml='<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i1"/></sheets></workbook>', xl___rels__workbook_DOT_xml_DOT_rels='<R><Relationship Id="i1" Target="s.xml"/></R>', xl__s_DOT_xml='<w><row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><v>9</v></c></row><row r="3"><c r="B3"><v>2</v></c></row></w>')))
    rows.append(("h", "h.epub", _zip(**{"META-INF__container_DOT_xml": '<c><rootfile full-path="O/p.opf"/></c>', "O__p_DOT_opf": '<p><item id="a" href="t.html"/><itemref idref="a"/></p>', "O__t_DOT_html": "<h2>In</h2><p>Text</p>"})))
    rows.append(("i", "i.odt", _zip(content_DOT_xml='<o xmlns:t="t"><body><t:h t:outline-level="2">Top</t:h><t:p>One<t:s t:c="2"/>two</t:p></body></o>')))
    rows.append(("j", "j.pptx", _zip(ppt__presentation_DOT_xml='<p xmlns:r="r"><sldId id="1" r:id="i1"/></p>', ppt___rels__presentation_DOT_xml_DOT_rels='<R><Relationship Id="i1" Target="s1.xml"/></R>', ppt__s1_DOT_xml='<s><sp><ph type="title"/><p><t>Name</t></p></sp><sp><p><t>Point</t></p></sp></s>')))
    rows.append(("k", "k.docx", _zip(word__document_DOT_xml="<broken")))
    blocks = files.blocks(spark.createDataFrame(rows, "docref string, name string, content binary"), "docref", "name", "content")
    got = [(r["docref"], r["kind"], r["text"]) for r in blocks.orderBy("docref", "ord").collect()]
    assert got[:5] == [("a", "title", "Head"), ("a", "para", "One two"), ("a", "page", "[12]"), ("a", "para", "Three"), ("a", "para", "Four")]
    assert [x for x in got if x[0] in "bc"] == [("b", "title", "Title"), ("b", "para", "Para one\nline"), ("b", "title", "Under"), ("c", "sheet", "| x | y |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |")]
    assert [x for x in got if x[0] > "e"] == [("f", "title", "Head"), ("f", "para", "A b"), ("g", "sheet", "S\n| x |  | 9 |\n| --- | --- | --- |\n|  | 2 |  |"), ("h", "title", "In"), ("h", "para", "Text"), ("i", "title", "Top"), ("i", "para", "One  two"), ("j", "slide", "# Name\n\nPoint"), ("k", "error", "not a sound docx file")]
    made = {(r["docref"], r["unit"]): (r["label"], r["text"]) for r in files.units(blocks.where("docref = 'a'")).collect()}
    assert made == {("a", 1): (None, "# Head\n\nOne two"), ("a", 2): ("[12]", "Three\n\nFour")} and office.kind_of_zip(b"PK\x03\x04x") == "zip"


def test_html_fields(spark):
    html = '<html lang="pt"><meta content="Title here" property="og:title"><META name="DC.Creator" content="A"><meta name="author" content="B"><meta name="dc.identifier" content="doi:10.1234/x"><body><article>' + "word " * 200 + "</article></body></html>"
    got = values(spark, corpus.html_meta(F.col("x")), html, "<p>x</p>")
    assert (got[0]["title"], got[0]["authors"], got[0]["doi"], got[0]["language"]) == ("Title here", ["A", "B"], "10.1234/x", "pt") and got[1]["authors"] == []
    assert values(spark, corpus.main_content(F.col("x")), html, "<body><p>x</p></body>", "x")[1:] == ["<body><p>x</p></body>", "x"] and values(spark, corpus.main_content(F.col("x")), html)[0].startswith("<article>")


def test_sql_functions(spark):
    from quire import sql

    sql.register(spark)
    assert spark.sql("SELECT roman_value('xiv'), canonical_json('{\"b\": 1.0, \"a\": 2}')").first()[:] == (14, '{"a":2,"b":1}')
    assert [r["sentence"] for r in spark.sql("SELECT * FROM sentence_rows('One. Two.')").collect()] == ["One.", "Two."]
    out = sql.embedded(spark.createDataFrame([("a",), (None,)], "text string"), lambda texts: V.fake_vectors(texts, 4))
    assert sorted(len(r["vector"]) for r in out.collect()) == [4, 4]


def test_folder_and_streamed_library(spark, tmp_path):
    from quire.streaming import library

    (tmp_path / "f" / ".hidden").mkdir(parents=True)
    (tmp_path / "f" / "a.txt").write_text("x")
    (tmp_path / "f" / ".hidden" / "b.txt").write_text("y")
    assert [r["name"] for r in files.folder(spark, str(tmp_path / "f")).collect()] == ["a.txt"]
    docs = spark.createDataFrame([("a", "p1", 1), ("a", "p0", 2), ("b", "p2", 3)], "docref string, path string, size int")
    assert sorted(tuple(r) for r in library.first_of_each(docs).collect()) == [("a", "p0", 2), ("b", "p2", 3)]
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    library.follow(library.watch(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "state"), lambda df, i: seen.extend(r["docref"] for r in df.collect())).awaitTermination(120)
    assert sorted(seen) == ["a", "b"]
