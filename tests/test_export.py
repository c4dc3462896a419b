"""Records, annotations and manifests."""

import json

from quire.operators import export


def test_exports(spark):
    docs = spark.createDataFrame([("d", "T", None)], "docref string, title string, year int")
    passages = spark.createDataFrame([("d", 1, "x"), ("e", 1, "y")], "docref string, n long, text string")
    got = {r["id"]: r["metadata"] for r in export.records(passages, docs, ["title", "year"]).collect()}
    assert got == {"d#1": {"title": "T"}, "e#1": None}
    units = spark.createDataFrame([("d", "u", "é" * 40 + "QUOTE" + "b" * 3)], "docref string, id string, text string")
    quotes = spark.createDataFrame([("d", "u", 40, 45, None, "cite:d#p=1"), ("d", "u", 0, 2, "note", "cite:d#p=1")], "docref string, unit string, start int, end int, body string, uri string")
    out = sorted((json.loads(r["annotation"]) for r in export.annotations(quotes, units).collect()), key=lambda x: x["motivation"])
    assert out[1]["motivation"] == "highlighting" and "body" not in out[1] and out[0]["body"]["value"] == "note"
    s = out[1]["target"]["selector"]
    assert (s["exact"], s["prefix"], s["suffix"]) == ("QUOTE", "é" * 32, "bbb")
    items = spark.createDataFrame([("l", 2, "a" * 64, "B"), ("l", 1, "b" * 64, "A")], "library string, place int, sha256 string, title string")
    assert json.loads(export.manifests(items).first()["manifest"]) == {"title": "l", "items": [{"sha256": "b" * 64, "title": "A"}, {"sha256": "a" * 64, "title": "B"}]}
