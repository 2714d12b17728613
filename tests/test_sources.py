"""Readers and small operators that no query runs, by files and hand-made rows."""

import json

from pyspark.sql import functions as F

from foliolake.operators import documents as D
from foliolake.operators import matching as N
from foliolake.operators import spatial as B
from foliolake.sources import files as S
from tests.conftest import rows


def test_read_decks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": "2", "slides": [None, {"key": "k1", "layout": "cover"}, {"layout": "grid"}]}))
    (tmp_path / "b.json").write_text('{"slides": [')
    (tmp_path / "c.json").write_text("")
    got = S.read_decks(spark, f"file:{tmp_path}/*.json").select("slide_pos", "key", "layout", "page_no")
    assert rows(got) == [(1, "k1", "cover", 1), (2, None, "grid", 2)]


def test_frames(spark):
    html = '<section class="slide" data-slide-key="a"><section>x</section></section><section class="slide" hidden>y</section><section class="slide">open'
    df = spark.createDataFrame([("d", html, 1), ("e", "", 2), ("f", None, 3), (None, '<section class="slide">z</section>', 4)], "deck string, html string, pos int")
    got = rows(S.frames(df, "deck", "html"))
    assert got == sorted([("d", 0, "a", False, "<section>x</section>"), ("d", 1, "", True, "y"), (None, 0, "", False, "z")], key=repr)
    prior = spark.createDataFrame([("a", "T", "n"), ("b", " ", None)], "slide_key string, title string, notes string")
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "slide_key string")
    assert rows(S.keep_prior(found, prior, ["slide_key"])) == [("a", "T", "n"), ("b", "b", None), ("c", "c", None)]


def test_discover(spark):
    folders = spark.createDataFrame([("x", "/a"), ("y", "/b"), ("x", "/a")], "name string, path string")
    aliases = spark.createDataFrame([("x", "/b"), ("z", "/gone"), ("n", None)], "name string, path string")
    got = set(rows(S.discover(folders, aliases)))
    assert got == {("x", "/b", "alias"), ("z", "/gone", "broken"), ("n", None, "broken"), ("y", "/b", "folder")}


def test_append_history(spark):
    old = spark.createDataFrame([("c", 1, "a", 1), ("c", 2, "b", 2)], "chain string, step int, note string, at int")
    new = spark.createDataFrame([("c", "d", 9), ("c", "e", 5), ("z", "f", 1)], "chain string, note string, at int")
    assert rows(S.append_history(old, new)) == [("c", 1, "a", 1), ("c", 2, "b", 2), ("c", 3, "e", 5), ("c", 4, "d", 9), ("z", 1, "f", 1)]
    assert rows(S.append_history(old.limit(0), new.where("chain = 'z'"))) == [("z", 1, "f", 1)]


def test_keep_fields(spark):
    df = spark.createDataFrame([({"a": "1", "b": None, "c": "3"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(D.keep_fields(F.col("m"), ["a", "b", "x"])).collect()] == [{"a": "1", "b": None}, {}, None]


def test_close_boxes(spark):
    one = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 8.0, -8.0, 10.0, 17.9), (0.0, 0.0, 10.0, 10.0, 8.1, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, None, 0.0, 0.0, 10.0, 10.0)], "ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double")
    got = one.select(B.close_boxes(B.box("a"), B.box("b")).alias("r"))
    assert [r[0] for r in got.collect()] == [True, False, None]


def test_gate_strict_and_unknown(spark):
    found = spark.createDataFrame([(1, f"$.p{i:02}", "r") for i in range(12)] + [(1, "$.q", "odd"), (2, "$", "w")], "id int, path string, rule string")
    rules = spark.createDataFrame([("r", "f", "error"), ("w", "f", "warning")], "rule string, family string, severity string")
    first = ",".join(f"$.p{i:02}" for i in range(10))
    assert rows(D.gate(found, rules, "id")) == [(1, "f", 12, 0, first), (1, "uncategorized", 0, 1, "$.q"), (2, "f", 0, 1, "$")]
    assert rows(D.gate(found, rules, "id", strict=True))[2] == (2, "f", 1, 0, "$")
    docs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int")
    assert rows(D.passes(found, rules, docs, "id")) == [(1, False), (2, True), (3, True)] and rows(D.passes(found, rules, docs, "id", strict=True)) == [(1, False), (2, False), (3, True)]
    assert rows(D.by_code(found, rules)) == [("r", "f", "error", 1, 12), ("w", "f", "warning", 1, 1)]


def test_token_pairs_within(spark):
    df = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["x", "y"]), ("c", ["q"]), ("d", []), ("e", None), ("f", ["q"])], "id string, tokens array<string>")
    assert [(r.a, r.b, round(r.jaccard, 3)) for r in N.token_pairs_within(df, "id", 0.5).orderBy("a").collect()] == [("a", "b", 0.667), ("c", "f", 1.0)]
