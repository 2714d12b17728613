"""Preferred lookups, chains of offsets and names of places."""

from pyspark.sql import functions as F

from foliolake.operators import lookups as L
from foliolake.operators import measures as V
from tests.conftest import rows


def test_scopes(spark):
    c = spark.createDataFrame([("a", "x", "a2"), ("a", "x", "a1"), ("b", "y", "b1"), (None, "x", "n")], "scope string, name string, path string")
    r = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "z"), (4, None, "y"), (5, "a", None)], "id int, scope string, name string")
    assert rows(L.scoped_then_global(r, c, "id", "scope", "name", "path")) == [(1, "a1"), (2, "a1"), (3, None), (4, "b1"), (5, None)]


def test_long_prefix(spark):
    long = "p" * 50
    c = spark.createDataFrame([(long + "1", "one"), ("q" * 60, "two"), ("q" * 55 + "x", "three"), ("short", "four")], "name string, path string")
    r = spark.createDataFrame([(1, long + "zzz"), (2, "q" * 70), (3, "short"), (4, None)], "id int, name string")
    assert rows(L.by_long_prefix(r, c, "id", "name", "path")) == [(1, "one")]


def test_best_file(spark):
    c = spark.createDataFrame([("n", "p1", "png", 100, 100), ("n", "p2", "PNG", 200, 100), ("n", "p3", "tiff", 200, 100), ("n", "p4", "png", 20, 10), ("n", "p5", "png", 200, 100)], "name string, path string, ext string, w int, h int")
    r = spark.createDataFrame([(1, "n", "png", 190, 100), (2, "n", "tiff", 100, 100), (3, "n", "gif", 100, 100), (4, "m", "png", 1, 1), (5, "n", "png", 0, 0)], "id int, name string, ext string, w int, h int")
    assert rows(L.best_file(r, c, "id", "name", "path")) == [(1, "p2"), (2, "p3"), (3, "p1"), (5, "p1")]


def test_summed_chain(spark):
    n = spark.createDataFrame([(1, None, 1.0, 1.0), (2, 1, 2.0, None), (3, 2, 4.0, 0.0), (4, 9, 5.0, 0.0), (5, 5, 1.0, 0.0)], "id int, up int, x double, y double")
    got = {r[0]: r[1] for r in rows(L.summed_chain(n, "id", "up", ["x", "y"]))}
    assert got[3] == 7.0 and got[4] == 5.0 and 17.0 <= got[5] <= 33.0


def test_reachable(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (4, 2), (5, 5), (None, 1), (3, None), (1, 2)], "parent int, child int")
    starts = spark.createDataFrame([(1,), (5,), (3,), (None,)], "start int")
    assert rows(L.reachable(links, starts)) == [(1, 2), (1, 3), (1, 4), (5, 5)]
    assert rows(L.reachable(links.limit(0), starts)) == []


def test_places(spark):
    def one(expression, text):
        return spark.createDataFrame([(text,)], "t string").select(expression.alias("r")).first()["r"]

    arrays, leaves = {"card": "cards", "branch": "branches", "leaf": "leaves", "item": "items"}, {"cards.title": "title_zh", "items": "title_zh"}
    path = L.path_of_text_id(F.col("t"), arrays, leaves)
    for text, want in {"slide-03.card-2.title": "data.cards.1.title_zh", "slide-1.branch-1.leaf-3": "data.branches.0.leaves.2", "slide-1.item-4": "data.items.3.title_zh", "slide-1.lede": "data.lede", "other": None}.items():
        assert one(path, text) == want
    place = L.message_places(F.col("t"))
    for text, want in {"3 slide(s) miss x (slide indices: 1, 2, 3, )": ([1, 2, 3], None, 3, None, []), "slide 4 (cover): font-size 9px in `.a .b` and `.c`": ([4], "cover", None, 9.0, [".a .b", ".c"]), "use `<b>`": ([], None, None, None, [])}.items():
        assert tuple(one(place, text)) == want
    target = L.override_target(F.col("t"))
    for text, want in {"slide-24.html": "page:24", "slide-039.html": "key:slide-039", "slide-a1.html": "key:slide-a1", "x.html": None}.items():
        assert one(target, text) == want


def test_measures(spark):
    df = spark.createDataFrame([("a", "up -50%"), ("a", "100 now"), ("a", "none"), ("b", None), ("a", "7")], "g string, t string").withColumn("bar", F.lit("x"))
    assert rows(V.bars(df, ["g"], V.first_number(F.col("t"))).select("t", "bar")) == sorted([("up -50%", 50.0), ("100 now", 100.0), ("none", None), (None, None), ("7", 40.0)], key=repr)
    assert V.with_columns(df, {"t": "string", "new": "int"}).columns == ["g", "t", "bar", "new"]
