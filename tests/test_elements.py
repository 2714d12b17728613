"""Walks over decoded elements, element tables, and changes of a catalogue, by hand-made cases."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliolake.functions import text as X
from foliolake.operators import elements as E
from foliolake.operators import mutate as M
from foliolake.operators import sequence as Q
from foliolake.operators.skew import salted_join
from foliolake.sources import files as S
from foliolake.streaming.tasks import Versions
from tests.conftest import rows


def archives(spark):
    bodies = [
        (1, "group", {"geometry": {"x": 0, "y": 0, "w": 9, "h": 9}, "children": [{"identifier": 2}, {"identifier": 3}]}),
        (2, "image", {"geometry": {"x": 10.4, "y": 2, "w": 99, "h": 50}, "data": {"identifier": "77"}, "media": {"poster": {"data": {"identifier": 78}}}}),
        (3, "group", {"children": [{"identifier": 4}, {"identifier": 1}]}),
        (4, "text", {"geometry": {"x": 1, "y": 1, "w": 8, "h": 8}, "owned": {"storage": {"identifier": 9}}}),
        (5, "text", {"storage": {"identifier": 99}, "data": {"identifier": "none"}}),
    ]
    return spark.createDataFrame([*((i, k, json.dumps(b)) for i, k, b in bodies), (6, "text", "{"), (7, "text", None)], "id bigint, kind string, body string")


def test_data_references(spark):
    a = archives(spark)
    roles = {"data/identifier": "image", "poster/data/identifier": "poster"}
    assert rows(E.data_references(a.unionByName(a), roles)) == [(2, 77, "image"), (2, 78, "poster")]
    assert rows(E.data_references(a.limit(0), roles)) == []


def test_storage_texts_and_records(spark):
    a = archives(spark)
    stores = spark.createDataFrame([(9, ["a", "b"]), (8, ["c"])], "id bigint, text array<string>")
    texts = E.storage_texts(a, stores)
    assert rows(texts) == [(4, "a\nb")]
    roots = spark.createDataFrame([("s", 1), ("t", 2), (None, None)], "slide string, id bigint")
    found = E.data_references(a, {"data/identifier": "image"})
    got = E.element_records(a, roots, {"image": "pic", "text": "txt"}, texts, found)
    assert [(r.slide, r.id, r.kind, r.x, r.w, r.asset, r.text_hash is not None) for r in got.orderBy("slide", "id").collect()] == [("s", "2", "pic", 12, 100, 77, False), ("s", "4", "txt", 0, 8, None, True), ("t", "2", "pic", 12, 100, 77, False)]
    assert got.where("id = '4'").count() == 1 and E.element_records(a, roots, {"text": "txt"}, texts, found, ["a\nb"]).count() == 0


def test_element_table_records(spark):
    lines = ["#SLIDE\t1\tfalse", "CELL\t0\t0\t1\t1\taGk=", "ITEM\ttable\t1\t2\t3\t4\t0\tf.png\tArial\t12\t1\t2\t3\t\t\t\t0\t100\taGk=", "CELL\t0\t1\t5\t6\taGk=", "CELL\t1\t0\t5\t6\tA\t9\t1\t2\t3\t4\t5\t6\tb3g=", "ITEM\tgroup\t1\t2\t3\t4", "SERIES\taGk=", "POINT\t0\t1\t2.5", "RUN\tB\tbad\t1\t2\t3\t!", "CHART_META\tbar", "#SLIDE\t2\ttrue", "ITEM\ttext", "RUN\tB\t1\t1\t1\t1\taGk="]
    df = S.lines_of(spark.createDataFrame([("p", "\n".join(lines))], "path string, text string"), "path", "text")
    assert [(r.line, r.kind, r.text, r.size, r.r, r.opacity) for r in S.elements_from_tsv(df, fields=S.EXTRACTED).orderBy("line").collect()] == [(2, "table", "hi", 12.0, 1, 100.0), (5, "group", None, None, None, None)]
    assert [(r.item, r.row, r.col, r.size, r.text) for r in S.records_from_tsv(df, "CELL").orderBy("line").collect()] == [(2, 0, 1, None, "hi"), (2, 1, 0, 9.0, "ox")]
    assert [(r.item, r.name) for r in S.records_from_tsv(df, "SERIES").collect()] == [(2, "hi")]
    assert [(r.series, r.category, r.value) for r in S.records_from_tsv(df, "POINT").collect()] == [(0, 1, 2.5)]
    assert [(r.font, r.size, r.text) for r in S.records_from_tsv(df, "RUN").collect()] == [("B", None, None)]
    assert [r.kind for r in S.records_from_tsv(df, "CHART_META").collect()] == ["bar"]


def test_create_and_delete(spark):
    old = spark.createDataFrame([("a", 1, 2, "x")], "id string, s int, e int, status string")
    new = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "x"), ("c", 1, None, "x"), (None, 1, 1, "x"), ("d", 1, 1, "x"), ("d", 1, 1, "y")], old.schema)
    table, answers = M.create_rows(old, new, "id", "s", "e")
    assert rows(answers) == sorted([("a", 409), ("b", 400), ("c", 201), (None, 400), ("d", 409), ("d", 409)], key=repr)
    assert sorted(r.id for r in table.collect()) == ["a", "c"]
    left, answers = M.delete_rows(table, spark.createDataFrame([("a",), ("z",), ("a",)], "id string"), "id")
    assert rows(answers) == [("a", 200), ("z", 404)] and [r.id for r in left.collect()] == ["c"]


def test_request_faults(spark):
    slides = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1), ("e", 2)], "deck_id string, page_no int")
    r = spark.createDataFrame([(1, "d", "insert", 3), (2, "d", "insert", 4), (3, "d", "delete", 3), (4, "d", "delete", 1), (5, "x", "delete", 1), (6, "e", "delete", 1), (7, "e", "delete", 2), (8, "d", "insert", None)], "request int, deck_id string, op string, page int")
    assert rows(M.request_faults(r, slides)) == [(2, "no page"), (3, "no page"), (4, "cover"), (5, "no deck"), (6, "all"), (6, "cover"), (7, "all"), (8, "no page")]


def test_enqueue_is_stable(spark):
    r = spark.createDataFrame([(1, "d", None), (2, "d", 3)], "request int, deck string, page int")
    a, b = (rows(M.enqueue(r, "insert", ["deck", "page"], F.lit(5))) for _ in range(2))
    assert a == b and {x[2] for x in a} == {'{"deck":"d","page":null}', '{"deck":"d","page":3}'} and len({x[0] for x in a}) == 2


def test_copied_tags(spark):
    s = spark.createDataFrame([("a", None, "t1", "f1"), ("b", "B", "t2", None), ("c", "C", "t3", "f3")], "id string, title string, tag string, free string")
    m = spark.createDataFrame([("c", "a"), ("a", "b")], "id string, source string")
    assert rows(M.copy_tags(s, s, m, ["tag", "free"]).select("id", "tag", "free")) == [("a", "t2", "f1"), ("b", "t2", None), ("c", "t3", "f3")]


def test_flips_and_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id int, hidden int")
    assert rows(Q.flips(df, F.lit(True), True)) == [(1, 1), (3, 1)] and rows(Q.flips(df, F.lit(True), False)) == [(2, 0)]
    n = spark.createDataFrame([("07 x", 3), ("x", 123), (None, 1)], "l string, n int")
    assert [r[0] for r in n.select(Q.renumber_label(F.col("l"), F.col("n"))).collect()] == ["03 x", "123x", None]


def test_numbers_are_those_of_a_window(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 7, F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("o"), "id", F.lit(1).alias("_x"))
    order = [F.desc("o"), F.asc("id")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert rows(Q.numbered(df, ["g"], order, "n")) == rows(want)
    assert rows(Q.numbered(df.limit(0), ["g"], order, "n")) == []


def test_salted_join_is_the_join(spark):
    many = spark.createDataFrame([(1, i) for i in range(300)] + [(2, 1), (None, 1), (3, 9)], "k int, v int")
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "k int, w string")
    weights = many.groupBy("k").agg(F.count(F.lit(1)).alias("weight"))
    assert rows(salted_join(many, few, "k", weights, 20000.0)) == rows(many.join(few, "k"))
    assert rows(salted_join(many.limit(0), few, "k", weights, 0.0)) == []


def test_title_by_version(spark):
    df = spark.createDataFrame([(2, "T"), (2, ""), (2, None), (1, "T")], "v int, t string")
    got = [(r.r.title, r.r.source) for r in df.select(X.title_of("v", "t", F.lit(""), F.lit("Body。x"), F.lit(4)).alias("r")).collect()]
    assert got == [("T", "extracted"), ("(p4 · 无标题)", "stub"), ("Body", "auto-summary"), ("Body", "auto-summary")]


def test_versions_by_buckets(spark, tmp_path):
    v = Versions(spark, f"file:{tmp_path}/t")
    assert v.read() is None and v.current == 0
    df = spark.createDataFrame([(1, 0), (2, 1)], "id int, bucket int")
    v.write(df)
    v.write(spark.createDataFrame([(3, 1)], "id int, bucket int"))
    assert rows(v.read().select("id")) == [(1,), (3,)] and rows(v.read([0]).select("id")) == [(1,)] and v.read([5]) is None
    v.roll_back()
    assert rows(v.read().select("id")) == [(1,), (2,)]
