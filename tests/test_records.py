"""Intervals, record shredding and unpacking against brute force, round trips and edge cases."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliolake.operators import packed, shred
from foliolake.operators.intervals import BUCKET, coverage
from foliolake.operators.skew import lookup
from tests.conftest import rows

# coverage


def brute_coverage(data):
    pages = {}
    for k, a, b in data:
        if k is not None and a is not None and b is not None and a <= b:
            pages.setdefault(k, set()).update(range(a, b + 1))
    out = []
    for k, held in pages.items():
        runs = []
        for p in sorted(held):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out += [(k, "period", a, b) for a, b in runs]
        out += [(k, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:], strict=False)]
    return sorted(out, key=repr)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-30, 60)), st.one_of(st.none(), st.integers(-30, 60))), max_size=25))
def test_coverage_is_brute_force(spark, data):
    df = spark.createDataFrame(data, "k string, a int, b int")
    assert rows(coverage(df, "k", "a", "b")) == brute_coverage(data)


def test_coverage_over_buckets_and_clashing_columns(spark):
    top = BUCKET * 3
    data = [("x", 1, top, 0, "p"), ("x", top + 1, top + 5, 0, "q"), ("x", top + 9, top + 9, 0, None), ("x", top + 9, top + 9, 0, None)]
    df = spark.createDataFrame(data, "entity string, at int, bucket int, active int, kind string")
    assert rows(coverage(df, "entity", "at", "bucket")) == [("x", "gap", top + 6, top + 8), ("x", "period", 1, top + 5), ("x", "period", top + 9, top + 9)]


def test_coverage_of_nothing_and_extremes(spark):
    empty = spark.createDataFrame([], "k string, a int, b int")
    assert rows(coverage(empty, "k", "a", "b")) == []
    most = 2**31 - 1
    df = spark.createDataFrame([("k", most, most), ("k", -5, -5)], "k string, a int, b int")
    assert rows(coverage(df, "k", "a", "b")) == [("k", "gap", -4, most - 1), ("k", "period", -5, -5), ("k", "period", most, most)]


# shredding


def leaves(value, path=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, (*path, str(i)))
    else:
        yield "/".join(path), value


JSON = st.recursive(st.none() | st.booleans() | st.integers(-9999, 9999) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON, st.booleans())
def test_pull_parser_is_json(value, ascii_only):
    text = json.dumps(value, ensure_ascii=ascii_only)
    got = [(p, v) for p, v, _ in shred.triples(text)]
    shown = {True: "true", False: "false", None: None}
    want = [(p, shown[v] if v is None or isinstance(v, bool) else v if isinstance(v, str) else str(v)) for p, v in leaves(value)]
    assert got == want


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", '"x', "01", "tru", "[1]]", '{"a":1}x', "{1:2}", '["\\x"]', "[,1]", '{"a":}'])
def test_pull_parser_refuses_what_json_refuses(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(shred.Incomplete):
        list(shred.triples(text))


@settings(max_examples=100, deadline=None)
@given(JSON, st.integers(0, 60))
def test_cut_texts_are_incomplete(value, at):
    text = json.dumps({"v": value})
    if 0 < at < len(text):
        with pytest.raises(shred.Incomplete):
            list(shred.triples(text[:at]))


DECK = {
    "slides": [
        None,
        {"key": "a", "layout": "grid", "data": {"lede": "L", "cards": {"title_zh": "one"}, "body_blocks": ["plain", {"text": "t", "children": {"text": "kid", "children": ["deep"]}}, {"text": None}, {"text": "  　"}]}},
        {"key": "b", "layout": None, "data": json.dumps({"columns": [{"width": 1}, {"cards": [{"num": 1}, {"title_zh": "in column", "metrics": [{"text": "no"}]}]}], "items": [{"title_zh": "no"}]})},
        {"key": "c", "data": "{broken"},
    ]
}


def test_groups_by_repeated_ancestor(spark):
    docs = [(1, '{"id": 7, "a": [{"x": 1, "b": [{"y": "p"}, {"y": null, "c": {"z": true}}]}, {"x": 2, "b": {"y": "q"}}], "m": [[1, 2], [3]]}', "e"), (2, "[4]", "e"), (3, "{", "e"), (None, "{}", "e"), (4, None, "e")]
    t = shred.shred(spark.createDataFrame(docs, "record int, doc string, element string"), "record", "doc", lists=("b",))
    assert rows(shred.groups(t)) == sorted([("", "id", 1), ("a", "x", 2), ("b", "y", 3), ("b", "c/z", 1), ("m", "", 3), ("", "", 1)], key=repr)
    b = shred.flat_table(t, "record", "b", {"y": "y", "c/z": "z"})
    got = rows(b.select("record", "element", shred.parent_of(F.col("element")), "y", "z"))
    assert got == [(1, "a/0/b/0", "a/0", "p", None), (1, "a/0/b/1", "a/0", None, "true"), (1, "a/1/b/0", "a/1", "q", None)]
    assert rows(shred.flat_table(t, "record", "m", {"": "v"}).select("element", "v")) == [("m/0/0", "1"), ("m/0/1", "2"), ("m/1/0", "3")]


def test_deck_items(spark):
    data = [(1, json.dumps(DECK), "x"), (2, json.dumps(DECK)[:-1], "x"), (3, None, "x"), (None, json.dumps(DECK), "x"), (4, "[]", None), (1, json.dumps(DECK), "x")]
    df = spark.createDataFrame(data, "file_id bigint, doc string, layout string")
    want = [
        (1, 1, "grid", "block", "body_blocks/0", "plain"),
        (1, 1, "grid", "block", "body_blocks/1", "t"),
        (1, 1, "grid", "block", "body_blocks/1/children/0", "kid"),
        (1, 1, "grid", "block", "body_blocks/1/children/0/children/0", "deep"),
        (1, 1, "grid", "card", "cards/0", "one"),
        (1, 2, "", "card", "columns/1/cards/1", "in column"),
    ]
    assert rows(shred.deck_items(df)) == want
    assert rows(shred.deck_items(df, ledes=True).where("kind = 'lede'")) == [(1, 1, "grid", "lede", "lede", "L")]
    assert rows(shred.deck_items(df.limit(0))) == []
    assert [tuple(r)[:3] for r in rows(shred.deck_slides(df))] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")]


# unpacking


@pytest.mark.parametrize(
    ("field", "want"),
    [
        ('["a b", "c, d", "x|y"]', ["a b", "c, d", "x|y"]),
        ("['a b', 'c;d']", ["a b", "c;d"]),
        ('["\\u7cbe\\u9009", "the \\"why\\" page"]', ["精选", 'the "why" page']),
        ('"the ""why"" page";"c;d";long one', ['the "why" page', "c;d", "long one"]),
        ("“甲、乙”、“丙”", ["甲、乙", "丙"]),
        ('["a", "b",', ["a", "b"]),
    ],
)
def test_some_dialect_reads_a_field(field, want):
    assert want in packed.parses(field)


def test_unpack_learns_values(spark):
    words = ["pilot", "demo", "long read", "海报", "A/B test", "red, blue"]
    fields = [f"{a}|{b}" for a in words[:4] for b in words[:4]] + [json.dumps([a, b], ensure_ascii=False) for a in words for b in words]
    fields += [f"{a} , ,{b},," for a in words[:4] for b in words[:3]] + ["#pilot #demo #海报", "pilot; demo | 海报", "A/B test", "", "  ", None, "[]", ",,", 'demo;"red, blue"']
    df = spark.createDataFrame([(f"k{i}", f, 1) for i, f in enumerate(fields)] + [("k0", fields[0], 2)], "id string, free_tags string, pos int")
    got = {}
    for k, pos, v in rows(packed.unpack(df, "id", "free_tags")):
        got.setdefault(k, []).append((pos, v))
    at = {f: f"k{i}" for i, f in enumerate(fields)}
    assert got["k0"] == [(1, "pilot"), (2, "pilot")]
    assert got[at["#pilot #demo #海报"]] == [(1, "pilot"), (2, "demo"), (3, "海报")]
    assert got[at["pilot; demo | 海报"]] == [(1, "pilot"), (2, "demo"), (3, "海报")]
    assert got[at["A/B test"]] == [(1, "A/B test")]
    assert got[at['demo;"red, blue"']] == [(1, "demo"), (2, "red, blue")]
    for f in ("", "  ", None, "[]", ",,"):
        assert at[f] not in got
    assert rows(packed.unpack(df.limit(0), "id", "free_tags")) == []


def test_lookup_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, i int")
    right = left.where("k IS NOT NULL").groupBy("k").count()
    assert lookup(left, right, "k", "count", 3050.0).count() == 3050
