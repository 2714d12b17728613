"""Catalogue, matching, change, document, file, box and stream operators."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from foliolake.operators import catalog as C
from foliolake.operators import documents as D
from foliolake.operators import files as P
from foliolake.operators import matching as N
from foliolake.operators import mutate as M
from foliolake.operators import sequence as Q
from foliolake.operators import spatial as B
from foliolake.plans import content
from foliolake.sources import files as S
from foliolake.streaming import tasks as T
from tests.conftest import rows


@pytest.fixture(scope="module")
def deck(spark):
    data = [(i, f"d/{i}", "d" if i < 8 else "e", f"k{i}", None if i == 7 else i, f"title {i}", "{}", 0) for i in range(1, 10)]
    return spark.createDataFrame(data, "row_seq bigint, id string, deck_id string, slide_key string, page_no int, title string, free_tags string, hidden int").withColumn("thumbnail_path", F.col("id"))


@pytest.fixture(scope="module")
def stories(spark):
    return spark.createDataFrame([("a", "A", "d", 1, 3, 1), ("b", "B", "d", 3, 4, 2), ("c", "C", "d", None, 9, 3), ("x", "X", "d", 5, 4, 4), ("e", "E", "f", 1, 9, 5)], "id string, title string, deck_id string, start_page int, end_page int, seq int")


def test_members_and_orphans_part_the_slides(deck, stories):
    inside = {r[2] for r in rows(C.members(stories, deck))}
    outside = {r.id for r in C.orphans(stories, deck).collect()}
    assert inside == {"d/1", "d/2", "d/3", "d/4"}
    assert inside | outside == {r.id for r in deck.collect()} and not inside & outside


def test_deck_rollup(deck, stories):
    got = {r.deck_id: (r.slides, r.stories, r.cover_key) for r in C.decks(deck, stories).collect()}
    assert got == {"d": (7, 4, "k1"), "e": (2, 0, "k8")}


def test_search_nulls(spark):
    df = spark.createDataFrame([(1, "Risk", None), (2, None, "x"), (3, "r%sk", "y")], "id int, t string, tag string")
    assert [r.id for r in C.search(df, text="RISK", columns=["t"]).collect()] == [1]
    assert [r.id for r in C.search(df, text="%", columns=["t"]).collect()] == [3]
    assert {r.id for r in C.search(df, without={"tag": ["x"]}).collect()} == {1, 3}
    assert {r.id for r in C.search(df, only={"tag": ["x"]}).collect()} == {2}


@pytest.mark.parametrize(("jac", "ovl"), [(0.2, 0.4), (0.6, 0.5), (0.5, 1.0)])
def test_inverted_join_is_brute_force(spark, jac, ovl):
    rng = random.Random(int(jac * 10))
    a = {i: rng.sample(range(40), rng.randint(0, 12)) for i in range(25)}
    b = {i: rng.sample(range(40), rng.randint(0, 20)) for i in range(40)}
    want = set()
    for p, x in a.items():
        for s, y in b.items():
            c, n, m = len({*x} & {*y}), len(x), len(y)
            if n and m and (c / (n + m - c) >= jac or c / min(n, m) >= ovl):
                want.add((p, s))
    x, y = (spark.createDataFrame([(k, [f"t{v}" for v in vs]) for k, vs in d.items()], f"{n} int, tokens array<string>") for d, n in ((a, "page"), (b, "slide")))
    for join in (N.token_pairs, N.query_pairs):
        got = join(x, y, jac, ovl)
        assert {(r.page, r.slide) for r in got.collect()} == want and got.count() == len(want)


def brute(a, b, jac, ovl):
    found = {}
    for p, x in a.items():
        for s, y in b.items():
            c, n, m = len({*x} & {*y}), len(x), len(y)
            if n and m and (c / (n + m - c) >= jac or c / min(n, m) >= ovl):
                found[p, s] = (c / (n + m - c), c / min(n, m))
    return found


def set_tables(spark, a, b):
    return [spark.createDataFrame([(k, None if v is None else [f"t{x}" for x in v]) for k, v in d], f"{n} string, tokens array<string>") for d, n in ((a, "page"), (b, "slide"))]


@pytest.mark.parametrize(("jac", "ovl"), [(0.2, 0.4), (0.6, 0.8), (0.5, 2.0)])
def test_blocks_and_rare_tokens_are_brute_force(spark, monkeypatch, jac, ovl):
    rng = random.Random(7)
    a = {f"p{i}": rng.sample(range(30), rng.randint(0, 12)) for i in range(40)}
    b = {f"s{i}": rng.sample(range(40), rng.randint(0, 20)) for i in range(60)}
    want = brute(a, b, jac, ovl)
    x, y = set_tables(spark, [*a.items(), (None, [1, 2]), ("none", None)], [*b.items(), (None, [1, 2]), ("none", None)])
    monkeypatch.setattr(N, "FLUSH", 3)
    for got in (N.block_pairs(x, y, jac, ovl), N.block_pairs(x, y, jac, ovl, 5), N.rare_pairs(x, y, jac, ovl)):
        found = got.collect()
        assert {(r.page, r.slide): (r.jaccard, r.overlap) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize(("common", "held", "way"), [(0, 10, "rare_pairs"), (8, 120, "block_pairs")])
def test_way_of_token_pairs_by_what_meets(spark, monkeypatch, common, held, way):
    """Sets of rare tokens go by these, sets that share many tokens with all others by blocks; the pairs are the same."""
    a = {f"p{i}": [*range(common), *(100 + 4 * i + k for k in range(4))] for i in range(40)}
    b = {f"s{i}": [*range(common), *(100 + 4 * i + k for k in range(1, 5))] for i in range(40)}
    monkeypatch.setattr(N, "HELD", held)
    used = []
    for name in ("rare_pairs", "block_pairs"):
        monkeypatch.setattr(N, name, lambda *args, name=name, join=getattr(N, name): used.append((name, *args[4:])) or join(*args))
    got = N.token_pairs(*set_tables(spark, a.items(), b.items()), 0.4, 0.5).collect()
    assert {(r.page, r.slide): (r.jaccard, r.overlap) for r in got} == brute(a, b, 0.4, 0.5) and used[0][0] == way and len(used) == 1
    assert way == "rare_pairs" or used[0][1] == 4


def test_token_pairs_shuffle_neither_tokens_nor_candidates(spark):
    """Ten tokens of every set are common to all, so that every page meets every slide, but few pairs reach a threshold."""
    a = [(f"p{i}", [*range(10), *(1000 * i + k for k in range(100, 130))]) for i in range(20)]
    b = [(f"s{i}", [*range(10), *(1000 * i + k for k in range(110, 140))]) for i in range(500)]
    x, y = set_tables(spark, a, b)
    sc = spark.sparkContext
    before = int(sc._jsc.sc().dagScheduler().nextStageId())
    assert {(r.page, r.slide) for r in N.token_pairs(x, y).collect()} == {(f"p{i}", f"s{i}") for i in range(20)}
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = sc._jsc.sc().statusStore()
    written = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in range(before, int(sc._jsc.sc().dagScheduler().nextStageId())))
    groups = max(sc.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert written <= len(b) + len(a) * groups + 100


def test_every_candidate_has_a_rank(spark, tmp_path):
    text = "alpha beta gamma delta epsilon zeta"
    spark.createDataFrame([(1, text), (2, text)], "item_id bigint, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    docs = [(i, f"{text} and some more words" if i % 2 else text) for i in range(25)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(page, slide, rank) for page in (1, 2) for rank, slide in enumerate([*range(0, 25, 2), *range(1, 25, 2)], 1)]
    assert rows(content.candidate_rank(spark, str(tmp_path)).select("page", "slide", "rank")) == sorted(want, key=repr)


def test_probe_merges_five_channels(spark, tmp_path):
    schema = "row_seq bigint, id string, deck_id string, iwa_uuid string, element_sig string, template_sig string, body_text string"
    text = "alpha beta gamma delta epsilon"
    data = [(1, "o/1", "o", "U", "E", "T", text), (2, "o/2", "o", None, "E", "T", "other words"), (3, "o/3", "o", None, None, "T2", f"{text} zeta"), (4, "o/4", "o", "U4", None, None, None)]
    data += [(5, "n/1", "n", "U", "E", "T", text), (6, "n/2", "n", "U4", None, "T2", "alpha beta")]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "slides.parquet"))
    spark.createDataFrame([("n/1", "h"), ("o/1", "h"), ("n/2", "i"), ("o/4", "i"), ("n/2", "j"), ("o/3", "j")], "slide_id string, asset_hash string").write.parquet(str(tmp_path / "slide_assets.parquet"))
    spark.createDataFrame([("h", 60000, "png"), ("i", 60000, ".PNG"), ("j", 10, "png")], "hash string, size_bytes bigint, ext string").write.parquet(str(tmp_path / "assets.parquet"))
    want = [("n/1", "o/1", "uuid,structural,template,text,asset", 30, 1), ("n/1", "o/3", "text", 4, 2), ("n/2", "o/4", "asset", 2, 1)]
    assert rows(content.unified_probe(spark, str(tmp_path))) == want


def test_tiers(spark):
    df = spark.createDataFrame([("a", 1, "u", "s", None), ("b", 2, None, "s", "t"), ("c", 3, "u", "s", "t"), ("d", 4, None, None, None)], "id string, row_seq int, u string, s string, t string")
    m = N.tier_matches(df, df, "id", [("uuid", "u"), ("structural", "s"), ("template", "t")], "row_seq", earlier=True)
    assert [(r.id, r.tier, r.match) for r in m.orderBy("id", "tier").collect()] == [("b", "structural", "a"), ("c", "structural", "a"), ("c", "template", "b"), ("c", "uuid", "a")]
    assert rows(N.first_tier(m, ["id"], ["uuid", "structural", "template"])) == [("b", "structural", "a"), ("c", "uuid", "a")]


def test_precision_by_hand(spark):
    c = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (1, "x")], "id int, channel string")
    labels = spark.createDataFrame([(1, "S"), (2, "N"), (3, "?")], "id int, label string")
    assert rows(N.precision(c, labels, ["id"], ["S", "L"], ["N"])) == [("x", 1, 1, 1, 0.5), ("y", 0, 0, 1, None)]


def test_upsert_classes(spark):
    schema = "id string, title string, tag string, notes string, made int"
    old = spark.createDataFrame([("a", "A", "mine", "n", 1), ("b", "B", None, "n", 1), ("gone", "G", "g", None, 1)], schema)
    new = spark.createDataFrame([("a", "A2", "auto", None, 9), ("b", None, "auto", "n2", 9), ("c", "C", "auto", None, 9), (None, "x", "x", "x", 9)], schema)
    def run(o, retag=False):
        return M.upsert(o, new, "id", ["title"], ["tag"], ["notes"], retag)
    once = run(old)
    want = [("a", "A2", "mine", "n", 1), ("b", None, None, "n2", 1), ("c", "C", "auto", None, 9), ("gone", "G", "g", None, 1)]
    assert rows(once) == want and rows(run(once)) == want
    assert ("a", "A2", "auto", "n", 1) in rows(run(old, True))


def test_propagate_last_and_first(spark, deck, stories):
    s = stories.where("id IN ('a', 'b')")
    tagged = deck.withColumn("customer_tag", F.lit("old")).withColumn("type_tag", F.when(F.col("page_no") == 2, "kept"))
    got = {r[0]: r[1:] for r in rows(M.propagate(tagged, s, F.col("title"), F.lower("title"), ["other"], "seq"))}
    assert got["d/2"] == ("A", "kept") and got["d/3"] == ("B", "a") and got["d/4"] == ("B", "b") and got["d/9"] == ("old", None)


def test_flag_once(spark, deck, stories):
    tagged = deck.withColumn("tags", F.when(F.col("page_no") == 5, F.array(F.lit("needs-review"))))
    once = M.flag_orphans(tagged, stories)
    again = M.flag_orphans(tagged.drop("tags").join(once, "id"), stories)
    assert rows(once) == rows(again) and ("d/1", []) in rows(once) and ("d/5", ["needs-review"]) in rows(once) and ("d/7", ["needs-review"]) in rows(once)


def test_task_fold(spark):
    e = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "done"), (2, 1, "running"), (3, 1, "queued")], "task int, s int, status string").withColumn("at", F.timestamp_seconds("s"))
    assert {r.task: r.status for r in M.fold_tasks(e, "task", "at", "status").collect()} == {1: "done", 2: "failed", 3: "queued"}
    soon = F.timestamp_seconds(F.lit(60))
    assert {r.task: r.status for r in M.fold_tasks(e, "task", "at", "status", {"timeout": 100}, soon).collect()}[2] == "running"


SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "uniqueItems": True, "maxItems": 2, "items": {"$ref": "#/$defs/s"}}, "c": {"oneOf": [{"type": "string"}, {"const": 3}]}}, "additionalProperties": False, "$defs": {"s": {"type": "string", "minLength": 2, "pattern": "^x"}}, "if": {"required": ["b"]}, "then": {"required": ["c"]}}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ({"a": 1}, []),
        ({"a": True}, [("$.a", "type")]),
        ({"a": 0, "z": 1}, [("$.a", "minimum"), ("$.z", "additionalProperties")]),
        ({}, [("$.a", "required")]),
        ([], [("$", "type")]),
        ({"a": 1, "b": ["xa", "xa", "q"], "c": 3}, [("$.b", "maxItems"), ("$.b", "uniqueItems"), ("$.b[2]", "minLength"), ("$.b[2]", "pattern")]),
        ({"a": 1, "b": []}, [("$.c", "required")]),
        ({"a": 1, "c": 4}, [("$.c", "oneOf"), ("$.c", "type")]),
    ],
)
def test_schema(value, want):
    assert D.Schema(SCHEMA).check(value) == want


def test_documents(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}}'), (2, "bad"), (3, None)], "id int, doc string")
    assert [r[0] for r in df.select(D.get_path("doc", "a.b.1.c")).collect()] == ["x", None, None]
    new = {r.id: r.doc for r in D.set_path(df, "doc", "a.d.e", "[1]").collect()}
    assert json.loads(new[1]) == {"a": {"b": [1, {"c": "x"}], "d": {"e": [1]}}} and new[2] == "bad" and new[3] is None
    assert rows(D.violations(df, "id", "doc", {"type": "array"})) == [(1, "$", "type"), (2, "$", "json")]
    assert D.picks("1,3-5,all,99", 6) == [1, 3, 4, 5, 2, 6]


def test_array_edits(spark):
    df = spark.createDataFrame([([("a", 1), ("b", 2), ("c", 3)],)], "s array<struct<key:string,v:int>>")
    def keys(c):
        return [x.key for x in df.select(c.alias("r")).first().r]
    s = F.col("s")
    assert keys(D.reorder(s, ["c", "a"])) == ["c", "a", "b"]
    assert keys(D.remove(s, ["b"])) == ["a", "c"]
    assert keys(D.clone(s, "a", "a2")) == ["a", "a2", "b", "c"]
    assert keys(D.splice(s, 9, F.slice(s, 1, 1))) == ["a", "b", "c", "a"]
    assert keys(D.splice(s, 0, F.slice(s, 3, 1))) == ["c", "a", "b", "c"]


def test_files(spark, tmp_path):
    for name, content in {"a/x": b"same", "a/y": b"same", "b/z": b"othe", "c": b"longer"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    stored = P.stored_hashes(spark, str(tmp_path))
    assert rows(P.savings(stored, "hash", "size_bytes", ["path"]).select("copies", "freed")) == [(2, 4)]
    html = spark.createDataFrame([(1, '<img src="a/x?v=1"><a href="https://q"><i style="background:url(\'./b/z\')"><b src="#n">'), (2, None)], "id int, html string")
    refs = P.references(html, "id", "html")
    assert rows(refs) == [(1, "a/x"), (1, "b/z")]
    have = spark.createDataFrame([("a/x",), ("c",)], "path string")
    assert rows(P.orphaned(have, refs)) == [("c",)] and rows(P.missing(refs, have).select("path")) == [("b/z",)]


def test_large_files_are_hashed(spark, tmp_path):
    size = 65 * 1024 * 1024
    for name, last in {"a/one 100%25 é.mp4": b"x", "b/two.mp4": b"x", "b/other.mp4": b"y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with (tmp_path / name).open("wb") as f:
            f.seek(size - 1)
            f.write(last)
    (tmp_path / "single").write_bytes(b"of its own size")
    stored = P.stored_hashes(spark, str(tmp_path)).cache()
    assert rows(P.savings(stored, "hash", "size_bytes", ["path"]).select("hash", "copies", "freed")) == [(hashlib.sha256(b"\0" * (size - 1) + b"x").hexdigest(), 2, size)]
    assert [r.path.rsplit("/", 1)[1] for r in stored.where("hash IS NULL").collect()] == ["single"]


def test_boxes(spark):
    schema = "page int, id string, x double, y double, w double, h double"
    df = spark.createDataFrame([(1, "big", 0.0, 0.0, 500.0, 500.0), (1, "in", 10.0, 10.0, 300.0, 300.0), (1, "edge", 500.0, 0.0, 50.0, 50.0), (1, "flat", 5.0, 5.0, 0.0, 9.0), (2, "big2", 0.0, 0.0, 10.0, 10.0), (1, "same", 10.0, 10.0, 300.0, 300.0)], schema)
    assert rows(B.containment(df, ["page"], "id")) == [(1, "big", "in"), (1, "big", "same"), (1, "in", "same"), (1, "same", "in")]
    fills = spark.createDataFrame([(1, 1, "f1", 0.0, 0.0, 10.0, 10.0), (1, 2, "f2", 0.0, 0.0, 10.0, 10.0), (1, 3, "f3", 900.0, 900.0, 5.0, 5.0)], "page int, ord int, id string, x double, y double, w double, h double")
    shapes = spark.createDataFrame([(1, 1, "s1", 0.0, 0.0, 10.0, 10.0), (1, 2, "s2", 20.0, 0.0, 10.0, 10.0)], fills.schema)
    assert rows(B.pair_greedily(fills, shapes, "page")) == [(1, "f1", "s1"), (1, "f2", "s2"), (1, "f3", None)]


def test_chains(spark):
    nodes = spark.createDataFrame([(1, None, "red"), (2, 1, None), (3, 2, ""), (4, 3, None), (5, 6, None), (6, 5, None), (7, 99, None)], "id int, up int, style string")
    got = {r[0]: (r[1], r[2]) for r in rows(B.resolve_chain(nodes, "id", "up", ["style"]))}
    assert got[2] == ("red", 1) and got[4] == ("", 3) and got[5] == (None, 16) and got[7] == (None, 0)


def test_long_chains_and_cycles(spark):
    n = 150
    data = [(i, i - 1 if i else None, "top" if i == 0 else None) for i in range(n)]
    data += [(1000 + i, 1000 + (i + 1) % 40, "round" if i == 39 else None) for i in range(40)] + [(2000, 1000, None), (3000, 3000, None)]
    nodes = spark.createDataFrame(data, "id int, up int, style string")
    want = [(i, "top", i) for i in range(n)] + [(1000 + i, "round", 16) for i in range(40)] + [(2000, "round", 16), (3000, None, 16)]
    assert rows(B.resolve_chain(nodes, "id", "up", ["style"])) == sorted(want, key=repr)


def test_sequences(spark, deck):
    numbered = Q.renumber(deck, ["deck_id"], [F.col("row_seq")], F.col("row_seq") == 2)
    assert [r.number for r in numbered.orderBy("row_seq").collect()][:3] == [1, None, 2]
    df = spark.createDataFrame([("g", "a", 1), ("g", "a", 2), ("g", "a-2", 3), ("g", "a", 4)], "g string, b string, n int")
    assert [r.key for r in Q.unique_keys(df, ["g"], "b", [F.col("n")]).orderBy("n").collect()] == ["a", "a--2", "a-2", "a-3"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'x "y", z\nw', "t", None, "", "m", "[]", "n")], "id string, page_no int, title string, type_tag string, subtype_tag string, customer_tag string, media_tag string, free_tags string, notes string")
    S.write_csv(df, str(tmp_path / "c"))
    back = S.read_csv(spark, str(tmp_path / "c")).first()
    assert back.title == 'x "y", z\nw' and back.subtype_tag == "" and back.customer_tag == "" and back.page_no == "1"


def test_markdown(spark):
    text = "# x\n## 1. First  \n- **页** p3 – 9\n- **note** a：kept\n## 2. Second\n- **slides** slide-001, slide-014\n- other"
    lines = S.lines_of(spark.createDataFrame([("p", text)], "path string, text string"), "path", "text")
    assert rows(S.stories_from_markdown(lines)) == [("p", 1, "First", 3, 9, None, "kept"), ("p", 2, "Second", None, None, ["slide-001", "slide-014"], None)]
    side = "## slide-01 (cover) — x\ntitle: A\\nB\n  more\nsub.0: c: d\n## slide-02 (y)\ntitle:\n"
    lines = S.lines_of(spark.createDataFrame([("p", side)], "path string, text string"), "path", "text")
    assert rows(S.texts_from_markdown(lines)) == [("p", "slide-01", "sub.0", "c: d"), ("p", "slide-01", "title", "A\nB\nmore"), ("p", "slide-02", "title", "")]


def test_other_sources(spark):
    tsv = "#TOTAL 2\n#SLIDE\t1\tfalse\nITEM\t1\ttext\t0\t0\t5\t5\t0\t1\t1\tfalse\taGk=\tA\t12\t\tleft\t\t\t\n#SLIDE\t2\ttrue\nITEM\t2\ttext"
    lines = S.lines_of(spark.createDataFrame([("p", tsv)], "path string, text string"), "path", "text")
    assert [(r.slide_no, r.master, r.kind, r.text, r.size) for r in S.elements_from_tsv(lines).collect()] == [(1, False, "text", "hi", 12.0)]
    log = [json.dumps({"type": "user", "message": {"content": " hi "}, "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "sessionId": "s"}), json.dumps({"type": "user", "message": {"content": "<tool>"}}), "bad", json.dumps({"type": "assistant", "message": {"content": "x"}})]
    got = S.prompts_from_transcripts(spark.createDataFrame([(x,) for x in log], "value string")).collect()
    assert [(r.session, r.prompt) for r in got] == [("s", "hi")]
    assert S.frames_of('<section class="slide" data-slide-key="a"><section>x</section></section><section class="slide" hidden>y</section><section class="slide">z', "section", r"\bslide\b") == [(0, "a", False, "<section>x</section>"), (1, "", True, "y")]
    front = spark.createDataFrame([("p", "---\nname: n\nkind: [a, b]\n---\nbody"), ("q", "no")], "path string, text string")
    assert [(r.name, r.kind) for r in S.registry(front, "path", "text").collect()] == [("n", ["a", "b"])]


def test_stream_ingest_is_the_batch(spark, tmp_path):
    schema = S.SLIDES
    def frame(data):
        return spark.createDataFrame([{f.name: None for f in schema} | d for d in data], schema)
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    frame([{"row_seq": 1, "id": "a", "title": "A", "type_tag": "mine"}]).coalesce(1).write.parquet(source)
    T.ingest(spark, source, schema, table, str(tmp_path / "c")).awaitTermination()
    frame([{"row_seq": 2, "id": "a", "title": "A2", "type_tag": "auto"}, {"row_seq": 3, "id": "b", "title": "B"}]).coalesce(1).write.mode("append").parquet(source)
    T.ingest(spark, source, schema, table, str(tmp_path / "c")).awaitTermination()
    held = T.Versions(spark, table)
    assert rows(held.read().select("id", "title", "type_tag")) == [("a", "A2", "mine"), ("b", "B", None)]
    assert not held.write(held.read().limit(0), check=lambda df: df.count() > 0) and held.read().count() == 2
    held.roll_back()
    assert held.read().count() == 1


def test_stream_fold_and_postings(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, "queued"), (1, 2, "done"), (2, 1, "running")], "task int, at int, status string")
    e.write.parquet(str(tmp_path / "e"))
    q = T.latest_status(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "task", "at", "status").writeStream.outputMode("complete").format("memory").queryName("fold").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("fold")) == rows(T.latest_status(e, "task", "at", "status"))
    a = spark.createDataFrame([("x", "red plan"), ("y", "blue plan")], "id string, title string")
    b = spark.createDataFrame([("x", "green plan")], a.schema)
    index = T.refresh_postings(C.postings(a, "id", ["title"]), b, a.where("id = 'y'"), "id", ["title"])
    assert rows(index) == rows(C.postings(b, "id", ["title"]))
