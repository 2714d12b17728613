"""The training-text operators against brute force, round trips and held-out cases."""

import random
import re
import time
import unicodedata
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliolake.llm import bpe, canon, leakage, looks, reading, residue, setjoin
from tests.conftest import rows

VOCABULARY = Path(bpe.TOKENIZERS) / bpe.BYTE_BPE

# 1


@pytest.fixture(scope="module")
def entries(spark):
    data = [(1, "who", "Brennovar Dairy", False), (1, "who", "堇禾乳业", True), (2, "who", "Wexapoli Dairy", False), (2, "who", "柚田乳业", True), (3, "what", "Feature Demo", False), (3, "what", "功能演示", True)]
    return spark.createDataFrame(data, "entry bigint, axis string, name string, canonical boolean")


def test_map_values(spark, entries):
    typed = {"Brenovar Dairy": 1, "dairy, brennovar": 1, "ＢＲＥＮＮＯＶＡＲ　ＤＡＩＲＹ": 1, "堇禾": 1, "堇禾集团": 1, "槿禾乳业": 1, "Wexapoli": 2, "Grizmount Dairy": 0, "穹顶乳业": 0, "Dairy": 0, "乳业": 0, "??": 0, "堇禾乳业（Brennovar Dairy）": 1, "x" * 5000: 0}
    data = [(f"s{i}", "who", v, 7) for i, v in enumerate(typed)] + [("t", "what", "功演能示", 7), ("u", "what", "功能演示", 7), ("v", "what", "堇禾乳业", 7), ("w", "who", None, 7), ("w", "who", " 　", 7), (None, "who", "Wexapoli", 7), ("s0", "who", "Brenovar Dairy", 8)]
    df = spark.createDataFrame(data, "id string, axis string, value string, entry int")
    want = sorted([(f"s{i}", "who", e) for i, e in enumerate(typed.values())] + [("t", "what", 3), ("v", "what", 0)], key=repr)
    assert rows(canon.map_values(df, entries, "id", "axis", "value")) == want
    assert rows(canon.map_values(df.limit(0), entries, "id", "axis", "value")) == []


# 3


@pytest.mark.parametrize("text", ["${owner} plan", "[请填写customer]", "{{ title }}", "Hello %s, welcome to %s", "复盘 [TODO: 数据来源]", "<<title>> plan", "共 {count} 页", "%(year)s", "__owner__ plan", "(your title goes here)", "@{日期}"])
def test_slots(text):
    assert residue.has_slot(text)


LONG = ["{{" + "a.b|" * 50 + "}}", "${" + "x+" * 100 + "}", "<%= " + "row % 2 < n " * 20 + "%>", "{% if " + "a > b and " * 25 + "%}", "<<" + "name " * 40 + ">>", "@{" + "日期" * 100 + "}", "#{" + "v" * 200 + "}", "%(" + "k" * 200 + ")s", "%" + "name." * 40 + "x%", "__" + "owner_" * 40 + "name__", ":" + "name-" * 40 + "x:", "{" + "n" * 200 + "}", "[请填写" + "客户名称" * 50 + "]", "[insert " + "client name " * 20 + "here]", "(your " + "long title " * 20 + "goes here)", "[TODO: " + "data source " * 20 + "]"]


@pytest.mark.parametrize("slot", LONG)
def test_long_slots(slot):
    assert len(slot) >= 200 and residue.has_slot(f"复盘 {slot} plan")
    assert not residue.has_slot(f"复盘 {slot[:-2]}")


@pytest.mark.parametrize("part", ["{{a ", "<% a ", "{% a ", "<<a ", "__a ", " %a", ":a ", "%(a "])
def test_open_slots_take_linear_time(part):
    began = time.process_time()
    assert not residue.SLOTS.search(part * 40000)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("text", ["集合 {A, B} 的分组打法", "增长 50% 与 60% 之间", "TODO 清单如何救了复盘", "plan: a", "snake_case_name", "Access for all: plan", "10:30: start"])
def test_no_slots(text):
    assert not residue.has_slot(text)


@pytest.mark.parametrize(("text", "kind"), [("⚠ 抱歉，您访问的页面不存在（404） #3", "error"), ("PLEASE TURN ON JAVASCRIPT TO VIEW THIS SLIDE.", "script"), ("null - v2", "value"), ("Session expired - please log in again!", "access"), ("标题标题标题标题", "filler"), ("内容加载中...", "loading"), ("双击本框即可输入正文", "prompt"), ("JavaScript 小组的协作节奏", None), ("复盘页面不存在断点", None), ("How we cut 404 errors by 30%", None), ("权限被拒绝之后：复盘", None)])
def test_message_kinds(text, kind):
    assert residue.kind_of(residue.message(text)) == kind


def test_residue(spark):
    filler = ["velum", "torquis", "ovexi", "parlum", "sintor"]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(filler, k=8)) + "." for _ in range(6)] + ["The plan of the store is good and clear.", "Contract archive before and after", "null", "{{x}} plan", None, "", " ", "Contract archive open points", "".join(chr(0x4E00 + i * 7 % 9000) for i in range(40000))]
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)] + [(8, "null", "v")], "id int, text string, verdict string")
    got = rows(residue.residue(df, ["id"], "text"))
    assert got == sorted([(i, "filler") for i in range(6)] + [(8, "value"), (8, "value"), (9, "slot")], key=repr)
    assert rows(residue.residue(df.limit(0), ["id"], "text")) == []


def test_templates_vote(spark):
    # variants that no pattern knows are found among their like; one message that a pattern hits doesn't condemn a genuine template
    notices = [f"the deck viewer reports a problem with {x}: access denied" for x in ("alpha", "beta", "gamma", "delta")] + ["the deck viewer reports a problem with omega: access refused"]
    genuine = [f"the store team writes its own plan about {x}" for x in ("alpha", "beta", "gamma", "delta")] + ["the store team writes its own plan about loading..."]
    assert residue.kind_of(residue.message(notices[4])) is None
    df = spark.createDataFrame(list(enumerate([*notices, *genuine, "access denied"])), "id int, text string")
    assert rows(residue.residue(df, ["id"], "text")) == sorted([*((i, "access") for i in range(5)), (10, "access")], key=repr)


def test_filler_beside_contaminating_rows(spark):
    filler = ["velum", "torquis", "ovexi", "parlum", "sintor", "calpus"]
    rng = random.Random(2)
    texts = [" ".join(rng.choices(filler, k=9)) + "." for _ in range(20)]
    mixed = ["Velum torquis ovexi parlum sintor calpus [TODO: 数据来源]", "季度复盘 velum torquis ovexi parlum sintor calpus 数据", "Nobody read the plan of the store. Velum torquis ovexi parlum sintor calpus."]
    clean = ["velum torquis", "calpus", "The velum torquis parlum ovexi sintor calpus text of this page was replaced", "季度复盘 store rollout key moves", *(f"Store rollout key moves {x}" for x in ("before and after", "at the start", "and what they cost", "wins", "plan"))]
    df = spark.createDataFrame(list(enumerate(texts + mixed + clean)), "id int, text string")
    assert rows(residue.residue(df, ["id"], "text")) == sorted([(i, "filler") for i in range(23)], key=repr)


# 5

ODD = [chr(o) for a, b in looks.unstable_ranges() for o in (a, b)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from([*ODD, *"abcéñ中文 \n\r" * 30, "́", "​"]), max_size=12))
def test_segments_are_the_whole(text):
    assert looks.form(text) == looks.whole_form(text)
    assert looks.form(looks.form(text)) == looks.form(text)


@pytest.mark.parametrize(("a", "b", "same"), [("Café", "Café", True), ("ＱＸ－１", "QX-1", True), ("Рrice", "Price", True), ("a​b", "ab", True), ("a　b", "a b", True), ("⼯单", "工单", True), ("Ⅱ", "II", True), ("Cafe", "Café", False), ("plan", "Plan", False), ("x²", "x2", False), ("①", "1", False), ("a b", "ab", False)])
def test_same_look(a, b, same):
    assert (looks.form(a) == looks.form(b)) is same


def test_same_look_pairs(spark):
    data = [("a", "Café", "x"), ("b", "Café", "x"), ("c", "Café", None), ("d", "cafe", ""), ("e", "​", "​"), ("f", " ", " "), ("g", None, "x​"), ("a", "Café", "x"), (None, "Ｃafé", "x")]
    df = spark.createDataFrame(data, "id string, title string, body string").selectExpr("*", "title AS stored", "body AS form")
    assert rows(looks.same_look_pairs(df, "id", ["title", "body"])) == [("a", "b", "title"), ("a", "g", "body"), ("b", "c", "title"), ("b", "g", "body")]
    assert rows(looks.same_look_pairs(df.limit(0), "id", ["title", "body"])) == []


# 6


@pytest.mark.parametrize(("seed", "pivots", "rounds", "frequent"), [(1, 1024, 1, 0.2), (2, 5, 2, 0.2), (3, 64, 1, 0.0)])
def test_similar_records_is_brute_force(spark, monkeypatch, seed, pivots, rounds, frequent):
    placed = setjoin.placed
    monkeypatch.setattr(setjoin, "placed", lambda sets, threshold, *_: placed(sets, threshold, pivots, rounds, frequent))
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randint(3, 9)) for _ in range(40)]
    sets = {}
    for i in range(160):
        s = set(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            s.symmetric_difference_update({rng.randrange(60)})
        sets[f"r{i:03}"] = s | {999}
    data = [(k, f"m{x}", 1) for k, s in sets.items() for x in s] + [("r000", None, 1), (None, "m1", 1), ("tiny", "m1", 1), ("void", None, 1)]
    rng.shuffle(data)
    df = spark.createDataFrame(data + data[:50], "slide string, n string, set_id int")
    want = sorted((a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 3 and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]))
    classes, links, membership = setjoin.similar_records(df, "slide", "n", 0.6, least=3)
    assert rows(setjoin.expanded(classes, links, membership)) == sorted(want, key=repr)
    assert membership.count() == 160 and classes.count() == len({frozenset(x) for x in sets.values()})
    assert rows(setjoin.expanded(*setjoin.similar_records(df.limit(0), "slide", "n", 0.6, least=3))) == []


# 8


@pytest.fixture(scope="module")
def encoder():
    if not VOCABULARY.exists():
        pytest.skip("no vocabulary here")
    return bpe.encoder(str(VOCABULARY))


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("ab 's\n12，。的是", max_size=60))
def test_ids_are_the_public_ones(encoder, public, text):
    assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_long_and_special_texts(encoder, public):
    for text in ["a" * 20000, " " * 3000, "的" * 5000, "<|endoftext|> x", "ÿ\x00‍👍🏽" * 50, "-" * 999]:
        assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_encode_texts(spark, encoder):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "hello world", "y")], "doc_id bigint, text string, ids string")
    assert rows(bpe.encode_texts(df, "doc_id", "text", str(VOCABULARY))) == sorted([(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [64])], key=repr)
    assert rows(bpe.encode_texts(df.limit(0), "doc_id", "text", str(VOCABULARY))) == []


# 9


def _texts(rng, n, words):
    return " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(n))


def test_find_leaks(spark):
    rng = random.Random(3)
    words = [f"w{i}x" for i in range(300)]
    heading = "Read the passage and answer the question below. "
    items = {i: _texts(rng, 70, words) for i in range(40)}
    docs, want = [], []
    for d in range(60):
        i = d % 40
        body, w = _texts(rng, rng.choice([30, 300, 1500]), words), items[i].split()
        if d % 4 == 0:
            piece = " ".join(w[:20]) + ". " + _texts(rng, 30, words) + " " + " ".join(w[40:58]).upper()
            want.append((d, i))
        elif d % 4 == 1:
            changed = list(w[5:45])
            changed[12] = changed[26] = "other"
            piece = "\r\n".join(changed)
            want.append((d, i))
        elif d % 4 == 2:
            piece = heading + " ".join(w[:8])
        else:
            piece = ""
        docs.append((d, body[:400] + ". " + piece + " ." + body[400:], "x"))
    docs += [(100, None, "x"), (101, "", "x"), (None, items[0], "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item string")
    it = spark.createDataFrame([(i, heading + t if i % 2 else t) for i, t in items.items()] + [(90, None), (91, ""), (92, "short")], "item_id bigint, text string")
    assert rows(leakage.find_leaks(df, "doc_id", "text", it, "item_id", "text")) == sorted(want, key=repr)
    assert rows(leakage.find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "text")) == []
    assert rows(leakage.find_leaks(df.limit(0), "doc_id", "text", it, "item_id", "text")) == []


def test_search_finds_what_exact_containment_finds():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    maker = leakage.Shingler(looks._pattern())
    items = [(i, *maker.shingles(" ".join(rng.choices(words, k=60)))) for i in range(50)]
    index = leakage.Index([(i, s, g, np.zeros(len(s), dtype=bool)) for i, s, g in items])
    missed = 0
    for i, s, _ in items:
        other = maker.shingles(" ".join(rng.choices(words, k=2500)))[0]
        part = np.concatenate([other[:1000], s[10:36], other[1000:]])
        missed += i not in index.search(part)
    assert missed == 0


# 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab'-’ \n.,;A中文é1_?。，üж", max_size=30) | st.text(max_size=15), min_size=1, max_size=4))
def test_occurrences_are_those_of_plain_patterns(texts):
    script, both = reading.occurrences(texts)
    for k, t in enumerate(texts):
        t = t.lower()
        words = Counter(x for w in re.findall(r"[a-z][a-z'’-]*|[㐀-鿿]+", t) for x in ([w[i : i + 2] for i in range(len(w) - 1)] if "㐀" <= w[0] else [w]))
        shapes: Counter = Counter()
        for s in re.split(r"[.!?。！？\n]+", t):
            runs = re.findall(r"(?:[^\W\d_]|[㐀-鿿À-ɏ])+", "".join(c if ord(c) < 0xFFFF and (c.isalpha() or "㐀" <= c <= "鿿" or "À" <= c <= "ɏ") else " " for c in s))
            n = sum(1 if re.search("[a-zA-ZÀ-ɏ]", r) else len(re.findall("[㐀-鿿]", r)) for r in runs)
            if n >= 3:
                shapes[min(n // 3, 40)] += 1
                shapes[64 + min(len(re.findall("[,，;；]", s)), 15)] += 1
        got = [Counter(number[text == k].tolist()) for text, number in both]
        assert got[1] == shapes
        # numbers are hashes: equal counts, and equal words have equal numbers
        assert sorted(got[0].values()) == sorted(words.values())
        assert script[k] == (len(re.findall("[㐀-鿿]", t)) > 0.2 * len(t))


def test_fit_items_finds_slopes():
    rng = np.random.default_rng(1)
    x = reading.LEVELS - reading.MIDDLE
    slopes = np.array([1.2, -0.8, 0.0])
    exposure = np.full(len(x), 20000.0)
    counts = rng.poisson(exposure[None, :] * np.exp(-4 + slopes[:, None] * x[None, :]))
    _, a = reading.fit_items(counts.astype(float), exposure)
    assert np.allclose(a, slopes, atol=0.1)


def test_grades_of_held_out_documents(spark):
    rng = random.Random(4)
    easy, hard = [f"box{c}" for c in "abcdefghij"], [f"epistemology{c}" for c in "abcdefghij"]
    docs, grades = [], []
    for d in range(400):
        g = d % 4 + 1
        n = 4 + 4 * g
        text = " ".join(" ".join(rng.choice(hard if rng.random() < g / 5 else easy) for _ in range(rng.randint(n - 2, n + 2))) + "." for _ in range(12))
        docs.append((d, text, g))
        grades.append((d, g))
    docs += [(900, None, 1), (901, "", 1), (902, "short", 1), (903, "…" * 150, 1), (None, docs[0][1], 1), (0, docs[0][1], 1), (904, docs[3][1] * 40, 4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, grade int")
    marks = spark.createDataFrame([x for x in grades if x[0] % 3], "doc_id bigint, grade int")
    got = dict(rows(reading.grade_documents(df, "doc_id", "text", marks, "grade")))
    assert set(got) == {*range(400), 903, 904} and len(rows(reading.grade_documents(df, "doc_id", "text", marks, "grade"))) == len(got)
    held = [d for d in range(400) if d % 3 == 0]
    assert np.mean([got[d] == d % 4 + 1 for d in held]) > 0.9
    assert got[904] == 4
    assert rows(reading.grade_documents(df.limit(0), "doc_id", "text", marks, "grade")) == []
    assert rows(reading.grade_documents(df, "doc_id", "text", marks.limit(0), "grade")) == []


def test_numbered_members_and_forms():
    assert Counter(canon.members("a", "k", "aba"))["a\x1fk\x1fa\x1f2"] == 1
    assert unicodedata.normalize("NFC", looks.form("é")) == "é"
