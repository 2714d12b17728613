"""Template residue, filler and failing-page messages among ordinary texts.

Messages are mined with a prefix tree of fixed depth: masked texts that agree in length and in their first
tokens share a leaf, and a leaf's message template keeps the tokens that its texts share. Each template gets one
verdict, by the votes of its messages, and the verdict goes to every text of it: one message that reads like a notice
doesn't condemn a template, and a message that no pattern knows is found among its like. Slots that were left open are detected inside
ordinary texts, and filler by words that occur almost only in sentences without function words.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import digest, lookup
from ..session import cut, ship, spread
from .looks import form

#: Depth of the prefix tree below the level of message length, the share of tokens in which a text must agree with its leaf, and the share of a template's messages that must read like residue.
DEPTH, AGREE, VOTES = 4, 0.7, 0.5
#: Fewest words of a sentence that says anything about its words, the weight of the doubt in a word's share of bare sentences, and the mean share from which a passage is filler.
LEAST, DOUBT, FILLER = 4, 0.5, 0.84

#: A name runs to the sign that closes it, however far that is; classes leave out what opens the next slot, so that a search stays linear.
_NAME = r"[^\W\d][\w.\- ]*+"
_DUNDER = r"[^\W\d](?:[^\W_]|[.\- ]|(?<!\w)_(?!_)|(?<=\w)_(?!_(?!\w)))*+"
#: Slots: what a template engine, a format string or an author's prompt leaves open.
SLOTS = re.compile(
    r"\{\{[^{}]*+\}\}|\$\{[^{}]++\}|<%(?:[^<%]|<(?!%(?!>))|%(?!>))*+%>|\{%(?:[^{%]|\{(?!%(?!\}))|%(?!\}))++%\}|<<[^<>]++>>|@\{[^{}]++\}|#\{[^{}]++\}"
    r"|%\([^()]++\)[sdrf]|(?<![\w%])%[sd](?!\w)|(?<!\w)%" + _NAME + r"%(?!\w)|(?<!\w)_{5,}+(?!\w)|(?<!\w)__" + _DUNDER + r"__(?!\w)"
    r"|(?<!\w):" + _NAME + r":(?=\s|$)|\{(?:\d{1,2}|[^\W\d]\w*+)\}"
    r"|[\[【(<〔]\s*(?:请(?:在此)?(?:填写|输入|填入|补充)|此处(?:填入|填写|补充|插入|配图|放)|在这里(?:写|填|输入)|待(?:补充|填写))[^\]】)>〕]*+[\]】)>〕]"
    r"|[\[(<]\s*(?:insert|enter|add|type|put)\b[^\])>]+\bhere\s*[\])>]|[\[(<]\s*your\b[^\])>]+\bgoes here\s*[\])>]"
    r"|[\[(<]\s*(?:todo|tbd|fixme)\b[^\])>]*+[\])>]|<\s*placeholder\s*>|\[\s*placeholder\s*\]|\binsert (?:\w+ ){1,3}here\b|待定\s*x{2,}|x{2,}公司|x{2,}项目|某某公司|xx年xx月",
    re.IGNORECASE,
)
#: What a template must read like to be a notice, a raw value, a prompt or filler text.
KINDS = {
    "script": r"\b(?:javascript|js|scripts?|cookies)\b.*\b(?:enabled?|turn(?:ed)? on|allow(?:ed)?|required|disabled|to (?:view|load|continue|work))\b|\b(?:enable|turn on|allow|needs?|requires?)\b.*\b(?:javascript|js|scripts?|cookies)\b|(?:禁用|关闭)了?\s*(?:javascript|js|脚本)|(?:启用|开启|打开|允许).{0,8}(?:javascript|脚本)|(?:javascript|脚本).{0,6}(?:被禁用|未启用|已禁用)",
    "error": r"\bpage not found\b|\b(?:does not exist|doesn't exist|no longer exists|cannot be found)\b$|\b(?:bad gateway|service unavailable|internal server error|gateway time(?:d )?-?out)\b|^(?:http )?# (?:not found|forbidden|error|unauthorized)$|^traceback\b|\bexception in\b.*(?:line|template)|^(?:key|type|value|name|attribute|index|reference|syntax)error\b|\bfailed to (?:fetch|load)\b|\b(?:could not|couldn't|cannot) be (?:loaded|displayed|rendered)\b|\bsomething went wrong\b|(?:页面|网页|内容|文件)(?:不存在|未找到|已删除)$|^抱歉,.*(?:不存在|出错)|页面走丢了|开小差了|(?:渲染|加载|请求|连接|获取)失败(?:$|[:,。])|(?:服务器|系统)(?:错误|异常|繁忙|出错)|稍后重试$|变量缺失$|网络(?:异常|错误|超时)",
    "access": r"\baccess denied\b|\bpermission denied\b|\bsession (?:has )?expired\b|\b(?:sign|log) in (?:again|to continue)\b|无权(?:访问|查看|限)|没有.{0,10}权限|请(?:先)?登录$|登录(?:已)?(?:过期|失效)|会话(?:已)?过期",
    "loading": r"^loading\b.*(?:wait|\.\.\.)|^loading$|\bplease wait\b|加载中$|正在加载|\bchecking your browser\b|\bjust a moment\b|\bverify (?:that )?you are (?:a )?human\b|请求过于频繁|请完成验证|\btoo many requests\b",
    "value": r"^(?:undefined|null|nan|none|nil|n/a|inf|infinity)(?:[\s·,/|-]+(?:undefined|null|nan|none|nil|n/a))*$|^\[object \w+\]$|^#(?:ref|value|name|div/0|n/a|num|null)$|^#(?:n/a)$",
    "prompt": r"^(?:type|enter|add|insert|put|click|double-?click)\b.*\b(?:here|this box|to (?:add|edit) (?:text|title|subtitle))$|(?:双击|点击|单击|点一下).{0,8}(?:输入|添加|编辑)|(?:输入|添加|编辑)(?:标题|正文|副标题|文字|文本|内容)$|\b(?:sample|dummy|placeholder|example) (?:copy|text|content)\b|\breplace before\b|\bcopy to come\b|^(?:tbd|todo|fixme)\b(?!\s*清单)(?=\s*(?:$|-|:|headline|title|copy|text|补|待|写|填))|示例(?:文字|文本|内容)|请替换|(?:文案|图片|内容)占位$|^占位(?:文字|符)?$|^待补充$",
    "filler": r"^(.{1,6}?)(?:\s*\1){2,}$|^(asdf|qwer\w*|test|xxx+|foo)(?:\s+\2)*$|^x{3,}$|\blorem ipsum\b|\bdolor sit amet\b",
}
_KINDS = {k: re.compile(v) for k, v in KINDS.items()}
#: Words that real English sentences can't do without.
FUNCTION_WORDS = frozenset("a an and or of to in on for with by from at is are was were be been this that these those our your their its his her my we you they it as but not no into than then each every one which who what how when where all after before without so if while because has have had do does did can could will would should may might must".split())

_TAIL = re.compile(r"(?:\s*-\s*v\d+|\s*\(\s*#?\d+\s*\)|\s+#?\d+|[\s!/.。…]+)+$")
_OTHER = re.compile(r"[^\x00-\u024f\u2000-\u206f]+")
_END = re.compile(r"[.!?;]+(?:\s|$)")
_WORD = re.compile(r"[a-zß-öø-ɏ]{2,}")
_TOKEN = re.compile(r"[a-z]+(?:'[a-z]+)?|#|[一-鿿]|[^\w\s]|\w")


def message(text: str) -> str:
    """A text as a message: one form, lower case, without signs around it or a running number after it; numbers masked."""
    return _message(form(text))


def _message(formed: str) -> str:
    s = formed.casefold().strip().lstrip("⚠❌❗! ").strip()
    bare = _TAIL.sub("", s)
    return re.sub(r"\s+", " ", re.sub(r"\d+", "#", bare or s))


def kind_of(template: str) -> str | None:
    """What residue a message template is, or None for ordinary content."""
    return next((k for k, p in _KINDS.items() if p.search(template)), None)


#: A sign or word that every slot has.
_MAY = re.compile(r"[{<%\[【(〔@_:]|x{2}|某|待|insert", re.IGNORECASE)


def _slot(formed: str) -> bool:
    return _MAY.search(formed) is not None and SLOTS.search(formed) is not None


def has_slot(text: str) -> bool:
    return _slot(form(text))


def passages(message: str) -> tuple[list[list[str]], list[str], list[str]]:
    """The Latin passages of a message that can be filler, and the words of its real and of its bare sentences.

    A passage lies between slots and other scripts; its sentences are passages too. A sentence is real if it has a
    function word and bare if not; one of fewer than LEAST words is neither.
    """
    found, real, bare = [], set(), set()
    for run in _OTHER.split(SLOTS.sub("一", message)):
        sentences = [_WORD.findall(x) for x in _END.split(run)]
        found += [[w for s in sentences for w in s], *(sentences if len(sentences) > 1 else [])]
        for s in sentences:
            if len(s) >= LEAST:
                (bare if FUNCTION_WORDS.isdisjoint(s) else real).update(s)
    # a function word is in no bare sentence, so its share is 0, and a passage with too many of them can't reach FILLER
    fit = [x for x in dict.fromkeys(map(tuple, found)) if len(x) >= LEAST and sum(w in FUNCTION_WORDS for w in x) <= (1 - FILLER) * len(x)]
    return [list(x) for x in fit], sorted(real), sorted(bare)


_READ = "struct<leaf:bigint,tokens:array<string>,kind:string,passages:array<array<string>>,real:array<string>,bare:array<string>>"


def templates(messages: DataFrame) -> DataFrame:
    """(id, template, kind) of messages (id, leaf, tokens, kind): each message's template and the kind that at least VOTES of the template's messages have, else null.

    Only leaves where some message has a kind are mined, as no other template can get one; messages that don't agree with their
    leaf are their own template.
    """
    leaves = messages.groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"), F.count("kind").alias("kinds")).where("kinds > 0").select("leaf", "texts")
    total = float(messages.count())
    mined = cut(lookup(messages, leaves, "leaf", "texts", total))
    total = float(mined.count())
    cells = mined.select("leaf", "texts", F.posexplode("tokens").alias("pos", "token"))
    shared = cells.groupBy("leaf", "texts", "pos", "token").agg(F.count(F.lit(1)).alias("n")).where("2 * n >= texts").groupBy("leaf", "texts", "pos").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    constants = shared.groupBy("leaf", F.col("texts").alias("weight")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("fixed"))
    held = lookup(mined, constants, "leaf", "weight", total)
    at = F.transform("tokens", lambda t, i: F.col("fixed")[i])
    agree = F.size(F.filter(F.arrays_zip(F.col("tokens").alias("t"), at.alias("f")), lambda x: x["t"] == x["f"]))
    # the places that the leaf's messages don't share are open
    open_ = F.concat_ws(" ", F.transform(at, lambda f: F.coalesce(f, F.lit("<*>"))))
    own = F.concat_ws(" ", "tokens")
    held = held.withColumn("template", F.when(agree >= F.size("tokens") * AGREE, open_).otherwise(own)).select("id", "kind", "template", digest("template").alias("key"))
    votes = held.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))
    judged = votes.groupBy("key").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("verdict"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("found"), F.sum("n").alias("texts"))
    judged = judged.select("key", "texts", F.when(F.col("found") >= F.col("texts") * VOTES, F.col("verdict")).alias("verdict"))
    return lookup(held.drop("kind"), judged, "key", "texts", total).select("id", "template", F.col("verdict").alias("kind"))


def residue(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, verdict) of the rows whose text is, or contains, residue; verdict is 'slot', 'filler' or a kind of KINDS.

    Null and blank texts have no verdict; repeated rows give repeated rows. Rows are read once, every distinct message is
    judged once, and rows get its verdict by a join that spreads hot messages. Templates and word counts
    are mined over all texts.
    """
    ship(df.sparkSession)

    @F.pandas_udf("struct<message:string,slot:boolean>")
    def look(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[str, bool]] = {}
        rows = []
        for t in texts:
            seen = known.get(t)
            if seen is None:
                formed = form(t)
                seen = known[t] = _message(formed), _slot(formed)
            rows.append(seen)
        return pd.DataFrame(rows, columns=["message", "slot"])

    @F.pandas_udf(_READ)
    def read(messages: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for m in messages:
            tokens = _TOKEN.findall(m)
            leaf = xxhash.xxh64_intdigest("\x1f".join([str(len(tokens)), *tokens[:DEPTH]])) - (1 << 63)
            rows.append((leaf, tokens, kind_of(m), *passages(m)))
        return pd.DataFrame(rows, columns=["leaf", "tokens", "kind", "passages", "real", "bare"])

    filled = df.select(F.struct(*keys).alias("row"), F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)[^\s\p{Z}\p{Cc}]"))
    rows = cut(spread(filled).withColumn("s", look("text")).select("row", "s.*").withColumn("id", digest("message")))
    held = rows.groupBy("id", "message").agg(F.count(F.lit(1)).alias("held"))
    messages = cut(spread(held).withColumn("r", read("message")).select("id", "held", "r.*"))
    notices = templates(messages.select("id", "leaf", "tokens", "kind")).where("kind IS NOT NULL").select("id", "kind")

    # filler: passages of words that are seldom in a real sentence; one such sentence only lowers a word's share
    seen = messages.select(F.explode(F.concat(F.transform("real", lambda w: F.struct(w.alias("word"), F.lit(0).alias("bare"))), F.transform("bare", lambda w: F.struct(w.alias("word"), F.lit(1).alias("bare"))))).alias("w")).select("w.*")
    words = seen.groupBy("word").agg(F.sum("bare").alias("in_bare"), F.count(F.lit(1)).alias("n"))
    odd = words.where("in_bare > 0").select("word", (F.col("in_bare") / (F.col("n") + DOUBT)).alias("share"))
    each = messages.select("id", F.posexplode("passages").alias("at", "words")).select("id", "at", F.size("words").alias("n"), F.explode("words").alias("word"))
    filler = each.join(odd, "word").groupBy("id", "at", "n").agg(F.sum("share").alias("sum")).where(F.col("sum") >= FILLER * F.col("n")).select("id", F.lit("filler").alias("kind"))

    kinds = cut(notices.unionByName(filler).groupBy("id").agg(F.min("kind").alias("verdict")).join(messages.select("id", "held"), "id"))
    total = float(rows.count())
    found = lookup(rows.drop("message"), kinds, "id", "held", total).select("row", F.col("verdict").alias("_verdict"))
    slots = rows.where("slot").join(kinds.select("id"), "id", "left_anti").select("row", F.lit("slot").alias("_verdict"))
    return found.unionByName(slots).select(*[F.col("row").getField(k).alias(k) for k in keys], F.col("_verdict").alias("verdict"))
