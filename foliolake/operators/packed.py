"""Several values packed in one field: the dialect of each field by minimum description length.

Every field is parsed by every dialect that its signs allow. How often a value comes out over all
parses of all fields gives its code length; a parse costs the code lengths of its values, and each
field takes its cheapest dialect.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, spread
from .skew import digest, lookup

#: Signs that part values, in order of preference, and the pairs that quote one.
DELIMITERS = (",", ";", "|", "\t", "\n", "，", "、", "；", "/")
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』"}
BRACKETS = {"[": "]", "(": ")", "{": "}", "【": "】", "（": "）"}
_SIGNS = set("".join(DELIMITERS)) | set(QUOTES) | set(QUOTES.values()) | set(BRACKETS) | set(BRACKETS.values()) | {"#", "\\"}
_JSON = re.compile(r'\s*\[?\s*(?:,\s*)*("(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)(?:,\s*)*\]?\s*')
_JSON_ITEM = re.compile(r'"(?:[^"\\]|\\.)*"')

#: Bits of a value that was never seen: per ASCII letter, other letter, and packing sign. A sign
#: inside a value must cost more than a further value does, else nothing would ever be split.
_ASCII_BITS, _LETTER_BITS, _SIGN_BITS = 5.0, 11.0, 48.0


def _clean(value: str) -> str:
    value = value.strip().strip("​﻿")
    return value.strip()


def _split(body: str, delimiters: frozenset[str], quoted: bool) -> list[str]:
    """Items between delimiters; with `quoted`, a quote at the start of an item holds to its closing
    sign, where a doubled or escaped closing sign is part of the item."""
    items, at, n = [], 0, len(body)
    while at <= n:
        while at < n and body[at].isspace() and body[at] not in delimiters:
            at += 1
        close = QUOTES.get(body[at]) if quoted and at < n else None
        if close:
            i, held = at + 1, []
            while i < n:
                if body[i] == "\\" and i + 1 < n and body[i + 1] in (close, "\\"):
                    held.append(body[i + 1])
                    i += 2
                elif body[i] == close:
                    if body[i + 1 : i + 2] == close and close == '"':
                        held.append(close)
                        i += 2
                    else:
                        break
                else:
                    held.append(body[i])
                    i += 1
            j = i + 1
            while j < n and body[j].isspace() and body[j] not in delimiters:
                j += 1
            if i < n and (j >= n or body[j] in delimiters):
                items.append("".join(held))
                at = j + 1
                continue
        j = at
        while j < n and body[j] not in delimiters:
            j += 1
        items.append(body[at:j])
        at = j + 1
    return items


def parses(field: str) -> list[list[str]]:
    """The distinct parses of a field, by dialects in order of preference; none for a blank field."""
    out: list[list[str]] = []

    def add(items: list[str]) -> None:
        items = [c for c in map(_clean, items) if c]
        if items not in out:
            out.append(items)

    text = field.strip()
    if not text:
        return out
    if text[0] in "[\"" or text[-1] == "]":
        try:
            held = json.loads(text)
            if isinstance(held, list) and all(isinstance(x, (str, int, float)) or x is None for x in held):
                add([x if isinstance(x, str) else "" if x is None else json.dumps(x) for x in held])
        except ValueError:
            pass
        if (m := _JSON.fullmatch(text)) and '""' not in m[1].replace('\\"', ""):
            try:
                add([json.loads(x) for x in _JSON_ITEM.findall(m[1])])
            except ValueError:
                pass
    body = text
    if body[0] in BRACKETS and (body[-1] == BRACKETS[body[0]] or body[-1] not in BRACKETS.values()):
        body = body[1:-1] if body[-1] == BRACKETS[body[0]] else body[1:]
    elif body[-1] in BRACKETS.values() and not any(o in body for o, c in BRACKETS.items() if c == body[-1]):
        body = body[:-1]
    used = [d for d in DELIMITERS if d in body]
    sets = [frozenset([d]) for d in used]
    if len(used) > 1:
        sets += [frozenset(used), frozenset(used) - {"/"}]
    if any(q in body for q in QUOTES):
        for s in sets or [frozenset()]:
            add(_split(body, s, True))
    for s in sets:
        add(_split(body, s, False))
    if " / " in body or body.endswith(" /") or body.startswith("/ "):
        add(re.split(r"(?:^|\s)/(?:\s|$)", body))
    if "#" in body:
        add(re.split(r"[#＃]", body))
        for s in sets:
            add([x.strip().strip("#＃") for x in _split(body, s, True)])
    add(_split(body, frozenset(), True))
    add([text])
    return out


def spelled_bits(value: str) -> float:
    bits = _ASCII_BITS
    for c in value:
        bits += _SIGN_BITS if c in _SIGNS else _ASCII_BITS if c < "\x80" else _LETTER_BITS if unicodedata.category(c)[0] in "LN" else 2 * _LETTER_BITS
    return bits


_PARSES = "array<struct<d:int,items:array<struct<item:string,spelled:double>>>>"


def unpack(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, pos, value): one row per value of each field, pos from 1 over the non-empty values.

    Repeated rows of (key, field) count once. A null or blank field, `[]` and a field of signs only
    have no rows. Repeated values stay. A field that no dialect explains comes out as one value.

    Values are counted over the distinct fields with equal weight for each of a field's parses. Code
    lengths are joined to the values with hot values broadcast (a bounded number) and the rest
    shuffled, likewise the chosen parses to the rows, so a value or field held by a third of all rows
    is spread.
    """
    spark = df.sparkSession
    ship(spark)

    @F.pandas_udf(_PARSES)
    def candidates(fields: pd.Series) -> pd.Series:
        return pd.Series([[(d, [(i, spelled_bits(i)) for i in items]) for d, items in enumerate(parses(f))] for f in fields], dtype=object)

    # fields go by digests of a fixed size, their texts are kept once; values by numbers, and values that share one would share their count, which is all a value is for
    rows = df.select(F.col(key).alias("key"), F.col(field).alias("field")).where("field IS NOT NULL").distinct().withColumn("id", digest("field"))
    fields = rows.groupBy("id", "field").agg(F.count(F.lit(1)).alias("held"))
    parsed = cut(spread(fields).withColumn("parses", candidates("field")).drop("field").where("size(parses) > 0"))
    each = parsed.select("id", F.size("parses").alias("n"), F.explode("parses").alias("p")).select("id", "n", F.col("p.d").alias("d"), F.col("p.items").alias("items"))
    values = each.select("id", "n", "d", F.explode("items").alias("v")).select("id", "d", "n", F.xxhash64("v.item").alias("value"), F.col("v.spelled").alias("spelled"))
    counts = values.groupBy("value").agg(F.sum(1 / F.col("n")).alias("seen"), F.count(F.lit(1)).alias("rows"))
    sums = counts.agg(F.sum("seen").alias("seen"), F.sum("rows").alias("rows")).collect()[0]
    total = float(sums["seen"] or 1.0)
    # a value found in one parse only may be that field misread, so its own sighting is taken off; what is
    # left of a known value, or else the spelling after an escape, is its code
    again = F.col("seen") - 1
    spelled = F.col("spelled") + F.log2(F.lit(total + 1))
    bits = F.when(again > 0, F.least(F.log2(F.lit(total + 1)) - F.log2(again), spelled)).otherwise(spelled)
    coded = lookup(values, counts, "value", "rows", float(sums["rows"] or 1))
    cost = coded.groupBy("id", "d").agg(F.sum(bits).alias("bits"))
    empty = each.where("size(items) = 0").select("id", "d", F.lit(0.0).alias("bits"))
    # millionths of a bit and the dialect as one number, of which the least is taken
    ranked = F.shiftleft(F.round(F.col("bits") * 1e6).cast("bigint"), 8) + F.col("d")
    best = cost.unionByName(empty).groupBy("id").agg(F.min(ranked).bitwiseAND(F.lit(255)).cast("int").alias("best"))
    chosen = parsed.join(best, "id").select("id", "held", F.expr("filter(parses, p -> p.d = best)[0].items.item").alias("items"))
    n_rows = float(parsed.agg(F.sum("held")).collect()[0][0] or 1)
    out = lookup(rows.select("key", "id"), chosen, "id", "held", n_rows)
    out = out.select(F.col("key").alias(key), F.posexplode("items").alias("p", "value"))
    return out.select(key, (F.col("p") + 1).cast("int").alias("pos"), "value")
