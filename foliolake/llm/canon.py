"""Freely typed values to the entries of a reference list, by a prefix-filtered set-similarity join.

A value is a set of numbered letters and letter pairs, so typing slips, moved words and stray signs cost
a few members only. Members are ordered by global rarity; only rare prefixes are joined; what survives the
length and position filters is verified exactly, and the best entry is kept.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import cut, ship, spread
from .looks import form
from .setjoin import prefix_join, rare_first

#: Least Jaccard similarity of a match; four signs with two swapped have just 0.4.
LEAST = 0.4
#: Share of the members of an entry's own part (what it doesn't share with other entries of its axis)
#: that a match must contain: a word of an alphabet survives a slip or two, of two signs one may differ.
OWN_WORD, OWN_SIGNS = 0.74, 0.3
#: Bound of the reference list, one row for each name; a longer list is refused, as it comes to the driver and to every task.
MOST_NAMES = 100_000
#: Or: a word whose edit distance to it is at most this share of its length.
OWN_EDITS = 0.4

_PARTS = re.compile(r"[()\[\]{}〔〕【】<>《》/|:=\n\t]+")


def compact(text: str) -> str:
    """Letters and digits of the one form, lower case."""
    return "".join(c for c in form(text).casefold() if c.isalnum())


def members(axis: str, kind: str, view: str) -> list[str]:
    """Numbered letters and pairs of neighbours; axis and kind are part of each, so only views of one axis and kind meet."""
    seen: Counter = Counter()
    out = []
    for g in [*view, *(a + b for a, b in zip(view, view[1:], strict=False))]:
        seen[g] += 1
        out.append(f"{axis}\x1f{kind}\x1f{g}\x1f{seen[g]}")
    return sorted(out)


def shared_parts(names: list[str]) -> list[str]:
    """Words, and for scripts without blanks endings of two signs or more, that several entries share; longest first."""
    words = Counter(w for n in names for w in set(re.findall(r"[^\W_]+", form(n).casefold())))
    ends = Counter(n[-k:] for n in map(compact, names) if not n.isascii() for k in range(2, len(n)))
    return sorted({w for w, n in words.items() if n > 1} | {e for e, n in ends.items() if n > 1}, key=lambda w: (-len(w), w))


def own_part(text: str, shared: list[str]) -> str:
    """A name without the words and endings that several entries share; empty if nothing else is left."""
    kept = "".join(w for w in re.findall(r"[^\W_]+", form(text).casefold()) if w not in shared)
    if not kept.isascii():
        kept = next((kept[: -len(e)] for e in shared if kept.endswith(e) and not e.isascii()), kept)
    return kept


def views(text: str, shared: list[str]) -> list[tuple[str, str, str]]:
    """(kind, view, rest) of what a value is compared as: all of it and each part between brackets, slashes and colons, whole and without what entries share; rest is the part without that."""
    whole = form(text)
    found = []
    for p in (whole, *_PARTS.split(whole)):
        rest = own_part(p, shared)
        found += [("whole", compact(p), rest), ("own", rest, rest)]
    return [v for v in dict.fromkeys(found) if v[1]]


def map_values(rows: DataFrame, entries: DataFrame, key: str, axis: str, value: str) -> DataFrame:
    """(key, axis, entry): the entry of its axis meant by each filled value that is no canonical value letter for letter; 0 if none is.

    `entries` is the reference list (entry, axis, name, canonical), one row for each name of an entry,
    canonical true for the value that needs no mapping. It is a list kept by hand, of at most MOST_NAMES names, and is
    the only thing that comes to the driver. Null and blank values and a null key or axis have no row; repeated rows count once; of
    entries that are equally similar the smallest counts. Values are mapped once each, however many rows
    hold them; rows get theirs by a join that spreads hot values.
    """
    spark = rows.sparkSession
    ship(spark)
    long = rows.select(F.col(key).alias("key"), F.col(axis).alias("axis"), F.col(value).alias("value")).where("key IS NOT NULL AND axis IS NOT NULL")
    long = long.where(F.col("value").rlike(r"(?U)[^\s\p{Z}\p{Cc}]")).distinct()
    names = entries.where("name IS NOT NULL AND axis IS NOT NULL").take(MOST_NAMES + 1)
    if len(names) > MOST_NAMES:
        raise ValueError(f"the reference list has more than {MOST_NAMES} names")
    exact = spark.createDataFrame([(r.axis, r.name) for r in names if r.canonical], "axis string, value string")
    long = long.join(exact, ["axis", "value"], "left_anti").withColumn("typed", F.concat_ws("\x1f", "axis", "value"))
    values = cut(long.groupBy("typed", "axis", "value").agg(F.count(F.lit(1)).alias("held")))

    shared = {a: shared_parts([r.name for r in names if r.axis == a]) for a in {r.axis for r in names}}
    listed = set()
    for r in names:
        own = own_part(r.name, shared[r.axis]) or compact(r.name)
        for kind, view in (("whole", compact(r.name)), ("own", own)):
            if view:
                least = 0.0 if own == compact(r.name) else OWN_WORD if own.isascii() else OWN_SIGNS
                listed.add((r.entry, r.axis, kind, view, own, tuple(members(r.axis, kind, view)), tuple(members("", "", own)), least))
    refs = spark.createDataFrame([(*x[:5], list(x[5]), list(x[6]), x[7]) for x in sorted(listed)], "entry bigint, axis string, kind string, view string, word string, members array<string>, own array<string>, least double")

    @F.pandas_udf("array<struct<kind:string,view:string,members:array<string>,rest:string,rests:array<string>>>")
    def viewed(axes: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[(k, v, members(a, k, v), rest, members("", "", rest)) for k, v, rest in views(t, shared.get(a, []))] for a, t in zip(axes, texts, strict=True)], dtype=object)

    seen = cut(spread(values).select("typed", "axis", F.explode(viewed("axis", "value")).alias("v")).select("typed", F.concat_ws("\x1f", F.lit("v"), "axis", "v.kind", "v.view", "v.rest").alias("set_id"), F.col("v.members").alias("members"), F.col("v.rest").alias("rest"), F.col("v.rests").alias("rests")))
    asked = seen.groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("members", "rest", "rests")])
    given = refs.withColumn("set_id", F.concat_ws("\x1f", F.lit("r"), F.col("entry").cast("string"), "axis", "kind", "view"))
    sets = asked.select("set_id", "members").unionByName(given.select("set_id", "members")).withColumn("n", F.size("members"))
    ranked = cut(rare_first(sets).join(sets.select("set_id", "members"), "set_id"))
    near = prefix_join(ranked.where(F.col("set_id").startswith("v\x1f")), ranked.where(F.col("set_id").startswith("r\x1f")), LEAST)
    near = near.join(given.select(F.col("set_id").alias("pivot"), "entry", "word", "own", "least"), "pivot").join(asked.drop("members"), "set_id")
    held = F.size(F.array_intersect("rests", "own")) >= F.size("own") * F.col("least")
    slips = (F.col("least") == OWN_WORD) & (F.levenshtein("rest", "word") <= F.length("word") * OWN_EDITS)
    near = near.where(held | slips).select("set_id", "entry", "sim")
    best = seen.select("typed", "set_id").join(near, "set_id").groupBy("typed").agg(F.max_by("entry", F.struct(F.round("sim", 9), -F.col("entry"))).alias("entry"))
    mapped = values.join(best, "typed", "left").select("typed", "held", F.coalesce("entry", F.lit(0)).alias("entry"))
    total = float(values.agg(F.sum("held")).collect()[0][0] or 1)
    return lookup(long, mapped, "typed", "held", total).select(F.col("key").alias(key), F.col("axis").alias(axis), "entry")
