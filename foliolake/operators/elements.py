"""Walks over trees of drawn elements that arrive decoded, one JSON object for each archive.

Archives are rows (id, kind, body): body is the archive's object as JSON, and other archives are named in it by id. All walks go over the
triples of `shred`, so that no tree is built, and references between archives are joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_to, short_hash
from .lookups import reachable
from .shred import shred


def _fields(archives: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path, name, value): every scalar of every archive with the names on its path (positions left out) joined by '/'."""
    t = shred(archives, key, body).where("value IS NOT NULL")
    return t.select(key, "path", F.regexp_replace("path", r"(?:^|/)\d+(?=/|$)", "").alias("name"), "value", "ordinal")


def data_references(archives: DataFrame, roles: Mapping[str, str], key: str = "id", body: str = "body") -> DataFrame:
    """(key, data_id, role): the data that an archive refers to, wherever it sits in its body, each pair once.

    roles maps the end of a path of names, such as 'poster/data/identifier', to a role; of several that fit the longest counts. An
    identifier that is no whole number is left out; null and unreadable bodies refer to nothing.
    """
    f = _fields(archives, key, body)
    role = F.lit(None).cast("string")
    for end, name in sorted(roles.items(), key=lambda kv: len(kv[0])):
        role = F.when((F.col("name") == end) | F.col("name").endswith("/" + end), name).otherwise(role)
    found = f.select(key, F.col("value").try_cast("bigint").alias("data_id"), role.alias("role"))
    return found.where("role IS NOT NULL AND data_id IS NOT NULL").distinct()


def storage_texts(archives: DataFrame, storages: DataFrame, field: str = "storage/identifier", key: str = "id", body: str = "body", text: str = "text") -> DataFrame:
    """(key, text): the text that an archive's storage holds: the lines (an array `text`) of the storage (id, text) that it names, joined by
    line breaks. Archives without a storage, or whose storage isn't there, have no row; of several storages the first in the body counts."""
    f = _fields(archives, key, body).where((F.col("name") == field) | F.col("name").endswith("/" + field))
    named = f.groupBy(key).agg(F.min_by("value", "ordinal").alias("_s"))
    held = storages.select(F.col("id").cast("string").alias("_s"), F.array_join(text, "\n").alias("text"))
    return named.join(held, "_s").select(key, "text")


def element_records(archives: DataFrame, roots: DataFrame, kinds: Mapping[str, str], texts: DataFrame, assets: DataFrame, placeholders: Sequence[str] = (), step: int = 4) -> DataFrame:
    """(slide, id, kind, x, y, w, h, text_hash, asset) of the elements below each slide's roots (slide, id), through groups of any depth.

    archives is (id, kind, body) with the members geometry/x, y, w, h, and children for groups; `kinds` maps kinds of archive to kinds of element,
    others have no record. Boxes are rounded to `step`; the hash is that of the element's text (texts: id, text), null without one; placeholder
    texts leave the element out. assets is (id, data_id, role) as `data_references` gives it: the least data is the element's.
    """
    f = _fields(archives, "id", "body")
    links = f.where("name = 'children' OR endswith(name, '/children') OR name = 'children/identifier'").select(F.col("id").cast("string").alias("parent"), F.col("value").alias("child"))
    tops = roots.select("slide", F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    below = reachable(links, tops.select("id")).withColumnRenamed("start", "id")
    every = tops.unionByName(tops.join(below, "id").select("slide", F.col("node").alias("id"))).distinct()
    boxes = f.groupBy(F.col("id").cast("string").alias("id")).agg(*[F.max(F.when(F.col("name") == f"geometry/{c}", F.col("value").try_cast("double"))).alias(c) for c in "xywh"])
    names = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])
    known = archives.select(F.col("id").cast("string").alias("id"), names[F.col("kind")].alias("kind")).where("kind IS NOT NULL")
    text = texts.select(F.col("id").cast("string").alias("id"), F.trim("text").alias("_t"))
    asset = assets.groupBy(F.col("id").cast("string").alias("id")).agg(F.min("data_id").alias("asset"))
    out = every.join(known, "id").join(boxes, "id", "left").join(text, "id", "left").join(asset, "id", "left")
    kept: Column = ~F.coalesce(F.col("_t").isin(*placeholders), F.lit(False)) if placeholders else F.lit(True)
    return out.where(kept).select("slide", "id", "kind", *[round_to(c, step).alias(c) for c in "xywh"], F.when(F.col("_t") != "", short_hash("_t")).alias("text_hash"), "asset")
