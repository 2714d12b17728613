"""Bounding boxes and hierarchies of drawn elements."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Side of a grid cell for box joins, in canvas units.
CELL = 240.0


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in "xywh")


def intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def box_score(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of boxes that overlap; of others minus the squared distance of their centres in millions."""
    both = intersection(a, b)
    union = a[2] * a[3] + b[2] * b[3] - both
    dx, dy = a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2
    return F.when(both > 0, both / union).otherwise(-(dx * dx + dy * dy) / 1e6)


def line_score(a: Sequence[Column], b: Sequence[Column], height: float = 1080.0) -> Column:
    """Horizontal overlap over the narrower width, minus the vertical distance of the centres in canvas heights."""
    wide = F.greatest(F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return wide / F.greatest(F.least(a[2], b[2]), F.lit(1.0)) - F.abs(a[1] + a[3] / 2 - b[1] - b[3] / 2) / height


def best_match(boxes: DataFrame, targets: DataFrame, group: Sequence[str], key: str, target: str, score: str = "box", least: float | None = None) -> DataFrame:
    """(group, key, target, score): for each box the target of its group (a page, say) with the greatest score, ties to the smallest target;
    matches under `least` are dropped. Scores are defined at any distance, so a group's boxes all meet its targets; a group is one page."""
    a = boxes.select(*group, key, *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    b = targets.select(*group, target, *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    s = (box_score if score == "box" else line_score)(box("a_"), box("b_"))
    met = a.join(b, list(group)).withColumn("score", F.round(s, 9))
    first = Window.partitionBy(*group, key).orderBy(F.desc("score"), target)
    best = met.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    out = best.select(*group, key, target, "score")
    return out if least is None else out.where(F.col("score") >= least)


def overlapping(boxes: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """(group, one, two, shared, area_one, area_two) of boxes that overlap within a group, one < two, by a grid join: boxes meet where they
    share a cell, so a crowded group costs its neighbours, not all its pairs. Boxes without an area overlap nothing."""
    def cells(c: str, d: str) -> Column:
        return F.sequence(F.floor(F.col(c) / CELL).cast("int"), F.floor((F.col(c) + F.col(d)) / CELL).cast("int"))

    b = boxes.where("w > 0 AND h > 0").select(*group, key, *"xywh")
    grid = b.withColumn("cx", F.explode(cells("x", "w"))).withColumn("cy", F.explode(cells("y", "h")))
    one = grid.select(*group, "cx", "cy", F.col(key).alias("one"), *[F.col(c).alias(f"a_{c}") for c in "xywh"])
    two = grid.select(*group, "cx", "cy", F.col(key).alias("two"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    met = one.join(two, [*group, "cx", "cy"]).where("one < two")
    # a pair counts in the cell where its intersection starts
    home = (F.col("cx") == F.floor(F.greatest("a_x", "b_x") / CELL)) & (F.col("cy") == F.floor(F.greatest("a_y", "b_y") / CELL))
    met = met.where(home).withColumn("shared", intersection(box("a_"), box("b_"))).where("shared > 0")
    return met.select(*group, "one", "two", "shared", (F.col("a_w") * F.col("a_h")).alias("area_one"), (F.col("b_w") * F.col("b_h")).alias("area_two"))


def containment(boxes: DataFrame, group: Sequence[str], key: str, share: float = 0.7) -> DataFrame:
    """(group, outer, inner): boxes of which at least `share` lies inside another one; of equal boxes both contain each other."""
    o = overlapping(boxes, group, key)
    a = o.where(F.col("shared") >= F.col("area_two") * share - 1e-9).select(*group, F.col("one").alias("outer"), F.col("two").alias("inner"))
    b = o.where(F.col("shared") >= F.col("area_one") * share - 1e-9).select(*group, F.col("two").alias("outer"), F.col("one").alias("inner"))
    return a.unionByName(b)


def close_boxes(a: Sequence[Column], b: Sequence[Column], tolerance: float = 8.0) -> Column:
    """Whether four sides differ by at most the tolerance each."""
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & (F.abs(p - q) <= tolerance)
    return out


def pair_greedily(fills: DataFrame, shapes: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """(group, fill, shape): fills, in order of `ord`, each take the unclaimed shape with the best overlap of at least `least`, else the nearest
    one within max(30, 0.3 of its longer side) of its centre, else none (null). What a fill may take depends on all before it, so a group
    (one page) is worked through in one task; both tables have (group, ord, id, x, y, w, h)."""
    both = fills.withColumn("is_fill", F.lit(True)).unionByName(shapes.withColumn("is_fill", F.lit(False)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, s = (pdf[pdf["is_fill"] == v].sort_values(["ord", "id"]) for v in (True, False))
        x, y, w, h = (s[c].to_numpy(dtype=float) for c in "xywh")
        ids, free, out = s["id"].to_numpy(), np.ones(len(s), dtype=bool), []
        # one fill meets all shapes of its group at once; only the order of fills is a loop
        for group_key, fill, fx, fy, fw, fh in f[[group, "id", *"xywh"]].itertuples(index=False):
            shared = np.maximum(np.minimum(fx + fw, x + w) - np.maximum(fx, x), 0.0) * np.maximum(np.minimum(fy + fh, y + h) - np.maximum(fy, y), 0.0)
            union = fw * fh + w * h - shared
            iou = np.divide(shared, union, out=np.zeros(len(x)), where=shared > 0)
            away = np.hypot(fx + fw / 2 - x - w / 2, fy + fh / 2 - y - h / 2)
            over, near = free & (iou >= least), free & (away <= max(30.0, 0.3 * max(fw, fh)))
            best = np.where(over, iou, -1.0).argmax() if over.any() else np.where(near, away, np.inf).argmin() if near.any() else None
            if best is not None:
                free[best] = False
            out.append((group_key, fill, ids[best] if best is not None else None))
        return pd.DataFrame(out, columns=[group, "fill", "shape"])

    kind = dict(fills.dtypes)
    return both.groupBy(group).applyInPandas(run, f"{group} {kind[group]}, fill {kind['id']}, shape {kind['id']}")


def resolve_chain(nodes: DataFrame, key: str, parent: str, columns: Sequence[str], depth: int = 16) -> DataFrame:
    """Each node's own value of the columns, else the nearest ancestor's, and how many ancestors it has.

    Chains are followed to their end, however long; a parent that isn't there ends a chain. One that runs into a cycle has no end: it takes
    the values of all its nodes and counts `depth` ancestors. An empty text is a value (it clears); null isn't. Pointers double each round, so
    a chain takes the logarithm of its length in joins, each on unique keys."""
    up = cut(nodes.select(key, *columns, F.col(parent).alias("_up"), F.lit(0).alias("_n")))
    reach, before, left = 1, -1, up.where("_up IS NOT NULL").count()
    # chains of every length below the longest exist, so when a round ends none, cycles are all that's left; they are read once around
    while left and (left != before or reach <= left):
        p = up.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], F.col("_up").alias("_next"), F.col("_n").alias("_m"))
        joined = up.join(p, F.col("_up") == F.col("_k"), "left")
        found = F.col("_k").isNotNull()
        up = cut(joined.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns], F.when(found, F.col("_next")).alias("_up"), (F.col("_n") + F.when(found, F.col("_m") + 1).otherwise(0)).alias("_n")))
        reach, before, left = 2 * reach, left, up.where("_up IS NOT NULL").count()
    return up.select(key, *columns, F.when(F.col("_up").isNull(), F.col("_n")).otherwise(F.lit(depth)).alias("ancestors"))
