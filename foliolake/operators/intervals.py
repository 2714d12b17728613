"""Coverage of overlapping integer intervals by a sweep line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of one sweep bucket. After the pre-aggregation a bucket has at most so many rows, however
#: many intervals an entity has, so no task ever gets an unbounded group.
BUCKET = 4096


def _running(df: DataFrame, aggregates: dict[str, tuple[Column, str]]) -> DataFrame:
    """Running totals along `at` for each `entity`, in two levels.

    Each bucket is reduced to one row, the buckets of an entity are scanned, and each bucket is then
    scanned from its carried-in value; `aggregates` maps a new column to (input, "sum" or "max").
    """
    def fold(kind: str, c: Column) -> Column:
        return F.sum(c) if kind == "sum" else F.max(c)

    before = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("entity", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    carried = df.groupBy("entity", "bucket").agg(*[fold(k, c).alias(f"_{n}") for n, (c, k) in aggregates.items()])
    carried = carried.select("entity", "bucket", *[fold(k, F.col(f"_{n}")).over(before).alias(f"_{n}") for n, (_, k) in aggregates.items()])
    out = df.join(carried, ["entity", "bucket"])
    for name, (c, kind) in aggregates.items():
        here = fold(kind, c).over(inside)
        total = F.coalesce(here, F.lit(0)) + F.coalesce(F.col(f"_{name}"), F.lit(0)) if kind == "sum" else F.greatest(here, F.col(f"_{name}"))
        out = out.withColumn(name, total)
    return out.drop(*[f"_{n}" for n in aggregates])


def coverage(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Continuous covered periods of each entity and the gaps between them.

    Returns (entity, kind, start, end) under the names given, kind 'period' or 'gap', both ends
    inclusive; n and n + 1 are continuous. Rows with a null entity, a null bound or start > end are
    left out; repeated rows change nothing; an empty table gives an empty result. Other columns of df,
    whatever their names, are ignored.

    Boundaries become plus and minus events that are summed per (entity, position) before anything
    else, so a hot entity costs one row per distinct position, and the prefix sums run in buckets.
    """
    spans = df.select(F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("lo"), F.col(end).cast("bigint").alias("hi"))
    spans = spans.where("entity IS NOT NULL AND lo <= hi")
    events = spans.select("entity", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    events = events.groupBy("entity", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    events = events.withColumn("bucket", F.floor(F.col("at") / BUCKET))
    swept = _running(events, {"active": (F.col("d"), "sum")}).withColumn("was", F.col("active") - F.col("d"))
    turns = swept.where("active = 0 OR was = 0").select("entity", "bucket", "at", "active", "was")
    opened = F.when(F.col("was") == 0, F.col("at"))
    closed = F.when(F.col("active") == 0, F.col("at"))
    turns = _running(turns, {"since": (opened, "max"), "until": (closed, "max")})
    kind = F.when(F.col("active") == 0, F.lit("period")).otherwise(F.lit("gap"))
    first = F.when(F.col("active") == 0, F.col("since")).otherwise(F.col("until"))
    out = turns.select(F.col("entity").alias(entity), kind.alias("kind"), first.cast(df.schema[start].dataType).alias(start), (F.col("at") - 1).cast(df.schema[end].dataType).alias(end))
    return out.where(F.col(start).isNotNull())
