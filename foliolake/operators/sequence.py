"""Numbering, carrying forward and keeping rows by order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """df with 1-based row numbers within each group, null a group as any other; no group has to fit a task.

    Rows are dealt out by ranges of group and order, so a hot group lies in many partitions, one behind the other; a row's number is its place in its
    partition's share of the group plus the shares before that. Rows that tie in `order` lie together and are numbered in no particular order.
    """
    parts = cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    shares = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition that a group lies in
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = shares.select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_{i}"))
    out = parts.withColumn("_place", place).join(before, same)
    return out.select(*df.columns, (F.col("_before") + F.col("_place")).cast("int").alias(name))


def renumber(df: DataFrame, group: Sequence[str], order: Sequence[Column], hidden: Column | None = None, name: str = "number") -> DataFrame:
    """1-based numbers within each group; hidden rows take none (null) and leave no hole."""
    if hidden is None:
        return numbered(df, group, order, name)
    out = numbered(df.withColumn("_hidden", F.coalesce(hidden, F.lit(False))), [*group, "_hidden"], order, name)
    return out.withColumn(name, F.when(~F.col("_hidden"), F.col(name))).drop("_hidden")


def carry_forward(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def keep_latest(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the order given (newest first)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_preferred(df: DataFrame, keys: Sequence[str], preferred: Column, order: Sequence[str]) -> DataFrame:
    """One row per key: a preferred one before any other, then the first in order."""
    best = F.min_by(F.struct(*df.columns), F.struct((~preferred).alias("p"), *order))
    return df.groupBy(*keys).agg(best.alias("r")).select("r.*")


def unique_keys(df: DataFrame, group: Sequence[str], base: str, order: Sequence[Column], name: str = "key") -> DataFrame:
    """Keys made unique within a group: the first of a base keeps it, others get '-2', '-3' and so on; a made key that is itself a base of the group
    gets one more '-' and its number."""
    counted = numbered(df, [*group, base], order, "_n")
    made = counted.withColumn("_made", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), F.col("_n").cast("string"))))
    bases = df.select(*group, F.col(base).alias("_made"), F.lit(True).alias("_taken")).distinct()
    joined = made.join(bases, [*group, "_made"], "left")
    clash = F.coalesce("_taken", F.lit(False)) & (F.col("_n") > 1)
    return joined.withColumn(name, F.when(clash, F.concat_ws("--", F.col(base), F.col("_n").cast("string"))).otherwise(F.col("_made"))).drop("_n", "_made", "_taken")


def flips(df: DataFrame, wanted: Column, hide: bool, state: str = "hidden") -> DataFrame:
    """The wanted rows that are in the opposite state, with the state flipped; a null state counts as visible."""
    now = F.coalesce(F.col(state), F.lit(0))
    return df.where(wanted & (now == (0 if hide else 1))).withColumn(state, F.lit(1 if hide else 0))


def renumber_label(label: Column, number: Column) -> Column:
    """A label with its number in front replaced by the row's, at least two digits wide; the text behind stays."""
    return F.concat(_two_digits(number), F.regexp_replace(label, r"^\d+", ""))


def _two_digits(number: Column) -> Column:
    n = number.cast("string")
    return F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0"))


def renumber_refs(text: Column, number: Column, prefix: str = "slide-") -> Column:
    """A text in which the prefix's number is the row's, at least two digits wide."""
    return F.regexp_replace(text, F.lit(rf"{prefix}\d+"), F.concat(F.lit(prefix), _two_digits(number)))
