"""Small measures of a page's content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_number(text: Column) -> Column:
    """The first number in a text, with its sign; null without one."""
    return F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def bars(df: DataFrame, group: Sequence[str], value: Column, floor: float = 40.0, name: str = "bar") -> DataFrame:
    """Bar heights: the value's size in per cent of the greatest of its group, at least `floor`; null without a value. The greatest comes by an
    aggregate and a join, so a hot group is never one task's."""
    rows = df.withColumn("_v", F.abs(value))
    top = rows.groupBy(*group).agg(F.max("_v").alias("_top"))
    out = rows.join(top, list(group))
    return out.withColumn(name, F.when(F.col("_v").isNotNull(), F.greatest(F.when(F.col("_top") > 0, 100 * F.col("_v") / F.col("_top")).otherwise(0.0), F.lit(floor)))).drop("_v", "_top")


def fill_verdict(percent: Column, sparse: float = 80, full: float = 105) -> Column:
    """'sparse' below, 'overflow' above, else 'ok'; null without a measure."""
    return F.when(percent < sparse, "sparse").when(percent > full, "overflow").when(percent.isNotNull(), "ok")


def overridden(df: DataFrame, by_page: DataFrame, by_key: DataFrame, page: Sequence[str], key: Sequence[str], name: str = "value") -> DataFrame:
    """df with the override of its page, else of its key, else null; an empty override counts as none. Both tables hold one `value` for each place."""
    p = by_page.select(*page, F.nullif(F.col("value"), F.lit("")).alias("_p"))
    k = by_key.select(*key, F.nullif(F.col("value"), F.lit("")).alias("_k"))
    return df.join(p, list(page), "left").join(k, list(key), "left").withColumn(name, F.coalesce("_p", "_k")).drop("_p", "_k")


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with columns that it lacks added as nulls of the given types: an additive migration, safe to repeat."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}) if columns else df
