"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from 1 / HOT_SHARE of all rows on, so there are at most HOT_SHARE hot keys. Their bytes are bounded too, where a row of the
#: other side holds what its key brings (as its text, or is as long as what was made of it): a hot key's b bytes lie in at least 1 / HOT_SHARE of the
#: rows, so the hot keys together have at most HOT_SHARE times the mean bytes of a row. Long keys go by their `digest`.
HOT_SHARE = 2000


def digest(*columns: Column | str) -> Column:
    """128 bits of the values as two numbers: a key of fixed size in place of long texts or lists."""
    return F.struct(F.xxhash64(*columns).alias("hi"), F.xxhash64(F.lit(7), *columns).alias("lo"))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: float) -> DataFrame:
    """Inner join of left with one row per key of right, where right.weight counts the key's rows in left.

    Hot keys (at most HOT_SHARE of them) are joined by broadcast and never shuffled, so a hot key is
    spread over all tasks; each of the others has under 1 / HOT_SHARE of the rows and is shuffled.
    `total` is the sum of the weights. Null keys match nothing.
    """
    least = max(total / HOT_SHARE, 1.0)
    hot = F.broadcast(right.where(F.col(weight) >= least))
    rest = left.join(hot.select(key), key, "left_anti").where(F.col(key).isNotNull())
    return left.join(hot, key).unionByName(rest.join(right.where(F.col(weight) < least), key))


def salted_join(many: DataFrame, few: DataFrame, key: str, weights: DataFrame, total: float) -> DataFrame:
    """Inner join of many with few where both may have several rows a key; weights (key, weight) counts the key's rows in many.

    The rows of a hot key in many are dealt out over as many salts as keep each under 1 / HOT_SHARE of all
    rows, and the rows of few are repeated for those salts only: at most HOT_SHARE more in all for every row a
    key has there. Only the hot keys with their weights are broadcast. Null keys match nothing.
    """
    least = max(total / HOT_SHARE, 1.0)
    hot = F.broadcast(weights.where(F.col("weight") > least).select(key, F.ceil(F.col("weight") / least).alias("_salts")))
    others = [c for c in many.columns if c != key]
    dealt = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*others), F.col("_salts")))).drop("_salts")
    met = few.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(met, [key, "_salt"]).drop("_salt")
