"""Queries of the training-text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shred import deck_items
from ..plans import Query
from ..session import table
from .bpe import encode_texts
from .canon import map_values
from .leakage import find_leaks
from .looks import same_look_pairs
from .reading import grade_documents
from .residue import residue
from .setjoin import expanded, similar_records


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    slides, tags = table(spark, folder, "slides"), table(spark, folder, "tag_list")
    axes = ("type", "subtype", "customer")
    rows = slides.select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}_tag").alias("value")) for a in axes])).alias("t")).select("id", "t.*")
    names = F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.lit(c == "canonical").alias("canonical")) for c in ("canonical", "english")]))
    entries = tags.select(F.col("tag_id").alias("entry"), "axis", names.alias("n")).select("entry", "axis", "n.*")
    return map_values(rows, entries, "id", "axis", "value").withColumnRenamed("entry", "tag_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "slides").select(F.lit("slides").alias("table_name"), F.col("id").alias("record_id"), F.lit("title").alias("field_path"), F.col("title").alias("text"))
    items = deck_items(table(spark, folder, "sample_deck"), ledes=True).where("kind <> 'card'")
    blocks = items.select(F.lit("sample_deck").alias("table_name"), F.concat_ws("/", "file_id", "slide_pos").alias("record_id"), F.col("item_path").alias("field_path"), F.col("item_text").alias("text"))
    keys = ["table_name", "record_id", "field_path"]
    return residue(titles.distinct().unionByName(blocks), keys, "text").select(*keys).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look_pairs(table(spark, folder, "slides"), "id", ["title", "body_text"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = expanded(*similar_records(table(spark, folder, "slide_assets"), "slide_id", "asset_hash", 0.6, least=3))
    return pairs.select(F.col("a").alias("slide_a"), F.col("b").alias("slide_b"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "reading_labels")
    grades = grade_documents(table(spark, folder, "documents"), "doc_id", "text", labels, "grade")
    return grades.join(labels.select("doc_id"), "doc_id", "left_anti")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}

SQL: dict[str, str] = {
    "p6_found": """
WITH s AS (SELECT slide_id, list_sort(list(DISTINCT asset_hash)) AS h FROM slide_assets WHERE slide_id IS NOT NULL AND asset_hash IS NOT NULL GROUP BY slide_id),
t AS (SELECT slide_id, len(h) AS n, unnest(h) AS x FROM s WHERE len(h) >= 3),
c AS (SELECT a.slide_id AS slide_a, b.slide_id AS slide_b, a.n AS n, b.n AS m, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.slide_id < b.slide_id GROUP BY 1, 2, 3, 4)
SELECT slide_a, slide_b FROM c WHERE 5 * k >= 3 * (n + m - k)""",
}
