"""Queries of the general record problems: nested decks, page coverage and packed tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import coverage
from ..operators.packed import unpack
from ..operators.shred import deck_items
from ..session import ship, table
from . import Query


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return deck_items(table(spark, folder, "sample_deck")).select("file_id", "slide_pos", "layout", "item_path", "item_text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(table(spark, folder, "stories"), "deck_id", "start_page", "end_page")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    tags = unpack(table(spark, folder, "slides"), "id", "free_tags")
    return tags.select("id", F.col("pos").alias("tag_pos"), F.col("value").alias("tag"))


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p4_found": p4_found, "p7_found": p7_found}

SQL: dict[str, str] = {
    "p2_found": """
WITH RECURSIVE d AS (SELECT file_id, CAST(doc AS JSON)->'$.slides' AS v FROM sample_deck WHERE json_valid(doc) AND json_type(CAST(doc AS JSON)) = 'OBJECT'),
l AS (SELECT file_id, CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END AS v FROM d WHERE v IS NOT NULL),
s AS (SELECT file_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS slide_pos FROM l),
o AS (SELECT file_id, slide_pos, CASE WHEN json_type(x->'layout') = 'VARCHAR' THEN x->>'layout' ELSE '' END AS layout, x->'data' AS data FROM s WHERE json_type(x) = 'OBJECT'),
n AS (
SELECT file_id, slide_pos, layout, '' AS path, '' AS holder, CASE WHEN json_type(data) = 'VARCHAR' AND json_valid(data->>'$') THEN CAST(data->>'$' AS JSON) ELSE data END AS val FROM o
UNION ALL
SELECT file_id, slide_pos, layout, CASE WHEN prefix = '' THEN '' ELSE prefix || '/' END || i AS path, holder, val FROM (
SELECT file_id, slide_pos, layout, prefix, holder, unnest(c) AS val, generate_subscripts(c, 1) - 1 AS i FROM (
SELECT file_id, slide_pos, layout, CASE WHEN k = '' THEN path WHEN path = '' THEN k ELSE path || '/' || k END AS prefix, CASE WHEN k = '' THEN holder ELSE k END AS holder,
CASE WHEN k = '' THEN CAST(val AS JSON[]) WHEN json_type(json_extract(val, k)) = 'ARRAY' THEN CAST(json_extract(val, k) AS JSON[]) ELSE [json_extract(val, k)] END AS c
FROM n, (VALUES (''), ('cards'), ('body_blocks'), ('columns'), ('children')) h(k)
WHERE (k = '' AND json_type(val) = 'ARRAY') OR (k <> '' AND json_type(val) = 'OBJECT' AND json_extract(val, k) IS NOT NULL)))),
t AS (SELECT file_id, slide_pos, layout, path AS item_path, CASE WHEN holder = 'cards' AND json_type(val) = 'OBJECT' AND json_type(val->'title_zh') = 'VARCHAR' THEN val->>'title_zh'
WHEN holder IN ('body_blocks', 'children') AND json_type(val) = 'OBJECT' AND json_type(val->'text') = 'VARCHAR' THEN val->>'text' WHEN holder IN ('body_blocks', 'children') AND json_type(val) = 'VARCHAR' THEN val->>'$' END AS item_text FROM n)
SELECT file_id, CAST(slide_pos AS INTEGER) AS slide_pos, layout, item_path, item_text FROM t WHERE regexp_matches(item_text, '[^\\s\\p{Z}\\p{Cc}]')""",
    "p4_found": """
WITH s AS (SELECT DISTINCT deck_id, start_page, end_page FROM stories WHERE deck_id IS NOT NULL AND start_page <= end_page),
m AS (SELECT *, max(end_page) OVER (PARTITION BY deck_id ORDER BY start_page, end_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_page > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY deck_id ORDER BY start_page, end_page ROWS UNBOUNDED PRECEDING) AS run FROM m),
p AS (SELECT deck_id, run, min(start_page) AS start_page, max(end_page) AS end_page FROM g GROUP BY deck_id, run),
n AS (SELECT *, lead(start_page) OVER (PARTITION BY deck_id ORDER BY run) AS next_start FROM p)
SELECT deck_id, 'period' AS kind, start_page, end_page FROM p
UNION ALL SELECT deck_id, 'gap', CAST(end_page + 1 AS INTEGER), CAST(next_start - 1 AS INTEGER) FROM n WHERE next_start IS NOT NULL""",
}
