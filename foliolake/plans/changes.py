"""Queries on changes: requests, creation and deletion, copies of tags, renumbering, order of listings, and small functions on real columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import lookups as K
from ..operators import matching as N
from ..operators import measures as V
from ..operators import mutate as M
from ..operators import sequence as Q
from ..session import table
from . import Query
from .catalogue import _S, _ST, slides, stories

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


# ids, names and values


@_add("valid_ids", f"WITH {_S} SELECT id, coalesce(regexp_full_match(deck_id, '[A-Za-z0-9一-鿿][A-Za-z0-9._\\-一-鿿]{{0,127}}'), false) AS deck, coalesce(regexp_full_match(slide_key, '[A-Za-z0-9][A-Za-z0-9._\\-]{{0,127}}'), false) AS slide, coalesce(regexp_full_match(title, '[A-Za-z0-9][A-Za-z0-9._\\-]{{0,63}}'), false) AS pack FROM s")
def valid_ids(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).select("id", X.is_id("deck_id", "deck").alias("deck"), X.is_id("slide_key", "slide").alias("slide"), X.is_id("title", "pack").alias("pack"))


@_add("placeholder_texts", f"WITH {_S} SELECT id, coalesce(trim(title) IN ('null', 'TBD') OR starts_with(trim(title), '双击'), false) AS placeholder FROM s WHERE title IS NOT NULL")
def placeholder_texts(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).where("title IS NOT NULL").select("id", X.is_placeholder(F.trim("title"), ("null", "TBD"), ("双击",)).alias("placeholder"))


@_add("file_stems", "SELECT hash, regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '(-small)?-[0-9]+$', '') AS stem, CASE WHEN regexp_matches(filename, '\\.[^.]+$') THEN regexp_replace(regexp_extract(filename, '^(.*)\\.[^.]+$', 1), '-\\d{4,}$', '') || regexp_extract(filename, '(\\.[^.]+)$', 1) ELSE regexp_replace(filename, '-\\d{4,}$', '') END AS name FROM assets WHERE filename IS NOT NULL")
def file_stems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "assets").where("filename IS NOT NULL").select("hash", X.bare_stem("filename").alias("stem"), X.strip_id_suffix("filename").alias("name"))


@_add("size_labels", "SELECT hash, CASE WHEN size_bytes < 1024 THEN format('{:.0f} B', size_bytes::DOUBLE) WHEN size_bytes < 1048576 THEN format('{:.1f} KB', size_bytes / 1024) WHEN size_bytes < 1073741824 THEN format('{:.1f} MB', size_bytes / 1048576) ELSE format('{:.1f} GB', size_bytes / 1073741824) END AS size FROM assets WHERE size_bytes IS NOT NULL")
def size_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "assets").where("size_bytes IS NOT NULL").select("hash", X.human_bytes("size_bytes").alias("size"))


@_add("colours", "SELECT iwa_data_id AS d, '#' || upper(lpad(to_hex(CAST(round(least(iwa_data_id % 70000, 65535) * 255 / 65535) AS BIGINT)), 2, '0')) || '00' || 'FF' AS colour, least(greatest(coalesce((iwa_data_id % 300 - 100) / 100.0, 1.0), 0.0), 1.0)::DOUBLE AS opacity FROM (SELECT DISTINCT iwa_data_id FROM slide_assets WHERE iwa_data_id IS NOT NULL)")
def colours(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "slide_assets").select("iwa_data_id").where("iwa_data_id IS NOT NULL").distinct()
    return d.select(F.col("iwa_data_id").alias("d"), X.rgb_hex(F.col("iwa_data_id") % 70000, F.lit(-5), F.lit(99999)).alias("colour"), X.opacity((F.col("iwa_data_id") % 300 - 100) / 100).alias("opacity"))


@_add("stored_bodies", "SELECT doc_id, substring(text, 1, 300) AS body, coalesce(length(text), 0) AS chars FROM documents")
def stored_bodies(spark: SparkSession, folder: str) -> DataFrame:
    body, length = X.stored_body("text", 300)
    return table(spark, folder, "documents").select("doc_id", body.alias("body"), length.cast("bigint").alias("chars"))


@_add("title_versions", f"WITH {_S} SELECT id, CASE WHEN page_no % 3 = 0 AND title IS NOT NULL THEN CASE WHEN title = '' THEN '(p' || coalesce(CAST(page_no AS VARCHAR), '?') || ' · 无标题)' ELSE title END WHEN split_part(body_text, '。', 1) <> '' THEN substring(regexp_replace(split_part(body_text, '。', 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), 1, 80) WHEN coalesce(body_text, '') <> '' THEN substring(body_text, 1, 40) ELSE '(empty)' END AS title, CASE WHEN page_no % 3 = 0 AND title = '' THEN 'stub' WHEN page_no % 3 = 0 AND title IS NOT NULL THEN 'extracted' ELSE 'auto-summary' END AS source FROM s WHERE page_no IS NOT NULL")
def title_versions(spark: SparkSession, folder: str) -> DataFrame:
    version = F.when(F.col("page_no") % 3 == 0, 2).otherwise(1)
    s = slides(spark, folder).where("page_no IS NOT NULL")
    return s.select("id", X.title_of(version, F.col("title"), F.lit(""), F.col("body_text"), F.col("page_no")).alias("t")).select("id", "t.title", "t.source")


@_add("sound_overrides", f"WITH {_S} SELECT id, CASE WHEN contains(coalesce(type_tag, ''), '复盘') OR contains(coalesce(media_tag, ''), '复盘') THEN false WHEN contains(coalesce(type_tag, ''), '视频') OR contains(coalesce(media_tag, ''), '视频') THEN true END AS sound FROM s")
def sound_overrides(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).select("id", X.sound_of(F.array("type_tag", "media_tag"), "视频", "复盘").alias("sound"))


@_add("deck_mentions", f"WITH {_S} SELECT id, deck_id || '-x,b' AS refs FROM s WHERE deck_id IS NOT NULL")
def deck_mentions(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder).where("deck_id IS NOT NULL")
    text = F.concat(F.lit("see runs/20240102-030405-b/ and runs/20230102-030405-"), "deck_id", F.lit("-x/index.html, runs/20230102-030405-"), "deck_id", F.lit("-x/ not runs/b"))
    return s.select("id", F.array_join(F.transform(X.deck_refs(text), lambda r: F.substring(r, 17, 999)), ",").alias("refs"))


@_add("rule_places", f"WITH {_S} SELECT id, CAST(page_no AS VARCHAR) AS slides, slide_key AS label, page_no + 0.5 AS px, '.a .b' AS selectors FROM s WHERE page_no IS NOT NULL")
def rule_places(spark: SparkSession, folder: str) -> DataFrame:
    message = F.concat(F.lit("slide "), "page_no", F.lit(" ("), "slide_key", F.lit("): font-size "), "page_no", F.lit(".5px in `.a .b`, use `<b>`"))
    s = slides(spark, folder).where("page_no IS NOT NULL").select("id", K.message_places(message).alias("p"))
    return s.select("id", F.array_join(F.col("p.slides").cast("array<string>"), ",").alias("slides"), "p.label", "p.px", F.array_join("p.selectors", ",").alias("selectors"))


@_add("text_id_paths", f"WITH {_S} SELECT id, 'data.cards.' || (page_no - 1) || '.title_zh' AS path FROM s WHERE page_no IS NOT NULL")
def text_id_paths(spark: SparkSession, folder: str) -> DataFrame:
    text_id = F.concat(F.lit("slide-03.card-"), F.col("page_no").cast("string"), F.lit(".title"))
    return slides(spark, folder).where("page_no IS NOT NULL").select("id", K.path_of_text_id(text_id, {"card": "cards"}, {"cards.title": "title_zh"}).alias("path"))


@_add("override_targets", f"WITH {_S} SELECT id, CASE WHEN page_no BETWEEN 1 AND 99 THEN 'page:' || page_no WHEN page_no BETWEEN 100 AND 999 THEN 'page:' || page_no END AS by_page, 'key:' || slide_key AS by_key FROM s WHERE page_no IS NOT NULL AND slide_key LIKE 'slide-0%'")
def override_targets(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder).where("page_no IS NOT NULL AND slide_key LIKE 'slide-0%'")
    return s.select("id", K.override_target(F.concat(F.lit("slide-"), F.col("page_no").cast("string"), F.lit(".html"))).alias("by_page"), K.override_target(F.concat("slide_key", F.lit(".html"))).alias("by_key"))


# requests and rows that come and go


_REQUESTS = "SELECT DISTINCT id AS request, deck_id, CASE WHEN length(id) % 2 = 0 THEN 'insert' ELSE 'delete' END AS op, start_page AS page FROM stories WHERE id IS NOT NULL"


@_add("request_faults", f"WITH {_S}, d AS (SELECT deck_id, max(page_no) AS pages, count(DISTINCT page_no) AS held FROM s GROUP BY 1), r AS ({_REQUESTS}), x AS (SELECT request, CASE WHEN pages IS NULL THEN 'no deck' WHEN page IS NULL OR page < 1 OR page > pages + CAST(op = 'insert' AS INTEGER) THEN 'no page' WHEN op = 'delete' AND page = 1 THEN 'cover' END AS fault FROM r LEFT JOIN d USING (deck_id)), a AS (SELECT r.deck_id FROM r JOIN d USING (deck_id) WHERE op = 'delete' AND page BETWEEN 1 AND pages GROUP BY r.deck_id, held HAVING count(DISTINCT page) >= held) SELECT * FROM x WHERE fault IS NOT NULL UNION ALL SELECT request, 'all' FROM r WHERE op = 'delete' AND deck_id IN (SELECT deck_id FROM a)")
def request_faults(spark: SparkSession, folder: str) -> DataFrame:
    op = F.when(F.length("id") % 2 == 0, "insert").otherwise("delete")
    r = table(spark, folder, "stories").where("id IS NOT NULL").select(F.col("id").alias("request"), "deck_id", op.alias("op"), F.col("start_page").alias("page")).distinct()
    return M.request_faults(r, slides(spark, folder))


_NEW = "SELECT CASE WHEN start_page % 2 = 0 THEN id ELSE id || '-new' END AS id, title, deck_id, start_page, end_page FROM st"


@_add("story_creation", f"WITH {_ST}, o AS (SELECT DISTINCT id FROM st), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS times FROM ({_NEW})) SELECT id, CASE WHEN id IS NULL OR coalesce(start_page > end_page, false) THEN 400 WHEN times > 1 OR id IN (SELECT id FROM o WHERE id IS NOT NULL) THEN 409 ELSE 201 END AS status FROM n")
def story_creation(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("id", "title", "deck_id", "start_page", "end_page")
    old = stories(spark, folder).select(*columns)
    new = stories(spark, folder).select(F.when(F.col("start_page") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-new"))).alias("id"), *columns[1:])
    return M.create_rows(old, new, "id", "start_page", "end_page")[1]


@_add("story_deletion", f"WITH {_ST}, d AS (SELECT DISTINCT CASE WHEN start_page % 2 = 0 THEN id ELSE id || '-gone' END AS id FROM st WHERE id IS NOT NULL AND start_page IS NOT NULL) SELECT id, CASE WHEN id IN (SELECT id FROM st WHERE id IS NOT NULL) THEN 200 ELSE 404 END AS status FROM d")
def story_deletion(spark: SparkSession, folder: str) -> DataFrame:
    s = stories(spark, folder)
    doomed = s.where("id IS NOT NULL AND start_page IS NOT NULL").select(F.when(F.col("start_page") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("-gone"))).alias("id"))
    return M.delete_rows(s, doomed, "id")[1]


@_add("tasks_enqueued", f"WITH {_ST}, r AS (SELECT DISTINCT id, deck_id, start_page FROM st WHERE id IS NOT NULL), p AS (SELECT id, CAST(json_object('deck_id', deck_id, 'start_page', start_page) AS VARCHAR) AS payload FROM r) SELECT substring(sha256(id || chr(31) || 'insert' || chr(31) || payload), 1, 16) AS task, payload, 'queued' AS status FROM p")
def tasks_enqueued(spark: SparkSession, folder: str) -> DataFrame:
    r = stories(spark, folder).where("id IS NOT NULL").select("id", "deck_id", "start_page").distinct()
    return M.enqueue(r, "insert", ["deck_id", "start_page"], F.lit(0), "id").select("task", "payload", "status")


@_add("insert_first_writer", "WITH o AS (SELECT hash, filename FROM assets WHERE size_bytes >= 50000), n AS (SELECT asset_hash AS hash, min(slide_id) AS filename FROM slide_assets WHERE asset_hash IS NOT NULL AND slide_id IS NOT NULL GROUP BY 1) SELECT * FROM o UNION ALL SELECT * FROM n WHERE hash NOT IN (SELECT hash FROM o)")
def insert_first_writer(spark: SparkSession, folder: str) -> DataFrame:
    """Of several writers of a new key the first by name is kept."""
    old = table(spark, folder, "assets").where("size_bytes >= 50000").select("hash", "filename")
    new = table(spark, folder, "slide_assets").where("asset_hash IS NOT NULL AND slide_id IS NOT NULL").select(F.col("asset_hash").alias("hash"), F.col("slide_id").alias("filename"))
    return M.insert_ignore(old, new, ["hash"], "filename")


@_add("update_by_page", f"WITH {_S}, f AS (SELECT deck_id, page_no, min(id) AS uuid FROM s WHERE deck_id IS NOT NULL AND page_no % 2 = 0 GROUP BY 1, 2) SELECT s.id, coalesce(f.uuid, s.iwa_uuid) AS iwa_uuid FROM s LEFT JOIN f ON s.deck_id = f.deck_id AND s.page_no = f.page_no")
def update_by_page(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    prints = s.where("deck_id IS NOT NULL AND page_no % 2 = 0").groupBy("deck_id", "page_no").agg(F.min("id").alias("iwa_uuid"))
    return M.update_given(s, prints, ["deck_id", "page_no"], ["iwa_uuid"]).select("id", "iwa_uuid")


@_add("updates_unmatched", f"WITH {_S}, {_ST} SELECT DISTINCT deck_id, start_page AS page_no FROM st WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.deck_id = st.deck_id AND s.page_no = st.start_page)")
def updates_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return M.unmatched(slides(spark, folder), stories(spark, folder).select("deck_id", F.col("start_page").alias("page_no")), ["deck_id", "page_no"])


_MAP = "SELECT a.id, b.id AS source FROM s a JOIN s b ON a.deck_id = b.deck_id AND a.page_no = b.page_no + 1"


@_add("tags_copied", f"WITH {_S}, m AS (SELECT id, min(source) AS source FROM ({_MAP}) GROUP BY 1) SELECT s.id, coalesce(CASE WHEN b.title IS NOT NULL THEN b.type_tag END, s.type_tag) AS type_tag, coalesce(CASE WHEN b.title IS NOT NULL THEN b.free_tags END, s.free_tags) AS free_tags FROM s LEFT JOIN m ON s.id = m.id LEFT JOIN s b ON m.source = b.id")
def tags_copied(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    before = s.select("deck_id", (F.col("page_no") + 1).alias("page_no"), F.col("id").alias("source"))
    mapping = s.select("id", "deck_id", "page_no").join(before, ["deck_id", "page_no"]).groupBy("id").agg(F.min("source").alias("source"))
    return M.copy_tags(s, s, mapping, ["type_tag", "free_tags"]).select("id", "type_tag", "free_tags")


@_add("source_meta", "WITH a AS (SELECT hash, ext, size_bytes FROM assets WHERE size_bytes > 1000) SELECT DISTINCT l.slide_id, l.asset_hash, a.ext AS source_ext, a.size_bytes AS source_size_bytes FROM slide_assets l LEFT JOIN a ON l.asset_hash = a.hash")
def source_meta(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "slide_assets").select("slide_id", "asset_hash").distinct()
    return M.with_source(links, table(spark, folder, "assets").where("size_bytes > 1000"), "asset_hash", "hash", ["ext", "size_bytes"])


@_add("drift_by_key", f"WITH {_S}, a AS (SELECT id, title, layout FROM (SELECT id, title, CASE WHEN page_no % 7 = 0 THEN 'template' ELSE 'free' END AS layout FROM s WHERE page_no % 5 <> 0)), b AS (SELECT id, CASE WHEN page_no % 2 = 0 THEN '  ' || title || ' ' ELSE upper(title) END AS title FROM s WHERE page_no % 3 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN layout = 'template' THEN 'skipped' WHEN trim(regexp_replace(a.title, '\\s+', ' ', 'g')) IS NOT DISTINCT FROM trim(regexp_replace(b.title, '\\s+', ' ', 'g')) THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.id = b.id")
def drift_by_key(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    a = s.where("page_no % 5 <> 0").select("id", "title", F.when(F.col("page_no") % 7 == 0, "template").otherwise("free").alias("layout"))
    b = s.where("page_no % 3 <> 0").select("id", F.when(F.col("page_no") % 2 == 0, F.concat(F.lit("  "), "title", F.lit(" "))).otherwise(F.upper("title")).alias("title"), F.lit("").alias("layout"))
    return M.compare_keys(a, b, ["id"], ["title"], lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")), F.col("layout") == "template")


@_add("splice_report", f"WITH {_S}, b AS (SELECT DISTINCT deck_id, slide_key FROM s WHERE page_no % 4 <> 0), a AS (SELECT deck_id, slide_key, body_text FROM s WHERE page_no % 3 <> 0), ad AS (SELECT deck_id, count(*) AS added FROM (SELECT DISTINCT deck_id, slide_key FROM a EXCEPT SELECT * FROM b) GROUP BY 1), rm AS (SELECT deck_id, count(*) AS removed FROM (SELECT * FROM b EXCEPT SELECT deck_id, slide_key FROM a) GROUP BY 1), em AS (SELECT deck_id, count(*) FILTER (trim(coalesce(body_text, ''), ' ') = '') AS empty FROM a GROUP BY 1), r AS (SELECT s.deck_id, l.asset_hash FROM slide_assets l JOIN s ON l.slide_id = s.id WHERE l.asset_hash IS NOT NULL), ms AS (SELECT deck_id, count(DISTINCT asset_hash) AS missing FROM r WHERE asset_hash NOT IN (SELECT hash FROM assets WHERE size_bytes > 100000) GROUP BY 1) SELECT deck_id, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, empty, coalesce(missing, 0) AS missing FROM em LEFT JOIN ad USING (deck_id) LEFT JOIN rm USING (deck_id) LEFT JOIN ms USING (deck_id)")
def splice_report(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    before, after = s.where("page_no % 4 <> 0"), s.where("page_no % 3 <> 0").withColumn("body", F.col("body_text"))
    links = table(spark, folder, "slide_assets").where("asset_hash IS NOT NULL").select(F.col("slide_id").alias("id"), F.col("asset_hash").alias("path"))
    refs = links.join(s.select("id", "deck_id"), "id").select("deck_id", "path")
    return M.splice_report(before, after, refs, table(spark, folder, "assets").where("size_bytes > 100000").select(F.col("hash").alias("path")))


# order, numbers, listings


@_add("flipped_pages", f"WITH {_S} SELECT id, 1 - hidden AS hidden FROM s WHERE page_no BETWEEN 2 AND 5 AND hidden = 0")
def flipped_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages 2 to 5 of each deck to hide: only those that are visible are flipped."""
    return Q.flips(slides(spark, folder), F.col("page_no").between(2, 5), True).select("id", "hidden")


@_add("labels_renumbered", f"WITH {_S}, n AS (SELECT id, slide_key, row_number() OVER (PARTITION BY deck_id ORDER BY page_no, id) AS n FROM s WHERE deck_id IS NOT NULL AND page_no IS NOT NULL) SELECT id, lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || ' ' || slide_key AS label, 'slide-' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '.card-1' AS text_id FROM n")
def labels_renumbered(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder).where("deck_id IS NOT NULL AND page_no IS NOT NULL")
    n = Q.renumber(s, ["deck_id"], [F.col("page_no"), F.col("id")], name="n")
    old = F.concat(F.lit("77 "), "slide_key")
    return n.select("id", Q.renumber_label(old, F.col("n")).alias("label"), Q.renumber_refs(F.lit("slide-99.card-1"), F.col("n")).alias("text_id"))


@_add("stories_listed", f"WITH {_ST}, o AS (SELECT id, deck_id, start_page, end_page - start_page + 1 AS slide_count FROM st WHERE id IS NOT NULL AND deck_id IS NOT NULL AND start_page IS NOT NULL AND end_page IS NOT NULL) SELECT id, row_number() OVER (ORDER BY deck_id, start_page, slide_count DESC, id) AS place FROM (SELECT DISTINCT * FROM o) QUALIFY place <= 200")
def stories_listed(spark: SparkSession, folder: str) -> DataFrame:
    """The first 200 stories of a listing in its order; the page of a listing is the feature."""
    s = stories(spark, folder).where("id IS NOT NULL AND deck_id IS NOT NULL AND start_page IS NOT NULL AND end_page IS NOT NULL")
    s = s.select("id", "deck_id", "start_page", (F.col("end_page") - F.col("start_page") + 1).alias("slide_count")).distinct()
    page = C.top(s, [F.asc("deck_id"), F.asc("start_page"), F.desc("slide_count"), F.asc("id")], 200)
    return Q.renumber(page.withColumn("_all", F.lit(1)), ["_all"], [F.asc("deck_id"), F.asc("start_page"), F.desc("slide_count"), F.asc("id")], name="place").select("id", "place")


@_add("tasks_listed", "SELECT doc_id, created_at FROM documents WHERE created_at IS NOT NULL ORDER BY created_at DESC, doc_id LIMIT 20")
def tasks_listed(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 20, as a task list shows them."""
    return C.top(table(spark, folder, "documents").where("created_at IS NOT NULL").select("doc_id", "created_at"), [F.desc("created_at"), F.asc("doc_id")], 20)


@_add("pick_list", f"WITH {_S} SELECT id, title FROM s WHERE type_tag IS NOT NULL AND title IS NOT NULL ORDER BY deck_id, page_no, id LIMIT 40")
def pick_list(spark: SparkSession, folder: str) -> DataFrame:
    """The first 40 after the filters, as a pick list shows them."""
    s = slides(spark, folder).where("type_tag IS NOT NULL AND title IS NOT NULL")
    return C.top(s.select("deck_id", "page_no", "id", "title"), [F.asc_nulls_last("deck_id"), F.asc_nulls_last("page_no"), F.asc("id")], 40).select("id", "title")


@_add("hits_joined", f"WITH {_S} SELECT id, deck_id, title FROM s WHERE regexp_matches(lower(coalesce(title, '')), '(^|[^a-z0-9])risks([^a-z0-9]|$)')")
def hits_joined(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    hits = C.match(C.postings(s, "id", ["title"]), "id", ["risks"])
    return s.join(hits, "id").select("id", "deck_id", "title")


@_add("facet_map", f"WITH {_S}, f AS (SELECT type_tag AS value, count(*) AS n FROM s WHERE type_tag IS NOT NULL GROUP BY 1) SELECT 'type_tag' AS axis, string_agg(value || ':' || n, '|' ORDER BY n DESC, value DESC) AS entries FROM f")
def facet_map(spark: SparkSession, folder: str) -> DataFrame:
    m = C.facet_map(C.facets(slides(spark, folder), ["type_tag"]))
    return m.select("axis", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["value"], e["n"].cast("string"))), "|").alias("entries"))


@_add("shared_within_decks", f"WITH {_S}, k AS (SELECT hash FROM assets WHERE size_bytes >= 20000 AND lower(CASE WHEN starts_with(ext, '.') THEN ext ELSE '.' || ext END) IN ('.png', '.jpg')), l AS (SELECT DISTINCT asset_hash, slide_id FROM slide_assets WHERE asset_hash IS NOT NULL AND slide_id IS NOT NULL), c AS (SELECT asset_hash FROM l GROUP BY 1 HAVING count(*) >= 3), u AS (SELECT l.*, s.deck_id FROM l JOIN s ON l.slide_id = s.id WHERE asset_hash IN (SELECT hash FROM k) AND asset_hash NOT IN (SELECT asset_hash FROM c)) SELECT a.asset_hash, a.slide_id AS slide_a, b.slide_id AS slide_b FROM u a JOIN u b ON a.asset_hash = b.asset_hash AND a.slide_id < b.slide_id")
def shared_within_decks(spark: SparkSession, folder: str) -> DataFrame:
    return N.shared_assets(table(spark, folder, "slide_assets"), table(spark, folder, "assets"), slides(spark, folder), 20000, (".png", ".jpg"), other_decks=False)


@_add("reachable_nodes", "WITH RECURSIVE e AS (SELECT c_custkey // 3 AS p, c_custkey AS c FROM customer), r AS (SELECT p AS start, c AS node FROM e WHERE p % 100 = 0 UNION SELECT r.start, e.c FROM r JOIN e ON r.node = e.p) SELECT start, node FROM r")
def reachable_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes below every hundredth node of a tree of keys."""
    c = table(spark, folder, "customer")
    links = c.select(F.floor(F.col("c_custkey") / 3).alias("parent"), F.col("c_custkey").cast("bigint").alias("child"))
    return K.reachable(links, links.where("parent % 100 = 0").select(F.col("parent").alias("start")))


@_add("columns_added", f"WITH {_S} SELECT id, CAST(NULL AS VARCHAR) AS origin, hidden FROM s")
def columns_added(spark: SparkSession, folder: str) -> DataFrame:
    return V.with_columns(slides(spark, folder).select("id", "hidden"), {"origin": "string", "hidden": "int"})
