"""Queries on the catalogue: search, facets, stories, decks, changes and task states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import mutate as M
from ..operators import sequence as Q
from ..session import table
from . import Query

TEXT_COLUMNS = ("title", "body_text", "id", "notes", "type_tag", "subtype_tag", "customer_tag", "free_tags")
AXES = ("type_tag", "subtype_tag", "customer_tag", "media_tag")
KINDS = {"plan": ("计划", "目标", "plan"), "result": ("试点", "结果", "wins"), "review": ("复盘", "risks")}


def slides(spark: SparkSession, folder: str) -> DataFrame:
    """Slides with repeated deliveries folded into the last one."""
    return C.latest_rows(table(spark, folder, "slides"), "id", "row_seq")


def stories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stories").distinct()


#: The same two views for the oracle.
_S = "s AS (SELECT * FROM slides WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_seq DESC) = 1)"
_ST = "st AS (SELECT DISTINCT * FROM stories)"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _held(c: str, needle: str) -> str:
    return f"contains(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{needle}')"


@_add("search_substring", f"WITH {_S} SELECT id, deck_id, page_no, title FROM s WHERE media_tag = '图文' AND (" + " OR ".join(_held(c, "risk") for c in TEXT_COLUMNS) + ")")
def search_substring(spark: SparkSession, folder: str) -> DataFrame:
    return C.search(slides(spark, folder), {"media_tag": "图文", "deck_id": None}, "risk", TEXT_COLUMNS).select("id", "deck_id", "page_no", "title")


@_add("search_top", f"WITH {_S} SELECT deck_id, page_no, id FROM s ORDER BY deck_id, page_no, id LIMIT 500")
def search_top(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of a listing: 500 rows by deck and page is the feature."""
    return C.top(slides(spark, folder).select("deck_id", "page_no", "id"), [F.asc_nulls_last("deck_id"), F.asc_nulls_last("page_no"), F.asc("id")], 500)


@_add("search_tag_text", f"WITH {_S} SELECT id FROM s WHERE contains(coalesce(free_tags, ''), 'review') AND (customer_tag IS NULL OR customer_tag NOT IN ('堇禾乳业')) AND media_tag IN ('图文', '视频')")
def search_tag_text(spark: SparkSession, folder: str) -> DataFrame:
    return C.search(slides(spark, folder), tag="review", only={"media_tag": ("图文", "视频")}, without={"customer_tag": ("堇禾乳业",)}).select("id")


_TAGS = "CASE WHEN json_valid(free_tags) AND json_type(free_tags) = 'ARRAY' THEN CAST(free_tags AS JSON)::VARCHAR[] ELSE [] END"


@_add("search_all_tags", f"WITH {_S}, t AS (SELECT id, {_TAGS} AS tags FROM s) SELECT id FROM t WHERE list_has_all(tags, ['pilot', 'demo'])")
def search_all_tags(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).where(C.has_all(X.lenient_list("free_tags"), ["pilot", "demo"])).select("id")


_TOKENS = "list_distinct(list_concat(list_concat(flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))), list_filter(regexp_extract_all({x}, '[一-鿿]+'), lambda r: length(r) <= 2)), list_concat(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9]+'), lambda w: lower(w)), regexp_extract_all({x}, '\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?'))))"


def token_sql(x: str) -> str:
    return _TOKENS.format(x=f"coalesce({x}, '')")


_POST = f"p AS (SELECT DISTINCT id, unnest({token_sql('concat_ws(chr(10), title, body_text)')}) AS token FROM s)"


@_add("fts_or", f"WITH {_S}, {_POST} SELECT DISTINCT id FROM p WHERE token IN ('forecast', 'budget')")
def fts_or(spark: SparkSession, folder: str) -> DataFrame:
    return C.match(C.postings(slides(spark, folder), "id", ["title", "body_text"]), "id", ["forecast", "budget"])


@_add("fts_and", f"WITH {_S}, {_POST} SELECT id FROM p WHERE token IN ('库存', '预测') GROUP BY id HAVING count(DISTINCT token) = 2")
def fts_and(spark: SparkSession, folder: str) -> DataFrame:
    return C.match(C.postings(slides(spark, folder), "id", ["title", "body_text"]), "id", ["库存", "预测"], every=True)


@_add("facet_counts", f"WITH {_S} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value, count(*) AS n FROM s WHERE {a} IS NOT NULL GROUP BY {a}" for a in AXES))
def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.facets(slides(spark, folder), AXES)


@_add("facet_totals", f"WITH {_S}, {_ST} SELECT (SELECT count(*) FROM s) AS slides, (SELECT count(*) FROM s WHERE contains(coalesce(free_tags, ''), 'needs review')) AS flagged, (SELECT count(DISTINCT deck_id) FROM s) AS decks, (SELECT count(*) FROM st) AS stories")
def facet_totals(spark: SparkSession, folder: str) -> DataFrame:
    return C.totals(slides(spark, folder), stories(spark, folder), "needs review")


@_add("free_tag_histogram", f"WITH {_S}, t AS (SELECT unnest({_TAGS}) AS tag FROM s) SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY tag")
def free_tag_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return C.tag_histogram(slides(spark, folder))


@_add(
    "deck_rollup",
    f"WITH {_S}, {_ST}, n AS (SELECT deck_id, count(*) AS stories FROM st GROUP BY deck_id), c AS (SELECT deck_id, slide_key, title, thumbnail_path, count(*) OVER (PARTITION BY deck_id) AS slides, row_number() OVER (PARTITION BY deck_id ORDER BY page_no IS NULL, page_no, row_seq) AS r FROM s) SELECT c.deck_id, c.slides, coalesce(n.stories, 0) AS stories, slide_key AS cover_key, title AS cover_title, thumbnail_path AS cover_thumb FROM c LEFT JOIN n ON c.deck_id = n.deck_id WHERE r = 1",
)
def deck_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return C.decks(slides(spark, folder), stories(spark, folder))


@_add("deck_search", SQL["deck_rollup"].replace("WHERE r = 1", "WHERE r = 1 AND (" + _held("c.deck_id", "am") + " OR " + _held("title", "am") + ")"))
def deck_search(spark: SparkSession, folder: str) -> DataFrame:
    return C.search(deck_rollup(spark, folder), text="am", columns=("deck_id", "cover_title"))


@_add("story_search", f"WITH {_ST} SELECT id, title, start_page, end_page - start_page + 1 AS slide_count FROM st WHERE {_held('title', '复盘')} OR {_held('description', '复盘')} OR {_held('id', '复盘')}")
def story_search(spark: SparkSession, folder: str) -> DataFrame:
    return C.search(stories(spark, folder), text="复盘", columns=("title", "description", "id")).select("id", "title", "start_page", (F.col("end_page") - F.col("start_page") + 1).alias("slide_count"))


_MEM = "m AS (SELECT st.id AS story_id, st.title AS story_title, s.id AS slide_id, s.deck_id, s.page_no, s.page_no - st.start_page AS position FROM st JOIN s ON st.deck_id = s.deck_id AND s.page_no BETWEEN st.start_page AND st.end_page)"


@_add("story_members", f"WITH {_S}, {_ST}, {_MEM} SELECT * FROM m")
def story_members(spark: SparkSession, folder: str) -> DataFrame:
    return C.members(stories(spark, folder), slides(spark, folder))


@_add("slide_stories", f"WITH {_S}, {_ST}, {_MEM} SELECT slide_id, count(DISTINCT story_id) AS stories, min(position) AS first_position FROM m GROUP BY slide_id")
def slide_stories(spark: SparkSession, folder: str) -> DataFrame:
    return story_members(spark, folder).groupBy("slide_id").agg(F.count_distinct("story_id").alias("stories"), F.min("position").alias("first_position"))


@_add("orphan_slides", f"WITH {_S}, {_ST} SELECT id, deck_id, page_no FROM s WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.deck_id = s.deck_id AND s.page_no BETWEEN st.start_page AND st.end_page)")
def orphan_slides(spark: SparkSession, folder: str) -> DataFrame:
    return C.orphans(stories(spark, folder), slides(spark, folder)).select("id", "deck_id", "page_no")


@_add("story_titles_concat", f"WITH {_S}, {_ST}, {_MEM}, d AS (SELECT DISTINCT slide_id, story_title FROM m) SELECT slide_id, coalesce(string_agg(story_title, ' | ' ORDER BY story_title), '') AS titles FROM d GROUP BY slide_id")
def story_titles_concat(spark: SparkSession, folder: str) -> DataFrame:
    return C.story_titles(story_members(spark, folder))


@_add("story_cover", f"WITH {_S}, {_ST}, f AS (SELECT deck_id, page_no, arg_min_null(thumbnail_path, row_seq) AS cover FROM s WHERE page_no IS NOT NULL GROUP BY deck_id, page_no) SELECT st.id, st.deck_id, st.start_page, end_page - start_page + 1 AS slide_count, cover FROM st LEFT JOIN f ON st.deck_id = f.deck_id AND st.start_page = f.page_no")
def story_cover(spark: SparkSession, folder: str) -> DataFrame:
    return C.story_covers(stories(spark, folder), slides(spark, folder))


@_add("stale_decks", f"WITH {_S}, u AS (SELECT deck_id, max(updated_at) AS updated FROM s GROUP BY deck_id), f AS (SELECT deck_id, max(received_at) AS modified FROM sample_deck GROUP BY deck_id) SELECT u.deck_id, coalesce(epoch_us(modified) > epoch_us(updated) + 5000000, false) AS stale FROM u LEFT JOIN f ON u.deck_id = f.deck_id")
def stale_decks(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "sample_deck").groupBy("deck_id").agg(F.max("received_at").alias("modified"))
    return C.stale(slides(spark, folder), files)


@_add("tag_axis_facets", "WITH t AS (SELECT axis || '/' || canonical AS tag FROM tag_list) SELECT split_part(tag, '/', 1) AS axis, count(*) AS n, min(split_part(tag, '/', 2)) AS first_value FROM t GROUP BY 1")
def tag_axis_facets(spark: SparkSession, folder: str) -> DataFrame:
    axis, value = X.tag_axis("tag")
    tags = table(spark, folder, "tag_list").select(F.concat_ws("/", "axis", "canonical").alias("tag"))
    return tags.select(axis.alias("axis"), value.alias("value")).groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value"))


@_add("explode_kind_groups", "WITH k AS (SELECT coalesce(kind, 'other') AS kind FROM documents) SELECT kind, CAST(CASE kind WHEN 'minutes' THEN 1 WHEN 'notes' THEN 2 ELSE 3 END AS INTEGER) AS place, count(*) AS n FROM k GROUP BY kind")
def explode_kind_groups(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.when(F.col("kind").isNotNull(), F.array("kind"))
    return C.kinds_exploded(table(spark, folder, "documents"), kinds, ("minutes", "notes"))


@_add("session_semi_join", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE contains(props, '\"k\": 69'))")
def session_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return C.sessions_with(table(spark, folder, "events"), "user_id", "props", '"k": 69').select("event_id", "user_id")


@_add("task_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type, max(ts) AS ts, count(*) AS events FROM events GROUP BY user_id")
def task_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return C.latest_state(table(spark, folder, "events"), "user_id", "ts", ["event_type"])


_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@_add("task_recovery", f"WITH e AS (SELECT user_id, ts, {_STATUS} AS status FROM events), g AS (SELECT user_id, arg_max(status, (ts, status)) AS status, min(ts) FILTER (WHERE status = 'running') AS started, max(ts) FILTER (WHERE status IN ('done', 'failed')) AS finished FROM e GROUP BY user_id) SELECT user_id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, started, finished FROM g")
def task_recovery(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "ts", F.expr(_STATUS).alias("status"))
    return M.fold_tasks(e, "user_id", "ts", "status")


@_add("oldest_queued", "SELECT user_id, event_id FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def oldest_queued(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("event_type = 'signup'")
    return e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "f.event_id")


@_add("keep_latest_n", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= 3")
def keep_latest_n(spark: SparkSession, folder: str) -> DataFrame:
    return Q.keep_latest(table(spark, folder, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "ts")


@_add("carry_forward_state", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened_by FROM events")
def carry_forward_state(spark: SparkSession, folder: str) -> DataFrame:
    opened = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return Q.carry_forward(table(spark, folder, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], opened, "opened_by").select("event_id", "opened_by")


@_add("visible_renumber", f"WITH {_S} SELECT id, CASE WHEN coalesce(hidden, 0) = 0 THEN row_number() OVER (PARTITION BY deck_id, coalesce(hidden, 0) = 1 ORDER BY page_no NULLS FIRST, row_seq) END AS number FROM s")
def visible_renumber(spark: SparkSession, folder: str) -> DataFrame:
    return Q.renumber(slides(spark, folder), ["deck_id"], [F.col("page_no"), F.col("row_seq")], F.col("hidden") == 1).select("id", "number")


@_add("unique_keys", f"WITH {_S}, n AS (SELECT id, deck_id, type_tag AS base, row_number() OVER (PARTITION BY deck_id, type_tag ORDER BY row_seq) AS n FROM s WHERE type_tag IS NOT NULL), m AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS made FROM n) SELECT id, CASE WHEN n > 1 AND EXISTS (SELECT 1 FROM n o WHERE o.deck_id = m.deck_id AND o.base = m.made) THEN base || '--' || n ELSE made END AS key FROM m")
def unique_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = slides(spark, folder).where("type_tag IS NOT NULL")
    return Q.unique_keys(rows, ["deck_id"], "type_tag", [F.col("row_seq")]).select("id", "key")


# changes: deliveries before 2024 are the old table, all later rows the new one

_OLD = "o AS (SELECT * FROM slides WHERE created_at < TIMESTAMP '2024-01-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_seq) = 1), n AS (SELECT * REPLACE (coalesce(title, '') || ' v2' AS title) FROM slides QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_seq DESC) = 1)"


def _old_new(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "slides")
    old = Q.keep_latest(rows.where("created_at < TIMESTAMP '2024-01-01'"), ["id"], [F.col("row_seq")], 1)
    return old, slides(spark, folder).withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" v2")))


@_add("upsert_preserve", f"WITH {_OLD} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN o.id IS NOT NULL THEN o.type_tag ELSE n.type_tag END AS type_tag, CASE WHEN o.id IS NOT NULL THEN coalesce(n.notes, o.notes) ELSE n.notes END AS notes, CASE WHEN o.id IS NOT NULL THEN o.created_at ELSE n.created_at END AS created_at FROM o FULL JOIN n ON o.id = n.id")
def upsert_preserve(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    merged = M.upsert(old, new, "id", ("deck_id", "slide_key", "page_no", "title", "title_source", "body_text", "hidden", "updated_at"), AXES, ("notes", "thumbnail_path"))
    return merged.select("id", "title", "type_tag", "notes", "created_at")


@_add("insert_ignore_first", "WITH o AS (SELECT hash, filename FROM assets WHERE size_bytes >= 50000), n AS (SELECT DISTINCT asset_hash AS hash, CAST(NULL AS VARCHAR) AS filename FROM slide_assets WHERE asset_hash IS NOT NULL) SELECT * FROM o UNION ALL SELECT * FROM n WHERE hash NOT IN (SELECT hash FROM o)")
def insert_ignore_first(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "assets").where("size_bytes >= 50000").select("hash", "filename")
    new = table(spark, folder, "slide_assets").where("asset_hash IS NOT NULL").select(F.col("asset_hash").alias("hash"), F.lit(None).cast("string").alias("filename"))
    return M.insert_ignore(old, new, ["hash"], "filename")


_KIND_SQL = "CASE WHEN contains(title, '复盘') THEN '复盘' WHEN contains(title, '全景') THEN '全景' END"
_CUST_SQL = "CASE WHEN contains(title, '门店') THEN '门店' WHEN contains(title, '会员') THEN '会员' END"


@_add("propagate_last_first", f"WITH {_S}, {_ST}, k AS (SELECT *, {_CUST_SQL} AS cust, {_KIND_SQL} AS kind FROM st), m AS (SELECT s.id, arg_max(k.cust, (k.created_at, k.id)) FILTER (WHERE k.cust IS NOT NULL) AS c, arg_min(k.kind, (k.created_at, k.id)) FILTER (WHERE k.kind IS NOT NULL) AS t FROM k JOIN s ON k.deck_id = s.deck_id AND s.page_no BETWEEN k.start_page AND k.end_page GROUP BY s.id) SELECT s.id, coalesce(c, customer_tag) AS customer_tag, CASE WHEN type_tag IS NULL OR type_tag IN ('待分类', 'misc') THEN coalesce(t, type_tag) ELSE type_tag END AS type_tag FROM s LEFT JOIN m ON s.id = m.id")
def propagate_last_first(spark: SparkSession, folder: str) -> DataFrame:
    return M.propagate(slides(spark, folder), stories(spark, folder), X.first_contained("title", ["门店", "会员"]), X.first_contained("title", ["复盘", "全景"]), ["待分类", "misc"], "created_at")


@_add("flag_needs_review", f"WITH {_S}, {_ST}, t AS (SELECT id, deck_id, page_no, {_TAGS} AS tags FROM s), f AS (SELECT *, NOT EXISTS (SELECT 1 FROM st WHERE st.deck_id = t.deck_id AND t.page_no BETWEEN st.start_page AND st.end_page) AS lone FROM t) SELECT id, array_to_string(CASE WHEN lone AND NOT list_contains(tags, 'needs review') THEN list_append(tags, 'needs review') ELSE tags END, ',') AS tags FROM f")
def flag_needs_review(spark: SparkSession, folder: str) -> DataFrame:
    rows = slides(spark, folder).withColumn("tags", X.lenient_list("free_tags"))
    return M.flag_orphans(rows, stories(spark, folder), "needs review").select("id", F.array_join("tags", ",").alias("tags"))


@_add("weak_title_stub", f"WITH {_S} SELECT id, CASE WHEN w THEN '(p' || coalesce(CAST(page_no AS VARCHAR), '?') || ' · untitled)' ELSE title END AS title, CASE WHEN w THEN 'stub' ELSE title_source END AS title_source FROM (SELECT *, coalesce(bare IN ('', '(empty)') OR try_cast(rtrim(rtrim(bare, '%')) AS DOUBLE) IS NOT NULL AND regexp_full_match(bare, '[0-9][0-9.]*\\s*%?') OR starts_with(bare, chr(65532)), true) AS w FROM (SELECT *, regexp_replace(title, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS bare FROM s))")
def weak_title_stub(spark: SparkSession, folder: str) -> DataFrame:
    w = X.weak_title("title")
    stub = F.concat(F.lit("(p"), F.coalesce(F.col("page_no").cast("string"), F.lit("?")), F.lit(" · untitled)"))
    return slides(spark, folder).select("id", F.when(w, stub).otherwise(F.col("title")).alias("title"), F.when(w, "stub").otherwise(F.col("title_source")).alias("title_source"))


@_add("csv_update", f"WITH {_S} SELECT id, NULLIF(upper(coalesce(type_tag, '')), '') AS type_tag, NULLIF(coalesce(notes, ''), '') AS notes, title FROM s")
def csv_update(spark: SparkSession, folder: str) -> DataFrame:
    """An edited table comes back: written columns replace, the empty cell clears, other columns stay."""
    rows = slides(spark, folder)
    edited = rows.select("id", F.upper(F.coalesce("type_tag", F.lit(""))).alias("type_tag"), F.coalesce("notes", F.lit("")).alias("notes"))
    return M.update_given(rows, edited, "id", ["type_tag", "notes"], empty_is_null=True).select("id", "type_tag", "notes", "title")


@_add("delete_cascade", f"WITH {_S} SELECT slide_id, asset_hash, iwa_data_id FROM slide_assets WHERE slide_id NOT IN (SELECT id FROM s WHERE hidden = 1)")
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    rows = slides(spark, folder)
    _, links = M.delete_cascade(rows, table(spark, folder, "slide_assets"), rows.where("hidden = 1"), "id", "slide_id")
    return links.select("slide_id", "asset_hash", "iwa_data_id")


@_add("key_set_diff", f"WITH {_OLD} SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'missing' WHEN o.id IS NULL THEN 'extra' WHEN o.page_no IS NOT DISTINCT FROM n.page_no AND o.body_text IS NOT DISTINCT FROM n.body_text THEN 'same' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.id = n.id")
def key_set_diff(spark: SparkSession, folder: str) -> DataFrame:
    old, new = _old_new(spark, folder)
    return M.compare_keys(old, new, ["id"], ["page_no", "body_text"])


@_add("duplicate_ids", "SELECT id, count(*) AS n FROM slides GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return M.duplicated(table(spark, folder, "slides"), ["id"])


@_add("dangling_refs", "SELECT slide_id, asset_hash FROM slide_assets WHERE asset_hash IS NULL OR asset_hash NOT IN (SELECT hash FROM assets)")
def dangling_refs(spark: SparkSession, folder: str) -> DataFrame:
    return M.dangling(table(spark, folder, "slide_assets"), table(spark, folder, "assets"), "asset_hash", "hash").select("slide_id", "asset_hash")


@_add("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """An extra on the event table: the batch form of the windowed stream."""
    from ..streaming.tasks import windowed_counts

    return windowed_counts(table(spark, folder, "events"), "ts", "event_type")
