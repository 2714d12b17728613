"""Queries on content: texts, markup, near-duplicate evidence, nested documents, files and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import files as P
from ..operators import lookups as K
from ..operators import matching as N
from ..operators import measures as V
from ..operators import sequence as Q
from ..operators import spatial as B
from ..session import ship, table
from . import Query
from .catalogue import _S, slides, token_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# markup made from the slides' own fields, the same way on both sides
_HTML = """'<style>p{a>b}</style><div style="font-size:' || (28 + page_no % 9) || 'px">' || coalesce(title, '') || '</div><h2>' || coalesce(title, '') || '<br/>' || deck_id || '</h2><p>' || coalesce(body_text, '') || '&nbsp;&amp;lt;</p>' || CASE media_tag WHEN '图文' THEN '<img src="../a/' || slide_key || '.png?v=1"><img src="https://x.y/z.png">' WHEN '视频' THEN '<video poster="' || coalesce(thumbnail_path, 'none.png') || '" src="v/' || slide_key || '.mp4#t"></video>' ELSE '' END"""
_H = f"{_S}, h AS (SELECT id, deck_id, slide_key, page_no, title, body_text, media_tag, {_HTML} AS html FROM s)"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).withColumn("html", F.expr(_HTML))


def _strip(x: str) -> str:
    s = f"regexp_replace({x}, '<style[^>]*>.*?</style>', ' ', 'gis')"
    s = f"regexp_replace({s}, '<script[^>]*>.*?</script>', ' ', 'gis')"
    s = f"regexp_replace({s}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        s = f"replace({s}, '{a}', '{b}')"
    return f"trim(regexp_replace({s}, '[\\s\\p{{Z}}\\x0b\\x85]+', ' ', 'g'), ' ')"


@_add("strip_html", f"WITH {_H} SELECT id, {_strip('html')} AS text FROM h")
def strip_html(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("id", X.strip_html("html").alias("text"))


@_add("media_counts", f"WITH {_H} SELECT id, CAST(len(regexp_extract_all(html, '(?i)<img\\b')) AS INTEGER) AS images, CAST(len(regexp_extract_all(html, '(?i)<video\\b')) AS INTEGER) AS videos, CASE WHEN regexp_matches(html, '(?i)<video\\b') THEN 'video' WHEN NOT regexp_matches(html, '(?i)<img\\b') AND length(coalesce(body_text, '')) > 0 THEN 'text' ELSE 'mixed' END AS media FROM h")
def media_counts(spark: SparkSession, folder: str) -> DataFrame:
    images, videos = X.media_counts("html")
    length = F.length(F.coalesce("body_text", F.lit("")))
    return pages(spark, folder).select("id", images.alias("images"), videos.alias("videos"), X.media_tag(images, videos, length).alias("media"))


_SIZED = "(?is)<(?:div|h1|h2|h3|p|span)\\b[^>]*?font-size\\s*:\\s*([0-9.]+)px[^>]*>(.*)"
_CAND = f"{_H}, c AS (SELECT id, coalesce(body_text, '') AS b, list_transform(string_split_regex(html, '(?i)</(?:div|h1|h2|h3|p|span)>')[:-2], lambda x: {{'px': try_cast(regexp_extract(x, '{_SIZED}', 1) AS DOUBLE), 't': {_strip(f"regexp_extract(x, '{_SIZED}', 2)")}}}) AS l FROM h), q AS (SELECT id, b, list_filter(l, lambda x: x.px >= 30 AND length(x.t) BETWEEN 2 AND 80 AND NOT contains(x.t, 'Confidential')) AS l FROM c), g AS (SELECT *, len(l) > 0 AS good, list_filter(l, lambda x: x.px = list_max(list_transform(l, lambda y: y.px)))[1].t AS t, trim(split_part(b, '。', 1), ' ') AS f FROM q)"


@_add("title_extract", f"WITH {_CAND} SELECT id, CASE WHEN good THEN t WHEN f <> '' THEN substring(f, 1, 80) WHEN b <> '' THEN substring(b, 1, 40) ELSE '(empty)' END AS title, CASE WHEN good THEN 'extracted' ELSE 'auto-summary' END AS source FROM g")
def title_extract(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("id", X.styled_title("html", "body_text", ("Confidential",)).alias("t")).select("id", "t.title", "t.source")


_H2 = _strip("regexp_replace(regexp_extract(html, '(?is)<h2\\b[^>]*>(.*?)</h2>', 1), '(?i)<br\\s*/?>', ' / ', 'g')")


@_add("heading_title", f"WITH {_H} SELECT id, coalesce(NULLIF(substring({_H2}, 1, 100), ''), slide_key) AS title FROM h")
def heading_title(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("id", X.heading_title("html", F.col("slide_key")).alias("title"))


_TYPES = {"方法": ("机制", "模型", "method"), "数据": ("指标", "数据", "report"), "案例": ("门店", "store", "customer")}


def _votes(cols: tuple[str, ...]) -> str:
    rows = []
    for i, (label, words) in enumerate(_TYPES.items()):
        n = " + ".join("CAST(" + " OR ".join(f"contains(coalesce({c}, ''), '{w}')" for c in cols) + " AS INTEGER)" for w in words)
        rows.append(f"{{'n': {n}, 'o': {-i}, 'l': '{label}'}}")
    best = f"list_max([{', '.join(rows)}])"
    return f"CASE WHEN {best}.n > 0 THEN {best}.l END"


@_add("tag_vote_type", f"WITH {_S}, p AS (SELECT *, count(*) OVER (PARTITION BY deck_id) AS pages FROM s) SELECT id, CASE WHEN page_no = 1 THEN 'cover' WHEN page_no = pages THEN 'end' WHEN length(coalesce(body_text, '')) < 40 AND length(coalesce(title, '')) > 0 THEN 'section' ELSE coalesce({_votes(('body_text', 'title'))}, 'other') END AS type FROM p")
def tag_vote_type(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    p = s.join(s.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages")), "deck_id")
    return p.select("id", X.page_type("body_text", "title", "page_no", "pages", _TYPES).alias("type"))


@_add("tag_vote_subtype", f"WITH {_S} SELECT id, {_votes(('body_text', 'title'))} AS subtype FROM s")
def tag_vote_subtype(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).select("id", X.vote(["body_text", "title"], _TYPES).alias("subtype"))


@_add("first_dictionary_match", "SELECT doc_id, CASE WHEN contains(text, '采购审批') THEN '采购审批' WHEN contains(text, '门店') THEN '门店' WHEN contains(text, 'warehouse') THEN 'warehouse' END AS found FROM documents")
def first_dictionary_match(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.first_contained("text", ["采购审批", "门店", "warehouse"]).alias("found"))


@_add("tokenize", f"SELECT doc_id, array_to_string(list_sort({token_sql('text')}), ' ') AS tokens, CAST(len({token_sql('text')}) AS INTEGER) AS n FROM documents")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    t = X.tokens("text")
    return table(spark, folder, "documents").select("doc_id", F.array_join(F.array_sort(t), " ").alias("tokens"), F.size(t).alias("n"))


@_add("slug_titles", f"WITH {_S} SELECT id, CASE WHEN x = '' THEN 'story' ELSE x END AS slug FROM (SELECT id, lower(array_to_string(regexp_extract_all(replace(title, '门店', '-store'), '[A-Za-z0-9_/]+'), '-')) AS x FROM s)")
def slug_titles(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).select("id", X.slug("title", {"门店": "store"}).alias("slug"))


@_add("slide_refs", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(text, '#(\\d+)', 1), regexp_extract_all(text, 'slide-(\\d+)', 1)), lambda x: try_cast(x AS BIGINT)))), ',') AS refs FROM documents WHERE text IS NOT NULL")
def slide_refs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(X.slide_refs("text"), ",").alias("refs"))


_CONFIRM = "^(ok|done|go|好的?|可以)[\\s。,.!?~-]*$"


@_add("prompt_type_counts", f"WITH p AS (SELECT trim(body_text) AS s FROM slides WHERE body_text IS NOT NULL), k AS (SELECT CASE WHEN length(s) < 30 AND regexp_matches(s, '{_CONFIRM}') THEN 'confirm' WHEN regexp_matches(s, '^第\\d+页') THEN 'add' WHEN contains(s, '减少') OR contains(s, 'cut') THEN 'delete' WHEN contains(s, '更新') OR contains(s, '改进') OR contains(s, 'replaced') THEN 'edit' ELSE 'meta' END AS kind FROM p) SELECT kind, count(*) AS n FROM k GROUP BY kind")
def prompt_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    kind = X.classify("body_text", _CONFIRM, {"add": r"^第\d+页"}, {"delete": ("减少", "cut"), "edit": ("更新", "改进", "replaced")})
    return table(spark, folder, "slides").where("body_text IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_add("rounded_geometry", "SELECT slide_id, iwa_data_id, CAST(round_even(iwa_data_id / 10, 0) * 10 AS INTEGER) AS rounded FROM slide_assets WHERE iwa_data_id IS NOT NULL")
def rounded_geometry(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "slide_assets").where("iwa_data_id IS NOT NULL").select("slide_id", "iwa_data_id", X.round_to("iwa_data_id", 10).alias("rounded"))


# near-duplicate evidence: evaluation items are the incoming pages, documents the library

_A = f"a AS (SELECT item_id AS page, {token_sql('text')} AS t FROM eval_items), b AS (SELECT doc_id AS slide, {token_sql('text')} AS t FROM documents), aa AS (SELECT page, len(t) AS n, unnest(t) AS x FROM a WHERE len(t) >= 5), bb AS (SELECT slide, len(t) AS n, unnest(t) AS x FROM b WHERE len(t) > 0), c AS (SELECT page, slide, aa.n AS n, bb.n AS m, count(*) AS k FROM aa JOIN bb ON aa.x = bb.x GROUP BY 1, 2, 3, 4), j AS (SELECT page, slide, k / (n + m - k) AS jaccard, k / least(n, m) AS overlap FROM c)"
_J = _A + ", pairs AS (SELECT * FROM j WHERE jaccard >= 0.2 OR overlap >= 0.4)"
_J6 = _A + ", pairs AS (SELECT * FROM j WHERE jaccard >= 0.6 OR overlap >= 0.8)"


def _sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, folder, "eval_items").select(F.col("item_id").alias("page"), X.tokens("text").alias("tokens")).where("size(tokens) >= 5")
    return a, table(spark, folder, "documents").select(F.col("doc_id").alias("slide"), X.tokens("text").alias("tokens"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("page", "slide", F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


@_add("similar_inverted", f"WITH {_J} SELECT page, slide, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM pairs")
def similar_inverted(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(N.query_pairs(*_sets(spark, folder)))


@_add("similar_joined", f"WITH {_J} SELECT page, slide, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM pairs")
def similar_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of similar_inverted by `token_pairs`, in which both sides stay distributed."""
    return _rounded(N.token_pairs(*_sets(spark, folder)))


@_add("jaccard_overlap_pairs", f"WITH {_J6} SELECT page, slide, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM pairs")
def jaccard_overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(N.query_pairs(*_sets(spark, folder), 0.6, 0.8))


@_add("similar_topk", f"WITH {_J} SELECT page, slide, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY round(greatest(jaccard, overlap), 9) DESC, slide) AS INTEGER) AS rank FROM pairs) WHERE rank <= 3")
def similar_topk(spark: SparkSession, folder: str) -> DataFrame:
    order = table(spark, folder, "documents").select(F.col("doc_id").alias("slide"), F.col("doc_id").alias("row_seq"))
    return N.best_per_page(N.query_pairs(*_sets(spark, folder)), order, 3).select("page", "slide", "rank")


@_add("exact_hash_match", "SELECT substring(sha256(text), 1, 16) AS text_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_hash_match(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1").select(F.substring("h", 1, 16).alias("text_hash"), "copies", "first_doc")


_TIERS = (("uuid", "iwa_uuid"), ("structural", "element_sig"), ("template", "template_sig"))
_TI = f"{_S}, m AS (" + " UNION ALL ".join(f"SELECT id, row_seq, '{t}' AS tier, {i} AS place, match FROM (SELECT id, row_seq, first_value(id) OVER w AS match, first_value(row_seq) OVER w AS f FROM s WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY {c} ORDER BY row_seq)) WHERE f < row_seq" for i, (t, c) in enumerate(_TIERS)) + ")"


def _tiers(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    return N.tier_matches(s, s, "id", _TIERS, "row_seq", earlier=True)


@_add("all_tiers_match", f"WITH {_TI} SELECT id, tier, match FROM m")
def all_tiers_match(spark: SparkSession, folder: str) -> DataFrame:
    return _tiers(spark, folder).select("id", "tier", "match")


@_add("first_tier_match", f"WITH {_TI} SELECT id, tier, match FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1")
def first_tier_match(spark: SparkSession, folder: str) -> DataFrame:
    return N.first_tier(_tiers(spark, folder), ["id"], [t for t, _ in _TIERS])


@_add("tier_tally", f"WITH {_TI}, f AS (SELECT id, tier FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1) SELECT coalesce(tier, 'none') AS tier, count(*) AS n FROM s LEFT JOIN f ON s.id = f.id GROUP BY 1")
def tier_tally(spark: SparkSession, folder: str) -> DataFrame:
    best = first_tier_match(spark, folder).select("id", "tier")
    return slides(spark, folder).select("id").join(best, "id", "left").groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@_add("asset_reuse_filter", "SELECT asset_hash, count(DISTINCT slide_id) AS slides FROM slide_assets WHERE asset_hash IS NOT NULL GROUP BY asset_hash HAVING count(DISTINCT slide_id) >= 3")
def asset_reuse_filter(spark: SparkSession, folder: str) -> DataFrame:
    return N.reused(table(spark, folder, "slide_assets"), "asset_hash", "slide_id", 3)


_EXT = (".png", ".jpg", ".jpeg", ".mp4", ".svg")


@_add("shared_assets", f"WITH {_S}, c AS (SELECT asset_hash FROM slide_assets WHERE asset_hash IS NOT NULL GROUP BY asset_hash HAVING count(DISTINCT slide_id) >= 3), w AS (SELECT hash FROM assets WHERE size_bytes >= 51200 AND lower(CASE WHEN starts_with(ext, '.') THEN ext ELSE '.' || ext END) IN {_EXT}), u AS (SELECT DISTINCT asset_hash, slide_id, s.deck_id FROM slide_assets l JOIN s ON l.slide_id = s.id WHERE asset_hash IN (SELECT hash FROM w) AND asset_hash NOT IN (SELECT asset_hash FROM c)) SELECT a.asset_hash, a.slide_id AS slide_a, b.slide_id AS slide_b FROM u a JOIN u b ON a.asset_hash = b.asset_hash AND a.slide_id < b.slide_id AND a.deck_id <> b.deck_id")
def shared_assets(spark: SparkSession, folder: str) -> DataFrame:
    return N.shared_assets(table(spark, folder, "slide_assets"), table(spark, folder, "assets"), slides(spark, folder), 50 * 1024, _EXT)


_SENT = r"[。.!?！？\n]+"
_CH = _J + f", x AS (SELECT page, slide FROM pairs), sa AS (SELECT DISTINCT item_id AS page, trim(unnest(regexp_split_to_array(text, '{_SENT}')), ' ') AS q FROM eval_items), sb AS (SELECT DISTINCT doc_id AS slide, trim(unnest(regexp_split_to_array(text, '{_SENT}')), ' ') AS q FROM documents), y AS (SELECT DISTINCT page, slide FROM sa JOIN sb ON sa.q = sb.q WHERE length(sa.q) >= 20), u AS (SELECT page, slide, 'text' AS ch, 4 AS w FROM x UNION ALL SELECT page, slide, 'sentence', 2 FROM y), g AS (SELECT page, slide, string_agg(ch, ',' ORDER BY w DESC) AS channels, CAST(sum(w) AS INTEGER) AS score FROM u GROUP BY page, slide)"


def _sentences(df: DataFrame, key: str, name: str) -> DataFrame:
    q = df.select(F.col(key).alias(name), F.explode(F.split("text", _SENT)).alias("q")).select(name, F.trim("q").alias("q"))
    return q.where("length(q) >= 20").distinct()


@_add("unified_candidates", f"WITH {_CH} SELECT * FROM g")
def unified_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Two kinds of evidence between evaluation items and documents, similar tokens and shared sentences, one row per candidate; `unified_probe` has the five channels of slides."""
    text = N.query_pairs(*_sets(spark, folder)).select("page", "slide")
    shared = _sentences(table(spark, folder, "eval_items"), "item_id", "page").join(_sentences(table(spark, folder, "documents"), "doc_id", "slide"), "q").select("page", "slide")
    return N.unify({"text": text, "sentence": shared}, ["page", "slide"], {"text": 4, "sentence": 2})


@_add("candidate_rank", f"WITH {_CH} SELECT page, slide, score, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, slide) AS INTEGER) AS rank FROM g QUALIFY rank <= 10")
def candidate_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The rank of every candidate of a page. The SQL still ends at rank 10: its rows are those of this query with a rank up to 10."""
    order = Window.partitionBy("page").orderBy(F.desc("score"), "slide")
    return unified_candidates(spark, folder).select("page", "slide", "score", F.row_number().over(order).alias("rank"))


@_add("candidate_ranks_all", f"WITH {_CH} SELECT page, slide, score, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, slide) AS INTEGER) AS rank FROM g")
def candidate_ranks_all(spark: SparkSession, folder: str) -> DataFrame:
    """candidate_rank beside SQL that ranks every candidate too."""
    return candidate_rank(spark, folder)


_WEIGHTS = {"uuid": 10, "structural": 8, "template": 6, "text": 4, "asset": 2}
_PR = (
    f"{_S}, p AS (SELECT * FROM s WHERE deck_id = (SELECT deck_id FROM s WHERE deck_id IS NOT NULL ORDER BY row_seq DESC LIMIT 1)), l AS (SELECT * FROM s WHERE id NOT IN (SELECT id FROM p)), "
    + "t AS ("
    + " UNION ALL ".join(f"SELECT p.id AS page, f.slide, '{t}' AS ch, {_WEIGHTS[t]} AS w FROM p JOIN (SELECT {c} AS v, arg_min(id, row_seq) AS slide FROM l WHERE {c} IS NOT NULL GROUP BY {c}) f ON p.{c} = f.v WHERE p.element_sig IS NOT NULL" for t, c in _TIERS)
    + f"), pt AS (SELECT id, {token_sql('body_text')} AS t FROM p), lt AS (SELECT id, {token_sql('body_text')} AS t FROM l), pu AS (SELECT id, len(t) AS n, unnest(t) AS x FROM pt WHERE len(t) >= 5), lu AS (SELECT id, len(t) AS n, unnest(t) AS x FROM lt), k AS (SELECT pu.id AS page, lu.id AS slide, pu.n AS n, lu.n AS m, count(*) AS k FROM pu JOIN lu ON pu.x = lu.x GROUP BY 1, 2, 3, 4), "
    + f"c AS (SELECT asset_hash FROM slide_assets WHERE asset_hash IS NOT NULL GROUP BY asset_hash HAVING count(DISTINCT slide_id) >= 3), w AS (SELECT hash FROM assets WHERE size_bytes >= 51200 AND lower(CASE WHEN starts_with(ext, '.') THEN ext ELSE '.' || ext END) IN {_EXT}), a AS (SELECT DISTINCT asset_hash, slide_id FROM slide_assets WHERE asset_hash IN (SELECT hash FROM w) AND asset_hash NOT IN (SELECT asset_hash FROM c)), "
    + "u AS (SELECT * FROM t UNION SELECT page, slide, 'text', 4 FROM k WHERE k / (n + m - k) >= 0.2 OR k / least(n, m) >= 0.4 UNION SELECT x.slide_id, y.slide_id, 'asset', 2 FROM a x JOIN a y ON x.asset_hash = y.asset_hash WHERE x.slide_id IN (SELECT id FROM p) AND y.slide_id IN (SELECT id FROM l)), "
    + "g AS (SELECT page, slide, string_agg(ch, ',' ORDER BY w DESC) AS channels, CAST(sum(w) AS INTEGER) AS score FROM u GROUP BY page, slide)"
)


@_add("unified_probe", f"WITH {_PR} SELECT page, slide, channels, score, CAST(row_number() OVER (PARTITION BY page ORDER BY score DESC, slide) AS INTEGER) AS rank FROM g")
def unified_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate for the pages of the newest deck among the slides of all others, over all five channels, and its rank.

    The deck of the last row is the incoming one. As in the reference a page without a structural signature has no signature channels,
    each of these names the first slide that matches, and a page with fewer than five tokens has no text channel.
    """
    s = slides(spark, folder)
    newest = s.where("deck_id IS NOT NULL").agg(F.max_by("deck_id", "row_seq").alias("deck_id"))
    pages, library = s.join(newest, "deck_id", "left_semi"), s.join(newest, "deck_id", "left_anti")
    tiers = N.tier_matches(pages.where("element_sig IS NOT NULL"), library, "id", _TIERS, "row_seq").select(F.col("id").alias("page"), "tier", F.col("match").alias("slide"))
    a, b = (x.select(F.col("id").alias(name), X.tokens("body_text").alias("tokens")) for x, name in ((pages, "page"), (library, "slide")))
    shared = N.shared_assets(table(spark, folder, "slide_assets"), table(spark, folder, "assets"), s, 50 * 1024, _EXT)
    both = shared.select(F.col("slide_a").alias("page"), F.col("slide_b").alias("slide")).unionByName(shared.select(F.col("slide_b").alias("page"), F.col("slide_a").alias("slide")))
    channels = {t: tiers.where(F.col("tier") == t).select("page", "slide") for t, _ in _TIERS}
    channels |= {"text": N.query_pairs(a.where("size(tokens) >= 5"), b).select("page", "slide"), "asset": both.join(pages.select(F.col("id").alias("page")), "page", "left_semi")}
    order = Window.partitionBy("page").orderBy(F.desc("score"), "slide")
    return N.unify(channels, ["page", "slide"], _WEIGHTS).withColumn("rank", F.row_number().over(order))


@_add("target_popularity", f"WITH {_J6} SELECT slide, count(*) AS hits FROM pairs GROUP BY slide ORDER BY hits DESC, slide LIMIT 10")
def target_popularity(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most hit documents: the length of the report is the feature."""
    return N.popularity(N.query_pairs(*_sets(spark, folder), 0.6, 0.8), "slide", 10)


@_add("channel_precision", f"WITH {_TI}, l AS (SELECT id, CASE WHEN title_source = 'extracted' THEN 'S' WHEN title_source = 'auto-summary' THEN 'L' WHEN title IS NULL THEN '?' ELSE 'N' END AS label FROM s) SELECT tier AS channel, count(*) FILTER (WHERE label IN ('S', 'L')) AS good, count(*) FILTER (WHERE label = 'N') AS bad, count(*) FILTER (WHERE label = '?') AS unlabelled, CASE WHEN count(*) FILTER (WHERE label <> '?') > 0 THEN round(count(*) FILTER (WHERE label IN ('S', 'L')) / count(*) FILTER (WHERE label <> '?'), 6) END AS precision FROM m JOIN l ON m.id = l.id GROUP BY tier")
def channel_precision(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("title_source") == "extracted", "S").when(F.col("title_source") == "auto-summary", "L").when(F.col("title").isNull(), "?").otherwise("N")
    labels = slides(spark, folder).select("id", label.alias("label"))
    return N.precision(_tiers(spark, folder).select("id", F.col("tier").alias("channel")), labels, ["id"], ("S", "L"), ("N",))


# nested documents


@_add("json_path_get", "SELECT file_id, doc->>'$.deck.title' AS title, doc->>'$.slides[1].layout' AS second_layout FROM (SELECT file_id, CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS doc FROM sample_deck) WHERE doc IS NOT NULL")
def json_path_get(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "sample_deck").where(F.try_parse_json("doc").isNotNull())
    return d.select("file_id", D.get_path("doc", "deck.title").alias("title"), D.get_path("doc", "slides.1.layout").alias("second_layout"))


DECK_SCHEMA = {
    "type": "object",
    "required": ["version", "deck", "slides"],
    "properties": {
        "version": {"enum": ["1.0", "2"]},
        "deck": {"type": "object", "required": ["title", "language"], "properties": {"title": {"type": "string", "minLength": 1}, "language": {"enum": ["zh", "en", "bilingual"]}}},
        "slides": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/slide"}},
    },
    "$defs": {"slide": {"type": "object", "required": ["key", "layout", "data"], "properties": {"key": {"type": "string", "pattern": "^[a-z]+-\\d+$"}, "layout": {"type": "string"}, "data": {"type": "object"}}}},
}


_BROKEN = """v AS (SELECT file_id, CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS j FROM sample_deck WHERE doc IS NOT NULL),
o AS (SELECT file_id, j, j->'version' AS version, j->'deck' AS deck, j->'slides' AS slides FROM v WHERE json_type(j) = 'OBJECT'),
l AS (SELECT file_id, CAST(slides AS JSON[]) AS a FROM o WHERE json_type(slides) = 'ARRAY'),
i AS (SELECT file_id, unnest(a) AS x, '$.slides[' || (generate_subscripts(a, 1) - 1) || ']' AS p FROM l),
k AS (SELECT *, x->'key' AS key, x->'layout' AS layout, x->'data' AS data FROM i WHERE json_type(x) = 'OBJECT'),
b AS (SELECT file_id, '$' AS path, 'json' AS rule FROM v WHERE j IS NULL
UNION ALL SELECT file_id, '$', 'type' FROM v WHERE json_type(j) <> 'OBJECT'
UNION ALL SELECT file_id, '$.' || n, 'required' FROM o, (VALUES ('version'), ('deck'), ('slides')) r(n) WHERE json_extract(j, n) IS NULL
UNION ALL SELECT file_id, '$.version', 'enum' FROM o WHERE version IS NOT NULL AND NOT (json_type(version) = 'VARCHAR' AND (version->>'$') IN ('1.0', '2'))
UNION ALL SELECT file_id, '$.deck', 'type' FROM o WHERE json_type(deck) <> 'OBJECT'
UNION ALL SELECT file_id, '$.deck.' || n, 'required' FROM o, (VALUES ('title'), ('language')) r(n) WHERE json_type(deck) = 'OBJECT' AND json_extract(deck, n) IS NULL
UNION ALL SELECT file_id, '$.deck.title', CASE WHEN json_type(deck->'title') = 'VARCHAR' THEN 'minLength' ELSE 'type' END FROM o WHERE json_type(deck) = 'OBJECT' AND (deck->'title') IS NOT NULL AND NOT (json_type(deck->'title') = 'VARCHAR' AND (deck->>'title') <> '')
UNION ALL SELECT file_id, '$.deck.language', 'enum' FROM o WHERE json_type(deck) = 'OBJECT' AND (deck->'language') IS NOT NULL AND NOT (json_type(deck->'language') = 'VARCHAR' AND (deck->>'language') IN ('zh', 'en', 'bilingual'))
UNION ALL SELECT file_id, '$.slides', 'type' FROM o WHERE json_type(slides) <> 'ARRAY'
UNION ALL SELECT file_id, '$.slides', 'minItems' FROM l WHERE len(a) = 0
UNION ALL SELECT file_id, p, 'type' FROM i WHERE coalesce(json_type(x), 'NULL') <> 'OBJECT'
UNION ALL SELECT file_id, p || '.' || n, 'required' FROM k, (VALUES ('key'), ('layout'), ('data')) r(n) WHERE json_extract(x, n) IS NULL
UNION ALL SELECT file_id, p || '.key', CASE WHEN json_type(key) = 'VARCHAR' THEN 'pattern' ELSE 'type' END FROM k WHERE key IS NOT NULL AND NOT (json_type(key) = 'VARCHAR' AND regexp_full_match((key->>'$'), '[a-z]+-\\d+'))
UNION ALL SELECT file_id, p || '.layout', 'type' FROM k WHERE json_type(layout) <> 'VARCHAR'
UNION ALL SELECT file_id, p || '.data', 'type' FROM k WHERE json_type(data) <> 'OBJECT')"""


@_add("schema_violations", f"WITH {_BROKEN} SELECT * FROM b")
def schema_violations(spark: SparkSession, folder: str) -> DataFrame:
    return D.violations(table(spark, folder, "sample_deck"), "file_id", "doc", DECK_SCHEMA)


_RULES = [("type", "shape", "error"), ("required", "shape", "error"), ("enum", "values", "warning"), ("json", "file", "error")]
_KNOWN = f"{_BROKEN}, r(rule, family, severity) AS (VALUES {', '.join(map(str, _RULES))})"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "rule string, family string, severity string")


@_add("rules_gate", f"WITH {_KNOWN}, g AS (SELECT file_id, path, coalesce(family, 'uncategorized') AS family, coalesce(severity = 'error', false) AS bad FROM b LEFT JOIN r USING (rule)), t AS (SELECT file_id, family, count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad) AS warnings, list_sort(list_distinct(list(path))) AS p FROM g GROUP BY 1, 2) SELECT file_id, family, errors, warnings, array_to_string(p[1:10], ',') AS locations FROM t")
def rules_gate(spark: SparkSession, folder: str) -> DataFrame:
    return D.gate(schema_violations(spark, folder), _rules(spark), "file_id")


@_add("rules_by_code", f"WITH {_KNOWN} SELECT rule, family, 'error' AS severity, count(DISTINCT file_id) AS documents, count(*) AS violations FROM b JOIN r USING (rule) GROUP BY 1, 2")
def rules_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """The tally under strict rules, which make every known code an error."""
    return D.by_code(schema_violations(spark, folder), _rules(spark), strict=True)


@_add("documents_passing", f"WITH {_KNOWN} SELECT DISTINCT file_id, file_id NOT IN (SELECT file_id FROM b JOIN r USING (rule) WHERE severity = 'error') AS passed FROM sample_deck WHERE file_id IS NOT NULL")
def documents_passing(spark: SparkSession, folder: str) -> DataFrame:
    return D.passes(schema_violations(spark, folder), _rules(spark), table(spark, folder, "sample_deck"), "file_id")


@_add("document_set_path", "WITH v AS (SELECT file_id, CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS j FROM sample_deck) SELECT file_id, CASE WHEN json_type(j) = 'OBJECT' AND coalesce(json_type(j->'deck'), '') <> 'ARRAY' THEN 'final' END AS mode, CASE WHEN json_type(j->'deck') = 'OBJECT' THEN j->'deck'->>'title' END AS title FROM v")
def document_set_path(spark: SparkSession, folder: str) -> DataFrame:
    new = D.set_path(table(spark, folder, "sample_deck").select("file_id", "doc"), "doc", "deck.mode", "final")
    return new.select("file_id", D.get_path("doc", "deck.mode").alias("mode"), D.get_path("doc", "deck.title").alias("title"))


@_add("deck_slide_list", "SELECT file_id, CAST(u.i - 1 AS INTEGER) AS slide_pos, u.x->>'$.key' AS key, u.x->>'$.layout' AS layout FROM (SELECT file_id, unnest(list_zip(range(1, len(v) + 1), v)) AS z FROM (SELECT file_id, CAST(CAST(doc AS JSON)->'$.slides' AS JSON[]) AS v FROM sample_deck WHERE json_valid(doc))) q, LATERAL (SELECT z[1] AS i, z[2] AS x) u WHERE u.x->>'$.key' IS NOT NULL")
def deck_slide_list(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.shred import deck_slides

    ship(spark)
    return deck_slides(table(spark, folder, "sample_deck")).select("file_id", "slide_pos", "key", "layout").where("key IS NOT NULL")


@_add("slide_array_edits", f"WITH {_S}, d AS (SELECT deck_id, list(slide_key ORDER BY page_no, row_seq) AS keys FROM s WHERE page_no IS NOT NULL GROUP BY deck_id) SELECT deck_id, array_to_string(list_concat(list_concat(list_slice(keys, 1, 1), ['new-1']), list_slice(keys, 2, len(keys))), ',') AS keys FROM d")
def slide_array_edits(spark: SparkSession, folder: str) -> DataFrame:
    keys = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "row_seq", "slide_key"))), lambda x: x["slide_key"])
    d = slides(spark, folder).where("page_no IS NOT NULL").groupBy("deck_id").agg(keys.alias("keys"))
    return d.select("deck_id", F.array_join(D.splice(F.col("keys"), 1, F.array(F.lit("new-1"))), ",").alias("keys"))


# files


@_add("html_refs", f"WITH {_H}, r AS (SELECT id, unnest(regexp_extract_all(html, '(?i)(?:src|href|poster|data-src)\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS ref FROM h) SELECT DISTINCT id, regexp_replace(regexp_replace(ref, '[?#].*$', ''), '^(?:\\./)+', '') AS path FROM r WHERE NOT regexp_matches(ref, '(?i)^(?:[a-z][a-z0-9+.-]*:|//|#|$)')")
def html_refs(spark: SparkSession, folder: str) -> DataFrame:
    return P.references(pages(spark, folder), "id", "html")


@_add("missing_files", SQL["html_refs"].replace("SELECT DISTINCT id,", ", q AS (SELECT DISTINCT id,") + ") SELECT id, path FROM q WHERE path NOT IN (SELECT thumbnail_path FROM slides WHERE thumbnail_path IS NOT NULL)")
def missing_files(spark: SparkSession, folder: str) -> DataFrame:
    have = table(spark, folder, "slides").where("thumbnail_path IS NOT NULL").select(F.col("thumbnail_path").alias("path"))
    return P.missing(html_refs(spark, folder), have)


@_add("orphan_assets", "SELECT hash, size_bytes FROM assets WHERE hash NOT IN (SELECT asset_hash FROM slide_assets WHERE asset_hash IS NOT NULL)")
def orphan_assets(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "slide_assets").where("asset_hash IS NOT NULL").select(F.col("asset_hash").alias("hash"))
    return P.orphaned(table(spark, folder, "assets"), used, ["hash"]).select("hash", "size_bytes")


@_add("content_dedup_savings", "WITH f AS (SELECT l.slide_id, l.asset_hash, a.size_bytes FROM slide_assets l JOIN assets a ON l.asset_hash = a.hash) SELECT asset_hash, count(*) AS copies, min(slide_id) AS kept, CAST(sum(size_bytes) - min(size_bytes) AS BIGINT) AS freed FROM f GROUP BY asset_hash HAVING count(*) >= 2")
def content_dedup_savings(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "assets").select(F.col("hash").alias("asset_hash"), "size_bytes")
    return P.savings(table(spark, folder, "slide_assets").join(a, "asset_hash"), "asset_hash", "size_bytes", ["slide_id"])


@_add("folder_sizes", "WITH f AS (SELECT first_deck || '/' || filename AS path, size_bytes FROM assets WHERE first_deck IS NOT NULL AND filename IS NOT NULL) SELECT split_part(path, '/', 1) AS folder, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM f GROUP BY 1")
def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "assets").where("first_deck IS NOT NULL AND filename IS NOT NULL").select(F.concat_ws("/", "first_deck", "filename").alias("path"), "size_bytes")
    return P.folder_sizes(f)


# boxes drawn from the links' numbers, the same way on both sides
_SIDES = ("CAST(iwa_data_id % 1700 AS DOUBLE) AS x", "CAST(floor(iwa_data_id / 7) % 900 AS DOUBLE) AS y", "CAST(60 + iwa_data_id % 601 AS DOUBLE) AS w", "CAST(40 + floor(iwa_data_id / 11) % 403 AS DOUBLE) AS h")
_BX = f"b AS (SELECT DISTINCT slide_id, role, iwa_data_id AS id, {', '.join(_SIDES)} FROM slide_assets WHERE iwa_data_id IS NOT NULL)"
_INTER = "greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0)"


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "slide_assets").where("iwa_data_id IS NOT NULL")
    return rows.selectExpr("slide_id", "role", "iwa_data_id AS id", *_SIDES).distinct()


@_add("bbox_containment", f"WITH {_BX} SELECT DISTINCT a.slide_id, a.id AS outer, c.id AS inner FROM b a JOIN b c ON a.slide_id = c.slide_id AND a.id <> c.id WHERE {_INTER} > 0 AND {_INTER} >= 0.7 * c.w * c.h - 0.000000001")
def bbox_containment(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder).select("slide_id", "id", "x", "y", "w", "h").distinct()
    return B.containment(b, ["slide_id"], "id")


@_add("iou_best_match", f"WITH {_BX}, p AS (SELECT a.slide_id, a.id, c.id AS target, round(CASE WHEN {_INTER} > 0 THEN {_INTER} / (a.w * a.h + c.w * c.h - {_INTER}) ELSE -((a.x + a.w / 2 - c.x - c.w / 2) ** 2 + (a.y + a.h / 2 - c.y - c.h / 2) ** 2) / 1000000 END, 9) AS score FROM b a JOIN b c ON a.slide_id = c.slide_id WHERE a.role = 'icon' AND c.role = 'image') SELECT slide_id, id, target, round(score, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY slide_id, id ORDER BY score DESC, target) = 1")
def iou_best_match(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder)
    out = B.best_match(b.where("role = 'icon'"), b.where("role = 'image'").withColumnRenamed("id", "target"), ["slide_id"], "id", "target")
    return out.withColumn("score", F.round("score", 4))


@_add("text_line_match", f"WITH {_BX}, p AS (SELECT a.slide_id, a.id, c.id AS target, round(greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) / greatest(least(a.w, c.w), 1) - abs(a.y + a.h / 2 - c.y - c.h / 2) / 1080, 9) AS score FROM b a JOIN b c ON a.slide_id = c.slide_id WHERE a.role = 'icon' AND c.role = 'background') SELECT slide_id, id, target, round(score, 4) AS score FROM p QUALIFY row_number() OVER (PARTITION BY slide_id, id ORDER BY score DESC, target) = 1 AND score >= 0.5")
def text_line_match(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder)
    out = B.best_match(b.where("role = 'icon'"), b.where("role = 'background'").withColumnRenamed("id", "target"), ["slide_id"], "id", "target", "line", 0.5)
    return out.withColumn("score", F.round("score", 4))


_GREEDY = """f AS (SELECT slide_id, id, x, y, w, h, row_number() OVER (PARTITION BY slide_id ORDER BY id) AS n FROM b WHERE role = 'icon' AND slide_id IS NOT NULL),
c AS (SELECT slide_id, id, x, y, w, h, row_number() OVER (PARTITION BY slide_id ORDER BY id) AS rn FROM b WHERE role = 'image' AND slide_id IS NOT NULL),
m AS (SELECT f.slide_id, f.n, c.rn, c.id AS shape, greatest(least(f.x + f.w, c.x + c.w) - greatest(f.x, c.x), 0) * greatest(least(f.y + f.h, c.y + c.h) - greatest(f.y, c.y), 0) AS shared, f.w * f.h + c.w * c.h AS areas, sqrt(pow(f.x + f.w / 2 - c.x - c.w / 2, 2) + pow(f.y + f.h / 2 - c.y - c.h / 2, 2)) AS away, greatest(30, 0.3 * greatest(f.w, f.h)) AS reach FROM f JOIN c ON f.slide_id = c.slide_id),
p AS (SELECT slide_id, n, rn, shape, CASE WHEN shared > 0 AND shared / (areas - shared) >= 0.5 THEN {'t': 1, 's': CAST(shared / (areas - shared) AS DOUBLE), 'r': -rn} WHEN away <= reach THEN {'t': 0, 's': CAST(-away AS DOUBLE), 'r': -rn} END AS score FROM m),
g AS (SELECT slide_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS fill, CAST(NULL AS BIGINT) AS shape FROM f GROUP BY slide_id
UNION ALL SELECT slide_id, n, CASE WHEN rn IS NULL THEN taken ELSE list_append(taken, rn) END, fill, shape FROM (
SELECT g.slide_id, f.n, any_value(g.taken) AS taken, any_value(f.id) AS fill, arg_max(p.shape, p.score) FILTER (WHERE p.score IS NOT NULL AND NOT list_contains(g.taken, p.rn)) AS shape, arg_max(p.rn, p.score) FILTER (WHERE p.score IS NOT NULL AND NOT list_contains(g.taken, p.rn)) AS rn
FROM g JOIN f ON f.slide_id = g.slide_id AND f.n = g.n + 1 LEFT JOIN p ON p.slide_id = f.slide_id AND p.n = f.n GROUP BY g.slide_id, f.n))"""


@_add("greedy_pairs", f"WITH RECURSIVE {_BX}, {_GREEDY} SELECT slide_id, fill, shape FROM g WHERE n > 0")
def greedy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    b = _boxes(spark, folder).withColumn("ord", F.col("id")).select("slide_id", "ord", "id", "x", "y", "w", "h", "role")
    return B.pair_greedily(b.where("role = 'icon'").drop("role"), b.where("role = 'image'").drop("role"), "slide_id")


@_add("area_vote", f"WITH {_BX} SELECT slide_id, CASE WHEN sum(CASE WHEN role = 'background' THEN w * h ELSE 0 END) > sum(CASE WHEN role = 'image' THEN w * h ELSE 0 END) THEN 'dark' ELSE 'light' END AS ground FROM b GROUP BY slide_id")
def area_vote(spark: SparkSession, folder: str) -> DataFrame:
    area = F.col("w") * F.col("h")
    dark, light = (F.sum(F.when(F.col("role") == r, area).otherwise(0.0)) for r in ("background", "image"))
    return _boxes(spark, folder).groupBy("slide_id").agg(F.when(dark > light, "dark").otherwise("light").alias("ground"))


@_add("hierarchy_resolve", "WITH RECURSIVE n AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 1 THEN c_custkey // 3 END AS up, CASE WHEN c_acctbal > 8000 THEN c_mktsegment END AS style FROM customer), r AS (SELECT k, up, style, 0 AS d FROM n UNION ALL SELECT r.k, n.up, coalesce(r.style, n.style), d + 1 FROM r JOIN n ON r.up = n.k WHERE d < 31) SELECT k AS c_custkey, style, CAST(d AS INTEGER) AS ancestors FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) = 1")
def hierarchy_resolve(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 3)).alias("up"), F.when(F.col("c_acctbal") > 8000, F.col("c_mktsegment")).alias("style"))
    return B.resolve_chain(n, "c_custkey", "up", ["style"])


# measures and lookups


@_add("number_bars", f"WITH {_S}, v AS (SELECT id, deck_id, abs(try_cast(NULLIF(regexp_extract(body_text, '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)) AS v FROM s), t AS (SELECT deck_id, max(v) AS top FROM v GROUP BY deck_id) SELECT id, CASE WHEN v IS NOT NULL THEN round(greatest(CASE WHEN top > 0 THEN 100 * v / top ELSE 0 END, 40), 4) END AS bar FROM v JOIN t ON v.deck_id = t.deck_id")
def number_bars(spark: SparkSession, folder: str) -> DataFrame:
    b = V.bars(slides(spark, folder), ["deck_id"], V.first_number(F.col("body_text")))
    return b.select("id", F.round("bar", 4).alias("bar"))


@_add("fill_verdicts", f"WITH {_S}, v AS (SELECT length(body_text) * 100.0 / 120 AS p FROM s), k AS (SELECT CASE WHEN p < 80 THEN 'sparse' WHEN p > 105 THEN 'overflow' WHEN p IS NOT NULL THEN 'ok' END AS verdict FROM v) SELECT verdict, count(*) AS n FROM k GROUP BY verdict")
def fill_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return slides(spark, folder).groupBy(V.fill_verdict(F.length("body_text") * 100 / 120).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@_add("page_then_key", f"WITH {_S}, p AS (SELECT deck_id, start_page AS page_no, min(description) AS value FROM stories WHERE start_page IS NOT NULL GROUP BY 1, 2), k AS (SELECT canonical AS type_tag, english AS value FROM tag_list WHERE axis = 'type') SELECT id, coalesce(NULLIF(p.value, ''), k.value) AS label FROM s LEFT JOIN p ON s.deck_id = p.deck_id AND s.page_no = p.page_no LEFT JOIN k ON s.type_tag = k.type_tag")
def page_then_key(spark: SparkSession, folder: str) -> DataFrame:
    by_page = table(spark, folder, "stories").where("start_page IS NOT NULL").groupBy("deck_id", F.col("start_page").alias("page_no")).agg(F.min("description").alias("value"))
    by_key = table(spark, folder, "tag_list").where("axis = 'type'").select(F.col("canonical").alias("type_tag"), F.col("english").alias("value"))
    return V.overridden(slides(spark, folder), by_page, by_key, ["deck_id", "page_no"], ["type_tag"], "label").select("id", "label")


@_add("preferred_per_page", f"WITH {_S} SELECT deck_id, page_no, id FROM s WHERE page_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY deck_id, page_no ORDER BY coalesce(title_source, '') <> 'extracted', row_seq) = 1")
def preferred_per_page(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder).where("page_no IS NOT NULL").select("deck_id", "page_no", "id", "row_seq", F.coalesce("title_source", F.lit("")).alias("source"))
    return Q.first_preferred(s, ["deck_id", "page_no"], F.col("source") == "extracted", ["row_seq"]).select("deck_id", "page_no", "id")


@_add("file_manifest", SQL["html_refs"].replace("SELECT DISTINCT id,", ", q AS (SELECT DISTINCT id,") + ") SELECT CASE WHEN starts_with(path, '../a/') THEN 'shared' WHEN starts_with(path, 'thumbs/') THEN 'framework' ELSE 'local' END AS place, count(DISTINCT path) AS files FROM q GROUP BY 1")
def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return P.manifest(html_refs(spark, folder), "../a/", "thumbs/")


@_add("resolve_first_existing", f"WITH {_S}, f AS (SELECT DISTINCT thumbnail_path AS path FROM s WHERE thumbnail_path IS NOT NULL), c AS (SELECT id, 'covers/' || slide_key || '.png' AS a, 'thumbs/' || deck_id || '/' || slide_key || '.png' AS b FROM s) SELECT id, CASE WHEN a IN (SELECT path FROM f) THEN a WHEN b IN (SELECT path FROM f) THEN b END AS resolved FROM c")
def resolve_first_existing(spark: SparkSession, folder: str) -> DataFrame:
    s = slides(spark, folder)
    files = s.where("thumbnail_path IS NOT NULL").select(F.col("thumbnail_path").alias("path"))
    tries = [F.concat(F.lit("covers/"), F.col("slide_key"), F.lit(".png")), F.concat(F.lit("thumbs/"), F.col("deck_id"), F.lit("/"), F.col("slide_key"), F.lit(".png"))]
    return P.first_existing(s, files, ["id"], tries)


@_add("same_content", "WITH a AS (SELECT l.slide_id, l.asset_hash AS hash, x.size_bytes, x.filename FROM slide_assets l JOIN assets x ON l.asset_hash = x.hash), o AS (SELECT filename, min(size_bytes) AS s2, min(hash) AS h2 FROM assets WHERE filename IS NOT NULL GROUP BY filename), d AS (SELECT DISTINCT filename, size_bytes, hash FROM a WHERE filename IS NOT NULL) SELECT d.filename, CASE WHEN o.h2 IS NULL THEN 'no original' WHEN d.size_bytes <> o.s2 THEN 'other size' WHEN d.hash <> o.h2 THEN 'other content' ELSE 'same' END AS status FROM d LEFT JOIN o ON d.filename = o.filename")
def same_content(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "assets").where("filename IS NOT NULL")
    used = table(spark, folder, "slide_assets").select(F.col("asset_hash").alias("hash")).distinct()
    copies = x.join(used, "hash").select("filename", "size_bytes", "hash").distinct()
    originals = x.groupBy("filename").agg(F.min("size_bytes").alias("size_bytes"), F.min("hash").alias("hash"))
    return P.same_content(copies, originals, ["filename"])


@_add("stem_lookup", "WITH a AS (SELECT hash, first_deck, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM assets WHERE filename IS NOT NULL), r AS (SELECT hash, first_deck AS deck, stem FROM a), i AS (SELECT first_deck, stem, min(hash) AS h FROM a GROUP BY 1, 2), g AS (SELECT stem, min(hash) AS h FROM a GROUP BY 1) SELECT r.hash, coalesce(i.h, g.h) AS found FROM r LEFT JOIN i ON r.deck = i.first_deck AND r.stem = i.stem LEFT JOIN g ON r.stem = g.stem")
def stem_lookup(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "assets").where("filename IS NOT NULL").select("hash", F.col("hash").alias("found"), "first_deck", F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem"))
    return K.scoped_then_global(a.drop("found"), a, "hash", "first_deck", "stem", "found")
