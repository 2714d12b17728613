"""Searching, faceting and rolling up a catalogue of slides, stories and decks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import holds, lenient_list, tokens


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one that came last by a unique order; rows with a null key are dropped. Columns that nobody asks for later are pruned."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.where(F.col(key).isNotNull()).withColumn("_last", last).where("_last = 1").drop("_last")


def search(df: DataFrame, equal: Mapping[str, str | None] | None = None, text: str | None = None, columns: Sequence[str] = (), tag: str | None = None, tag_column: str = "free_tags", only: Mapping[str, Sequence[str]] | None = None, without: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows that meet every given condition, all of them pushed towards the scan.

    `equal` compares columns, a None there is no condition; `text` is looked for literally in any of `columns`, ASCII letters in any
    case; `tag` is looked for as a substring of the stored tag list; `only` and `without` are value lists (a null is in no list, so
    `only` drops and `without` keeps it).
    """
    conditions = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    if text:
        conditions.append(_any([holds(c, text) for c in columns]))
    if tag:
        conditions.append(F.coalesce(F.contains(F.col(tag_column), F.lit(tag)), F.lit(False)))
    conditions += [F.col(c).isin(*v) for c, v in (only or {}).items() if v]
    conditions += [F.coalesce(~F.col(c).isin(*v), F.lit(True)) for c, v in (without or {}).items() if v]
    return df.where(_all(conditions))


def has_all(tags: Column, wanted: Sequence[str]) -> Column:
    """Whether an array of tags holds every wanted one."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<string>"), tags)) == 0


def postings(df: DataFrame, key: str, columns: Sequence[str], stop: Sequence[str] = ()) -> DataFrame:
    """(token, key): the inverted index of the columns' text."""
    text = F.concat_ws("\n", *columns)
    return df.select(F.col(key), F.explode(tokens(text, stop)).alias("token")).distinct()


def match(index: DataFrame, key: str, words: Sequence[str], every: bool = False) -> DataFrame:
    """Keys whose postings hold any, or every, of the words; no words match nothing."""
    wanted = sorted({w.lower() for w in words})
    hit = index.where(F.col("token").isin(*wanted)) if wanted else index.limit(0)
    return hit.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (len(wanted) if every else 1)).select(key)


def facets(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, value, n) of several columns in one pass; nulls aren't counted."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])).alias("f")).select("f.*")
    return long.where("value IS NOT NULL").groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"))


def facet_map(counts: DataFrame) -> DataFrame:
    """(axis, entries): each axis's values as an array of (n, value) ordered by count, largest first."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("n").alias("n"), F.col("value").alias("value"))), False)
    return counts.groupBy("axis").agg(rows.alias("entries"))


#: Pages of a bucket in range joins: a story meets the slides of its own buckets only, so a hot deck costs what it has, not its stories times its slides.
PAGES = 64


def _bucketed(stories: DataFrame, slides: DataFrame) -> DataFrame:
    """Stories once for each bucket of pages that they cover, ranges clipped to the pages that their deck has."""
    known = slides.where("page_no IS NOT NULL").groupBy(F.col("deck_id").alias("_d")).agg(F.min("page_no").alias("_lo"), F.max("page_no").alias("_hi"))
    s = stories.join(known, F.col("deck_id") == F.col("_d")).where("start_page <= end_page AND start_page <= _hi AND end_page >= _lo")
    first, last = F.greatest("start_page", "_lo"), F.least("end_page", "_hi")
    return s.withColumn("_bucket", F.explode(F.sequence(F.floor(first / PAGES), F.floor(last / PAGES)))).drop("_d", "_lo", "_hi")


def members(stories: DataFrame, slides: DataFrame) -> DataFrame:
    """Slides of each story: an equi-join on deck and bucket of pages with the range as residue; a null bound has no members.

    Returns (story_id, story_title, slide_id, deck_id, page_no, position), position counted from the story's first page.
    """
    p = slides.select(F.col("id").alias("slide_id"), "deck_id", "page_no", F.floor(F.col("page_no") / PAGES).alias("_bucket"))
    s = _bucketed(stories.select(F.col("id").alias("story_id"), F.col("title").alias("story_title"), "deck_id", "start_page", "end_page"), slides)
    out = s.join(p, ["deck_id", "_bucket"]).where(F.col("page_no").between(F.col("start_page"), F.col("end_page")))
    return out.select("story_id", "story_title", "slide_id", "deck_id", "page_no", (F.col("page_no") - F.col("start_page")).alias("position"))


def orphans(stories: DataFrame, slides: DataFrame) -> DataFrame:
    """Slides in no story's range, as a left anti join; a null page or a deck without stories is an orphan."""
    s = _bucketed(stories.select("deck_id", "start_page", "end_page").distinct(), slides).select(F.col("deck_id").alias("_deck"), "_bucket", F.col("start_page").alias("_start"), F.col("end_page").alias("_end"))
    inside = (F.col("deck_id") == F.col("_deck")) & (F.floor(F.col("page_no") / PAGES) == F.col("_bucket")) & F.col("page_no").between(F.col("_start"), F.col("_end"))
    return slides.join(s, inside, "left_anti")


def story_titles(membership: DataFrame, separator: str = " | ") -> DataFrame:
    """(slide_id, titles): the distinct titles of each slide's stories in order; null titles are skipped."""
    return membership.groupBy("slide_id").agg(F.concat_ws(separator, F.sort_array(F.collect_set("story_title"))).alias("titles"))


def story_covers(stories: DataFrame, slides: DataFrame) -> DataFrame:
    """Each story with its page count and the thumbnail of the slide on its first page, null without one."""
    first = slides.where("page_no IS NOT NULL").groupBy("deck_id", F.col("page_no").alias("start_page")).agg(F.min_by("thumbnail_path", "row_seq").alias("cover"))
    s = stories.select("id", "deck_id", "start_page", "end_page", (F.col("end_page") - F.col("start_page") + 1).alias("slide_count"))
    return s.join(first, ["deck_id", "start_page"], "left").select("id", "deck_id", "start_page", "slide_count", "cover")


def decks(slides: DataFrame, stories: DataFrame) -> DataFrame:
    """One row per deck: slides, stories (0 without), and key, title and thumbnail of the slide on the lowest page, ties by arrival."""
    lowest = F.struct(F.col("page_no").isNull(), F.col("page_no"), F.col("row_seq"))
    cover = F.min_by(F.struct("slide_key", "title", "thumbnail_path"), lowest)
    s = slides.groupBy("deck_id").agg(F.count(F.lit(1)).alias("slides"), cover.alias("c"))
    n = stories.groupBy("deck_id").agg(F.count(F.lit(1)).alias("stories"))
    out = s.join(n, "deck_id", "left")
    return out.select("deck_id", "slides", F.coalesce("stories", F.lit(0)).alias("stories"), F.col("c.slide_key").alias("cover_key"), F.col("c.title").alias("cover_title"), F.col("c.thumbnail_path").alias("cover_thumb"))


def totals(slides: DataFrame, stories: DataFrame, flag: str) -> DataFrame:
    """One row: slides, flagged slides (the flag among the stored tags), decks and stories."""
    a = slides.agg(F.count(F.lit(1)).alias("slides"), F.count_if(F.contains(F.coalesce("free_tags", F.lit("")), F.lit(flag))).alias("flagged"), F.count_distinct("deck_id").alias("decks"))
    b = stories.agg(F.count(F.lit(1)).alias("stories"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")


def tag_histogram(slides: DataFrame, column: str = "free_tags") -> DataFrame:
    """(tag, n) over lists stored as JSON; bad JSON is skipped."""
    return slides.select(F.explode(lenient_list(column)).alias("tag")).where("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def stale(slides: DataFrame, files: DataFrame, grace_s: float = 5.0) -> DataFrame:
    """(deck_id, stale): whether a deck's file (deck_id, modified) is newer than its last update by more than the grace; false if either is missing."""
    last = slides.groupBy("deck_id").agg(F.max("updated_at").alias("updated"))
    late = F.unix_micros(F.col("modified").cast("timestamp")) > F.unix_micros(F.col("updated").cast("timestamp")) + int(grace_s * 1_000_000)
    return last.join(files, "deck_id", "left").select("deck_id", F.coalesce(late, F.lit(False)).alias("stale"))


def top(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    """The first n rows in an order; the order should be total."""
    return df.orderBy(*by).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], by: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; Spark cuts each partition to n rows of a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col(rank) <= n)


def latest_state(events: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """The last values of each key and how many events it had; ties of time go to the greatest values."""
    return events.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("s"), F.count(F.lit(1)).alias("events")).select(key, F.col(f"s.{at}").alias(at), *[F.col(f"s.{c}").alias(c) for c in columns], "events")


def kinds_exploded(df: DataFrame, kinds: Column, order: Sequence[str], other: str = "other") -> DataFrame:
    """(kind, place, n): rows counted under each of their kinds; no kind counts as `other`; place is the kind's place in `order`, unknown last."""
    k = F.explode(F.when(F.size(F.coalesce(kinds, F.array().cast("array<string>"))) > 0, kinds).otherwise(F.array(F.lit(other)))).alias("kind")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    out = df.select(k).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return out.select("kind", F.when(place > 0, place).otherwise(len(order) + 1).cast("int").alias("place"), "n")


def sessions_with(df: DataFrame, session: str, text: str, needle: str) -> DataFrame:
    """All rows of every session in which some row's text holds the needle."""
    hit = df.where(holds(text, needle)).select(session).distinct()
    return df.join(hit, session, "left_semi")
