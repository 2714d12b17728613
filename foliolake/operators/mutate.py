"""Upserts and other changes of a catalogue as rewrites: each gives the table's next version."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import members, orphans


def upsert(old: DataFrame, new: DataFrame, key: str, refresh: Sequence[str], preserve: Sequence[str], fill: Sequence[str], retag: bool = False) -> DataFrame:
    """Old rows with the new ones merged in, by column class: `refresh` always takes the new value, `preserve` keeps the old one of a
    known row unless `retag`, `fill` takes the new one where it isn't null, every other column keeps what a known row has. New keys
    come in whole; rows that are only in old stay. Keys are unique on both sides; rows with a null key are dropped.
    """
    def taken(c: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        known = F.col("o._is").isNotNull()
        if c in refresh or (retag and c in preserve):
            kept = F.when(F.col("n._is").isNotNull(), n).otherwise(o)
        elif c in fill:
            kept = F.coalesce(n, o)
        else:
            kept = o
        return F.when(known, kept).otherwise(n).alias(c)

    a, b = (x.where(F.col(key).isNotNull()).withColumn("_is", F.lit(True)).alias(name) for x, name in ((old, "o"), (new, "n")))
    joined = a.join(b, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key) if c == key else taken(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Old rows and those new ones whose key isn't there yet; of several new rows with one key the first by `order`, ties to the least row."""
    fresh = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(order, *new.columns)).alias("r")).select("r.*")
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return old.unionByName(fresh.alias("f").join(old.select(*keys).alias("k"), condition, "left_anti"))


def update_given(old: DataFrame, changes: DataFrame, key: str | Sequence[str], columns: Sequence[str], empty_is_null: bool = False, only: Column | None = None) -> DataFrame:
    """Old rows with the columns of `changes` written in; a null there changes nothing, unless `empty_is_null`: then every listed column of a
    changed row is written, the empty text as null, as a table edited by hand comes back. The key may be several columns; `only` is a
    condition on the rows of `changes` that count. Keys of `changes` are unique; rows with a null in the key change nothing."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = changes if only is None else changes.where(only)
    c = kept.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(x).alias(f"_{x}") for x in columns])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    joined = old.join(c, same, "left")
    def value(x: str) -> Column:
        if empty_is_null:
            return F.when(F.col("_k0").isNotNull(), F.nullif(F.col(f"_{x}"), F.lit(""))).otherwise(F.col(x))
        return F.coalesce(F.col(f"_{x}"), F.col(x))
    return joined.select(*[value(x).alias(x) if x in columns else F.col(x) for x in old.columns])


def unmatched(old: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of `changes` that no row of old has, so that an update would not find them; a null key is one."""
    return changes.select(*keys).distinct().join(old.select(*keys).distinct(), list(keys), "left_anti")


def with_source(rows: DataFrame, source: DataFrame, key: str, source_key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with columns of the source row that `key` names, as source_*; nulls where there is none. Source keys are unique."""
    s = source.select(F.col(source_key).alias("_s"), *[F.col(c).alias(f"source_{c}") for c in columns])
    return rows.join(s, F.col(key) == F.col("_s"), "left").drop("_s")


def copy_tags(rows: DataFrame, source: DataFrame, mapping: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Rows with tags copied from the source rows that mapping (key, source) names; a source without a title gives nothing, a null tag changes nothing."""
    given = mapping.join(source.select(F.col(key).alias("source"), "title", *columns), "source").where("title IS NOT NULL").select(key, *columns)
    return update_given(rows, given, key, columns)


def create_rows(old: DataFrame, new: DataFrame, key: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(table, answers) of rows to create: answers (key, status) is 409 for a key that is there already or comes twice, 400 for a null key or a start behind
    its end, else 201; the table has old rows and the created ones."""
    there = old.select(F.col(key).alias("_k")).distinct()
    n = new.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(key)))
    n = n.join(there, F.col(key) == F.col("_k"), "left")
    bad = F.col(key).isNull() | F.coalesce(F.col(start) > F.col(end), F.lit(False))
    n = n.withColumn("_status", F.when(bad, 400).when(F.col("_k").isNotNull() | (F.col("_times") > 1), 409).otherwise(201))
    return old.unionByName(n.where("_status = 201").select(*old.columns)), n.select(key, F.col("_status").alias("status"))


def delete_rows(old: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table, answers): old rows without the doomed keys; answers (key, status) is 200 for a key that was there, else 404."""
    keys = doomed.select(key).distinct()
    there = old.select(F.col(key).alias("_k")).distinct()
    answers = keys.join(there, F.col(key) == F.col("_k"), "left").select(key, F.when(F.col("_k").isNotNull(), 200).otherwise(404).alias("status"))
    return old.join(keys, key, "left_anti").select(*old.columns), answers


def enqueue(requests: DataFrame, kind: str, payload: Sequence[str], at: Column, key: str = "request") -> DataFrame:
    """(task, kind, payload, status, at) events for requests: the payload is JSON of the columns named, nulls kept, and the task's id is
    made from request, kind and payload, so that the same request enqueued again is the same task."""
    text = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    rows = requests.withColumn("_p", text)
    task = F.substring(F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.lit(kind), "_p"), 256), 1, 16)
    return rows.select(task.alias("task"), F.lit(kind).alias("kind"), F.col("_p").alias("payload"), F.lit("queued").alias("status"), at.alias("at"))


def request_faults(requests: DataFrame, slides: DataFrame) -> DataFrame:
    """(request, fault) of what is wrong with requests (request, deck_id, op, page) to change decks whose pages slides (deck_id, page_no) has:
    'no deck', 'no page' beyond the last page (one more for an insert) or below 1, 'cover' for a deletion of page 1, 'all' for deletions of every page of a deck."""
    decks = slides.groupBy("deck_id").agg(F.max("page_no").alias("pages"), F.count_distinct("page_no").alias("held"))
    r = requests.join(decks, "deck_id", "left")
    most = F.col("pages") + F.when(F.col("op") == "insert", 1).otherwise(0)
    fault = F.when(F.col("pages").isNull(), "no deck").when(F.col("page").isNull() | (F.col("page") < 1) | (F.col("page") > most), "no page").when((F.col("op") == "delete") & (F.col("page") == 1), "cover")
    single = r.select("request", fault.alias("fault")).where("fault IS NOT NULL")
    doomed = r.where("op = 'delete' AND page BETWEEN 1 AND pages").groupBy("deck_id", "held").agg(F.count_distinct("page").alias("n")).where("n >= held").select("deck_id")
    every = requests.where("op = 'delete'").join(doomed, "deck_id", "left_semi").select("request", F.lit("all").alias("fault"))
    return single.unionByName(every)


def splice_report(before: DataFrame, after: DataFrame, refs: DataFrame, files: DataFrame, key: str = "deck_id") -> DataFrame:
    """(key, added, removed, empty, missing) of decks after pages were put in or taken out: pages (key, slide_key, body) that came and went, pages
    without a body, and references (key, path) to files (path) that aren't there. Decks without pages after the change have no row."""
    b, a = before.select(key, "slide_key").distinct(), after.select(key, "slide_key").distinct()
    added = a.join(b, [key, "slide_key"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("added"))
    removed = b.join(a, [key, "slide_key"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("removed"))
    empty = after.groupBy(key).agg(F.count_if(F.trim(F.coalesce("body", F.lit(""))) == "").alias("empty"))
    lost = refs.join(files.select("path").distinct(), "path", "left_anti").groupBy(key).agg(F.count_distinct("path").alias("missing"))
    out = empty.join(added, key, "left").join(removed, key, "left").join(lost, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "removed", "empty", "missing")])


def propagate(slides: DataFrame, stories: DataFrame, customer: Column, kind: Column, generic: Sequence[str], order: str) -> DataFrame:
    """(id, customer_tag, type_tag) of slides with what their stories' titles say: the customer of the last story that names one, and, where
    the type is null or generic, the type of the first that names one. `customer` and `kind` are expressions on the story title."""
    named = stories.select("id", F.col("title"), "deck_id", "start_page", "end_page", order).select("*", customer.alias("_customer"), kind.alias("_kind"))
    m = members(named, slides).join(named.select(F.col("id").alias("story_id"), order, "_customer", "_kind").distinct(), "story_id")
    said = m.groupBy("slide_id").agg(
        F.max_by("_customer", F.when(F.col("_customer").isNotNull(), F.struct(order, "story_id"))).alias("c"),
        F.min_by("_kind", F.when(F.col("_kind").isNotNull(), F.struct(order, "story_id"))).alias("t"),
    )
    out = slides.join(said, F.col("id") == F.col("slide_id"), "left")
    open_type = F.col("type_tag").isNull() | F.col("type_tag").isin(*generic)
    return out.select("id", F.coalesce("c", "customer_tag").alias("customer_tag"), F.when(open_type, F.coalesce("t", "type_tag")).otherwise(F.col("type_tag")).alias("type_tag"))


def flag_orphans(slides: DataFrame, stories: DataFrame, flag: str = "needs-review") -> DataFrame:
    """(id, tags): the tags of every slide (an array column `tags`), with the flag added once to slides in no story; it is never taken away."""
    lone = orphans(stories, slides).select(F.col("id").alias("_lone")).distinct()
    joined = slides.join(lone, F.col("id") == F.col("_lone"), "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return joined.select("id", F.when(F.col("_lone").isNotNull() & ~F.array_contains(tags, flag), F.concat(tags, F.array(F.lit(flag)))).otherwise(tags).alias("tags"))


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the doomed keys."""
    gone = doomed.select(F.col(key).alias("_gone")).distinct()
    return parents.join(gone, F.col(key) == F.col("_gone"), "left_anti"), children.join(gone, F.col(child_key) == F.col("_gone"), "left_anti")


def dangling(children: DataFrame, parents: DataFrame, child_key: str, key: str) -> DataFrame:
    """Children whose key has no parent; a null key dangles too."""
    return children.join(parents.select(F.col(key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left_anti")


def compare_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], normal: Callable[[Column], Column] | None = None, skip: Column | None = None) -> DataFrame:
    """(keys, status): 'missing' in b, 'extra' in b, 'changed' or 'same', by a full outer join on unique keys. `normal` brings a column to the
    form in which values are compared; rows of a where `skip` holds are 'skipped' when b has them."""
    def held(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[(normal(F.col(c)) if normal else F.col(c)).alias(c) for c in columns]).alias(name), (F.coalesce(skip, F.lit(False)) if skip is not None and name == "x" else F.lit(False)).alias(f"_{name}"))

    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("_x"), "skipped").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("changed")
    return held(a, "x").join(held(b, "y"), list(keys), "full_outer").select(*keys, status.alias("status"))


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def fold_tasks(events: DataFrame, task: str, at: str, status: str, limits: Mapping[str, int] | None = None, now: Column | None = None) -> DataFrame:
    """(task, status, started, finished): the state of each task from its event log; a task that still runs after limits['timeout'] seconds, or at
    all if `now` is null, has failed, as a restart finds it."""
    rows = events.groupBy(task).agg(
        F.max(F.struct(F.col(at).alias("t"), F.col(status).alias("s"))).alias("last"),
        F.min(F.when(F.col(status) == "running", F.col(at))).alias("started"),
        F.max(F.when(F.col(status).isin("done", "failed"), F.col(at))).alias("finished"),
    )
    s = F.col("last.s")
    if now is None:
        state = F.when(s == "running", "failed").otherwise(s)
    else:
        late = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) > (limits or {}).get("timeout", 1800) * 1_000_000
        state = F.when((s == "running") & late, "failed").otherwise(s)
    return rows.select(task, state.alias(status), "started", "finished")
