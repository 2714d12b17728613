"""Readers and writers of the formats around a catalogue."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shred import deck_slides
from ..session import ship

#: Fixed values below, in the patterns of the readers: the marks that open a story, a slide or a field in proposals and sidecars.
SLIDES = T.StructType([T.StructField(n, T.LongType() if n == "row_seq" else T.IntegerType() if n in ("page_no", "hidden") else T.TimestampType() if n.endswith("_at") else T.StringType()) for n in "row_seq id deck_id slide_key page_no title title_source thumbnail_path body_text type_tag subtype_tag customer_tag media_tag free_tags hidden notes created_at updated_at iwa_uuid element_sig template_sig".split()])
STORIES = T.StructType([T.StructField(n, T.IntegerType() if n.endswith("_page") else T.TimestampType() if n.endswith("_at") else T.StringType()) for n in "id title description deck_id start_page end_page notes created_at updated_at".split()])
#: Columns that people edit in a table and that come back.
EDITABLE = ("id", "page_no", "title", "type_tag", "subtype_tag", "customer_tag", "media_tag", "free_tags", "notes")


def read_decks(spark: SparkSession, path: str) -> DataFrame:
    """(path, slide_pos, key, layout, screen_label, page_no) of deck files, one JSON document each; unreadable files have no rows."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("doc"))
    return deck_slides(docs, "path", "doc").withColumn("page_no", F.row_number().over(Window.partitionBy("path").orderBy("slide_pos")))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = EDITABLE) -> None:
    """The editable columns as CSV with a header; null is the empty cell."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as written by write_csv or by hand: all columns as text, the empty cell as the empty text, quoted line breaks kept."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "\x00").csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of text files; the line number comes from splitting each whole file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return lines_of(whole, "path", "text")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, value): the lines of each text."""
    return df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("line", "value"))


def stories_from_markdown(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, ord, title, start_page, end_page, slides, note) from lines (key, line, value) of proposals: '## N. title' opens a story, bullets with a
    bold 页, slides or note give its page range, its slide keys and its note; other lines are passed over."""
    title = F.nullif(F.regexp_extract("value", r"(?U)^##\s+\d+\.\s+(.+?)\s*$", 1), F.lit(""))
    ord_ = F.sum(F.when(title.isNotNull(), 1).otherwise(0)).over(Window.partitionBy(key).orderBy("line"))
    span = F.when(F.col("value").rlike(r"^-\s+\*\*页\*\*"), F.regexp_extract("value", r"(\d+\s*[–-]\s*\d+)", 1))
    named = F.when(F.col("value").rlike(r"^-\s+\*\*slides\*\*"), F.regexp_extract_all("value", F.lit(r"slide-\d{3}"), F.lit(0)))
    note = F.when(F.col("value").rlike(r"^-\s+\*\*note\*\*"), F.nullif(F.regexp_replace(F.regexp_extract("value", "：(.*)$", 1), r"(?U)^\s+|\s+$", ""), F.lit("")))
    rows = lines.select(key, "line", title.alias("title"), ord_.alias("ord"), F.nullif(span, F.lit("")).alias("span"), F.when(F.size(named) > 0, named).alias("slides"), note.alias("note")).where("ord > 0")
    last = {c: F.last(c, ignorenulls=True).over(Window.partitionBy(key, "ord").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("span", "slides", "note")}
    out = rows.select(key, "ord", "title", *[v.alias(c) for c, v in last.items()]).where("title IS NOT NULL")
    pages = [F.regexp_extract("span", rf"{p}", 1).try_cast("int") for p in (r"^(\d+)", r"(\d+)$")]
    return out.select(key, "ord", "title", pages[0].alias("start_page"), pages[1].alias("end_page"), "slides", "note")


def texts_from_markdown(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, slide, field, value) from sidecars: '## slide-NN (layout) — label' opens a slide, 'field: value' a value that indented lines continue;
    '\\n' in a value is a line break, a later value of one field wins."""
    slide = F.nullif(F.regexp_extract("value", r"^##\s+(slide-\d+)\b", 1), F.lit(""))
    start = F.nullif(F.regexp_extract("value", r"^([A-Za-z_][\w.\[\]-]*)\s*:", 1), F.lit(""))
    more = F.col("value").rlike(r"^\s+\S")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"slide": F.last(slide, True).over(w), "start": start})
    rows = rows.withColumn("ord", F.sum(F.when(F.col("start").isNotNull() | slide.isNotNull(), 1).otherwise(0)).over(w)).where(F.col("slide").isNotNull())
    part = F.when(F.col("start").isNotNull(), F.regexp_replace("value", r"^[^:]*:\s*", "")).when(more, F.trim("value"))
    parts = rows.select(key, "slide", "ord", "line", "start", part.alias("part")).where("part IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "\n")
    fields = parts.groupBy(key, "slide", "ord").agg(F.first("start", True).alias("field"), joined.alias("value")).where("field IS NOT NULL")
    best = fields.groupBy(key, "slide", "field").agg(F.max_by("value", "ord").alias("value"))
    return best.withColumn("value", F.replace("value", F.lit("\\n"), F.lit("\n")))


#: Fields of an ITEM or MASTER line of an element table made by hand, in order.
ELEMENT = "ord kind x y w h angle opacity z locked text font size color align file_name data_id style".split()


#: The fields of element lines as the slide extractor writes them, and of the records that follow an element, in order. A shorter CELL has CELL_SHORT.
EXTRACTED = "kind x y w h angle file_name font size r g b fill_r fill_g fill_b corner opacity text".split()
RECORDS = {
    "CELL": "row col cw rh font size r g b fill_r fill_g fill_b text".split(),
    "CHART_META": ["kind"],
    "SERIES": ["name"],
    "CATEGORY": ["name"],
    "POINT": "series category value".split(),
    "RUN": "font size r g b text".split(),
}
CELL_SHORT = "row col cw rh text".split()
_BASE64, _WHOLE = frozenset({"text", "name"}), frozenset("ord z row col series category r g b fill_r fill_g fill_b".split())
_REAL = frozenset("x y w h angle opacity size corner cw rh value".split())


def _cell(name: str, at: int | None) -> Column:
    """One field of a line's `cells`; what can't be read is null."""
    c = F.lit(None).cast("string") if at is None else F.get("cells", at + 1)
    if name in _BASE64:
        return F.lit(None).cast("string") if at is None else F.expr(f"try_to_binary(get(cells, {at + 1}), 'base64')").cast("string")
    if name in _WHOLE:
        return c.try_cast("double").cast("int")
    return c.try_cast("double") if name in _REAL else F.nullif(c, F.lit(""))


def elements_from_tsv(lines: DataFrame, key: str = "path", fields: Sequence[str] = ELEMENT) -> DataFrame:
    """(key, line, slide_no, master, fields) from element tables: '#SLIDE n skipped' opens a slide (a skipped one has no rows), ITEM and MASTER lines carry
    `fields` in order, text in base64; ELEMENT is the order of hand-made tables, EXTRACTED that of the slide extractor. `records_from_tsv` reads the other kinds."""
    cells = F.split("value", "\t")
    slide = F.when(F.get("cells", 0) == "#SLIDE", F.struct(F.get("cells", 1).try_cast("int").alias("no"), (F.lower(F.get("cells", 2)) == "true").alias("skipped")))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("cells", cells).withColumn("at", F.last(slide, True).over(w))
    rows = rows.where(F.get("cells", 0).isin("ITEM", "MASTER") & F.col("at").isNotNull() & ~F.coalesce(F.col("at.skipped"), F.lit(False)))
    return rows.select(key, "line", F.col("at.no").alias("slide_no"), (F.get("cells", 0) == "MASTER").alias("master"), *[_cell(f, i).alias(f) for i, f in enumerate(fields)])


def records_from_tsv(lines: DataFrame, record: str, key: str = "path") -> DataFrame:
    """(key, line, slide_no, item, fields) of one kind of RECORDS in element tables; item is the line of the last element before it on its slide, to which
    it belongs; groups are no elements. Skipped slides, records before an element and lines before the first slide have no rows; a field that
    can't be read is null."""
    cells = F.split("value", "\t")
    head, upto = F.get("cells", 0), Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    slide = F.struct(F.get("cells", 1).try_cast("int").alias("no"), (F.lower(F.get("cells", 2)) == "true").alias("skipped"), "line")
    rows = lines.select(key, "line", cells.alias("cells")).withColumn("at", F.last(F.when(head == "#SLIDE", slide), True).over(upto))
    element = F.when(head.isin("ITEM", "MASTER") & (F.get("cells", 1) != "group"), F.col("line"))
    rows = rows.withColumn("item", F.last(element, True).over(upto)).where(head == record)
    rows = rows.where(~F.coalesce(F.col("at.skipped"), F.lit(True)) & (F.col("item") > F.col("at.line")))
    fields = RECORDS[record]
    if record != "CELL":
        return rows.select(key, "line", F.col("at.no").alias("slide_no"), "item", *[_cell(f, i).alias(f) for i, f in enumerate(fields)])
    short = F.size("cells") <= len(CELL_SHORT) + 1
    both = [F.when(short, _cell(f, CELL_SHORT.index(f) if f in CELL_SHORT else None)).otherwise(_cell(f, i)).alias(f) for i, f in enumerate(fields)]
    return rows.select(key, "line", F.col("at.no").alias("slide_no"), "item", *both)


def prompts_from_transcripts(df: DataFrame) -> DataFrame:
    """(session, cwd, at, prompt) of what users wrote in transcript rows (type, message.content, timestamp, cwd, sessionId), each a JSON line in
    `value`; bad JSON, other types, blank prompts and those that start with '<' (made by tools) are left out; a bad time is null."""
    schema = "type string, message struct<content:string>, timestamp string, cwd string, sessionId string"
    r = df.select(F.from_json("value", schema).alias("r")).select("r.*").where("type = 'user'")
    text = F.regexp_replace("message.content", r"(?U)^\s+|\s+$", "")
    out = r.select(F.col("sessionId").alias("session"), "cwd", F.try_to_timestamp(F.regexp_replace("timestamp", "Z$", "+00:00")).alias("at"), text.alias("prompt"))
    return out.where("prompt <> '' AND NOT startswith(prompt, '<') AND NOT startswith(prompt, '[{')")


_OPEN = re.compile(r"<(/?)(section|div)\b([^>]*?)(/?)>", re.IGNORECASE)


def frames_of(html: str, tag: str, marker: str) -> list[tuple[int, str, bool, str]]:
    """(position, key, hidden, inner) of the outermost elements of a tag whose attributes hold the marker, by counting depth."""
    out: list[tuple[int, str, bool, str]] = []
    depth, start, attrs = 0, None, ""
    for m in _OPEN.finditer(html):
        if m[2].lower() != tag:
            continue
        if m[1]:
            if depth:
                depth -= 1
                if depth == 0:
                    key = re.search(r"""(?:data-slide-key|data-key|id)\s*=\s*["']([^"']+)""", attrs)
                    out.append((len(out), key[1] if key else "", bool(re.search(r"\bhidden\b|data-hidden\s*=\s*[\"'](?:true|1)", attrs)), html[start : m.start()]))
        elif depth:
            depth += not m[4]
        elif re.search(marker, m[3]) and not m[4]:
            depth, start, attrs = 1, m.end(), m[3]
    return out


def frames(df: DataFrame, key: str, html: str, tag: str = "section", marker: str = r"\bslide\b") -> DataFrame:
    """(key, pos, slide_key, hidden, inner) of slide markup; an element that never closes has no row, null and empty markup none."""
    ship(df.sparkSession)

    @F.pandas_udf("array<struct<pos:int,slide_key:string,hidden:boolean,inner:string>>")
    def cut_out(pages: pd.Series) -> pd.Series:
        return pd.Series([frames_of(p or "", tag, marker) for p in pages], dtype=object)

    return df.select(key, F.explode(cut_out(html)).alias("f")).select(key, "f.*")


def keep_prior(found: DataFrame, prior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with the title and notes that were known under their key; a blank title is the slide's key."""
    joined = found.join(prior.select(*keys, "title", "notes"), list(keys), "left")
    return joined.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "slide_key"))


def registry(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, description, kind) of the frontmatter between the first two '---' lines of each text; kind is a list written '[a, b]' or 'a'."""
    front = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    def value(name: str) -> Column:
        return F.nullif(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1), r"""^["']|["']$""", ""), F.lit(""))
    kind = F.split(F.regexp_replace(value("kind"), r"[\[\]\s\"']", ""), ",")
    return df.select(key, value("name").alias("name"), value("description").alias("description"), kind.alias("kind")).where("name IS NOT NULL")


def discover(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, path, source) of mounts: folders found (name, path) and aliases (name, path) over them; an alias to a path that isn't there is 'broken'."""
    real = paths.select("path").distinct().withColumn("_there", F.lit(True))
    a = aliases.join(real, "path", "left").select("name", "path", F.when(F.col("_there"), "alias").otherwise("broken").alias("source"))
    good = a.where("source = 'alias'").select("name")
    return a.unionByName(paths.join(good, "name", "left_anti").select("name", "path", F.lit("folder").alias("source")))


def append_history(old: DataFrame, new: DataFrame, at: str = "at") -> DataFrame:
    """A history with the new entries behind the old ones, steps counted from 1 within each chain (`chain`); steps of old entries stay."""
    last = old.groupBy("chain").agg(F.max("step").alias("_last"))
    n = new.withColumn("_n", F.row_number().over(Window.partitionBy("chain").orderBy(at))).join(last, "chain", "left")
    return old.unionByName(n.withColumn("step", F.coalesce("_last", F.lit(0)) + F.col("_n")).select(*old.columns))
