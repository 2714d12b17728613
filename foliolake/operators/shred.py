"""Nested JSON records to flat related tables.

Records are read token by token, without building the document, to (path, value, ordinal) triples. Each
triple names its nearest repeated ancestor: the list element that it is in, and the member that holds the list.
Triples are grouped by that member, and each group is pivoted into one table, whose rows are the elements
and whose keys lead to the elements around them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Mapping
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, spread

_TOKEN = re.compile(r'[ \t\n\r]*+([{}\[\]:,]|"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][-+]?\d++)?|true|false|null|[^ \t\n\r])', re.ASCII)
_WORDS = {"true": "boolean", "false": "boolean", "null": "null"}


class Incomplete(ValueError):
    """The text isn't one complete JSON value."""


def _whole(s: str) -> str:
    """Escaped surrogates in pairs become their character, single ones U+FFFD."""
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", s) else s


def _string(token: str) -> str:
    return token[1:-1] if "\\" not in token else _whole(json.loads(token))


def _read(text: str, path: str, name: str, element: tuple[str, str, int], lists: frozenset[str], embedded: frozenset[str], out: list) -> None:
    """Append (path, value, type, element, holder, leaf) of every scalar of a JSON text that lies at a path, under a member name, in an element.

    `element` is the nearest element of a list: its path, the member that holds the list, and where the path below it starts.
    """
    tokens = _TOKEN.findall(text)
    tokens.append("")  # the end, which is no sign of a value
    # open containers: (is it an object, its path, its element, the name that holds it); `places` holds the next position of each
    stack: list[tuple[bool, str, tuple[str, str, int], str]] = []
    places: list[int] = []
    at = 0
    while True:
        token = tokens[at]
        first = token[:1]
        at += 1
        held_by = name
        if name in lists and first != "[":
            path = f"{path}/0" if path else "0"
            element = (path, name, len(path) + 1)
            if first == "{":
                name = ""
        if first == '"':
            if len(token) < 2:
                raise Incomplete(path)
            value = _string(token)
            part: list | None = None
            if name in embedded and value.lstrip()[:1] in ("{", "[", '"'):
                part = []
                try:
                    _read(value, path, name, element, lists, embedded, part)
                except (Incomplete, RecursionError):
                    part = None
            if part is None:
                out.append((path, value, "string", element[0], element[1], path[element[2] :]))
            else:
                out += part
        elif first == "{" or first == "[":
            stack.append((first == "{", path, element, held_by))
            places.append(0)
            if tokens[at] == ("}" if first == "{" else "]"):
                at += 1
                stack.pop()
                places.pop()
            else:
                at -= 1  # the opening sign stands for the comma before the first member
                tokens[at] = ","
        elif token in _WORDS:
            out.append((path, None if first == "n" else token, _WORDS[token], element[0], element[1], path[element[2] :]))
        elif first == "-" and len(token) > 1 or "0" <= first <= "9":
            out.append((path, token, "number", element[0], element[1], path[element[2] :]))
        else:
            raise Incomplete(path)
        while stack:
            is_object, above, element, holder = stack[-1]
            token = tokens[at]
            at += 1
            if token == ",":
                break
            if token != ("}" if is_object else "]"):
                raise Incomplete(above)
            stack.pop()
            places.pop()
        else:
            if tokens[at] or at + 1 != len(tokens):
                raise Incomplete(path)
            return
        if is_object:
            key = tokens[at]
            if key[:1] != '"' or len(key) < 2 or tokens[at + 1] != ":":
                raise Incomplete(above)
            at += 2
            name = _string(key)
            path = f"{above}/{name}" if above else name
        else:
            path = f"{above}/{places[-1]}" if above else str(places[-1])
            places[-1] += 1
            # a list in a list is held by the same member
            name, element = "", (path, holder or element[1], len(path) + 1)


def elements(text: str, lists: frozenset[str] = frozenset(), embedded: frozenset[str] = frozenset()) -> list[tuple[str, str | None, str, str, str, str]]:
    """(path, value, type, element, holder, leaf) of every scalar of a JSON text, in document order.

    element is the path of the nearest list element around it ('' outside of lists), holder the member that holds this list, leaf the
    path below the element. A member named in `lists` whose value is no list counts as a list of one; a string under a name in
    `embedded` that is itself complete JSON of an object, list or string is read in its place. Raises
    Incomplete at the first sign that can't belong to one complete JSON value, or at the end.
    """
    out: list = []
    _read(text, "", "", ("", "", 0), lists, embedded, out)
    return out


def triples(text: str, lists: frozenset[str] = frozenset(), embedded: frozenset[str] = frozenset()) -> list[tuple[str, str | None, str]]:
    """(path, value, type) of every scalar of a JSON text."""
    return [x[:3] for x in elements(text, lists, embedded)]


def shred(df: DataFrame, record: str, text: str, lists: Iterable[str] = (), embedded: Iterable[str] = (), keep: str | None = None) -> DataFrame:
    """(record, ordinal, path, value, type, element, holder, leaf): one row per scalar of each complete JSON text.

    Records with a null id, a null text or a text that is no complete JSON have no rows. `keep` is a
    regular expression of the paths wanted; others are dropped before they leave the parser. Should `record` be the name of another
    column here, that column has a '_' behind its name.
    """
    ship(df.sparkSession)
    lists, embedded = frozenset(lists), frozenset(embedded)
    wanted = re.compile(keep).search if keep else None
    kind = df.schema[record].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record", "ordinal", "path", "value", "type", "element", "holder", "leaf"]
        for batch in batches:
            of, found, ordinals = [], [], []
            for k, t in enumerate(batch.column(1)):
                try:
                    rows = elements(t.as_py(), lists, embedded)
                except (Incomplete, ValueError):
                    continue
                kept = [(i, r) for i, r in enumerate(rows) if wanted is None or wanted(r[0])]
                of += repeat(k, len(kept))
                ordinals += [i for i, _ in kept]
                found += [r for _, r in kept]
            columns = [pa.array(c, pa.string()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(ordinals, pa.int32()), *columns], names=names)

    base = spread(df.select(F.col(record).alias("record"), F.col(text).alias("text")).where("record IS NOT NULL AND text IS NOT NULL"))
    out = base.mapInArrow(parse, f"record {kind}, ordinal int, path string, value string, type string, element string, holder string, leaf string")
    if record in out.columns and record != "record":
        out = out.withColumnRenamed(record, f"{record}_")
    return out.withColumnRenamed("record", record)


def pivot(df: DataFrame, keys: list[str], leaf: Column, leaves: Mapping[str, str]) -> DataFrame:
    """One row per key with a column for each leaf name; of a repeated member the last value counts."""
    at = F.col("ordinal")
    return df.groupBy(*keys).agg(*[F.max_by(F.when(leaf == name, F.col("value")), F.when(leaf == name, at)).alias(column) for name, column in leaves.items()])


def groups(shredded: DataFrame) -> DataFrame:
    """(holder, leaf, n): the groups of paths by repeated ancestor, the leaves of each, and how many scalars they have; '' is the record itself."""
    return shredded.groupBy("holder", "leaf").agg(F.count(F.lit(1)).alias("n"))


def parent_of(element: Column) -> Column:
    """The path of the list element around an element, '' at the top: what is left up to its last position without the element's own member and positions."""
    return F.regexp_extract(F.regexp_replace(element, r"/[^/]*[^/\d][^/]*(?:/\d+)+$", ""), r"^(.*/\d+|\d+)(?:/|$)", 1)


def flat_table(shredded: DataFrame, record: str, holder: str | Iterable[str], leaves: Mapping[str, str], extra: Iterable[str] = ()) -> DataFrame:
    """(record, extra, element, leaves): the table of one group of paths, a row for each list element that has one of the leaves.

    leaves maps paths below the element ('' for an element that is itself a scalar) to column names; a missing leaf is null. The
    element is the row's key in its record, `parent_of` the key of the row around it. `extra` are columns that depend on record and element.
    """
    held = [holder] if isinstance(holder, str) else list(holder)
    mine = shredded.where(F.col("holder").isin(held) & F.col("leaf").isin(list(leaves)))
    return pivot(mine, [record, *extra, "element", "holder"], F.col("leaf"), leaves)


#: Fixed values of the deck format: the members that hold cards and blocks.
HOLDERS = ("cards", "body_blocks", "columns", "children")
_HELD = r"(?:\d+/)*(?:(?:cards|body_blocks|columns|children)(?:/\d+)+/)*(?:cards|body_blocks|columns|children)(?:/\d+)+"
_SLIDE = r"^slides/(\d+)(?:/|$)"


#: Groups of a deck's paths and the leaves of each that become columns of its table; '' is an element that is itself a text.
DECK = {"slides": {"layout": "layout", "data/lede": "lede"}, "cards": {"title_zh": "title"}, "body_blocks": {"text": "text", "": "own"}, "children": {"text": "text", "": "own"}}


#: The name of the record's column while decks are read, so that none of theirs can clash with it.
_ID = "_deck"


def _decks(df: DataFrame, record: str, text: str) -> DataFrame:
    return df.select(F.col(record).alias(_ID), F.col(text).alias("doc"))


def deck_tables(df: DataFrame, record: str = "file_id", text: str = "doc") -> DataFrame:
    """(record, slide_pos, holder, element, layout, lede, title, text): the tables of all groups of DECK in one frame, told apart by holder.

    Texts are strings only. One object counts as a list of one, a block that is a plain string as its own text; data given as JSON
    is read. One frame, as a filter on holder gives a table, while all of them need but one reading of the documents and one shuffle.
    """
    keep = rf"^slides/\d+/(?:layout|data/lede|data/{_HELD}(?:/title_zh|/text)?)$"
    t = shred(df, record, text, lists=(*HOLDERS, "slides"), embedded=("data",), keep=keep).where("type = 'string'")
    t = t.withColumn("slide_pos", F.regexp_extract("element", _SLIDE, 1).cast("int")).repartition(record, "slide_pos")
    leaves = {leaf: column for held in DECK.values() for leaf, column in held.items()}
    flat = flat_table(t, record, DECK, leaves, ["slide_pos"])
    return flat.withColumn("text", F.coalesce("text", "own")).drop("own")


def deck_items(df: DataFrame, record: str = "file_id", text: str = "doc", ledes: bool = False) -> DataFrame:
    """Cards and body blocks with a filled text: (record, slide_pos, layout, kind, item_path, item_text).

    kind is 'card', 'block' or, where `ledes`, 'lede'. The link to the parent slide is (record,
    slide_pos), to a parent card, column or block the item_path. Null and blank texts are left out; a layout that is
    missing, null or no string is ''.
    """
    flat = deck_tables(df, record, text)
    of_slide = F.max(F.when(F.col("holder") == "slides", F.col("layout"))).over(Window.partitionBy(record, "slide_pos"))
    kind = F.when(F.col("holder") == "slides", "lede").when(F.col("holder") == "cards", "card").otherwise("block")
    own = F.when(F.col("holder") == "slides", F.col("lede")).when(F.col("holder") == "cards", F.col("title")).otherwise(F.col("text"))
    path = F.when(F.col("holder") == "slides", "lede").otherwise(F.regexp_replace("element", r"^slides/\d+/data/", ""))
    items = flat.select(record, "slide_pos", F.coalesce(of_slide, F.lit("")).alias("layout"), kind.alias("kind"), path.alias("item_path"), own.alias("item_text"))
    return items.where(F.col("item_text").rlike(r"(?U)[^\s\p{Z}\p{Cc}]") & (F.lit(ledes) | (F.col("kind") != "lede")))


def deck_slides(df: DataFrame, record: str = "file_id", text: str = "doc") -> DataFrame:
    """One row per slide that has a key, layout or label: (record, slide_pos, key, layout, screen_label), null slides counted in the positions."""
    keep = r"^slides/\d+/(?:key|layout|screen_label)$"
    t = shred(_decks(df, record, text), _ID, "doc", lists=("slides",), keep=keep).where("type <> 'null'")
    t = t.withColumn("slide_pos", F.regexp_extract("element", _SLIDE, 1).cast("int"))
    slides = flat_table(t, _ID, "slides", {"key": "key", "layout": "layout", "screen_label": "screen_label"}, ["slide_pos"])
    return slides.drop("holder", "element").withColumnRenamed(_ID, record)
