"""One stored form for text that looks the same on screen.

The form undoes differences of composition, width, invisible characters, kinds of space and look-alike
letters and signs, and nothing else: case, accents, words and digits stay. Every code point has a
quick-check property, stable or not; a text without unstable ones is its own form. Elsewhere only the
unstable segments are rewritten, each with the starter before it as boundary context, and spliced back.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import digest, lookup
from ..session import cut, ship, spread
from .setjoin import named

#: Greek and Cyrillic letters and the Latin letters that they look like.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "α": "a", "ρ": "p", "ι": "i", "υ": "u", "χ": "x", "κ": "k", "γ": "y", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "к": "k", "ɡ": "g", "ı": "i", "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
}
#: Signs and the plain sign that they look like.
LIKE_SIGNS = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "⁃": "-", "˗": "-", "‘": "'", "’": "'", "ʼ": "'", "′": "'", "ʹ": "'", "“": '"', "”": '"', "″": '"',
    "․": ".", "‚": ",", "⁄": "/", "∕": "/", "∶": ":", "꞉": ":", "ː": ":", "ǃ": "!", "∗": "*", "⁎": "*", "∙": "·", "⋅": "·", "•": "·", "・": "·", "‧": "·", "˜": "~", "∼": "~", "ˆ": "^", "❨": "(", "❩": ")",
}
#: Kinds of compatibility decomposition that change only width or how a sign is stored; raised, lowered, circled and fraction forms look different and stay.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<vertical>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>"}


@cache
def _letter(c: str) -> str:
    """What one code point becomes before composition."""
    o = ord(c)
    if c in "\t\n\r":
        return c
    kind = unicodedata.category(c)
    if kind == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D, 0x17B4, 0x17B5):
        return ""
    if kind == "Zs" or c in "  \u0085⠀":
        return " "
    if c in LIKE_SIGNS:
        return LIKE_SIGNS[c]
    tag = unicodedata.decomposition(c).partition(" ")[0]
    if tag in _SAME_LOOK:
        c = unicodedata.normalize("NFKC", c)
    return "".join(LOOK_ALIKES.get(x, LIKE_SIGNS.get(x, x)) for x in unicodedata.normalize("NFD", c))


_SPACED_MARKS = {"´": "´", "¨": "¨", "¯": "¯", "¸": "¸"}


def whole_form(text: str) -> str:
    """The form by rewriting everything: the definition, for segments and for tests."""
    return unicodedata.normalize("NFC", "".join(_SPACED_MARKS.get(c) or _letter(c) for c in text.replace("\r\n", "\n").replace("\r", "\n")))


@cache
def unstable_ranges() -> list[tuple[int, int]]:
    """Code points that may change, by rule: those with another form, and those that may join what is before them."""
    joins = {ord(unicodedata.normalize("NFD", chr(o))[-1]) for o in range(0xA0, 0x12000) if not 0xAC00 <= o < 0xD7A4 and not unicodedata.decomposition(chr(o)).startswith("<") and unicodedata.decomposition(chr(o)) and not 0xD800 <= o < 0xE000}
    joins |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    found: list[tuple[int, int]] = []
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or 0x3400 <= o < 0x4DC0 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0x20000 <= o < 0x2F800 or 0x2FA20 <= o < 0xE0000 or o >= 0xE0200:
            continue
        c = chr(o)
        if c == "\r" or unicodedata.combining(c) or (o in joins and o > 0x2FF) or whole_form(c) != c:
            if found and found[-1][1] == o - 1:
                found[-1] = (found[-1][0], o)
            else:
                found.append((o, o))
    return found


@cache
def _pattern() -> str:
    """A pattern of unstable segments; code points beyond the basic plane all count, which costs little and keeps the class small. \\n is the context of \\r\\n."""
    inside = "".join(f"\\u{a:04x}-\\u{min(b, 0xFFFF):04x}" for a, b in unstable_ranges() if a <= 0xFFFF)
    return f"[{inside}\\U00010000-\\U0010ffff]+\n?"


@cache
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


@cache
def quick_check() -> str:
    """A pattern of the JVM that finds every text with an unstable code point, and few others: it passes the stable ones of common scripts."""
    unstable = {o for a, b in unstable_ranges() for o in range(a, b + 1)}
    common = [o for o in (*range(0x20, 0x250), *range(0x3001, 0x3020), *range(0x3041, 0x3097), *range(0x30A1, 0x30FB)) if o not in unstable and o != 0x7F]
    parts, first = [], None
    for o, after in zip(common, [*common[1:], -1], strict=True):
        first = o if first is None else first
        if after != o + 1:
            parts.append(f"\\x{{{first:x}}}-\\x{{{o:x}}}")
            first = None
    return "[^\\t\\n" + "".join(parts) + "\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7a3}]"


@cache
def _own_segments() -> re.Pattern:
    return re.compile(_pattern())


def form(text: str) -> str:
    """The one form of a text: unstable segments normalised, the rest spliced in unchanged."""
    return text if text.isascii() and text.isprintable() else _form(text, _own_segments())


def _form(text: str, segments: re.Pattern) -> str:
    out, at = [], 0
    for m in segments.finditer(text):
        start, end = m.span()
        start -= start > at  # the starter before a segment may combine with it
        out += [text[at:start], _short_form(text[start:end]) if end - start <= 8 else whole_form(text[start:end])]
        at = end
    return "".join([*out, text[at:]]) if out else text


@lru_cache(maxsize=1 << 16)
def _short_form(segment: str) -> str:
    return whole_form(segment)


def with_form(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a column `name`: the one form of the text; null stays null, empty stays empty.

    The quick check runs in the JVM; only texts that fail it are sent to Python.
    """
    ship(df.sparkSession)
    pattern = _pattern()

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        segments = _compiled(pattern)
        return texts.map(lambda t: None if t is None else _form(t, segments))

    c = F.col(text)
    return df.withColumn(name, F.coalesce(rewrite(F.when(c.rlike(quick_check()), c)), c))


def same_look(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, links, membership) of texts that have one form but are stored differently, each field by itself.

    variants is (set_id, copies, field) with one row for each stored text that has such a partner in its field, links (set_a,
    set_b) all pairs of them, membership (set_id, record) the rows that hold them. Null texts, and those without a
    visible sign, have no partner; repeated rows count once. Texts are compared by 128-bit digests and never shuffled.
    """
    long = df.select(F.col(key).alias("record"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("stored")) for f in fields])).alias("t")).select("record", "t.*")
    formed = with_form(spread(long.where("record IS NOT NULL AND stored IS NOT NULL")), "stored", "form").where(F.col("form").rlike(r"(?U)[^\s\p{Z}\p{Cc}]"))
    rows = cut(formed.select("record", "field", digest("field", "stored").alias("set_id"), digest("field", "form").alias("class")).distinct())
    ends = [f(F.col(f"set_id.{c}")).alias(f"{n}_{c}") for c in ("hi", "lo") for n, f in (("least", F.min), ("most", F.max))]
    several = rows.groupBy("class").agg(F.count(F.lit(1)).alias("held"), *ends).where("least_hi <> most_hi OR least_lo <> most_lo").select("class", "held")
    # a class may hold a third of all rows: its rows are found by the skew-proof lookup
    total = float(rows.count())
    members = cut(lookup(rows, several, "class", "held", total).select("record", "field", "set_id", "class"))
    variants = members.groupBy("set_id", "class", "field").agg(F.count(F.lit(1)).alias("copies"))
    a = variants.select("class", F.col("set_id").alias("set_a"))
    b = variants.select("class", F.col("set_id").alias("set_b"))
    links = a.join(b, "class").where("set_a < set_b").select("set_a", "set_b")
    return variants.select("set_id", "copies", "field"), links, members.select("set_id", "record")


def same_look_pairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id_a, id_b, field), id_a < id_b: rows whose texts in a field have one form but are stored differently, where a result has to name every pair."""
    variants, links, membership = same_look(df, key, fields)
    pairs = named(links, membership, variants)
    pairs = pairs.join(variants.select(F.col("set_id").alias("set_a"), "field"), "set_a").where("one <> two")
    return pairs.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b"), "field").distinct()
