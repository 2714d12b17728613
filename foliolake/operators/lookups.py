"""Lookups with an order of preference between several candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def scoped_then_global(requests: DataFrame, candidates: DataFrame, key: str, scope: str, name: str, value: str) -> DataFrame:
    """(key, value): for each request (key, scope, name) the least value of its own scope's candidates of that name, else of any scope's, else null."""
    inside = candidates.groupBy(scope, name).agg(F.min(value).alias("_in"))
    anywhere = candidates.groupBy(name).agg(F.min(value).alias("_any"))
    out = requests.select(key, scope, name).join(inside, [scope, name], "left").join(anywhere, name, "left")
    return out.select(key, F.coalesce("_in", "_any").alias(value))


def by_long_prefix(requests: DataFrame, candidates: DataFrame, key: str, name: str, value: str, least: int = 50) -> DataFrame:
    """(key, value) of requests whose name has its first `least` signs in common with exactly one candidate: an equi-join on that prefix.

    Names shorter than that match nothing; two candidates are no match."""
    start = F.substring(F.col(name), 1, least).alias("_p")
    wanted = candidates.where(F.length(name) >= least).groupBy(start).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value)).where("_n = 1")
    return requests.where(F.length(name) >= least).select(key, start).join(wanted, "_p").select(key, value)


def best_file(requests: DataFrame, candidates: DataFrame, key: str, name: str, path: str) -> DataFrame:
    """(key, path): of the candidates (name, path, ext, w, h) of a request (key, name, ext, w, h) the one whose shape fits best.

    Candidates of the request's extension go before others, then those of at least half its area; among these the least sum of the relative
    difference of the ratios and a twentieth of the relative difference of the areas wins, ties to the least path.
    """
    r = requests.select(key, name, F.lower("ext").alias("_ext"), F.col("w").cast("double").alias("_w"), F.col("h").cast("double").alias("_h"))
    c = candidates.select(name, path, F.lower("ext").alias("ext"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"))
    area, want = F.col("w") * F.col("h"), F.greatest(F.col("_w") * F.col("_h"), F.lit(1.0))
    ratio = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(1.0)
    wanted = F.when(F.col("_h") > 0, F.col("_w") / F.col("_h")).otherwise(1.0)
    score = F.abs(ratio - wanted) / F.greatest(ratio, wanted) + 0.05 * (1 - F.least(area, want) / F.greatest(area, want))
    rank = F.struct((~F.coalesce(F.col("ext") == F.col("_ext"), F.lit(False))).alias("a"), (area < 0.5 * want).alias("b"), F.round(score, 9).alias("c"), F.col(path).alias("d"))
    return r.join(c, name).groupBy(key).agg(F.min_by(path, rank).alias(path))


def summed_chain(nodes: DataFrame, key: str, parent: str, columns: Sequence[str], depth: int = 16) -> DataFrame:
    """Each node's columns plus those of its ancestors, `depth` of them at least and twice that at most, so cycles end. Pointers double each
    round, and each round is cut, so that the next joins two tables and not two plans."""
    up = nodes.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], F.col(parent).alias("_up"))
    reach = 1
    while reach <= depth:
        p = up.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], F.col("_up").alias("_next"))
        up = cut(up.join(p, F.col("_up") == F.col("_k"), "left").select(key, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in columns], F.col("_next").alias("_up")))
        reach *= 2
    return up.select(key, *columns)


def reachable(links: DataFrame, starts: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """(start, node): everything below each start by links (parent, child), whatever the depth; a start is below itself only by a cycle.

    One level a round, each cut, until a round finds nothing new; a node met before isn't followed again, so cycles end.
    """
    edges = cut(links.select(F.col(parent).alias("_p"), F.col(child).alias("_c")).where("_p IS NOT NULL AND _c IS NOT NULL").distinct())
    front = starts.select(F.col(starts.columns[0]).alias("start")).where("start IS NOT NULL").distinct().withColumn("node", F.col("start"))
    met = None
    while True:
        found = front.join(edges, F.col("node") == F.col("_p")).select("start", F.col("_c").alias("node")).distinct()
        front = cut(found if met is None else found.join(met, ["start", "node"], "left_anti"))
        met = front if met is None else cut(met.unionByName(front))
        if front.isEmpty():
            return met


def path_of_text_id(c: Column, arrays: Mapping[str, str], leaves: Mapping[str, str] | None = None) -> Column:
    """The document path of a text id like 'slide-03.card-2.title': 'data.' and its parts, where a part 'name-N' of a name in `arrays` is the
    array's name and the 0-based place; a last part named in `leaves` (by 'array.part', or 'array' for an id that ends on the place) is renamed
    or added. Null for an id without a slide."""
    field = F.nullif(F.regexp_extract(c, r"^slide-\d+\.(.+)$", 1), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in arrays.items() for x in kv])

    def part(p: Column) -> Column:
        array = F.element_at(names, F.regexp_extract(p, r"^(.*)-\d+$", 1))
        place = F.regexp_extract(p, r"-(\d+)$", 1).try_cast("int") - 1
        return F.when(array.isNotNull(), F.concat(array, F.lit("."), place.cast("string"))).otherwise(p)

    out = F.concat(F.lit("data."), F.array_join(F.transform(F.split(field, r"\."), part), "."))
    for where, name in (leaves or {}).items():
        array, _, leaf = where.partition(".")
        out = F.regexp_replace(out, rf"(^|\.)({array}\.\d+)\.{leaf}$" if leaf else rf"(^|\.)({array}\.\d+)$", f"$1$2.{name}")
    return out


#: How rule messages name places.
ONE_SLIDE, MANY_SLIDES, INDICES, FONT_SIZE = r"\bslide (\d+)", r"(\d+)\s+slide\(s\)", r"slide (?:index|indices):\s*([\d,\s]+)", r"font-size (\d+(?:\.\d+)?)px"


def message_places(c: Column) -> Column:
    """struct(slides, label, count, px, selectors): the places that a rule message names, each null or empty where it names none.

    slides are the indices of the slide or slides spoken of, label is what stands in brackets behind a single one, count the number of slides of a message about several, px
    a font size, selectors all code in backticks that isn't markup.
    """
    def number(pattern: str, kind: str) -> Column:
        return F.regexp_extract(c, pattern, 1).try_cast(kind)

    count = number(MANY_SLIDES, "int")
    listed = F.transform(F.regexp_extract_all(F.regexp_extract(c, INDICES, 1), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    single = F.when(count.isNull() & number(ONE_SLIDE, "int").isNotNull(), F.array(number(ONE_SLIDE, "int")))
    label = F.when(count.isNull(), F.nullif(F.regexp_extract(c, ONE_SLIDE + r"\s*\(([^)]+)\)", 2), F.lit("")))
    quoted = F.regexp_extract_all(c, F.lit("`([^`\n]+)`"), F.lit(1))
    selectors = F.filter(quoted, lambda q: ~q.rlike("[<>\"']"))
    return F.struct(F.coalesce(single, listed).alias("slides"), label.alias("label"), count.alias("count"), number(FONT_SIZE, "double").alias("px"), selectors.alias("selectors"))


def override_target(file_name: Column) -> Column:
    """'key:…' or 'page:N' for an override file 'slide-….html': three digits with a leading 0 are a key, one to three others a page; null for other names."""
    digits = F.nullif(F.regexp_extract(file_name, r"^slide-(\d{1,3})\.html$", 1), F.lit(""))
    key = F.nullif(F.regexp_extract(file_name, r"(?i)^(slide-[a-z0-9-]+)\.html$", 1), F.lit(""))
    page = F.when(digits.isNotNull() & ~digits.rlike(r"^0\d\d$"), F.concat(F.lit("page:"), digits.cast("int").cast("string")))
    return F.coalesce(page, F.concat(F.lit("key:"), key))
