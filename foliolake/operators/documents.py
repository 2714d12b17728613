"""Operations on nested JSON documents: paths, positional edits, schema checks and rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def parse_value(text: str) -> object:
    """A value typed by hand: JSON if it is JSON, else the text itself."""
    try:
        return json.loads(text.strip())
    except ValueError:
        return text


def json_path(dotted: str) -> str:
    """'a.0.b' as a path of the JSON functions: numeric segments index arrays."""
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in dotted.split("."))


def get_path(doc: Column | str, dotted: str) -> Column:
    """The value at a dotted path as text; null where the path leads nowhere, for bad JSON and for null."""
    return F.get_json_object(F.col(doc) if isinstance(doc, str) else doc, json_path(dotted))


def set_path(df: DataFrame, doc: str, dotted: str, value: str) -> DataFrame:
    """Documents with the value (JSON or text) set at a dotted path; missing objects on the way are made, lists aren't.

    A document in which the path can't be followed, bad JSON and null stay as they are.
    """
    ship(df.sparkSession)
    steps, new = dotted.split("."), parse_value(value)

    def put(text: str | None) -> str | None:
        try:
            root = here = json.loads(text) if text is not None else None
            for s in steps[:-1]:
                if isinstance(here, list):
                    here = here[int(s)]
                elif isinstance(here, dict):
                    if not isinstance(here.get(s), (dict, list)):
                        here[s] = {}
                    here = here[s]
            if isinstance(here, list):
                here[int(steps[-1])] = new
            elif isinstance(here, dict):
                here[steps[-1]] = new
            else:
                return text
            return json.dumps(root, ensure_ascii=False)
        except (ValueError, IndexError, KeyError):
            return text

    @F.pandas_udf("string")
    def rewritten(docs: pd.Series) -> pd.Series:
        return docs.map(put)

    return df.withColumn(doc, rewritten(doc))


def splice(items: Column, at: int, new: Column) -> Column:
    """An array with the elements of `new` put in at 0-based position `at`; a position past the end appends."""
    head = F.slice(items, 1, at) if at else F.slice(items, 1, 0)
    return F.concat(head, new, F.slice(items, at + 1, F.greatest(F.size(items) - at, F.lit(0))))


def reorder(items: Column, keys: Sequence[str], key: str = "key") -> Column:
    """The elements in the order of `keys`, those not named behind them in their own order."""
    listed = F.array(*map(F.lit, keys)).cast("array<string>")
    named = F.flatten(F.transform(listed, lambda k: F.filter(items, lambda x: x[key] == k)))
    return F.concat(named, F.filter(items, lambda x: ~F.coalesce(F.array_contains(listed, x[key]), F.lit(False))))


def remove(items: Column, keys: Sequence[str], key: str = "key") -> Column:
    return F.filter(items, lambda x: ~F.coalesce(x[key].isin(*keys), F.lit(False)))


def clone(items: Column, source: str, name: str, key: str = "key") -> Column:
    """The array with a copy of the element `source`, under the key `name`, right behind it."""
    return F.flatten(F.transform(items, lambda x: F.when(x[key] == source, F.array(x, x.withField(key, F.lit(name)))).otherwise(F.array(x))))


def keep_fields(data: Column, keep: Sequence[str]) -> Column:
    """A map with only the entries named."""
    return F.map_filter(data, lambda k, v: k.isin(*keep))


def picks(text: str, n: int) -> list[int]:
    """1-based positions of a list like '1,3-5,all', in order and each once; positions outside 1 to n are left out."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        if part == "all":
            span = range(1, n + 1)
        elif m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", part):
            span = range(int(m[1]), int(m[2]) + 1)
        else:
            span = [int(part)]
        out += [i for i in span if 1 <= i <= n and i not in out]
    return out


#: A check of one value at a path: all it finds broken, as (path, rule).
Check = Callable[[object, str], list[tuple[str, str]]]

_KINDS: dict[str, Callable[[object], bool]] = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
}
#: Keywords that look at a value alone: the kind of value they speak about, and what holds for value and operand.
_PREDICATES: dict[str, tuple[str | None, Callable]] = {
    "const": (None, lambda v, x: v == x),
    "enum": (None, lambda v, x: v in x),
    "minLength": ("string", lambda v, x: len(v) >= x),
    "pattern": ("string", lambda v, x: re.search(x, v) is not None),
    "minimum": ("number", lambda v, x: v >= x),
    "maximum": ("number", lambda v, x: v <= x),
    "minItems": ("array", lambda v, x: len(v) >= x),
    "maxItems": ("array", lambda v, x: len(v) <= x),
    "uniqueItems": ("array", lambda v, x: not x or len({json.dumps(i, sort_keys=True) for i in v}) == len(v)),
}


class Schema:
    """Checker of a JSON-Schema subset: local $ref, type, const, enum, minLength, pattern, minimum, maximum, required, properties,
    additionalProperties, minItems, maxItems, uniqueItems, items, allOf, oneOf, if/then/else.

    A schema is compiled once to a list of checks, one for each keyword; references are compiled when they are first met, so they may be recursive.
    """

    def __init__(self, schema: dict):
        self.defs = schema.get("$defs", {})
        self.known: dict[str, Check] = {}
        self.checks = self.compiled(schema)

    def check(self, value: object) -> list[tuple[str, str]]:
        """(path, rule) of everything broken, sorted and each once; a wrong type hides what else is said about that value."""
        return sorted(set(self.checks(value, "$")))

    def compiled(self, schema: object) -> Check:
        if not isinstance(schema, dict):
            return lambda value, path: []
        if "$ref" in schema:
            return self._reference(schema["$ref"].rpartition("/")[2])
        checks = [self._predicate(k, schema[k]) for k in _PREDICATES if k in schema]
        checks += [make(self, schema) for k, make in _NESTED.items() if k in schema]
        kinds = schema.get("type")
        tests = [_KINDS[k] for k in ([kinds] if isinstance(kinds, str) else kinds or [])]

        def run(value: object, path: str) -> list[tuple[str, str]]:
            if tests and not any(t(value) for t in tests):
                return [(path, "type")]
            return [x for c in checks for x in c(value, path)]

        return run

    def _reference(self, name: str) -> Check:
        def run(value: object, path: str) -> list[tuple[str, str]]:
            if name not in self.known:
                self.known[name] = self.compiled(self.defs[name])
            return self.known[name](value, path)

        return run

    @staticmethod
    def _predicate(rule: str, operand: object) -> Check:
        kind, holds = _PREDICATES[rule]
        speaks = _KINDS[kind] if kind else lambda value: True
        return lambda value, path: [(path, rule)] if speaks(value) and not holds(value, operand) else []

    def _required(self, schema: dict) -> Check:
        return lambda value, path: [(f"{path}.{k}", "required") for k in schema["required"] if k not in value] if isinstance(value, dict) else []

    def _properties(self, schema: dict) -> Check:
        parts = {k: self.compiled(v) for k, v in schema["properties"].items()}
        closed = schema.get("additionalProperties") is False

        def run(value: object, path: str) -> list[tuple[str, str]]:
            if not isinstance(value, dict):
                return []
            found = [x for k in parts.keys() & value.keys() for x in parts[k](value[k], f"{path}.{k}")]
            return found + [(f"{path}.{k}", "additionalProperties") for k in value.keys() - parts.keys() if closed]

        return run

    def _items(self, schema: dict) -> Check:
        part = self.compiled(schema["items"])
        return lambda value, path: [x for i, v in enumerate(value) for x in part(v, f"{path}[{i}]")] if isinstance(value, list) else []

    def _all(self, schema: dict) -> Check:
        parts = [self.compiled(x) for x in schema["allOf"]]
        return lambda value, path: [x for p in parts for x in p(value, path)]

    def _one(self, schema: dict) -> Check:
        parts = [self.compiled(x) for x in schema["oneOf"]]

        def run(value: object, path: str) -> list[tuple[str, str]]:
            tried = [p(value, path) for p in parts]
            fits = tried.count([])
            # where none fits, the nearest branch says why
            return [] if fits == 1 else [(path, "oneOf"), *(min(tried, key=len) if not fits else [])]

        return run

    def _if(self, schema: dict) -> Check:
        asked, then, other = (self.compiled(schema.get(k)) for k in ("if", "then", "else"))
        return lambda value, path: (other if asked(value, path) else then)(value, path)


_NESTED = {"required": Schema._required, "properties": Schema._properties, "items": Schema._items, "allOf": Schema._all, "oneOf": Schema._one, "if": Schema._if}


def violations(df: DataFrame, key: str, doc: str, schema: dict) -> DataFrame:
    """(key, path, rule) for all that a document breaks; ('$', 'json') for text that is no JSON; a null document has no rows."""
    ship(df.sparkSession)

    @F.pandas_udf("array<struct<path:string,rule:string>>")
    def checked(docs: pd.Series) -> pd.Series:
        checker, out = Schema(schema), []
        for d in docs:
            try:
                out.append([] if d is None else checker.check(json.loads(d)))
            except ValueError:
                out.append([("$", "json")])
        return pd.Series(out, dtype=object)

    return df.select(F.col(key), F.explode(checked(doc)).alias("v")).select(key, "v.path", "v.rule")


def gate(found: DataFrame, rules: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, family, errors, warnings, locations) of violations (key, path, rule) whose rule the dictionary (rule, family, severity) knows, and
    of the others under the family 'uncategorized' as warnings; `strict` makes warnings errors; locations are the first ten paths, kept
    as the least ten while paths are counted, so no group is collected."""
    known = found.join(rules, "rule", "left").withColumn("family", F.coalesce("family", F.lit("uncategorized")))
    error = F.lit(True) if strict else F.coalesce(F.col("severity") == "error", F.lit(False))
    paths = known.groupBy(key, "family", "path").agg(F.count_if(error).alias("e"), F.count_if(~error).alias("w"))
    nth = paths.withColumn("nth", F.row_number().over(Window.partitionBy(key, "family").orderBy("path")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 10, F.col("path")))), lambda p: p), ",")
    return nth.groupBy(key, "family").agg(F.sum("e").alias("errors"), F.sum("w").alias("warnings"), first.alias("locations"))


def by_code(found: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """(rule, family, severity, documents, violations) over all documents: the tally of the codes that the dictionary knows, and whether it lets them pass."""
    known = found.join(rules, "rule")
    severity = F.lit("error") if strict else F.col("severity")
    return known.groupBy("rule", "family", severity.alias("severity")).agg(F.count_distinct(found.columns[0]).alias("documents"), F.count(F.lit(1)).alias("violations"))


def passes(found: DataFrame, rules: DataFrame, documents: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, passed): a document passes if no rule that the dictionary knows as an error is broken in it; with `strict`, no known rule at all."""
    bad = found.join(rules.where(F.lit(strict) | (F.col("severity") == "error")).select("rule"), "rule", "left_semi").select(key).distinct().withColumn("_bad", F.lit(True))
    return documents.select(key).where(F.col(key).isNotNull()).distinct().join(bad, key, "left").select(key, F.col("_bad").isNull().alias("passed"))
