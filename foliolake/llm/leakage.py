"""Evaluation texts inside corpus documents, by size-partitioned MinHash containment search.

A short item inside a long document has a small Jaccard similarity however much of it is there, and the
smaller the longer the document. Documents are therefore cut to blocks and the blocks partitioned by size;
each partition has as many MinHash values as make a miss of the least wanted containment improbable at its
upper size. They come from one permutation, whose range is split to bins: a value is the least of its bin, so
that a block costs one sort however many values it has. Colliding pairs are verified on all shingles of the document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread
from .looks import _compiled, _form, _pattern

#: Shingle length in words, and in signs for scripts without blanks.
WORDS, SIGNS = 5, 8
#: Sizes that bound the partitions; a longer document is cut to blocks of the largest that overlap.
SIZES, OVERLAP = (64, 128, 256, 512), 160
#: Least shingle containment searched for, smallest item size that it is planned for, and chance of a miss.
CONTAINMENT, ITEM_SIZE, MISS = 0.2, 30, 1e-3
#: A match covers at least SHARE of an item's own wording in stretches longer than a short quote; a stretch bridges single changed words.
SHARE, QUOTE_WORDS, QUOTE_SIGNS, BRIDGE_WORDS, BRIDGE_SIGNS = 1 / 3, 9, 14, 2, 6
#: A shingle of an item's first sentence that so many items start with is a heading, not the item's own wording.
HEADING = 3
#: Items held in one pass over the corpus; more items are more passes.
BLOCK = 5000

#: Tokens hashed together.
CHUNK = 1_000_000

_TOKEN = re.compile(r"[^\W_㐀-鿿]+|[㐀-鿿]")
_SENTENCE = re.compile(r"\s*[^.!?。！？:：\n]*[.!?。！？:：\n]?")
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Tokens and shingles of texts, with the hashes of tokens remembered."""

    def __init__(self, pattern: str):
        self.segments = _compiled(pattern)
        self.known: dict[str, int] = {}

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes, and whether each is a sign; case, marks, line breaks and width make no difference."""
        import xxhash

        known, out = self.known, []
        found = _TOKEN.findall(_form(text, self.segments).casefold())
        for t in found:
            h = known.get(t)
            if h is None:
                h = xxhash.xxh64_intdigest(t)
                if len(known) < 500_000:
                    known[t] = h
            out.append(h)
        return np.array(out, dtype=np.uint64), np.fromiter(("㐀" <= t <= "鿿" for t in found), dtype=bool, count=len(found))

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the shingle that starts at each token (0 where too few follow), and whether it is one of signs."""
        return next(self.shingles_of([text]))

    def shingles_of(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The shingles of each text; texts are hashed together, up to CHUNK tokens at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for t in texts:
            held.append(self.tokens(t))
            size += len(held[-1][0])
            if size >= CHUNK:
                yield from _hashed(held)
                held, size = [], 0
        yield from _hashed(held)


def _hashed(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not held:
        return
    lengths = np.array([len(t) for t, _ in held])
    tokens, signs = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    ends = np.repeat(np.cumsum(lengths), lengths)
    left = ends - np.arange(len(tokens))
    out = np.zeros(len(tokens), dtype=np.uint64)
    for size, mask in ((WORDS, ~signs), (SIGNS, signs)):
        n = len(tokens) - size + 1
        if n > 0 and mask.any():
            h = np.zeros(n, dtype=np.uint64)
            for j in range(size):
                h = _mix(h * np.uint64(0x100000001B3) + tokens[j : j + n])
            out[:n] = np.where(mask[:n] & (left[:n] >= size), h | np.uint64(1), out[:n])
    at = 0
    for n, (_, s) in zip(lengths, held, strict=True):
        yield out[at : at + n], s
        at += n


@cache
def bits_of(size: int) -> int:
    """How many bins, as a power of two, a block of up to `size` shingles needs for the chance MISS at CONTAINMENT.

    A common shingle gives a collision if it is the least of its bin, which has the chance (1 - e^-x) / x with x shingles a bin.
    """
    common = CONTAINMENT * ITEM_SIZE
    bits = 1
    while True:
        x = (ITEM_SIZE + size - common) / 2**bits
        if (1 - (1 - math.exp(-x)) / x) ** common <= MISS:
            return bits
        bits += 1


def permuted(shingles: np.ndarray) -> np.ndarray:
    return _mix(shingles * np.uint64(0x9E3779B97F4A7C15) + np.uint64(20240))


def signature(values: np.ndarray, bits: int) -> np.ndarray:
    """Of sorted permuted shingles the least in each bin; the bin is the value's leading bits."""
    bins = values >> np.uint64(64 - bits)
    return values[np.append(True, bins[1:] != bins[:-1])] if len(values) else values


def blocks(shingles: np.ndarray) -> Iterator[np.ndarray]:
    most = SIZES[-1]
    if len(shingles) <= most:
        yield shingles
        return
    for at in range(0, len(shingles) - OVERLAP, most - OVERLAP):
        yield shingles[at : at + most]


def stretches(hit: np.ndarray, signs: np.ndarray, own: np.ndarray) -> int:
    """Own tokens of an item inside stretches longer than a short quote; `hit` marks where found shingles start."""
    n = len(hit)
    covered = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + np.where(signs[starts], SIGNS, WORDS), n), -1)
    at = np.flatnonzero(np.cumsum(covered[:n]) > 0)
    if not len(at):
        return 0
    gap = np.where(signs[at[1:]], BRIDGE_SIGNS, BRIDGE_WORDS)
    cuts = np.flatnonzero(np.diff(at) - 1 > gap) + 1
    total = 0
    for run in np.split(at, cuts):
        length = run[-1] - run[0] + 1
        if length >= (QUOTE_SIGNS if signs[run].mean() > 0.5 else QUOTE_WORDS):
            total += int(own[run[0] : run[-1] + 1].sum())
    return total


class Index:
    """Signatures of one block of items for every partition, and what is needed to verify a pair, in flat sorted arrays."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        self.items, self.needs = [], np.empty(len(items))
        signed: dict[int, list[tuple[np.ndarray, int]]] = {u: [] for u in SIZES}
        places: list[tuple[np.ndarray, int, np.ndarray]] = []
        for i, (item, shingles, signs, common) in enumerate(items):
            own = np.ones(len(shingles), dtype=bool)
            for s in np.flatnonzero(common):
                own[s : s + (SIGNS if signs[s] else WORDS)] = False
            mine = permuted(np.where(common, np.uint64(0), shingles))
            held = np.flatnonzero(~common & (shingles > 0))
            for u in SIZES:
                signed[u].append((signature(np.unique(mine[held]), bits_of(u)), i))
            places.append((mine[held], i, held))
            total = max(1, int(own.sum()))
            self.items.append((item, signs, own, total))
            # a found shingle adds at most itself and the bridge behind it to a stretch
            reach = max(SIGNS, WORDS) + BRIDGE_SIGNS if signs.any() else WORDS + BRIDGE_WORDS
            self.needs[i] = (total * SHARE - 1e-9) / reach
        self.tables = {u: self._sorted([x for x, _ in v], [np.full(len(x), i) for x, i in v]) for u, v in signed.items()}
        self.values, self.owners, self.at = self._sorted([x for x, _, _ in places], [np.full(len(x), i) for x, i, _ in places], [x for _, _, x in places])

    @staticmethod
    def _sorted(values: list[np.ndarray], *others: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        flat = np.concatenate([np.empty(0, dtype=np.uint64), *values])
        order = flat.argsort(kind="stable")
        return (flat[order], *(np.concatenate([np.empty(0, dtype=np.int32), *x])[order].astype(np.int32) for x in others))

    @staticmethod
    def _found(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Places in a sorted table of all its entries that are among some values."""
        first = np.searchsorted(table, values)
        first = first[table[np.minimum(first, len(table) - 1)] == values] if len(table) else first[:0]
        if not len(first):
            return first
        # entries of one value lie together
        counts = np.searchsorted(table, table[first], "right") - first
        return np.repeat(first - np.append(0, counts.cumsum()[:-1]), counts) + np.arange(counts.sum())

    def search(self, shingles: np.ndarray) -> list[int]:
        """Items of which the document contains enough."""
        values = permuted(shingles[shingles > 0])
        met = []
        for block in blocks(values):
            table, owners = self.tables[u := next(u for u in SIZES if len(block) <= u)]
            met.append(owners[self._found(table, signature(np.sort(block), bits_of(u)))])
        met = np.concatenate(met)
        if not len(met):
            return []
        places = self._found(self.values, values)
        owners = self.owners[places]
        enough = np.bincount(owners, minlength=len(self.needs))[met] >= self.needs[met]
        out = []
        for i in np.unique(met[enough]) if enough.any() else ():
            item, signs, own, total = self.items[i]
            hit = np.zeros(len(signs), dtype=bool)
            hit[self.at[places[owners == i]]] = True
            if stretches(hit, signs, own) >= total * SHARE - 1e-9:
                out.append(item)
        return out


def item_shingles(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, shingles, signs, common) of each item with a text; common marks the shingles of its heading: those of its first sentence that HEADING items have in theirs."""
    pattern = _pattern()

    @F.pandas_udf("struct<s:array<bigint>,signs:array<boolean>,first:int>")
    def shingled(texts: pd.Series) -> pd.DataFrame:
        maker = Shingler(pattern)
        rows = [maker.shingles(t) for t in texts]
        first = [len(maker.tokens(_SENTENCE.match(t)[0])[0]) for t in texts]
        return pd.DataFrame({"s": [r[0].view(np.int64).tolist() for r in rows], "signs": [r[1].tolist() for r in rows], "first": first})

    base = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item"])
    made = base.select("item", shingled("text").alias("x")).select("item", "x.*")
    long = made.select("item", "first", F.posexplode(F.arrays_zip("s", "signs")).alias("pos", "z")).select("item", "pos", "z.s", "z.signs", (F.col("pos") < F.col("first")).alias("leads"))
    counts = long.where("leads AND s <> 0").select("item", "s").distinct().groupBy("s").agg(F.count(F.lit(1)).alias("items"))
    often = counts.where(F.col("items") >= HEADING).select("s", F.lit(True).alias("leads"), F.lit(True).alias("common"))
    long = long.join(often, ["s", "leads"], "left")
    rows = F.array_sort(F.collect_list(F.struct("pos", "s", "signs", F.coalesce("common", F.lit(False)).alias("common"))))
    return long.groupBy("item").agg(rows.alias("r")).select("item", "r.s", "r.signs", "r.common")


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(key, item): documents that contain at least SHARE of an item's own wording.

    Null and empty texts on either side match nothing, as do items shorter than a shingle; repeated rows
    count once; whole texts are searched. The items are a stated query set, taken in blocks of BLOCK, and
    each block meets all documents in one narrow pass; only the block's signatures (a bounded size) are sent
    to the executors.
    """
    spark = documents.sparkSession
    ship(spark)
    pattern = _pattern()
    kinds = (documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString())
    rows = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL"))

    def passed(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            maker, index = Shingler(pattern), held.value
            for pdf in batches:
                keys, found = [], []
                for k, (shingles, _) in zip(pdf["key"], maker.shingles_of(pdf["text"]), strict=True):
                    hits = index.search(shingles)
                    keys += [k] * len(hits)
                    found += hits
                yield pd.DataFrame({"key": keys, "item": found})

        return rows.mapInPandas(run, f"key {kinds[0]}, item {kinds[1]}")

    out, block = None, []
    for r in item_shingles(items, item, item_text).toLocalIterator():
        block.append((r.item, np.array(r.s, dtype=np.int64).view(np.uint64), np.array(r.signs, dtype=bool), np.array(r.common, dtype=bool)))
        if len(block) == BLOCK:
            out, block = passed(block) if out is None else out.unionByName(passed(block)), []
    if block or out is None:
        out = passed(block) if out is None else out.unionByName(passed(block))
    return out.distinct().select(F.col("key").alias(key), F.col("item").alias(item))
