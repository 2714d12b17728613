"""Near-duplicate evidence between incoming pages and a library, channel by channel, and its evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, overlap
from ..session import cut, ship, spread

#: Pages of a query set that meet the library in one pass; more pages are more passes.
BLOCK = 5000

#: Tokens of the pages that a cell of `block_pairs` holds at once, about; and the pairs that it gives out at once, about.
HELD, FLUSH = 4_000_000, 200_000


def token_pairs(pages: DataFrame, library: DataFrame, least_jaccard: float = 0.20, least_overlap: float = 0.40) -> DataFrame:
    """(page, slide, jaccard, overlap) of pairs that reach either threshold; both inputs have (page or slide, tokens).

    Two exact ways, in both of which either side stays distributed. `block_pairs` counts the common tokens of every row with blocks of pages; it
    shuffles the library once a block, however many pairs there are. `rare_pairs` joins rare tokens and verifies what meets; it is taken instead
    if there are several blocks and the sets to verify weigh less than the library taken once a block.
    """
    size = F.greatest(F.size("tokens"), F.lit(0))
    held, rows = pages.where("page IS NOT NULL").agg(F.coalesce(F.sum(size), F.lit(0)), F.count_if(size > 0)).first()
    blocks = -(-held // HELD) or 1
    if blocks > 1 and few_meet(pages, library, least_jaccard, least_overlap, held / rows, blocks):
        return rare_pairs(pages, library, least_jaccard, least_overlap)
    return block_pairs(pages, library, least_jaccard, least_overlap, blocks)


def few_meet(pages: DataFrame, library: DataFrame, least_jaccard: float, least_overlap: float, mean: float, blocks: int) -> bool:
    """Whether the pairs that rare tokens bring together, each with a page's `mean` tokens, have fewer tokens than the library taken `blocks` times.

    Estimated from the frequencies of all tokens by powers of two, at most 64 rows: the rarest tokens that make up a prefix's share of all
    tokens, each with as many pairs as it has rows here times rows there. Both ways are exact, so the estimate decides on cost alone.
    """
    a, b = pages.where("page IS NOT NULL"), library.where("slide IS NOT NULL")
    each = a.select(F.explode("tokens").alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.explode("tokens").alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    df = each.groupBy("t").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    classes = df.groupBy(F.floor(F.log2(F.col("a") + F.col("b"))).alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("pairs")).orderBy("k").collect()
    met = 0.0
    for side, share in (("a", min(least_jaccard, least_overlap)), ("b", least_overlap)):
        rest = (1 - share) * sum(r[side] for r in classes)
        for r in classes:
            if rest > 0:
                met, rest = met + r.pairs, rest - r[side]
    return met * mean <= blocks * sum(r.b for r in classes)


def block_pairs(pages: DataFrame, library: DataFrame, least_jaccard: float, least_overlap: float, blocks: int = 1) -> DataFrame:
    """The pairs of `token_pairs` by cells: each row of the library meets each block of pages in one of the block's cells.

    The library's rows are dealt out once for each block, and a block's pages are repeated for its cells, a number that doesn't depend on the
    pages. In a cell the pages come first and make an inverted index of about HELD tokens; the library's rows pass it one by one, and
    their common tokens with all pages of the block are counted together. No pair is shuffled.
    """
    spark = library.sparkSession
    ship(spark)
    kinds = (dict(pages.dtypes)["page"], dict(library.dtypes)["slide"])
    groups = max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, key: str, every: int, cell: Column) -> DataFrame:
        df = df.where(F.col(key).isNotNull()).select(key, "tokens").withColumn("every", F.explode(F.sequence(F.lit(0), F.lit(every - 1))))
        side = {"page": F.lit(None).cast(kinds[0]), "slide": F.lit(None).cast(kinds[1])} | {key: F.col(key)}
        return df.select(cell.cast("int").alias("cell"), F.lit(key == "slide").alias("passes"), *[c.alias(name) for name, c in side.items()], "tokens")

    every = F.col("every")
    both = dealt(pages.where("size(tokens) > 0"), "page", groups, F.pmod(F.xxhash64("page"), F.lit(blocks)) * groups + every)
    both = both.unionByName(dealt(library, "slide", blocks, every * groups + F.pmod(F.xxhash64("slide"), F.lit(groups))))
    cells = both.repartitionById(blocks * groups, "cell").sortWithinPartitions("cell", "passes")

    def numbered(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list]:
        """The size of each set, the tokens of all sets as numbers, and what the numbers stand for."""
        coded = lists.flatten().dictionary_encode(null_encoding="encode")
        return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            cell, passes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "passes"))
            bounds = [0, *(np.flatnonzero((np.diff(cell) != 0) | (passes[1:] != passes[:-1])) + 1), len(cell)]
            for first, last in zip(bounds, bounds[1:]):
                part = batch.slice(first, last - first)
                if not len(part):
                    continue
                if cell[first] != at:
                    at, held, index = cell[first], [], None
                if not passes[first]:
                    held.append(part)
                    continue
                if index is None:
                    names = pa.concat_arrays([b.column("page") for b in held]) if held else pa.array([])
                    sizes, codes, words = numbered(pa.concat_arrays([b.column("tokens") for b in held])) if held else (np.zeros(0, int), np.zeros(0, int), [])
                    owners = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(codes, kind="stable")]
                    postings = np.split(owners, np.cumsum(np.bincount(codes, minlength=len(words)))[:-1])
                    index, held = {w: k for k, w in enumerate(words)}, []
                if index:
                    yield from met(part, names, sizes, index, postings)

    def met(part: pa.RecordBatch, names: pa.Array, sizes: np.ndarray, index: dict, postings: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths, codes, words = numbered(part.column("tokens"))
        known = np.array([index.get(w, -1) for w in words], dtype=np.int64)[codes]
        ends = np.cumsum(lengths)
        found, rows = [], 0

        def flush() -> pa.RecordBatch:
            page, slide, jac, ovl = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([names.take(pa.array(page)), part.column("slide").take(pa.array(slide)), pa.array(jac), pa.array(ovl)], names=["page", "slide", "jaccard", "overlap"])

        for k, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
            lists = [postings[t] for t in known[end - n : end].tolist() if t >= 0]
            if not lists:
                continue
            common = np.bincount(np.concatenate(lists), minlength=len(sizes))
            jac, ovl = common / (sizes + n - common), common / np.minimum(sizes, n)
            hit = np.flatnonzero((jac >= least_jaccard - 1e-12) | (ovl >= least_overlap - 1e-12))
            if len(hit):
                found.append((hit, np.full(len(hit), k), jac[hit], ovl[hit]))
                rows += len(hit)
            if rows >= FLUSH:
                yield flush()
                found, rows = [], 0
        if found:
            yield flush()

    return cells.mapInArrow(run, f"page {kinds[0]}, slide {kinds[1]}, jaccard double, overlap double")


def rare_pairs(pages: DataFrame, library: DataFrame, least_jaccard: float, least_overlap: float) -> DataFrame:
    """The pairs of `token_pairs` by an inverted-index join on rare tokens.

    With the thresholds 0.2 and 0.4 a matching pair has at least 0.2 |A| tokens in common if B has half
    of |A| or more, and 0.4 |B| if it has fewer; so it shares a token with the rare prefix of A, or of B, of that length. (In
    general: min(j, o) |A| from |B| = min(1, j / o) |A| on, else o |B|.) Frequent tokens fall outside the prefixes, nothing is
    dropped, and every pair is verified on the whole sets.
    """
    a = pages.select(F.col("page"), "tokens", F.size("tokens").alias("n")).where("page IS NOT NULL AND n > 0")
    b = library.select(F.col("slide"), "tokens", F.size("tokens").alias("n")).where("slide IS NOT NULL AND n > 0")
    df = a.select(F.explode("tokens").alias("t")).unionByName(b.select(F.explode("tokens").alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def posted(side: DataFrame, key: str, share: float) -> DataFrame:
        long = side.select(key, "n", F.explode("tokens").alias("t")).join(df, "t")
        rank = F.row_number().over(Window.partitionBy(key).orderBy("df", "t"))
        rare = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
        return long.withColumn("rare", rank <= rare).select(key, F.col("n").alias(f"n_{key}"), "t", F.col("rare").alias(f"rare_{key}"))

    turn = min(1.0, least_jaccard / least_overlap)
    left, right = cut(posted(a, "page", min(least_jaccard, least_overlap))), cut(posted(b, "slide", least_overlap))
    far = F.col("n_slide") >= F.col("n_page") * turn - 1e-9
    # only rare postings of the side whose prefix decides are joined, so no frequent token brings all pages and slides together
    by_page = left.where("rare_page").join(right, "t").where(far)
    by_slide = left.join(right.where("rare_slide"), "t").where(~far)
    met = by_page.select("page", "slide").unionByName(by_slide.select("page", "slide")).distinct()
    both = met.join(a.select("page", F.col("tokens").alias("ta")), "page").join(b.select("slide", F.col("tokens").alias("tb")), "slide")
    scored = both.select("page", "slide", jaccard("ta", "tb").alias("jaccard"), overlap("ta", "tb").alias("overlap"))
    return scored.where((F.col("jaccard") >= least_jaccard - 1e-12) | (F.col("overlap") >= least_overlap - 1e-12))


def query_pairs(pages: DataFrame, library: DataFrame, least_jaccard: float = 0.20, least_overlap: float = 0.40) -> DataFrame:
    """The same pairs as `token_pairs` for a query set of pages that is small beside the library.

    The pages are taken in blocks of BLOCK; a block's inverted index (a bounded size) is sent to the executors, and the library passes it
    once without a shuffle: common tokens of a row with all pages of a block are counted together.
    """
    spark = library.sparkSession
    ship(spark)
    kinds = (dict(pages.dtypes)["page"], dict(library.dtypes)["slide"])
    rows = spread(library.select("slide", "tokens").where("slide IS NOT NULL AND size(tokens) > 0"))

    def passed(block: list) -> DataFrame:
        index: dict[str, list[int]] = {}
        for k, (_, tokens) in enumerate(block):
            for t in tokens:
                index.setdefault(t, []).append(k)
        held = spark.sparkContext.broadcast(({t: np.array(v, dtype=np.int32) for t, v in index.items()}, [p for p, _ in block], np.array([len(t) for _, t in block])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            postings, names, sizes = held.value
            for pdf in batches:
                out: list[tuple] = []
                for slide, tokens in zip(pdf["slide"], pdf["tokens"], strict=True):
                    found = [postings[t] for t in tokens if t in postings]
                    if found:
                        common = np.bincount(np.concatenate(found), minlength=len(names))
                        jac, ovl = common / (sizes + len(tokens) - common), common / np.minimum(sizes, len(tokens))
                        for k in np.flatnonzero((jac >= least_jaccard - 1e-12) | (ovl >= least_overlap - 1e-12)):
                            out.append((names[k], slide, jac[k], ovl[k]))
                yield pd.DataFrame(out, columns=["page", "slide", "jaccard", "overlap"])

        return rows.mapInPandas(run, f"page {kinds[0]}, slide {kinds[1]}, jaccard double, overlap double")

    out, block = None, []
    for r in pages.select("page", "tokens").where("page IS NOT NULL AND size(tokens) > 0").toLocalIterator():
        block.append((r.page, r.tokens))
        if len(block) == BLOCK:
            out, block = passed(block) if out is None else out.unionByName(passed(block)), []
    if block or out is None:
        out = passed(block) if out is None else out.unionByName(passed(block))
    return out


def token_pairs_within(sets: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b, jaccard), a < b, for pairs of one table by the prefix-filtered join of `token_pairs`."""
    pairs = token_pairs(sets.select(F.col(key).alias("page"), "tokens"), sets.select(F.col(key).alias("slide"), "tokens"), least, 2.0)
    return pairs.where("page < slide").select(F.col("page").alias("a"), F.col("slide").alias("b"), "jaccard")


def best_per_page(pairs: DataFrame, order: DataFrame, k: int = 3) -> DataFrame:
    """The k best slides of each page by max(jaccard, overlap), ties by the library's order (slide, row_seq)."""
    scored = pairs.join(order, "slide").withColumn("score", F.greatest("jaccard", "overlap"))
    w = Window.partitionBy("page").orderBy(F.round("score", 9).desc(), "row_seq", "slide")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tier_matches(pages: DataFrame, library: DataFrame, key: str, tiers: Sequence[tuple[str, str]], order: str, earlier: bool = False) -> DataFrame:
    """(key, tier, match): for each tier (name, column) the first library row with the page's value; null values match nothing.

    With `earlier` only a library row that came before the page counts, as when pages are probed in order of arrival.
    """
    out = None
    for name, column in tiers:
        first = library.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("match"))).alias("f"))
        hit = pages.select(key, F.col(order).alias("o"), column).where(F.col(column).isNotNull()).join(first, column)
        if earlier:
            hit = hit.where(F.col("f.o") < F.col("o"))
        hit = hit.select(key, F.col("o").alias(order), F.lit(name).alias("tier"), F.col("f.match").alias("match"))
        out = hit if out is None else out.unionByName(hit)
    return out


def first_tier(matches: DataFrame, keys: Sequence[str], tiers: Sequence[str]) -> DataFrame:
    """The match of the first tier that has one, for each page."""
    place = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    best = matches.groupBy(*keys).agg(F.min(F.struct(place.alias("place"), "tier", "match")).alias("b"))
    return best.select(*keys, "b.tier", "b.match")


def reused(links: DataFrame, asset: str, slide: str, least: int = 3) -> DataFrame:
    """Assets on `least` or more distinct slides: scenery rather than content."""
    return links.where(F.col(asset).isNotNull()).groupBy(asset).agg(F.count_distinct(slide).alias("slides")).where(F.col("slides") >= least)


def shared_assets(links: DataFrame, assets: DataFrame, slides: DataFrame, least_bytes: int, kinds: Sequence[str], scenery: int = 3, other_decks: bool = True) -> DataFrame:
    """(asset_hash, slide_a, slide_b), slide_a < slide_b: slides that share a content asset.

    Only assets of the given extensions (lower case, with a dot) and size; those on `scenery` or more slides are dropped before the
    join, which bounds what a pair of slides can come from. With `other_decks`, pairs within a deck are left out.
    """
    kind = F.lower(F.when(F.col("ext").startswith("."), F.col("ext")).otherwise(F.concat(F.lit("."), "ext")))
    wanted = assets.where((F.col("size_bytes") >= least_bytes) & kind.isin(*kinds)).select(F.col("hash").alias("asset_hash"))
    common = reused(links, "asset_hash", "slide_id", scenery).select("asset_hash")
    used = links.where("asset_hash IS NOT NULL AND slide_id IS NOT NULL").select("asset_hash", "slide_id").distinct()
    used = used.join(common, "asset_hash", "left_anti").join(wanted, "asset_hash", "left_semi")
    decks = slides.select(F.col("id").alias("slide_id"), "deck_id").distinct()
    used = used.join(decks, "slide_id")
    a = used.select("asset_hash", F.col("slide_id").alias("slide_a"), F.col("deck_id").alias("deck_a"))
    b = used.select("asset_hash", F.col("slide_id").alias("slide_b"), F.col("deck_id").alias("deck_b"))
    out = a.join(b, "asset_hash").where("slide_a < slide_b")
    return (out.where("deck_a <> deck_b") if other_decks else out).select("asset_hash", "slide_a", "slide_b")


def unify(channels: Mapping[str, DataFrame], keys: Sequence[str], weights: Mapping[str, int]) -> DataFrame:
    """One record per candidate over all channels: (keys, channels, score), channels sorted by weight, score the sum of their weights."""
    every = None
    for name, df in channels.items():
        one = df.select(*keys, F.struct(F.lit(-weights[name]).alias("w"), F.lit(name).alias("name")).alias("c")).distinct()
        every = one if every is None else every.unionByName(one)
    merged = every.groupBy(*keys).agg(F.sort_array(F.collect_set("c")).alias("cs"))
    total = F.aggregate("cs", F.lit(0), lambda n, x: n - x["w"])
    return merged.select(*keys, F.concat_ws(",", "cs.name").alias("channels"), total.alias("score"))


def precision(candidates: DataFrame, labels: DataFrame, keys: Sequence[str], good: Sequence[str], bad: Sequence[str]) -> DataFrame:
    """(channel, good, bad, unlabelled, precision) of candidates (keys, channel) against labels (keys, label).

    A label in neither list counts as unlabelled, like none; precision is null where nothing is labelled.
    """
    joined = candidates.select(*keys, "channel").distinct().join(labels.select(*keys, "label"), list(keys), "left")
    g, b = F.col("label").isin(*good), F.col("label").isin(*bad)
    n = joined.groupBy("channel").agg(F.count_if(g).alias("good"), F.count_if(b).alias("bad"), F.count_if(F.coalesce(~(g | b), F.lit(True))).alias("unlabelled"))
    return n.withColumn("precision", F.when(F.col("good") + F.col("bad") > 0, F.round(F.col("good") / (F.col("good") + F.col("bad")), 6)))


def popularity(candidates: DataFrame, target: str, n: int = 10) -> DataFrame:
    """The n targets with most candidates, ties by target."""
    return candidates.groupBy(target).agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), target).limit(n)
