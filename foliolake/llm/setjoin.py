"""All similar pairs of set-valued records by metric pivot partitioning.

A pivot is a group of members, and a record's distance to it is the Jaccard distance to the nearest set of
those members, 1 - |x & P| / |x|. As the distance to a set of points of a metric space it obeys the triangle
inequality: records within eps of each other differ by eps at most in it. A record's home is its nearest
pivot; every other record is copied into the cells of the pivots that it is within radius + eps of, and
cells are joined exactly. Pivots grow around records by votes, so that members which occur together lie in
one pivot; their number is fixed, whatever the number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import digest, salted_join
from ..session import cut

#: Number of pivots.
PIVOTS = 1024
#: Rounds in which records and members vote for their pivot.
ROUNDS = 1
#: A member of a larger share of the sets belongs to no pivot; there are at most mean set size / FREQUENT of them.
FREQUENT = 0.005
#: Stands for the pivot of frequent members, and for the cell of sets without a home.
NO_PIVOT = -1
_TINY = 1e-9


def numbered(df: DataFrame, member: str) -> DataFrame:
    """df with members as 64-bit numbers, an eighth of the size of a long hash to shuffle; as they are, should two of them share one."""
    number, other = F.xxhash64(member), F.xxhash64(F.lit(7), member)
    met = df.where(F.col(member).isNotNull()).groupBy(number.alias("n")).agg(F.min(other).alias("least"), F.max(other).alias("most"))
    if not met.where("least <> most").isEmpty():
        return df
    return df.withColumn(member, F.when(F.col(member).isNotNull(), number))


def record_sets(df: DataFrame, record: str, member: str, least: int = 1) -> DataFrame:
    """(record, set_id, members, n): the distinct non-null members of each record with a non-null id, sorted; records below `least` are
    left out, and equal sets have one set_id."""
    pairs = df.select(F.col(record).alias("record"), F.col(member).alias("member")).where("record IS NOT NULL AND member IS NOT NULL")
    sets = pairs.groupBy("record").agg(F.sort_array(F.collect_set("member")).alias("members")).withColumn("n", F.size("members"))
    return sets.where(F.col("n") >= least).select("record", digest("members").alias("set_id"), "members", "n")


def rare_first(sets: DataFrame, key: str = "set_id") -> DataFrame:
    """Members of each distinct set in their order of global rarity: (key, n, ranked array of (df, member)).

    The counts run over all sets; the order is total, ties by the member itself.
    """
    long = sets.select(key, "n", F.explode("members").alias("member"))
    counts = long.groupBy("member").agg(F.count(F.lit(1)).alias("df")).withColumn("weight", F.col("df"))
    total = float(long.count())
    met = salted_join(long, counts.select("member", "df"), "member", counts.select("member", "weight"), total)
    return met.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("df", "member"))).alias("ranked"))


def _prefix(least: Column | float) -> Column:
    """Length of the rare prefix in which two sets of similarity `least` or more must share a member."""
    return F.col("n") - F.ceil(F.col("n") * least - _TINY) + 1


def _common(a: str, b: str) -> Column:
    return F.size(F.array_intersect(F.col(a), F.col(b)))


def prefix_join(records: DataFrame, pivots: DataFrame, least: float) -> DataFrame:
    """(set_id, pivot, sim) of records and pivots of similarity `least` or more, exactly."""
    def prefixed(df: DataFrame, name: str) -> DataFrame:
        p = df.select(F.col("set_id").alias(name), F.col("n"), F.posexplode(F.slice("ranked", F.lit(1), _prefix(least).cast("int"))).alias("pos", "m"), "members")
        return p.select(name, F.col("m.member").alias("member"), F.col("pos").alias(f"{name}_pos"), F.col("n").alias(f"{name}_n"), F.col("members").alias(f"{name}_members"))

    met = prefixed(records, "set_id").join(prefixed(pivots, "pivot"), "member")
    n, m = F.col("set_id_n"), F.col("pivot_n")
    # length filter, then positions: the members up to here plus all that can still follow must suffice
    met = met.where((n >= m * least - _TINY) & (m >= n * least - _TINY))
    most = F.least(n - F.col("set_id_pos"), m - F.col("pivot_pos")) + F.least(F.col("set_id_pos"), F.col("pivot_pos"))
    met = met.where(most >= (n + m) * (least / (1 + least)) - _TINY)
    found = met.withColumn("common", _common("set_id_members", "pivot_members")).where(F.col("common") >= (n + m) * (least / (1 + least)) - _TINY)
    return found.select("set_id", "pivot", (F.col("common") / (n + m - F.col("common"))).alias("sim")).distinct()


def _count_of(values: Column, value: Column) -> Column:
    return F.size(values) - F.size(F.array_remove(values, value))


def _most(values: Column) -> Column:
    """The number from 0 to 2^31 - 1 that an array holds most often, ties to the least; null if it holds none. Smaller numbers don't count."""
    top = (1 << 31) - 1
    held = F.filter(values, lambda v: v >= 0)
    best = F.array_max(F.transform(F.array_distinct(held), lambda v: F.shiftleft(_count_of(held, v).cast("bigint"), 31) + (top - v)))
    return (top - best.bitwiseAND(F.lit(top))).cast("int")


def placed(sets: DataFrame, threshold: float, pivots: int = PIVOTS, rounds: int = ROUNDS, frequent: float = FREQUENT) -> DataFrame:
    """(set_id, n, members, pivots, dfs, share, home): each set's members with their pivots and counts, in the order of pivot, count and member; its nearest pivot and the share of its members there.

    A member's first pivot is the least number among the records that hold it; then records take the pivot of most of
    their members and members that of most of their records. Frequent members have NO_PIVOT. `home` is null for a set
    whose nearest pivot is too far for the triangle inequality to say anything: a partner at the threshold may have nothing in it.
    """
    count = sets.count()
    # member numbers don't differ by pivot, so votes are counted within PIVOTS numbers
    long = sets.select("set_id", "n", F.explode("members").alias("member"), F.pmod(F.col("set_id.hi"), F.lit(pivots)).cast("int").alias("vote"))
    members = long.groupBy("member").agg(F.count(F.lit(1)).alias("df"), F.min("vote").alias("vote"))
    often = F.broadcast(members.where(F.col("df") > frequent * count).select("member", "df", F.lit(None).cast("int").alias("vote")))
    rare = members.where(F.col("df") <= frequent * count)
    few = long.select("set_id", "n", "member").join(often.select("member"), "member", "left_anti")
    many = long.select("set_id", "n", "member").join(often, "member")
    for _ in range(rounds):
        votes = few.join(rare, "member").groupBy("set_id").agg(F.mode("vote", True).alias("vote"), F.collect_list(F.struct("member", "df")).alias("m"))
        rare = votes.select("vote", F.explode("m").alias("m")).groupBy("m.member", "m.df").agg(F.mode("vote", True).alias("vote")).select("member", "df", "vote")
    held = few.join(rare, "member").unionByName(many)
    ranked = held.groupBy("set_id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("vote", F.lit(NO_PIVOT)).alias("pivot"), "df", "member"))).alias("r"))
    ranked = ranked.select("set_id", "n", F.col("r.member").alias("members"), F.col("r.pivot").alias("pivots"), F.col("r.df").alias("dfs")).withColumn("home", _most(F.col("pivots")))
    share = _count_of(F.col("pivots"), F.col("home")) / F.col("n")
    within = share > 1 - threshold + _TINY
    return ranked.withColumns({"share": F.when(within, share), "home": F.when(within, F.col("home"))})


def _postings(homed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Home postings and copy postings (cell, member, set_id, n, home, share, members): the rarest members of each set within each pivot near enough.

    Two sets of similarity t or more lack at most n - tn members of each other, so among the members they share in a pivot
    the rarest is one of the first n - tn + 1 of either there. Members lie in one pivot each, and cells are
    split by member: no task holds a whole cell. Cell -1 takes the sets without a home, with their rarest members of all.
    """
    base = homed.select("set_id", "n", "home", "members", "pivots", F.posexplode("members").alias("pos", "member"))
    base = base.withColumn("cell", F.get("pivots", "pos")).where(F.col("cell") > NO_PIVOT)
    base = base.where(F.col("pos") - F.array_position("pivots", F.col("cell")) + 1 < _prefix(threshold))
    cells = base.select("cell", "member", "set_id", "n", "home", (_count_of(F.col("pivots"), F.col("cell")) / F.col("n")).alias("share"), "members")
    by_df = F.array_sort(F.arrays_zip(F.col("dfs"), F.col("members")))
    loose = homed.where("home IS NULL").select("set_id", "n", "home", "members", F.explode(F.slice(by_df, F.lit(1), _prefix(threshold).cast("int"))).alias("r"))
    loose = loose.select(F.lit(NO_PIVOT).alias("cell"), F.col("r.members").alias("member"), "set_id", "n", "home", F.lit(None).cast("double").alias("share"), "members")
    # one row a pivot, so at most PIVOTS: the share that the farthest set at home there has in it
    radii = F.broadcast(homed.where("home IS NOT NULL").groupBy(F.col("home").alias("cell")).agg(F.min("share").alias("farthest")))
    copies = cells.join(radii, "cell").where(F.col("share") >= F.col("farthest") - (1 - threshold) - _TINY).drop("farthest")
    return cells.where(F.col("cell") == F.col("home")).unionByName(loose), copies.unionByName(loose)


def similar_sets(sets: DataFrame, threshold: float, pivots: int = PIVOTS, rounds: int = ROUNDS, frequent: float = FREQUENT) -> DataFrame:
    """(set_a, set_b), set_a < set_b: all pairs of distinct sets with similarity `threshold` or more, which counts itself.

    `sets` has set_id (of `digest`), n and members, one row per distinct set. A pair is found in the cell of the smaller id; in that
    of the other one if the smaller has no home; in cell -1 if neither has one. Exact for every threshold above 0 and any pivots.
    """
    homed = cut(placed(sets, threshold, pivots, rounds, frequent))
    homes, copies = _postings(homed, threshold)
    a = homes.select("cell", "member", F.col("set_id").alias("x"), F.col("n").alias("n_x"), F.col("share").alias("share_x"), F.col("members").alias("members_x"))
    b = copies.select("cell", "member", F.col("set_id").alias("y"), F.col("n").alias("n_y"), F.col("share").alias("share_y"), F.col("members").alias("members_y"), F.col("home").isNull().alias("loose"))
    n, m = F.col("n_x"), F.col("n_y")
    met = a.join(b, ["cell", "member"]).where((F.col("x") < F.col("y")) | (F.col("loose") & (F.col("cell") > NO_PIVOT)))
    met = met.where((n >= m * threshold - _TINY) & (m >= n * threshold - _TINY))
    # the triangle inequality for the two at hand
    met = met.where((F.col("cell") == NO_PIVOT) | (F.abs(F.col("share_x") - F.col("share_y")) <= 1 - threshold + _TINY))
    met = met.where(_common("members_x", "members_y") >= (n + m) * (threshold / (1 + threshold)) - _TINY)
    return met.select(F.least("x", "y").alias("set_a"), F.greatest("x", "y").alias("set_b")).distinct()


def similar_records(df: DataFrame, record: str, member: str, threshold: float, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, membership) of records whose distinct non-null members have a Jaccard similarity of `threshold` or more.

    Records with equal members are one class: classes is (set_id, n, copies), links (set_a, set_b) the pairs of different
    classes that are similar, membership (set_id, record). Records with fewer than `least` distinct members, a null id or null members
    only are in no class; repeated rows count once; an empty table has no classes.
    """
    records = cut(record_sets(numbered(df.select(record, member), member), record, member, least))
    classes = cut(records.groupBy("set_id", "members", "n").agg(F.count(F.lit(1)).alias("copies")))
    links = similar_sets(classes.select("set_id", "n", "members"), threshold)
    return classes.select("set_id", "n", "copies"), links, records.select("set_id", "record")


def named(links: DataFrame, membership: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_a, set_b, one, two): the records of both ends of each link; the records of a class with many copies are dealt out."""
    weights = classes.select("set_id", F.col("copies").alias("weight"))
    total = float(classes.agg(F.sum("copies")).collect()[0][0] or 1)
    one = salted_join(membership.withColumnsRenamed({"set_id": "set_a", "record": "one"}), links, "set_a", weights.withColumnRenamed("set_id", "set_a"), total)
    return salted_join(membership.withColumnsRenamed({"set_id": "set_b", "record": "two"}), one, "set_b", weights.withColumnRenamed("set_id", "set_b"), total)


def expanded(classes: DataFrame, links: DataFrame, membership: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of records of linked classes and of one class, where a result has to name them all."""
    several = classes.where("copies > 1").select(F.col("set_id").alias("set_a"), F.col("set_id").alias("set_b"))
    both = named(links.unionByName(several), membership, classes)
    both = both.where((F.col("one") < F.col("two")) | ((F.col("set_a") != F.col("set_b")) & (F.col("one") != F.col("two"))))
    return both.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
