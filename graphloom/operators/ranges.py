"""Questions on ranges of an ordered table: where bounds fall, how many values of a range lie below one, its k-th value.

No form pairs rows with the rows of their range.  Bounds are sorted in among the values, and running sums tell how
many values come before.  For counts and order statistics, the values' ranks are cut into nodes of a merge-sort
tree: a range of ranks below a bound is a few whole nodes a level, and within a node the sums before the
two ends of a range of places differ by the node's members between them.  The rows that are sorted are in proportion
to points and questions times the levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import prefix_sums
from ..storage import materialize

#: Bits of a level of the tree for counts (every level sorts all points), and for order statistics (every level is a round).
COUNT_BITS = 2
KTH_BITS = 6


def window_ranks(points: DataFrame, windows: DataFrame) -> DataFrame:
    """``key, first, last``: ranks (from 0) of the first and last point within [lo, hi]; an empty window has last < first.

    ``points`` is (x, n), distinct values with their numbers of rows; ``windows`` (key, lo, hi).  Nulls take no part.
    """
    windows = windows.where("key is not null and lo is not null and hi is not null")
    held = points.where("x is not null").select(F.col("x").cast("double").alias("x"), F.col("n").cast("long").alias("n"), F.lit(1).alias("side"), F.lit(None).cast(windows.schema["key"].dataType).alias("key"))
    ends = lambda c, side: windows.select(F.col(c).cast("double").alias("x"), F.lit(0).cast("long").alias("n"), F.lit(side).alias("side"), "key")
    # a lower bound comes before the points equal to it, an upper one after them
    both = prefix_sums(held.unionByName(ends("lo", 0)).unionByName(ends("hi", 2)), [F.col("x").asc(), F.col("side").asc(), F.col("key").asc()], F.col("n"))
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("before")))
    return both.where("side <> 1").groupBy("key").agg(at(0).alias("first"), (at(2) - 1).alias("last"))


def window_counts(left: DataFrame, right: DataFrame, share: float = 0.1) -> DataFrame:
    """``id, n, lo, hi``: of each ``left`` row (id, degree) the number of ``right`` degrees (other_degree) within ``share`` of its own, the least and the largest.

    Rows without any are left out, as a join would.  Only distinct degrees are sorted.
    """
    points = prefix_sums(right.where("other_degree is not null").groupBy(F.col("other_degree").alias("x")).agg(F.count("*").alias("n")), [F.col("x").asc()], F.col("n"), "first")
    points = materialize(points, "window-points")
    degree = F.col("degree")
    found = window_ranks(points, left.select("degree").distinct().select(degree.alias("key"), ((1 - share) * degree).alias("lo"), ((1 + share) * degree).alias("hi"))).where("last >= first")
    # a window begins and ends with whole runs of equal degrees
    found = found.join(points.select("first", F.col("x").alias("lo")), "first").join(points.select((F.col("first") + F.col("n") - 1).alias("last"), F.col("x").alias("hi")), "last")
    return left.join(found.select(F.col("key").alias("degree"), (F.col("last") - F.col("first") + 1).alias("n"), "lo", "hi"), "degree").select("id", "n", "lo", "hi")


def _levels(n: int, bits: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // bits))


def _members(points: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n``: for each key, how many ``points`` (node, pos) its events (keys, node, first, last) enclose, summed up."""
    pair = F.explode(F.array(F.struct(F.col("last").alias("pos"), F.lit(1).alias("sign")), F.struct((F.col("first") - 1).alias("pos"), F.lit(-1).alias("sign"))))
    ends = events.select(*keys, "node", pair.alias("e")).select(*keys, "node", "e.pos", "e.sign")
    both = points.select("node", "pos", F.lit(0).alias("sign")).unionByName(ends, allowMissingColumns=True)
    # ties go by key, so that many equal ends don't meet in one task
    order = [F.col("node").asc(), F.col("pos").asc(), F.abs("sign").asc(), *[F.col(k).asc() for k in keys]]
    told = prefix_sums(both, order, (F.col("sign") == 0).cast("long"), "before").where("sign <> 0")
    return told.groupBy(*keys).agg(F.sum(F.col("sign") * F.col("before")).alias("n"))


def count_below(points: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """``first, last, v, below`` for each distinct row of ``asked`` (first, last, v): points with first <= pos <= last and a rank under v.

    ``points`` is (pos, v), two orders of the same ``n`` rows, both from 0 without gaps.
    """
    levels, top = _levels(n, COUNT_BITS), 2**COUNT_BITS
    asked = asked.select("first", "last", "v").distinct()
    shifts = [COUNT_BITS * (levels - j) for j in range(1, levels + 1)]
    node = lambda s: F.shiftright("v", s)
    # (level, node) as one sortable number: nodes of a level are fewer than 2 ** (bits * levels)
    named = lambda j, c: F.lit(j << (COUNT_BITS * levels)).cast("long") + c
    cut = points.select("pos", F.explode(F.array(*[named(j, node(s)) for j, s in enumerate(shifts)])).alias("node"))

    def smaller(j: int, s: int) -> Column:
        """The level's siblings below the node that holds v."""
        own = node(s) % top
        return F.when(own > 0, F.transform(F.sequence(F.lit(0).cast("long"), own - 1), lambda d: named(j, node(s) - own + d))).otherwise(F.array().cast("array<bigint>"))

    keys = ["first", "last", "v"]
    inside = _members(cut, asked.select(*keys, F.explode(F.concat(*[smaller(j, s) for j, s in enumerate(shifts)])).alias("node")), keys)
    return asked.join(inside, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("below"))


def kth(points: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """``first, last, k, v`` for each distinct row of ``asked`` (first, last, k): the k-th least rank (k from 0) among the points there.

    ``points`` as for ``count_below``; k must be less than the number of places.  A round for each level, log64(n) in all.
    """
    levels, keys = _levels(n, KTH_BITS), ["first", "last", "k"]
    width = 2**KTH_BITS
    state = asked.select(*keys).distinct().withColumn("left", F.col("k").cast("long")).withColumn("v", F.lit(0).cast("long"))
    for j in range(1, levels + 1):
        cut = points.select("pos", F.shiftright("v", KTH_BITS * (levels - j)).alias("node"))
        base = F.col("v") * width
        children = state.select(*keys, F.explode(F.sequence(base, base + width - 1)).alias("node"))
        counts = _members(cut, children.withColumn("child", F.col("node")), [*keys, "child"])
        each = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("counts"))  # one entry for each child

        def step(acc, x):
            here = (acc["v"] < 0) & (acc["left"] < x["n"])
            return F.struct(F.when((acc["v"] < 0) & ~here, acc["left"] - x["n"]).otherwise(acc["left"]).alias("left"), F.when(here, x["child"]).otherwise(acc["v"]).alias("v"))

        start = F.struct(F.col("left").alias("left"), F.lit(-1).cast("long").alias("v"))
        state = state.drop("v").join(each, keys).select(*keys, F.aggregate("counts", start, step).alias("s")).select(*keys, "s.left", "s.v")
        state = materialize(state, "kth")
    return state.select(*keys, "v")
