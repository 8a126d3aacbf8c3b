"""Range joins, degree peers, and matched controls."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import draw, global_rank, portable_hash
from ..storage import materialize
from .ranges import count_below, kth, window_ranks

#: Half-width of a window on log10(degree + 1).
LOG_WINDOW = math.log10(1.1)


def window_join(left: DataFrame, right: DataFrame, share: float = 0.1) -> DataFrame:
    """Pairs of ``left`` (id, degree) and ``right`` (other, other_degree) with (1 - share) d <= other_degree <= (1 + share) d.

    No row meets more than its neighbourhood: degrees are cut into bins of one window on a logarithmic scale, the left
    side goes to its bin and the two beside it, an equi-join on bins is followed by the exact test.
    """
    width = math.log(1 + share) - math.log(1 - share)
    log = lambda c: F.floor(F.log(F.greatest(F.col(c).cast("double"), F.lit(1e-9))) / width)
    a = left.withColumn("__bin", F.explode(F.sequence(log("degree") - 1, log("degree") + 1)))
    b = right.withColumn("__bin", log("other_degree"))
    return a.join(b, "__bin").where(F.col("other_degree").between((1 - share) * F.col("degree"), (1 + share) * F.col("degree"))).drop("__bin")


def _windows(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """``degree, first, last``: of each distinct degree of ``left`` the ranks (degree, other) of the first and last ``right`` rows in its window."""
    degree = F.col("degree")
    held = right.groupBy(F.col("other_degree").alias("x")).agg(F.count("*").alias("n"))
    bounds = left.select("degree").distinct().select(degree.alias("key"), ((1 - share) * degree).alias("lo"), ((1 + share) * degree).alias("hi"))
    return window_ranks(held, bounds).where("last >= first").withColumnRenamed("key", "degree")


def _ranked(right: DataFrame) -> DataFrame:
    ranked = global_rank(right.where("other_degree is not null").select("other", "other_degree"), [F.col("other_degree").asc(), F.col("other").asc()], "rank")
    return materialize(ranked.withColumn("rank", F.col("rank") - 1), "matching-ranks")


def nearest_peer(left: DataFrame, right: DataFrame, share: float = 0.1) -> DataFrame:
    """``id, degree, other, other_degree``: of each ``left`` id the ``right`` row nearest in degree within the window, ties to the smaller id.

    Ids aren't their own peers, so of each degree two rows can matter.  Only distinct degrees are joined by range.
    """
    order = Window.partitionBy("other_degree").orderBy("other")
    two = right.select("other", "other_degree").distinct().withColumn("n", F.row_number().over(order)).where("n <= 2").groupBy("other_degree").agg(F.array_sort(F.collect_list("other")).alias("others"))
    near = window_join(left.select("degree").distinct(), two, share).withColumn("far", F.abs(F.col("other_degree") - F.col("degree")))
    # a degree whose only row is the id itself doesn't count: the nearest and, for that case, the next distances stay
    byfar = Window.partitionBy("degree").orderBy("far")
    near = near.withColumn("k", F.dense_rank().over(byfar)).where("k <= 2").groupBy("degree").agg(F.collect_list(F.struct("far", "other_degree", "others")).alias("near"))  # four degrees at most
    each = left.select("id", "degree").join(near, "degree").select("id", "degree", F.explode("near").alias("x")).select("id", "degree", "x.far", "x.other_degree", F.explode("x.others").alias("other")).where("id <> other")
    best = each.groupBy("id", "degree").agg(F.min(F.struct("far", "other", "other_degree")).alias("b"))
    return best.select("id", "degree", "b.other", "b.other_degree")


def random_match(left: DataFrame, right: DataFrame, salt: str, share: float = 0.1) -> DataFrame:
    """``id, degree, other, other_degree``: of each ``left`` id a random ``right`` row in the window, with replacement; never itself.

    The window's rows are numbered by (degree, other); a hash of (id, salt) that other engines have too draws one.
    No pairs are made.
    """
    ranked = _ranked(right)
    wanted = left.select("id", "degree").join(_windows(left, ranked, share), "degree").join(ranked.select(F.col("other").alias("id"), F.col("rank").alias("own"), F.col("other_degree").alias("own_degree")), "id", "left")
    own = F.col("own").between(F.col("first"), F.col("last"))
    n = F.col("last") - F.col("first") + 1 - F.coalesce(own.cast("long"), F.lit(0))
    at = F.col("first") + portable_hash(F.col("id"), salt) % F.greatest(F.col("n"), F.lit(1))
    drawn = wanted.withColumn("n", n).where("n > 0").withColumn("at", at)
    drawn = drawn.withColumn("rank", F.col("at") + F.coalesce((F.col("own").between(F.col("first"), F.col("last")) & (F.col("at") >= F.col("own"))).cast("long"), F.lit(0)))
    return drawn.join(ranked, "rank").select("id", "degree", "other", "other_degree")


def peers(population: DataFrame, subjects: DataFrame, exclude_self: bool = True, fallback: int = 50) -> DataFrame:
    """Each subject (id) with its peers (peer, value, own): within LOG_WINDOW on log10(degree + 1).

    ``population`` is (id, degree, value).  Where a subject's window is empty, its neighbours by rank take its place,
    ``fallback`` on each side.  With ``exclude_self`` a subject isn't its own peer, nor does it fill its window.
    """
    pop = population.select(F.col("id").alias("peer"), F.col("degree").alias("d"), F.log10(F.col("degree") + 1.0).alias("ld"), "value").withColumn("bin", F.floor(F.col("ld") / (2 * LOG_WINDOW)))
    ranked = global_rank(pop, [F.col("ld").asc(), F.col("peer").asc()], "r")
    subj = subjects.select("id").join(ranked.select(F.col("peer").alias("id"), F.col("ld").alias("own_ld"), F.col("value").alias("own"), F.col("bin").alias("own_bin"), F.col("r").alias("own_r")), "id")
    binned = subj.withColumn("bin", F.explode(F.sequence(F.col("own_bin") - 1, F.col("own_bin") + 1)))
    inside = binned.join(ranked, "bin").where(F.abs(F.col("ld") - F.col("own_ld")) <= LOG_WINDOW + 1e-12).select("id", "own", "peer", "value")
    inside = inside.where("id <> peer") if exclude_self else inside
    lonely = subj.join(inside.select("id").distinct(), "id", "left_anti").withColumn("r", F.explode(F.sequence(F.col("own_r") - fallback, F.col("own_r") + fallback - 1)))
    near = lonely.join(ranked.select("r", "peer", "value"), "r").select("id", "own", "peer", "value")
    return inside.unionByName(near.where("id <> peer") if exclude_self else near)


def peer_exceedance(population: DataFrame, subjects: DataFrame, fallback: int = 50) -> DataFrame:
    """``id, peer_pool_n, emp_p, peer_median, excess_ratio``: the exact share of peers with at least the subject's value.

    Peers are those of ``peers``, without the subject, but no row is made for a subject and a peer: a window is a range
    of places in order of degree, and counts and medians of ranges come from ``ranges``.  Rows whose degree or value is
    null take no part; a subject without any peer has no row.
    """
    pop = population.where("id is not null and degree is not null and value is not null").select("id", "value", F.log10(F.col("degree") + 1.0).alias("ld"))
    ranked = global_rank(pop, [F.col("ld").asc(), F.col("id").asc()], "pos").withColumn("pos", F.col("pos") - 1)
    ranked = materialize(global_rank(ranked, [F.col("value").asc(), F.col("id").asc()], "v").withColumn("v", F.col("v") - 1), "peer-ranks")
    n, points = ranked.count(), ranked.select("pos", "v")
    subj = ranked.join(subjects.select("id").distinct(), "id", "left_semi")
    lows = ranked.groupBy("value").agg(F.min("v").alias("low"))
    bounds = subj.select("ld").distinct().select(F.col("ld").alias("key"), (F.col("ld") - (LOG_WINDOW + 1e-12)).alias("lo"), (F.col("ld") + (LOG_WINDOW + 1e-12)).alias("hi"))
    windows = window_ranks(ranked.groupBy(F.col("ld").alias("x")).agg(F.count("*").alias("n")), bounds).withColumnRenamed("key", "ld")
    subj = subj.join(windows, "ld").join(lows, "value")
    alone = F.col("first") == F.col("last")
    subj = subj.select("id", "value", "v", "low", F.when(alone, F.greatest(F.col("pos") - fallback, F.lit(0))).otherwise(F.col("first")).alias("first"), F.when(alone, F.least(F.col("pos") + fallback - 1, F.lit(n - 1))).otherwise(F.col("last")).alias("last"))
    subj = materialize(subj.withColumn("peers", F.col("last") - F.col("first")).where("peers > 0"), "peer-subjects")
    below = count_below(points, subj.select("first", "last", F.col("low").alias("v")), n).withColumnRenamed("v", "low")
    # without the subject, the m-th value is the window's m-th or the one after: three order statistics serve all of a window
    middle = F.floor((F.col("peers") - 1) / 2)
    asked = subj.select("first", "last", "peers").distinct().withColumn("k", F.explode(F.sequence(middle, F.least(middle + 2, F.col("peers")))))
    found = kth(points, asked, n).join(ranked.select("v", F.col("value").alias("x")), "v")
    near = found.groupBy("first", "last").agg(F.array_sort(F.collect_list(F.struct("k", "v", "x"))).alias("near"))
    without = lambda i: F.when(F.col("v") > F.get("near", i)["v"], F.get("near", i)["x"]).otherwise(F.get("near", i + 1)["x"])
    upper = F.when(F.col("peers") % 2 == 1, without(0)).otherwise(without(1))
    p = subj.join(below, ["first", "last", "low"]).join(near, ["first", "last"]).withColumn("peer_median", 0.5 * without(0) + 0.5 * upper)
    emp_p = (F.col("peers") - F.col("below")) / F.col("peers")  # the subject itself is in the window and not below its value
    return p.select("id", F.col("peers").alias("peer_pool_n"), emp_p.alias("emp_p"), "peer_median", F.when(F.col("peer_median") > 0, F.col("value") / F.col("peer_median")).alias("excess_ratio"))


def monte_carlo_exceedance(population: DataFrame, subjects: DataFrame, draws: int = 2_000, seed: int = 14) -> DataFrame:
    """``id, emp_p`` from ``draws`` random peers with replacement for each subject.

    Each drawn peer reaches the subject's value with its exact exceedance, so hits are drawn and peers aren't: no row per draw.
    """
    exact = peer_exceedance(population, subjects)
    hits = F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), F.lit(0), lambda acc, i: acc + (draw(F.col("id"), i, seed) < F.col("emp_p")).cast("int"))
    return exact.select("id", (hits / draws).alias("emp_p"))


def greedy_match(cases: DataFrame, controls: DataFrame, share: float = 0.1) -> DataFrame:
    """One-to-one matches ``id, degree, other, other_degree`` without replacement, nearest in degree, within the window.

    Cases choose in order of decreasing degree (ties: smaller id); ties among controls go to the smaller id.  The
    choice depends on all earlier ones, so a sequence of dependent cases stays together; cases whose windows can't
    share a control are independent: where no case or control lies within a gap on the degree axis, the sequence is
    cut, and the parts are matched in parallel.  Only (id, degree) travels.
    """
    d = F.col("degree").cast("double")
    rows = cases.select("id", d.alias("degree"), F.lit(True).alias("case")).unionByName(controls.select(F.col("other").alias("id"), F.col("other_degree").cast("double").alias("degree"), F.lit(False).alias("case")))
    # the windows' union on the degree axis falls into separate stretches
    spans = cases.select(((1 - share) * d).alias("lo"), ((1 + share) * d).alias("hi")).distinct().orderBy("lo").toPandas()  # one row for each distinct degree
    stretches: list[list[float]] = []
    for lo, hi in spans.itertuples(index=False):
        if stretches and lo <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], hi)
        else:
            stretches.append([lo, hi])
    spark = cases.sparkSession
    if not stretches:
        return spark.createDataFrame([], "id long, degree double, other long, other_degree double")
    parts = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(stretches)], "part int, lo double, hi double")
    dealt = rows.join(F.broadcast(parts), F.col("degree").between(F.col("lo"), F.col("hi"))).select("part", "id", "degree", "case")
    return dealt.groupBy("part").applyInPandas(lambda frame: _greedy(frame, share), "id long, degree double, other long, other_degree double")


def _greedy(frame: pd.DataFrame, share: float) -> pd.DataFrame:
    from bisect import bisect_left

    free = sorted(frame.loc[~frame["case"], ["degree", "id"]].itertuples(index=False, name=None))
    out = []
    for minus, case in sorted((-d, i) for d, i in frame.loc[frame["case"], ["degree", "id"]].itertuples(index=False, name=None)):
        degree = -minus
        at = bisect_left(free, (degree, -math.inf))
        best = None
        if at < len(free) and free[at][0] <= (1 + share) * degree:
            best = (free[at][0] - degree, free[at][1], at)
        if at:
            first = bisect_left(free, (free[at - 1][0], -math.inf))  # the smallest id of the next lower degree
            if free[first][0] >= (1 - share) * degree:
                best = min(best, (degree - free[first][0], free[first][1], first)) if best else (degree - free[first][0], free[first][1], first)
        if best:
            d, other = free.pop(best[2])
            out.append((case, degree, other, d))
    return pd.DataFrame(out, columns=["id", "degree", "other", "other_degree"])


def greedy_match_by(df: DataFrame, case: Column, control: Column, id_col: str = "id", degree: str = "degree", share: float = 0.1) -> DataFrame:
    """``greedy_match`` of the rows of ``df`` where ``case`` holds with those where ``control`` does, by any columns and window."""
    return greedy_match(df.where(case).select(F.col(id_col).alias("id"), F.col(degree).alias("degree")), df.where(control).select(F.col(id_col).alias("other"), F.col(degree).alias("other_degree")), share)


def merged_labels(label: Column, merge: tuple[str, ...], name: str) -> Column:
    """The label, with those of ``merge`` under one name; null stays null."""
    return F.when(label.isin(*merge), F.lit(name)).otherwise(label)


def paired(matches: DataFrame, scores: DataFrame, eps: float = 1e-7) -> DataFrame:
    """``id, other, diff, log_ratio`` of the scores (id, score) of matched ids; the ratio is log10((case + eps) / (control + eps))."""
    a, b = scores.select("id", F.col("score").alias("x")), scores.select(F.col("id").alias("other"), F.col("score").alias("y"))
    both = matches.select("id", "other").join(a, "id").join(b, "other")
    return both.select("id", "other", (F.col("x") - F.col("y")).alias("diff"), F.log10((F.col("x") + eps) / (F.col("y") + eps)).alias("log_ratio"))
