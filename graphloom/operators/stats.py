"""Rank statistics, regression from sufficient statistics, resampling tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import average_rank, global_rank, prefix_sums
from ..storage import materialize
from .resampling import group_medians, signed_medians


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, rho``: Pearson's correlation of average ranks, over rows where neither is null."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def cliffs_delta(df: DataFrame, group: Column, value: str) -> DataFrame:
    """``n1, n2, u, delta``: Mann-Whitney U of the rows where ``group`` is true against those where it is false; delta = 2U/(n1 n2) - 1."""
    rows = df.select(group.alias("g"), F.col(value).alias("v")).where("g is not null and v is not null")
    by = average_rank(rows, "v", "r").groupBy().agg(F.count_if("g").alias("n1"), F.count_if(~F.col("g")).alias("n2"), F.sum(F.when(F.col("g"), F.col("r")).otherwise(0.0)).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return by.select("n1", "n2", u.alias("u"), F.when((F.col("n1") > 0) & (F.col("n2") > 0), 2 * u / (F.col("n1") * F.col("n2")) - 1).alias("delta"))


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, w_plus, w_minus, w, ties`` of the paired differences; zeros are dropped; ties: the sum of t^3 - t."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d is not null and d <> 0").withColumn("a", F.abs("d"))
    plus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0))
    one = average_rank(d, "a", "r").agg(F.count("*").alias("n"), plus.alias("w_plus"), (F.sum("r") - plus).alias("w_minus"))
    ties = d.groupBy("a").count().agg(F.coalesce(F.sum(F.col("count") * F.col("count") * F.col("count") - F.col("count")), F.lit(0)).alias("ties"))
    return one.crossJoin(ties).select("n", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), "ties")


def wilcoxon_p(n: int, w: float, ties: float) -> float:
    """Two-sided p-value of the normal approximation with tie correction."""
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if var <= 0 else math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))


def descriptives(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """``grp, n, mean, median, sd, q1, q3, iqr``: quantiles are exact and interpolated."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(group.alias("grp")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"))
    return out.select("grp", "n", "mean", F.col("q")[1].alias("median"), "sd", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def ols(df: DataFrame, y: Column, *x: Column) -> list[float]:
    """Coefficients (intercept first) from the normal equations; one aggregation gives all sums. Rows with nulls don't count."""
    terms = [F.lit(1.0), *x]
    k = len(terms)
    good = df.select(*[t.cast("double").alias(f"x{i}") for i, t in enumerate(terms)], y.cast("double").alias("y")).dropna()
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)] + [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(k)]
    got = list(good.agg(*sums).first())  # one row of sums
    if got[0] is None:
        return [float("nan")] * k
    a, n = [[0.0] * (k + 1) for _ in range(k)], 0
    for i in range(k):
        for j in range(i, k):
            a[i][j] = a[j][i] = got[n]
            n += 1
    for i in range(k):
        a[i][k] = got[n + i]
    for i in range(k):  # elimination with pivots
        p = max(range(i, k), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        if a[i][i] == 0:
            return [float("nan")] * k
        for r in range(k):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [u - f * v for u, v in zip(a[r], a[i])]
    return [a[i][k] / a[i][i] for i in range(k)]


def ols_excess(df: DataFrame, fit_on: Column, y: Column, x: Column, name: str = "excess") -> DataFrame:
    """``df`` with y minus its prediction from x, the line fitted on the rows where ``fit_on`` holds."""
    line = df.where(fit_on).agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"))
    return df.crossJoin(F.broadcast(line)).withColumn(name, y - (F.col("__a") + F.col("__b") * x)).drop("__a", "__b")


def benjamini_hochberg(df: DataFrame, p: str, order: list[Column]) -> DataFrame:
    """``df`` with ``q``: p n / rank, the running minimum from the largest p down, at most 1.

    Ranks come from range-dealt tasks; the minimum is one over tasks and one within each.
    """
    n = df.count()
    ranked = prefix_sums(df, [F.col(p).asc(), *order], F.lit(1).cast("long"), "__b").withColumn("__raw", F.col(p) * n / (F.col("__b") + 1))
    step = max(1, n // 256)
    ranked = ranked.withColumn("__block", F.expr(f"__b div {step}"))
    after = Window.orderBy("__block").rowsBetween(1, Window.unboundedFollowing)  # 256 blocks or so
    blocks = ranked.groupBy("__block").agg(F.min("__raw").alias("__m")).withColumn("__later", F.min("__m").over(after)).select("__block", "__later")
    here = Window.partitionBy("__block").orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.join(F.broadcast(blocks), "__block").withColumn("q", F.least(F.lit(1.0), F.min("__raw").over(here), F.coalesce("__later", F.lit(float("inf")))))
    return out.select(*df.columns, "q")


def null_summary(nulls: DataFrame, value: str, observed: Column, obs: DataFrame) -> DataFrame:
    """``n, mean, sd, max, p95, z, empirical_p`` of an ensemble against the one-row table ``obs``: p = (1 + #{null >= observed}) / (n + 1)."""
    v = F.col(value)
    rows = nulls.where(v.isNotNull()).crossJoin(F.broadcast(obs.select(observed.alias("__o"))))
    a = rows.groupBy("__o").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.max(v).alias("max"), F.percentile(v, 0.95).alias("p95"), F.count_if(v >= F.col("__o")).alias("ge"))
    return a.select("n", "mean", "sd", "max", "p95", F.when(F.col("sd") > 0, (F.col("__o") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"), ((F.col("ge") + 1) / (F.col("n") + 1)).alias("empirical_p"))


def audit(recomputed: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``figure, stored, recomputed, agrees`` for each column of the one-row table ``stored`` against the same one of ``recomputed``.

    Figures agree within ``tolerance``, or if both are null; a figure that only one side has doesn't.
    """
    cells = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias(name)) for c in df.columns])).alias("x")).select("x.*")
    both = cells(stored, "stored").join(cells(recomputed, "recomputed"), "figure", "full_outer")
    near = F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= tolerance, F.col("stored").isNull() & F.col("recomputed").isNull())
    return both.select("figure", "stored", "recomputed", near.alias("agrees"))


def null_zscore(nulls: DataFrame, value: str, observed: Column, obs: DataFrame) -> DataFrame:
    """``z, p``: z is 0 without spread; p = 2 min(P(>=), P(<=)), at least 1/(n + 1); with ties it can exceed 1."""
    v = F.col(value)
    rows = nulls.where(v.isNotNull()).crossJoin(F.broadcast(obs.select(observed.alias("__o"))))
    a = rows.groupBy("__o").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.avg((v >= F.col("__o")).cast("int")).alias("ge"), F.avg((v <= F.col("__o")).cast("int")).alias("le"))
    return a.select(F.when(F.col("sd") > 0, (F.col("__o") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"), F.greatest(2 * F.least("ge", "le"), 1 / (F.col("n") + 1)).alias("p"))


def _two_sided(observed: DataFrame, shuffled: DataFrame, n_perm: int) -> DataFrame:
    out = shuffled.crossJoin(F.broadcast(observed)).groupBy("observed").agg(F.count_if(F.abs("s") >= F.abs("observed")).alias("n_ge"))
    return out.select("observed", "n_ge", ((F.col("n_ge") + 1) / (n_perm + 1)).alias("p"))


def permutation_median_test(df: DataFrame, group: Column, value: str, n_perm: int, seed: int) -> DataFrame:
    """``observed, n_ge, p``: difference of medians against shuffled groups of the same sizes; p = (c + 1) / (n_perm + 1), two-sided.

    A shuffle draws the places of the medians only (``resampling``): no row for each replicate and input row.
    """
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null")
    return _two_sided(*group_medians(rows, n_perm, seed), n_perm)


def sign_flip_test(df: DataFrame, diff: str, n_perm: int = 10_000, seed: int = 123) -> DataFrame:
    """``observed, n_ge, p``: the median of paired differences against random signs; two-sided, (c + 1) / (n_perm + 1).

    As in ``permutation_median_test``, the places of the medians are drawn, not the signs of all rows.
    """
    rows = df.select(F.col(diff).cast("double").alias("v")).where("v is not null")
    return _two_sided(*signed_medians(rows, n_perm, seed), n_perm)


def ols_permutation(df: DataFrame, y: Column, flag: Column, x: Column, n_perm: int = 5_000, seed: int = 0, block: int = 1_000_000) -> DataFrame:
    """``observed, n_ge, p``: one-sided test of the flag's coefficient in y ~ 1 + flag + x when y is shuffled.

    The design stays, so a shuffle needs only a weighted sum of y, added up by tasks for a block of y, a block of the
    design and some replicates: which share of one block meets the other is drawn by hypergeometric counts, which rows
    by a shuffle of either.  No row is made for a replicate and an input row, and a task holds two blocks.
    """
    rows = df.select(y.cast("double").alias("y"), flag.cast("double").alias("f"), x.cast("double").alias("x")).dropna()
    rows = materialize(global_rank(rows, [F.col(c).asc() for c in ("f", "x", "y")], "i"), "ols")
    n, sf, sx, sff, sxx, sfx = rows.agg(F.count("*"), F.sum("f"), F.sum("x"), F.sum(F.col("f") ** 2), F.sum(F.col("x") ** 2), F.sum(F.col("f") * F.col("x"))).first()
    det = n * (sff * sxx - sfx**2) - sf * (sf * sxx - sfx * sx) + sx * (sf * sfx - sff * sx)
    c0, c1, c2 = -(sf * sxx - sx * sfx) / det, (n * sxx - sx**2) / det, -(n * sfx - sf * sx) / det  # the flag's row of the inverse
    weight = c0 + c1 * F.col("f") + c2 * F.col("x")
    sizes = np.diff([*range(0, n, block), n])
    parts = max(1, 64 // len(sizes) ** 2)  # of the replicates

    def meet(ours: pd.DataFrame, design: pd.DataFrame) -> pd.DataFrame:
        a, b, part = (int(ours[c].iloc[0]) for c in ("a", "b", "part"))
        v, w = (frame.sort_values("at")[c].to_numpy() for frame, c in ((ours, "v"), (design, "v")))
        reps, sums = np.arange(part, n_perm, parts), []
        for rep in reps.tolist():
            counts, left, rng = np.zeros((len(sizes), len(sizes)), np.int64), sizes.copy(), np.random.default_rng([seed, rep])
            for k in range(a + 1):  # how many of block k meet each block of the design
                counts[k] = rng.multivariate_hypergeometric(left, sizes[k], method="marginals")
                left -= counts[k]
            mine = np.random.default_rng([seed, rep, 1, a]).permutation(v)[counts[a, :b].sum() :][: counts[a, b]]
            theirs = np.random.default_rng([seed, rep, 2, b]).permutation(w) if len(sizes) > 1 else w
            sums.append(mine @ theirs[counts[:a, b].sum() :][: counts[a, b]])
        return pd.DataFrame({"rep": reps, "s": sums})

    place, every = F.expr(f"(i - 1) div {block}"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(sizes) - 1).cast("long")))
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    # names of their own on each side: where both share a column, Spark may take one side's for unused
    ours = rows.select(F.col("i").alias("at"), F.col("y").alias("v"), place.alias("a"), every.alias("b")).select("*", each).groupBy("a", "b", "part")
    design = rows.select(F.col("i").alias("at"), weight.alias("v"), place.alias("b"), every.alias("a")).select("*", each).groupBy("a", "b", "part")
    stats = ours.cogroup(design).applyInPandas(meet, "rep long, s double").groupBy("rep").agg(F.sum("s").alias("s"))
    observed = rows.agg(F.sum(weight * F.col("y")).alias("observed"))
    out = stats.crossJoin(F.broadcast(observed)).groupBy("observed").agg(F.count_if(F.col("s") >= F.col("observed")).alias("n_ge"))
    return out.select("observed", "n_ge", ((F.col("n_ge") + 1) / (n_perm + 1)).alias("p"))


def jaccard(sets: DataFrame) -> DataFrame:
    """``n_sets, n_common, n_union, jaccard`` of the sets in (id, tag): ids in all of them over ids in any."""
    n = sets.select("tag").distinct().count()
    by = sets.groupBy("id").agg(F.count_distinct("tag").alias("t"))
    one = by.agg(F.count_if(F.col("t") == n).alias("n_common"), F.count("*").alias("n_union"))
    return one.select(F.lit(n).cast("long").alias("n_sets"), "n_common", "n_union", F.when(F.col("n_union") > 0, F.col("n_common") / F.col("n_union")).alias("jaccard"))


def top_k(df: DataFrame, k: int, col: str, tie: str, largest: bool = True) -> DataFrame:
    return df.orderBy(F.col(col).desc() if largest else F.col(col).asc(), tie).limit(k)


def unpaired(df: DataFrame, group: Column, value: str) -> DataFrame:
    """``median_case, median_control, median_diff, cliffs_delta, n_case, n_control``: rows where ``group`` is true against those where it is false."""
    rows = df.select(group.alias("g"), F.col(value).alias("v")).where("g is not null and v is not null")
    m = rows.agg(F.median(F.when(F.col("g"), F.col("v"))).alias("a"), F.median(F.when(~F.col("g"), F.col("v"))).alias("b"))
    d = cliffs_delta(rows, F.col("g"), "v")
    return m.crossJoin(d).select(F.col("a").alias("median_case"), F.col("b").alias("median_control"), (F.col("a") - F.col("b")).alias("median_diff"), F.col("delta").alias("cliffs_delta"), F.col("n1").alias("n_case"), F.col("n2").alias("n_control"))


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """``field, n, n_annotated, pct``: how many rows have a value, for each column."""
    n = F.count("*")
    one = df.agg(n.alias("n"), *[F.count(c).alias(f"c{k}") for k, c in enumerate(columns)])
    each = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c{k}").alias("n_annotated")) for k, c in enumerate(columns)])).alias("x"))
    return each.select("x.field", "n", "x.n_annotated", F.when(F.col("n") > 0, 100.0 * F.col("x.n_annotated") / F.col("n")).alias("pct"))
