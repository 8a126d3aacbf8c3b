"""Enrichment of labels among selected nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import draw
from ..storage import materialize
from .matching import peers


def ratio(top: DataFrame, base: DataFrame) -> DataFrame:
    """``label, n_top, n_base, enrichment``: the label's share in ``top`` (label) over its share in ``base`` (label); nulls don't count."""
    share = lambda df, n: df.where("label is not null").groupBy("label").agg(F.count("*").alias(n))
    sizes = top.where("label is not null").agg(F.count("*").alias("st")).crossJoin(base.where("label is not null").agg(F.count("*").alias("sb")))
    both = share(top, "n_top").join(share(base, "n_base"), "label").crossJoin(F.broadcast(sizes))
    return both.select("label", "n_top", "n_base", ((F.col("n_top") / F.col("st")) / (F.col("n_base") / F.col("sb"))).alias("enrichment"))


def expected_uniform(tested: DataFrame, top: DataFrame) -> DataFrame:
    """``label, observed, tested_count, expected, enrichment`` against as many uniform draws from ``tested`` (id, label): K times the label's rate."""
    k, n = top.agg(F.count("*").alias("k")), tested.agg(F.count("*").alias("n"))
    by = tested.groupBy("label").agg(F.count("*").alias("tested_count"))
    got = tested.join(top.select("id"), "id", "left_semi").groupBy("label").agg(F.count("*").alias("observed"))
    both = by.join(got, "label", "left").na.fill(0, ["observed"]).crossJoin(F.broadcast(k.crossJoin(n)))
    e = F.col("k") * F.col("tested_count") / F.col("n")
    return both.where("label is not null").select("label", "observed", "tested_count", e.alias("expected"), (F.col("observed") / F.greatest(e, F.lit(1e-12))).alias("enrichment"))


def expected_matched(tested: DataFrame, top: DataFrame, focus: str, exclude_self: bool = False) -> DataFrame:
    """``observed, expected, enrichment`` of label ``focus`` where each slot draws from its degree peers: the sum of the pools' rates.

    ``tested`` is (id, degree, label), ``top`` is (id).
    """
    pop = tested.select("id", "degree", (F.col("label") == focus).cast("double").alias("value")).na.fill(0.0, ["value"])
    rates = peers(pop, top, exclude_self).groupBy("id", "own").agg(F.avg("value").alias("rate"))
    one = rates.agg(F.sum("own").cast("long").alias("observed"), F.sum("rate").alias("expected"))
    return one.select("observed", "expected", (F.col("observed") / F.greatest("expected", F.lit(1e-12))).alias("enrichment"))


def _scored(counts: DataFrame, observed: int, n_rep: int) -> DataFrame:
    a = counts.agg(F.avg("hits").alias("expected"), F.stddev_samp("hits").alias("sd"), F.count_if(F.col("hits") >= observed).alias("ge"))
    return a.select(F.lit(observed).alias("observed"), "expected", ((F.lit(observed) - F.col("expected")) / F.greatest("sd", F.lit(1e-12))).alias("z"), ((F.col("ge") + 1) / (n_rep + 1)).alias("p"))


def monte_carlo_uniform(tested: DataFrame, k: int, focus: str, observed: int, n_rep: int = 10_000, seed: int = 2026) -> DataFrame:
    """``observed, expected, z, p`` from ``n_rep`` samples of ``k`` with replacement; a sample's hits need only the label's rate."""
    n, hits = tested.agg(F.count("*"), F.count_if(F.col("label") == focus)).first()
    draws = tested.sparkSession.range(n_rep * k).select(F.expr(f"id div {k}").alias("rep"), (F.floor(draw(F.col("id"), seed) * n) < hits).cast("int").alias("hit"))
    return _scored(draws.groupBy("rep").agg(F.sum("hit").alias("hits")), observed, n_rep)


def monte_carlo_matched(tested: DataFrame, top: DataFrame, focus: str, n_rep: int = 10_000, seed: int = 2026) -> DataFrame:
    """The same where each slot draws from its own degree peers: a slot's draw is a hit with its pool's rate."""
    pop = tested.select("id", "degree", (F.col("label") == focus).cast("double").alias("value")).na.fill(0.0, ["value"])
    pools = peers(pop, top, False).groupBy("id", "own").agg(F.sum("value").alias("hits"), F.count("*").alias("n"))
    observed = int(pools.agg(F.coalesce(F.sum("own"), F.lit(0.0))).first()[0])
    reps = tested.sparkSession.range(n_rep).select(F.col("id").alias("rep")).crossJoin(F.broadcast(pools))
    hit = (F.floor(draw(F.col("id"), F.col("rep"), seed) * F.col("n")) < F.col("hits")).cast("int")
    return _scored(reps.groupBy("rep").agg(F.sum(hit).alias("hits")), observed, n_rep)


def by_class(tested: DataFrame, top: DataFrame, n_rep: int = 10_000, seed: int = 77) -> DataFrame:
    """``label, observed, tested_count, expected, sd, enrichment, z, p`` of every label among ``top`` (id) of ``tested`` (id, label).

    The null draws as many rows from ``tested`` as ``top`` has, with replacement; one set of draws serves all labels: a
    draw is a rank among the tested, sorted by label, so only the labels' shares travel.  p = (1 + #{null >= observed}) / (n_rep + 1).
    """
    base = materialize(expected_uniform(tested, top).withColumn("sd", F.lit(None).cast("double")), "by-class")
    k, n = top.count(), tested.count()
    order = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # a row for each label
    shares = base.select("label", "tested_count", F.coalesce(F.sum("tested_count").over(order), F.lit(0)).alias("start"))
    draws = tested.sparkSession.range(n_rep * k).select(F.expr(f"id div {max(k, 1)}").alias("rep"), F.floor(draw(F.col("id"), seed) * n).alias("at"))
    counts = F.array(*[F.count_if(F.col("at").between(r.start, r.start + r.tested_count - 1)) for r in shares.collect()])  # labels
    labels = [r.label for r in shares.collect()]
    if not labels or not k:
        return base.select("label", "observed", "tested_count", "expected", "sd", "enrichment", F.lit(0.0).alias("z"), F.lit(1.0).alias("p"))
    hits = draws.groupBy("rep").agg(counts.alias("c")).select(F.posexplode("c").alias("j", "hits")).withColumn("label", F.array(*map(F.lit, labels))[F.col("j")])
    null = hits.join(F.broadcast(base.select("label", "observed")), "label").groupBy("label").agg(F.stddev_samp("hits").alias("sd"), F.avg("hits").alias("m"), F.count_if(F.col("hits") >= F.col("observed")).alias("ge"))
    z = (F.col("observed") - F.col("m")) / F.greatest("sd", F.lit(1e-12))
    return base.drop("sd").join(null, "label").select("label", "observed", "tested_count", "expected", "sd", "enrichment", z.alias("z"), ((F.col("ge") + 1) / (n_rep + 1)).alias("p"))


def sweep(scores: DataFrame, sizes: list[int], focus: str) -> DataFrame:
    """``k, observed, expected, enrichment`` of label ``focus`` among the top k by score, for each k; scores is (id, score, label)."""
    most = scores.orderBy(F.desc("score"), "id").limit(max(sizes)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # the top few
    rate = scores.agg(F.avg(F.coalesce((F.col("label") == focus).cast("int"), F.lit(0))).alias("rate"))
    ks = scores.sparkSession.createDataFrame([(k,) for k in sizes], "k int")
    got = ks.join(F.broadcast(most), F.col("r") <= F.col("k")).groupBy("k").agg(F.count_if(F.col("label") == focus).alias("observed"))
    e = F.col("k") * F.col("rate")
    return got.crossJoin(F.broadcast(rate)).select("k", "observed", e.alias("expected"), (F.col("observed") / F.greatest(e, F.lit(1e-12))).alias("enrichment"))
