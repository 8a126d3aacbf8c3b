"""Candidate selection, screening with checkpoints, reranking, annotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import draw, global_rank, portable_draw
from ..storage import materialize
from . import traverse
from .stats import spearman, top_k

CHUNK = 200


def candidates(metrics: DataFrame, share: float = 0.01, columns: tuple[str, ...] = ("total_degree", "strength", "pagerank")) -> DataFrame:
    """``node``: the union of the top ``share`` of nodes by each column, one at least; ties go to the smaller node."""
    k = max(1, int(share * metrics.count()))
    out = None
    for c in columns:
        best = top_k(metrics.select("node", c), k, c, "node").select("node")
        out = best if out is None else out.unionByName(best)
    return out.distinct()


def hot_by_label(metrics: DataFrame, label: str, quantile: float = 0.9) -> DataFrame:
    """``node``: nodes of a label whose degree is at least that label's quantile; none if nothing has the label."""
    mine = metrics.where(F.col("nt_type") == label)
    edge = mine.agg(F.percentile("total_degree", quantile).alias("edge"))
    return mine.crossJoin(F.broadcast(edge)).where(F.col("total_degree") >= F.col("edge")).select("node")


def background(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """``node``: ``k`` nodes without replacement, the least hashes of (seed, node)."""
    return nodes.select("node").orderBy(draw(F.col("node"), seed), "node").limit(k)


def background_portable(nodes: DataFrame, k: int, salt: str) -> DataFrame:
    """The same by a hash that other engines have too."""
    return nodes.select("node").orderBy(portable_draw(F.col("node"), salt, 1 << 32), "node").limit(k)


def target_manifest(union: DataFrame, hot: DataFrame, random: DataFrame) -> DataFrame:
    """``n_union, n_hot, n_hot_new, n_background, n_targets``."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    every = union.unionByName(hot).unionByName(random).distinct()
    return n(union, "n_union").crossJoin(n(hot, "n_hot")).crossJoin(n(hot.join(union, "node", "left_anti"), "n_hot_new")).crossJoin(n(random, "n_background")).crossJoin(n(every, "n_targets"))


def screen(pairs: DataFrame, targets: DataFrame, panel: DataFrame, n_nodes: int, path: str, chunk: int = CHUNK) -> DataFrame:
    """Panel impact of all targets (node), in chunks that are appended to Parquet at ``path``; chunks found there aren't computed again.

    The undamaged graph is part of each chunk's batch, so that no extra pass is needed.
    """
    spark = pairs.sparkSession
    schema = "target long, cis double, reach_drop double, S_baseline double, S_perturbed double"
    pairs = materialize(pairs.select("pre", "post"), "screen-edges")
    while True:
        try:
            done = spark.read.schema(schema).parquet(path)
            left = targets.join(done.select(F.col("target").alias("node")), "node", "left_anti")
        except Exception as e:  # nothing there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done, left = None, targets
        batch = materialize(left.select("node").orderBy("node").limit(chunk), "screen-chunk")
        if batch.isEmpty():
            return done if done is not None else spark.createDataFrame([], schema)
        traverse.panel_cis(pairs, batch, panel, n_nodes).write.mode("append").parquet(path)


def finalists(screened: DataFrame, top: int = 150, anchors: int = 50, salt: str = "anchor") -> DataFrame:
    """``node, is_anchor``: the ``top`` targets by cis (ties: smaller target), and ``anchors`` of the others, drawn by a portable hash."""
    best = top_k(screened.select(F.col("target").alias("node"), "cis"), top, "cis", "node").select("node")
    rest = screened.select(F.col("target").alias("node")).join(best, "node", "left_anti")
    return best.withColumn("is_anchor", F.lit(False)).unionByName(background_portable(rest, anchors, salt).withColumn("is_anchor", F.lit(True)))


def drawn_panel(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """``pos, node``: ``k`` sources without replacement, in drawn order."""
    few = background(nodes, k, seed)  # a panel
    return global_rank(few, [draw(F.col("node"), seed).asc(), F.col("node").asc()], "pos").select((F.col("pos") - 1).alias("pos"), "node")


def rerank_finalists(pairs: DataFrame, nodes: DataFrame, screened: DataFrame, seeds: tuple[int, ...] = (0, 1), k: int = 32, top: int = 150, anchors: int = 50) -> DataFrame:
    """``target, cis_mean, cis_std, reach_drop_mean`` of the finalists of a screen, from a panel of ``k`` sources for each seed."""
    chosen = materialize(finalists(screened, top, anchors).select("node"), "finalists")
    drawn = [drawn_panel(nodes, k, seed).select(F.lit(seed).alias("panel"), "node") for seed in seeds]
    panels = materialize(reduce(DataFrame.unionByName, drawn), "rerank-panels")
    return rerank(materialize(traverse.panels_cis(pairs, chosen, panels, seeds, nodes.count()), "rerank"))


def screen_summary(screened: DataFrame, reranked: DataFrame) -> DataFrame:
    """``n, cis_median, cis_p90, cis_p99, cis_max, n_reranked, spearman``: the screen's spread, and how well its ranks foretell the rerank's."""
    q = F.percentile("cis", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    one = screened.agg(F.count("*").alias("n"), q.alias("q"), F.max("cis").alias("cis_max"))
    both = spearman(screened.select("target", "cis").join(reranked.select("target", "cis_mean"), "target"), "cis", "cis_mean")
    return one.crossJoin(both.select(F.col("n").alias("n_reranked"), F.col("rho").alias("spearman"))).select("n", F.col("q")[0].alias("cis_median"), F.col("q")[1].alias("cis_p90"), F.col("q")[2].alias("cis_p99"), "cis_max", "n_reranked", "spearman")


def rerank(per_seed: DataFrame) -> DataFrame:
    """``target, cis_mean, cis_std, reach_drop_mean`` over seeds of (target, seed, cis, reach_drop)."""
    return per_seed.groupBy("target").agg(F.avg("cis").alias("cis_mean"), F.stddev_samp("cis").alias("cis_std"), F.avg("reach_drop").alias("reach_drop_mean"))


def annotate(screened: DataFrame, core: DataFrame, degrees: DataFrame, reranked: DataFrame, random: DataFrame) -> DataFrame:
    """Screened targets (target, cis) with metadata, degrees (0 if none), reranked scores, and the flags is_finalist and in_background."""
    out = screened.withColumnRenamed("target", "node").join(core, "node", "left").join(degrees, "node", "left").na.fill(0, ["in_degree", "out_degree", "total_degree"])
    out = out.join(reranked.withColumnRenamed("target", "node"), "node", "left").join(random.select("node", F.lit(True).alias("__b")), "node", "left")
    return out.withColumn("is_finalist", F.col("cis_mean").isNotNull()).withColumn("in_background", F.coalesce("__b", F.lit(False))).drop("__b")
