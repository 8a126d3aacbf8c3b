"""Labelled directed graphs as edge tables (src, dst[, weight]) and node tables (node, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import portable_draw
from ..storage import materialize


def collapse(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Multi-edges (pre, post, neuropil, syn_count, nt_type) to pairs: summed weight, majority label, distinct regions.

    With ``by`` there is a graph for each value of these columns.  The majority label has the largest summed weight, ties go to the first in alphabetical order; null labels don't
    stand for election.  Two aggregations on nested keys: (pre, post, label), then (pre, post).
    """
    by_label = edges.groupBy(*by, "pre", "post", "nt_type").agg(F.sum("syn_count").alias("w"), F.collect_set("neuropil").alias("regions"))
    best = F.min(F.when(F.col("nt_type").isNotNull(), F.struct((-F.col("w")).alias("w"), F.col("nt_type").alias("label"))))["label"]
    return by_label.groupBy(*by, "pre", "post").agg(
        F.sum("w").cast("long").alias("syn_count_total"), best.alias("nt_type_edge"), F.size(F.array_distinct(F.flatten(F.collect_list("regions")))).cast("long").alias("n_neuropils")
    )


#: Ends in a row of ``adjacency``.
ENDS = 1_000


def adjacency(pairs: DataFrame) -> DataFrame:
    """``node, to``: the ends of all pairs by their start, in arrays of up to ENDS, so that a join moves and sorts a row for each node."""
    at = F.row_number().over(Window.partitionBy("pre").orderBy("post"))
    some = pairs.select("pre", "post").withColumn("some", F.floor((at - 1) / ENDS))
    return some.groupBy("pre", "some").agg(F.collect_list("post").alias("to")).select(F.col("pre").alias("node"), "to")


def node_index(pairs: DataFrame) -> DataFrame:
    """``node`` with ``first_pre`` and ``post_only``: the order of first appearance is (post_only, first_pre, node)."""
    ends = pairs.select(F.explode(F.expr("array(struct(pre as node, 0 as post_only, null as first_pre), struct(post as node, 1 as post_only, pre as first_pre))")).alias("e")).select("e.*")
    # numbers, not structs: sums in hash tables, where structs are sorted; a node that is a source comes first as its own
    best = ends.groupBy("node").agg(F.min("post_only").alias("post_only"), F.min("first_pre").alias("first_pre"))
    return best.select("node", "post_only", F.when(F.col("post_only") == 0, F.col("node")).otherwise(F.col("first_pre")).alias("first_pre"))


def degrees(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """``node, in_degree, out_degree, total_degree`` (and in_strength, out_strength) of all nodes with an edge: one shuffle."""
    w = F.col(weight) if weight else F.lit(0)
    ends = pairs.select(F.col("pre").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("wi"), w.alias("wo"))
    ends = ends.unionByName(pairs.select(F.col("post").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), w.alias("wi"), F.lit(0).alias("wo")))
    aggs = [F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total_degree")]
    if weight:
        aggs += [F.sum("wi").alias("in_strength"), F.sum("wo").alias("out_strength")]
    return ends.groupBy("node").agg(*aggs)


def degrees_by_outer_join(pairs: DataFrame) -> DataFrame:
    """The same degrees as a full outer join of both ends' counts, missing ones filled with 0."""
    out = pairs.groupBy(F.col("pre").alias("node")).agg(F.count("*").alias("out_degree"))
    in_ = pairs.groupBy(F.col("post").alias("node")).agg(F.count("*").alias("in_degree"))
    both = out.join(in_, "node", "full_outer").na.fill(0, ["out_degree", "in_degree"])
    return both.select("node", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"))


def with_universe(nodes: DataFrame, table: DataFrame, fill: list[str]) -> DataFrame:
    """``table`` on all ``nodes``: isolated nodes get 0 in the columns ``fill``."""
    return nodes.select("node").join(table, "node", "left").na.fill(0, fill)


def density(pairs: DataFrame, n: DataFrame) -> DataFrame:
    """``n_nodes, n_edges, density, mean_degree`` from pairs and a one-row table with ``n_nodes``."""
    m = pairs.agg(F.count("*").alias("n_edges"))
    nn = F.col("n_nodes")
    return n.crossJoin(m).select("n_nodes", "n_edges", F.when(nn > 1, F.col("n_edges") / (nn * (nn - 1))).otherwise(0.0).alias("density"), (F.col("n_edges") / nn).alias("mean_degree"))


def reciprocity(pairs: DataFrame) -> DataFrame:
    """``n_mutual`` ordered pairs with their reverse; per edge, and halved as mutual pairs per edge.

    An edge and its reverse share the unordered key: one aggregation, no self-join.  A self-loop is its own reverse.
    """
    key = [F.least("pre", "post").alias("a"), F.greatest("pre", "post").alias("b")]
    seen = pairs.groupBy(*key).agg(F.count_distinct("pre").alias("ways"))
    mutual = F.when(F.col("a") == F.col("b"), 1).when(F.col("ways") == 2, 2).otherwise(0)
    one = seen.agg(F.sum(mutual).alias("n_mutual"), F.sum("ways").alias("n_edges"))
    return one.select("n_mutual", (F.col("n_mutual") / F.col("n_edges")).alias("reciprocity_edges"), (F.col("n_mutual") / 2 / F.col("n_edges")).alias("reciprocity_pairs"))


def endpoint_coverage(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many pairs, self-loops, and which shares of pairs have their ends in ``nodes``."""
    known = nodes.select("node").distinct()
    pre, post = known.select(F.col("node").alias("pre"), F.lit(1).alias("has_pre")), known.select(F.col("node").alias("post"), F.lit(1).alias("has_post"))
    both = pairs.join(pre, "pre", "left").join(post, "post", "left")
    has_pre, has_post = F.col("has_pre").isNotNull().cast("int"), F.col("has_post").isNotNull().cast("int")
    return both.agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("pre") == F.col("post")).alias("n_self_loops"),
        F.avg(has_pre).alias("pre_coverage"), F.avg(has_post).alias("post_coverage"), F.avg(has_pre * has_post).alias("both_coverage"),
    )


def induced_subgraph(pairs: DataFrame, keep: DataFrame) -> DataFrame:
    """Pairs with both ends in ``keep`` (node)."""
    k = keep.select("node")
    return pairs.join(k.select(F.col("node").alias("pre")), "pre", "left_semi").join(k.select(F.col("node").alias("post")), "post", "left_semi").select(*pairs.columns)


def without_node(pairs: DataFrame, target: int) -> DataFrame:
    """Pairs that don't touch ``target``; the node set stays as it is."""
    return pairs.where((F.col("pre") != target) & (F.col("post") != target))


def k_ring(pairs: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``node, ring``: nodes within ``k`` undirected steps of the seeds (node), with the fewest steps."""
    both = pairs.select(F.col("pre").alias("a"), F.col("post").alias("b")).unionByName(pairs.select(F.col("post").alias("a"), F.col("pre").alias("b")))
    reached = seeds.select("node", F.lit(0).alias("ring")).distinct()
    front = reached
    for step in range(1, k + 1):
        front = front.join(both, front.node == both.a).select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("ring", F.lit(step))
        front = materialize(front, "k-ring")
        reached = reached.unionByName(front)
    return reached


def neighbourhood(pairs: DataFrame, seeds: DataFrame, k: int, extra: int, salt: str = "background") -> tuple[DataFrame, DataFrame]:
    """The nodes (node, ring) within ``k`` steps of the seeds and ``extra`` others (ring null), drawn by a portable hash; and the pairs among them."""
    ring = materialize(k_ring(pairs, seeds, k), "ring")
    every = pairs.select(F.explode(F.array("pre", "post")).alias("node")).distinct()
    others = every.join(ring, "node", "left_anti").orderBy(portable_draw(F.col("node"), salt, 1 << 32), "node").limit(extra)
    kept = materialize(ring.unionByName(others.withColumn("ring", F.lit(None).cast("int"))), "neighbourhood")
    return kept, induced_subgraph(pairs, kept)


def neighbourhood_composition(pairs: DataFrame, targets: DataFrame, labels: DataFrame, named: list[str]) -> DataFrame:
    """Shares of labels among the distinct in- and out-neighbours of each target (node), summed over targets.

    ``labels`` is (node, label).  Labels besides ``named`` are "other", missing ones "unknown".
    """
    out = targets.join(pairs, targets.node == pairs.pre).select(F.col("node").alias("t"), F.col("post").alias("u"))
    in_ = targets.join(pairs, targets.node == pairs.post).select(F.col("node").alias("t"), F.col("pre").alias("u"))
    near = out.unionByName(in_).distinct().join(labels.select(F.col("node").alias("u"), "label"), "u", "left")
    kind = F.when(F.col("label").isNull(), "unknown").when(F.col("label").isin(named), F.col("label")).otherwise("other")
    return near.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def region_profile(edges: DataFrame, k: int = 3) -> DataFrame:
    """``node, regions``: the ``k`` regions with most synapses out of a node, as "REGION:count; ..."."""
    by = edges.where(F.col("neuropil").isNotNull()).groupBy(F.col("pre").alias("node"), "neuropil").agg(F.sum("syn_count").alias("n"))
    order = Window.partitionBy("node").orderBy(F.desc("n"), "neuropil")
    top = by.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    text = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", "neuropil", "n").alias("s")))), lambda x: x["s"])
    return top.groupBy("node").agg(F.array_join(text, "; ").alias("regions"))


def weak_components(pairs: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that edges of either direction reach.

    Contraction: each node points at its smallest neighbour, pointers are doubled to their roots, edges are rewritten
    to roots; the graph shrinks in each round and minima are pre-aggregated, so that hubs don't meet in one task.
    """
    todo = materialize(pairs.select(F.least("pre", "post").alias("a"), F.greatest("pre", "post").alias("b")).where("a <> b").distinct(), "wcc-edges")
    rounds: list[DataFrame] = []
    while not todo.isEmpty():
        both = todo.unionByName(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")), "wcc-up")
        moved = True
        while moved:
            step = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.node")).select("x.node", F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved"))
            step = materialize(step, "wcc-jump")
            up, moved = step.select("node", "p"), not step.where("moved").isEmpty()
        rounds.append(up)
        ends = todo.join(up.select(F.col("node").alias("a"), F.col("p").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("p").alias("rb")), "b")
        todo = materialize(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "wcc-edges")
    labels = pairs.select(F.explode(F.array("pre", "post")).alias("node")).distinct().withColumn("component", F.col("node"))
    for up in rounds:
        labels = labels.join(up.select(F.col("node").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return labels


def pagerank(pairs: DataFrame, nodes: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """``node, pagerank``: uniform teleport, dangling mass spread evenly, until the L1 change is below ``tolerance``.

    A round joins ranks with the ends of their nodes and sums by target; the dangling mass is one aggregated number.
    """
    ends = materialize(adjacency(pairs), "pagerank-ends")  # pairs are made once
    out = ends.groupBy("node").agg(F.sum(F.size("to")).alias("d"))
    base = materialize(nodes.select("node").distinct().join(out, "node", "left"), "pagerank-nodes")
    n = base.count()
    ranks = base.withColumn("r", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations):
        dangling = ranks.where(F.col("d").isNull()).agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("lost"))
        given = ranks.where(F.col("d").isNotNull()).join(ends, "node").select(F.explode("to").alias("node"), (F.col("r") / F.col("d")).alias("part")).groupBy("node").agg(F.sum("part").alias("got"))
        new = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n) + (1 - alpha) / n
        step = materialize(ranks.join(given, "node", "left").crossJoin(F.broadcast(dangling)).select("node", "d", new.alias("r"), F.abs(new - F.col("r")).alias("moved")), "pagerank")
        ranks = step.select("node", "d", "r")
        if tolerance > 0 and (step.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            break
    return ranks.select("node", F.col("r").alias("pagerank"))


def label_summary(metrics: DataFrame, label: str, value: str) -> DataFrame:
    """``label, n, median, mean`` of a metric by label, the null label included."""
    v = F.col(value)
    return metrics.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.median(v).alias("median"), F.avg(v).alias("mean"))


def value_counts(df: DataFrame, col: Column) -> DataFrame:
    """``value, n, share``: counts with nulls kept."""
    counts = df.groupBy(col.alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("share"))
