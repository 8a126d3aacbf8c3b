"""Generated graphs (pre, post) of known shape, distributed from the start: no edge list on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import draw


def edge_list(spark: SparkSession, edges: list[tuple[int, int]]) -> DataFrame:
    """A few given edges."""
    return spark.createDataFrame(edges, "pre long, post long")


def ring(spark: SparkSession, n: int) -> DataFrame:
    """Each of ``n`` nodes points at the next, the last at the first; no edges below two nodes."""
    return spark.range(n if n > 1 else 0).select(F.col("id").alias("pre"), ((F.col("id") + 1) % max(n, 1)).alias("post"))


def hub(spark: SparkSession, n: int) -> DataFrame:
    """Node 0 and each of the other ``n - 1`` point at one another."""
    k = spark.range(1, max(n, 1))
    return k.select(F.lit(0).cast("long").alias("pre"), F.col("id").alias("post")).unionByName(k.select(F.col("id").alias("pre"), F.lit(0).cast("long").alias("post")))


def barbell(spark: SparkSession, clique: int, path: int) -> DataFrame:
    """Two complete graphs of ``clique`` nodes, joined both ways by a path of ``path`` nodes: 2 clique + path nodes in all."""
    one = spark.range(clique * clique).select(F.expr(f"id div {max(clique, 1)}").alias("pre"), (F.col("id") % max(clique, 1)).alias("post")).where("pre <> post")
    two = one.select(*[(F.col(c) + clique + path).alias(c) for c in ("pre", "post")])
    chain = spark.range(max(clique - 1, 0), clique + path).select(F.col("id").alias("pre"), (F.col("id") + 1).alias("post")) if clique else one.limit(0)
    return one.unionByName(two).unionByName(chain).unionByName(chain.select(F.col("post").alias("pre"), F.col("pre").alias("post")))


def bernoulli(spark: SparkSession, n: int, p: float, seed: int = 0) -> DataFrame:
    """Each ordered pair of different nodes is an edge with probability ``p``.

    A node's out-degree is not drawn pair by pair: gaps between its successive edges are geometric, so the work is that
    of the edges.
    """
    if not 0 < p < 1:
        every = spark.range(n * n if p >= 1 else 0).select(F.expr(f"id div {max(n, 1)}").alias("pre"), (F.col("id") % max(n, 1)).alias("post"))
        return every.where("pre <> post")
    import math

    from pyspark.sql import Column

    def gap(pre: Column, k: Column) -> Column:
        u = draw(pre, k, F.lit(seed))
        return (F.floor(F.log(1 - u) / math.log1p(-p)) + 1).cast("long")

    most = int(n * p + 12 * math.sqrt(n * p * (1 - p)) + 40)  # enough gaps to pass n, but for one node in 10^30
    steps = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: gap(F.col("id"), k))
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    walk = F.aggregate(steps, start, lambda acc, g: F.struct((acc["at"] + g).alias("at"), F.when(acc["at"] + g < n, F.concat(acc["out"], F.array(acc["at"] + g))).otherwise(acc["out"]).alias("out")))
    return spark.range(n).select(F.col("id").alias("pre"), F.explode(walk["out"]).alias("post")).where("pre <> post")
