"""Helpers shared by the training-data operators: shared storage, sizes, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir

__all__ = ["connected_components", "materialize", "planned_bytes", "shared_dir", "task_count", "unsigned_crc"]

#: Bytes of input that one task should hold.
TASK_BYTES = 8 << 20
#: Estimates from here on mean that Catalyst knows nothing.
UNKNOWN_BYTES = 1 << 55


def planned_bytes(df: DataFrame) -> int:
    """The size of what ``df`` reads, by its scans (file sizes, no job); where they have none, the measured size of texts.

    What Catalyst estimates for joins isn't asked: that is a product of sizes.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size < UNKNOWN_BYTES:
        return size
    texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return int(df.agg(F.coalesce(F.sum(sum(texts, F.lit(64))), F.lit(0))).first()[0])


def task_count(df: DataFrame, per_task: int = TASK_BYTES) -> int:
    """How many tasks share the rows of ``df``: grows with the input, a few at least."""
    return max(8, min(1_000_000, planned_bytes(df) // per_task))


def unsigned_crc(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: columns ``node, root``, root the smallest node of each component.

    Contraction: every node points at its smallest neighbour (an associative minimum, so that a hub is
    pre-aggregated by each task), pointers are doubled until they reach roots, edges are rewritten to
    roots, and the smaller graph is taken again.  Isolated nodes don't appear; an empty graph gives no rows.
    """
    todo = materialize(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "cc-edges"
    )
    rounds: list[DataFrame] = []
    while not todo.isEmpty():
        both = todo.unionByName(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("p")), "cc-up")
        while True:
            next_ = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.node")).select("x.node", F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved"))
            next_ = materialize(next_, "cc-jump")
            up = next_.select("node", "p")
            if next_.where("moved").isEmpty():
                break
        rounds.append(up)
        todo = materialize(
            todo.join(up.select(F.col("node").alias("a"), F.col("p").alias("ra")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("p").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "cc-edges",
        )
    if not rounds:
        return todo.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[0].select("node", F.col("p").alias("root"))
    for up in rounds[1:]:
        labels = labels.join(up.select(F.col("node").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return labels
