"""The pair graph of each month, built anew where its orders changed.

Consecutive lines of an order make an edge, and the edges of a month's orders collapse to weighted pairs with majority
labels.  A mark holds for each month the number of its orders and lines and a sum of their hashes.  A run compares the
mark with the tables, builds the months that are new or differ, overwrites only their partitions, and then writes their
marks.  A run that breaks off in between leaves months unmarked, which the next one builds to the same result.

    python -m jobs.monthly_graph --orders PATH --lines PATH --output PATH --mark PATH [--config FILE]
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans.derive import LINE_ORDER

from .common import log, main

PAIRS = "pre long, post long, syn_count_total long, nt_type_edge string, n_neuropils long, month string"
MARK = "n_orders long, n_lines long, hash decimal(38,0), min_synapses long, month string"


def _orders(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("nt_type"))


def fingerprints(orders: DataFrame, lines: DataFrame, min_synapses: int) -> DataFrame:
    """The mark that each month of the tables should have; orders without a date belong to no month."""
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum(F.xxhash64(*LINE_ORDER).cast("decimal(20,0)")).alias("hash"))
    o = _orders(orders).where("month is not null").join(per_order, "l_orderkey", "left")
    both = F.coalesce("hash", F.lit(0)) + F.xxhash64("l_orderkey", "nt_type").cast("decimal(20,0)")
    return o.groupBy("month").agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.sum(both).cast("decimal(38,0)").alias("hash"), F.lit(min_synapses).cast("long").alias("min_synapses"))


def monthly_pairs(orders: DataFrame, lines: DataFrame, min_synapses: int) -> DataFrame:
    """``month, pre, post, syn_count_total, nt_type_edge, n_neuropils`` of pairs with at least so many synapses."""
    own = lines.join(_orders(orders).where("month is not null"), "l_orderkey")
    next_ = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    edges = own.select("month", F.col("l_partkey").alias("pre"), next_.alias("post"), F.concat("l_returnflag", "l_linestatus").alias("neuropil"), F.col("l_quantity").cast("long").alias("syn_count"), "nt_type")
    pairs = graph.collapse(edges.where(F.col("post").isNotNull() & (F.col("pre") != F.col("post"))), ("month",))
    return pairs.where(F.col("syn_count_total") >= min_synapses)


def run(spark: SparkSession, orders: str, lines: str, output: str, mark: str, config: dict[str, Any]) -> DataFrame:
    """Builds the months that changed and returns the pairs of all months."""
    least = config["min_synapses"]
    o = spark.read.parquet(orders).select("o_orderkey", "o_orderdate", "o_orderpriority")
    all_lines = spark.read.parquet(lines).select("l_orderkey", *LINE_ORDER)
    # an empty folder has no files to tell the columns from
    spark.createDataFrame([], MARK).write.mode("append").partitionBy("month").parquet(mark)
    spark.createDataFrame([], PAIRS).write.mode("append").partitionBy("month").parquet(output)
    now = fingerprints(o, all_lines, least)
    known = spark.read.schema(MARK).parquet(mark)
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("n_orders", "n_lines", "hash", "min_synapses")]
    new = now.alias("n").join(known.alias("k"), F.col("n.month") == F.col("k.month"), "left").where(~(same[0] & same[1] & same[2] & same[3])).select("n.*")
    todo = new.collect()  # a row for each month
    log.info("monthly_graph: %d months differ from the mark in %s, with %d orders and %d lines", len(todo), mark, sum(r.n_orders for r in todo), sum(r.n_lines for r in todo))
    if todo:
        months = [r.month for r in todo]
        some = o.where(F.date_format("o_orderdate", "yyyy-MM").isin(months))
        counted = Observation()
        pairs = monthly_pairs(some, all_lines, least).observe(counted, F.count("*").alias("n"))
        dealt = pairs.repartition("month", F.pmod(F.hash("pre"), F.lit(config["partitions_per_month"])))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(output)
        marks = spark.createDataFrame(todo, "month string, n_orders long, n_lines long, hash decimal(38,0), min_synapses long")
        marks.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(mark)
        log.info("monthly_graph wrote %d pairs of %d months to %s", counted.get["n"], len(months), output)
    return spark.read.schema(PAIRS).parquet(output)


if __name__ == "__main__":
    main("monthly_graph", __doc__.split("\n")[0], ("orders", "lines", "output", "mark"), run)
