"""Graph tables derived from the star schema: consecutive parts of an order make an edge.

Lines of an order in a fixed order: each part points at the next one.  A line's quantity is the edge's weight, its
return flag and status the region, the order's priority the edge label.  Parts are the nodes; the part type stands
for one of six transmitter labels, the brand for a super class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import sign_of
from ..operators import graph

# The label that each part type stands for.
LABEL_OF_TYPE = {"ECONOMY": "ACH", "LARGE": "DA", "MEDIUM": "GABA", "PROMO": "GLUT", "SMALL": "OCT", "STANDARD": "SER"}
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pre, post, neuropil, syn_count, nt_type``: a multigraph without self-loops."""
    next_ = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("pre"), next_.alias("post"), F.concat("l_returnflag", "l_linestatus").alias("neuropil"), F.col("l_quantity").cast("long").alias("syn_count"))
    lines = lines.where(F.col("post").isNotNull() & (F.col("pre") != F.col("post")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("nt_type"))
    return lines.join(orders, "l_orderkey").select("pre", "post", "neuropil", "syn_count", "nt_type")


def pairs(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """``pre, post, syn_count_total, nt_type_edge, n_neuropils``, or the first three (``links``)."""
    return graph.collapse(raw_edges(spark, sf_dir)) if labelled else links(spark, sf_dir)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pre, post, syn_count_total`` of the pairs: one aggregation, where labels and regions ask for two."""
    return raw_edges(spark, sf_dir).groupBy("pre", "post").agg(F.sum("syn_count").cast("long").alias("syn_count_total"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, name, nt_type, nt_sign, super_class, size``: one row for each part."""
    label = F.create_map(*[F.lit(x) for kv in LABEL_OF_TYPE.items() for x in kv])[F.col("p_type")]
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), label.alias("nt_type"), sign_of(label).alias("nt_sign"), F.col("p_brand").alias("super_class"), F.col("p_size").alias("size"))
