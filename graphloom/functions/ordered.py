"""Ranks and running sums over a whole table without a single-task window.

Rows are dealt by range, numbered within their task and moved by the totals of the tasks before: a window over
a few rows per task is the only one without partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def prefix_sums(df: DataFrame, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come before in ``order`` (ties: in no particular order)."""
    cols = df.columns
    dealt = df.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("__task", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    by_task = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    totals = dealt.groupBy("__task").agg(F.sum("__v").alias("__total")).withColumn("__base", F.coalesce(F.sum("__total").over(by_task), F.lit(0)))
    within = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__own", F.coalesce(F.sum("__v").over(within), F.lit(0))).join(F.broadcast(totals.select("__task", "__base")), "__task")
    return out.select(*cols, (F.col("__base") + F.col("__own")).alias(name))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with row numbers from 1 in ``order``, which should be total."""
    out = prefix_sums(df, order, F.lit(1).cast("long"), "__n")
    return out.select(*df.columns, (F.col("__n") + 1).alias(name))


def average_rank(df: DataFrame, col: str, name: str = "rank", ascending: bool = True) -> DataFrame:
    """``df`` with the rank of ``col`` from 1, ties at their average; nulls get none."""
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("__x")).agg(F.count("*").alias("__c"))
    order = F.col("__x").asc() if ascending else F.col("__x").desc()
    ranked = prefix_sums(values, [order], F.col("__c"), "__b").select("__x", (F.col("__b") + (F.col("__c") + 1) / 2).alias(name))
    return df.join(ranked, F.col(col) == F.col("__x"), "left").drop("__x")


def draw(key: Column, *salt: Column | int | str) -> Column:
    """A uniform number in [0, 1) from a hash of key and salts: independent of partitions and order."""
    salts = [s if isinstance(s, Column) else F.lit(s) for s in salt]
    return F.pmod(F.xxhash64(key, *salts), F.lit(1 << 52)) / float(1 << 52)


def portable_hash(key: Column, salt: str) -> Column:
    """The first 32 bits of an MD5, which SQL engines have in common."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary")), 1, 8), 16, 10).cast("long")


def portable_draw(key: Column, salt: str, n: int) -> Column:
    """A whole number below ``n`` from ``portable_hash``."""
    return portable_hash(key, salt) % n
