"""Classification of ranked nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import average_rank

# Class and tag names, thresholds, and the super classes of the visual system.
STRONG, HUB, INTERMEDIATE, CANDIDATE, NONE = "A_strong_chokepoint", "B_degree_driven_hub", "B_intermediate", "C_gaba_candidate", "not_classified"
VISUAL_TAG, EXPLORATORY_TAG = "D_visual_system", "C_gaba_exploratory"
VISUAL_CLASSES = ("visual_centrifugal", "optic")
TOP, EXCESS, P_STRONG, P_HUB = 50, 0.3, 0.01, 0.05


def descending_rank(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """``df`` with the average rank of ``col`` from the largest down, cut to a whole number; nulls get none."""
    return average_rank(df, col, name, ascending=False).withColumn(name, F.floor(name).cast("int"))


def class_v1(rank: Column, excess: Column, label: Column, delta: Column) -> Column:
    """The first that holds: strong, candidate, hub (all for top ranks), candidate, none."""
    top, candidate = rank <= TOP, (label == "GABA") & (delta > 0)
    return F.when(top & (excess > EXCESS), STRONG).when(top & candidate, CANDIDATE).when(top, HUB).when(candidate, CANDIDATE).otherwise(NONE)


def class_v2(p: Column, super_class: Column, label: Column, delta: Column, visual: tuple[str, ...] = VISUAL_CLASSES) -> Column:
    """The base class by exceedance, then "|" and the tags that hold, joined by "+"."""
    base = F.when(p < P_STRONG, STRONG).when(p >= P_HUB, HUB).otherwise(INTERMEDIATE)
    tags = F.array_compact(F.array(F.when(super_class.isin(*visual), VISUAL_TAG), F.when((label == "GABA") & (delta > 0), EXPLORATORY_TAG)))
    return F.concat(base, F.when(F.size(tags) > 0, F.concat(F.lit("|"), F.array_join(tags, "+"))).otherwise(""))


def base_class(label: Column) -> Column:
    return F.split(label, r"\|")[0]


def summary_v2(cat: DataFrame, visual: tuple[str, ...] = VISUAL_CLASSES) -> DataFrame:
    """One row: medians and counts over (emp_p, peer_pool_n, super_class, excess_ratio)."""
    return cat.agg(
        F.count("*").alias("n"), F.median("emp_p").alias("median_emp_p"), F.count_if(F.col("emp_p") < P_STRONG).alias("n_emp_p_below_001"), F.count_if(F.col("emp_p") < P_HUB).alias("n_emp_p_below_005"),
        F.count_if(F.col("peer_pool_n") < 10).alias("n_tiny_pools"), F.avg(F.coalesce(F.col("super_class").isin(*visual), F.lit(False)).cast("int")).alias("visual_fraction"), F.median("excess_ratio").alias("median_excess_ratio"),
    )


def integrated(cat: DataFrame, regions_out: DataFrame, regions_in: DataFrame) -> DataFrame:
    """Catalogue rows (node, ...) with the top regions of their outputs and inputs (node, regions)."""
    out, in_ = regions_out.select("node", F.col("regions").alias("output_regions")), regions_in.select("node", F.col("regions").alias("input_regions"))
    return cat.join(out, "node", "left").join(in_, "node", "left")


def log_histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """``bin, n``: counts in ``bins`` equal bins from lo to hi, the last closed; values outside don't count; empty bins are 0."""
    v = df.select(value.alias("v")).where(F.col("v").between(lo, hi))
    at = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    counts = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0, ["n"])


def five_numbers(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """``grp, low, q1, median, q3, high``: quartiles, and the farthest values within 1.5 interquartile ranges of them."""
    v = df.select(group.alias("grp"), value.alias("v")).where("v is not null")
    q = v.groupBy("grp").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("grp", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = v.join(F.broadcast(q), v.grp.eqNullSafe(q.grp)).drop(v.grp).where(F.col("v").between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy("grp", "q1", "median", "q3").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("grp", "low", "q1", "median", "q3", "high")


def agreement_counts(df: DataFrame, claim: Column, found: Column, tolerance: float = 1e-9) -> DataFrame:
    """``n_verified, n_mismatch, n_missing`` of claimed figures against those found: missing where either is null."""
    off = F.abs(claim - found)
    return df.agg(F.count_if(off <= tolerance).alias("n_verified"), F.count_if(off > tolerance).alias("n_mismatch"), F.count_if(off.isNull()).alias("n_missing"))


def summary_tables(metrics: DataFrame, screened: DataFrame, matches: DataFrame, cat: DataFrame, nulls: DataFrame) -> dict[str, DataFrame]:
    """The five summary tables: the graph, the screen, the matched comparison, the catalogue, and the null ensemble.

    ``metrics`` is (node, total_degree, label), ``screened`` (target, cis), ``matches`` (id, other, diff), ``cat``
    (id, class_label), ``nulls`` (null_id, median_diff, cliffs_delta).
    """
    q = lambda c, x: F.percentile(c, x)
    return {
        "graph": metrics.groupBy("label").agg(F.count("*").alias("n"), F.avg("total_degree").alias("mean_degree"), F.median("total_degree").alias("median_degree"), F.max("total_degree").alias("max_degree")),
        "screen": screened.agg(F.count("*").alias("n"), F.median("cis").alias("median"), q("cis", 0.9).alias("p90"), q("cis", 0.99).alias("p99"), F.max("cis").alias("max")),
        "matched": matches.agg(F.count("*").alias("n_pairs"), F.median("diff").alias("median_diff"), F.avg((F.col("diff") > 0).cast("int")).alias("share_positive")),
        "catalogue": cat.groupBy("class_label").agg(F.count("*").alias("n")),
        "nulls": nulls.agg(F.count("*").alias("n"), F.avg("median_diff").alias("mean_diff"), F.stddev_samp("median_diff").alias("sd_diff"), F.avg("cliffs_delta").alias("mean_delta")),
    }


def scatter(df: DataFrame, x: Column, y: Column, label: Column, eps: float = 1e-7) -> DataFrame:
    """``label, x, y``: what a scatter plot shows, on logarithmic axes: log10(x + 1) and log10(y + eps); rows without either go."""
    points = df.select(label.alias("label"), F.log10(x + 1.0).alias("x"), F.log10(y + eps).alias("y"))
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
