"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import clean, full_id, list_cell, sign_of, vector_cell
from ..operators.jobs import left_join_one_to_one

# Table names and their columns.
NODE_TABLES = {
    "neurons": "root_id long, `group` string, nt_type string, nt_type_score double",
    "names": "root_id long, name string, `group` string",
    "classification": "root_id long, flow string, super_class string, `class` string, sub_class string, hemilineage string, side string, nerve string",
    "consolidated_cell_types": "root_id long, primary_type string, `additional_type(s)` string",
    "visual_neuron_types": "root_id long, type string, family string, subsystem string, category string, side string",
    "cell_stats": "root_id long, length_nm double, area_nm double, size_nm double",
    "connectivity_tags": "root_id long, connectivity_tag string",
}
EDGE_TABLES = ("princeton_thresholded", "princeton_no_threshold", "buhmann_no_threshold")
EDGES = "pre_root_id long, post_root_id long, neuropil string, syn_count long, nt_type string"


def csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A CSV file (gzip too) with a header, whose names must be those of the schema; empty cells are null."""
    return spark.read.options(header=True, enforceSchema=False, **options).schema(schema).csv(path)


def node_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in NODE_TABLES:
        raise KeyError(f"unknown table {name!r}; known: {sorted(NODE_TABLES)}")
    return csv(spark, f"{folder}/{name}.csv.gz", NODE_TABLES[name])


def edge_table(spark: SparkSession, folder: str, dataset: str = EDGE_TABLES[0]) -> DataFrame:
    """A connection table; text cells lose blanks and carriage returns."""
    if dataset not in EDGE_TABLES:
        raise KeyError(f"unknown dataset {dataset!r}; known: {EDGE_TABLES}")
    e = csv(spark, f"{folder}/connections_{dataset}.csv.gz", EDGES, lineSep="\n")
    return e.select(F.col("pre_root_id").alias("pre"), F.col("post_root_id").alias("post"), clean(F.col("neuropil")).alias("neuropil"), "syn_count", clean(F.col("nt_type")).alias("nt_type"))


def synapse_table(spark: SparkSession, path: str, columns: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """The master synapse table with whole ids; a gzip file is one split, so its rows are dealt out after reading."""
    schema = "pre_root_id_720575940 long, post_root_id_720575940 long, x double, y double, z double, size double, neuropil string"
    s = csv(spark, path, schema)
    s = s.select(full_id(F.col("pre_root_id_720575940")).alias("pre_root_id"), full_id(F.col("post_root_id_720575940")).alias("post_root_id"), "x", "y", "z", "size", "neuropil")
    s = s.select(*columns) if columns else s
    return s.repartition(tasks) if tasks else s


def processed_labels(spark: SparkSession, path: str) -> DataFrame:
    s = csv(spark, path, "root_id long, processed_labels string")
    return s.select("root_id", list_cell(F.col("processed_labels")).alias("processed_labels"))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``root_id, supervoxel_id, x, y, z``: several rows for an id."""
    s = csv(spark, path, "root_id long, position string, supervoxel_id long").withColumn("v", vector_cell(F.col("position")))
    return s.select("root_id", "supervoxel_id", *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate("xyz")])


def attachment_rates(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, "neuropil string, count_total long, count_proof long, proof_ratio double, side string")


def json_records(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """JSON files, one record each, from any number of paths or globs; ``file`` is the source.

    A file that isn't a record is a row too: its text is in ``corrupt``, all else is null.
    """
    r = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    df = (r.schema(f"{schema}, corrupt string") if schema else r).json(list(paths))
    df = df if "corrupt" in df.columns else df.withColumn("corrupt", F.lit(None).cast("string"))
    return df.withColumn("file", F.input_file_name())


def npz_edges(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """Edges (pre, post) and the shape from a NumPy archive with row, col and shape: a driver-side exchange format."""
    import numpy as np

    z = np.load(path)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"pre": z["row"].astype("int64"), "post": z["col"].astype("int64")})), tuple(int(n) for n in z["shape"])


def forward_filled(df: DataFrame, row: str, *cols: str, block: int = 1_000_000) -> DataFrame:
    """Blank cells take the last value before them in the order of ``row``, a whole number.

    Blocks of rows fill by themselves; what a block starts with comes from the last values of earlier blocks, of which
    there is one row each.
    """
    b = df.withColumn("__b", F.expr(f"{row} div {block}"))
    here = Window.partitionBy("__b").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    tails = b.groupBy("__b").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(row))).alias(f"__t_{c}") for c in cols])
    heads = tails.select("__b", *[F.last(f"__t_{c}", ignorenulls=True).over(before).alias(f"__h_{c}") for c in cols])
    out = b.join(F.broadcast(heads), "__b")
    return out.select(*[F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"__h_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def neuron_core(spark: SparkSession, folder: str) -> DataFrame:
    """All neurons with classification, name, types and sign: left joins, one row for each id on every side."""
    t = {n: node_table(spark, folder, n) for n in NODE_TABLES if n not in ("cell_stats", "connectivity_tags")}
    visual = t["visual_neuron_types"].select("root_id", *[F.col(c).alias(f"visual_{c}") for c in ("type", "family", "subsystem")])
    core = left_join_one_to_one(t["neurons"], "root_id", t["classification"], t["names"].select("root_id", "name"), t["consolidated_cell_types"].select("root_id", "primary_type"), visual)
    return core.withColumn("nt_sign", sign_of(F.col("nt_type")))
