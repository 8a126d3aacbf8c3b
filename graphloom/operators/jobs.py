"""Validation of tables and result records, job manifests, adoption of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_id

CHECKS = (
    "seed_correct", "version_correct", "node_count", "edge_count", "pairs_config", "cis_valid",
    "no_self_loops", "no_duplicate_edges", "out_degree_exact", "in_degree_exact", "statistic_present",
)
STATUSES = ("pending", "running", "done", "failed")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises ValueError if a key occurs twice (nulls are a key as well)."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not one row for each {keys}: {twice[0]}")
    return df


def left_join_one_to_one(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """``base`` with the columns of each other table; both sides must have unique keys, names must not clash."""
    out = assert_unique(base, key)
    for o in others:
        clash = ({*out.columns} & {*o.columns}) - {key}
        if clash:
            raise ValueError(f"columns in both tables: {sorted(clash)}")
        out = out.join(assert_unique(o, key), key, "left")
    return out


def id_report(df: DataFrame, *cols: str) -> DataFrame:
    """``column, n, n_null, min_id, max_id, all_match``: one row for each id column, from one scan."""
    aggs = []
    for c in cols:
        present = F.col(c).isNotNull()
        aggs += [F.count("*").alias(f"n_{c}"), F.count_if(~present).alias(f"z_{c}"), F.min(c).cast("string").alias(f"a_{c}"), F.max(c).cast("string").alias(f"b_{c}"), F.coalesce(F.bool_and(F.when(present, is_id(F.col(c)))), F.lit(True)).alias(f"m_{c}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"z_{c}").alias("n_null"), F.col(f"a_{c}").alias("min_id"), F.col(f"b_{c}").alias("max_id"), F.col(f"m_{c}").alias("all_match")) for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def record_checks(records: DataFrame, seed_base: int, version: str, n_nodes: int, n_edges: int, n_pair_nodes: int, n_cases: int, n_controls: int) -> DataFrame:
    """Each null record with its eleven checks and ``ok``; a missing field fails its check."""

    def bounded(c: str) -> Column:
        return F.forall(F.col(c), lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))

    checks = {
        "seed_correct": F.col("seed") == F.col("null_id") + seed_base,
        "version_correct": F.col("code_version") == version,
        "node_count": F.col("n_nodes") == n_nodes,
        "edge_count": F.col("n_edges_null") == n_edges,
        "pairs_config": F.col("n_pair_nodes") == n_pair_nodes,
        "cis_valid": (F.size("gaba_cis") == n_cases) & (F.col("n_gaba") == n_cases) & (F.size("ctrl_cis") == n_controls) & bounded("gaba_cis") & bounded("ctrl_cis"),
        "no_self_loops": F.col("no_self_loops"),
        "no_duplicate_edges": F.col("no_duplicate_edges"),
        "out_degree_exact": F.col("out_degree_exact_match"),
        "in_degree_exact": F.col("in_degree_exact_match"),
        "statistic_present": F.col("cliffs_delta").isNotNull() & F.col("median_diff").isNotNull(),
    }
    flags = {f"check_{k}": F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    ok = None
    for f in flags.values():
        ok = f if ok is None else ok & f
    return records.select("*", *[v.alias(k) for k, v in flags.items()], ok.alias("ok"))


def adoption(checked: DataFrame, adopted: DataFrame, n_nulls: int) -> DataFrame:
    """``null_id, verdict`` of checked records (null_id, ok) against those adopted (null_id): bad_id, skip, reject or adopt."""
    have = adopted.select("null_id", F.lit(True).alias("have")).distinct()
    bad = F.col("null_id").isNull() | (F.col("null_id") < 0) | (F.col("null_id") >= n_nulls)
    return checked.join(have, "null_id", "left").select("null_id", F.when(bad, "bad_id").when(F.col("have"), "skip").when(~F.col("ok"), "reject").otherwise("adopt").alias("verdict"))


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` and the rows of ``incoming`` whose key isn't there yet; of repeated new keys the first in column order."""
    order = Window.partitionBy(key).orderBy(*[c for c in incoming.columns if c != key])
    fresh = incoming.join(existing.select(key), key, "left_anti").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    return existing.unionByName(fresh.select(*existing.columns))


def last_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The union of both tables; where both have a key, the row of ``second``."""
    both = first.withColumn("__p", F.lit(0)).unionByName(second.withColumn("__p", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.col("__p").desc(), *[c for c in first.columns if c != key])
    return both.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__p", "__r")


def new_manifest(spark, n: int, seed_base: int, name: str = "null") -> DataFrame:
    """A row for each job: ``null_id, null_name, seed, status, worker_id, attempts, error, result_file, updated_utc``."""
    return manifest_of(spark.range(n), seed_base, name)


def manifest_of(ids: DataFrame, seed_base: int, name: str = "null") -> DataFrame:
    """``new_manifest`` of the jobs with the given ``id``, each once; null ids are none."""
    j = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    text = F.lit(None).cast("string")
    digits = F.greatest(F.length(F.col("id").cast("string")), F.lit(3))  # padded to three, never cut
    return j.select(F.col("id").alias("null_id"), F.concat(F.lit(f"{name}_"), F.lpad(F.col("id").cast("string"), digits, F.lit("0"))).alias("null_name"), (F.col("id") + seed_base).alias("seed"), F.lit("pending").alias("status"), text.alias("worker_id"), F.lit(0).alias("attempts"), text.alias("error"), text.alias("result_file"), text.alias("updated_utc"))


def mark(manifest: DataFrame, updates: DataFrame, at: str) -> DataFrame:
    """The manifest after ``updates`` (null_id, status, worker_id, error, result_file): a job that starts running counts an attempt."""
    u = updates.select("null_id", *[F.col(c).alias(f"u_{c}") for c in ("status", "worker_id", "error", "result_file")])
    out = manifest.join(u, "null_id", "left")
    hit = F.col("u_status").isNotNull()
    cols = []
    for c in manifest.columns:
        if c in ("status", "worker_id", "error", "result_file"):
            cols.append(F.when(hit, F.coalesce(f"u_{c}", c)).otherwise(F.col(c)).alias(c))
        elif c == "attempts":
            cols.append((F.col(c) + F.when(hit & (F.col("u_status") == "running"), 1).otherwise(0)).alias(c))
        elif c == "updated_utc":
            cols.append(F.when(hit, F.lit(at)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def reconcile(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Jobs with a result row (null_id) are done; "done" jobs without one are pending again."""
    have = rows.select("null_id", F.lit(True).alias("have")).distinct()
    status = F.when(F.col("have"), "done").when(F.col("status") == "done", "pending").otherwise(F.col("status"))
    return manifest.join(have, "null_id", "left").select(*[status.alias(c) if c == "status" else F.col(c) for c in manifest.columns])


def pending(manifest: DataFrame, most_attempts: int = 3) -> DataFrame:
    return manifest.where((F.col("status") != "done") & (F.col("attempts") < most_attempts)).orderBy("null_id")


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a, only_b``: how many rows, repeats counted, are in one table only."""
    n = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return n(a, b, "only_a").crossJoin(n(b, a, "only_b"))


def agreement(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """``n, max_diff, n_off`` of a value in two tables by key; keys in one table only are off."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full_outer")
    diff = F.abs(F.col("x") - F.col("y"))
    return both.agg(F.count("*").alias("n"), F.max(diff).alias("max_diff"), F.count_if(diff.isNull() | (diff > tolerance)).alias("n_off"))


def file_hashes(spark, path: str) -> DataFrame:
    """``path, length, sha256`` of the files at a path or glob."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def mentions(docs: DataFrame, pattern: str) -> DataFrame:
    """``term, n_docs, n``: how often matches of a pattern occur in texts, and in how many documents."""
    hits = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("term"))
    return hits.groupBy("term").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


def load_manifest(spark, path: str, version: str):
    """The manifest at ``path`` (Parquet); ValueError if any of its jobs is of another code version."""
    m = spark.read.parquet(path)
    other = m.where(~F.col("code_version").eqNullSafe(version)).select("code_version").first()
    if other:
        raise ValueError(f"manifest at {path} is of version {other.code_version!r}, not {version!r}")
    return m


def progress(manifest: DataFrame) -> DataFrame:
    """One row: ``n_jobs, n_done, n_failed, n_open, share_done, most_attempts``; what a status command prints."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    n = F.count("*")
    return manifest.agg(n.alias("n_jobs"), done.alias("n_done"), failed.alias("n_failed"), (n - done - failed).alias("n_open"), F.when(n > 0, done / n).alias("share_done"), F.max("attempts").alias("most_attempts"))


def reproducibility(spark, paths: list[str], parameters: dict[str, str], version: str) -> dict:
    """What a run can be repeated from: hashes of its files, its parameters, code version, engine and settings."""
    import platform

    files = [r.asDict() for p in paths for r in file_hashes(spark, p).orderBy("path").collect()]  # a run's files
    settings = {k: v for k, v in sorted(spark.sparkContext.getConf().getAll()) if k.startswith("spark.sql.")}
    return {"files": files, "parameters": dict(sorted(parameters.items())), "code_version": version, "python": platform.python_version(), "spark": spark.version, "settings": settings}
