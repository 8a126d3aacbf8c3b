"""Intermediate results in shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a temporary folder in local mode, where all tasks see it; an error on a cluster, where they don't.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/graphloom-checkpoints"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder of the application goes when the driver ends, or earlier with ``release``.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"
    _written.add(folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which can't be used any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = SparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == f"graphloom-{df.sparkSession.sparkContext.applicationId}":
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Delete all that ``materialize`` wrote; DataFrames that read it can't be used any more."""
    jvm = SparkContext._jvm
    while _written and jvm:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if not SparkContext._active_spark_context else SparkContext._active_spark_context._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception as e:  # the engine may be gone; what is left is the folder of one application
        print(f"graphloom: intermediate results stay: {type(e).__name__}")
