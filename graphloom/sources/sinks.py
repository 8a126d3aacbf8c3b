"""Writers: tables, reports, manifests, exchange formats."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..operators.jobs import append_new


def parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose joins and aggregations on ``key`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def atomic(path: str | Path, data: bytes) -> None:
    """A driver-side file that appears whole or not at all."""
    path = Path(path)
    handle, tmp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise


def _few(df: DataFrame, most: int) -> list:
    """All rows of a small result; ValueError if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    return rows


def report(values: dict[str, Any] | DataFrame, path: str | Path, most: int = 100_000) -> None:
    """A JSON report of a dict, or of the rows of a small table, whose number is checked."""
    data = [r.asDict(recursive=True) for r in _few(values, most)] if isinstance(values, DataFrame) else values
    atomic(path, json.dumps(data, indent=2, default=str).encode())


def append_rows(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't in the Parquet table at ``path`` yet; how many were appended."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = df.limit(0)
    new = append_new(old, df, key).join(old.select(key), key, "left_anti").select(*df.columns)
    from ..storage import materialize

    new = materialize(new, "append")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def latex(df: DataFrame, caption: str, label: str, digits: int = 3, most: int = 1000) -> str:
    """A LaTeX table of a small result, whose number of rows is checked; special characters are escaped, nulls are dashes."""
    def cell(v: Any) -> str:
        text = "--" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
        return "".join({"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}.get(c, f"\\{c}" if c in "&%$#_{}" else c) for c in text)

    rows = [" & ".join(map(cell, r)) + r" \\" for r in _few(df, most)]
    head = " & ".join(map(cell, df.columns)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def npz(df: DataFrame, shape: tuple[int, int], path: str, most: int = 50_000_000) -> None:
    """Edges (pre, post) as a compressed NumPy archive with row, col and shape; the number of edges is checked."""
    import numpy as np

    e = df.select("pre", "post").orderBy("pre", "post").limit(most + 1).toArrow()
    if e.num_rows > most:
        raise ValueError(f"more than {most} edges")
    np.savez_compressed(path, row=e.column("pre").to_numpy(), col=e.column("post").to_numpy(), shape=np.array(shape))


def archive(folder: str | Path, path: str | Path, forbidden: tuple[str, ...] = ()) -> list[str]:
    """A ZIP of a folder's files, sorted; raises ValueError if a name holds a forbidden text."""
    folder = Path(folder)
    names = sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())
    leaks = [n for n in names for f in forbidden if f in n]
    if leaks:
        raise ValueError(f"must not be packed: {leaks}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.write(folder / n, n)
    return names
