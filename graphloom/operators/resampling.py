"""Medians of random groups and of random signs, without a row for each replicate and input row.

A replicate shuffles which places of the sorted values belong to which group, and a median asks for one or two of these
places only.  So the shuffle is revealed where it is asked for: a tree of binomial draws tells how many members of each
group lie in which part of the order, and a replicate costs some log2(n) draws, whatever the number of rows.  The values at the drawn
places come from one join by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import global_rank
from ..storage import materialize


class Arrangement:
    """A uniformly random order of ``sizes[0]`` items of kind 0 and ``sizes[1]`` of kind 1, drawn as far as it is asked for.

    Each item has a uniform number and the order is that of the numbers.  Of the items in an interval of numbers, those
    in its lower half are a binomial draw for each kind; what was drawn once stays.
    """

    def __init__(self, sizes: tuple[int, int], rng: np.random.Generator) -> None:
        self._rng = rng
        self._root: list = [*sizes, None, None]

    def place(self, kind: int, k: int) -> int:
        """The place (from 0) of the k-th (from 0) item of a kind."""
        node, before = self._root, 0
        while node[1 - kind]:
            if node[2] is None:
                low = [int(self._rng.binomial(node[0], 0.5)), int(self._rng.binomial(node[1], 0.5))]
                node[2:] = [*low, None, None], [node[0] - low[0], node[1] - low[1], None, None]
            low, high = node[2:]
            if k < low[kind]:
                node = low
            else:
                k, before, node = k - low[kind], before + low[0] + low[1], high
        return before + k


def _middle(n: int) -> tuple[int, ...]:
    """The places whose mean is the median of ``n`` values; one place counts twice."""
    return ((n - 1) // 2, n // 2) if n else ()


def _group_places(sizes: tuple[int, int], rng: np.random.Generator) -> list[tuple[int, int]]:
    drawn = Arrangement(sizes, rng)
    return [(kind, drawn.place(kind, k)) for kind in (0, 1) for k in _middle(sizes[kind])]


def _signed_places(n: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Of ``n`` values in order of their size, those in the middle once signs are drawn: (sign, place)."""
    minus = int(rng.binomial(n, 0.5))
    drawn = Arrangement((minus, n - minus), rng)
    # the least values are the largest with a minus
    return [(-1, drawn.place(0, minus - 1 - k)) if k < minus else (1, drawn.place(1, k - minus)) for k in _middle(n)]


def _drawn(df: DataFrame, n_perm: int, seed: int, places) -> DataFrame:
    """``rep, kind, place`` from ``places(rng)`` of each replicate; a replicate's draws hang on seed and number only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(rep, *x) for rep in b.column("id").to_pylist() for x in places(np.random.Generator(np.random.Philox(key=np.array([seed % (1 << 64), rep], np.uint64))))]
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["rep", "kind", "place"])

    return df.sparkSession.range(0, n_perm).mapInArrow(run, "rep long, kind long, place long")


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    return global_rank(rows, [F.col(c).asc() for c in order], "place").withColumn("place", F.col("place") - 1)


def group_medians(rows: DataFrame, n_perm: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``observed`` (one row) and ``rep, s``: the median of v where g holds minus that where it doesn't, as given and for shuffled g.

    ``rows`` is (g, v) without nulls.  Without a row in one of the groups the differences are null.
    """
    rows = materialize(rows.select("g", "v"), "resampled")
    n = rows.agg(F.count_if("g").alias("a"), F.count_if(~F.col("g")).alias("b")).first()
    sizes = (n.a, n.b)
    difference = F.avg(F.when(F.col("kind") == 0, F.col("v"))) - F.avg(F.when(F.col("kind") == 1, F.col("v")))
    # sorted by group and value, the second group comes first
    asked = [(kind, k + (n.b if kind == 0 else 0)) for kind in (0, 1) for k in _middle(sizes[kind])]
    own = rows.sparkSession.createDataFrame(asked, "kind long, place long")  # four rows at most
    observed = _ranked(rows, "g", "v").join(F.broadcast(own), "place").agg(difference.alias("observed"))
    drawn = _drawn(rows, n_perm, seed, lambda rng: _group_places(sizes, rng))
    return observed, drawn.join(_ranked(rows, "v").select("place", "v"), "place").groupBy("rep").agg(difference.alias("s"))


def signed_medians(rows: DataFrame, n_perm: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``observed`` (one row) and ``rep, s``: the median of v, as given and with a random sign for each row; ``rows`` is (v) without nulls."""
    rows = materialize(rows.select("v", F.abs("v").alias("size")), "resampled")
    n = rows.count()
    own = rows.sparkSession.createDataFrame([(k,) for k in _middle(n)], "place long")  # two rows
    observed = _ranked(rows, "v").join(F.broadcast(own), "place").agg(F.avg("v").alias("observed"))
    drawn = _drawn(rows, n_perm, seed, lambda rng: _signed_places(n, rng))
    return observed, drawn.join(_ranked(rows, "size").select("place", "size"), "place").groupBy("rep").agg(F.avg(F.col("kind") * F.col("size")).alias("s"))
