"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Equal vectors form a class: it is indexed once, with its k + 1 smallest ids (no other member can be among any
query's nearest), and queries of one class are answered once.  Coarse centroids and codebooks are fitted on a
bounded sample; how many cells to probe and how far codes err is measured on it as well.  Every class is encoded and
dealt by cell; cells with many vectors or many queries are split by salt on both sides.  Only codes meet queries:
asymmetric distance tables pick candidates that can be nearer than the query's k-th neighbour in the sample.  The
candidates of all cells of a query are then joined with the original vectors and ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

NEIGHBOURS = 5
#: Vectors that centroids and codebooks are fitted on, at most.
SAMPLE = 12_000
#: Of the sample, so many are asked against all of it to set probes and depth.
TRIALS = 400
#: Share of true neighbours that the probed cells, and then the reranked candidates, must hold on the sample.
WANTED = 0.94
WANTED_CODES = 0.985
SUB_DIMS = 2
CODES = 256
#: Cells for each square root of the number of vectors, and at most.
CELLS = 2
MOST_CELLS = 2048
#: Vectors and queries in a part of a cell, about.
PART_ROWS = 50_000
PART_QUERIES = 2_000
#: Classes in the nearest cells whose best codes are reranked in any case, for each neighbour asked for.
ENOUGH = 8


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from random rows; empty clusters take the rows farthest from their centres."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at, far = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            centres[:, d] = np.where(n > 0, np.bincount(at, x[:, d], k) / np.maximum(n, 1), centres[:, d])
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    norms = (centres * centres).sum(1)
    for k in range(0, len(x), 2048):
        d = norms - 2 * (x[k : k + 2048] @ centres.T)
        at[k : k + 2048] = d.argmin(1)
        far[k : k + 2048] = d.min(1) + (x[k : k + 2048] ** 2).sum(1)
    return at, far


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares of tiny or huge numbers stay in range and no digit changes."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of rows, in double precision; each row's sum is independent of the other rows."""
    x, q = scaled(x), scaled(q)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(1)))


@dataclass
class Quantiser:
    coarse: np.ndarray
    books: list[np.ndarray]
    #: Unit vectors of the sample: a query's k-th neighbour among them is no nearer than its k-th in the table.
    sample: np.ndarray
    probes: int = 1
    #: What codes add to a true neighbour's squared distance, and how many codes may be nearer than a true neighbour's.
    slack: float = 0.0
    depth: int = 1

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All cells, the nearest first, and the squared distances to their centroids."""
        d = (self.coarse**2).sum(1) - 2 * (x @ self.coarse.T) + (x * x).sum(1)[:, None]
        order = np.argsort(d, axis=1, kind="stable")
        return order, np.take_along_axis(d, order, 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and what a distance has besides the centroid's and the query's parts."""
        centre = self.coarse[cell]
        codes = np.stack([nearest((x - centre)[:, s], b)[0] for s, b in self._subs()], 1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return codes, ((decoded + 2 * centre) * decoded).sum(1)

    def _subs(self) -> list[tuple[slice, np.ndarray]]:
        return [(slice(k * SUB_DIMS, (k + 1) * SUB_DIMS), b) for k, b in enumerate(self.books)]

    def distances(self, q: np.ndarray, gap: np.ndarray, codes: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Asymmetric, of queries (rows) to quantised residuals of one cell: a table of products for each query and subspace."""
        out = gap[:, None] + bias
        for k, (s, b) in enumerate(self._subs()):
            out -= np.take(2 * (q[:, s] @ b.T), codes[:, k], axis=1)
        return out

    def limits(self, x: np.ndarray, k: int) -> np.ndarray:
        """The squared distance of each row's (k + 1)-th in the sample, one of which may be the row itself, with slack."""
        if len(self.sample) <= k:
            return np.full(len(x), np.inf, np.float32)
        s = np.partition(x @ self.sample.T, -k - 1, axis=1)[:, -k - 1]
        return (2 - 2 * s + max(self.slack, 0.0) + 1e-4).astype(np.float32)


def fit(x: np.ndarray, cells: int, total: int, k: int = NEIGHBOURS) -> Quantiser:
    """Centroids, codebooks, probes, slack and depth from unit vectors ``x``, a sample of ``total``."""
    q = Quantiser(kmeans(x, cells, 10, 1), [], x)
    cell = nearest(x, q.coarse)[0]
    r = x - q.coarse[cell]
    q.books = [kmeans(r[:, d : d + SUB_DIMS], CODES, 8, 2 + d) for d in range(0, x.shape[1], SUB_DIMS)]
    codes, _ = q.encode(x, cell)
    decoded = q.coarse[cell] + np.concatenate([b[codes[:, j]] for j, b in enumerate(q.books)], 1)
    trial = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    order, _ = q.cells(x[trial])
    ranks, depths, errors = [], [], []
    for n, t in enumerate(trial):
        exact = x @ x[t]
        exact[t] = -np.inf
        true = np.argsort(-exact, kind="stable")[: min(k, len(x) - 1)]
        place = np.empty(len(q.coarse), int)
        place[order[n]] = np.arange(len(q.coarse))
        ranks += (place[cell[true]] + 1).tolist()
        guess = ((decoded - x[t]) ** 2).sum(1)
        errors += (guess[true] - (2 - 2 * exact[true])).tolist()
        depths += [int((guess < guess[j]).sum()) + 1 for j in true]
    if ranks:
        q.probes = int(np.quantile(ranks, WANTED, method="higher"))
        q.slack = float(np.quantile(errors, WANTED_CODES, method="higher"))
        # crowding between a vector and its neighbours grows with the number of vectors that are compared at once
        q.depth = int(np.ceil(np.quantile(depths, WANTED_CODES, method="higher") * max(1.0, min(total, PART_ROWS) / len(x)))) + k
    return q


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def neighbours(vectors: DataFrame, every: int = 50, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding; other columns are ignored.  Vectors that are null, zero or of another length
    than most, or hold null or non-finite components, take no part, nor do null ids.  Ties go to the smaller vec_id.
    Rows with a query's own vec_id aren't its neighbours, repeated rows are one neighbour and ask each; fewer than ``k`` candidates are all returned.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v + 0.0).alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("embedding") == size.d)
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = rows.distinct()  # a row that is there several times is one candidate
    few = distinct.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    classes = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(classes.select(F.col("ids")[0].alias("class"), "ids", "embedding"), "ann-classes")
    asks = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "embedding").agg(F.count("*").cast("int").alias("times"))
    # an id with several vectors asks for itself: any number of its own may be nearest
    several = asks.groupBy("vec_id").count().where("count > 1").select("vec_id", F.col("vec_id").alias("own"))
    asks = asks.join(several, "vec_id", "left").withColumnRenamed("vec_id", "query_id")
    asks = materialize(asks.join(classes.select("class", "embedding"), "embedding"), "ann-asks")
    total = classes.count()
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).toArrow()
    model = spark.sparkContext.broadcast(fit(unit(_matrix(sample.column("embedding"))), max(1, min(MOST_CELLS, int(CELLS * total**0.5))), total, k))  # of a bounded size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = unit(_matrix(b.column("embedding")))
                cell = nearest(v, model.value.coarse)[0]
                codes, bias = model.value.encode(v, cell)
                yield pa.record_batch([pa.array(cell.astype(np.int32)), b.column("class"), b.column("only"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(bias.astype(np.float32))], names=["cell", "class", "only", "codes", "bias"])

    only = F.when(F.size("ids") == 1, F.col("ids")[0]).alias("only")
    index = materialize(classes.select("class", only, "embedding").mapInArrow(encode, "cell int, class long, only long, codes binary, bias float"), "ann-index")
    counts = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}  # a row for each centroid
    sizes = np.array([counts.get(c, 0) for c in range(len(model.value.coarse))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("embedding")))
                order, gap = m.cells(x)
                # cells until there are enough classes; an id with several vectors looks everywhere beside them
                enough = (np.cumsum(sizes[order], axis=1) < ENOUGH * (k + 1)).sum(1) + 1
                enough[b.column("own").is_valid().to_numpy(zero_copy_only=False)] = len(sizes)
                at, n = np.nonzero(np.arange(len(sizes)) < np.maximum(enough, m.probes)[:, None])
                rows = pa.array(at)
                cols = [pa.array(order[at, n].astype(np.int32)), b.column("class").take(rows), b.column("own").take(rows), pa.array(n < enough[at]), pa.array(gap[at, n].astype(np.float32))]
                yield pa.record_batch([*cols, pa.array(m.limits(x, k)[at]), pa.array([v.tobytes() for v in x], pa.binary()).take(rows)], names=["cell", "query", "own", "sure", "gap", "limit", "unit"])

    asked = asks.select("class", "own", "embedding").distinct()
    queries = materialize(asked.mapInArrow(probe, "cell int, query long, own long, sure boolean, gap float, limit float, unit binary"), "ann-probes")

    def split(df: DataFrame, rows: int, name: str) -> DataFrame:
        """The number of parts for each cell: as many rows as there are centroids."""
        return F.broadcast(df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name)))

    parts, blocks = split(index, PART_ROWS, "parts"), split(queries, PART_QUERIES, "blocks")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    salt = lambda key, name: F.pmod(F.xxhash64(key), F.col(name)).cast("int")
    vectors_ = index.join(parts, "cell").join(blocks, "cell").withColumn("part", salt("class", "parts")).withColumn("block", every("blocks")).drop("parts", "blocks")
    queries = queries.join(parts, "cell").join(blocks, "cell").withColumn("block", salt("query", "blocks")).withColumn("part", every("parts")).drop("parts", "blocks")

    def search(key: tuple, q: pa.Table, v: pa.Table) -> pa.Table:
        found: list[tuple[list[int], list[int]]] = []
        if q.num_rows and v.num_rows:
            m = model.value
            codes = np.frombuffer(b"".join(v.column("codes").to_pylist()), np.uint8).reshape(v.num_rows, -1)
            bias, only = v.column("bias").to_numpy(), v.column("only").to_pylist()
            x = np.frombuffer(b"".join(q.column("unit").to_pylist()), np.float32).reshape(q.num_rows, -1)
            gap, limit, sure, own = q.column("gap").to_numpy(), q.column("limit").to_numpy(), q.column("sure").to_numpy(), q.column("own").to_pylist()
            step = max(1, (1 << 22) // (v.num_rows + CODES))
            for at in range(0, q.num_rows, step):
                far = m.distances(x[at : at + step], gap[at : at + step], codes, bias)
                for i, d in enumerate(far, at):
                    if own[i] is not None:
                        d[[o == own[i] for o in only]] = np.inf
                    near = np.flatnonzero(d <= limit[i])
                    least = k + 1 if sure[i] else 0
                    if len(near) < least:
                        near = np.argsort(d, kind="stable")[:least]
                        near = near[d[near] < np.inf]
                    if len(near) > m.depth:
                        near = near[np.argpartition(d[near], m.depth)[: m.depth]]
                    if len(near):
                        found.append(([i] * len(near), near.tolist()))
        mine, near = (pa.array([x for f in found for x in f[n]], pa.int64()) for n in (0, 1))
        return pa.table([q.column("query").take(mine), q.column("own").take(mine), v.column("class").take(near)], names=["query", "own", "near"])

    near = queries.groupBy("cell", "part", "block").cogroup(vectors_.groupBy("cell", "part", "block")).applyInArrow(search, "query long, own long, near long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                exact = cosines(_matrix(b.column("theirs")), _matrix(b.column("mine")))
                yield pa.record_batch([b.column("class"), b.column("own"), b.column("ids"), pa.array(exact)], names=["class", "own", "ids", "score"])

    theirs = classes.select(F.col("class").alias("near"), "ids", F.col("embedding").alias("theirs"))
    mine = asked.select("class", F.col("embedding").alias("mine")).distinct()
    pairs = near.withColumnRenamed("query", "class").join(theirs, "near").join(mine, "class").select("class", "own", "ids", "theirs", "mine")
    best = pairs.mapInArrow(score, "class long, own long, ids array<long>, score double").select("class", "own", F.explode("ids").alias("near"), "score").where("own is null or near <> own")
    order = Window.partitionBy("class", "own").orderBy(F.desc("score"), "near")
    best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = best.groupBy(F.col("class").alias("of"), F.col("own").alias("by")).agg(F.array_sort(F.collect_list(F.struct("n", "near", "score"))).alias("best"))  # k + 1 each
    mine = F.slice(F.filter("best", lambda b: b["near"] != F.col("query_id")), 1, k)
    asking = asks.select("query_id", "class", "own", F.explode(F.array_repeat(F.lit(0), F.col("times"))))  # each row asks
    asking = asking.join(lists, (F.col("class") == F.col("of")) & F.col("own").eqNullSafe(F.col("by")))
    return asking.select("query_id", F.posexplode(mine).alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.near").alias("vec_id"), F.col("b.score").alias("score"))
