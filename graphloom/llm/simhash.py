"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints of 64 bits link when they differ in 3 bits or fewer.  They are cut into four segments of
16 bits: three errors leave one segment exact, and of the two halves (24 bits each) of the rest one has
one error at most.  A half is decoded by the perfect binary Golay code (23,12): the codewords nearest to
the half and to the words one bit away are its keys, one or six of them.  Halves within one error share a key.
A key is thus (which segment, its 16 bits, which half, 12-bit codeword index): 8 tables, about 42 keys
for each *distinct* fingerprint, and pairs that meet under a key are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import resemblance
from .common import connected_components, materialize

SEED = 42
WIDTH = 3
MAX_BITS = 3
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Up to so many fingerprints under one key are compared pair by pair; more are split by further pigeonholes.
DIRECT = 1024

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a whole UTF-8 text; 0 if it has no words or is null."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < WIDTH:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), "<u8")
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").view("<u8")[0])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64)), "node": b.column("node")})


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    s = words.copy()
    for bit in range(22, 10, -1):
        s ^= np.where((s >> bit) & 1, GOLAY << (bit - 11), 0)
    return s


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns that lead a word, or a word one bit away, to its nearest codewords; how many."""
    one = 1 << np.arange(23)
    errors = np.concatenate([[0], one, *[one[:i] | one[i] for i in range(1, 23)], *[one[:i] | one[i] | one[j] for j in range(2, 23) for i in range(1, j)]])
    leader = np.zeros(2048, np.int64)
    leader[_syndrome(errors)] = errors
    flips = np.concatenate([[0], one])
    near = np.sort(leader[np.arange(2048)[:, None] ^ _syndrome(flips)] ^ flips, axis=1)
    new = np.concatenate([np.ones((2048, 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
    n = new.sum(1)
    table = np.zeros((2048, n.max()), np.int64)
    for s in range(2048):
        table[s, : n[s]] = near[s][new[s]]
    return table, n


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, n = golay_tables()
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        keys, owners = [], []
        for segment in range(4):
            exact = ((fp >> np.uint64(16 * segment)) & np.uint64(0xFFFF)).astype(np.int64)
            low = fp & np.uint64((1 << (16 * segment)) - 1)
            high = fp >> np.uint64(16 * segment + 16) if segment < 3 else np.zeros_like(fp)
            rest = low | (high << np.uint64(16 * segment))
            for half in range(2):
                word = ((rest >> np.uint64(24 * half)) & np.uint64((1 << 23) - 1)).astype(np.int64)
                s = _syndrome(word)
                index = (word[:, None] ^ table[s]) >> 11
                row, col = np.nonzero(np.arange(table.shape[1]) < n[s][:, None])
                keys.append(((segment * 2 + half) << 28 | exact[row] << 12) | index[row, col])
                owners.append(row)
        at = np.concatenate(owners)
        yield pa.record_batch({"key": pa.array(np.concatenate(keys)), "fp": pa.array(fp[at].view(np.int64))})


class _Forest:
    """Union-find over the linked fingerprints of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (p := up.setdefault(top, top)) != top:
            top = p
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def link_all(fp: np.ndarray, forest: _Forest) -> None:
    """Link all distinct ``fp`` (uint64) within MAX_BITS of one another, without all pairs of a large group."""
    if len(fp) < 2:
        return
    varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [i for i in range(64) if varying >> i & 1]
    if len(bits) <= MAX_BITS:
        for x in fp[1:].tolist():
            forest.link(int(fp[0]), x)
    elif len(fp) <= DIRECT:
        i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp) <= MAX_BITS, 1))
        for x, y in zip(fp[i].tolist(), fp[j].tolist()):
            forest.link(x, y)
    else:
        for part in range(MAX_BITS + 1):
            mask = np.uint64(sum(1 << i for i in bits[part :: MAX_BITS + 1]))
            value = fp & mask
            order = np.argsort(value, kind="stable")
            for group in np.split(fp[order], np.flatnonzero(np.diff(value[order])) + 1):
                link_all(group, forest)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: a spanning forest of the links found in this task."""
    forest = _Forest()
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def close(key: np.ndarray, fp: np.ndarray) -> None:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        pairs = starts[sizes == 2]
        near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= MAX_BITS]
        for x, y in zip(fp[near].tolist(), fp[near + 1].tolist()):
            forest.link(x, y)
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            link_all(np.unique(fp[s : s + n]), forest)

    for b in batches:
        if b.num_rows:
            key = np.concatenate([key, b.column("key").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                close(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
    if len(key):
        close(key, fp)
    pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
    for k in range(0, len(pairs), 10_000):
        a = np.array(pairs[k : k + 10_000], np.uint64).view(np.int64)
        yield pa.record_batch({"a": pa.array(a[:, 0].copy()), "b": pa.array(a[:, 1].copy())})


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all distinct fingerprints ``fp`` within MAX_BITS of one another."""
    keyed = distinct.mapInArrow(_keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, resembling: bool = False) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (columns doc_id, text; others are ignored).

    Null, empty and blank texts have fingerprint zero and link like any other.  Repeated rows come back as
    often as they went in.  component_id is the smallest doc_id reachable over links (nulls don't count).
    With ``resembling``, texts whose five-word shingles have a Jaccard similarity of 0.8 or more link as well.
    """
    if resembling:
        # the fingerprint of each text, by its name
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), resemblance.name(F.col("text")).alias("node"))
        every = materialize(texts.mapInArrow(_named, "doc_id long, fp long, node binary"), "simhash")
        fps = every.select("doc_id", "fp")
        more = resemblance.links(docs, every.select("node", "fp").dropDuplicates(["node"]))
    else:
        fps, more = materialize(fingerprints(docs), "simhash"), None
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    near = fingerprint_links(nodes.select("fp"))
    labels = connected_components(near if more is None else near.unionByName(more)).select(F.col("node").alias("fp"), "root")
    linked = nodes.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    first = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = linked.join(first, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, resembling: bool = False) -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller doc_id, all columns unchanged.

    Of rows that share a doc_id one stays.  Rows without doc_id stay: nothing tells them apart.
    """
    found = materialize(near_duplicates(docs, resembling), "simhash-classes")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))  # columns may have any names
    # always by shuffle: the list of what goes grows with the documents
    rows = rows.join(gone.hint("merge"), "id", "left_anti")
    again = found.where("doc_id is not null and doc_id = component_id").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    if not again.isEmpty():
        order = Window.partitionBy("id").orderBy(F.xxhash64("kept.text"), "kept.text")
        first = rows.join(again, "id", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        rows = rows.join(again, "id", "left_anti").unionByName(first)
    return rows.select("kept.*")
