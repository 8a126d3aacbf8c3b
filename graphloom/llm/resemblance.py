"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Sixty-four bits of a fingerprint can't tell that similarity: such texts differ in about ten of them.  So banded minima
of hashes (30 bands of 6) make candidates: a pair at 0.8 shares a band with probability 0.9999.  Equal texts are one,
named by 128 bits of their SHA-256.
Candidates are verified on the whole sets of shingles, in two steps.  First the members of each band meet its first
member only, a large band's dealt over several tasks.  Only bands of three or more whose members aren't connected by
then have their other members compared, in blocks of bounded size, without pairs that are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

WIDTH = 5
SIMILAR = 0.8
BANDS, IN_BAND = 30, 6

_DRAW = np.random.default_rng(7)
_TIMES = _DRAW.integers(0, 1 << 63, BANDS * IN_BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, BANDS * IN_BAND, np.uint64)
#: Shingles that are multiplied at a time.
CHUNK = 4096
#: Texts that meet a band's first member in one task, and shingles of a block.
STAR = 4096
BLOCK = 1 << 20


def name(text: Column) -> Column:
    """What a text goes by: 128 bits, so that different texts don't share a name at any number of documents."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    every = [b" ".join(words)] if len(words) < WIDTH else map(b" ".join, zip(*(words[k:] for k in range(WIDTH))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, every), np.uint64))


def bands(h: np.ndarray) -> list[int]:
    """A key for each band, as signed longs; none for a text without words."""
    if not len(h):
        return []
    least = np.full(len(_TIMES), (1 << 64) - 1, np.uint64)
    for k in range(0, len(h), CHUNK):
        mixed = h[k : k + CHUNK, None] * _TIMES + _PLUS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(0), out=least)
    rows = least.reshape(BANDS, IN_BAND)
    return [xxhash.xxh64_intdigest(rows[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def verified(roots: list, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all similar pairs among ``sets``, by position; those of one root are connected already."""
    together: dict[object, list[int]] = {}
    for x, root in enumerate(roots):
        together.setdefault(root, []).append(x)
    out: list[tuple[int, int]] = []
    groups: list[list[int]] = []
    for new in together.values():
        stays, grown = [], new
        for old in groups:
            link = next(((y, x) for x in new for y in old if similar(sets[x], sets[y])), None)
            if link:
                out.append(link)
                grown = grown + old
            else:
                stays.append(old)
        groups = [*stays, grown]
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, keys = [], []
        for t in b.column("text"):
            h = shingles(t.as_py())
            size.append(len(h))
            keys.append(bands(h))
        yield pa.record_batch([b.column("node"), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "size", "keys"])


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by a, salt and b, where a null ``b`` is the text of ``a``: the b that are similar to their a."""
    first = np.empty(0, np.uint64)
    for rows in batches:
        a, b = [], []
        for x, y, text in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), rows.column("text")):
            h = shingles(text.as_py())
            if y is None:
                first = h
            elif similar(first, h):
                a.append(x)
                b.append(y)
        yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, i and j: the links found in each block."""
    now, nodes, roots, sets = None, [], [], []

    def close() -> pa.RecordBatch:
        found = verified(roots, sets)
        return pa.record_batch([pa.array([nodes[x] for x, _ in found], pa.binary()), pa.array([nodes[y] for _, y in found], pa.binary())], names=["a", "b"])

    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("key", "i", "j", "node", "root"))
        for *unit, node, root, text in zip(*columns, b.column("text")):
            if unit != now:
                if len(nodes) > 1:
                    yield close()
                now, nodes, roots, sets = unit, [], [], []
            nodes.append(node)
            roots.append(root)
            sets.append(shingles(text.as_py()))
    if len(nodes) > 1:
        yield close()


def links(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``a, b``: links that connect similar texts of ``docs`` (text), by the fp that ``names`` (node, fp) has for each ``name`` of a text.

    Null and wordless texts have no links; a text of fewer than five words is one shingle.
    """
    texts = docs.where("text is not null").select(name(F.col("text")).alias("node"), F.col("text").cast("binary").alias("text"))
    keyed = materialize(texts.mapInArrow(_keys, "node binary, size long, keys array<long>").dropDuplicates(["node"]), "bands")
    one = keyed.select("node", "size", F.explode("keys").alias("key"))
    sizes = one.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = materialize(one.join(sizes.hint("merge"), "key"), "band-members")
    met = members.select("node").distinct()
    # copies go before the shuffle: one text of a group leaves each task
    whole = materialize(texts.dropDuplicates(["node"]).join(met.hint("merge"), "node", "left_semi"), "band-texts")

    others = members.where("node <> first")
    pairs = others.groupBy(F.col("first").alias("a"), F.col("node").alias("b")).agg(F.ceil(F.max("n") / STAR).alias("salts"))
    theirs = whole.withColumnRenamed("node", "b").join(pairs.hint("merge"), "b")
    theirs = theirs.select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b", "text")
    firsts = pairs.groupBy("a").agg(F.max("salts").alias("salts"))
    mine = whole.withColumnRenamed("node", "a").join(firsts.hint("merge"), "a")
    mine = mine.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "text")
    dealt = theirs.unionByName(mine).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    star = materialize(dealt.select("a", "b", "text").mapInArrow(_star, "a binary, b binary"), "band-links")

    roots = connected_components(star)
    loose = others.where("n > 2").join(roots.hint("merge"), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    loose = materialize(loose, "band-roots")
    split = loose.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("size"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("low <> high")
    split = split.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.ceil(F.max("size") / BLOCK).alias("blocks"))  # equal bands once
    rest = loose.select("key", "node", "root").join(split.select("key", "blocks").hint("merge"), "key").withColumn("mine", F.pmod(F.xxhash64("node"), "blocks"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 or mine <> other")
    rest = rest.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "root")
    rest = whole.join(rest.hint("merge"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = rest.select("key", "i", "j", "node", "root", "text").mapInArrow(_blocks, "a binary, b binary").unionByName(star)

    a, b = (names.select(F.col("node").alias(c), F.col("fp").alias(f"{c}_fp")).hint("merge") for c in "ab")
    return found.join(a, "a").join(b, "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).where("a <> b")
