"""Removal of long repeated word sequences by prefix-partitioned suffix trees.

The suffixes of the corpus, in words, are split by variable-length prefixes into groups that fit a task, each group's
subtree is built by itself, and every internal node as deep as the window is long stands for a sequence that repeats.
All suffixes with all their words would be many times the corpus, so a suffix travels with the one that opens its
group:

1. Of the prefixes of ``PREFIXES[0]`` words that start inside a window and end in it, the one with the least hash names
   the window's group: equal windows have equal groups, and neighbouring windows mostly share one.  How often each
   prefix is held is counted.  A prefix that occurs once leads to a leaf: its windows are unique and go no further.  A
   prefix with more than ``most`` different stretches of windows would make too large a group: its windows are named by longer
   prefixes, at last by all their words.
2. A stretch of windows of one group is sent once by each shard, as text.  A task builds the subtrees of its groups
   from the top down: the suffixes of a node part by the words that follow, up to eight at a time, and a suffix that is
   alone is a leaf.  What still shares a node at the depth of a window repeats.
3. Each shard learns which windows of its stretches repeat and removes their words.

Hashes name groups and decide nothing: words are compared as words.  Documents are dealt over shards by hash, equal
texts of a shard are read once, and a passage that a third of all documents hold costs a shard as much as one that it
holds once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, planned_bytes

WINDOW = 35
#: Words of the prefixes that name groups, before those of the window's length.
PREFIXES = (8, 16)
#: Distinct stretches of windows in a group, as its shards count them, at most.
MOST = 20_000
#: Bytes of (compressed) input in a shard, and in what a task builds subtrees of.
SHARD_BYTES = 8 << 20
#: Words by which suffixes part at a time.
RANGE = 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: The low bytes of a number, by how many of them.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def _joined(x: np.ndarray, step: int) -> np.ndarray:
    """A hash of two neighbouring strings for each place, from hashes of strings of ``step`` words."""
    return _mixed(x[:-step] * _MIX[1] + x[step:]) if len(x) > step else x[:0]


def prefix_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each place on, from hashes of words."""
    x, n = words, 1
    while 2 * n <= length:
        x, n = _joined(x, n), 2 * n
    return _joined(x, length - n) if length > n else x


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of ``width`` neighbours, the first of equal ones, from each place on."""
    low, at, n = x, np.arange(len(x)), 1
    while n < width:
        step = min(n, width - n)
        if len(low) <= step:
            return at[:0]
        behind = low[step:] < low[:-step]
        low, at, n = np.where(behind, low[step:], low[:-step]), np.where(behind, at[step:], at[:-step]), n + step
    return at


class Texts:
    """The distinct texts of a shard as words, one behind the other."""

    def __init__(self, texts: Counter[str], window: int) -> None:
        self.texts, self.window = sorted(texts), window  # in an order that doesn't depend on how rows arrive
        self.times = np.array([texts[t] for t in self.texts], np.int64)
        split = pc.ascii_split_whitespace(pa.array(self.texts, pa.large_string()))
        words = split.flatten()
        real = pc.not_equal(words, "")  # white space at the ends of a text leaves empty strings
        count = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        self.starts = count[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        self.words = words.filter(real)
        sizes = np.diff(self.starts)
        # windows that don't cross texts
        n = np.maximum(sizes - window + 1, 0)
        self.open = np.repeat(self.starts[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        # all words with a space behind each, and where they begin
        self.at = np.concatenate([[0], np.cumsum(pc.binary_length(self.words).to_numpy() + 1)])
        self.joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(self.words)], pa.int64()), self.words), pa.scalar(" ", pa.large_string()))[0].as_py().encode()

    def hash(self) -> None:
        """Hashes of the words, from their first and last eight bytes and, of longer words, from all."""
        data = self.joined + bytes(8)
        at, size = self.at[:-1], np.diff(self.at) - 1
        eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
        first = eight[at] & _LOW[np.minimum(size, 8)]
        last = np.where(size > 8, eight[np.maximum(at + size - 8, 0)], np.uint64(0))
        for k in np.flatnonzero(size > 16).tolist():
            last[k] = xxhash.xxh3_64_intdigest(self.joined[at[k] : at[k] + size[k]])
        self.hashes = _mixed(_mixed(first * _MIX[1] + size.astype(np.uint64)) * _MIX[1] + last)


    def text(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b``, exclusive, joined by spaces."""
        return self.joined[self.at[a] : self.at[b] - 1] if b > a else b""

    def times_of(self, start: np.ndarray) -> np.ndarray:
        """How often the texts that hold these words stand in the shard."""
        return self.times[np.searchsorted(self.starts, start, "right") - 1]

    def names(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows that start ``at``: the place of the prefix that names each one's group, and its hash."""
        h = prefix_hashes(self.hashes, length)
        place = least_in(h, self.window - length + 1)[at] if len(at) else at
        return place, h[place]


def _runs(place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a new stretch begins: windows that follow one another and have one place are together."""
    return np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])) if len(place) else np.empty(0, np.int64)


class _Level:
    """What a shard was told of its prefixes of one length: those that occur more than once, and which are too frequent."""

    def __init__(self, level: int, told: pa.Table) -> None:
        mine = told.filter(pc.equal(told.column("level"), level))
        keys, often = mine.column("key").to_numpy().view(np.uint64), mine.column("n").to_numpy() < 0
        order = np.argsort(keys)
        self.keys, self.often = keys[order], often[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` repeat and make a group, and which are too frequent for that."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[k] == keys
        return known & ~self.often[k], known & self.often[k]


def stretches(t: Texts, lengths: tuple[int, ...], told: pa.Table, level: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """Groups so far and what is left: for each level below ``level`` its number, starts of windows and places of their prefixes; starts left."""
    left, out = t.open, []
    for k, length in enumerate(lengths[:level]):
        place, key = t.names(length, left)
        group, often = _Level(k, told).of(key)
        out.append((k, left[group], place[group]))
        left = left[often]
    return out, left


_KEYS = "key long, shard long, level int, n long, m long"


def _keys(key: np.ndarray, shard: int, level: int, n: np.ndarray, m: np.ndarray) -> pa.Table:
    return pa.table([pa.array(key.view(np.int64)), pa.array(np.full(len(key), shard)), pa.array(np.full(len(key), level, np.int32)), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))], names=["key", "shard", "level", "n", "m"])


def _told(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all shards' prefixes that were dealt to a task: those that occur more than once, n below zero if too frequent."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        kind, _ = pd.factorize(table.column("key").to_numpy())
        total, stretches_ = (np.bincount(kind, table.column(c).to_numpy())[kind] for c in ("n", "m"))
        out = table.set_column(3, "n", pa.array(np.where(stretches_ > most, -1, 1))).filter(pa.array(total > 1))
        yield from out.to_batches()

    return run


def sent(t: Texts, found: list[tuple[int, np.ndarray, np.ndarray]], lengths: tuple[int, ...]) -> list[tuple[int, int, bytes, bytes]]:
    """Distinct stretches of a shard: the key of the group, how often it stands in the shard, where, and the text."""
    out: dict[tuple[int, bytes], list] = {}
    for level, start, place in found:
        cut = _runs(place, start)
        first, last = start[cut], start[np.append(cut[1:], len(start))[: len(cut)] - 1]
        keys = prefix_hashes(t.hashes, lengths[level])[place[cut]].view(np.int64)
        joined, width = t.joined, t.window
        for a, i, j, key, n in zip(first.tolist(), t.at[first].tolist(), (t.at[last + width] - 1).tolist(), keys.tolist(), t.times_of(first).tolist()):
            known = out.setdefault((level, joined[i:j]), [key, 0, []])
            known[1] += n
            known[2].append(a)
    return [(key, n, np.array(places, "<i8").tobytes(), text) for (_, text), (key, n, places) in out.items()]


def _deepest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The subtrees of all groups of a task: to each stretch the runs of windows that end in a node with several leaves."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        repeated, windows = deep_windows(table.column("text").cast(pa.large_binary()).cast(pa.large_string()), table.column("times").to_numpy(), table.column("key").to_numpy(), window)
        stretch, low, high = runs_of(repeated, windows)
        found = table.select(["shard", "places"]).take(pa.array(stretch)).append_column("low", pa.array(low)).append_column("high", pa.array(high + window))
        yield from found.combine_chunks().to_batches(10_000)

    return run


def runs_of(repeated: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretch of each run of windows that repeat, its first and last window there."""
    at = np.flatnonzero(repeated)
    stretch = np.repeat(np.arange(len(windows)), windows)[at]
    first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(stretch, prepend=-1) > 0))
    base, last = (np.cumsum(windows) - windows)[stretch[first]], np.append(first[1:], len(at))[: len(first)] - 1
    return stretch[first], at[first] - base, at[last] - base


def deep_windows(texts: pa.ChunkedArray, times: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows lie below an internal node of depth ``window``, and how many each stretch has; ``times``: how often it stands there.

    From the top down: suffixes of a node part by their next words, RANGE at a time; those that are alone leave.
    """
    split = pc.split_pattern(texts, " ").combine_chunks()
    words = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    sizes = pc.list_value_length(split).to_numpy()
    ends = np.cumsum(sizes)
    classes, n = words, 1  # of 1, 2, 4, 8 words
    while n < min(RANGE, window):
        step = min(n, window - n, RANGE - n)
        pair = classes[:-step] * np.int64(classes.max(initial=0) + 1) + classes[step:]
        classes, n = pd.factorize(pair)[0].astype(np.int64), n + step
    windows = sizes - window + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    start = np.repeat(ends - sizes - first[:-1], windows) + np.arange(first[-1])
    weight = np.repeat(times, windows)
    node = np.repeat(pd.factorize(group)[0], windows).astype(np.int64)
    alive = np.arange(len(start))
    depth = 0
    while depth < window and len(alive):
        at = start[alive] + min(depth, window - n)  # the last words overlap with those before
        node = pd.factorize(node * np.int64(classes.max(initial=0) + 1) + classes[at])[0].astype(np.int64)
        leaves = np.bincount(node, weight[alive])
        several = leaves[node] > 1
        alive, node, depth = alive[several], node[several], depth + n
    out = np.zeros(first[-1], bool)
    out[alive] = True
    return out, windows


_ANSWER = "shard long, places binary, low long, high long"


def covered(n: int, answers: pa.Table) -> np.ndarray:
    """Which of a shard's ``n`` words the runs cover: each from word ``low`` to ``high``, exclusive, behind all its places."""
    places = answers.column("places").to_pylist()
    times = np.fromiter((len(p) // 8 for p in places), np.int64, len(places))
    at = np.frombuffer(b"".join(places), "<i8")
    low, high = (np.repeat(answers.column(c).to_numpy(), times) for c in ("low", "high"))
    gone = np.bincount(at + low, minlength=n + 1) - np.bincount(at + high, minlength=n + 1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, ...] = PREFIXES, most: int = MOST, shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """Remove each word covered by a sequence of ``window`` words that also starts anywhere else in the texts of ``docs``.

    Words are split at ASCII white space and compared as they stand.  Returns for each row: ``doc_id, n_words,
    n_removed, n_spans, kept_sha256`` (and ``kept``, the remaining words joined by spaces, with ``with_text``).

    A null or empty text has no words; shorter texts than ``window`` are kept; repeated rows are copies of one another;
    null ids and ties need no care; an empty table gives no rows.
    """
    lengths = (*(p for p in prefixes if p < window), window)
    shards = int(max(8, planned_bytes(docs) // shard_bytes))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(shards)).cast("long").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.record_batch({"shard": b.column("shard"), "doc_id": b.column("doc_id"), "z": pa.array([press(t.as_py().encode()) for t in b.column("text")], pa.binary())})

    packed = rows.mapInArrow(pressed, "shard long, doc_id long, z binary")

    def read(table: pa.Table) -> list[str]:
        expand = zstandard.ZstdDecompressor().decompress
        return [expand(z.as_py()).decode() for z in table.column("z")]

    def ask(level: int):
        def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
            """A shard's prefixes of one length: each once, with how many stretches of windows it has, in all and distinct ones."""
            t = Texts(Counter(read(table)), window)
            t.hash()
            _, left = stretches(t, lengths, told, level)
            place, name = t.names(lengths[level], left)
            cut = _runs(place, left)
            kind, keys = pd.factorize(name[cut])
            ends = left[np.append(cut[1:], len(left))[: len(cut)] - 1]
            h = prefix_hashes(t.hashes, window)
            distinct = ~pd.Series(_mixed(_mixed(name[cut] * _MIX[1] + h[left[cut]]) * _MIX[1] + h[ends])).duplicated().to_numpy() if len(cut) else np.empty(0, bool)
            n, m = (np.bincount(kind, x, minlength=len(keys)) for x in (t.times_of(left[cut]), distinct))
            return _keys(np.asarray(keys, np.uint64), key[0].as_py(), level, n, m)

        return run

    def send(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        t = Texts(Counter(read(table)), window)
        t.hash()
        found, _ = stretches(t, lengths, told, len(lengths))
        rows = sent(t, found, lengths)
        cols = list(zip(*rows)) or [[]] * 4
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([*(pa.array(c, k) for c, k in zip(cols, types)), pa.array(np.full(len(rows), key[0].as_py()))], names=["key", "times", "places", "text", "shard"])

    def finish(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        texts = read(table)
        t = Texts(Counter(texts), window)
        gone = covered(len(t.words), told)
        by_text: dict[str, tuple] = {}
        for text, i, j in zip(t.texts, t.starts[:-1].tolist(), t.starts[1:].tolist()):
            edges = np.flatnonzero(np.diff(gone[i:j], prepend=False, append=False)).tolist()
            stays = [(a, b) for a, b in zip([i, *(i + e for e in edges[1::2])], [*(i + e for e in edges[::2]), j]) if b > a]
            kept = b" ".join([t.text(a, b) for a, b in stays])
            by_text[text] = (j - i, j - i - sum(b - a for a, b in stays), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept if with_text else None)
        rows = [(d, *by_text[x]) for d, x in zip(table.column("doc_id").to_pylist(), texts)]
        names, types = ("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept"), (pa.int64(),) * 4 + (pa.string(), pa.binary())
        cols = list(zip(*rows)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(cols, types)][: 5 + with_text], names=list(names)[: 5 + with_text])

    by = lambda df: df.groupBy("shard")
    told = docs.sparkSession.createDataFrame([], _KEYS)
    for level in range(len(lengths)):
        keys = by(packed).cogroup(by(told)).applyInArrow(ask(level), _KEYS)
        new = materialize(keys.repartition(shards, "key").mapInArrow(_told(most if lengths[level] < window else 1 << 62), _KEYS), "subtrees-prefixes")
        told = told.unionByName(new)
        if new.where("n < 0").isEmpty():
            break
    dealt = by(packed).cogroup(by(told)).applyInArrow(send, "key long, times long, places binary, text binary, shard long").repartition(shards, "key")
    answers = materialize(dealt.mapInArrow(_deepest(window), _ANSWER), "subtrees-windows")
    out = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return by(packed).cogroup(by(answers)).applyInArrow(finish, out)
