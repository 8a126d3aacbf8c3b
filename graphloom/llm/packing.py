"""Best-fit-decreasing packing of token sequences.

Every document is tokenized once, in Arrow batches; what is packed are only the lengths.  At most
``capacity`` lengths exist, so best-fit decreasing runs on their histogram: a segment tree over remaining
capacities finds the tightest open bin, and all items of one length and all bins of one history move
together.  That gives exactly the bins of the item-by-item algorithm, for any number of documents, from
``capacity`` counts on the driver.  The resulting runs of slots (a few for each length) are broadcast; a
piece finds its slot from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024
END_ID = 2


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as ``tokenizers`` gives them for the file.

    Where the file is a byte-level BPE without normalizer whose ids follow the order of its merges, the same
    vocabulary runs in ``tiktoken``, four times as fast.  Texts beyond Latin letters and general punctuation, with
    separators that regular-expression libraries class differently or with an added token's string go to
    ``tokenizers`` itself, as do all texts for other files.
    """

    # Fixed value: the split pattern of the byte-level pre-tokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    UNUSUAL = re.compile("[\x1c-\x1f\x85\u0250-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\U0010ffff]")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast(json.loads(self.tokenizer.to_str()))

    def _fast(self, spec: dict):
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        vocab, merges = model.get("vocab"), [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        # the printable stand-ins of byte-level BPE: bytes that print stand for themselves, others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(of[c] for c in w): i for w, i in vocab.items() if w not in self.added}
        ids = [vocab[a + b] for a, b in merges]
        if ids != sorted(ids) or len(ranks) != 256 + len(ids) or any(vocab[c] > ids[0] for c in of):
            return None
        import tiktoken

        return tiktoken.Encoding("same", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast and (text.isascii() and not UNPRINTED.search(text) or not self.UNUSUAL.search(text)) and not any(a in text for a in self.added):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


UNPRINTED = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[int]:
    """Where pieces of a document of ``n`` tokens begin: the first piece may be shorter, others are full."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``task, nth``: the rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        nth = [0] * (capacity + 1)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                for k, start in enumerate(starts := cuts(n, capacity)):
                    end = starts[k + 1] if k + 1 < len(starts) else n
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), task, nth[end - start]))
                    nth[end - start] += 1
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


class TightestFit:
    """A segment tree over remaining capacities: which capacities have open bins, the least one from ``at`` up."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, remaining: int) -> None:
        k = self.size + remaining
        self.open[k] = bool(self.bins[remaining])
        while k := k >> 1:
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def add(self, remaining: int, first: int, n: int) -> None:
        """``n`` bins, numbered from ``first``, have ``remaining`` left."""
        if n and remaining:
            self.bins[remaining].append((first, n))
            self._set(remaining)

    def take(self, at: int) -> tuple[int, int, int] | None:
        """Bins (remaining, first, n) with the least remaining capacity of ``at`` or more."""
        k = self.size + at
        while not self.open[k]:
            while k & 1:
                k >>= 1
                if k <= 1:
                    return None
            k += 1
            if k & (k - 1) == 0:
                return None
        while k < self.size:
            k = 2 * k + (not self.open[2 * k])
        remaining = k - self.size
        first, n = self.bins[remaining].pop()
        self._set(remaining)
        return remaining, first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of ``counts`` items by length: runs of slots, and the number of bins.

    A run (length, first, n, bin, each, offset) places the items ``first`` .. ``first + n - 1`` of that length:
    ``each`` to a bin, from bin ``bin`` on, at ``offset`` and then one after another.
    """
    tree, runs, bins = TightestFit(capacity), [], 0
    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            remaining, first, have = tree.take(length) or (capacity, bins, -1)
            each = remaining // length
            full, rest = divmod(n - done, each)
            if have < 0:
                have = full + bool(rest)
                bins += have
            use = min(have, full)
            if use:
                runs.append((length, done, use * each, first, each, capacity - remaining))
                tree.add(remaining - each * length, first, use)
                done += use * each
            if use < have and done < n:
                runs.append((length, done, rest, first + use, rest, capacity - remaining))
                tree.add(remaining - rest * length, first + use, 1)
                done += rest
                use += 1
            tree.add(remaining, first + use, have - use)
    return runs, bins


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all ``docs`` (columns doc_id, text; others are ignored) and their places in sequences.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row for each piece.  A null or
    empty text is the end id alone; repeated rows are packed as often as they occur; an empty table gives none.
    """
    spark = docs.sparkSession
    placed = materialize(pieces(docs, path, capacity), "pieces")
    by_task = placed.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs, _ = plan(counts, capacity)
    runs_df = spark.createDataFrame(runs, "run_length long, run_first long, run_n long, run_bin long, run_each long, run_offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = placed.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    nth = F.col("rank") - F.col("run_first")
    return ranked.join(
        F.broadcast(runs_df), (F.col("length") == F.col("run_length")) & nth.between(0, F.col("run_n") - 1)  # a few runs for each of the lengths
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run_bin") + F.expr("(rank - run_first) div run_each")).alias("sequence_id"),
        (F.col("run_offset") + nth % F.col("run_each") * F.col("length")).alias("offset"),
    )
