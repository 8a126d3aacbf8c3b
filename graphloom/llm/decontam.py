"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND, and overlap checks.

Every training passage (overlapping windows of words over whole texts) is a query.  An item's threshold is the
least score that a passage which passes the check below can have: the item's score for itself less its largest
impacts, as many as words may be missing.  So retrieval loses no pair.  The index is searched by the bounds of
block-max WAND, for all passages of a text at once in arrays and not by a cursor: a bound from the largest impact of each term skips most passages, bounds from the largest impact in each
block of items skip most blocks, and only what is left is scored.

The index is broadcast; items are taken in blocks of bounded size (of their text, measured), one after another, so
that its size has a bound for any benchmark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
LEAST_OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Items of a block share their bounds.
BLOCK_ITEMS = 8
#: Bytes of benchmark text in one broadcast index, which is several times as large.
INDEX_BYTES = 16 << 20
#: Scores (passages times items) that are held at a time.
CELLS = 1 << 21
#: Words of a shortest passage's stride.
LEAST_STRIDE = 32

WORD = re.compile(r"[^\W_]+")
ANSWER = re.compile(r"^(.*[.?!])\s+(\S.*)$", re.S)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words up to the last sentence, and those of the last sentence; a single sentence is a question without answer."""
    m = ANSWER.match(text or "")
    q, a = (words(m[1]), words(m[2])) if m else (words(text), [])
    return (q, a) if q else (a, [])


def shingles(w: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


class Item:
    """A test item; what the overlap check needs is made of its words when it is first asked for, so little is shipped."""

    def __init__(self, item_id: int, text: str | None) -> None:
        self.item_id = item_id
        question, answer = question_answer(text)
        self.question, self.answer = " ".join(question), " ".join(answer)
        self.n = min(SHINGLE, len(question))
        distinct = len(shingles(question, self.n)) if question else 0
        self.missing = int((1 - LEAST_OVERLAP) * distinct) + int((1 - LEAST_OVERLAP) * len({*answer})) + SHINGLE
        self.n_words = len(question) + len(answer)
        self.stride = max(LEAST_STRIDE, 1 << (self.n_words - 1).bit_length()) if self.n_words else 0

    @cached_property
    def shingles(self) -> set[tuple[str, ...]]:
        return shingles(self.question.split(), self.n)

    @cached_property
    def answer_words(self) -> set[str]:
        return {*self.answer.split()}

    @property
    def words(self) -> list[str]:
        return self.question.split() + self.answer.split()

    def overlap(self, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's word shingles and of the answer's words that the passage holds."""
        found = len(self.shingles & shingles(passage, self.n)) / len(self.shingles)
        return found, len(self.answer_words.intersection(passage)) / len(self.answer_words) if self.answer_words else 1.0


class Index:
    """Postings of items whose passages have one length, with bounds of terms and of blocks of items; built by sorting."""

    def __init__(self, items: list[Item], stride: int) -> None:
        self.stride, self.terms = stride, {}
        counts = [Counter(i.words) for i in items]
        term = np.array([self.terms.setdefault(t, len(self.terms)) for c in counts for t in c], np.int64)
        tf = np.array([n for c in counts for n in c.values()], np.float64)
        sizes = np.array([len(c) for c in counts])
        item, length = np.repeat(np.arange(len(items)), sizes), np.array([i.n_words for i in items], np.float64)
        held = np.bincount(term, minlength=len(self.terms))
        idf = np.log(1 + (len(items) - held + 0.5) / (held + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / length.mean()))
        cuts = np.split(impact, np.cumsum(sizes)[:-1])
        least = np.array([max(np.sort(x)[: max(1, len(x) - i.missing)].sum(), 1e-9) * (1 - 1e-9) for i, x in zip(items, cuts)])
        order = np.lexsort(([i.item_id for i in items], least))  # like thresholds share a block
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.items, self.least = [items[k] for k in order.tolist()], least[order]
        self.block_least = self.least[::BLOCK_ITEMS]
        by = np.lexsort((place[item], term))
        term, self.item, self.impact = term[by], place[item][by], impact[by]
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1])
        block = self.item // BLOCK_ITEMS
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        self.block, self.block_impact = block[first], np.maximum.reduceat(self.impact, first)
        self.block_start = np.searchsorted(term[first], np.arange(len(self.terms) + 1))

    @staticmethod
    def _postings(start: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all postings of ``terms``, and whose they are."""
        n = start[terms + 1] - start[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        return np.arange(n.sum()) + (start[terms] - np.cumsum(n) + n)[owner], owner

    def search(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item by position, score) wherever a passage scores at or above the item's threshold.

        ``ids`` are a text's terms, -1 for words of no item; passage k holds words k * stride up to (k + 2) * stride.
        """
        at = np.flatnonzero(ids >= 0)
        t = ids[at]
        before = np.full(len(at), -1, np.int64)
        order = np.argsort(t, kind="stable")
        same = t[order][1:] == t[order][:-1]
        before[order[1:][same]] = at[order[:-1][same]]
        k = at // self.stride
        # a term counts where it is new to the passage that begins with its stride, and to the one before
        first, second = before < k * self.stride, (k > 0) & (before < (k - 1) * self.stride)
        passage, term = np.concatenate([k[first], k[second] - 1]), np.concatenate([t[first], t[second]])
        n = -(-len(ids) // self.stride)
        kept = np.bincount(passage, self.most[term], n) >= self.block_least[0]
        passage, term = self._of(kept, passage), term[kept[passage]]
        if not len(term):
            return []
        numbers, blocks = np.flatnonzero(kept), len(self.block_least)
        p, owner = self._postings(self.block_start, term)
        bound = np.bincount(passage[owner] * blocks + self.block[p], self.block_impact[p], len(numbers) * blocks).reshape(-1, blocks)
        alive = bound >= self.block_least
        kept = alive.any(1)
        if not kept.any():
            return []
        numbers, alive = numbers[kept], alive[kept]
        passage, term = self._of(kept, passage), term[kept[passage]]
        p, owner = self._postings(self.start, term)
        owner = passage[owner]
        here = alive[owner, self.item[p] // BLOCK_ITEMS]
        p, owner, items = p[here], owner[here], len(self.items)
        score = np.bincount(owner * items + self.item[p], self.impact[p], len(numbers) * items).reshape(-1, items)
        rows, cols = np.nonzero(score >= self.least)
        return list(zip(numbers[rows].tolist(), cols.tolist(), score[rows, cols].tolist()))

    @staticmethod
    def _of(kept: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Passages that are kept, numbered anew."""
        return (np.cumsum(kept) - 1)[passage[kept[passage]]]


def indexes(rows: list[tuple[int, str | None]]) -> list[Index]:
    items = [i for r in rows if (i := Item(*r)).n_words]
    return [Index([i for i in items if i.stride == s], s) for s in sorted({i.stride for i in items})]


def leaks(text: str | None, found: list[Index]) -> list[tuple[int, float, float, float]]:
    """(item_id, BM25 score, question overlap, answer overlap) of each item that a passage of the text holds: its best passage."""
    w, best = words(text), {}
    for index in found:
        ids = np.fromiter(map(index.terms.get, w, repeat(-1)), np.int64, len(w))
        step = max(1, CELLS // len(index.items))  # passages at a time
        for start in range(0, len(w), step * index.stride):
            for k, item, score in index.search(ids[start : start + (step + 1) * index.stride]):
                at = start + k * index.stride
                if k == step:
                    continue  # comes whole with the next passages
                q, a = index.items[item].overlap(w[at : at + 2 * index.stride])
                if q >= LEAST_OVERLAP and a >= LEAST_OVERLAP:
                    key = index.items[item].item_id
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (q, a, score))
    return [(i, s, q, a) for i, (q, a, s) in sorted(best.items())]


def _blocks(benchmark: DataFrame, index_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of all items, each of ``index_bytes`` of text or so."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]  # measured, not what files have
    blocks = max(1, -(-size // index_bytes))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # index_bytes, about
        yield benchmark.sparkSession.sparkContext.broadcast(indexes([(r.item_id, r.text) for r in mine]))


def contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of the documents that hold a test item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.  An item counts where
    one passage holds 0.8 or more of its question's distinct five-word shingles and of its answer's distinct words.
    Null and wordless texts hold nothing; items without words or without item_id are not looked for; repeated
    documents give their rows each, repeated items one row with the best overlap.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def searched(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")) for x in leaks(t.as_py(), shared.value)]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.float64()] * 3))], names=names)

        return rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, map(searched, _blocks(benchmark, index_bytes)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns unchanged; see ``contaminated``."""

    def clean(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not leaks(t.as_py(), shared.value) for t in b.column("text")], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    return reduce(clean, _blocks(benchmark, index_bytes), docs)
