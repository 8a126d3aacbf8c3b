"""Alignment of two tokenizers by a corpus-wide table of id pairs.

Texts are cut where both tokenizers always have a token end: before a space between two other characters.  Such a
chunk is encoded once for each shard of the input, however often it stands there, and cut at the ends of all tokens of
both sides: each piece between two such ends belongs to one token of either side and is a link.

1. each task reads a partition in shards of bounded size, keeps documents as numbers of chunks and chunks as
   numbers of pairs, and counts packed pair keys (id of B in the high half, of A in the low half) with ``np.unique``;
2. partial counts are dealt by range of keys and sorted, so that one pass sums the runs of equal keys; each shard gets
   the totals of those of its pairs that other shards hold too, and the highest count of each id of B (as many
   numbers as its vocabulary) is broadcast;
3. each shard looks its pairs up in its sorted keys with ``searchsorted`` and adds up its documents.

Count shards reach a task as Arrow buffers that NumPy reads in place, not as mapped files: executors share no folder
that the operating system could map.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, task_count
from .packing import UNPRINTED, Encoder

#: Bytes of text in a shard; a longer text is one of its own.
SHARD_BYTES = 32 << 20
#: Rows of partial counts are dealt over a task for so many bytes of (compressed) input.
COUNT_BYTES = 16 << 20
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = r"[\s\v\x1c-\x1f\x{85}\pZ] | [\s\v\x1c-\x1f\x{85}\pZ]|^ | $"
_SHAPE = re.compile(f"{SPACE}*[^{SPACE}]*")


class Plain(Encoder):
    """Ids of texts in which the strings of added tokens are text like any other."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        if self.fast and (text.isascii() and not UNPRINTED.search(text) or not self.UNUSUAL.search(text)):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: printable bytes stand for themselves in a byte-level vocabulary, others from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        names = self.tokenizer.get_vocab(True)
        out = [b""] * (max(names.values(), default=0) + 1)
        for name, k in names.items():
            out[k] = name.encode() if name in self.added else bytes(of[c] for c in name)
        return out


class Aligner:
    """Both tokenizers: ``byte_path`` is a byte-level BPE of ``tokenizers``, ``piece_path`` a model of ``sentencepiece``."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self.a, self.b = Plain(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self.b.get_piece_size()
        self.bytes_a = self.a.token_bytes()
        self.bytes_b = [self._piece(k) for k in range(n)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(k).encode() for k in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        # chunks are independent where no piece goes on behind a space and nothing is normalised
        odd = "a  b c\tﬁ ① Å  \n x "
        self.cuts = all(_SHAPE.fullmatch(self.b.id_to_piece(k)) for k in range(n)) and self.joined_b(self.b.encode(odd)) == b" " + odd.encode()

    def _piece(self, k: int) -> bytes:
        name = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(name[3:5], 16)])
        return name.replace(SPACE, " ").encode()

    def joined_b(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_b[k] for k in ids])

    def chunks(self, text: str) -> list[str]:
        """The chunks of space + text, each without its leading space."""
        return _CUT.split(text) if self.cuts else [text]

    def encoded(self, chunks: list[str]) -> Encoded:
        return Encoded(self, chunks)


class Encoded:
    """The tokens of many chunks: ids in a row, and of each chunk the groups as text and whether its bytes are kept."""

    def __init__(self, of: Aligner, chunks: list[str]) -> None:
        want = [b" " + c.encode() for c in chunks]
        ids_a, ids_b = [of.a.ids(" " + c) for c in chunks], of.b.encode(chunks, num_threads=1) if chunks else []
        self.kept = np.ones(len(chunks), bool)
        if not self._fits(of, ids_a, ids_b, want):
            for k, (a, b, w) in enumerate(zip(ids_a, ids_b, want)):
                if not self._fits(of, [a], [b], [w]):
                    self.kept[k], ids_a[k], ids_b[k] = False, [], []
            self._fits(of, ids_a, ids_b, want)
        end_a, end_b = np.cumsum(of.len_a[self.a]), np.cumsum(of.len_b[self.b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        again = np.diff(ends, prepend=-1) == 0
        cuts, both = ends[~again], ends[again]
        link_a, link_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        self.keys = self.b[link_b] << 32 | self.a[link_a]
        self.chunk = np.repeat(np.arange(len(chunks)), self.n_a)[link_a]
        self.n_links = np.bincount(self.chunk, minlength=len(chunks))
        self.n_groups = self.n_a + self.n_b - self.n_links
        self.groups = self._groups(of, both, end_a, end_b)

    def _fits(self, of: Aligner, ids_a: list[list[int]], ids_b: list[list[int]], want: list[bytes]) -> bool:
        """Sets the ids; whether the tokens' bytes are those wanted, chunk by chunk."""
        self.n_a, self.n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        sizes = np.fromiter(map(len, want), np.int64, len(want))
        for ids, n, lens, data in ((self.a, self.n_a, of.len_a, of.bytes_a), (self.b, self.n_b, of.len_b, of.bytes_b)):
            if (np.bincount(np.repeat(np.arange(len(n)), n), lens[ids], len(n)) != sizes).any() or b"".join([data[k] for k in ids.tolist()]) != b"".join(want):
                return False
        return True

    def _groups(self, of: Aligner, both: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each chunk."""
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        words = [of.text_a[k] for k in self.a.tolist()] + [of.text_b[k] for k in self.b.tolist()]
        marks = np.concatenate([np.where(both[group_a] == end_a, b"|", b","), np.where(both[group_b] == end_b, b";", b",")]).tolist()
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")  # A's tokens of a group, then B's
        text = [words[k] + marks[k] for k in order.tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(text[i:j])[:-1] for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


_DOCS = "shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary, keys binary, counts binary, links binary, sizes binary"
_DOC_COLS = tuple(c.split()[0] for c in _DOCS.split(", "))
_NO_TOKENS = (0, 0, 0, 0, "", b"")
#: Chunks that are encoded at a time.
SLICE = 50_000


class _Shard:
    """Documents of one shard as they are read, and the row with its partial counts and the links of its chunks."""

    def __init__(self, of: Aligner, number: int) -> None:
        self.of, self.number, self.size = of, number, 0
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.keys, self.sizes, self.seen = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(0, np.int64)
        self.per = np.zeros((5, 0), np.int64)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text as numbers."""
        column = pa.array(texts, pa.large_string())
        # where single spaces stand between other characters only, every space is a cut
        plain = pc.invert(pc.match_substring_regex(column, _UNEVEN)).to_pylist() if self.of.cuts else [False] * len(texts)
        lists = pc.split_pattern(column.filter(pa.array(plain, pa.bool_())), " ")
        known = lists.flatten().dictionary_encode()
        index = self.index
        own = np.array([index.setdefault(c, len(index)) for c in known.dictionary.to_pylist()], np.int32)
        flat, ends = own[known.indices.to_numpy()], np.cumsum(pc.list_value_length(lists).to_numpy())
        even = iter(np.split(flat, ends[:-1]))
        return [next(even) if p else np.array([index.setdefault(c, len(index)) for c in self.of.chunks(t)], np.int32) for t, p in zip(texts, plain)]

    def read(self, docs: list[tuple[int, str]]) -> list[tuple]:
        """Rows of the documents (doc_id, text); chunks that are new are encoded."""
        known = len(self.index)
        # U+2581 stands for a space in B: such a text's bytes can't be kept
        ids = iter(self.numbers([t for _, t in docs if t and SPACE not in t]))
        fresh = list(islice(self.index, known, None))
        for k in range(0, len(fresh), SLICE):
            e = self.of.encoded(fresh[k : k + SLICE])
            self.keys.append(e.keys)
            self.sizes.append(e.n_links)
            self.groups += e.groups
            self.per = np.concatenate([self.per, [e.n_a, e.n_b, e.n_groups, e.n_links, ~e.kept]], 1)
        rows, good = [], [np.empty(0, np.int32)]
        for doc_id, text in docs:
            self.size += len(text or "")
            mine = next(ids) if text and SPACE not in text else ()
            *n, lost = self.per[:, mine].sum(1).tolist() if len(mine) else (0, 0, 0, 0, 1)
            if lost:
                rows.append((self.number, doc_id, *_NO_TOKENS))
                continue
            good.append(mine)
            sha = hashlib.sha256(b";".join([self.groups[k] for k in mine.tolist()])).hexdigest()
            rows.append((self.number, doc_id, *n, sha, mine.tobytes()))
        more = np.bincount(np.concatenate(good), minlength=len(self.index))
        more[: len(self.seen)] += self.seen
        self.seen = more
        return [(*r, None, None, None, None) for r in rows]

    def close(self) -> tuple:
        sizes = np.concatenate(self.sizes)
        keys, links = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, links, np.repeat(self.seen, sizes))
        links = links.astype("<u2" if len(keys) <= 1 << 16 else "<u4")
        return (self.number, None, 0, 0, 0, 0, None, None, keys.tobytes(), counts.tobytes(), links.tobytes(), sizes.astype("<u4").tobytes())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(),) * 6 + (pa.string(),) + (pa.binary(),) * 5
    cols = list(zip(*rows)) or [[]] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=list(_DOC_COLS))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, shard, n): the sum of each run of equal keys to each of its shards but lone ones; at last the highest sum of each id of B."""
    best: dict[int, int] = {}
    held: list[np.ndarray] = [np.empty((3, 0), np.int64)]

    def told(x: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(x[0], prepend=x[0][:1] - 1))
        total, size = np.add.reduceat(x[2], first), np.diff(np.append(first, x.shape[1]))
        b = x[0][first] >> 32
        run = np.flatnonzero(np.diff(b, prepend=-1))
        for k, n in zip(b[run].tolist(), np.maximum.reduceat(total, run).tolist()):
            best[k] = max(best.get(k, 0), n)
        several = np.repeat(size > 1, size)
        return _counts(x[1][several], x[0][several], np.repeat(total, size)[several])

    for batch in batches:
        x = np.stack([batch.column(c).to_numpy() for c in ("key", "shard", "n")])
        if not x.shape[1]:
            continue
        cut = int(np.searchsorted(x[0], x[0][-1]))  # the last run may go on
        if cut:
            yield told(np.concatenate([*held, x[:, :cut]], 1))
            held = [x[:, cut:]]
        else:
            if held[-1].shape[1] and held[-1][0, -1] != x[0, 0]:
                yield told(np.concatenate(held, 1))
                held = []
            held.append(x)
    if (rest := np.concatenate(held, 1)).shape[1]:
        yield told(rest)
    yield _counts(np.full(len(best), -1), np.fromiter(best, np.int64, len(best)), np.fromiter(best.values(), np.int64, len(best)))


def _counts(shard: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in (shard, key, n)], names=["shard", "key", "n"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, keys, counts in zip(*(b.column(c).to_pylist() for c in ("shard", "keys", "counts"))):
            k, n = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
            k, n = k[n > 0], n[n > 0]
            yield _counts(np.full(len(k), shard), k, n)


def align(docs: DataFrame, byte_path: str, piece_path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """How the tokens of two tokenizers align in each text, and how usual its links are in all texts.

    Returns for each row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  A null or empty
    text, and one whose bytes a tokenizer doesn't keep, has no tokens: zeros, and '' in place of a digest.  Repeated
    rows count as often as they stand there; null ids and ties need no care; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, task, n = aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0
        shard = _Shard(of, task << 24)
        for b in batches:
            slice_, size = [], 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                slice_.append((doc_id, text))
                size += len(text or "")
                if shard.size + size >= shard_bytes:
                    yield _rows([*shard.read(slice_), shard.close()])
                    slice_, size, n = [], 0, n + 1
                    shard = _Shard(of, task << 24 | n)
            if slice_:
                yield _rows(shard.read(slice_))
        yield _rows([shard.close()])

    def second(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table.column("keys")))
        keys, total, links, sizes = (np.frombuffer(own.column(c)[0].as_py(), t) for c, t in (("keys", np.int64), ("counts", np.int64), ("links", np.uint8), ("sizes", "<u4")))
        sizes = sizes.astype(np.int64)
        n_links = int(sizes.sum())
        links = links.view("<u2" if len(links) == 2 * n_links else "<u4")
        total = total.copy()
        total[np.searchsorted(keys, told.column("key").to_numpy())] = told.column("n").to_numpy()
        usual = total == best.value[keys >> 32]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        n_best, sums = (np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends]) for x in (usual, total))
        docs = table.filter(pc.is_valid(table.column("groups_sha256")))
        numbers = [np.frombuffer(ids.as_py(), np.int32) for ids in docs.column("chunks")]
        out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for name, x in (("n_best", n_best), ("count_sum", sums)):
            out = out.append_column(name, pa.array([int(x[ids].sum()) for ids in numbers], pa.int64()))
        return out.append_column("groups_sha256", docs.column("groups_sha256"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = materialize(rows.mapInArrow(first, _DOCS), "alignment-documents")
    partial = known.where("keys is not null").select("shard", "keys", "counts").mapInArrow(_partial, "shard long, key long, n long")
    dealt = partial.repartitionByRange(task_count(docs, COUNT_BYTES), "key").sortWithinPartitions("key")
    told = materialize(dealt.mapInArrow(_sums, "shard long, key long, n long"), "alignment-counts")
    highest = np.zeros(len(aligner(byte_path, piece_path).bytes_b), np.int64)
    for r in told.where("shard = -1").groupBy("key").agg(F.max("n").alias("n")).collect():  # the vocabulary of B at most
        highest[r.key] = r.n
    best = spark.sparkContext.broadcast(highest)
    by = lambda df: df.groupBy("shard")
    return by(known).cogroup(by(told.where("shard >= 0"))).applyInArrow(second, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
