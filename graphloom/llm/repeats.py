"""Removal of long repeated substrings by prefix-free parsing.

A hash of 16 rolling bytes triggers phrase boundaries, so equal text is cut alike wherever it stands.  A phrase runs
from one trigger to the end of the next.  In prefix-free parsing the suffixes of the corpus are ordered by the suffix
arrays of the phrase dictionary and of the parse, and a string repeats where neighbours in that order share a prefix
that long.  The order is needed only among suffixes that can be neighbours, so it is built by phrase:

1. dictionary: how often each phrase occurs in the corpus.  A window of ``length`` bytes that holds a phrase which
   occurs once occurs once; all others are candidates.
2. parse: candidates whose least phrase (by hash; rare before frequent ones) is the same meet in one task, as pieces
   of text: around that phrase the end of the phrase before, a suffix in the dictionary, and what follows in the
   parse.  Their suffixes are sorted; neighbours that share ``length`` bytes repeat.  Equal pieces are sent once by
   each shard and need no sorting.  Windows without a whole phrase, and those that hold only very frequent ones,
   would be too many for one task: they are sent one by one, as 128-bit cryptographic digests.

Phrases are counted by 64-bit hashes: a collision makes candidates, it decides nothing.  Documents are dealt over
shards by hash.  A passage that a third of all documents hold costs a shard as much as one that it holds once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, task_count

LENGTH = 400
#: Words of a passage that ``n_passages`` counts, at least.
WORDS = 51
GRAM = 16
#: Bytes between triggers on average.
GAP = 48
#: A phrase that shards report so often in all is very frequent.
FREQUENT = 256
#: Bytes of (compressed) input in a shard.
SHARD_BYTES = 8 << 20
#: Bytes whose triggers are looked for at a time.
SPAN = 1 << 22
DIGEST = 16

_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def triggers(text: bytes, gap: int) -> np.ndarray:
    """Places of the 16-byte strings whose hash falls below a limit: one in ``gap``."""
    found, limit, last = [np.empty(0, np.int64)], np.uint64((1 << 64) // gap), len(text) - GRAM + 1
    for k in range(0, last, SPAN):
        halves = np.ndarray((min(SPAN, last - k) + 8,), "<u8", text, k, (1,))
        found.append(k + np.flatnonzero(halves[:-8] * _FIRST + halves[8:] * _SECOND < limit))
    return np.concatenate(found)


_EMPTY = {kind: hashlib.blake2b(digest_size=DIGEST, person=kind) for kind in (b"window", b"windows", b"passage", b"passages")}


def digests(text: bytes, spans: Iterable[tuple[int, int]], kind: bytes) -> list[bytes]:
    """The digest of each span of a text."""
    blank, out = _EMPTY[kind].copy, []
    for a, b in spans:
        h = blank()
        h.update(text[a:b])
        out.append(h.digest())
    return out


def digest(data: bytes, kind: bytes) -> bytes:
    h = _EMPTY[kind].copy()
    h.update(data)
    return h.digest()


class Parse:
    """The phrases of one text, and its windows of ``length`` bytes and of ``words`` words by their least phrase."""

    def __init__(self, text: bytes, length: int, words: int, gap: int) -> None:
        at = triggers(text, gap)
        self.text, self.length, self.words, self.last = text, length, words, len(text) - length
        self.at, self.ends = at[:-1], at[1:] + GRAM
        self.keys = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(self.at.tolist(), self.ends.tolist())), np.uint64, len(self.ends))

    def told(self, once: np.ndarray, common: np.ndarray) -> None:
        """Which phrases occur once, and which are very frequent."""
        self.common, self.n_once = common, np.append(0, once.cumsum())
        self.least: list[np.ndarray] = []
        self.own = self.n_once[-1] == len(once)  # no phrase occurs twice

    def _rank(self) -> None:
        self.order = np.lexsort((self.keys, self.common))  # of equal phrases the first is least
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(rank))
        self.least = [rank]  # of 1, 2, 4, ... phrases

    def leading(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of the least whole phrase in each window; BARE if there is none, UNIQUE if one occurs once."""
        first, last = np.searchsorted(self.at, start), np.searchsorted(self.ends, end, "right") - 1
        out = np.where(last < first, BARE, UNIQUE)
        ask = np.flatnonzero((last >= first) & (self.n_once[np.maximum(last, -1) + 1] == self.n_once[first]))
        if len(ask):
            if not self.least:
                self._rank()
            first, last = first[ask], last[ask]
            level = np.frexp(last - first + 1)[1] - 1
            while len(self.least) <= level.max():
                half = 1 << (len(self.least) - 1)
                self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
            for k in np.flatnonzero(np.bincount(level)).tolist():
                m = level == k
                out[ask[m]] = self.order[np.minimum(self.least[k][first[m]], self.least[k][last[m] - (1 << k) + 1])]
        return out

    def _split(self, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of one leading phrase: their first and last numbers, and whether they are compared one by one."""
        cut = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])) if len(lead) else np.empty(0, np.int64)
        last = np.append(cut[1:], len(lead)) - 1
        cut, last = cut[keep := lead[cut] != UNIQUE], last[keep]
        single = lead[cut] == BARE
        single[~single] = self.common[lead[cut][~single]]
        return cut, last, single

    def windows(self) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Candidates by their first and last starts: those to compare one by one, and pieces with their leading phrases."""
        if self.last < 0 or (self.own and not self._bare()):
            return [], []
        # what a window holds changes behind the start of a phrase and where one's end comes in
        change = np.sort(np.concatenate([[0], self.at + 1, self.ends - self.length]))
        change = change[(change >= 0) & (change <= self.last) & (np.diff(change, prepend=-self.length - 1) > 0)]
        lead = self.leading(change, change + self.length)
        a, b, single = self._split(lead)
        low, high = change[a], np.append(change[1:], self.last + 1)[b] - 1
        return list(zip(low[single].tolist(), high[single].tolist())), list(zip(low[~single].tolist(), high[~single].tolist(), lead[a][~single].tolist()))

    def _bare(self) -> bool:
        """Whether some window holds no whole phrase: where one start is passed, the next phrase must still fit."""
        start = np.append(0, self.at + 1)
        end = np.append(self.ends, start[-1] + self.length + 1)
        return bool(((end - start > self.length) & (start <= self.last)).any())

    def passages(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Starts and ends of all strings of ``words`` words, and the candidates by number, as in ``windows``."""
        start, end = word_windows(self.text, self.words)
        first, last = self.at.searchsorted(start), self.ends.searchsorted(end, "right")
        if not len(start) or (self.own and (last > first).all()):
            return start, end, [], []
        # strings that hold the same phrases are asked for once
        change = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])]))
        lead = self.leading(start[change], end[change])
        a, b, single = self._split(lead)
        low, high = change[a], np.append(change[1:], len(start))[b] - 1
        return start, end, list(zip(low[single].tolist(), high[single].tolist())), list(zip(low[~single].tolist(), high[~single].tolist(), lead[a][~single].tolist()))


BARE, UNIQUE = -1, -2


def word_windows(text: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all strings of so many words."""
    x = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], (x == 32) | ((x >= 9) & (x <= 13)), [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2][: max(0, len(edges) // 2 - words + 1)], edges[1::2][words - 1 :]


#: Kinds of pieces.
WINDOWS, PASSAGES = 0, 1
SEVERAL = -1


def _piece(kind: int, text: bytes) -> bytes:
    return digest(text, b"passages" if kind else b"windows")


class _Sent:
    """What a shard sends to the parts: digests and pieces, each distinct one once, with its count and its document."""

    def __init__(self) -> None:
        self.digests: Counter[bytes] = Counter()
        self.pieces: dict[tuple[int, bytes], list[int]] = {}

    def piece(self, kind: int, key: int, doc: int, text: bytes) -> None:
        known = self.pieces.setdefault((kind, text), [key, 0, doc])
        known[1] += 1
        if known[2] != doc:
            known[2] = SEVERAL


_KEY = np.dtype([("key", "<u8"), ("n", "u1")])
_ONE = np.dtype([("digest", "<u8", 2), ("n", "u1")])
_HEAD = np.dtype([("kind", "u1"), ("key", "<u8"), ("doc", "<i8"), ("size", "<u4"), ("n", "u1")])


def _by_part(keys: np.ndarray, parts: int) -> dict[int, np.ndarray]:
    """Places of ``keys`` by the part that they go to."""
    mixed = keys * _FIRST
    part = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
    return {int(part[g[0]]): g for g in groups if len(g)}


def _capped(counts: Iterable[int]) -> np.ndarray:
    return np.minimum(np.fromiter(counts, np.int64), 255).astype("u1")


_DEALT = "part int, shard int, keys binary, ones binary, heads binary, blob binary"


def _dealt(shard: int, parts: int, keys: np.ndarray, sent: _Sent) -> pa.Table:
    ones = np.empty(len(sent.digests), _ONE)
    ones["digest"] = np.frombuffer(b"".join(sent.digests), "<u8").reshape(-1, 2)
    ones["n"] = _capped(sent.digests.values())
    texts = [t for _, t in sent.pieces]
    heads = np.array([(kind, key, doc, len(t), min(n, 255)) for (kind, t), (key, n, doc) in sent.pieces.items()], _HEAD)
    dealt = [_by_part(keys["key"], parts), _by_part(ones["digest"][:, 0], parts), _by_part(heads["key"], parts)]
    press, none = zstandard.ZstdCompressor(level=1).compress, np.empty(0, np.int64)
    rows = []
    for part in sorted({*dealt[0], *dealt[1], *dealt[2]}):
        k, o, h = (d.get(part, none) for d in dealt)
        rows.append((part, shard, keys[k].tobytes(), ones[o].tobytes(), heads[h].tobytes(), press(b"".join(texts[i] for i in h.tolist()))))
    return _table(rows, ("part", "shard", "keys", "ones", "heads", "blob"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.table([pa.array(c, pa.int32() if n in ("part", "shard") else pa.binary()) for c, n in zip(cols, names)], names=list(names))


#: What a shard is told: phrases that occur more than once and which of them are very frequent; digests that repeat;
#: digests of pieces with windows that repeat, and a bit for each window.
_TOLD = "shard int, keys binary, often binary, ones binary, pieces binary, masks binary"
_TOLD_NAMES = ("shard", "keys", "often", "ones", "pieces", "masks")


def _often(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of ``n`` over equal values, for each."""
    _, inverse = np.unique(values, return_inverse=True)
    return np.bincount(inverse, n)[inverse] if len(values) else np.empty(0)


def _counted(frequent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one part's phrases of all shards: to each shard those of its that occur more than once."""
        rows = [np.frombuffer(r.as_py(), _KEY) for r in table.column("keys")]
        n = _often(np.concatenate([np.empty(0, np.uint64), *(r["key"] for r in rows)]), np.concatenate([np.empty(0), *(r["n"] for r in rows)]))
        out, start = [], 0
        for shard, r in zip(table.column("shard").to_pylist(), rows):
            mine = n[start : start + len(r)]
            start += len(r)
            if (mine > 1).any():
                out.append((shard, r["key"][mine > 1].tobytes(), np.packbits(mine[mine > 1] >= frequent).tobytes(), b"", b"", b""))
        return _table(out, _TOLD_NAMES)

    return run


def _sorted_windows(kind: int, group: dict[bytes, list[int]], length: int, words: int) -> dict[bytes, np.ndarray]:
    """Which windows of each piece repeat (in another document, for passages): equal neighbours among the sorted suffixes."""

    def windows(t: bytes) -> list[tuple[int, int]]:
        return list(zip(*(x.tolist() for x in word_windows(t, words)))) if kind == PASSAGES else [(k, k + length) for k in range(len(t) - length + 1)]

    if len(group) == 1:  # a piece by itself, sent once, repeats nothing: its windows aren't looked at
        t, (n, doc) = next(iter(group.items()))
        twice = doc == SEVERAL if kind == PASSAGES else n > 1
        return {t: np.full(len(windows(t)), True) if twice else np.zeros(0, bool)}
    places = {t: windows(t) for t in group}
    masks = {t: np.full(len(places[t]), doc == SEVERAL if kind == PASSAGES else n > 1) for t, (n, doc) in group.items()}
    if len(group) > 1:
        suffixes = sorted((t[a:b], k, t) for t, at in places.items() for k, (a, b) in enumerate(at))
        for _, same in groupby(suffixes, itemgetter(0)):
            found = list(same)
            docs = {group[t][1] for *_, t in found}
            if len(found) > 1 and (kind == WINDOWS or len(docs) > 1 or SEVERAL in docs):
                for _, k, t in found:
                    masks[t][k] = True
    return masks


def _compared(length: int, words: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one part's windows of all shards: to each shard those of its that repeat."""
        expand = zstandard.ZstdDecompressor().decompress
        shards = table.column("shard").to_pylist()
        ones = [np.frombuffer(r.as_py(), _ONE) for r in table.column("ones")]
        pairs = np.concatenate([np.empty((0, 2), np.uint64), *(r["digest"] for r in ones)])
        n = np.concatenate([np.empty(0), *(r["n"] for r in ones)])
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        first = np.append(True, (pairs[order][1:] != pairs[order][:-1]).any(1))[: len(order)]
        twice = np.empty(len(order), bool)
        if len(order):
            twice[order] = (np.add.reduceat(n[order], np.flatnonzero(first)) > 1)[np.cumsum(first) - 1]
        groups: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        held: list[list[tuple[tuple[int, int], bytes]]] = []
        for heads, blob in zip(table.column("heads"), table.column("blob")):
            at, mine, blob = 0, [], expand(blob.as_py())
            for kind, key, doc, size, count in np.frombuffer(heads.as_py(), _HEAD).tolist():
                text = blob[at : at + size]
                at += size
                known = groups.setdefault((kind, key), {}).setdefault(text, [0, doc])
                known[0] += count
                if known[1] != doc:
                    known[1] = SEVERAL
                mine.append(((kind, key), text))
            held.append(mine)
        masks = {key: _sorted_windows(key[0], group, length, words) for key, group in groups.items()}
        out, start = [], 0
        for shard, r, mine in zip(shards, ones, held):
            repeated = r["digest"][twice[start : start + len(r)]].tobytes()
            start += len(r)
            found = [(_piece(key[0], t), np.packbits(m).tobytes()) for key, t in mine if (m := masks[key][t]).any()]
            if repeated or found:
                sizes = np.array([len(m) for _, m in found], "<u4").tobytes()
                out.append((shard, sizes, b"", repeated, b"".join(d for d, _ in found), b"".join(m for _, m in found)))
        return _table(out, _TOLD_NAMES)

    return run


class _Told:
    """What a shard was told about its phrases."""

    def __init__(self, table: pa.Table) -> None:
        keys, often = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for k, o in zip(*(table.column(c).to_pylist() for c in ("keys", "often"))):
            if o:  # in the answers about windows this column has the sizes of masks
                keys.append(np.frombuffer(k, "<u8"))
                often.append(np.unpackbits(np.frombuffer(o, np.uint8), count=len(keys[-1])).astype(bool))
        k, o = np.concatenate(keys), np.concatenate(often)
        order = np.argsort(k)
        self.keys, self.often = k[order], o[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which phrases occur once, and which are very frequent."""
        if not len(self.keys):
            return np.ones(len(keys), bool), np.zeros(len(keys), bool)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[k] == keys
        return ~known, known & self.often[k]


class _Decided:
    """What a shard was told about its windows."""

    def __init__(self, table: pa.Table) -> None:
        self.ones: set[bytes] = set()
        self.masks: dict[bytes, bytes] = {}
        for sizes, often, ones, pieces, masks in zip(*(table.column(c).to_pylist() for c in _TOLD_NAMES[1:])):
            if not often:
                self.ones.update(ones[k : k + DIGEST] for k in range(0, len(ones), DIGEST))
                at = 0
                for k, size in enumerate(np.frombuffer(sizes, "<u4").tolist()):
                    self.masks[pieces[k * DIGEST : (k + 1) * DIGEST]] = masks[at : at + size]
                    at += size


    def starts(self, kind: int, text: bytes, n: int) -> np.ndarray:
        """Which of a piece's windows repeat, by number."""
        mask = self.masks.get(_piece(kind, text))
        return np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n)) if mask else np.empty(0, np.int64)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.record_batch({"shard": b.column("shard"), "doc_id": b.column("doc_id"), "z": pa.array([press(t.as_py() or b"") for t in b.column("text")], pa.binary())})


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, gap: int = GAP, frequent: int = FREQUENT, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else in the texts of ``docs``.

    Returns for each row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages`` (and ``kept``, the remaining
    bytes, with ``with_text``).  ``n_passages`` counts the maximal stretches of words that are covered by strings of
    ``words`` words (by white space, as they stand) which another row holds too, whether or not they have ``length``
    bytes and are removed.

    A null text is an empty one; shorter texts than ``length`` are kept; repeated rows are copies of one another; null
    ids and ties need no care.  A worker needs some 40 bytes for each byte of its longest text.
    """
    shards = task_count(docs, SHARD_BYTES)
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", text), F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    packed = rows.mapInArrow(_compressed, "shard int, doc_id long, z binary")
    none = np.empty(0, _KEY)

    def texts(table: pa.Table) -> Iterator[bytes]:
        expand = zstandard.ZstdDecompressor().decompress
        for z in table.column("z"):
            yield expand(z.as_py())

    def first(key: tuple, table: pa.Table) -> pa.Table:
        found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *(Parse(t, length, words, gap).keys for t in texts(table))]), return_counts=True)
        keys = np.empty(len(found), _KEY)
        keys["key"], keys["n"] = found, np.minimum(n, 255)
        return _dealt(key[0].as_py(), shards, keys, _Sent())

    def second(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        known, sent, shard = _Told(told), _Sent(), key[0].as_py()
        for doc, t in enumerate(texts(table), shard << 32):
            p = Parse(t, length, words, gap)
            p.told(*known.of(p.keys))
            single, pieces = p.windows()
            sent.digests.update(digests(t, ((s, s + length) for a, b in single for s in range(a, b + 1)), b"window"))
            for a, b, k in pieces:
                sent.piece(WINDOWS, int(p.keys[k]), doc, t[a : b + length])
            start, end, single, pieces = p.passages()
            sent.digests.update({digest(t[start[i] : end[i]], b"passage") for a, b in single for i in range(a, b + 1)})
            for a, b, k in pieces:
                sent.piece(PASSAGES, int(p.keys[k]), doc, t[start[a] : end[b]])
        return _dealt(shard, shards, none, sent)

    def third(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        known, decided, out = _Told(told), _Decided(told), []
        for doc_id, t in zip(table.column("doc_id").to_pylist(), texts(table)):
            p = Parse(t, length, words, gap)
            p.told(*known.of(p.keys))
            single, pieces = p.windows()
            starts = [np.array([s for a, b in single for s in range(a, b + 1) if digest(t[s : s + length], b"window") in decided.ones], np.int64)]
            starts += [a + decided.starts(WINDOWS, t[a : b + length], b - a + 1) for a, b, _ in pieces]
            starts, kept, spans, removed = np.concatenate(starts), t, 0, 0
            if len(starts):
                edge = np.zeros(len(t) + 1, np.int32)
                edge[starts] += 1
                edge[starts + length] -= 1
                gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
                spans, removed = int((gone & ~np.append(False, gone[:-1])).sum()), int(gone.sum())
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            start, end, single, pieces = p.passages()
            word = [np.array([i for a, b in single for i in range(a, b + 1) if digest(t[start[i] : end[i]], b"passage") in decided.ones], np.int64)]
            word = np.sort(np.concatenate(word + [a + decided.starts(PASSAGES, t[start[a] : end[b]], b - a + 1) for a, b, _ in pieces]))
            passages = int((np.diff(word) > words).sum()) + 1 if len(word) else 0
            out.append((doc_id, len(t), removed, spans, hashlib.sha256(kept).hexdigest(), passages, kept))
        cols = list(zip(*out)) or [[]] * 7
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)][: 6 + with_text], names=names[: 6 + with_text])

    def by(df: DataFrame):
        return df.groupBy("shard")

    told = materialize(by(packed).applyInArrow(first, _DEALT).groupBy("part").applyInArrow(_counted(frequent), _TOLD), "repeats-phrases")
    sent = by(packed).cogroup(by(told)).applyInArrow(second, _DEALT)
    told = told.unionByName(materialize(sent.groupBy("part").applyInArrow(_compared(length, words), _TOLD), "repeats-windows"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + (", kept binary" if with_text else "")
    return by(packed).cogroup(by(told)).applyInArrow(third, out)
