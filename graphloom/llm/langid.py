"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, letters are kept and each run of other characters becomes one space.  Character
1- to 3-grams are hashed to ``DIM`` features, weighted by relative frequency and inverse document frequency.
The document frequencies cover every training text (summed in a tree, DIM numbers per task).  Weights are
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample, and a temperature is
then fitted on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, task_count, unsigned_crc

DIM = 1 << 16
UNDETERMINED = "und"
#: Documents of each language that the weights and the temperature are fitted on, at most.
SAMPLE_PER_LANG = 600
#: Languages, at most: the weights are DIM numbers for each.
MOST_LANGS = 512
#: Characters that are turned into features at a time.
SPAN = 1 << 22
#: Tasks that sum document frequencies, level by level; the driver sums what the last level has.
LEVELS = (256, 16)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(16)


def grams(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams of a whole text, repeats included; empty if it has no letters."""
    out, tail = [], np.array([32], np.uint32)
    letters = _letters()
    for at in range(0, len(text or ""), SPAN):
        c = np.frombuffer(text[at : at + SPAN].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters[c]
        before = np.concatenate([[tail[-1] != 32], is_letter[:-1]])
        c = np.concatenate([tail, np.where(is_letter, c, np.uint32(32))[is_letter | before]])
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] + c[1:] * np.uint32(0xC2B2AE3D)
        three = two[:-1] + c[2:] * np.uint32(0x27D4EB2F)
        new = len(tail)  # n-grams that end in the tail are counted already
        out += [_mix(one[new:]), _mix(two[max(new - 1, 0) :] + np.uint32(1)), _mix(three[max(new - 2, 0) :] + np.uint32(2))]
        tail = c[-2:]
    h = np.concatenate(out) if out else np.empty(0, np.uint32)
    return h if len(h) and _has_letters(text) else h[:0]


def _has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """langs: sorted labels; weights: (DIM + 1, languages), the last row the bias, idf included; temperature."""

    langs: tuple[str, ...]
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        h = grams(text)
        if not len(h) or not self.langs:
            return UNDETERMINED, 0.0
        logits = self.weights[h].sum(0, dtype=np.float64) / len(h) + self.weights[DIM]
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIM + 1, np.int64), 0
    for b in batches:
        for t in b.column("text"):
            seen = np.zeros(DIM, bool)
            seen[grams(t.as_py())] = True
            total[:DIM] += seen
            n += 1
    total[DIM] = n
    if n:
        yield _packed(total)


def _packed(total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"slot": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([zlib.compress(total.tobytes(), 1)])})


def _unpacked(values) -> np.ndarray:
    return sum((np.frombuffer(zlib.decompress(v), np.int64) for v in values), np.zeros(DIM + 1, np.int64))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, some = np.zeros(DIM + 1, np.int64), False
    for b in batches:
        total, some = total + _unpacked(b.column("n").to_pylist()), some or b.num_rows > 0
    if some:
        yield _packed(total)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of all ``texts`` each feature occurs; last, their number.  Zeros for an empty table."""
    rows, most = texts.select("text").mapInArrow(_frequencies, "slot int, n binary"), task_count(texts)
    for n in LEVELS:
        rows = rows.repartition(min(n, most), "slot").mapInArrow(_summed, "slot int, n binary")
    return _unpacked(bytes(r.n) for r in rows.collect())  # as many rows of a fixed size as the last level has tasks


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [np.unique(grams(t.as_py()), return_counts=True) for t in b.column("text")]
        yield pa.record_batch(
            [b.column("lang"), b.column("pick"), pa.array([i.tolist() for i, _ in found], pa.list_(pa.int32())), pa.array([(n / max(1, n.sum())).tolist() for _, n in found], pa.list_(pa.float32()))],
            names=["lang", "pick", "at", "tf"],
        )


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Follow-the-(proximally-)regularised-leader, per coordinate, over (features, values, class)."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            w, root = weights(z[at], n[at]), np.sqrt(n[at])
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(log_t))[np.arange(len(y)), y], 1e-300)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from text and non-null lang of the training rows: those whose crc32(doc_id as text) mod 3 is not 1.

    Of each language a sample of ``sample_per_lang`` texts at most is learned from; repeated rows are one.  More
    than MOST_LANGS languages are an error.  Without training rows the model knows no language.
    """
    train = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = train.where((unsigned_crc(F.col("doc_id")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df = document_frequencies(train)
    if not df[DIM]:
        return Model((), np.zeros((DIM + 1, 0), np.float32), 1.0)
    idf = np.append(np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1, 1.0)
    # the first of each language in hash order; those that can't be among them go before anything is shuffled
    counts = materialize(train.groupBy("lang").agg(F.count("*").alias("of")), "langid-counts")
    if (n := counts.count()) > MOST_LANGS:
        raise ValueError(f"{n} distinct values of lang: more than {MOST_LANGS}")
    drawn = F.pmod(F.col("hash"), F.lit(1 << 40)) / float(1 << 40) * F.col("of")
    few = train.withColumn("hash", F.xxhash64("doc_id", "text")).join(F.broadcast(counts), "lang").where(drawn < 2 * sample_per_lang + 100).dropDuplicates(["lang", "hash"])
    few = few.withColumn("pick", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("pick") <= sample_per_lang)
    found = few.select("lang", "pick", "text").mapInArrow(_features, "lang string, pick int, at array<int>, tf array<float>").toArrow()  # bounded by the sample
    lang, pick = found.column("lang").to_pylist(), found.column("pick").to_pylist()
    langs = tuple(sorted({*lang}))
    rows: dict[bool, list] = {False: [], True: []}
    for k in sorted(range(len(lang)), key=lambda k: (pick[k], lang[k])):
        at = np.array(found.column("at")[k].values, np.int64)
        x = np.append(np.array(found.column("tf")[k].values, np.float64) * SCALE * idf[at], 1.0)
        if len(at):
            rows[pick[k] % 5 == 0].append((np.append(at, DIM), x, langs.index(lang[k])))
    w = fit_weights(rows[False], len(langs))
    logits = np.array([x @ w[at] for at, x, _ in rows[True]]).reshape(-1, len(langs))
    t = fit_temperature(logits, np.array([y for *_, y in rows[True]], int))
    w[:DIM] *= SCALE * idf[:DIM, None]
    return Model(langs, w.astype(np.float32), t)


#: Relative frequencies are small numbers; this brings them near one.
SCALE = 20.0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``docs``, from the text alone.

    Null texts and texts without letters are ``und`` with score 0, as is every text if nothing could be learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column("text")]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(unsigned_crc(F.col("doc_id")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is determined with ``least_score`` or more, all columns unchanged.

    The model is fitted on ``docs`` itself.  Null texts and texts without letters go; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_py()) for t in b.column("text")]
            yield b.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the training rows of ``docs`` (doc_id, text, lang; other columns are ignored) and predict all rows."""
    return predict(docs, fit(docs))
