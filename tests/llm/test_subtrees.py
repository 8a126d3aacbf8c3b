"""Removal of repeated word sequences against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import subtrees as S


def brute(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = Counter()
    for (doc_id, _), w in zip(docs, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id, len(w), sum(gone), spans, hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    return out


def check(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in S.remove_repeats(df, **how).collect()) == brute(docs, how.get("window", S.WINDOW))


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_with_shared_parts(spark, seed):
    """Also where groups grow too large, so that longer prefixes name them."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé\xa0", k=rng.randint(1, 3))) for _ in range(rng.choice([2, 8, 60]))]
    text = lambda n: rng.choice([" ", "\n", "  \t"]).join(rng.choices(words, k=n))
    pool = [text(rng.randint(5, 60)) for _ in range(12)] + ["x " * 60, "x y " * 40]
    docs = [(k, " ".join(rng.choice(pool) if rng.random() < 0.6 else text(rng.randint(1, 25)) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, "x " * 700), (104, text(100)[:399]), (105, docs[3][1]), (105, docs[3][1]), (None, " \n\t ")]
    check(spark, docs, window=rng.choice([3, 9, 12, 20, 35]), prefixes=rng.choice([(8, 16), (2,), (), (1, 3, 8)]), most=rng.choice([1, 2, 20_000]))


def test_whole_table(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows)
    check(spark, rows, most=1)


def test_order_of_rows_changes_nothing(spark, docs):
    both = [sorted(map(tuple, S.remove_repeats(df, shard_bytes=n).collect())) for df, n in ((docs, 1 << 23), (docs.repartition(7, F.rand(3)), 20_000))]
    assert both[0] == both[1]


def test_deep_windows_are_those_that_repeat():
    rng = random.Random(1)
    texts = sorted({" ".join(rng.choices("ab", k=rng.randint(12, 30))) for _ in range(80)})
    count = Counter(tuple(t.split()[k : k + 12]) for t in texts for k in range(len(t.split()) - 11))
    flat, windows = S.deep_windows(pa.chunked_array([texts], pa.large_string()), np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64), 12)
    assert windows.tolist() == [len(t.split()) - 11 for t in texts]
    got = np.split(flat, np.cumsum(windows)[:-1])
    runs = [(k, a, b) for k, m in enumerate(got) for a in range(len(m)) if m[a] and (a == 0 or not m[a - 1]) for b in [next(i for i in range(a, len(m)) if i + 1 == len(m) or not m[i + 1])]]
    assert list(zip(*(x.tolist() for x in S.runs_of(flat, windows)))) == runs
    assert [m.tolist() for m in got] == [[count[tuple(t.split()[k : k + 12])] > 1 for k in range(len(t.split()) - 11)] for t in texts]


def test_least_and_prefixes():
    x = np.array([5, 3, 3, 9, 1, 7], np.uint64)
    assert S.least_in(x, 3).tolist() == [1, 1, 4, 4] and S.least_in(x, 1).tolist() == list(range(6)) and not len(S.least_in(x, 7))
    h = S.prefix_hashes(np.array([4, 5, 6, 4, 5, 6, 7], np.uint64), 3)
    assert len(h) == 5 and h[0] == h[3] and len({*h.tolist()}) == 4


def test_awkward_input(spark, awkward, nothing):
    rows = S.remove_repeats(awkward).collect()
    assert Counter(tuple(r) for r in rows) == brute([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], S.WINDOW)
    assert S.remove_repeats(nothing).count() == 0
    assert S.remove_repeats(awkward, with_text=True).where("doc_id = 4").first().kept == b"one"
