"""Texts with similar sets of shingles: links against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import resemblance as R
from graphloom.llm import simhash as S


def jaccard(a, b):
    five = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    return len(five(a) & five(b)) / len(five(a) | five(b))


def components(n, linked):
    up = [*range(n)]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in linked:
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("star, block", [(4096, 1 << 20), (3, 200)])
def test_chains_of_similar_texts(spark, monkeypatch, star, block):
    """Each text differs from the one before in a few words, so that ends of a chain aren't similar; tasks of any size."""
    monkeypatch.setattr(R, "STAR", star)
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(90)]
        for _ in range(14):
            texts.append(" ".join(words))
            for at in rng.sample(range(90), rng.choice([1, 1, 2, 5])):
                words[at] = f"x{rng.randrange(3000)}"
    rng.shuffle(texts)
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    names = df.select(R.name(F.col("text")).alias("node"), F.col("node").alias("fp"))
    found = [(r.a, r.b) for r in R.links(df, names).collect()]
    assert set(found) <= {*similar, *((j, i) for i, j in similar)}
    assert components(len(texts), found) == components(len(texts), similar)


def test_verified_connects_all_similar_sets():
    rng = np.random.default_rng(1)
    base = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(100, 200, 40), base).astype(np.uint64)) for _ in range(60)]
    similar = [(x, y) for x in range(60) for y in range(x) if R.similar(sets[x], sets[y])]
    roots = [x if x % 3 else 0 for x in range(60)]
    seeded = [(0, x) for x in range(0, 60, 3)]
    assert components(60, seeded + R.verified(roots, sets)) == components(60, seeded + similar)


def test_near_copies_go_that_differ_in_many_bits(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts.append(" ".join(words))
        for k in (1, 2, 3, 8):  # words replaced
            other = words[:]
            for at in rng.sample(range(120), k):
                other[at] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(other))
    up = [*range(len(texts))]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            near = (S.fingerprint(texts[i].encode()) ^ S.fingerprint(texts[j].encode())).bit_count() <= 3
            alike = jaccard(texts[i], texts[j]) >= 0.8
            wide += alike and not near
            if near or alike:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert wide > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in S.keep_one_of_each(df, resembling=True).collect()} == {root(k) for k in up}


def test_awkward_input(spark, awkward, nothing):
    kept = S.keep_one_of_each(awkward, resembling=True)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 9, 10]
    assert S.keep_one_of_each(nothing, resembling=True).count() == 0
    assert R.bands(R.shingles(None)) == []
