"""Decontamination: block-max search loses no pair that brute force finds."""

import random

from oracle import both

from graphloom.llm import catalog
from graphloom.llm import decontam as D


def brute(text, items):
    w, out = D.words(text), {}
    for it in items:
        i = D.Item(*it)
        for k in range(max(1, -(-len(w) // i.stride)) if i.n_words else 0):
            q, a = i.overlap(w[k * i.stride : (k + 2) * i.stride])
            if q >= D.LEAST_OVERLAP and a >= D.LEAST_OVERLAP:
                out[i.item_id] = max(out.get(i.item_id, (0, 0)), (q, a))
    return out


def test_search_equals_brute_force(monkeypatch):
    n = 0
    for seed in range(120):
        monkeypatch.setattr(D, "CELLS", 40 if seed % 2 else 1 << 21)
        rng = random.Random(seed)
        vocabulary = [f"w{k}" for k in range(rng.choice([10, 60, 400]))]
        text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "?"]) for _ in range(n))  # noqa: B023, E731
        items = [(k, text(rng.choice([0, 1, 3, 6, 20, 40, 90]))) for k in range(rng.randint(1, 60))]
        found = D.indexes(items)
        for _ in range(8):
            parts = []
            for _ in range(rng.randint(0, 6)):
                if rng.random() < 0.5:
                    p = rng.choice(items)[1].split()
                    for _ in range(rng.choice([0, 0, 1, 2])):
                        if p:
                            p[rng.randrange(len(p))] = "zz"
                    cut = rng.choice([0, 0, 1, 2, 4])
                    parts.append(" ".join(p[cut:] if rng.random() < 0.5 else p[: len(p) - cut]))
                else:
                    parts.append(text(rng.randint(0, 60)))
            want = brute(" ".join(parts), items)
            assert {i: (q, a) for i, _, q, a in D.leaks(" ".join(parts), found)} == want
            n += len(want)
    assert n > 1000


def test_building_is_linear():
    import time

    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(20_000)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=30))) for k in range(30_000)]
    began = time.time()
    found = D.indexes(rows)
    assert sum(len(i.items) for i in found) == 30_000 and time.time() - began < 20
    assert [x[0] for x in D.leaks(rows[77][1], found)] == [77]


def test_question_and_answer():
    assert D.question_answer("What is it? A cat.") == (["what", "is", "it"], ["a", "cat"])
    assert D.question_answer("Only one sentence") == (["only", "one", "sentence"], [])
    assert D.question_answer("?! Yes") == (["yes"], []) and D.question_answer(None) == ([], [])


def test_matches_sql(spark):
    name = "op3_benchmark_decontamination"
    ours, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    assert ours == theirs and ours


def test_blocks_of_items_give_the_same(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").cache()
    one, many = D.contaminated(docs, bench), D.contaminated(docs, bench, index_bytes=1000)
    assert sorted(map(tuple, one.select("doc_id", "item_id").collect())) == sorted(map(tuple, many.select("doc_id", "item_id").collect()))
    kept = D.keep_clean(docs, bench, index_bytes=1000)
    assert kept.columns == docs.columns and kept.count() == docs.count() - one.select("doc_id").distinct().count()


def test_awkward_input(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "the cat and the dog"), (2, None), (3, ""), (None, "x"), (4, "one two"), (4, "one two")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.contaminated(awkward, bench).collect())
    assert got == [(5, 4), (6, 1)]
    assert D.contaminated(awkward, bench.limit(0)).count() == 0 and D.keep_clean(awkward, bench.limit(0)).count() == awkward.count()
    assert D.contaminated(nothing, bench).count() == 0
    assert D.keep_clean(awkward, bench).columns == awkward.columns
