"""Nearest neighbours: recall and exact scores against brute force."""

import numpy as np

from graphloom.llm import ann as A


def brute(rows, every=50, k=5):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    n = np.sqrt((x * x).sum(1))
    for j in np.flatnonzero(ids % every == 0):
        s = (x * x[j]).sum(1) / (n * n[j])
        ok = ids != ids[j]
        order = np.lexsort((ids[ok], -s[ok]))[:k]
        yield int(ids[j]), ids[ok][order].tolist(), s[ok][order].tolist()


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in A.neighbours(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    score = {}
    hit = total = 0
    x = {i: np.array(v, np.float64) for i, v in rows}
    for q, ids, _ in brute(rows):
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (-m[1], m[0]))
        for _, i, s in mine:
            score = float((x[q] * x[i]).sum() / (np.sqrt((x[q] ** 2).sum()) * np.sqrt((x[i] ** 2).sum())))
            assert abs(score - s) < 1e-12
        hit, total = hit + len({m[1] for m in mine} & {*ids}), total + 5
    assert hit / total >= 0.9


def test_copies_and_ties_are_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8)).round(1)
    rows = [(k, base[k % 30 if k % 3 else 0].tolist()) for k in range(600)]  # a third are copies of one vector
    got = {}
    for r in A.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, ids, _ in brute(rows):
        assert [i for _, i in sorted(got[q])] == ids


def test_awkward_input(spark):
    rows = [(0, [1.0, 0.0], "x"), (50, [1.0, 0.0], "x"), (3, [2.0, 0.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [float("nan"), 1.0], "x"), (100, [0.0, 1.0], "x"), (7, [1.0], "x"), (None, [1.0, 1.0], "x"), (8, [None, 1.0], "x"), (150, None, "x"), (9, [float("inf"), 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class string")
    got = sorted(tuple(r) for r in A.neighbours(df).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 50, 1.0), (0, 3, 100, 0.0), (50, 1, 0, 1.0), (50, 2, 3, 1.0), (50, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 3, 0.0), (100, 3, 50, 0.0)]
    assert A.neighbours(df.limit(0)).count() == 0
    assert A.neighbours(df.where("vec_id = 0")).count() == 0


def test_split_cells_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(400)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, A.neighbours(df).collect()))
    monkeypatch.setattr(A, "PART_ROWS", 5)
    monkeypatch.setattr(A, "PART_QUERIES", 1)
    split = sorted(map(tuple, A.neighbours(df).collect()))
    assert sum(a == b for a, b in zip(whole, split)) >= 0.95 * len(whole) and len(whole) == len(split)


def test_repeated_queries_and_ids_with_several_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(1, 50)]
    once = [(0, rng.normal(size=6).tolist()), (50, rng.normal(size=6).tolist())]
    close = [(100, (np.array(rows[0][1]) + 1e-4 * j).tolist()) for j in range(12)]
    want = {(q, tuple(ids)) for q, ids, _ in brute(rows + once + close)}
    times = {0: 7, 50: 1, 100: 1}
    # a row that is there seven times, an id with twelve vectors, and a neighbour that is there three times
    df = spark.createDataFrame(rows + rows[3:4] * 2 + [r for r in once for _ in range(times[r[0]])] + close, "vec_id long, embedding array<double>")
    got = A.neighbours(df).collect()
    for q, ids in want:
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 5 * (12 if q == 100 else times[q]) and all(r.vec_id != q for r in mine)
        if q != 100:
            assert [r.vec_id for r in sorted(mine, key=lambda r: r["rank"])][:: times[q]] == list(ids)


def test_huge_and_tiny_numbers(spark):
    rows = [(0, [1e200, 1e200]), (50, [1e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [5e-324, 0.0])]
    got = {}
    for r in A.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    near = 3 / 10**0.5
    for q, want in ((0, {3: 1, 4: 1, 50: near, 5: 0.5**0.5}), (50, {0: near, 3: near, 4: near, 5: 0.2**0.5})):
        assert got[q].keys() == want.keys() and all(abs(got[q][i] - s) < 1e-15 for i, s in want.items())


def test_probes_stay_below_half_of_the_cells():
    """On vectors without any structure, which is the worst there is."""
    rng = np.random.default_rng(5)
    x = A.unit(rng.normal(size=(20_000, 64)))
    m = A.fit(x[: A.SAMPLE], int(A.CELLS * len(x) ** 0.5), len(x))
    assert m.probes < 0.47 * len(m.coarse)
    cell = A.nearest(x, m.coarse)[0]
    codes, bias = m.encode(x, cell)
    hit = reranked = 0
    for j in range(0, 20_000, 400):
        true = {*np.argsort(-(x @ x[j]), kind="stable")[1:6].tolist()}
        order, gap = m.cells(x[j : j + 1])
        found = set()
        for c, g in zip(order[0, : m.probes].tolist(), gap[0]):
            here = np.flatnonzero(cell == c)
            d = m.distances(x[j : j + 1], np.array([g]), codes[here], bias[here])[0]
            found |= {*here[d <= m.limits(x[j : j + 1], 5)[0]].tolist()}
        hit, reranked = hit + len(found & true), reranked + len(found)
    assert hit >= 0.9 * 250 and reranked < 50 * 0.05 * 20_000
