"""Range questions and degree peers against plain forms."""

import math
import random
import statistics

from graphloom.operators import matching, ranges


def test_counts_and_order_statistics(spark):
    rng = random.Random(5)
    for n in (1, 2, 70, 300):
        v = rng.sample(range(n), n)
        points = spark.createDataFrame(list(enumerate(v)), "pos long, v long").cache()
        asked = []
        for _ in range(25):
            a, b = sorted(rng.choices(range(n), k=2))
            asked.append((a, b, rng.randint(0, n - 1), rng.randint(0, b - a)))
        df = spark.createDataFrame(asked + asked[:3], "first long, last long, v long, k long")
        below = {(r.first, r.last, r.v): r.below for r in ranges.count_below(points, df, n).select(*[c for c in ("first", "last", "v", "below")]).toPandas().itertuples(index=False)}
        assert below == {(a, b, x): sum(y < x for y in v[a : b + 1]) for a, b, x, _ in asked}
        got = {(r.first, r.last, r.k): r.v for r in ranges.kth(points, df, n).toPandas().itertuples(index=False)}
        assert got == {(a, b, k): sorted(v[a : b + 1])[k] for a, b, _, k in asked}


def test_window_counts(spark):
    rng = random.Random(6)
    left = [(k, rng.choice([0, 1, 9, 10, 11, 50, 90, 100, 110, 7000, None])) for k in range(60)]
    right = [(k, rng.choice([0, 1, 9, 10, 11, 55, 90, 99, 100, 110, None])) for k in range(200)]
    got = ranges.window_counts(spark.createDataFrame(left, "id long, degree long"), spark.createDataFrame(right, "other long, other_degree long"))
    want = {}
    for i, d in left:
        inside = [x for _, x in right if d is not None and x is not None and (1 - 0.1) * d <= x <= (1 + 0.1) * d]
        if inside:
            want[i] = (len(inside), min(inside), max(inside))
    assert {r.id: (r.n, r.lo, r.hi) for r in got.collect()} == want
    none = spark.createDataFrame([], "id long, degree long")
    assert ranges.window_counts(none, spark.createDataFrame(right, "other long, other_degree long")).count() == 0


def plain_exceedance(pop, subjects):
    order = sorted((math.log10(d + 1.0), i) for i, d, v in pop if d is not None and v is not None)
    value, at = {i: v for i, _, v in pop}, {i: k for k, (_, i) in enumerate(order)}
    out = {}
    for i in set(subjects) & at.keys():
        ld = order[at[i]][0]
        near = [o for x, o in order if abs(x - ld) <= matching.LOG_WINDOW + 1e-12 and o != i] or [o for _, o in order[max(0, at[i] - 50) : at[i] + 50] if o != i]
        if near:
            v = [value[o] for o in near]
            out[i] = (len(v), round(sum(x >= value[i] for x in v) / len(v), 9), round(statistics.median(v), 9))
    return out


def test_every_node_against_its_peers(spark):
    rng = random.Random(7)
    # ties in degree and value, a third of all rows with one degree, far-off degrees that fall back, nulls
    pop = [(k, rng.choice([1, 1, 2, 3, rng.randint(1, 400)]), rng.choice([0.0, 0.0, 0.5, rng.random()])) for k in range(400)]
    pop += [(1000, 10**6, 0.2), (1001, 10**9, 0.9), (1002, None, 0.1), (1003, 5, None)]
    df = spark.createDataFrame(pop, "id long, degree long, value double")
    got = {r.id: (r.peer_pool_n, round(r.emp_p, 9), round(r.peer_median, 9)) for r in matching.peer_exceedance(df, df).collect()}
    assert got == plain_exceedance(pop, [p[0] for p in pop])
    few = spark.createDataFrame([(3,), (3,), (1001,), (-5,)], "id long")
    assert {r.id: r.peer_pool_n for r in matching.peer_exceedance(df, few).collect()} == {i: x[0] for i, x in plain_exceedance(pop, [3, 1001]).items()}
    assert matching.peer_exceedance(df.limit(0), df).count() == 0 and matching.peer_exceedance(df.where("id = 1"), df).count() == 0
    drawn = {r.id: r.emp_p for r in matching.monte_carlo_exceedance(df, df, draws=400).collect()}
    assert drawn.keys() == got.keys() and all(abs(drawn[i] - p) <= 5 * math.sqrt(p * (1 - p) / 400) + 1e-9 for i, (_, p, _) in got.items())
