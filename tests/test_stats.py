"""Closed forms of statistics, matching, manifests and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import ordered
from graphloom.operators import enrichment, jobs, matching, selection, stats
from graphloom.streaming import events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ordered(spark):
    df = frame(spark, [(k, k % 7) for k in range(100)], "id long, v long").repartition(5)
    assert sorted((r.rank, r.id) for r in ordered.global_rank(df, [F.col("id").desc()]).collect()) == [(k + 1, 99 - k) for k in range(100)]
    got = {r.id: r.before for r in ordered.prefix_sums(df, [F.col("id").asc()], F.col("v")).collect()}
    assert all(got[k] == sum(j % 7 for j in range(k)) for k in got)
    ranks = ordered.average_rank(frame(spark, [(3.0,), (1.0,), (3.0,), (None,)], "v double"), "v").collect()
    assert sorted((r.v, r["rank"]) for r in ranks if r.v is not None) == [(1.0, 1.0), (3.0, 2.5), (3.0, 2.5)]
    assert [r["rank"] for r in ranks if r.v is None] == [None]


def test_rank_statistics(spark):
    df = frame(spark, [(True, 3.0), (True, 1.0), (False, 2.0), (False, 1.0), (None, 9.0)], "g boolean, v double")
    assert tuple(stats.cliffs_delta(df, F.col("g"), "v").first()) == (2, 2, 2.5, 0.25)
    pairs = frame(spark, [(5.0, 1.0), (1.0, 2.0), (3.0, 3.0), (4.0, 2.0)], "x double, y double")
    assert tuple(stats.wilcoxon(pairs, "x", "y").first()) == (3, 5.0, 1.0, 1.0, 0)
    assert stats.wilcoxon_p(10, 27.5, 0) == pytest.approx(1.0) and stats.wilcoxon_p(0, 0, 0) == 1.0
    assert stats.spearman(frame(spark, [(1.0, 1.0), (2.0, 8.0), (3.0, 9.0)], "x double, y double"), "x", "y").first().rho == pytest.approx(1)


def test_regression_and_tests(spark):
    rows = [(float(k), float(k % 2), 2.0 + 3 * k - 5 * (k % 2)) for k in range(20)]
    df = frame(spark, rows, "x double, f double, y double")
    assert stats.ols(df, F.col("y"), F.col("f"), F.col("x")) == pytest.approx([2, -5, 3])
    far = frame(spark, [(k < 10, float(k < 10) * 5 + k * 0.01) for k in range(20)], "g boolean, v double")
    assert stats.permutation_median_test(far, F.col("g"), "v", 99, 1).first().p == pytest.approx(0.01)
    assert stats.sign_flip_test(frame(spark, [(1.0 + k,) for k in range(12)], "d double"), "d", 99).first().p < 0.05
    assert stats.ols_permutation(df, -F.col("y"), F.col("f"), F.col("x"), 50).first().p < 0.9
    q = {r.id: r.q for r in stats.benjamini_hochberg(frame(spark, [(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.9)], "id long, p double"), "p", [F.col("id").asc()]).collect()}
    assert q == pytest.approx({1: 0.04, 2: 0.16 / 3, 3: 0.16 / 3, 4: 0.9})


def test_null_scores(spark):
    e, o = frame(spark, [(1.0,), (2.0,), (3.0,)], "v double"), frame(spark, [(3.0,)], "o double")
    r = stats.null_summary(e, "v", F.col("o"), o).first()
    assert (r.n, r.mean, r.z, r.empirical_p) == (3, 2.0, 1.0, 0.5)
    flat = frame(spark, [(1.0,), (1.0,)], "v double")
    assert tuple(stats.null_zscore(flat, "v", F.col("o"), frame(spark, [(1.0,)], "o double")).first()) == (0.0, 2.0)


def test_greedy_match_equals_the_plain_loop(spark):
    for seed in range(4):
        rng = random.Random(seed)
        cases = [(k, rng.choice([1, 5, 10, 50, 52, 55, 60, 300])) for k in range(25)]
        controls = [(100 + k, rng.choice([1, 5, 9, 11, 50, 51, 56, 310, 900])) for k in range(20)]
        free, want = dict(controls), []
        for case, d in sorted(cases, key=lambda c: (-c[1], c[0])):
            near = [(abs(x - d), o) for o, x in free.items() if 0.9 * d <= x <= 1.1 * d]
            # equal distances: the lower side's smallest id and the upper side's compete by id
            if near:
                o = min(near)[1]
                want.append((case, o))
                del free[o]
        got = matching.greedy_match(frame(spark, cases, "id long, degree long"), frame(spark, controls, "other long, other_degree long"))
        assert sorted((r.id, r.other) for r in got.collect()) == sorted(want)
    assert matching.greedy_match(frame(spark, [], "id long, degree long"), frame(spark, controls, "other long, other_degree long")).count() == 0


def test_peers_fall_back_to_neighbours_by_rank(spark):
    pop = frame(spark, [(k, 10 if k else 100_000, float(k)) for k in range(200)], "id long, degree long, value double")
    # its own window holds itself alone, and it isn't its own peer: the 50 ranks below it take its place
    assert sorted(r.peer for r in matching.peers(pop, frame(spark, [(0,)], "id long")).collect()) == list(range(150, 200))
    assert matching.peers(pop, frame(spark, [(5,)], "id long")).count() == 198


def test_monte_carlo_is_near_its_expectation(spark):
    pop = frame(spark, [(k, 5 + k % 3, "A" if k % 4 == 0 else "B") for k in range(400)], "id long, degree long, label string")
    r = enrichment.monte_carlo_uniform(pop, 40, "A", 10, 1000).first()
    assert abs(r.expected - 10) < 0.6
    top = pop.where("id < 40").select("id")
    exact = enrichment.expected_matched(pop, top, "A").first().expected
    assert abs(enrichment.monte_carlo_matched(pop, top, "A", 1000).first().expected - exact) < 0.6


def test_screen_resumes(spark, tmp_path):
    edges = frame(spark, [(k, (k + 1) % 12) for k in range(12)], "pre long, post long")
    nodes, panel = frame(spark, [(k,) for k in range(12)], "node long"), frame(spark, [(k, k) for k in range(4)], "pos long, node long")
    path = str(tmp_path / "screen")
    first = selection.screen(edges, nodes.where("node < 5"), panel, 12, path, chunk=3)
    assert first.count() == 5
    assert selection.screen(edges, nodes, panel, 12, path, chunk=4).count() == 12


def test_record_negative_cases(spark):
    good = dict(null_id=3, seed=103, code_version="v", n_nodes=5, n_edges_null=9, n_pair_nodes=4, n_gaba=2, gaba_cis=[0.1, 0.2], ctrl_cis=[0.1, 0.2], no_self_loops=True, no_duplicate_edges=True, out_degree_exact_match=True, in_degree_exact_match=True, cliffs_delta=0.1, median_diff=0.0)
    schema = "null_id long, seed long, code_version string, n_nodes long, n_edges_null long, n_pair_nodes long, n_gaba int, gaba_cis array<double>, ctrl_cis array<double>, no_self_loops boolean, no_duplicate_edges boolean, out_degree_exact_match boolean, in_degree_exact_match boolean, cliffs_delta double, median_diff double"
    wrong = [dict(seed=7), dict(code_version="w"), dict(n_nodes=6), dict(n_edges_null=8), dict(gaba_cis=[0.1, 1.2]), dict(ctrl_cis=[0.1, float("nan")]), dict(gaba_cis=[0.1]), dict(no_self_loops=False), dict(no_duplicate_edges=None), dict(out_degree_exact_match=False), dict(cliffs_delta=None), dict(n_pair_nodes=None)]
    rows = [tuple((good | w).values()) for w in [{}, *wrong]]
    ok = [r.ok for r in jobs.record_checks(frame(spark, rows, schema), 100, "v", 5, 9, 4, 2, 2).collect()]
    assert ok == [True] + [False] * len(wrong)


def test_manifest(spark):
    m = jobs.new_manifest(spark, 4, 100)
    u = frame(spark, [(1, "running", "w", None, None), (2, "failed", "w", "boom", None)], "null_id long, status string, worker_id string, error string, result_file string")
    m = jobs.mark(m, u, "now")
    assert {r.null_id: (r.status, r.attempts, r.error) for r in m.collect()} == {0: ("pending", 0, None), 1: ("running", 1, None), 2: ("failed", 0, "boom"), 3: ("pending", 0, None)}
    m = jobs.reconcile(m, frame(spark, [(3,)], "null_id long"))
    assert [r.null_id for r in jobs.pending(m).collect()] == [0, 1, 2] and m.where("null_id = 3").first().null_name == "null_003"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    frame(spark, [(1, 0.5), (2, 0.7)], "null_id long, v double").coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema("null_id long, v double").parquet(str(src))
    events.adopt(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    frame(spark, [(2, 9.9), (3, 0.1)], "null_id long, v double").coalesce(1).write.mode("append").parquet(str(src))
    events.adopt(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 0.5), (2, 0.7), (3, 0.1)]
    ev = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001/events.parquet*")
    q = events.tumbling(ev).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    table = events.tumbling(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert spark.table("tumbled").agg(F.sum("n")).first() == table.agg(F.sum("n")).first()


@pytest.mark.parametrize("block", [7, 25, 1000])
def test_ols_permutation_in_blocks(spark, block):
    """Blocks change neither the coefficient nor, but for chance, the p of all shuffles (before: a row for each replicate and row)."""
    rng = np.random.default_rng(5)
    f, x = rng.integers(0, 2, 60), rng.normal(size=60)
    y = 0.25 * f + 0.5 * x + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(y, f, x)], "y double, f int, x double")
    got = stats.ols_permutation(df, F.col("y"), F.col("f"), F.col("x"), 2000, block=block).first()
    row = np.linalg.pinv(np.stack([np.ones(60), f, x], 1))[1]
    assert got.observed == pytest.approx(row @ y)
    want = np.mean([row @ rng.permutation(y) >= row @ y for _ in range(20_000)])
    assert abs(got.p - want) < 5 * np.sqrt(want * (1 - want) / 2000)
