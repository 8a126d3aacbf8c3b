"""Operators beside the named queries: against brute force on small graphs and tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_whole_graph import reach

from graphloom import storage
from graphloom.operators import catalogue, enrichment, graph, jobs, matching, nulls, selection, stats, traverse
from graphloom.sources import sinks, synthetic, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges_of(df):
    return sorted((r.pre, r.post) for r in df.collect())


def nodes_of(df):
    return df.select(F.explode(F.array("pre", "post")).alias("node")).distinct()


def test_generated_graphs(spark):
    assert edges_of(synthetic.ring(spark, 3)) == [(0, 1), (1, 2), (2, 0)] and edges_of(synthetic.ring(spark, 1)) == []
    assert edges_of(synthetic.hub(spark, 3)) == [(0, 1), (0, 2), (1, 0), (2, 0)] and edges_of(synthetic.hub(spark, 0)) == []
    b = edges_of(synthetic.barbell(spark, 3, 1))
    assert len(b) == 6 + 6 + 4 and (2, 3) in b and (3, 4) in b and (4, 3) in b and (3, 2) in b
    assert graph.weak_components(synthetic.barbell(spark, 4, 0)).select("component").distinct().count() == 1
    g = edges_of(synthetic.bernoulli(spark, 300, 0.05, seed=3))
    assert len(g) == len({*g}) and all(a != b and 0 <= b < 300 for a, b in g) and abs(len(g) - 0.05 * 300 * 299) < 5 * (300 * 300 * 0.05) ** 0.5
    assert g == edges_of(synthetic.bernoulli(spark.newSession(), 300, 0.05, seed=3)) and g != edges_of(synthetic.bernoulli(spark, 300, 0.05, seed=4))
    assert synthetic.bernoulli(spark, 5, 1.0).count() == 20 and synthetic.bernoulli(spark, 5, 0.0).count() == 0
    assert edges_of(synthetic.edge_list(spark, [(4, 5)])) == [(4, 5)]


def test_efficiency_exact_sampled_and_sliced(spark):
    g = synthetic.bernoulli(spark, 40, 0.08, seed=1).cache()
    e, nodes = edges_of(g), spark.range(40).withColumnRenamed("id", "node")
    s, r = reach(e, range(40))
    assert abs(traverse.efficiency(g, nodes).first()[0] - s / (40 * 39)) < 1e-12
    assert abs(traverse.efficiency(g, nodes, n_samples=40, exact_below=10).first()[0] - s / r) < 1e-12
    assert traverse.efficiency(g, nodes, n_samples=7, exact_below=10, seed=2).first()[0] == traverse.efficiency(g, nodes, n_samples=7, exact_below=10, seed=2).first()[0]
    assert traverse.efficiency(g.limit(0), nodes.limit(0)).first()[0] == 0 and traverse.efficiency(g.limit(0), nodes.limit(1)).first()[0] == 0
    cut = [x for x in e if 3 not in x]
    want = (s / (40 * 39) - reach(cut, [n for n in range(40) if n != 3])[0] / (39 * 38)) / (s / (40 * 39))
    got = traverse.sliced_cis(g, nodes, nodes.where("node = 3")).first()
    assert got.target == 3 and abs(got.cis - want) < 1e-12


def test_neighbourhood_with_background(spark):
    ring = synthetic.ring(spark, 30)
    kept, inside = graph.neighbourhood(ring, frame(spark, [(5,)], "node long"), 2, 4)
    rows = {r.node: r.ring for r in kept.collect()}
    assert {n: r for n, r in rows.items() if r is not None} == {5: 0, 4: 1, 6: 1, 3: 2, 7: 2} and len(rows) == 9
    assert edges_of(inside) == [x for x in edges_of(ring) if x[0] in rows and x[1] in rows]


def test_finalists_and_rerank(spark):
    g = synthetic.bernoulli(spark, 60, 0.06, seed=5).cache()
    nodes = nodes_of(g).cache()
    n = nodes.count()
    screened = traverse.panel_cis(g, nodes, selection.drawn_panel(nodes, 8, 0), n).cache()
    chosen = selection.finalists(screened, 10, 5)
    assert chosen.where("not is_anchor").count() == 10 and chosen.where("is_anchor").count() == 5 and chosen.select("node").distinct().count() == 15
    out = selection.rerank_finalists(g, nodes, screened, seeds=(0, 1), k=20, top=10, anchors=5)
    assert out.count() == 15
    e = edges_of(g)
    one = out.first()
    panels = [[r.node for r in selection.drawn_panel(nodes, 20, s).collect()] for s in (0, 1)]
    cis = [1 - reach(e, p, one.target)[0] / reach(e, p)[0] for p in panels]
    assert abs(one.cis_mean - np.mean(cis)) < 1e-9 and abs(one.cis_std - np.std(cis, ddof=1)) < 1e-9
    summary = selection.screen_summary(screened, out).first()
    assert summary.n == n and summary.n_reranked == 15 and -1 <= summary.spearman <= 1


def test_records_of_large_graphs_have_the_same_fields(spark):
    g = synthetic.bernoulli(spark, 40, 0.15, seed=2).cache()
    seeds = frame(spark, [(0, 100), (1, 101)], "null_id long, seed long")
    ids = sorted(r.node for r in nodes_of(g).collect())
    node = lambda xs: frame(spark, [(x,) for x in xs], "node long")
    large = nulls.large_null_records(g, seeds, node(ids[:6]), node(ids[6:12]), frame(spark, [(k, x) for k, x in enumerate(ids[20:28])], "pos long, node long"), "v")
    small = nulls.null_records(g, seeds, ids[:6], ids[6:12], ids[20:28], "v")
    assert large.schema == small.schema
    for a, b in zip(large.orderBy("null_id").collect(), small.orderBy("null_id").collect()):
        assert a[:8] == b[:8] and a.status == b.status == "done"
        assert a.no_self_loops and a.no_duplicate_edges and a.out_degree_exact_match and a.in_degree_exact_match
        assert len(a.gaba_cis) == 6 and all(0 <= x <= 1 for x in a.gaba_cis + a.ctrl_cis)
    wrong = nulls.null_records(g, seeds, ids[:2], ids[2:4], ids[20:24], "v", lambda s, d, seed: np.roll(np.sort(d), 1) * 0 + d[0])
    assert {(r.in_degree_exact_match, r.status) for r in wrong.collect()} == {(False, "failed")}


def test_swaps_change_most_edges():
    rng = np.random.default_rng(0)
    hit = rng.random((60, 60)) < 0.1
    np.fill_diagonal(hit, False)
    src, dst = (x.astype(np.int64) * 7 for x in np.nonzero(hit))
    got = nulls.two_swaps(src, dst, 1)
    assert len({*zip(src, got)} & {*zip(src, dst)}) < 0.4 * len(src) and sorted(got) == sorted(dst)


def test_resampling_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), bool(k % 3), float(rng.normal())) for k in range(120)]
    one = {}
    for n in (1, 3, 7):
        df = frame(spark, rows, "i long, g boolean, v double").repartition(n)
        one.setdefault("perm", set()).add(tuple(stats.permutation_median_test(df, F.col("g"), "v", 200, 9).first()))
        one.setdefault("sign", set()).add(tuple(stats.sign_flip_test(df, "v", 200).first()))
        one.setdefault("ols", set()).add(tuple(stats.ols_permutation(df, F.col("v"), F.col("g").cast("int"), F.col("i") * 1.0, 100).first())[1:])
    assert all(len(x) == 1 for x in one.values())


def test_unpaired_coverage_and_pairs(spark):
    df = frame(spark, [(True, 1.0), (True, 3.0), (False, 2.0), (None, 9.0), (False, None)], "g boolean, v double")
    assert tuple(stats.unpaired(df, F.col("g"), "v").first()) == (2.0, 2.0, 0.0, 0.0, 2, 1)
    assert {r.field: (r.n, r.n_annotated, r.pct) for r in stats.coverage(df, "g", "v").collect()} == {"g": (5, 4, 80.0), "v": (5, 4, 80.0)}
    assert stats.coverage(df.limit(0), "g").first().pct is None
    m = matching.paired(frame(spark, [(1, 2)], "id long, other long"), frame(spark, [(1, 0.9), (2, 0.0)], "id long, score double"), eps=0.1).first()
    assert m.diff == 0.9 and abs(m.log_ratio - 1) < 1e-12


def test_window_matches_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    left = [(k, int(d)) for k, d in enumerate(rng.integers(1, 40, 60))]
    right = [(k, int(d)) for k, d in list(enumerate(rng.integers(1, 40, 90)))[30:]]
    right[:30] = [(k, d) for k, d in left[30:60]]  # ids on both sides aren't their own peers
    a, b = frame(spark, left, "id long, degree long"), frame(spark, right, "other long, other_degree long")
    near = {i: sorted((abs(x - d), o) for o, x in right if o != i and 0.9 * d <= x <= 1.1 * d) for i, d in left}
    assert {r.id: r.other for r in matching.nearest_peer(a, b).collect()} == {i: n[0][1] for i, n in near.items() if n}
    got = {r.id: r.other for r in matching.random_match(a, b, "s").collect()}
    assert got.keys() == {i for i, n in near.items() if n} and all(o in {x for _, x in near[i]} for i, o in got.items())
    assert got != {r.id: r.other for r in matching.random_match(a, b, "t").collect()}
    m = matching.greedy_match_by(a.withColumn("kind", F.col("id") % 2), F.col("kind") == 0, F.col("kind") == 1).collect()
    assert m and all(r.id % 2 == 0 and r.other % 2 == 1 for r in m) and len({r.other for r in m}) == len(m)


def test_enrichment_of_every_class(spark):
    tested = frame(spark, [(k, "abc"[min(k % 5, 2)]) for k in range(500)], "id long, label string")
    top = tested.where("id % 5 = 0 and id < 200").select("id")
    got = {r.label: r for r in enrichment.by_class(tested, top, 2000).collect()}
    assert got["a"].observed == 40 and got["a"].p == 1 / 2001 and got["a"].z > 5 and got["b"].observed == 0 and got["b"].p == 1.0
    assert abs(got["c"].expected - 24) < 1e-9 and abs(got["a"].sd - (40 * 0.2 * 0.8) ** 0.5) < 0.3
    assert enrichment.by_class(tested, top.limit(0), 10).where("p < 1").count() == 0


def test_limits_are_errors_and_corrupt_files_are_rows(spark, tmp_path):
    df = spark.range(20)
    for write in (lambda: sinks.report(df, tmp_path / "r.json", most=19), lambda: sinks.latex(df, "c", "l", most=19)):
        with pytest.raises(ValueError):
            write()
    sinks.report(df, tmp_path / "r.json", most=20)
    assert len(json.loads((tmp_path / "r.json").read_text())) == 20
    for k, text in enumerate(['{"null_id": 1}', "{broken"]):
        (tmp_path / f"row_{k}.json").write_text(text)
    for schema in ("null_id long", None):
        got = tables.json_records(spark, str(tmp_path / "row_*.json"), schema=schema).cache()
        assert sorted((r.null_id or 0, r.corrupt or "") for r in got.collect()) == [(0, "{broken"), (1, "")]


def test_manifest_versions_progress_and_reproducibility(spark, tmp_path):
    path = str(tmp_path / "m")
    jobs.new_manifest(spark, 3, 100).withColumn("code_version", F.lit("v1")).write.parquet(path)
    assert jobs.load_manifest(spark, path, "v1").count() == 3
    with pytest.raises(ValueError):
        jobs.load_manifest(spark, path, "v2")
    assert tuple(jobs.progress(jobs.load_manifest(spark, path, "v1")).first()) == (3, 0, 0, 3, 0.0, 0)
    (tmp_path / "x.txt").write_text("abc")
    r = jobs.reproducibility(spark, [str(tmp_path / "x.txt")], {"k": "8"}, "v1")
    assert r["files"][0]["sha256"].startswith("ba7816bf") and r["parameters"] == {"k": "8"} and r["spark"] == spark.version


def test_claims_and_summary_tables(spark):
    df = frame(spark, [(1.0, 1.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert tuple(catalogue.agreement_counts(df, F.col("a"), F.col("b")).first()) == (1, 1, 1)
    ranked = catalogue.descending_rank(frame(spark, [(1, 5.0), (2, 7.0), (3, 5.0), (4, None)], "id long, v double"), "v")
    assert {r.id: r["rank"] for r in ranked.collect()} == {2: 1, 1: 2, 3: 2, 4: None}
    t = catalogue.summary_tables(
        frame(spark, [(1, 4, "A"), (2, 2, "A")], "node long, total_degree long, label string"), frame(spark, [(1, 0.5)], "target long, cis double"),
        frame(spark, [(1, 2, 0.1)], "id long, other long, diff double"), frame(spark, [(1, "x")], "id long, class_label string"), frame(spark, [(0, 0.2, 0.1)], "null_id long, median_diff double, cliffs_delta double"),
    )
    assert [tuple(x.first()) for x in t.values()] == [("A", 2, 3.0, 3.0, 4), (1, 0.5, 0.5, 0.5, 0.5), (1, 0.1, 1.0), ("x", 1), (1, 0.2, None, 0.1)]


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        class sparkContext:
            master = "yarn"

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError):
        storage.shared_dir(Cluster)
    before = dict(spark.sparkContext.getConf().getAll())
    df = storage.materialize(spark.range(3), "test")
    assert df.count() == 3 and dict(spark.sparkContext.getConf().getAll()) == before
    other = {"file:/tmp/graphloom-test-release"}
    spark.range(2).write.mode("overwrite").parquet("file:/tmp/graphloom-test-release/x")
    monkeypatch.setattr(storage, "_written", other)
    storage.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet("file:/tmp/graphloom-test-release/x")


def test_node_order_needs_no_sort(spark):
    """Ends of edges are counted in hash tables: a struct as the value to aggregate made tasks sort all of them."""
    from graphloom.operators import graph

    pairs = spark.createDataFrame([(5, 1), (3, 1), (1, 9), (4, 9), (9, 3)], "pre long, post long")
    out = graph.node_index(pairs.where("pre <> 4").unionByName(pairs.where("pre = 4")))
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.select("node", "post_only", "first_pre").collect()} == {(5, 0, 5), (3, 0, 3), (1, 0, 1), (4, 0, 4), (9, 0, 9)}
    only = graph.node_index(pairs.where("pre in (5, 3)")).where("node = 1").first()
    assert (only.post_only, only.first_pre) == (1, 3)


def test_records_of_large_graphs_pass_no_task_whole(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("a whole graph goes to a task")

    monkeypatch.setattr(nulls, "RECORD_EDGES", 100)
    rng = np.random.default_rng(8)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (400, 2)) if a != b})
    g = spark.createDataFrame(edges, "pre long, post long")
    monkeypatch.setattr("graphloom.operators.dominance.losses", whole)
    got = nulls.null_records(g, spark.createDataFrame([(0, 7)], "null_id long, seed long"), [1, 2, 3], [4, 5], [6, 7], "v").first()
    assert got.status == "done" and got.n_edges_null == len(edges) and len(got.gaba_cis) == 3 and len(got.ctrl_cis) == 2
