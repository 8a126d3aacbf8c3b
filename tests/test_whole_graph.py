"""Queries over the whole pair graph against brute force."""

import numpy as np
import pytest
from oracle import SF

from graphloom import catalog
from graphloom.plans import derive


@pytest.fixture(scope="module")
def edges(spark):
    return sorted({(r.pre, r.post) for r in derive.pairs(spark, SF).select("pre", "post").collect()})


def page_rank(edges, nodes, rounds):
    at = {n: k for k, n in enumerate(nodes)}
    src, dst = np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])
    out, r = np.bincount(src, minlength=len(nodes)), np.full(len(nodes), 1 / len(nodes))
    for _ in range(rounds):
        r = 0.85 * (np.bincount(dst, r[src] / out[src], len(nodes)) + r[out == 0].sum() / len(nodes)) + 0.15 / len(nodes)
    return dict(zip(nodes, r.tolist()))


def top_union(spark, edges):
    """The top 1 % by degree, strength and PageRank."""
    degree, strength = {}, {}
    for r in derive.pairs(spark, SF).collect():
        for n in (r.pre, r.post):
            degree[n], strength[n] = degree.get(n, 0) + 1, strength.get(n, 0) + r.syn_count_total
    rank = page_rank(edges, sorted(r.node for r in derive.nodes(spark, SF).collect()), 10)
    k = max(1, len(degree) // 100)
    return {n for m in (degree, strength, rank) for n in sorted(degree, key=lambda n: (-m[n], n))[:k]}


def test_components_hold_every_node_of_the_pairs(spark, edges):
    up = {n: n for e in edges for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in catalog.QUERIES["weak_components"](spark, SF).collect()}
    assert got == {n: root(n) for n in up}


def test_pagerank_holds_every_node_of_the_pairs(spark, edges):
    got = {r.node: r.pagerank for r in catalog.QUERIES["pagerank_dangling"](spark, SF).collect()}
    want = page_rank(edges, sorted({n for e in edges for n in e}), 5)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-8 for n in want)


def test_rings_around_the_candidates(spark, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {n: 0 for n in top_union(spark, edges)}
    for step in (1, 2):
        for n in [n for n, r in want.items() if r == step - 1]:
            for m in near[n]:
                want.setdefault(m, step)
    assert {r.node: r.ring for r in catalog.QUERIES["k_ring_2"](spark, SF).collect()} == want


def test_candidates_by_pagerank_too(spark, edges):
    want = top_union(spark, edges)
    assert {r.node for r in catalog.QUERIES["candidate_union"](spark, SF).collect()} == want
    assert catalog.QUERIES["target_manifest"](spark, SF).first().n_union == len(want)


def reach(edges, sources, gone=None):
    near = {}
    for a, b in edges:
        if gone not in (a, b):
            near.setdefault(a, []).append(b)
    s = r = 0
    for x in sources:
        seen, front, level = {x}, [x] if x != gone else [], 0
        while front:
            level, front = level + 1, list({b for a in front for b in near.get(a, []) if b not in seen})
            seen.update(front)
            s, r = s + len(front) / level, r + len(front)
    return s, r


def test_impact_of_real_targets_on_all_nodes(spark, edges):
    every = {n for e in edges for n in e}
    s0, r0 = reach(edges, every)
    n = len(every)
    got = {r.target: r for r in catalog.QUERIES["exact_cis"](spark, SF).collect()}
    # fewer parts than a background: all of them are targets
    assert got.keys() == every
    for t in sorted(top_union(spark, edges)) + sorted(every)[:5]:
        s, r = reach(edges, every, t)
        assert abs(got[t].cis - (1 - s / s0)) < 1e-8 and abs(got[t].reach_drop - (r0 - r) / (n * (n - 1))) < 1e-11
    e = catalog.QUERIES["global_efficiency"](spark, SF).first()
    assert abs(e.exact - s0 / (n * (n - 1))) < 1e-8 and abs(e.sampled_reachable - s0 / r0) < 1e-8
    free = {r.target: r.cis_free for r in catalog.QUERIES["free_n_diagnostic"](spark, SF).collect()}
    t = min(every)
    s = reach(edges, every, t)[0]
    assert abs(free[t] - (1 - s / ((n - 1) * (n - 2)) / (s0 / (n * (n - 1))))) < 1e-8


def test_panel_is_drawn_and_targets_are_whole(spark, edges):
    every = {n for e in edges for n in e}
    far = catalog.QUERIES["bfs_distances"](spark, SF).collect()
    sources = {r.source for r in far}
    assert len(sources) == 8 and sources != set(sorted(every)[:8])
    s0, r0 = reach(edges, sources)
    assert sum(r.d > 0 for r in far) == r0 and abs(sum(1 / r.d for r in far if r.d) - s0) < 1e-6
    got = {r.target: r for r in catalog.QUERIES["panel_reach_shuffled"](spark, SF).collect()}
    assert got.keys() == every | {-1} and (got[-1].R, got[-1].S) == (r0, round(s0, 6))
    cis = {r.target: r.cis for r in catalog.QUERIES["panel_cis"](spark, SF).collect()}
    t = min(every - sources)
    assert cis.keys() == every and abs(cis[t] - (1 - reach(edges, sources, t)[0] / s0)) < 1e-8
