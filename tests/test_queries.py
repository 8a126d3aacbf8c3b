"""Every named query of the graph part against its SQL; those without SQL give rows."""

import pytest
from oracle import SF, both

from graphloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    ours, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted({*catalog.QUERIES} - {*catalog.ORACLES}))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry_points():
    import __spark_entry__ as e

    assert {*e.oracle_sql()} <= {*e.queries()}


def test_entry_works_without_the_training_data_operators(tmp_path):
    """The other queries are there when graphloom/llm and corpus_pipeline.py are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs")
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("name", ["bfs_distances", "k_ring_2", "neighbourhood_subgraph", "neighbourhood_composition"])
def test_edges_are_derived_once(spark, name, monkeypatch):
    """Only one plan collapses the lines to pairs (before: two), and the pairs go to storage once as such."""
    from graphloom.plans import derive, queries

    made, stored = [], []
    own, keep = derive.pairs, queries.selection.materialize
    monkeypatch.setattr(derive, "pairs", lambda *a: made.append(a) or own(*a))
    monkeypatch.setattr(queries.selection, "materialize", lambda df, tag: stored.append(tag) or keep(df, tag))
    catalog.QUERIES[name](spark, SF)
    assert len(made) == 1 and stored.count("pairs") <= 1


@pytest.mark.parametrize("name", ["label_hot_p90", "background_hash", "neighbourhood_subgraph"])
def test_no_pagerank_where_none_is_asked_for(spark, name, monkeypatch):
    from graphloom.operators import graph

    monkeypatch.setattr(graph, "pagerank", None)
    ours, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    assert ours == theirs


def test_distances_rank_no_nodes(spark, monkeypatch):
    """The sources of ``bfs_distances`` are drawn from the nodes; neither PageRank nor targets are made for them."""
    from graphloom.operators import graph
    from graphloom.plans import queries

    monkeypatch.setattr(graph, "pagerank", None)
    monkeypatch.setattr(queries, "_chosen", None)
    ours, theirs = both(spark, catalog.QUERIES["bfs_distances"], catalog.ORACLES["bfs_distances"])
    assert ours == theirs


def test_links_and_ends_hold_all_pairs(spark, monkeypatch):
    from graphloom.operators import graph
    from graphloom.plans import derive

    pairs = derive.pairs(spark, SF).select("pre", "post", "syn_count_total").collect()
    assert sorted(pairs) == sorted(derive.links(spark, SF).collect())
    monkeypatch.setattr(graph, "ENDS", 3)
    ends = graph.adjacency(derive.links(spark, SF)).collect()
    assert max(len(r.to) for r in ends) == 3 and sorted((r.node, x) for r in ends for x in r.to) == sorted(r[:2] for r in pairs)
