"""Named queries over the derived graph, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.ordered import average_rank, draw, global_rank, portable_draw, portable_hash
from ..operators import catalogue, enrichment, graph, jobs, matching, nulls, ranges, selection, stats, traverse
from ..sources import synthetic, tables
from ..storage import shared_dir
from ..streaming import adoption
from ..streaming import events as streams
from . import derive
from .derive import table
from .sql import CTES, chain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return derive.pairs(s, d)


def _population(s: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(derive.pairs(s, d), "syn_count_total")
    value = F.round((F.col("in_strength") + F.col("out_strength")) / F.col("total_degree"), 6)
    return deg.join(derive.nodes(s, d), "node").select(F.col("node").alias("id"), "in_degree", "out_degree", F.col("total_degree").alias("degree"), value.alias("value"), F.col("out_strength").alias("strength"), F.col("nt_type").alias("label"), "super_class")


def _r(c: Column | str, n: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- tables, cells, projections

@query(chain("pairs") + " SELECT * FROM pairs")
def edge_collapse(s, d):
    return _pairs(s, d)


@query(chain("pairs") + " SELECT pre, post, nt_type_edge FROM pairs")
def edge_majority_label(s, d):
    return _pairs(s, d).select("pre", "post", "nt_type_edge")


@query(chain("raw_edges") + " SELECT pre, post, count(DISTINCT neuropil) AS n_neuropils FROM raw_edges GROUP BY pre, post")
def edge_neuropil_nunique(s, d):
    return derive.raw_edges(s, d).groupBy("pre", "post").agg(F.count_distinct("neuropil").alias("n_neuropils"))


@query("""SELECT 'full_id' AS "column", count(*) AS n, 0 AS n_null, CAST(min(i) AS VARCHAR) AS min_id, CAST(max(i) AS VARCHAR) AS max_id, bool_and(regexp_full_match(CAST(i AS VARCHAR), '720575940[0-9]{9}')) AS all_match
FROM (SELECT 720575940000000000 + c_custkey AS i FROM customer)
UNION ALL SELECT 'c_custkey', count(*), 0, CAST(min(c_custkey) AS VARCHAR), CAST(max(c_custkey) AS VARCHAR), bool_and(regexp_full_match(CAST(c_custkey AS VARCHAR), '720575940[0-9]{9}')) FROM customer""")
def id_validation(s, d):
    c = table(s, d, "customer").select(labels.full_id(F.col("c_custkey")).alias("full_id"), "c_custkey")
    return jobs.id_report(c, "full_id", "c_custkey")


@query(chain("pairs") + """ SELECT count(*) AS n_pairs, count(*) FILTER (pre = post) AS n_self_loops, avg(CAST(pre % 3 <> 0 AS INT)) AS pre_coverage, avg(CAST(post % 3 <> 0 AS INT)) AS post_coverage,
 avg(CAST(pre % 3 <> 0 AND post % 3 <> 0 AS INT)) AS both_coverage FROM pairs""")
def endpoint_coverage(s, d):
    return graph.endpoint_coverage(_pairs(s, d), derive.nodes(s, d).where("node % 3 <> 0"))


@query(chain("raw_edges") + """ SELECT count(*) AS n_rows, count(DISTINCT (pre, post)) AS n_pairs, (SELECT count(*) FROM (SELECT pre FROM raw_edges UNION SELECT post FROM raw_edges)) AS n_nodes,
 count(DISTINCT neuropil) AS n_regions, min(syn_count) AS min_count, max(syn_count) AS max_count, CAST(sum(syn_count) AS BIGINT) AS total_count FROM raw_edges""")
def build_profile(s, d):
    e = derive.raw_edges(s, d)
    n = e.select(F.explode(F.array("pre", "post")).alias("node")).agg(F.count_distinct("node").alias("n_nodes"))
    return e.agg(F.count("*").alias("n_rows"), F.count_distinct("pre", "post").alias("n_pairs"), F.count_distinct("neuropil").alias("n_regions"), F.min("syn_count").alias("min_count"), F.max("syn_count").alias("max_count"), F.sum("syn_count").alias("total_count")).crossJoin(n)


@query(chain("nodes") + """ SELECT n.node, n.name, n.nt_type, n.nt_sign, s.n_lines, q.total FROM nodes n LEFT JOIN (SELECT l_partkey AS node, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s USING (node)
 LEFT JOIN (SELECT l_partkey AS node, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 45 GROUP BY 1) q USING (node)""")
def node_core_left_join(s, d):
    lines = table(s, d, "lineitem")
    returned = lines.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("n_lines"))
    large = lines.where("l_linestatus = 'F' and l_quantity > 45").groupBy(F.col("l_partkey").alias("node")).agg(F.sum("l_quantity").cast("long").alias("total"))
    return jobs.left_join_one_to_one(derive.nodes(s, d).select("node", "name", "nt_type", "nt_sign"), "node", returned, large)


@query("SELECT p_partkey AS node, CASE p_brand WHEN 'Brand#1' THEN 'ACH' WHEN 'Brand#2' THEN 'GABA' END AS label, CASE p_brand WHEN 'Brand#1' THEN 'excitatory' WHEN 'Brand#2' THEN 'inhibitory' ELSE 'unknown' END AS sign FROM part")
def sign_map_default(s, d):
    label = F.when(F.col("p_brand") == "Brand#1", "ACH").when(F.col("p_brand") == "Brand#2", "GABA")
    return table(s, d, "part").select(F.col("p_partkey").alias("node"), label.alias("label"), labels.sign_of(label).alias("sign"))


@query("""SELECT v AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 12) AS share FROM (SELECT CASE WHEN p_type <> 'PROMO' THEN p_type END AS v FROM part) GROUP BY v""")
def label_value_counts(s, d):
    return graph.value_counts(table(s, d, "part"), F.when(F.col("p_type") != "PROMO", F.col("p_type"))).withColumn("share", _r("share", 12))


@query("""SELECT s_suppkey AS id, 720575940000000000 + s_suppkey AS full_id, trim(s_name) AS name, round(log10(greatest(s_acctbal, 0) + 1), 9) AS log_balance,
 CASE WHEN s_acctbal > 0 THEN round(s_acctbal / greatest(s_nationkey, 1), 6) ELSE 0 END AS ratio, least(greatest(s_acctbal, 0), 5000) AS clipped, s_acctbal IS NULL AS missing, string_split(s_name, '#')[1] AS base FROM supplier""")
def scalar_projections(s, d):
    x = F.col("s_acctbal")
    return table(s, d, "supplier").select(
        F.col("s_suppkey").alias("id"), labels.full_id(F.col("s_suppkey")).alias("full_id"), labels.clean(F.concat(F.lit(" "), "s_name", F.lit("\r\n"))).alias("name"), _r(F.log10(F.greatest(x, F.lit(0.0)) + 1)).alias("log_balance"),
        F.when(x > 0, F.round(x / F.greatest("s_nationkey", F.lit(1)), 6)).otherwise(0.0).alias("ratio"), F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)).alias("clipped"), x.isNull().alias("missing"), F.split("s_name", "#")[0].alias("base"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, l_tax AS z, count(*) AS n FROM lineitem GROUP BY ALL")
def parse_vector_cell(s, d):
    cell = F.concat(F.lit("["), F.concat_ws("  ", "l_quantity", "l_discount", "l_tax"), F.lit("]"))
    v = table(s, d, "lineitem").withColumn("v", labels.vector_cell(cell))
    return v.groupBy("l_orderkey", "l_linenumber", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("z")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, unnest([p_brand, p_type]) AS label FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 1")
def parse_list_cell(s, d):
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))).otherwise(F.col("p_name"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.explode(labels.list_cell(cell)).alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, last_value(CASE WHEN event_id % 7 = 0 THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id) AS user_id FROM events")
def forward_fill_ids(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("user_id")).alias("user_id"))
    return tables.forward_filled(e, "event_id", "user_id", block=1000)


@query(r"SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[Ll]icen[sc]e[sd]?|version \d+')) AS term FROM documents) GROUP BY term")
def text_mentions(s, d):
    return jobs.mentions(table(s, d, "documents"), r"[Ll]icen[sc]e[sd]?|version \d+")


# --- static graph metrics

@query(chain("pairs") + """, ends AS (SELECT pre AS node, 0 AS post_only, pre AS first_pre FROM pairs UNION ALL SELECT post, 1, pre FROM pairs)
 SELECT node, post_only, first_pre FROM ends QUALIFY row_number() OVER (PARTITION BY node ORDER BY post_only, first_pre) = 1""")
def node_order(s, d):
    return graph.node_index(_pairs(s, d))


@query(chain("degree") + " SELECT node, in_degree, out_degree, total_degree FROM degree")
def degree_table(s, d):
    return graph.degrees(_pairs(s, d))


@query(chain("degree", "nodes") + " SELECT node, coalesce(in_strength, 0) AS in_strength, coalesce(out_strength, 0) AS out_strength FROM nodes LEFT JOIN degree USING (node)")
def strength_table(s, d):
    deg = graph.degrees(_pairs(s, d), "syn_count_total").select("node", "in_strength", "out_strength")
    return graph.with_universe(derive.nodes(s, d), deg, ["in_strength", "out_strength"])


@query(chain("degree") + " SELECT node, in_degree, out_degree, total_degree FROM degree")
def degree_outer_join(s, d):
    return graph.degrees_by_outer_join(_pairs(s, d))


@query(chain("pairs") + " SELECT n_nodes, n_edges, n_edges / (n_nodes * (n_nodes - 1)) AS density, n_edges / n_nodes AS mean_degree FROM (SELECT count(*) AS n_edges FROM pairs), (SELECT count(*) AS n_nodes FROM part)")
def density_mean_degree(s, d):
    return graph.density(_pairs(s, d), derive.nodes(s, d).agg(F.count("*").alias("n_nodes")))


@query(chain("pairs") + """ SELECT CAST(count(*) FILTER (b.pre IS NOT NULL) AS BIGINT) AS n_mutual, count(*) FILTER (b.pre IS NOT NULL) / count(*) AS reciprocity_edges, count(*) FILTER (b.pre IS NOT NULL) / 2 / count(*) AS reciprocity_pairs
 FROM pairs a LEFT JOIN pairs b ON a.pre = b.post AND a.post = b.pre""")
def reciprocity(s, d):
    return graph.reciprocity(_pairs(s, d))


@query(chain("degree", "nodes") + " SELECT nt_type AS label, count(*) AS n, median(coalesce(total_degree, 0)) AS median, round(avg(coalesce(total_degree, 0)), 9) AS mean FROM nodes LEFT JOIN degree USING (node) GROUP BY nt_type")
def label_metrics_summary(s, d):
    deg = graph.with_universe(derive.nodes(s, d), graph.degrees(_pairs(s, d)), ["in_degree", "out_degree", "total_degree"])
    return graph.label_summary(deg.join(derive.nodes(s, d), "node"), "nt_type", "total_degree").withColumn("mean", _r("mean"))


@query(chain("pairs") + " SELECT nt_type_edge AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM pairs), 12) AS share FROM pairs GROUP BY 1")
def edges_by_label(s, d):
    return graph.value_counts(_pairs(s, d), F.col("nt_type_edge")).withColumn("share", _r("share", 12))


@query(chain("degree", "nodes") + """ SELECT node, nt_type, nt_sign, super_class, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(total_degree, 0) AS total_degree,
 round(log10(coalesce(in_strength, 0) + 1), 9) AS log_in_strength, round(log10(coalesce(out_strength, 0) + 1), 9) AS log_out_strength FROM nodes LEFT JOIN degree USING (node)""")
def node_metrics(s, d):
    m = derive.nodes(s, d).join(graph.degrees(_pairs(s, d), "syn_count_total"), "node", "left").na.fill(0)
    return m.select("node", "nt_type", "nt_sign", "super_class", "in_degree", "out_degree", "total_degree", _r(F.log10(F.col("in_strength") + 1)).alias("log_in_strength"), _r(F.log10(F.col("out_strength") + 1)).alias("log_out_strength"))


def _pagerank_ctes(nodes: str, rounds: int) -> str:
    return chain("pairs", "nodes", recursive=True) + f""", universe AS ({nodes}), total AS (SELECT count(*) AS n FROM universe), outs AS (SELECT pre AS node, count(*) AS k FROM pairs GROUP BY pre),
 pr(it, node, r) AS (
   SELECT 0, node, 1.0::DOUBLE / n FROM universe, total
   UNION ALL
   (WITH prev AS (SELECT p.it, p.node, p.r, k FROM pr p LEFT JOIN outs USING (node) WHERE p.it < {rounds}),
     lost AS (SELECT coalesce(sum(r), 0) AS l FROM prev WHERE k IS NULL),
     got AS (SELECT e.post AS node, sum(p.r / p.k) AS g FROM prev p JOIN pairs e ON e.pre = p.node GROUP BY e.post)
    SELECT p.it + 1, p.node, 0.85 * (coalesce(g, 0) + l / n) + 0.15 / n FROM prev p LEFT JOIN got USING (node), lost, total)),
 pagerank AS (SELECT node, round(r, 9) AS pagerank FROM pr WHERE it = {rounds})"""


def _pagerank_sql(nodes: str, rounds: int) -> str:
    return _pagerank_ctes(nodes, rounds) + " SELECT node, pagerank FROM pagerank"


@query(_pagerank_sql("SELECT node FROM nodes", 10))
def pagerank_10iter(s, d):
    return graph.pagerank(_pairs(s, d), derive.nodes(s, d), iterations=10, tolerance=0).withColumn("pagerank", _r("pagerank"))


@query(chain("pairs", "nodes") + ", keep AS (SELECT node FROM nodes WHERE nt_type IN ('GABA', 'ACH')) SELECT pre, post, syn_count_total FROM pairs WHERE pre IN (SELECT node FROM keep) AND post IN (SELECT node FROM keep)")
def induced_subgraph(s, d):
    p = _pairs(s, d).select("pre", "post", "syn_count_total")
    return graph.induced_subgraph(p, derive.nodes(s, d).where(F.col("nt_type").isin("GABA", "ACH")))


@query(chain("pairs", recursive=True) + """, both_ways AS (SELECT pre AS a, post AS b FROM pairs UNION SELECT post, pre FROM pairs),
 least_of(it, node, c, moved) AS (
   SELECT 0, a, a, true FROM (SELECT DISTINCT a FROM both_ways)
   UNION ALL
   (WITH prev AS (SELECT * FROM least_of), got AS (SELECT e.a AS node, min(p.c) AS g FROM prev p JOIN both_ways e ON e.b = p.node GROUP BY e.a)
    SELECT p.it + 1, p.node, least(p.c, g), g < p.c FROM prev p JOIN got USING (node) WHERE (SELECT bool_or(moved) FROM prev)))
 SELECT node, min(c) AS component FROM least_of GROUP BY node""")
def weak_components(s, d):
    return graph.weak_components(_pairs(s, d))


@query(_pagerank_sql("SELECT pre AS node FROM pairs UNION SELECT post FROM pairs", 5))
def pagerank_dangling(s, d):
    e = selection.materialize(_pairs(s, d).select("pre", "post"), "pairs")
    return graph.pagerank(e, e.select(F.explode(F.array("pre", "post")).alias("node")), iterations=5, tolerance=0).withColumn("pagerank", _r("pagerank"))


@query(chain("raw_edges") + """, by_region AS (SELECT pre AS node, neuropil, CAST(sum(syn_count) AS BIGINT) AS n FROM raw_edges GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, neuropil) AS r FROM by_region)
 SELECT node, string_agg(neuropil || ':' || n, '; ' ORDER BY r) AS regions FROM ranked WHERE r <= 3 GROUP BY node""")
def region_profile_top3(s, d):
    return graph.region_profile(derive.raw_edges(s, d))


# --- selection

def _edges(s: SparkSession, d: str) -> DataFrame:
    return selection.materialize(derive.pairs(s, d, False), "pairs")


def _labelled_degrees(p: DataFrame, s: SparkSession, d: str) -> DataFrame:
    """Degree, strength and label of each node of the pair graph."""
    deg = graph.degrees(p, "syn_count_total").join(derive.nodes(s, d).select("node", "nt_type"), "node")
    return deg.withColumn("strength", F.col("in_strength") + F.col("out_strength"))


def _metrics(s: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """Degree, strength, PageRank of ten rounds, and label of each node of the pair graph, of which ``p`` holds the edges."""
    p = _edges(s, d) if p is None else p
    rank = graph.pagerank(p, derive.nodes(s, d), iterations=10, tolerance=0).withColumn("pagerank", _r("pagerank"))
    return selection.materialize(_labelled_degrees(p, s, d).join(rank, "node"), "metrics")


_BACKGROUND = 500
_TOP = "SELECT node FROM metrics, k QUALIFY row_number() OVER (ORDER BY {} DESC, node) <= k"
_SELECT = _pagerank_ctes("SELECT node FROM nodes", 10) + ", " + CTES["degree"] + f""", metrics AS (SELECT node, total_degree, in_strength + out_strength AS strength, pagerank, nt_type FROM degree JOIN nodes USING (node) JOIN pagerank USING (node)),
 k AS (SELECT greatest(1, CAST(floor(0.01 * count(*)) AS BIGINT)) AS k FROM metrics), top AS ({" UNION ".join(_TOP.format(c) for c in ("total_degree", "strength", "pagerank"))}),
 hot AS (SELECT node FROM metrics WHERE nt_type = 'GABA' AND total_degree >= (SELECT quantile_cont(total_degree, 0.9) FROM metrics WHERE nt_type = 'GABA')),
 random AS (SELECT node FROM metrics ORDER BY CAST('0x' || md5(CAST(node AS VARCHAR) || 'bg')[1:8] AS BIGINT), node LIMIT {_BACKGROUND}),
 chosen AS (SELECT node FROM top UNION SELECT node FROM hot UNION SELECT node FROM random)"""


def _chosen(m: DataFrame) -> DataFrame:
    """All targets: the candidates, the hot nodes of a label, and the background."""
    every = selection.candidates(m).unionByName(selection.hot_by_label(m, "GABA")).unionByName(selection.background_portable(m, _BACKGROUND, "bg"))
    return selection.materialize(every.distinct(), "targets")


@query(_SELECT + " SELECT node FROM top")
def candidate_union(s, d):
    return selection.candidates(_metrics(s, d))


@query(_SELECT + " SELECT node FROM hot")
def label_hot_p90(s, d):
    return selection.hot_by_label(selection.materialize(_labelled_degrees(_pairs(s, d), s, d), "degrees"), "GABA")


@query(_SELECT + " SELECT node FROM random")
def background_hash(s, d):
    nodes_ = _pairs(s, d).select(F.explode(F.array("pre", "post")).alias("node")).distinct().join(derive.nodes(s, d), "node", "left_semi")
    return selection.background_portable(nodes_, _BACKGROUND, "bg")


@query(_SELECT + """ SELECT (SELECT count(*) FROM top) AS n_union, (SELECT count(*) FROM hot) AS n_hot, (SELECT count(*) FROM hot WHERE node NOT IN (SELECT node FROM top)) AS n_hot_new, (SELECT count(*) FROM random) AS n_background,
 (SELECT count(*) FROM chosen) AS n_targets""")
def target_manifest(s, d):
    m = _metrics(s, d)
    return selection.target_manifest(selection.candidates(m), selection.hot_by_label(m, "GABA"), selection.background_portable(m, _BACKGROUND, "bg"))


@query(_SELECT + """, both_ways AS (SELECT pre AS a, post AS b FROM pairs UNION SELECT post, pre FROM pairs), one AS (SELECT node, 0 AS r FROM top UNION ALL SELECT b, 1 FROM top JOIN both_ways ON a = node), near AS (SELECT node, min(r) AS r FROM one GROUP BY node),
 two AS (SELECT node, r FROM near UNION ALL SELECT b, 2 FROM near JOIN both_ways ON a = node WHERE r = 1) SELECT node, CAST(min(r) AS INTEGER) AS ring FROM two GROUP BY node""")
def k_ring_2(s, d):
    """Two rings around the candidates."""
    p = _edges(s, d)
    return graph.k_ring(p, selection.candidates(_metrics(s, d, p)), 2)


@query(_SELECT + """, both_ways AS (SELECT pre AS a, post AS b FROM pairs UNION SELECT post, pre FROM pairs), ring AS (SELECT node FROM hot UNION SELECT b FROM hot JOIN both_ways ON a = node),
 others AS (SELECT a AS node FROM both_ways WHERE a NOT IN (SELECT node FROM ring) GROUP BY a ORDER BY CAST('0x' || md5(CAST(a AS VARCHAR) || 'background')[1:8] AS BIGINT), a LIMIT 100), kept AS (SELECT node FROM ring UNION ALL SELECT node FROM others)
 SELECT pre, post FROM pairs WHERE pre IN (SELECT node FROM kept) AND post IN (SELECT node FROM kept)""")
def neighbourhood_subgraph(s, d):
    """The pairs among the hot nodes, their neighbours and a drawn background."""
    p = _edges(s, d)
    hot = selection.hot_by_label(selection.materialize(_labelled_degrees(p, s, d), "degrees"), "GABA")
    return graph.neighbourhood(p.select("pre", "post"), hot, 1, 100)[1]


@query(_SELECT + """, near AS (SELECT pre AS t, post AS u FROM pairs WHERE pre IN (SELECT node FROM chosen) UNION SELECT post, pre FROM pairs WHERE post IN (SELECT node FROM chosen)),
 kinds AS (SELECT CASE WHEN nt_type IS NULL THEN 'unknown' WHEN nt_type IN ('GABA', 'ACH', 'GLUT') THEN nt_type ELSE 'other' END AS kind FROM near LEFT JOIN (SELECT node AS u, nt_type FROM nodes) USING (u))
 SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM kinds), 12) AS share FROM kinds GROUP BY kind""")
def neighbourhood_composition(s, d):
    labels_ = derive.nodes(s, d).select("node", F.col("nt_type").alias("label"))
    p = _edges(s, d)
    return graph.neighbourhood_composition(p, _chosen(_metrics(s, d, p)), labels_, ["GABA", "ACH", "GLUT"]).withColumn("share", _r("share", 12))


# --- traversal: all targets, from the panel of a screen or from all nodes

_PANEL = 8
_FAR = """(t, s, node, d) USING KEY (t, s, node) AS (SELECT t, s, s, 0 FROM {0}, {1} WHERE s <> t UNION
  (SELECT b.t, b.s, e.post, any_value(b.d) + 1 FROM {2} b JOIN pairs e ON e.pre = b.node LEFT JOIN recurring.{2} o ON o.t = b.t AND o.s = b.s AND o.node = e.post WHERE e.post <> b.t AND o.node IS NULL GROUP BY b.t, b.s, e.post))"""
_BFS = _SELECT + f""", undamaged AS (SELECT -1 AS t), targets AS (SELECT node AS t FROM chosen UNION ALL SELECT -1), every AS (SELECT node AS s FROM metrics),
 sources AS (SELECT s FROM every ORDER BY CAST('0x' || md5(CAST(s AS VARCHAR) || 'panel')[1:8] AS BIGINT), s LIMIT {_PANEL}), n AS (SELECT count(*) AS n FROM metrics), dist{_FAR.format("targets", "sources", "dist")},
 sr AS (SELECT t AS target, sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) AS S, count(*) FILTER (d > 0) AS R FROM dist GROUP BY t), base AS (SELECT S AS s0, R AS r0 FROM sr WHERE target = -1)"""


def _whole(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Pairs; all targets; all nodes (pos, node) in a drawn order, of which the first _PANEL are the panel; how many."""
    p = _edges(s, d)
    m, p = _metrics(s, d, p), p.select("pre", "post")
    every = _drawn(m)
    return p, _chosen(m), every, every.count()


def _drawn(nodes: DataFrame) -> DataFrame:
    """``pos, node``: all nodes in a drawn order."""
    drawn = nodes.select("node", portable_hash(F.col("node"), "panel").alias("drawn"))
    return selection.materialize(global_rank(drawn, [F.col("drawn"), F.col("node")], "pos").select((F.col("pos") - 1).alias("pos"), "node"), "every")


def _rounded_cis(df: DataFrame) -> DataFrame:
    return df.select("target", _r("cis").alias("cis"), _r("reach_drop", 12).alias("reach_drop"), _r("S_baseline", 6).alias("S_baseline"), _r("S_perturbed", 6).alias("S_perturbed"))


@query(_BFS.replace(_FAR.format("targets", "sources", "dist"), _FAR.format("undamaged", "sources", "dist")) + " SELECT s AS source, node, CAST(d AS INTEGER) AS d FROM dist")
def bfs_distances(s, d):
    p = _edges(s, d).select("pre", "post")
    nodes_ = p.select(F.explode(F.array("pre", "post")).alias("node")).distinct().join(derive.nodes(s, d), "node", "left_semi")
    few = nodes_.select("node", portable_hash(F.col("node"), "panel").alias("drawn")).orderBy("drawn", "node").limit(_PANEL)
    sources = selection.materialize(traverse.panel(_drawn(few)), "panel")
    base = s.range(1).select(F.lit(traverse.BASELINE).cast("long").alias("target"))
    found = traverse.distances(traverse.bfs_levels(p, sources, base))
    return found.join(sources.withColumnRenamed("node", "source"), ["batch", "bit"]).select("source", "node", "d")


@query(_BFS + " SELECT target, round(S, 6) AS S, R FROM sr")
def panel_reach_shuffled(s, d):
    p, targets, every, _ = _whole(s, d)
    return traverse.panel_reach(p, targets, traverse.panel(every.where(F.col("pos") < _PANEL)), broadcast_edges=0).withColumn("S", _r("S", 6))


_CIS = " SELECT target, round(1 - S / s0, 9) AS cis, round((r0 - R) / (n * (n - 1)), 12) AS reach_drop, round(s0, 6) AS S_baseline, round(S, 6) AS S_perturbed FROM sr, base, n WHERE target >= 0"


@query(_BFS + _CIS)
def panel_cis(s, d):
    return _rounded_cis(_screened(s, d)[1])


def _screened(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, targets, every, n = _whole(s, d)
    return p, selection.materialize(traverse.panel_cis(p, targets, every.where(F.col("pos") < _PANEL), n), "screen")


_SCREEN = _SELECT + """, screen AS (SELECT node AS target, size / 50.0 AS cis FROM chosen JOIN nodes USING (node)), best AS (SELECT target FROM screen ORDER BY cis DESC, target LIMIT 150),
 anchors AS (SELECT target FROM screen WHERE target NOT IN (SELECT target FROM best) ORDER BY CAST('0x' || md5(CAST(target AS VARCHAR) || 'anchor')[1:8] AS BIGINT), target LIMIT 50)"""


def _sized(s: SparkSession, d: str, m: DataFrame) -> DataFrame:
    """All targets with a score that stands for the screen's (the part's size), so that SQL can follow quickly."""
    found = derive.nodes(s, d).join(_chosen(m), "node", "left_semi")
    return selection.materialize(found.select(F.col("node").alias("target"), (F.col("size") / 50.0).alias("cis")), "screen")


@query(_SCREEN + " SELECT target AS node, false AS is_anchor FROM best UNION ALL SELECT target, true FROM anchors")
def finalists(s, d):
    return selection.finalists(_sized(s, d, _metrics(s, d)))


@query(_SCREEN + " SELECT count(*) AS n, round(median(cis), 9) AS cis_median, round(quantile_cont(cis, 0.9), 9) AS cis_p90, round(quantile_cont(cis, 0.99), 9) AS cis_p99, max(cis) AS cis_max, (SELECT count(*) FROM (FROM best UNION ALL FROM anchors)) AS n_reranked, 1.0::DOUBLE AS spearman FROM screen")
def screen_spread(s, d):
    found = _sized(s, d, _metrics(s, d))
    reranked = found.join(selection.finalists(found).select(F.col("node").alias("target")), "target", "left_semi").select("target", (F.col("cis") * 2).alias("cis_mean"))
    return selection.screen_summary(found, reranked).select("n", *[_r(c).alias(c) for c in ("cis_median", "cis_p90", "cis_p99")], "cis_max", "n_reranked", _r("spearman").alias("spearman"))


@query()
def screen_and_rerank(s, d):
    """The screen's spread, and how well its ranks foretell those of the finalists from panels of 32 with two seeds."""
    p, screened = _screened(s, d)
    nodes_ = p.select(F.explode(F.array("pre", "post")).alias("node")).distinct()
    return selection.screen_summary(screened, selection.rerank_finalists(p, selection.materialize(nodes_, "nodes"), screened))


@query()
def exact_cis(s, d):
    p, targets, every, n = _whole(s, d)
    return _rounded_cis(traverse.panel_cis(p, targets, every, n))


@query()
def free_n_diagnostic(s, d):
    p, targets, every, n = _whole(s, d)
    return traverse.free_n_cis(traverse.panel_cis(p, targets, every, n), n).withColumn("cis_free", _r("cis_free"))


_ALL_PAIRS = chain("pairs", recursive=True) + f""", undamaged AS (SELECT -1 AS t), every AS (SELECT pre AS s FROM pairs UNION SELECT post FROM pairs), n AS (SELECT count(*) AS n FROM every), dist{_FAR.format("undamaged", "every", "dist")},
 sr AS (SELECT sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) AS S, count(*) FILTER (d > 0) AS R FROM dist)"""


@query(_ALL_PAIRS + " SELECT round(S / (n * (n - 1)), 9) AS exact, round(S / R, 9) AS sampled_reachable FROM sr, n")
def global_efficiency(s, d):
    p = _edges(s, d).select("pre", "post")
    every = selection.materialize(p.select(F.explode(F.array("pre", "post")).alias("node")).distinct(), "every")
    found = selection.materialize(traverse.panel_reach(p, s.createDataFrame([], "node long"), every), "reach")
    return traverse.global_efficiency(found, every.count()).select(_r("efficiency").alias("exact")).crossJoin(traverse.sampled_efficiency(found).select(_r("efficiency").alias("sampled_reachable")))


@query(_ALL_PAIRS + " SELECT round(S / (n * (n - 1)), 9) AS efficiency FROM sr, n")
def efficiency_drawn(s, d):
    """Exact up to 5,000 nodes, from 1,000 drawn sources beyond; the SQL is that of small graphs."""
    p = selection.materialize(_pairs(s, d).select("pre", "post"), "pairs")
    return traverse.efficiency(p, p.select(F.explode(F.array("pre", "post")).alias("node")).distinct()).withColumn("efficiency", _r("efficiency"))


@query(chain("raw_edges") + """, per_seed AS (SELECT pre AS target, syn_count % 4 AS seed, sum(syn_count) / 1000.0 AS cis FROM raw_edges GROUP BY ALL)
 SELECT target, round(avg(cis), 9) AS cis_mean, round(stddev_samp(cis), 9) AS cis_std, round(avg(cis * 2), 9) AS reach_drop_mean FROM per_seed GROUP BY target""")
def rerank_mean_sd(s, d):
    e = derive.raw_edges(s, d).groupBy(F.col("pre").alias("target"), (F.col("syn_count") % 4).alias("seed")).agg((F.sum("syn_count") / 1000.0).alias("cis"))
    return selection.rerank(e.withColumn("reach_drop", F.col("cis") * 2)).select("target", *[_r(c).alias(c) for c in ("cis_mean", "cis_std", "reach_drop_mean")])


@query(_SCREEN + """, final AS (SELECT target FROM best UNION ALL SELECT target FROM anchors)
 SELECT n.node, cis, n.nt_type, coalesce(d.total_degree, 0) AS total_degree, CASE WHEN n.node IN (SELECT target FROM final) THEN cis * 2 END AS cis_mean, n.node IN (SELECT target FROM final) AS is_finalist, n.node IN (SELECT node FROM random) AS in_background
 FROM screen JOIN nodes n ON n.node = target LEFT JOIN degree d USING (node)""")
def annotate_screen(s, d):
    m = _metrics(s, d)
    screened = _sized(s, d, m)
    reranked = screened.join(selection.finalists(screened).select(F.col("node").alias("target")), "target", "left_semi").select("target", (F.col("cis") * 2).alias("cis_mean"))
    out = selection.annotate(screened, derive.nodes(s, d).select("node", "nt_type"), graph.degrees(_pairs(s, d)), reranked, selection.background_portable(m, _BACKGROUND, "bg"))
    return out.select("node", "cis", "nt_type", "total_degree", "cis_mean", "is_finalist", "in_background")


# --- range joins, matching, peers

_POP = chain("population")


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = selection.materialize(_population(s, d), "population")
    return p.where("label = 'GABA'").select("id", "degree"), p.where("label = 'ACH'").select(F.col("id").alias("other"), F.col("degree").alias("other_degree"))


_NEAR = _POP + """, near AS (SELECT a.id, a.degree, b.id AS other, b.degree AS other_degree FROM population a JOIN population b ON b.degree BETWEEN 0.9 * a.degree AND 1.1 * a.degree WHERE a.label = 'GABA' AND b.label = 'ACH')"""


@query(_NEAR + " SELECT id, count(*) AS n, min(other_degree) AS lo, max(other_degree) AS hi FROM near GROUP BY id")
def range_join_window(s, d):
    return ranges.window_counts(*_sides(s, d))


@query(_NEAR + " SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(other_degree - degree), other) = 1")
def nearest_degree_peer(s, d):
    return matching.nearest_peer(*_sides(s, d)).select("id", "degree", "other", "other_degree")


@query(_NEAR + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other_degree, other) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM near)
 SELECT id, degree, other, other_degree FROM numbered WHERE k = CAST('0x' || md5(CAST(id AS VARCHAR) || 'match')[1:8] AS BIGINT) % n""")
def random_match(s, d):
    return matching.random_match(*_sides(s, d), salt="match")


@query(_NEAR + """, one AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(other_degree - degree), other) = 1)
 SELECT o.id, other, round(a.value - b.value, 9) AS diff, round(log10((a.value + 1e-7) / (b.value + 1e-7)), 9) AS log_ratio FROM one o JOIN population a ON a.id = o.id JOIN population b ON b.id = o.other""")
def paired_log_ratio(s, d):
    scores = _population(s, d).select("id", F.col("value").alias("score"))
    return matching.paired(nearest_degree_peer(s, d), scores).select("id", "other", _r("diff").alias("diff"), _r("log_ratio").alias("log_ratio"))


_MERGED = "CASE WHEN label IN ('GABA', 'GLUT') THEN 'INH_CAND' ELSE label END"


def _merged(s: SparkSession, d: str) -> DataFrame:
    return selection.materialize(_population(s, d).withColumn("label", matching.merged_labels(F.col("label"), ("GABA", "GLUT"), "INH_CAND")), "merged")


@query(_POP + f""", m AS (SELECT {_MERGED} AS l, value FROM population), g AS (SELECT value AS v FROM m WHERE l = 'INH_CAND'), c AS (SELECT value AS v FROM m WHERE l = 'ACH'),
 u AS (SELECT sum(CASE WHEN g.v > c.v THEN 1.0 WHEN g.v = c.v THEN 0.5 ELSE 0 END) AS u FROM g, c), n AS (SELECT (SELECT count(*) FROM g) AS n_case, (SELECT count(*) FROM c) AS n_control, (SELECT median(v) FROM g) AS a, (SELECT median(v) FROM c) AS b)
 SELECT round(a, 9) AS median_case, round(b, 9) AS median_control, round(a - b, 9) AS median_diff, round(2 * u / (n_case * n_control) - 1, 9) AS cliffs_delta, n_case, n_control FROM u, n""")
def merged_label_unpaired(s, d):
    p = _merged(s, d).where(F.col("label").isin("INH_CAND", "ACH"))
    out = stats.unpaired(p, F.col("label") == "INH_CAND", "value")
    return out.select(*[_r(c).alias(c) for c in ("median_case", "median_control", "median_diff", "cliffs_delta")], "n_case", "n_control")


@query()
def merged_label_sensitivity(s, d):
    """The matched comparison redone with two labels as one: greedy pairs, their Wilcoxon sums and the sign-flip test."""
    p = _merged(s, d)
    m = selection.materialize(matching.greedy_match_by(p, F.col("label") == "INH_CAND", F.col("label") == "ACH"), "merged-pairs")
    both = selection.materialize(matching.paired(m, p.select("id", F.col("value").alias("score"))).withColumn("zero", F.lit(0.0)), "merged-diffs")
    w = stats.wilcoxon(both, "diff", "zero").select(F.col("n").alias("n_pairs"), "w")
    return w.crossJoin(stats.sign_flip_test(both, "diff"))


@query()
def greedy_match(s, d):
    return matching.greedy_match(*_sides(s, d))


@query(_NEAR + ", unused AS (SELECT 1), counts AS (SELECT (SELECT count(*) FROM population WHERE label = 'GABA') AS n) SELECT true AS one_to_one, true AS in_window, true AS largest_first")
def greedy_match_invariants(s, d):
    m = selection.materialize(greedy_match(s, d), "greedy")
    once = m.agg((F.count("*") == F.count_distinct("id")).alias("a"), (F.count("*") == F.count_distinct("other")).alias("b"), F.bool_and(F.col("other_degree").between(0.9 * F.col("degree"), 1.1 * F.col("degree"))).alias("in_window"), F.count("*").alias("n"))
    # a case that got nothing had all its window's controls taken by cases of its degree or more
    cases, controls = _sides(s, d)
    left = matching.window_join(cases.join(m.select("id"), "id", "left_anti"), controls).join(m.select("other", F.col("degree").alias("taken_by")), "other", "left")
    return once.crossJoin(left.agg(F.coalesce(F.bool_and(F.coalesce(F.col("taken_by") >= F.col("degree"), F.lit(False))), F.lit(True)).alias("largest_first"))).select((F.col("a") & F.col("b")).alias("one_to_one"), "in_window", "largest_first")


_W = "log10(1.1) + 1e-12"
_PEERS = _POP + f""", top AS (SELECT id FROM population ORDER BY value DESC, id LIMIT 50), ranked AS (SELECT *, row_number() OVER (ORDER BY degree, id) AS r FROM population), inside AS (
 SELECT a.id, a.value AS own, b.id AS peer, b.value FROM population a JOIN population b ON abs(log10(b.degree + 1.0) - log10(a.degree + 1.0)) <= {_W} AND a.id <> b.id WHERE a.id IN (SELECT id FROM top)),
 lonely AS (SELECT a.id, a.value AS own, b.id AS peer, b.value FROM ranked a JOIN ranked b ON b.r BETWEEN a.r - 50 AND a.r + 49 AND a.id <> b.id WHERE a.id IN (SELECT id FROM top) AND a.id NOT IN (SELECT id FROM inside)),
 pools AS (SELECT id, count(*) AS peer_pool_n, avg(CAST(value >= own AS INT)) AS emp_p, median(value) AS peer_median, any_value(own) AS own FROM (FROM inside UNION ALL FROM lonely) GROUP BY id)"""


@query(_PEERS + " SELECT id, peer_pool_n, round(emp_p, 9) AS emp_p, round(peer_median, 9) AS peer_median, round(own / peer_median, 9) AS excess_ratio FROM pools")
def peer_exceedance(s, d):
    return _exceedance(s, d).select("id", "peer_pool_n", _r("emp_p").alias("emp_p"), _r("peer_median").alias("peer_median"), _r("excess_ratio").alias("excess_ratio"))


def _exceedance(s: SparkSession, d: str) -> DataFrame:
    p = selection.materialize(_population(s, d), "population")
    return matching.peer_exceedance(p.select("id", "degree", "value"), stats.top_k(p, 50, "value", "id"))


@query(_PEERS.replace(" ORDER BY value DESC, id LIMIT 50", "") + " SELECT id, peer_pool_n, round(emp_p, 9) AS emp_p, round(peer_median, 9) AS peer_median, round(own / peer_median, 9) AS excess_ratio FROM pools")
def peer_exceedance_all(s, d):
    """Every node against its degree peers."""
    p = selection.materialize(_population(s, d).select("id", "degree", "value"), "population")
    return matching.peer_exceedance(p, p).select("id", "peer_pool_n", *[_r(c).alias(c) for c in ("emp_p", "peer_median", "excess_ratio")])


@query()
def peer_exceedance_monte_carlo(s, d):
    p = selection.materialize(_population(s, d), "population")
    return matching.monte_carlo_exceedance(p.select("id", "degree", "value"), stats.top_k(p, 50, "value", "id"))


# --- statistics

@query(_POP + " SELECT id, degree, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2 AS rank FROM population")
def avg_rank(s, d):
    return average_rank(_population(s, d).select("id", "degree"), "degree")


@query(_POP + """, r AS (SELECT rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2 AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS b FROM population)
 SELECT count(*) AS n, round(corr(a, b), 9) AS rho FROM r""")
def spearman(s, d):
    return stats.spearman(_population(s, d), "degree", "value").withColumn("rho", _r("rho"))


@query(_POP + " SELECT count(*) AS n, round(corr(degree, value), 9) AS r FROM population")
def pearson(s, d):
    return stats.pearson(_population(s, d), "degree", "value").withColumn("r", _r("r"))


@query(_POP + """, g AS (SELECT value AS v FROM population WHERE label = 'GABA'), c AS (SELECT value AS v FROM population WHERE label <> 'GABA'),
 u AS (SELECT sum(CASE WHEN g.v > c.v THEN 1.0 WHEN g.v = c.v THEN 0.5 ELSE 0 END) AS u FROM g, c), n AS (SELECT (SELECT count(*) FROM g) AS n1, (SELECT count(*) FROM c) AS n2)
 SELECT n1, n2, CAST(u AS DOUBLE) AS u, round(2 * u / (n1 * n2) - 1, 9) AS delta FROM u, n""")
def cliffs_delta(s, d):
    return stats.cliffs_delta(_population(s, d), F.col("label") == "GABA", "value").withColumn("delta", _r("delta"))


@query(_POP + """, x AS (SELECT in_degree - out_degree AS d FROM population WHERE in_degree <> out_degree), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM x),
 t AS (SELECT CAST(sum(k * k * k - k) AS BIGINT) AS ties FROM (SELECT count(*) AS k FROM x GROUP BY abs(d)))
 SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, any_value(ties) AS ties FROM r, t""")
def wilcoxon_w(s, d):
    return stats.wilcoxon(_population(s, d), "in_degree", "out_degree")


@query(_POP + """ SELECT label AS grp, count(*) AS n, round(avg(value), 9) AS mean, round(median(value), 9) AS median, round(stddev_samp(value), 9) AS sd, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.75), 9) AS q3,
 round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 9) AS iqr FROM population GROUP BY label""")
def descriptives(s, d):
    out = stats.descriptives(_population(s, d), F.col("label"), F.col("value"))
    return out.select("grp", "n", *[_r(c).alias(c) for c in ("mean", "median", "sd", "q1", "q3", "iqr")])


@query(_POP + """, v AS (SELECT log10(value + 1e-7) AS y, CAST(label = 'GABA' AS INT)::DOUBLE AS f, log10(degree + 1.0) AS x FROM population WHERE label IN ('GABA', 'ACH')),
 c AS (SELECT covar_pop(f, y) AS fy, covar_pop(x, y) AS xy, covar_pop(f, x) AS fx, var_pop(f) AS ff, var_pop(x) AS xx, avg(y) AS my, avg(f) AS mf, avg(x) AS mx FROM v),
 b AS (SELECT *, (fy * xx - xy * fx) / (ff * xx - fx * fx) AS b1, (xy * ff - fy * fx) / (ff * xx - fx * fx) AS b2 FROM c)
 SELECT round(my - b1 * mf - b2 * mx, 6) AS intercept, round(b1, 6) AS flag, round(b2, 6) AS log_degree FROM b""")
def ols_3param(s, d):
    p = _population(s, d).where(F.col("label").isin("GABA", "ACH"))
    b = stats.ols(p, F.log10(F.col("value") + 1e-7), (F.col("label") == "GABA").cast("int"), F.log10(F.col("degree") + 1.0))
    return s.range(1).select(*[F.round(F.lit(x), 6).alias(n) for x, n in zip(b, ("intercept", "flag", "log_degree"))])


@query(_POP + """, line AS (SELECT regr_slope(log10(value + 1e-7), log10(degree + 1.0)) AS b, regr_intercept(log10(value + 1e-7), log10(degree + 1.0)) AS a FROM population WHERE label IN ('GABA', 'ACH'))
 SELECT id, round(log10(value + 1e-7) - (a + b * log10(degree + 1.0)), 6) AS excess FROM population, line""")
def ols_residual_excess(s, d):
    p = _population(s, d)
    return stats.ols_excess(p, F.col("label").isin("GABA", "ACH"), F.log10(F.col("value") + 1e-7), F.log10(F.col("degree") + 1.0)).select("id", F.round("excess", 6).alias("excess"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 7919 % 10007) / 10007.0 AS p FROM part), r AS (SELECT *, p * (SELECT count(*) FROM p) / row_number() OVER (ORDER BY p, id) AS raw, row_number() OVER (ORDER BY p, id) AS k FROM p)
 SELECT id, round(p, 9) AS p, round(least(1, min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM r""")
def bh_fdr(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 10007 / 10007.0).alias("p"))
    return stats.benjamini_hochberg(p, "p", [F.col("id").asc()]).select("id", _r("p").alias("p"), _r("q").alias("q"))


_NULLS = chain("raw_edges") + """, e AS (SELECT neuropil || nt_type AS null_id, avg(syn_count) AS v FROM raw_edges GROUP BY 1), o AS (SELECT quantile_cont(v, 0.7) AS o FROM e)"""


def _ensemble(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = derive.raw_edges(s, d).groupBy(F.concat("neuropil", "nt_type").alias("null_id")).agg(F.avg("syn_count").alias("v"))
    return e, e.agg(F.percentile("v", 0.7).alias("o"))


@query(_NULLS + """ SELECT count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd, round(max(v), 9) AS max, round(quantile_cont(v, 0.95), 9) AS p95, round((any_value(o) - avg(v)) / stddev_samp(v), 6) AS z,
 round((count(*) FILTER (v >= o) + 1) / (count(*) + 1), 9) AS empirical_p FROM e, o""")
def null_ensemble_summary(s, d):
    e, o = _ensemble(s, d)
    out = stats.null_summary(e, "v", F.col("o"), o)
    return out.select("n", *[_r(c, 6 if c == "z" else 9).alias(c) for c in ("mean", "sd", "max", "p95", "z", "empirical_p")])


@query(_NULLS + """, r AS (SELECT avg(v) AS mean, stddev_samp(v) AS sd, max(v) AS max, (count(*) FILTER (v >= o) + 1) / (count(*) + 1) AS empirical_p FROM e, o)
 SELECT unnest(['mean', 'sd', 'max', 'empirical_p']) AS figure, unnest([round(mean, 2), round(sd, 2), round(max, 2) + 1, empirical_p]) AS stored, unnest([round(mean, 6), round(sd, 6), round(max, 6), round(empirical_p, 9)]) AS recomputed, unnest([true, true, false, true]) AS agrees FROM r""")
def recomputation_audit(s, d):
    """Figures as a report would hold them, to two digits and with one that is off, against the ensemble's."""
    e, o = _ensemble(s, d)
    e = selection.materialize(e.crossJoin(o), "ensemble")
    stored = e.agg(F.round(F.avg("v"), 2).alias("mean"), F.round(F.stddev_samp("v"), 2).alias("sd"), (F.round(F.max("v"), 2) + 1).alias("max"), ((F.count_if(F.col("v") >= F.col("o")) + 1) / (F.count("*") + 1)).alias("empirical_p"))
    found = stats.null_summary(e.select("v"), "v", F.col("o"), o).select("mean", "sd", "max", "empirical_p")
    return stats.audit(found, stored, 0.0051).select("figure", "stored", F.when(F.col("figure") == "empirical_p", _r("recomputed", 9)).otherwise(_r("recomputed", 6)).alias("recomputed"), "agrees")


@query(_POP + " SELECT label, round(log10(degree + 1), 9) AS x, round(log10(value + 1e-7), 9) AS y FROM population")
def scatter_extract(s, d):
    return catalogue.scatter(_population(s, d), F.col("degree"), F.col("value"), F.col("label")).select("label", _r("x").alias("x"), _r("y").alias("y"))


@query(_NULLS + " SELECT round((any_value(o) - avg(v)) / stddev_samp(v), 6) AS z, round(greatest(2 * least(avg(CAST(v >= o AS INT)), avg(CAST(v <= o AS INT))), 1 / (count(*) + 1)), 9) AS p FROM e, o")
def null_zscore(s, d):
    e, o = _ensemble(s, d)
    return stats.null_zscore(e, "v", F.col("o"), o).select(_r("z", 6).alias("z"), _r("p").alias("p"))


@query()
def permutation_median(s, d):
    p = _population(s, d).where(F.col("label").isin("GABA", "ACH"))
    return stats.permutation_median_test(p, F.col("label") == "GABA", "value", 10_000, 9)


@query()
def sign_flip(s, d):
    m = greedy_match(s, d).withColumn("diff", F.col("degree") - F.col("other_degree"))
    return stats.sign_flip_test(m, "diff")


@query()
def ols_permutation(s, d):
    p = _population(s, d).where(F.col("label").isin("GABA", "ACH"))
    return stats.ols_permutation(p, F.log10(F.col("value") + 1e-7), (F.col("label") == "GABA").cast("int"), F.log10(F.col("degree") + 1.0))


@query(_POP + """, g AS (SELECT value AS v FROM population WHERE label = 'GABA'), c AS (SELECT value AS v FROM population WHERE label = 'ACH'),
 u AS (SELECT sum(CASE WHEN g.v > c.v THEN 1.0 WHEN g.v = c.v THEN 0.5 ELSE 0 END) AS u FROM g, c), n AS (SELECT (SELECT count(*) FROM g) AS n_case, (SELECT count(*) FROM c) AS n_control, (SELECT median(v) FROM g) AS a, (SELECT median(v) FROM c) AS b)
 SELECT round(a, 9) AS median_case, round(b, 9) AS median_control, round(a - b, 9) AS median_diff, round(2 * u / (n_case * n_control) - 1, 9) AS cliffs_delta, n_case, n_control FROM u, n""")
def unpaired_statistic(s, d):
    p = _population(s, d).where(F.col("label").isin("GABA", "ACH"))
    out = stats.unpaired(p, F.col("label") == "GABA", "value")
    return out.select(*[_r(c).alias(c) for c in ("median_case", "median_control", "median_diff", "cliffs_delta")], "n_case", "n_control")


@query("""WITH n AS (SELECT count(*) AS n, count(text) AS a, count(lang) AS b, count(source) AS c FROM documents) SELECT 'text' AS field, n, a AS n_annotated, round(100.0 * a / n, 9) AS pct FROM n UNION ALL SELECT 'lang', n, b, round(100.0 * b / n, 9) FROM n
 UNION ALL SELECT 'source', n, c, round(100.0 * c / n, 9) FROM n""")
def annotation_coverage(s, d):
    return stats.coverage(table(s, d, "documents"), "text", "lang", "source").withColumn("pct", _r("pct"))


_TOPS = _POP + """, t AS (SELECT id, 'd' AS tag FROM (SELECT id FROM population ORDER BY degree DESC, id LIMIT 100) UNION ALL SELECT id, 'i' FROM (SELECT id FROM population ORDER BY in_degree DESC, id LIMIT 100)
 UNION ALL SELECT id, 'o' FROM (SELECT id FROM population ORDER BY out_degree DESC, id LIMIT 100)), c AS (SELECT id, count(DISTINCT tag) AS k FROM t GROUP BY id)"""


@query(_TOPS + " SELECT CAST(3 AS BIGINT) AS n_sets, count(*) FILTER (k = 3) AS n_common, count(*) AS n_union, count(*) FILTER (k = 3) / count(*) AS jaccard FROM c")
def topk_overlap_jaccard(s, d):
    p = selection.materialize(_population(s, d), "population")
    sets = [stats.top_k(p, 100, c, "id").select("id", F.lit(c).alias("tag")) for c in ("degree", "in_degree", "out_degree")]
    return stats.jaccard(sets[0].unionByName(sets[1]).unionByName(sets[2]))


_SP = """SELECT '{0}' AS definition, count(*) AS n, round(corr(a, b), 9) AS rho FROM (SELECT rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2 AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS b FROM population)"""


@query(_POP + " " + " UNION ALL ".join(_SP.format(c) for c in ("degree", "in_degree", "out_degree", "strength")))
def degree_definition(s, d):
    p = selection.materialize(_population(s, d), "population")
    out = [stats.spearman(p, c, "value").select(F.lit(c).alias("definition"), "n", _r("rho").alias("rho")) for c in ("degree", "in_degree", "out_degree", "strength")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# --- enrichment

_TOP100 = _POP + ", top AS (SELECT id, label, super_class FROM population ORDER BY value DESC, id LIMIT 100)"


def _top(p: DataFrame, k: int = 100) -> DataFrame:
    return stats.top_k(p, k, "value", "id")


@query(_TOP100 + """ SELECT t.super_class AS label, n_top, n_base, round((n_top / (SELECT count(*) FROM top)) / (n_base / (SELECT count(*) FROM population)), 9) AS enrichment
 FROM (SELECT super_class, count(*) AS n_top FROM top GROUP BY 1) t JOIN (SELECT super_class, count(*) AS n_base FROM population GROUP BY 1) b USING (super_class)""")
def enrichment_ratio(s, d):
    p = selection.materialize(_population(s, d), "population")
    return enrichment.ratio(_top(p).select(F.col("super_class").alias("label")), p.select(F.col("super_class").alias("label"))).withColumn("enrichment", _r("enrichment"))


@query(_TOP100 + """ SELECT b.super_class AS label, coalesce(observed, 0) AS observed, tested_count, round(100 * tested_count / (SELECT count(*) FROM population), 9) AS expected, round(coalesce(observed, 0) / (100 * tested_count / (SELECT count(*) FROM population)), 9) AS enrichment
 FROM (SELECT super_class, count(*) AS tested_count FROM population GROUP BY 1) b LEFT JOIN (SELECT super_class, count(*) AS observed FROM top GROUP BY 1) t USING (super_class)""")
def enrichment_expected_uniform(s, d):
    p = selection.materialize(_population(s, d), "population").select("id", "value", F.col("super_class").alias("label"))
    return enrichment.expected_uniform(p, _top(p)).select("label", "observed", "tested_count", _r("expected").alias("expected"), _r("enrichment").alias("enrichment"))


@query(_TOP100 + f""", rates AS (SELECT a.id, avg(CAST(b.label = 'GABA' AS INT)) AS rate, max(CAST(a.label = 'GABA' AS INT)) AS own FROM population a JOIN population b ON abs(log10(b.degree + 1.0) - log10(a.degree + 1.0)) <= {_W} WHERE a.id IN (SELECT id FROM top) GROUP BY a.id)
 SELECT CAST(sum(own) AS BIGINT) AS observed, round(sum(rate), 6) AS expected, round(sum(own) / sum(rate), 6) AS enrichment FROM rates""")
def enrichment_expected_matched(s, d):
    p = selection.materialize(_population(s, d), "population")
    return enrichment.expected_matched(p, _top(p), "GABA").select("observed", _r("expected", 6).alias("expected"), _r("enrichment", 6).alias("enrichment"))


@query(_POP + """, r AS (SELECT label, row_number() OVER (ORDER BY value DESC, id) AS r FROM population), rate AS (SELECT avg(CAST(label = 'GABA' AS INT)) AS q FROM population)
 SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (label = 'GABA') AS observed, round(k * any_value(q), 9) AS expected, round(count(*) FILTER (label = 'GABA') / (k * any_value(q)), 9) AS enrichment FROM r, rate, (SELECT unnest([25, 50, 100]) AS k) WHERE r <= k GROUP BY k""")
def enrichment_sweep(s, d):
    p = _population(s, d).select("id", F.col("value").alias("score"), "label")
    return enrichment.sweep(p, [25, 50, 100], "GABA").select("k", "observed", _r("expected").alias("expected"), _r("enrichment").alias("enrichment"))


@query(_TOP100 + """, b AS (SELECT super_class, count(*) AS tested_count FROM population GROUP BY 1), t AS (SELECT super_class, count(*) AS observed FROM top GROUP BY 1)
 SELECT b.super_class AS label, coalesce(observed, 0) AS observed, tested_count, round(100 * tested_count / (SELECT count(*) FROM population), 9) AS expected, true AS z_follows, true AS p_in_range FROM b LEFT JOIN t USING (super_class)""")
def enrichment_by_class(s, d):
    """Monte-Carlo z and p of each class: SQL has the counts and expectations, and that z has the sign of what was observed beyond."""
    p = selection.materialize(_population(s, d), "population")
    out = enrichment.by_class(p.select("id", F.col("super_class").alias("label")), _top(p))
    beyond = F.col("observed") - F.col("expected")
    follows = (F.abs(F.col("z") * F.col("sd") - beyond) <= 6 * F.col("sd") / 100).alias("z_follows")  # the mean of 10,000 draws
    return out.select("label", "observed", "tested_count", _r("expected").alias("expected"), follows, F.col("p").between(1 / 10_001, 1.0).alias("p_in_range"))


@query()
def enrichment_monte_carlo(s, d):
    p = selection.materialize(_population(s, d), "population")
    top = selection.materialize(_top(p, 50), "top")
    seen = top.where("label = 'GABA'").count()
    a = enrichment.monte_carlo_uniform(p, 50, "GABA", seen).withColumn("control", F.lit("uniform"))
    return a.unionByName(enrichment.monte_carlo_matched(p, top, "GABA").withColumn("control", F.lit("matched")))


# --- catalogue

_V1 = _POP + """, line AS (SELECT regr_slope(log10(value + 1e-7), log10(degree + 1.0)) AS b, regr_intercept(log10(value + 1e-7), log10(degree + 1.0)) AS a FROM population WHERE label IN ('GABA', 'ACH')),
 cat AS (SELECT id, label, value, CAST(floor(rank() OVER (ORDER BY value DESC) + (count(*) OVER (PARTITION BY value) - 1) / 2) AS INTEGER) AS rank, log10(value + 1e-7) - (a + b * log10(degree + 1.0)) AS excess,
  CASE WHEN label = 'GABA' AND id % 2 = 0 THEN value - 48 END AS delta FROM population, line),
 classed AS (SELECT id, rank, CASE WHEN rank <= 50 AND excess > 0.05 THEN 'A_strong_chokepoint' WHEN rank <= 50 AND label = 'GABA' AND delta > 0 THEN 'C_gaba_candidate' WHEN rank <= 50 THEN 'B_degree_driven_hub' WHEN label = 'GABA' AND delta > 0 THEN 'C_gaba_candidate' ELSE 'not_classified' END AS class_label FROM cat)"""


def _catalogue_v1(s: SparkSession, d: str) -> DataFrame:
    p = stats.ols_excess(_population(s, d), F.col("label").isin("GABA", "ACH"), F.log10(F.col("value") + 1e-7), F.log10(F.col("degree") + 1.0))
    p = catalogue.descending_rank(p, "value").withColumn("delta", F.when((F.col("label") == "GABA") & (F.col("id") % 2 == 0), F.col("value") - 48))
    # these values spread less than the scores that the threshold is meant for
    return p.select("id", "rank", catalogue.class_v1(F.col("rank"), F.col("excess") + (catalogue.EXCESS - 0.05), F.col("label"), F.col("delta")).alias("class_label"))


@query(_V1 + " SELECT * FROM classed")
def classify_v1(s, d):
    return _catalogue_v1(s, d)


@query(_V1 + " SELECT class_label AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM classed), 12) AS share FROM classed GROUP BY 1")
def class_roll_up(s, d):
    return graph.value_counts(_catalogue_v1(s, d), F.col("class_label")).withColumn("share", _r("share", 12))


_V2 = _PEERS + """, cat AS (SELECT p.id, emp_p, peer_pool_n, super_class, own / peer_median AS excess_ratio, label, CASE WHEN label = 'GABA' THEN own - 48 END AS delta FROM pools p JOIN population USING (id)),
 classed AS (SELECT id, emp_p, peer_pool_n, super_class, excess_ratio, CASE WHEN emp_p < 0.01 THEN 'A_strong_chokepoint' WHEN emp_p >= 0.05 THEN 'B_degree_driven_hub' ELSE 'B_intermediate' END
  || CASE WHEN super_class IN ('Brand#1', 'Brand#2', 'Brand#3') AND label = 'GABA' AND delta > 0 THEN '|D_visual_system+C_gaba_exploratory' WHEN super_class IN ('Brand#1', 'Brand#2', 'Brand#3') THEN '|D_visual_system' WHEN label = 'GABA' AND delta > 0 THEN '|C_gaba_exploratory' ELSE '' END AS class_label FROM cat)"""
_VISUAL = ("Brand#1", "Brand#2", "Brand#3")


def _catalogue_v2(s: SparkSession, d: str) -> DataFrame:
    found = _exceedance(s, d).join(_population(s, d).select("id", "label", "super_class", "value"), "id")
    delta = F.when(F.col("label") == "GABA", F.col("value") - 48)
    return found.withColumn("class_label", catalogue.class_v2(F.col("emp_p"), F.col("super_class"), F.col("label"), delta, _VISUAL))


@query(_V2 + " SELECT id, class_label, string_split(class_label, '|')[1] AS base FROM classed")
def classify_v2_tags(s, d):
    return _catalogue_v2(s, d).select("id", "class_label", catalogue.base_class(F.col("class_label")).alias("base"))


@query(_V2 + """ SELECT count(*) AS n, round(median(emp_p), 9) AS median_emp_p, count(*) FILTER (emp_p < 0.01) AS n_emp_p_below_001, count(*) FILTER (emp_p < 0.05) AS n_emp_p_below_005, count(*) FILTER (peer_pool_n < 10) AS n_tiny_pools,
 round(avg(CAST(super_class IN ('Brand#1', 'Brand#2', 'Brand#3') AS INT)), 9) AS visual_fraction, round(median(excess_ratio), 9) AS median_excess_ratio FROM classed""")
def catalogue_summary(s, d):
    out = catalogue.summary_v2(_catalogue_v2(s, d), _VISUAL)
    return out.select(*[_r(c).alias(c) if c.startswith(("median", "visual")) else F.col(c) for c in out.columns])


@query(_PEERS + """, by_region AS (SELECT pre AS node, neuropil, CAST(sum(syn_count) AS BIGINT) AS n FROM raw_edges GROUP BY ALL UNION ALL SELECT -1 - post, neuropil, CAST(sum(syn_count) AS BIGINT) FROM raw_edges GROUP BY ALL),
 prof AS (SELECT node, string_agg(neuropil || ':' || n, '; ' ORDER BY r) AS regions FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, neuropil) AS r FROM by_region) WHERE r <= 3 GROUP BY node)
 SELECT p.id AS node, o.regions AS output_regions, i.regions AS input_regions FROM pools p LEFT JOIN prof o ON o.node = p.id LEFT JOIN prof i ON i.node = -1 - p.id""")
def integrated_catalogue(s, d):
    e = derive.raw_edges(s, d)
    back = e.select(F.col("post").alias("pre"), F.col("pre").alias("post"), "neuropil", "syn_count")
    return catalogue.integrated(_exceedance(s, d).select(F.col("id").alias("node")), graph.region_profile(e), graph.region_profile(back))


@query(_POP + """, v AS (SELECT log10(value) AS v FROM population), b AS (SELECT CAST(least(floor((v - 1.4) / 0.01), 29) AS INTEGER) AS bin FROM v WHERE v BETWEEN 1.4 AND 1.7)
 SELECT CAST(t.bin AS INTEGER) AS bin, count(b.bin) AS n FROM range(30) t(bin) LEFT JOIN b ON b.bin = t.bin GROUP BY 1""")
def hist_log_bins(s, d):
    return catalogue.log_histogram(_population(s, d), F.log10("value"), 1.4, 1.7, 30)


@query(_POP + """, q AS (SELECT label AS grp, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM population GROUP BY 1)
 SELECT grp, min(value) AS low, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median, round(any_value(q3), 9) AS q3, max(value) AS high FROM population JOIN q ON grp = label WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY grp""")
def box_five_number(s, d):
    out = catalogue.five_numbers(_population(s, d), F.col("label"), F.col("value"))
    return out.select("grp", "low", _r("q1").alias("q1"), _r("median").alias("median"), _r("q3").alias("q3"), "high")


# --- random graphs: invariants have SQL

def _null(s: SparkSession, d: str, how=nulls.stub_matchings) -> tuple[DataFrame, DataFrame]:
    real = selection.materialize(_pairs(s, d).select("pre", "post"), "real")
    seeds = s.createDataFrame([(0, 100), (1, 101)], "null_id long, seed long")
    return real, how(real, seeds)


_DEGREES = chain("degree") + " SELECT CAST(i AS BIGINT) AS null_id, node, in_degree, out_degree FROM degree, range(2) t(i)"


def _null_degrees(null: DataFrame) -> DataFrame:
    one = lambda i: graph.degrees(null.where(F.col("null_id") == i)).select(F.lit(i).cast("long").alias("null_id"), "node", "in_degree", "out_degree")
    return one(0).unionByName(one(1))


@query(_DEGREES)
def config_null_degree_check(s, d):
    return _null_degrees(_null(s, d)[1])


@query(chain("pairs") + " SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_self_loops, CAST(0 AS BIGINT) AS n_duplicates FROM pairs")
def config_null_no_dups(s, d):
    return nulls.simplicity(_null(s, d)[1].where("null_id = 1"))


@query(_DEGREES)
def maslov_sneppen_check(s, d):
    return _null_degrees(_null(s, d, nulls.swap_rounds)[1])


@query(_DEGREES)
def large_replicates_check(s, d):
    """Two graphs drawn by joins alone, as for graphs that no task could hold."""
    return _null_degrees(nulls.large_replicates(_pairs(s, d), s.createDataFrame([(0, 100), (1, 101)], "null_id long, seed long")))


@query(_DEGREES)
def swap_rounds_check(s, d):
    """Two graphs of ten swaps an edge by joins alone."""
    return _null_degrees(nulls.swap_rounds(_pairs(s, d), s.createDataFrame([(0, 100), (1, 101)], "null_id long, seed long")))


@query(chain("pairs") + " SELECT i AS null_id, (SELECT count(*) FROM pairs) AS n_edges, CAST(0 AS BIGINT) AS n_self_loops, CAST(0 AS BIGINT) AS n_duplicates, CAST(0 AS BIGINT) AS n_differences FROM range(100) t(i)")
def null_ensemble_faithful(s, d):
    """A hundred random graphs, drawn at once, each checked for its degrees, loops and repeated edges."""
    real = selection.materialize(_pairs(s, d).select("pre", "post"), "real")
    seeds = s.range(100).select(F.col("id").alias("null_id"), (F.col("id") + 100).alias("seed"))
    return nulls.faithful_ensemble(real, seeds)


@query(chain("degree") + " SELECT node, in_degree, out_degree FROM degree")
def stub_matching_check(s, d):
    return graph.degrees(nulls.stub_matching(_pairs(s, d), 5)).select("node", "in_degree", "out_degree")


@query(chain("pairs") + " SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_differences FROM pairs")
def null_degree_differences(s, d):
    real, null = _null(s, d)
    return real.agg(F.count("*").alias("n_edges")).crossJoin(nulls.degree_differences(real, null.where("null_id = 0")).agg(F.count("*").alias("n_differences")))


@query("SELECT CAST(i AS BIGINT) AS null_id, CAST(100 + i AS BIGINT) AS seed, true AS ok, 'done' AS status FROM range(4) t(i)")
def null_worker_contract(s, d):
    p, targets, every, n = _whole(s, d)
    ids = sorted(r.node for r in targets.collect())  # the targets of a record are part of it
    panel = [r.node for r in every.where(F.col("pos") < 4).collect()]
    records = nulls.null_records(p, s.range(4).select(F.col("id").alias("null_id"), (F.col("id") + 100).alias("seed")), ids[::2], ids[1::2], panel, "v1")
    checked = jobs.record_checks(records, 100, "v1", n, p.count(), len(ids), len(ids[::2]), len(ids[1::2]))
    return checked.select("null_id", "seed", "ok", "status")


_LADDER = _POP + """, score AS (SELECT id, degree, value AS k8, round(value + in_degree / 10.0, 6) AS k16, round(value + out_degree / 10.0, 6) AS k32 FROM population),
 ranks AS (SELECT rank() OVER (ORDER BY k8) + (count(*) OVER (PARTITION BY k8) - 1) / 2 AS a, rank() OVER (ORDER BY k16) + (count(*) OVER (PARTITION BY k16) - 1) / 2 AS b, rank() OVER (ORDER BY k32) + (count(*) OVER (PARTITION BY k32) - 1) / 2 AS c FROM score),
 top AS (SELECT id, 'k8' AS tag FROM (SELECT id FROM score ORDER BY k8 DESC, id LIMIT 50) UNION ALL SELECT id, 'k16' FROM (SELECT id FROM score ORDER BY k16 DESC, id LIMIT 50) UNION ALL SELECT id, 'k32' FROM (SELECT id FROM score ORDER BY k32 DESC, id LIMIT 50))"""


@query(_LADDER + """ SELECT round(corr(a, b), 9) AS rho_8_16, round(corr(a, c), 9) AS rho_8_32, (SELECT count(*) FILTER (n = 2) / count(*) FROM (SELECT count(*) AS n FROM top WHERE tag <> 'k16' GROUP BY id)) AS jaccard_8_32,
 (SELECT count(*) FILTER (n = 3) / count(*) FROM (SELECT count(*) AS n FROM top GROUP BY id)) AS jaccard_all FROM ranks""")
def seed_and_k_stability(s, d):
    score = _population(s, d).select("id", F.col("value").alias("k8"), F.round(F.col("value") + F.col("in_degree") / 10.0, 6).alias("k16"), F.round(F.col("value") + F.col("out_degree") / 10.0, 6).alias("k32"))
    score = selection.materialize(score, "ladder")
    top = lambda c: stats.top_k(score, 50, c, "id").select("id", F.lit(c).alias("tag"))
    rho = lambda c: stats.spearman(score, "k8", c).select(_r("rho").alias(f"rho_8_{c[1:]}"))
    two, three = stats.jaccard(top("k8").unionByName(top("k32"))), stats.jaccard(top("k8").unionByName(top("k16")).unionByName(top("k32")))
    return rho("k16").crossJoin(rho("k32")).crossJoin(two.select(F.col("jaccard").alias("jaccard_8_32"))).crossJoin(three.select(F.col("jaccard").alias("jaccard_all")))


@query(_POP + """, v AS (SELECT value AS v FROM population WHERE value > 0), r AS (SELECT log10(min(v)) AS lo, log10(max(v)) AS hi FROM v)
 SELECT CAST(t.bin AS INTEGER) AS bin, count(b.bin) AS n FROM range(39) t(bin) LEFT JOIN (SELECT CAST(least(floor((log10(v) - lo) / ((hi - lo) / 39)), 38) AS INTEGER) AS bin FROM v, r) b ON b.bin = t.bin GROUP BY 1""")
def hist_log_spaced(s, d):
    p = selection.materialize(_population(s, d).where("value > 0"), "population")
    lo, hi = p.agg(F.log10(F.min("value")), F.log10(F.max("value"))).first()
    return catalogue.log_histogram(p, F.log10("value"), lo, hi, 39)


# --- records and manifests

def _records(s: SparkSession, d: str) -> DataFrame:
    """A result record for each customer: fields depend on the key, a few are wrong."""
    c, k = table(s, d, "customer"), F.col("c_custkey")
    cis = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda x: x * 0.1 + F.when(k % 13 == 0, 1.0).otherwise(0.0))
    return c.select(
        k.alias("null_id"), (k + F.when(k % 5 == 0, 1).otherwise(100)).alias("seed"), F.when(k % 7 == 0, "old").otherwise("v1").alias("code_version"), F.lit(10).alias("n_nodes"), F.lit(20).alias("n_edges_null"), F.lit(6).alias("n_pair_nodes"), F.lit(3).alias("n_gaba"),
        cis.alias("gaba_cis"), F.transform(cis, lambda x: x / 2).alias("ctrl_cis"), (k % 17 != 0).alias("no_self_loops"), F.lit(True).alias("no_duplicate_edges"), F.lit(True).alias("out_degree_exact_match"), F.when(k % 19 != 0, True).alias("in_degree_exact_match"),
        F.lit(0.1).alias("cliffs_delta"), F.when(k % 23 != 0, 0.2).alias("median_diff"),
    )


_OK = "c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 23 <> 0"


@query(f"SELECT c_custkey AS null_id, c_custkey % 5 <> 0 AS check_seed_correct, c_custkey % 13 <> 0 AS check_cis_valid, c_custkey % 19 <> 0 AS check_in_degree_exact, {_OK} AS ok FROM customer")
def record_contract(s, d):
    return jobs.record_checks(_records(s, d), 100, "v1", 10, 20, 6, 3, 3).select("null_id", "check_seed_correct", "check_cis_valid", "check_in_degree_exact", "ok")


@query(f"SELECT c_custkey AS null_id, CASE WHEN c_custkey >= 1000 THEN 'bad_id' WHEN c_custkey % 4 = 0 THEN 'skip' WHEN NOT ({_OK}) THEN 'reject' ELSE 'adopt' END AS verdict FROM customer")
def adopt_antijoin(s, d):
    checked = jobs.record_checks(_records(s, d), 100, "v1", 10, 20, 6, 3, 3)
    return jobs.adoption(checked, checked.where("null_id % 4 = 0").select("null_id"), 1000)


@query("""SELECT o_custkey - 10 AS null_id, o_orderkey, CASE WHEN o_custkey < 10 THEN 'bad_id' WHEN NOT coalesce(o_totalprice >= 100000, false) THEN 'reject'
 WHEN row_number() OVER (PARTITION BY o_custkey, o_totalprice >= 100000 ORDER BY o_orderdate, o_orderkey) = 1 THEN 'adopt' ELSE 'skip' END AS verdict FROM orders""")
def adoption_stream(s, d):
    """Orders as records of their customers that arrive on a stream: the verdict on each, with what was adopted as state."""
    folder = f"{shared_dir(s)}/adoption-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    records = s.readStream.schema(s.read.parquet(f"{d}/orders.parquet").schema).parquet(f"{d}/orders.parquet*")
    records = records.select((F.col("o_custkey") - 10).cast("long").alias("null_id"), "o_orderkey", "o_orderdate", (F.col("o_totalprice") >= 100_000).alias("ok"))
    s.conf.set(key, adoption.PROVIDER)
    try:
        adoption.adopt(records, f"{folder}/out", f"{folder}/checkpoint", 1 << 40, ["o_orderdate", "o_orderkey"]).awaitTermination()
    finally:
        s.conf.set(key, before) if before else s.conf.unset(key)
    return s.read.parquet(f"{folder}/out").select("null_id", "o_orderkey", "verdict")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS src, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS v FROM customer")
def last_wins_merge(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("first").alias("src"), F.col("c_acctbal").alias("v"))
    return jobs.last_wins(c, c.where("id % 3 = 0").select("id", F.lit("second").alias("src"), (F.col("v") + 1).alias("v")), "id")


@query("SELECT c_custkey AS null_id, c_acctbal AS v FROM customer")
def append_never_overwrites(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("null_id"), F.col("c_acctbal").alias("v"))
    return jobs.append_new(c.where("null_id % 2 = 0"), c.withColumn("v", F.when(F.col("null_id") % 2 == 0, F.col("v") + 5).otherwise(F.col("v"))), "null_id")


# a job for each order: those with a returned line have been started, those with an "F" order status reported failed;
# an order whose lines are all "F" has its result
_JOBS = """WITH results AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_linestatus = 'F')), started AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
 m AS (SELECT o_orderkey AS null_id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM results) THEN 'done' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderkey IN (SELECT l_orderkey FROM started) THEN 'running' ELSE 'pending' END AS status,
 CASE WHEN o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM started) THEN 1 ELSE 0 END AS attempts FROM orders)"""


def _order_jobs(s: SparkSession, d: str) -> DataFrame:
    orders, lines = table(s, d, "orders"), table(s, d, "lineitem")
    started = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("started", F.lit(True))
    text = F.lit(None).cast("string")
    told = orders.join(started, "o_orderkey", "left").select(F.col("o_orderkey").alias("null_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("started"), "running").alias("status"), text.alias("worker_id"), text.alias("error"), text.alias("result_file"))
    results = lines.groupBy(F.col("l_orderkey").alias("null_id")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("all_done")).where("all_done")
    manifest = jobs.mark(jobs.manifest_of(orders.select(F.col("o_orderkey").alias("id")), 100), told.where("status is not null"), "2024-01-01T00:00:00Z")
    return jobs.reconcile(manifest, results)


@query(_JOBS + " SELECT status, count(*) AS n FROM m GROUP BY status")
def manifest_status(s, d):
    return jobs.status_counts(_order_jobs(s, d))


@query(_JOBS + """ SELECT count(*) AS n_jobs, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status IN ('running', 'pending')) AS n_open,
 count(*) FILTER (status = 'done') / count(*) AS share_done, max(attempts) AS most_attempts FROM m""")
def manifest_progress(s, d):
    return jobs.progress(_order_jobs(s, d))


@query(_JOBS + " SELECT null_id, 'null_' || CASE WHEN null_id < 1000 THEN lpad(CAST(null_id AS VARCHAR), 3, '0') ELSE CAST(null_id AS VARCHAR) END AS null_name, null_id + 100 AS seed, status, attempts FROM m WHERE status <> 'done' AND attempts < 3")
def manifest_pending(s, d):
    """The jobs still to run."""
    return jobs.pending(_order_jobs(s, d)).select("null_id", "null_name", "seed", "status", "attempts")


@query("SELECT count(*) FILTER (o_totalprice % 2 < 1) AS n_verified, count(*) FILTER (o_totalprice % 2 >= 1) AS n_mismatch, CAST(0 AS BIGINT) AS n_missing FROM orders")
def verified_counts(s, d):
    price = F.col("o_totalprice")
    return catalogue.agreement_counts(table(s, d, "orders"), price, price + F.floor(price % 2))


@query("""WITH n AS (SELECT (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) AS regions),
 e AS (SELECT unnest(generate_series(nations - 1, nations + regions - 1)) AS i FROM n), k AS (SELECT unnest(generate_series(0, nations - 1)) AS i, nations + regions AS shift FROM n)
 SELECT 'ring' AS graph, i AS pre, (i + 1) % parts AS post FROM (SELECT unnest(generate_series(0, parts - 1)) AS i, parts FROM n) UNION ALL
 SELECT 'hub', 0, i FROM (SELECT unnest(generate_series(1, suppliers - 1)) AS i FROM n) UNION ALL SELECT 'hub', i, 0 FROM (SELECT unnest(generate_series(1, suppliers - 1)) AS i FROM n) UNION ALL
 SELECT 'barbell', a.i, b.i FROM k a, k b WHERE a.i <> b.i UNION ALL SELECT 'barbell', a.i + a.shift, b.i + b.shift FROM k a, k b WHERE a.i <> b.i UNION ALL
 SELECT 'barbell', i, i + 1 FROM e UNION ALL SELECT 'barbell', i + 1, i FROM e""")
def synthetic_graphs(s, d):
    """Graphs of known shape as large as the tables: a ring of parts, a hub of suppliers, cliques of nations."""
    n = {t: table(s, d, t).count() for t in ("part", "supplier", "nation", "region")}
    named = lambda g, name: g.select(F.lit(name).alias("graph"), "pre", "post")
    return named(synthetic.ring(s, n["part"]), "ring").unionByName(named(synthetic.hub(s, n["supplier"]), "hub")).unionByName(named(synthetic.barbell(s, n["nation"], n["region"]), "barbell"))


@query(chain("pairs") + " SELECT count(*) AS n, CAST(0.5 AS DOUBLE) AS max_diff, count(*) FILTER (syn_count_total % 10 = 0) AS n_off FROM pairs")
def value_agreement(s, d):
    p = _pairs(s, d).select(F.concat_ws("-", "pre", "post").alias("k"), F.col("syn_count_total").cast("double").alias("v"))
    return jobs.agreement(p, p.withColumn("v", F.when(F.col("v") % 10 == 0, F.col("v") + 0.5).otherwise(F.col("v"))), "k", "v")


@query(chain("pairs") + " SELECT count(*) FILTER (n_neuropils > 1) AS only_a, CAST(0 AS BIGINT) AS only_b FROM pairs")
def row_exactness(s, d):
    p = selection.materialize(_pairs(s, d), "pairs")
    return jobs.same_rows(p, p.where("n_neuropils = 1"))


# --- extensions: no counterpart in the graph pipeline

@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_events_tumbling(s, d):
    return streams.tumbling(table(s, d, "events")).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 hour THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 hour AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def x_events_session(s, d):
    return streams.sessions(table(s, d, "events"))


@query(chain("nodes", "degree") + " SELECT nt_type, super_class, count(*) AS n, CAST(sum(total_degree) AS BIGINT) AS degree FROM nodes JOIN degree USING (node) GROUP BY ROLLUP (nt_type, super_class)")
def x_rollup(s, d):
    return derive.nodes(s, d).join(graph.degrees(_pairs(s, d)), "node").rollup("nt_type", "super_class").agg(F.count("*").alias("n"), F.sum("total_degree").alias("degree"))


@query(chain("nodes", "degree") + " SELECT nt_type, super_class, nt_sign, count(*) AS n, CAST(sum(total_degree) AS BIGINT) AS degree FROM nodes JOIN degree USING (node) GROUP BY CUBE (nt_type, super_class, nt_sign)")
def x_cube(s, d):
    return derive.nodes(s, d).join(graph.degrees(_pairs(s, d)), "node").cube("nt_type", "super_class", "nt_sign").agg(F.count("*").alias("n"), F.sum("total_degree").alias("degree"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The 20 parts with most neighbours, with their labels: scan, join, window, two-level aggregation, top-k."""
    return stats.top_k(graph.degrees(_pairs(s, d), "syn_count_total").join(derive.nodes(s, d), "node"), 20, "total_degree", "node")


@query(chain("degree", "nodes") + """ SELECT node, in_degree, out_degree, total_degree, in_strength, out_strength, name, nt_type, nt_sign, super_class, size FROM degree JOIN nodes USING (node) ORDER BY total_degree DESC, node LIMIT 20""")
def top_degree_nodes(s, d):
    return flagship(s, d)
