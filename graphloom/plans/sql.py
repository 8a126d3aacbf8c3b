"""SQL of the derived tables, as common table expressions for the oracle statements."""

from __future__ import annotations

from ..functions.labels import SIGN_OF_LABEL
from .derive import LABEL_OF_TYPE, LINE_ORDER

LINES_IN_ORDER = ", ".join(LINE_ORDER)
_LABEL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_OF_TYPE.items()) + " END"
_SIGN = "CASE nt_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGN_OF_LABEL.items()) + " ELSE 'unknown' END"

CTES = {
    "raw_edges": f"""succ AS (
  SELECT l_orderkey, l_partkey AS pre, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS post, l_quantity, l_returnflag, l_linestatus FROM lineitem),
raw_edges AS (
  SELECT pre, post, l_returnflag || l_linestatus AS neuropil, CAST(l_quantity AS BIGINT) AS syn_count, o_orderpriority AS nt_type
  FROM succ JOIN orders ON o_orderkey = l_orderkey WHERE post IS NOT NULL AND pre <> post)""",
    "pairs": """majority AS (
  SELECT pre, post, nt_type FROM (SELECT pre, post, nt_type, sum(syn_count) AS w FROM raw_edges GROUP BY ALL) WHERE nt_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pre, post ORDER BY w DESC, nt_type) = 1),
pairs AS (
  SELECT pre, post, CAST(sum(syn_count) AS BIGINT) AS syn_count_total, any_value(m.nt_type) AS nt_type_edge, count(DISTINCT neuropil) AS n_neuropils
  FROM raw_edges LEFT JOIN majority m USING (pre, post) GROUP BY pre, post)""",
    "nodes": f"""labelled AS (SELECT p_partkey AS node, p_name AS name, {_LABEL} AS nt_type, p_brand AS super_class, p_size AS size FROM part),
nodes AS (SELECT node, name, nt_type, {_SIGN} AS nt_sign, super_class, size FROM labelled)""",
    "degree": """degree AS (
  SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS total_degree,
         CAST(sum(wi) AS BIGINT) AS in_strength, CAST(sum(wo) AS BIGINT) AS out_strength
  FROM (SELECT pre AS node, 0 AS i, 1 AS o, 0 AS wi, syn_count_total AS wo FROM pairs UNION ALL SELECT post, 1, 0, syn_count_total, 0 FROM pairs) GROUP BY node)""",
    "population": """population AS (
  SELECT d.node AS id, in_degree, out_degree, total_degree AS degree, round((in_strength + out_strength) / total_degree, 6) AS value, out_strength AS strength, nt_type AS label, super_class
  FROM degree d JOIN nodes n USING (node))""",
}
NEEDS = {"pairs": ["raw_edges"], "degree": ["pairs"], "population": ["degree", "nodes"]}


def chain(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the named tables after those that they need; a statement or further tables follow."""
    out: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(CTES[n] for n in out)
