"""The jobs as queries: each runs twice into a new folder; what stands there then is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.sql import LINES_IN_ORDER
from graphloom.storage import shared_dir

from . import language_audit, monthly_graph
from .common import shipped


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_language_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and numbers of all paragraphs of ``documents``, by a stream."""
    at, config = _folder(spark, "language-audit"), shipped("language_audit")
    for _ in range(2):
        out = language_audit.run(spark, f"{sf_dir}/documents.parquet", f"{at}/hits", f"{at}/checkpoint", config)
    return out


def job2_monthly_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair graph of each month of ``orders``."""
    at, config = _folder(spark, "monthly-graph"), shipped("monthly_graph")
    for _ in range(2):
        out = monthly_graph.run(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet", f"{at}/pairs", f"{at}/mark", config)
    return out


_AUDIT = shipped("language_audit")


def _sql_audit() -> str:
    whole = language_audit.whole
    framed = " OR ".join(f"regexp_matches(p, '{whole(c)}')" for c in _AUDIT["contexts"])
    terms = " UNION ALL ".join(
        f"SELECT doc_id, source, lang, paragraph, 'term' AS kind, '{name}' AS found, CASE WHEN {framed} THEN 'framed' ELSE 'review' END AS status, len(regexp_extract_all(regexp_replace(p, '([^a-z0-9])', '\\1\\1', 'g'), '{whole(p)}')) AS n FROM paras"
        for name, p in sorted(_AUDIT["terms"].items())
    )
    canonical = ", ".join(f"'{x}'" for x in _AUDIT["canonical"])
    return f"""
WITH split AS (SELECT doc_id, source, lang, string_split(translate(text, '{language_audit.UPPER}', '{language_audit.LOWER}'), chr(10)) AS ps FROM documents WHERE text IS NOT NULL),
paras AS (
  SELECT doc_id, source, lang, CAST(k AS INTEGER) AS paragraph, ' ' || trim(regexp_replace(ps[k], '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) || ' ' AS p
  FROM split, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS k)),
terms AS ({terms}),
numbers AS (
  SELECT doc_id, source, lang, paragraph, 'number' AS kind, found, CASE WHEN found IN ({canonical}) THEN 'canonical' ELSE 'other' END AS status, count(*) AS n
  FROM (SELECT doc_id, source, lang, paragraph, row, unnest(regexp_extract_all(p, '{_AUDIT["number"]}')) AS found FROM (SELECT *, row_number() OVER () AS row FROM paras))
  GROUP BY doc_id, source, lang, paragraph, row, found)
SELECT doc_id, source, lang, paragraph, kind, found, status, CAST(n AS INTEGER) AS n FROM (SELECT * FROM terms WHERE n > 0 UNION ALL SELECT * FROM numbers)
"""


SQL_MONTHS = f"""
WITH succ AS (
  SELECT l_orderkey, l_partkey AS pre, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {LINES_IN_ORDER}) AS post, l_quantity, l_returnflag || l_linestatus AS neuropil FROM lineitem),
edges AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, pre, post, neuropil, CAST(l_quantity AS BIGINT) AS syn_count, o_orderpriority AS nt_type
  FROM succ JOIN orders ON o_orderkey = l_orderkey WHERE post IS NOT NULL AND pre <> post AND o_orderdate IS NOT NULL),
majority AS (
  SELECT month, pre, post, nt_type FROM (SELECT month, pre, post, nt_type, sum(syn_count) AS w FROM edges GROUP BY ALL) WHERE nt_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY month, pre, post ORDER BY w DESC, nt_type) = 1)
SELECT month, pre, post, CAST(sum(syn_count) AS BIGINT) AS syn_count_total, any_value(m.nt_type) AS nt_type_edge, count(DISTINCT neuropil) AS n_neuropils
FROM edges LEFT JOIN majority m USING (month, pre, post) GROUP BY month, pre, post HAVING sum(syn_count) >= {shipped("monthly_graph")["min_synapses"]}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_language_audit": job1_language_audit, "job2_monthly_graph": job2_monthly_graph}
ORACLES: dict[str, str] = {"job1_language_audit": _sql_audit(), "job2_monthly_graph": SQL_MONTHS}
