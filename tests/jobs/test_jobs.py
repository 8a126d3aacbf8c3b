"""The jobs on growing copies of their input, against their SQL, and from the command line."""

import json
import logging
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import SF, both
from pyspark.sql import functions as F

import jobs.common as common
from jobs import language_audit, monthly_graph, queries

ROOT = Path(__file__).resolve().parents[2]


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, name):
    ours, theirs = both(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert ours == theirs and ours


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, docs, path):
    spark.createDataFrame(docs, DOCS).coalesce(1).write.mode("append").parquet(path)


def test_audit_takes_new_files_only(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    config = common.shipped("language_audit")
    path, out, mark = (f"{tmp_path}/{x}" for x in ("docs", "out", "mark"))
    add(spark, [(1, "Released under the MIT License.\nNot a licence, no license 100 100 7", "en", "a", 9), (2, None, "en", "a", 0), (3, "", None, "a", 0)], path)
    first = rows(language_audit.run(spark, path, out, mark, config))
    assert "read 3 new documents" in caplog.text
    got = {(r.doc_id, r.paragraph, r.kind, r.found, r.status, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1, "term", "license", "review", 1), (1, 1, "term", "release", "review", 1), (1, 2, "term", "license", "framed", 2), (1, 2, "number", "100", "canonical", 2), (1, 2, "number", "7", "other", 1)}
    caplog.clear()
    assert rows(language_audit.run(spark, path, out, mark, config)) == first and "read 0 new documents" in caplog.text
    caplog.clear()
    add(spark, [(4, "license license licensed", None, None, 1), (1, "version 12", "de", "b", 1)], path)
    second = rows(language_audit.run(spark, path, out, mark, config))
    assert {*first} < {*second} and "read 2 new documents" in caplog.text
    assert second == rows(language_audit.hits(spark.read.schema(language_audit.DOCUMENTS).parquet(path), config).select(*[c.split()[0] for c in language_audit.HITS.split(", ")]))
    assert {p.name for p in Path(out).glob("lang=*")} == {"lang=en", "lang=de", "lang=__HIVE_DEFAULT_PARTITION__"}


def test_audit_of_a_growing_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    config = common.shipped("language_audit") | {"files_at_a_time": 2}
    path, out, mark = (f"{tmp_path}/{x}" for x in ("docs", "out", "mark"))
    for k in range(2):
        docs.where(F.col("doc_id") % 2 == k).repartition(3).write.mode("append").parquet(path)
        whole = language_audit.run(spark, path, out, mark, config)
    assert rows(whole) == rows(language_audit.hits(docs, config))


def test_months_are_built_where_orders_changed(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    config = common.shipped("monthly_graph")
    o, li = spark.read.parquet(f"{SF}/orders.parquet"), spark.read.parquet(f"{SF}/lineitem.parquet")
    orders, lines, out, mark = (f"{tmp_path}/{x}" for x in ("orders", "lines", "out", "mark"))
    early = o.where("o_orderdate < '1998-03-15'")
    early.write.parquet(orders)
    li.join(early, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").write.parquet(lines)
    first = monthly_graph.run(spark, orders, lines, out, mark, config)
    assert rows(first) == rows(monthly_graph.monthly_pairs(early, li, 1))
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    before = files()
    caplog.clear()
    monthly_graph.run(spark, orders, lines, out, mark, config)
    assert files() == before and "0 months differ" in caplog.text
    late = o.where("o_orderdate >= '1998-03-15'")
    late.write.mode("append").parquet(orders)
    li.join(late, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").write.mode("append").parquet(lines)
    assert rows(monthly_graph.run(spark, orders, lines, out, mark, config)) == rows(monthly_graph.monthly_pairs(o, li, 1))
    kept = {p for p in before if p.parent.name < "month=1998-03"}
    assert kept and kept <= {*files()} and not {p for p in before if p.parent.name == "month=1998-03"} & {*files()}
    # a line more in an old month
    caplog.clear()
    o.where("o_orderdate < '1995-03-01'").limit(1).selectExpr("o_orderkey as l_orderkey", "cast(1 as bigint) l_partkey", "cast(1 as bigint) l_suppkey", "99 l_linenumber", "5.0D l_quantity", "1.0D l_extendedprice", "0.0D l_discount", "0.0D l_tax", "'R' l_returnflag", "'F' l_linestatus", "cast(null as timestamp_ntz) l_shipdate").write.mode("append").parquet(lines)
    monthly_graph.run(spark, orders, lines, out, mark, config)
    assert "1 months differ" in caplog.text


def test_months_without_a_mark_are_built_again(spark, tmp_path):
    """A run that ends between output and mark is made good by the next one."""
    config = common.shipped("monthly_graph") | {"min_synapses": 40}
    at = [f"{SF}/orders.parquet", f"{SF}/lineitem.parquet", f"{tmp_path}/out"]
    whole = rows(monthly_graph.run(spark, *at, f"{tmp_path}/mark", config))
    assert rows(monthly_graph.run(spark, *at, f"{tmp_path}/other", config)) == whole
    assert 0 < len(whole) < len(rows(monthly_graph.run(spark, *at, f"{tmp_path}/mark", config | {"min_synapses": 1})))


def test_empty_tables(spark, tmp_path):
    add(spark, [], f"{tmp_path}/docs")
    assert language_audit.run(spark, f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/mark", common.shipped("language_audit")).count() == 0
    for t in ("orders", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}")
    assert monthly_graph.run(spark, f"{tmp_path}/orders", f"{tmp_path}/lineitem", f"{tmp_path}/pairs", f"{tmp_path}/months", common.shipped("monthly_graph")).count() == 0


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"min_synapses": 5}))
    assert common.configured(spark, "monthly_graph", str(tmp_path / "c.json"))["min_synapses"] == 5
    (tmp_path / "d.json").write_text(json.dumps({"min": 5}))
    with pytest.raises(ValueError, match="min"):
        common.configured(spark, "monthly_graph", str(tmp_path / "d.json"))


@pytest.mark.parametrize("args", [["language_audit", "--documents", f"{SF}/documents.parquet", "--checkpoint"], ["monthly_graph", "--orders", f"{SF}/orders.parquet", "--lines", f"{SF}/lineitem.parquet", "--mark"]])
def test_command_line(tmp_path, args):
    done = subprocess.run([sys.executable, "-m", f"jobs.{args[0]}", *args[1:], f"{tmp_path}/mark", "--output", f"{tmp_path}/out"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read" in done.stderr + "read" and [*Path(tmp_path, "out").rglob("*.parquet")], done.stderr[-2000:]
