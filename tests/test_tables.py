"""Readers and writers on hand-written files."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import labels
from graphloom.operators import graph, jobs
from graphloom.sources import sinks, tables


def put(folder, name, text):
    with gzip.open(folder / f"{name}.csv.gz", "wt", newline="") as f:
        f.write(text)


@pytest.fixture()
def folder(tmp_path):
    put(tmp_path, "neurons", "root_id,group,nt_type,nt_type_score\n720575940000000001,A,GABA,0.9\n720575940000000002,B,,\n720575940000000003,B,XX,0.1\n720575940000000004,C,GLUT,0.7\n")
    put(tmp_path, "names", "root_id,name,group\n720575940000000001,n1,A\n720575940000000002,n2,B\n")
    put(tmp_path, "classification", "root_id,flow,super_class,class,sub_class,hemilineage,side,nerve\n720575940000000001,intrinsic,optic,c,s,h,,n\n")
    put(tmp_path, "consolidated_cell_types", "root_id,primary_type,additional_type(s)\n720575940000000001,T4b,\n")
    put(tmp_path, "visual_neuron_types", "root_id,type,family,subsystem,category,side\n720575940000000001,T4b,T4,motion,x,left\n")
    put(tmp_path, "connections_princeton_thresholded", "pre_root_id,post_root_id,neuropil,syn_count,nt_type\n1,2,AL_R\r,5,GABA\n1,2,AL_L, 3 ,ACH\n1,2,AL_R,2,ACH\n2,2,,1,\n".replace(" 3 ", "3"))
    return tmp_path


def test_core_and_edges(spark, folder):
    core = {r.root_id % 10: r for r in tables.neuron_core(spark, str(folder)).collect()}
    assert [core[k].nt_sign for k in (1, 2, 3, 4)] == ["inhibitory", "unknown", "unknown", "glut"]
    assert core[1].visual_type == "T4b" and core[1].side is None and core[3].name is None and len(core) == 4
    e = tables.edge_table(spark, str(folder))
    assert {r.neuropil for r in e.collect()} == {"AL_R", "AL_L", None}
    got = {(r.pre, r.post): r[2:] for r in graph.collapse(e).collect()}
    assert got == {(1, 2): (10, "ACH", 2), (2, 2): (1, None, 0)}  # a tie of 5 goes to the first in alphabetical order
    with pytest.raises(KeyError):
        tables.edge_table(spark, str(folder), "nothing")
    with pytest.raises(KeyError):
        tables.node_table(spark, str(folder), "nothing")


def test_duplicate_key_is_an_error(spark, folder):
    put(folder, "names", "root_id,name,group\n720575940000000001,n1,A\n720575940000000001,n2,B\n")
    with pytest.raises(ValueError):
        tables.neuron_core(spark, str(folder))


def test_cells_and_other_tables(spark, tmp_path):
    put(tmp_path, "labels", "root_id,processed_labels\n1,\"['A; X_1', 'B']\"\n2,plain\n3,\n")
    got = {r.root_id: r.processed_labels for r in tables.processed_labels(spark, str(tmp_path / "labels.csv.gz")).collect()}
    assert got == {1: ["A; X_1", "B"], 2: ["plain"], 3: None}
    put(tmp_path, "xyz", 'root_id,position,supervoxel_id\n1,"[1  2.5 -3]",9\n1,"[ 4 5 6 ]",8\n')
    rows = sorted(tuple(r) for r in tables.coordinates(spark, str(tmp_path / "xyz.csv.gz")).collect())
    assert rows == [(1, 8, 4.0, 5.0, 6.0), (1, 9, 1.0, 2.5, -3.0)]
    put(tmp_path, "syn", "pre_root_id_720575940,post_root_id_720575940,x,y,z,size,neuropil\n000000012,000000345,1,2,3,4,AL\n")
    r = tables.synapse_table(spark, str(tmp_path / "syn.csv.gz"), ["pre_root_id", "post_root_id"], 2).first()
    assert tuple(r) == (720575940000000012, 720575940000000345)
    put(tmp_path, "rates", "neuropil,count_total,count_proof,proof_ratio,side\nAL,10,5,0.5,left\nAL,10,6,0.6,right\n")
    assert tables.attachment_rates(spark, str(tmp_path / "rates.csv.gz")).agg(F.sum("count_proof")).first()[0] == 11
    for k, text in enumerate(['{"null_id": 1, "v": 0.5}', "{broken", '{"null_id": 2, "v": null}']):
        (tmp_path / f"row_{k}.json").write_text(text)
    got = tables.json_records(spark, str(tmp_path / "row_*.json"), schema="null_id long, v double").where("null_id is not null")
    assert sorted(r.null_id for r in got.collect()) == [1, 2]


def test_forward_fill_and_ids(spark):
    df = spark.createDataFrame([(0, None), (1, 5), (2, None), (3, None), (4, 7), (5, None)], "row long, id long")
    assert [r.id for r in tables.forward_filled(df, "row", "id", block=2).orderBy("row").collect()] == [None, 5, 5, 5, 7, 7]
    ids = spark.createDataFrame([(720575940000000001,), (5,), (None,)], "i long")
    assert [r[0] for r in ids.select(labels.is_id(F.col("i"))).collect()] == [True, False, None]
    assert tuple(jobs.id_report(ids, "i").first()) == ("i", 3, 1, "5", "720575940000000001", False)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "a_b"), (2, None, "50%")], "null_id long, v double, s string")
    sinks.parquet(df, str(tmp_path / "t"))
    assert sinks.append_rows(df.unionByName(df.withColumn("null_id", F.col("null_id") + 5)), str(tmp_path / "t"), "null_id") == 2
    assert sinks.append_rows(df, str(tmp_path / "t"), "null_id") == 0
    assert sinks.append_rows(df, str(tmp_path / "new"), "null_id") == 2
    sinks.csv(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    sinks.report(df, tmp_path / "r.json")
    sinks.report({"n": 3, "when": np.float64(1)}, tmp_path / "d.json")
    assert json.loads((tmp_path / "r.json").read_text())[1]["v"] is None and json.loads((tmp_path / "d.json").read_text())["n"] == 3
    tex = sinks.latex(df, "Caption", "tab:x")
    assert r"a\_b" in tex and r"50\%" in tex and "--" in tex
    e = spark.createDataFrame([(3, 1), (0, 2)], "pre long, post long")
    sinks.npz(e, (4, 4), str(tmp_path / "g.npz"))
    back, shape = tables.npz_edges(spark, str(tmp_path / "g.npz"))
    assert shape == (4, 4) and jobs.same_rows(back, e).first()[:] == (0, 0)
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack" / "a.txt").write_text("x")
    assert sinks.archive(tmp_path / "pack", tmp_path / "p.zip") == ["a.txt"]
    with pytest.raises(ValueError):
        sinks.archive(tmp_path / "pack", tmp_path / "p.zip", ("a.",))
    h = jobs.file_hashes(spark, str(tmp_path / "pack" / "a.txt")).first()
    import hashlib

    assert h.sha256 == hashlib.sha256(b"x").hexdigest() and h.length == 1
