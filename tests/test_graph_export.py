"""The export of a graph as JSON lines: whole, in order, and dealt over tasks."""

import json
from pathlib import Path

from docweave.plans import QUERIES
from docweave.sources import files


def test_lines_are_whole_and_in_order(spark, tmp_path):
    rows = [(k * 7919 % 20000, f"n{k}", "x\ny" if k % 2 else None, f"l@{k % 2}") for k in range(20000)]
    nodes = spark.createDataFrame(rows, "ord long, id string, name string, version_id string")
    edges = spark.createDataFrame([(1, "n2", "n4", 0.5, "l@0"), (0, "n4", "n2", None, "l@0")], "ord long, source string, target string, score double, version_id string")
    folder = str(tmp_path / "graph")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_graph_lines(nodes, edges, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(Path(folder, "nodes").glob("*/part-*"))) > 2  # no task has all of a version
    for k in (0, 1):
        parts = sorted(Path(folder, "nodes", f"version_id=l@{k}").glob("part-*"))
        lines = [json.loads(r["value"]) for p in parts for r in spark.read.text(str(p)).collect()]
        assert [(x["ord"], x["id"], x.get("name")) for x in lines] == sorted(r[:3] for r in rows if r[3] == f"l@{k}")
    assert sorted((json.loads(r["value"]) for r in files.read_graph_lines(spark, folder, "edges").collect()), key=lambda x: x["ord"]) == [{"ord": 0, "source": "n4", "target": "n2"}, {"ord": 1, "source": "n2", "target": "n4", "score": 0.5}]
    found = {r["version_id"]: json.loads(r["value"]) for r in files.read_graph_lines(spark, folder, "metadata").collect()}
    assert found == {"l@0": {"node_count": 10000, "edge_count": 2, "format": "property_graph"}, "l@1": {"node_count": 10000, "edge_count": 0, "format": "property_graph"}}


def test_no_row_holds_the_graph(spark, monkeypatch):
    monkeypatch.setattr(files, "graph_json", None)
    assert QUERIES["graph_export"](spark, "/root/testdata/sf0.001").first()["node_count"] > 0


def test_export_of_nothing(spark, tmp_path):
    schemas = {"part": "p_partkey long, p_name string, p_size int, p_brand string", "orders": "o_orderkey long, o_orderpriority string", "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert tuple(QUERIES["graph_export"](spark, str(tmp_path)).first()) == ("shop@1", 0, None, 0, None, 0, 0)
