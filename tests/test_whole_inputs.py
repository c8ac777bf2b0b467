"""Registered queries read all rows of their tables, also those that the driver's tables do not have."""

from docweave.plans import QUERIES


def test_louvain_takes_every_edge(spark, tmp_path):
    ends = [(1, 1), (1, 2), (2, 1), (2, 2), (41, 901), (41, 902), (42, 901), (42, 902)]
    rows = [("N", s, p, k % 5 + 1, float(k)) for k, (s, p) in enumerate(ends)]
    spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {}
    for r in QUERIES["louvain_communities"](spark, str(tmp_path)).collect():
        found.setdefault((r["version_id"], r["cluster"]), set()).add(r["id"])
    assert found == {("shop@N", 0): {"p1", "p2", "s1", "s2"}, ("shop@N", 1): {"p901", "p902", "s41", "s42"}}
    assert {r["node_count"] for r in QUERIES["cluster_labels"](spark, str(tmp_path)).collect()} == {4}


def test_sitemap_takes_every_page(spark, tmp_path):
    rows = [(k, f"{'https' if k >= 1100 else 'http'}://e.com/{k}") for k in range(1400)]
    spark.createDataFrame(rows, "page_id long, url string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    assert [r["url"] for r in QUERIES["sitemap_urls"](spark, str(tmp_path)).collect()] == [f"https://e.com/{k}" for k in range(1100, 1300)]
