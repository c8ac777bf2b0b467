"""Queries over a composed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import community, graph, index, retrieval
from docweave.session import cut_lineage, new_path, remove
from docweave.sources import files

from . import compose
from .compose import EDGES, NODES
from .registry import query, table

QUESTION = "how do i use red widget3 and blue bolt2 with small ring"
_N = f"n AS ({NODES})"
_LAST = f"{_N}, g AS (SELECT id, min(ord) AS ord, max_by(node_type, ord) AS node_type, max_by(name, ord) AS name, arg_max(struct_pack(k := kind), ord).k AS kind, arg_max(struct_pack(k := signature), ord).k AS signature FROM n GROUP BY id)"
_RESOLVED = f"{_N}, w AS (SELECT name, max_by(id, ord) AS id FROM n GROUP BY name), e AS ({EDGES}), i AS (SELECT DISTINCT id FROM n), x AS (SELECT coalesce(a.id, e.source) AS source, coalesce(b.id, e.target) AS target, e.ord, e.type, e.score FROM e LEFT JOIN w a ON e.source = a.name LEFT JOIN w b ON e.target = b.name), r AS (SELECT x.* FROM x WHERE source IN (SELECT id FROM i) AND target IN (SELECT id FROM i))"
_DEDUP = _RESOLVED + ", d AS (SELECT source, target, min(ord) AS ord, arg_max(type, ord) AS type, arg_max(score, ord) FILTER (WHERE score IS NOT NULL) AS score FROM r GROUP BY source, target)"


def _last(spark: SparkSession, folder: str) -> DataFrame:
    return graph.nodes_last_wins(compose.nodes(spark, folder))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return graph.resolve_edges(compose.edges(spark, folder), compose.nodes(spark, folder))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges_last_wins(_resolved(spark, folder))


@query("graph_nodes_last_wins", f"WITH {_LAST} SELECT id, ord, node_type, name, kind, signature FROM g")
def graph_nodes_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    return _last(spark, folder)


@query("name_to_id", f"WITH {_N} SELECT name, max_by(id, ord) AS id FROM n GROUP BY name")
def name_to_id(spark: SparkSession, folder: str) -> DataFrame:
    return graph.name_to_id(compose.nodes(spark, folder))


@query("edges_resolved", f"WITH {_RESOLVED} SELECT source, target, ord, type, score FROM r")
def edges_resolved(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder)


@query("edges_dedup", f"WITH {_DEDUP} SELECT source, target, ord, type, score FROM d")
def edges_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@query("structural_edges", f"WITH {_LAST} SELECT 'shop@1' AS source, id AS target, ord, CASE node_type WHEN 'symbol' THEN 'EXPORTS' ELSE 'HAS_GUIDE' END AS type, 'EXTRACTED' AS confidence FROM g")
def structural_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.structural_edges(_last(spark, folder).withColumn("version_id", F.lit("shop@1")))


@query("version_nodes", """WITH v AS (SELECT 'lib' || n_regionkey AS library_id, '1.' || n_nationkey AS version, '1.' || max(n_nationkey) OVER (PARTITION BY n_regionkey) AS latest FROM nation)
SELECT DISTINCT library_id AS id, 'library' AS node_type, false AS is_latest FROM v UNION ALL SELECT library_id || '@' || version, 'version', version = latest FROM v""")
def version_nodes(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    latest = n.groupBy("n_regionkey").agg(F.concat(F.lit("1."), F.max("n_nationkey")).alias("latest_version"))
    return graph.version_nodes(n.join(latest, "n_regionkey").select(F.concat(F.lit("lib"), "n_regionkey").alias("library_id"), F.concat(F.lit("1."), "n_nationkey").alias("version"), "latest_version"))[0].withColumn("is_latest", F.coalesce("is_latest", F.lit(False)))


@query("version_stats", f"WITH {_DEDUP}, z AS (SELECT DISTINCT id, node_type FROM n) SELECT 'shop@1' AS version_id, count(*) AS total_nodes, count(*) FILTER (WHERE node_type = 'symbol') AS symbols, count(*) FILTER (WHERE node_type = 'guide') AS guides, 0::BIGINT AS configs, (SELECT count(*) FROM d) AS total_edges FROM z")
def version_stats(spark: SparkSession, folder: str) -> DataFrame:
    v = F.lit("shop@1").alias("version_id")
    return graph.version_stats(_last(spark, folder).select("*", v), _edges(spark, folder).select("*", v))


@query("edge_type_stats", f"WITH {_DEDUP} SELECT type, count(*) AS n, count(score) AS scored, round(avg(score), 6) AS mean_score FROM d GROUP BY type")
def edge_type_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("degree_topk", f"WITH {_DEDUP}, u AS (SELECT source AS id, 1 AS o, 0 AS i FROM d UNION ALL SELECT target, 0, 1 FROM d) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM u GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def degree_topk(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_edges(spark, folder)).orderBy(F.desc("degree"), "id").limit(20)


@query("guide_references", """WITH g AS (SELECT DISTINCT 'g' || l_orderkey AS source, CASE WHEN l_linenumber % 3 = 0 THEN 'x' ELSE 's' END || l_partkey AS target FROM lineitem)
SELECT source, target, 'REFERENCES' AS type, 'EXTRACTED' AS confidence FROM g WHERE target IN (SELECT 's' || p_partkey FROM part)""")
def guide_references(spark: SparkSession, folder: str) -> DataFrame:
    """Every line's part; of each third line the name is one that no part has."""
    name = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "x").otherwise("s"), "l_partkey")
    g = table(spark, folder, "lineitem").groupBy(F.concat(F.lit("g"), "l_orderkey").alias("id")).agg(F.collect_set(name).alias("related_symbols"))
    return graph.references(g, table(spark, folder, "part").select(F.concat(F.lit("s"), "p_partkey").alias("id")))


@query("symbol_index", f"WITH {_N}, o AS (SELECT name, id, min(ord) AS ord FROM n GROUP BY name, id) SELECT name, string_agg(id, ',' ORDER BY ord, id) AS ids, count(*) AS n FROM o GROUP BY name")
def symbol_index(spark: SparkSession, folder: str) -> DataFrame:
    return index.grouped(index.flat(compose.nodes(spark, folder))).select("name", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("category_index", "SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_nationkey) AS ids FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def category_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_name").alias("id"), F.col("n_nationkey").alias("ord"))
    return index.grouped(rows).select("name", F.array_join("ids", ",").alias("ids"))


@query("language_index", "SELECT lang AS name, string_agg(source, ',' ORDER BY source) AS ids FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def language_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("lang").alias("name"), F.col("source").alias("id"), F.lit(0).alias("ord")).distinct()
    return index.grouped(rows).select("name", F.array_join("ids", ",").alias("ids"))


@query("keyword_query_top20", f"WITH {_LAST} SELECT name, id, kind, substr(signature, 1, 60) AS signature, 'shop' AS library, '1' AS version FROM (SELECT * FROM g WHERE contains(lower(name), 'widget') ORDER BY name, ord, id LIMIT 20)")
def keyword_query_top20(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _last(spark, folder)
    return retrieval.with_details(retrieval.keyword_query(index.flat(nodes), "WIDGET", "shop", "1"), nodes)


@query("word_match_seeds", f"WITH {_LAST} SELECT id, name, ord FROM g WHERE length(name) >= 4 AND regexp_matches('{QUESTION}', '(?i)\\b' || name || '\\b') ORDER BY ord, id LIMIT 5")
def word_match_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.seeds(_last(spark, folder), QUESTION).select("id", "name", "ord")


_SEEDS = f"s AS (SELECT id, ord FROM (SELECT id, min(ord) AS ord, max_by(name, ord) AS name FROM n GROUP BY id) WHERE length(name) >= 4 AND regexp_matches('{QUESTION}', '(?i)\\b' || name || '\\b') ORDER BY ord, id LIMIT 5)"


@query("one_hop_neighbors", f"WITH {_DEDUP}, {_SEEDS} SELECT s.id AS seed, target AS neighbour, type, 'out' AS direction, d.ord FROM d JOIN s ON source = s.id UNION ALL SELECT s.id, source, type, 'in', d.ord FROM d JOIN s ON target = s.id")
def one_hop_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(_edges(spark, folder), retrieval.seeds(_last(spark, folder), QUESTION).select("id"))


@query("graph_context", f"""WITH {_DEDUP}, {_SEEDS}, h AS (SELECT target AS id, d.ord FROM d JOIN s ON source = s.id UNION ALL SELECT source, d.ord FROM d JOIN s ON target = s.id),
k AS (SELECT id, min(ord) AS ord FROM h WHERE id NOT IN (SELECT id FROM s) GROUP BY id ORDER BY ord, id LIMIT 15)
SELECT id, 'seed' AS role, ord FROM s UNION ALL SELECT id, 'neighbour', ord FROM k""")
def graph_context(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.context_nodes(_last(spark, folder), _edges(spark, folder), QUESTION)


@query("symbol_details", f"WITH {_LAST} SELECT id, name, kind, signature FROM g WHERE id = 'shop@1::red widget3'")
def symbol_details(spark: SparkSession, folder: str) -> DataFrame:
    return _last(spark, folder).where(F.col("id") == "shop@1::red widget3").select("id", "name", "kind", "signature")


@query("full_context", f"WITH {_LAST} SELECT CASE WHEN node_type = 'guide' THEN 1 ELSE 2 END AS section, ord AS place, '## ' || name || CASE WHEN node_type = 'guide' THEN ' (guide)' ELSE ' (' || kind || ')' END || coalesce(chr(10) || nullif(signature, ''), '') AS text FROM g")
def full_context(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.full_context(_last(spark, folder).withColumn("description", F.lit(None).cast("string")))


@query("context_routes", f"WITH {_LAST}, f AS (SELECT CASE WHEN node_type = 'guide' THEN name ELSE kind END AS k, '## ' || name || CASE WHEN node_type = 'guide' THEN ' (guide)' ELSE ' (' || kind || ')' END || coalesce(chr(10) || nullif(signature, ''), '') AS text FROM g) SELECT left(k, 9) AS part, sum(octet_length(encode(text)))::BIGINT AS bytes, CASE WHEN sum(octet_length(encode(text))) < 60000 THEN 'full' ELSE 'graph' END AS route FROM f GROUP BY left(k, 9)")
def context_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The operator's own threshold, over parts of the graph: kinds of symbols, and guides by the beginning of their title."""
    nodes = _last(spark, folder).withColumn("description", F.lit(None).cast("string"))
    part = F.left(F.when(F.col("node_type") == "guide", F.col("name")).otherwise(F.col("kind")), F.lit(9))
    return retrieval.route(nodes.withColumn("part", part), "part")


@query("graph_export", f"""WITH {_DEDUP}, {_LAST[len(_N) + 2 :]},
q AS (SELECT 'shop@1' AS version_id, sum(ord)::HUGEINT AS ords, count(*) AS node_count, count(kind) AS kinds, sum(length(signature))::BIGINT AS signed FROM g)
SELECT version_id, node_count, ords::VARCHAR AS ords, kinds, signed, (SELECT count(*) FROM d) AS edge_count, (SELECT count(score) FROM d) AS scored FROM q""")
def graph_export(spark: SparkSession, folder: str) -> DataFrame:
    """The exported JSON lines read again: nothing of nodes and edges is lost."""
    v, path = F.lit("shop@1").alias("version_id"), new_path(spark)
    files.write_graph_lines(_last(spark, folder).select("*", v), _edges(spark, folder).select("*", v), path)
    read = lambda name, fields: files.read_graph_lines(spark, path, name).select(F.from_json("value", fields).alias("j")).select("j.*")
    nodes = read("nodes", "ord long, kind string, signature string").agg(F.sum(F.col("ord").cast("decimal(38,0)")).cast("string").alias("ords"), F.count("kind").alias("kinds"), F.sum(F.length("signature")).alias("signed"))
    edges = read("edges", "score double").agg(F.count("score").alias("scored"))
    counts = read("metadata", "node_count long, edge_count long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("node_count", "edge_count")])
    out = cut_lineage(counts.crossJoin(nodes).crossJoin(edges).select(v, "node_count", "ords", "kinds", "signed", "edge_count", "scored"))
    remove(spark, path)
    return out


@query("full_context_router", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, CASE WHEN sum(octet_length(encode(text))) < 60000 THEN 'full' ELSE 'graph' END AS route FROM documents GROUP BY source")
def full_context_router(spark: SparkSession, folder: str) -> DataFrame:
    size = F.sum(F.octet_length("text")).cast("long")
    return table(spark, folder, "documents").groupBy("source").agg(size.alias("bytes")).withColumn("route", F.when(F.col("bytes") < retrieval.FULL_BYTES, "full").otherwise("graph"))


@query("library_status_rollup", """WITH k AS (SELECT n_name AS library, 'symbols' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT n_name, 'guides' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'edges' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT CASE WHEN grouping(library) = 1 THEN 'TOTAL' ELSE library END AS library, count(*) FILTER (WHERE kind = 'symbols') AS symbols, count(*) FILTER (WHERE kind = 'guides') AS guides, count(*) FILTER (WHERE kind = 'edges') AS edges FROM k GROUP BY ROLLUP (library)""")
def library_status_rollup(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    nation = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("library"))
    guides = t("customer").join(nation, F.col("c_nationkey") == F.col("k"))
    return retrieval.status(t("supplier").join(nation, F.col("s_nationkey") == F.col("k")), guides, t("orders").join(guides, F.col("o_custkey") == F.col("c_custkey")))


_LINKS = """SELECT 'c' || o_custkey AS source, 'k' || o_orderkey AS target FROM orders UNION ALL SELECT 's' || l_suppkey || '-' || l_linenumber || l_returnflag, 'p' || l_partkey || '-' || l_linenumber || l_returnflag FROM lineitem
UNION ALL SELECT 'p' || l_partkey || '-' || l_linenumber || l_returnflag, 'q' || l_orderkey || '-' || l_linenumber FROM lineitem"""


@query("connected_components", f"""WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM ({_LINKS})), b AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
r(id, root) USING KEY (id) AS (SELECT DISTINCT a, a FROM b UNION SELECT b.b, min(r.root) FROM r JOIN b ON r.id = b.a JOIN recurring.r AS o ON o.id = b.b WHERE r.root < o.root GROUP BY b.b) SELECT id, root AS component FROM r""")
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customers; and each line with its part and supplier, of one line number and flag: components of all sizes."""
    return community.components(compose.run(spark, folder, _LINKS, "orders", "lineitem"))


@query("louvain_communities")
def louvain_communities(spark: SparkSession, folder: str) -> DataFrame:
    ends = [F.concat(F.lit(a), c).alias(n) for a, c, n in (("shop@", "l_returnflag", "version_id"), ("s", "l_suppkey", "source"), ("p", "l_partkey", "target"))]
    return community.communities(table(spark, folder, "lineitem").select(*ends))


@query("cluster_labels")
def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    return community.labelled(louvain_communities(spark, folder)).withColumn("nodes", F.array_join(F.slice("nodes", 1, 15), ","))
