"""Operators on small written-out inputs."""

import pytest

from docweave.functions.params import py_params, ts_params
from docweave.operators import community, dependencies, graph, incremental, markdown, model_pass, retrieval
from docweave.plans import flagship
from docweave.sources import files, html

PAGE = """---
title: "Front"
other: x
---
# Top #
text [a](/x) and ![i](../i.png)
```js Example one
# not a heading
export function useThing(a: string): Foo {
```
~~~
plain
~~~
| A | B |
|---|:-:|
| 1 | 2 | 3 |
| x |
## Sub C#
```py
def f(a, *, b: int = 2) -> str:
@app.get("/")
class K(Base):
```
```
unclosed
"""


@pytest.fixture(scope="module")
def page(spark):
    rows = [("p", PAGE), ("empty", ""), ("null", None), ("only", "no heading")]
    return {r["page_key"]: r for r in markdown.parsed(spark.createDataFrame(rows, "page_key string, content string")).collect()}


def test_headings_and_title(page):
    p = page["p"]
    assert [(h.text, h.level, h.slug, h.line_number) for h in p.headings] == [("Top", 1, "top", 1), ("Sub C", 2, "sub-c", 14)]
    assert p.title == "Front" and p.front["other"] == "x"
    assert page["only"].title == "" and page["empty"].word_count == 0 and page["null"].headings == []


def test_code_blocks(page):
    blocks = [(b.language, b.title, b.line_number) for b in page["p"].code_blocks]
    assert blocks == [("javascript", "Example one", 3), ("", "", 7), ("python", "", 15)]
    assert page["p"].code_blocks[1].code == "plain"


def test_tables_and_links(page):
    (t,) = page["p"].tables
    assert t.headers == ["A", "B"] and t.rows == [["1", "2", "3"], ["x"]] and t.context_heading == "Top" and t.line_number == 10
    assert [(x.text, x.url, x.is_internal) for x in page["p"].links] == [("a", "/x", True), ("i", "../i.png", True)]


def test_signatures(spark):
    p = markdown.parsed(spark.createDataFrame([("p", PAGE)], "page_key string, content string"))
    found = {r["name"]: r for r in markdown.signatures(p).collect()}
    assert {n: r["kind"] for n, r in found.items()} == {"useThing": "hook", "f": "function", "K": "class"}
    assert found["f"]["return_type"] == "str" and [(q.name, q.required) for q in found["f"]["parameters"]] == [("a", True), ("", True), ("b", False)]
    assert found["useThing"]["signature"] == "export function useThing(a: string): Foo {"


def test_compat_takes_first_line_as_title(spark):
    text = "```py\nfirst\nsecond\n```\n"
    row = markdown.parsed(spark.createDataFrame([("p", text)], "page_key string, content string"), compat=True).first()
    assert [(b.title, b.code) for b in row.code_blocks] == [("first", "second")]


def test_params(spark):
    df = spark.createDataFrame([("{a, b}: P, x = 5, m: Map<K, V>, n?: T = 1", "cls, a=1, **kw")], "t string, p string")
    row = df.select(ts_params(df["t"]).alias("t"), py_params(df["p"]).alias("p")).first()
    assert [(q.name, q.type, q.required, q.default) for q in row.t][-1] == ("n", "T", False, "1")
    assert ("x = 5", "unknown", True, None) in [tuple(q) for q in row.t]
    assert [tuple(q) for q in row.p] == [("a", "unknown", False, "1"), ("kw", "unknown", True, None)]


def test_graph_rules(spark):
    nodes = spark.createDataFrame([("a", 1, "x", "one"), ("a", 5, "x", None), ("b", 2, "y", "two")], "id string, ord int, name string, note string")
    last = {r["id"]: r for r in graph.nodes_last_wins(nodes).collect()}
    assert last["a"]["ord"] == 1 and last["a"]["note"] is None
    edges = spark.createDataFrame([("x", "b", 1, "T", 0.5), ("a", "b", 2, "U", None), ("a", "gone", 3, "T", 1.0)], "source string, target string, ord int, type string, score double")
    (e,) = graph.edges_last_wins(graph.resolve_edges(edges, nodes)).collect()
    assert (e["source"], e["target"], e["ord"], e["type"], e["score"]) == ("a", "b", 1, "U", 0.5)


def test_incremental_replacement(spark):
    old = spark.createDataFrame([("p", "s1"), ("q", "s2")], "page_key string, name string")
    new = spark.createDataFrame([("p", "s3")], "page_key string, name string")
    assert sorted(r["name"] for r in incremental.replace_pages(old, new, new.select("page_key")).collect()) == ["s2", "s3"]


def test_louvain_splits_two_cliques():
    left = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)]
    right = [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)]
    found = community.louvain([*left, *right, ("a0", "b0")])
    assert len({found[f"a{i}"] for i in range(5)}) == 1 and found["a0"] != found["b0"]
    assert found == community.louvain([*left, *right, ("a0", "b0")])


def test_components(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("z", "z")]
    found = {r["id"]: r["component"] for r in community.components(spark.createDataFrame(chain, "source string, target string")).collect()}
    assert {found[f"n{i:03}"] for i in range(41)} == {"n000"} and found["y"] == "x" and found["z"] == "z"


def test_answers(spark):
    rows = [('```json\n{"symbols": [{"name": "a"}, 3, {"kind": "x"}], "summary": "s"}\n```',), ("[]",), ("{",), (None,)]
    out = model_pass.parse_answers(spark.createDataFrame(rows, "answer string")).collect()
    assert [s.name for s in out[0].symbols] in (["a"], []) and out[1].error and out[2].error and out[3].error


def test_pyproject_bad_file(spark):
    f = spark.createDataFrame([(1, "not toml ["), (2, '[project]\ndependencies = ["x>=1.2"]')], "project int, text string")
    assert [(r["project"], r["name"], r["version"]) for r in dependencies.pyproject(f).collect()] == [(2, "x", "1.2")]


def test_html(spark):
    page = "<html><head><style>x</style></head><body><nav>n</nav><article><h1>T &amp; U</h1><p>Some <b>bold</b> <a href='/a'>link</a> text that is long enough to stay</p><pre><code>code</code></pre><ul><li>one</ul></article><footer>f</footer></body></html>"
    rows = html.pages_from_html(spark.createDataFrame([(1, "https://e.com/a/b/?q#f", page), (2, "https://e.com", "<p>short</p>"), (3, None, None)], "page_id int, url string, html string")).collect()
    (r,) = rows
    assert r["page_key"] == "a/b.md" and r["content"].startswith("# T & U") and "**bold** [link](/a)" in r["content"] and "```\ncode\n```" in r["content"]


def test_router_and_keyword(spark):
    nodes = spark.createDataFrame([("l@1::alpha", 1, "symbol", "alpha", "function", "alpha()", ""), ("l@1::guides/g", 2, "guide", "About alpha", None, None, "text")], "id string, ord int, node_type string, name string, kind string, signature string, description string")
    edges = spark.createDataFrame([("l@1::guides/g", "l@1::alpha", 1, "REFERENCES")], "source string, target string, ord int, type string")
    assert retrieval.answer(nodes, edges, None, "what is alpha?").count() == 2
    assert [r["role"] for r in retrieval.context_nodes(nodes, edges, "what is alpha?").orderBy("ord").collect()] == ["seed", "neighbour"]
    hits = retrieval.keyword_query(nodes.select("name", "id", "ord"), "ALPHA", "l", "1")
    assert hits.count() == 2 and retrieval.keyword_query(nodes.select("name", "id", "ord"), "alpha", "other").count() == 0


def test_registry_and_graph_files(spark, tmp_path):
    (tmp_path / "registry.json").write_text('{"libraries": {"b": {"id": "b", "name": "B", "latest_version": "2.0", "tags": ["x"], "docs_config": {"type": "html", "base_url": "u"}}, "a": {"id": "a", "latest_version": "1.0"}}}')
    libs = files.registry(spark, str(tmp_path / "registry.json"))
    assert [r["id"] for r in files.listing(libs).collect()] == ["a", "b"]
    assert files.discover(libs, "a").first()["version"] == "1.0" and files.discover(libs, "b", "9").first()["version"] == "9"
    with pytest.raises(KeyError, match="a, b"):
        files.discover(libs, "zz")
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A")
    (docs / "b.png").write_text("x")
    assert [(r["page_key"], r["file_type"]) for r in files.doc_files(spark, str(tmp_path), ["docs"]).collect()] == [("docs/a.md", "md")]
    nodes = spark.createDataFrame([("l@1::a", "l@1", 1, "symbol")], "id string, version_id string, ord int, node_type string")
    edges = spark.createDataFrame([("l@1", "l@1::a", "l@1", 1, "EXPORTS")], "source string, target string, version_id string, ord int, type string")
    files.write_graph(nodes, edges, str(tmp_path / "graph"))
    n, e = files.read_graph(spark, str(tmp_path / "graph"))
    assert n.count() == 1 and e.first()["type"] == "EXPORTS" and '"node_count":1' in files.graph_json(nodes, edges).first()["graph"]


def test_flagship(spark):
    assert flagship(spark, "/root/testdata/sf0.001").count() > 0
