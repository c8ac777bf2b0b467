"""Sources by registry row, what is installed, prebuilt graphs, projects, the model pass's edges, and the job from a library's id."""

import json

import pytest

from docweave.operators import dependencies, markdown, model_pass
from docweave.plans import jobs
from docweave.sources import files, html, libraries, projects
from docweave.streaming import ingest

REGISTRY = {
    "libraries": {
        "md": {"id": "md", "name": "MD", "latest_version": "1.0", "npm_package": "md-npm", "docs_config": {"type": "github_markdown", "repo": "o/md", "docs_path": "docs", "extra_paths": ["more.md"]}},
        "web": {"id": "web", "name": "Web", "latest_version": "2.0", "pypi_package": "web.Py", "docs_config": {"type": "html", "base_url": "https://e.com/docs"}},
        "odd": {"id": "odd", "name": "Odd", "latest_version": "1", "docs_config": {"type": "ftp"}},
    }
}


@pytest.fixture
def world(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps(REGISTRY))
    docs = tmp_path / "src" / "o" / "md" / "docs"
    docs.mkdir(parents=True)
    (docs / "a.md").write_text("# Alpha\n```py\ndef one(a):\n    pass\n```\n")
    (docs.parent / "more.md").write_text("# More\n```py\ndef two(): pass\n```\n")
    (docs / "bad.md").write_bytes(b"\xff\xfe\xfa broken")
    long = "<article><h1>T</h1><p>" + "words " * 30 + "</p></article>"
    crawled = spark.createDataFrame([("https://e.com/docs/x", long), ("https://e.com/other", long)], "url string, html string")
    maps = spark.createDataFrame([("<urlset><url><loc>https://e.com/docs/x</loc></url><url><loc>https://e.com/blog</loc></url></urlset>",)], "xml string")
    return files.registry(spark, str(tmp_path / "registry.json")), str(tmp_path / "src"), crawled, maps, tmp_path


def test_fetch_by_type(world):
    libs, src, crawled, maps, _ = world
    good, bad = libraries.fetch_all(libs, src, crawled, maps)
    assert set(good) == {"md", "web"} and bad == {"odd": "unknown source type: ftp"}
    assert [(r["page_key"], r["page_ord"]) for r in good["web"].collect()] == [("docs/x.md", 1)]
    assert {r["page_key"] for r in good["md"].collect()} >= {"docs/a.md", "more.md"}


def test_files_checked_and_single(spark, world):
    good, bad = files.doc_files_checked(spark, f"{world[1]}/o/md", ["docs"])
    assert [r["page_key"] for r in good.collect()] == ["docs/a.md"] and [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["bad.md"]
    assert files.single_file(spark, f"{world[1]}/o/md/more.md").startswith("# More") and files.single_file(spark, f"{world[1]}/none") is None


def test_library_from_id_to_answer(spark, world):
    libs, src, crawled, maps, tmp = world
    root = str(tmp / "out")
    built = jobs.extract_from_registry(libs, "md", root, src, crawled, maps)
    assert built["status"] == "built" and built["symbols"] == 2
    nodes = {r["id"]: r for r in spark.read.parquet(f"{root}/md/1.0/roots").collect()}
    assert nodes["md"]["node_type"] == "library" and nodes["md@1.0"]["is_latest"] is True
    edges = {(r["source"], r["target"], r["type"]) for r in spark.read.parquet(f"{root}/md/1.0/edges").collect()}
    assert ("md", "md@1.0", "HAS_VERSION") in edges
    assert [(r["library"], r["version"]) for r in libraries.installed(spark, [root]).collect()] == [("md", "1.0")]
    assert spark.read.json(f"{root}/md/meta.json").first()["name"] == "MD"
    assert libraries.find(spark, [str(tmp / "none"), root], "md") == f"{root}/md" and libraries.find(spark, [root], "web") is None
    info = {r["id"]: r["extracted"] for r in libraries.info(libs, spark.createDataFrame([("md", "1.9"), ("md", "1.10"), ("web", None)], "library string, version string")).collect()}
    assert info == {"md": ["1.10", "1.9"], "web": [], "odd": []}
    text = "\n".join(r["text"] for r in jobs.ask(spark, [root], "md", "what is one?").collect())
    assert "## one" in text
    with pytest.raises(LookupError, match="no version 7"):
        jobs.ask(spark, [root], "md", "x", "7")
    with pytest.raises(LookupError, match="not installed"):
        jobs.ask(spark, [root], "zz", "x")
    deps = spark.createDataFrame([("p", 0, 0, "npm", "md-npm", "1.0"), ("p", 1, 0, "pypi", "Web_Py", "2.0")], "project string, source_rank int, ord int, ecosystem string, name string, version string")
    assert jobs.extract_missing(deps, libs, root, src, crawled, maps) == {"web@2.0": "built"}


def test_prebuilt_and_migration(spark, tmp_path):
    (tmp_path / "store" / "lib" / "1.0" / "nodes").mkdir(parents=True)
    (tmp_path / "store" / "lib" / "1.0" / "nodes" / "x").write_text("x")
    store, cache = str(tmp_path / "store"), str(tmp_path / "cache")
    assert not libraries.load_prebuilt(spark, store, cache, "lib", "9") and libraries.load_prebuilt(spark, store, cache, "lib", "1.0")
    assert (tmp_path / "cache" / "lib" / "1.0" / "nodes" / "x").read_text() == "x" and spark.read.json(f"{cache}/lib/meta.json").first()["latest_version"] == "1.0"
    assert libraries.load_prebuilt(spark, str(tmp_path / "gone"), cache, "lib", "1.0")
    assert libraries.migrate(spark, store, str(tmp_path / "new")) == ["lib"] and libraries.migrate(spark, store, str(tmp_path / "new")) == []
    assert [r["library"] for r in libraries.installed(spark, [str(tmp_path / "new")]).collect()] == ["lib"]


def test_tables_are_read_once(spark, tmp_path):
    path = str(tmp_path / "t")
    known = libraries.Tables(spark)
    assert known.get(path) is None
    spark.range(3).write.parquet(path)
    assert known.get(path) is None
    known.forget(path)
    assert known.get(path).count() == 3 and known.get(path) is known.get(path)


def test_dependency_files(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (tmp_path / "a" / "package.json").write_text('{"dependencies": {"x": "1"}}')
    (tmp_path / "requirements.txt").write_text("y\n")
    (deep / "packages" / "one").mkdir(parents=True)
    (deep / "packages" / "one" / "package.json").write_text('{"devDependencies": {"z": "1"}}')
    names = [p.relative_to(tmp_path).as_posix() for p in projects.dependency_files(deep, "package.json", top=tmp_path)]
    assert names == ["a/package.json", "a/b/c/packages/one/package.json"]
    assert projects.dependency_files(deep, "package.json", levels=2, top=tmp_path) == [deep / "packages" / "one" / "package.json"]
    found = projects.project_files(spark, deep, top=tmp_path)
    assert [r["file"] for r in found.collect()] == ["package.json", "package.json", "requirements.txt"]
    assert sorted(r["name"] for r in dependencies.package_json_names(found.where("file = 'package.json'")).collect()) == ["x", "z"]
    assert dependencies.package_json_names(spark.createDataFrame([("broken {",), (None,)], "text string")).count() == 0


def test_backends():
    env = {"OPENAI_API_KEY": "k", "ANTHROPIC_API_KEY": "k"}
    assert model_pass.detect_backend(env) == "anthropic"
    assert model_pass.detect_backend({}, lambda u: ["small"]) == "ollama" and model_pass.detect_backend({}, lambda u: []) == "none"
    assert model_pass.detect_backend({"OLLAMA_MODEL": "big"}, lambda u: ["small"]) == "none"
    assert model_pass.detect_backend({}, lambda u: 1 / 0) == "none"
    with pytest.raises(RuntimeError):
        model_pass.caller("none", {})
    with pytest.raises(ValueError):
        model_pass.caller("x", {})


def test_requests_and_replies():
    answers = {"gemini": {"candidates": [{"content": {"parts": [{"text": "a"}]}}]}, "anthropic": {"content": [{"text": "a"}]}, "openai": {"choices": [{"message": {"content": "a"}}]}, "ollama": {"message": {"content": ""}}}
    for backend, answer in answers.items():
        url, headers, body = model_pass.request(backend, "the page", "the rules", {f"{backend.upper()}_API_KEY": "key", f"{backend.upper()}_MODEL": "mine"})
        assert url.startswith("http") and "key" in str(headers) and "the page" in str(body) and "the rules" in str(body) and "mine" in url + str(body)
        assert model_pass.reply(backend, answer) == ("{}" if backend == "ollama" else "a")
    assert model_pass.caller("x", {"x": str.upper})("a") == "A"


def test_frontmatter_forms(spark):
    text = "---\nt: 'a: b'\nl:\n- x\n-  \"y\"\nm:\n  k: 1\n  j: two\nfold: >\n  one\n  two\n# no\nnot yaml at all\nt: again\n---\nbody"
    df = spark.createDataFrame([(text,), ("---\n- only\n---\nx",), ("none",), (None,)], "c string")
    rows = [r[0] for r in df.select(markdown.frontmatter("c")).collect()]
    assert rows[0] == {"l": '["x","y"]', "m": '{"k":"1","j":"two"}', "fold": "one two", "t": "again"} and rows[1:] == [{}, {}, {}]


def test_markdown_is_linear_and_tables_are_apart(spark):
    page = "| a |\n|---|\n| 1 |\n\n| b |\n|---|\n# H\n| c |\n|---|\n| 2 |\n| 3 |\ntext\n| no |\n| table |\n|---|\n|---|\n| 4 |"
    (r,) = markdown.parsed(spark.createDataFrame([(page,)], "content string")).collect()
    assert [(t.headers, [x[0] for x in t.rows], t.context_heading, t.line_number) for t in r.tables] == [(["a"], ["1"], "", 1), (["b"], [], "", 5), (["c"], ["2", "3"], "H", 8), (["table"], ["---", "4"], "H", 14)]
    long = "\n".join(f"# h{k}\n| a |\n|---|\n| {k} |\n```\nx\n```" for k in range(2000))
    (r,) = markdown.parsed(spark.createDataFrame([(long,)], "content string")).collect()
    assert len(r.tables) == len(r.headings) == len(r.code_blocks) == 2000 and r.tables[-1].context_heading == "h1999"


def test_sitemaps_one_after_another(spark):
    loc = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    maps = spark.createDataFrame([(2, loc("https://e/z")), (1, loc("https://e/b", "https://e/a"))], "ord int, xml string")
    assert [r["url"] for r in html.sitemap_urls(maps, "https://e", limit=2).collect()] == ["https://e/b", "https://e/a"]


def test_stream_takes_the_last_and_compacts(spark, tmp_path):
    src, schema = tmp_path / "in", "page_key string, content string, modified timestamp"
    manifest = str(tmp_path / "manifest")
    src.mkdir()

    def put(k, *rows):
        spark.createDataFrame([(p, c, __import__("datetime").datetime(2024, 1, m)) for p, c, m in rows], schema).coalesce(1).write.mode("append").parquet(str(src))

    for k in range(5):
        put(k, ("p", f"zz{k}", 1), ("p", f"aa{k}", 2), (f"q{k}", "x", 1))
        ingest.ingest(spark.readStream.schema(schema).parquet(str(src)), manifest, str(tmp_path / "sink"), str(tmp_path / "check"), every=2).awaitTermination()
    last = {r["content"] for r in spark.read.parquet(str(tmp_path / "sink")).where("page_key = 'p' AND batch = 4").collect()}
    assert last == {"aa4"}
    found = {r["page_key"] for r in ingest.read_manifest(spark, manifest).collect()}
    assert found == {"p", *(f"q{k}" for k in range(5))}
    assert sorted(p.name for p in (tmp_path / "manifest").iterdir()) == ["batch=4", "upto=3"]
