"""The whole job on a few pages: full build, nothing to do, a change, a deletion."""

from docweave.plans.jobs import extract_library

A = "# Alpha\n```py\ndef one(a):\ndef two(b):\n```\n"
B = "# Beta\n```py\ndef two(c):\ndef three():\n```\n"


def pages(spark, *contents):
    return spark.createDataFrame([(f"p{k}.md", k, c, "u") for k, c in enumerate(contents) if c is not None], "page_key string, page_ord long, content string, source_url string")


def test_build_update_delete(spark, tmp_path):
    folder = str(tmp_path)
    built = extract_library(pages(spark, A, B), "lib", "1.0", folder)
    assert (built["symbols"], built["guides"], built["pages"]) == (3, 2, 2)
    edges = {(r["source"], r["target"], r["type"]) for r in spark.read.parquet(f"{folder}/lib/1.0/edges").collect()}
    assert ("lib@1.0", "lib@1.0::two", "EXPORTS") in edges and ("lib@1.0::guides/p1.md", "lib@1.0::two", "REFERENCES") in edges
    assert extract_library(pages(spark, A, B), "lib", "1.0", folder, update=True)["status"] == "up_to_date"
    changed = extract_library(pages(spark, A, B.replace("three", "four")), "lib", "1.0", folder, update=True)
    assert changed["pages"] == 1 and changed["symbols"] == 3
    names = {r["name"] for r in spark.read.parquet(f"{folder}/lib/1.0/nodes").collect()}
    assert names == {"one", "two", "four", "Alpha", "Beta"}
    full = extract_library(pages(spark, A, B.replace("three", "four")), "lib", "1.1", folder)
    assert {k: full[k] for k in ("nodes", "edges", "symbols")} == {k: changed[k] for k in ("nodes", "edges", "symbols")}
    gone = extract_library(pages(spark, A, None), "lib", "1.0", folder, update=True)
    assert gone["symbols"] == 2 and gone["guides"] == 1


def test_model_pass_adds_and_survives_failures(spark, tmp_path):
    def call(prompt: str) -> str:
        if "Beta" in prompt:
            raise ValueError("no answer")
        return '{"symbols": [{"name": "one", "description": "first"}, {"name": "extra", "kind": "class"}], "relationships": [{"source": "one", "target": "extra"}, {"source": "one", "target": "nowhere"}]}'

    built = extract_library(pages(spark, A, B), "lib", "2.0", str(tmp_path), call=call)
    nodes = {r["name"]: r for r in spark.read.parquet(f"{tmp_path}/lib/2.0/nodes").collect()}
    assert nodes["one"]["description"] == "first" and nodes["extra"]["kind"] == "class" and built["symbols"] == 4
    edges = {(r["source"], r["target"]): r["type"] for r in spark.read.parquet(f"{tmp_path}/lib/2.0/edges").collect()}
    assert edges[("lib@2.0::one", "lib@2.0::extra")] == "RELATED_TO"
