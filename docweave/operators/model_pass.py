"""The optional model pass: prompts, a pluggable caller, and what its answers say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import json
import os
import urllib.request

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import strip

SYMBOL = "struct<name:string,kind:string,module_path:string,signature:string,description:string,return_type:string,deprecated:boolean,deprecated_by:string>"
RELATION = "struct<source:string,target:string,type:string,confidence_score:double,description:string>"
ANSWER = f"symbols array<{SYMBOL}>, relationships array<{RELATION}>, summary string"
# Characters of prose and rows of a table in a prompt, the summary of pages that are not asked about.
PROSE, TABLE_ROWS = 8000, 5
SHORT = "Page too short for meaningful extraction."
#: Models that are asked unless the environment names another, and the longest answer.
MODELS = {"gemini": "gemini-2.5-flash", "anthropic": "claude-sonnet-4-20250514", "openai": "gpt-4o-mini", "ollama": "llama3.2"}
MAX_TOKENS = 4096
SYSTEM = """You read one page of API documentation. Answer with one JSON object and nothing else: symbols (name, kind, module_path, signature,
description, return_type, deprecated, deprecated_by), relationships (source, target, type, confidence_score, description) and summary.
Name only what the page names."""


def prompt() -> Column:
    """Of a parsed page with its signatures: title, frontmatter, headings, signatures, tables and the beginning of the prose; parts that a page lacks are left out."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {name}\n"), F.array_join(c, "\n")))
    heads = F.transform("headings", lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- "), h["text"]))
    signed = F.transform("signatures", lambda s: F.concat(F.lit("- "), s["kind"], F.lit(" "), s["name"], F.lit(": "), s["signature"]))
    cells = lambda r: F.array_join(r, " | ")
    tabled = F.transform("tables", lambda t: F.concat_ws("\n", F.when(t["context_heading"] != "", F.concat(F.lit("under "), t["context_heading"])), cells(t["headers"]), F.array_join(F.transform(F.slice(t["rows"], 1, TABLE_ROWS), cells), "\n")))
    text = strip("raw_text")
    prose = F.when(F.length(text) > PROSE, F.concat(F.substring(text, 1, PROSE), F.lit("\n...[truncated]"))).otherwise(text)
    front = F.when(F.size("front") > 0, F.concat(F.lit("## Frontmatter\n"), F.to_json("front")))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), front, part("Headings", heads), part("Signatures", signed), part("Tables", tabled), F.concat(F.lit("## Text\n"), prose))


def detect_backend(env: dict[str, str] | None = None, probe: Callable[[str], list[str]] | None = None) -> str:
    """The first backend that the environment offers: a key of gemini, anthropic or openai, then a local server with a model, else none.

    probe: names of the models that a server has; an error means that there is none.
    """
    env = dict(os.environ) if env is None else env
    for name in ("gemini", "anthropic", "openai"):
        if env.get(f"{name.upper()}_API_KEY"):
            return name
    try:
        models = (probe or _models)(env.get("OLLAMA_BASE_URL", "http://localhost:11434"))
    except Exception:  # no server, or one that does not answer
        return "none"
    wanted = env.get("OLLAMA_MODEL")
    return "ollama" if any(wanted is None or wanted in m for m in models) else "none"


def _models(base: str) -> list[str]:
    with urllib.request.urlopen(f"{base}/api/tags", timeout=2) as r:
        return [m.get("name", "") for m in json.load(r).get("models", [])]


def caller(backend: str, callers: dict[str, Callable[[str], str]] | None = None, system: str = SYSTEM, env: dict[str, str] | None = None) -> Callable[[str], str]:
    """The function that asks a backend: one of callers, or the backend's public web interface; none raises RuntimeError, one that is not known ValueError."""
    if backend == "none":
        raise RuntimeError("no backend: set a key or give a caller")
    if callers and backend in callers:
        return callers[backend]
    if backend not in MODELS:
        raise ValueError(f"unknown backend: {backend}")
    own = dict(os.environ) if env is None else env
    return lambda prompt: reply(backend, _send(*request(backend, prompt, system, own)))


def request(backend: str, prompt: str, system: str, env: dict[str, str]) -> tuple[str, dict[str, str], dict]:
    """Address, headers and body that ask a backend."""
    name = backend.upper()
    model, key = env.get(f"{name}_MODEL") or MODELS[backend], env.get(f"{name}_API_KEY", "")
    turns = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
    if backend == "gemini":
        part = lambda t: {"parts": [{"text": t}]}
        return f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", {"x-goog-api-key": key}, {"system_instruction": part(system), "contents": [part(prompt)]}
    if backend == "anthropic":
        return "https://api.anthropic.com/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": model, "max_tokens": MAX_TOKENS, "system": system, "messages": turns[1:]}
    if backend == "openai":
        return "https://api.openai.com/v1/chat/completions", {"Authorization": f"Bearer {key}"}, {"model": model, "max_tokens": MAX_TOKENS, "messages": turns}
    base = env.get("OLLAMA_BASE_URL", "http://localhost:11434")
    return f"{base}/api/chat", {"Authorization": f"Bearer {key}"} if key else {}, {"model": model, "messages": turns, "stream": False}


def reply(backend: str, answer: dict) -> str:
    """The text of a backend's answer; an empty one counts as an empty object."""
    ways = {"gemini": ("candidates", 0, "content", "parts", 0, "text"), "anthropic": ("content", 0, "text"), "openai": ("choices", 0, "message", "content"), "ollama": ("message", "content")}
    for step in ways[backend]:
        answer = answer[step]
    return answer or "{}"


def _send(url: str, headers: dict[str, str], body: dict) -> dict:
    ask_ = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
    with urllib.request.urlopen(ask_, timeout=120) as r:
        return json.load(r)


def extract(pages: DataFrame, call: Callable[[str], str], key: str = "page_key") -> DataFrame:
    """key, symbols, relationships, summary and error of every page: answers of those worth asking about, and a fixed summary of the others."""
    said = ask(pages.where(worth_asking()), call, key)
    parsed = parse_answers(said.withColumnRenamed("error", "_failed"))
    parsed = parsed.select(key, "symbols", "relationships", "summary", F.coalesce("_failed", "error").alias("error"))
    none = lambda t: F.array().cast(f"array<{t}>")
    short = pages.where(~worth_asking()).select(key, none(SYMBOL).alias("symbols"), none(RELATION).alias("relationships"), F.lit(SHORT).alias("summary"), F.lit(None).cast("string").alias("error"))
    return parsed.unionByName(short)


def worth_asking() -> Column:
    """Pages of at least 50 words or with signatures; the others get a fixed summary without a call."""
    return (F.col("word_count") >= 50) | (F.size("signatures") > 0)


def ask(pages: DataFrame, call: Callable[[str], str], key: str = "page_key") -> DataFrame:
    """key, answer and error of each page; a failed call is an error of that page only."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, text in zip(pdf["key"], pdf["prompt"], strict=True):
                try:
                    rows.append((k, call(text), None))
                except Exception as e:  # the caller's failure is data here
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "answer", "error"])

    return pages.select(F.col(key).alias("key"), prompt().alias("prompt")).mapInPandas(part, f"{key} string, answer string, error string")


def parse_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """symbols, relationships, summary and error of each answer: a code fence around it is dropped, entries without their names go, defaults are filled."""
    text = F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?s)\A```[a-zA-Z]*\s*\n", ""), r"(?s)\n```\s*\z", "")
    rows = answers.withColumn("_p", F.from_json(text, ANSWER, {"mode": "PERMISSIVE"})).withColumn("_ok", F.try_parse_json(text).isNotNull() & F.rlike(text, F.lit(r"(?s)\A\s*\{")))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    symbols = F.transform(
        F.filter(F.coalesce("_p.symbols", F.array().cast(f"array<{SYMBOL}>")), lambda s: s.isNotNull() & full(s["name"])),
        lambda s: s.withField("kind", F.coalesce(F.nullif(s["kind"], F.lit("")), F.lit("function"))).withField("deprecated", F.coalesce(s["deprecated"], F.lit(False))),
    )
    relations = F.transform(
        F.filter(F.coalesce("_p.relationships", F.array().cast(f"array<{RELATION}>")), lambda r: r.isNotNull() & full(r["source"]) & full(r["target"])),
        lambda r: r.withField("type", F.coalesce(F.nullif(r["type"], F.lit("")), F.lit("RELATED_TO"))).withField("confidence_score", F.coalesce(r["confidence_score"], F.lit(0.8))),
    )
    return rows.select(*answers.columns, symbols.alias("symbols"), relations.alias("relationships"), F.coalesce("_p.summary", F.lit("")).alias("summary"), F.when(~F.coalesce("_ok", F.lit(False)), "not a JSON object").alias("error"))
