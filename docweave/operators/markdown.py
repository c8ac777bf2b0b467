"""Structure of Markdown pages: expressions on the page's lines, so a page never leaves its row and nothing is shuffled.

Code fences are followed line by line (an opening fence's text closes it), so headings, links and tables inside code
do not count. A page's lines are read once, with the state of the fence and the table in the accumulator, and once more for what
each line is, so the work grows with the page; nothing is nested over lines. compat=True keeps the older reading, a single pattern in which an untitled fence's first code line
becomes its title, and looks for headings and links inside code too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.params import py_params, ts_params
from docweave.functions.regex import line_at, line_number, matches
from docweave.functions.text import col, language, slugify, strip, word_count

# The patterns of the formats.
FRONTMATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
FENCE = r"(?ms)^(`{3,}|~{3,})([^\s`~]*)(?:\s+([^\n]*))?\n(.*?)\n\1\s*$"
HEADING = r"^(#{1,6})\s+(.+?)(?:\s*#*)?$"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
SEPARATOR = r"^\|[\s:|-]+\|$"
#: (order, language family, kind, pattern, group of the name, of parameters, of the return type)
SIGNATURES = (
    (1, "ts", "hook", r"(?:export\s+)?(?:function\s+)?(use[A-Z]\w+)\s*\(", 1, 0, 0),
    (2, "ts", "component", r"(?:export\s+)?(?:default\s+)?(?:function|const)\s+([A-Z]\w+)\s*(?:\(|=\s*\()", 1, 0, 0),
    (3, "ts", "function", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)(?:<[^>]+>)?\s*\(([^)]*)\)(?:\s*:\s*(\S+))?", 1, 2, 3),
    (4, "ts", "class", r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>]+>)?(?:\s+extends\s+\w+)?(?:\s+implements\s+[^{]+)?", 1, 0, 0),
    (5, "ts", "interface", r"(?:export\s+)?interface\s+(\w+)(?:<[^>]+>)?", 1, 0, 0),
    (6, "ts", "type", r"(?:export\s+)?type\s+(\w+)(?:<[^>]+>)?\s*=", 1, 0, 0),
    (7, "ts", "enum", r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)", 1, 0, 0),
    (1, "py", "function", r"(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*(\S+))?", 1, 2, 3),
    (2, "py", "class", r"class\s+(\w+)(?:\(([^)]*)\))?:", 1, 0, 0),
    (3, "py", "decorator", r"@([\w.]+)(?:\(([^)]*)\))?", 1, 0, 0),
)
#: A further pattern, off by default: functions bound to a name.
ARROW = (8, "ts", "function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>", 1, 0, 0)
FAMILIES = {"typescript": "ts", "javascript": "ts", "python": "py"}

_BLOCK = "array<struct<start:int,stop:int,fence:string,info:string>>"


_PAIR = r"^([A-Za-z_][\w.-]*):(?:\s+(.*))?$"


def _scalar(c: Column) -> Column:
    """A value without its quotes, or without the comment behind it."""
    text = strip(c)
    quoted = F.regexp_extract(text, "^(?:\"(.*)\"|'(.*)')\\s*(?:\\s#.*)?$", 0) != ""
    inner = F.concat(F.regexp_extract(text, "^\"(.*)\"\\s*(?:\\s#.*)?$", 1), F.regexp_extract(text, "^'(.*)'\\s*(?:\\s#.*)?$", 1))
    return F.when(quoted, inner).otherwise(F.regexp_replace(text, r"\s+#.*$", ""))


def frontmatter(content: Column | str) -> Column:
    """The leading block as a map of texts: scalars as they are, lists and maps of one level (inline or indented) as JSON.

    Of a key that is given twice the last holds; comments and lines that are neither are passed over, so a block that is no
    YAML gives what can be read.
    """
    block = "struct<key:string,value:string,more:array<string>>"
    rows = F.filter(F.split(F.regexp_extract(F.coalesce(col(content), F.lit("")), FRONTMATTER, 1), "\n"), lambda x: ~F.rlike(x, F.lit(r"^\s*(#|$)")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        top = F.rlike(x, F.lit(_PAIR))
        new = F.struct(F.regexp_extract(x, _PAIR, 1), F.regexp_extract(x, _PAIR, 2), F.array().cast("array<string>")).cast(block)
        longer = F.struct(last["key"], last["value"], F.concat(last["more"], F.array(x))).cast(block)
        inner = F.rlike(x, F.lit(r"^(\s+\S|-\s)")) & (F.size(acc) > 0)
        return F.when(top, F.concat(acc, F.array(new))).when(inner, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(acc)

    def value(e: Column) -> Column:
        item, pair = r"^\s*-\s+(.*)$", r"^\s+([\w.-]+):\s+(.*)$"
        more = e["more"]
        listed = F.to_json(F.transform(more, lambda x: _scalar(F.regexp_extract(x, item, 1))))
        mapped = F.to_json(F.map_from_entries(F.transform(more, lambda x: F.struct(F.regexp_extract(x, pair, 1), _scalar(F.regexp_extract(x, pair, 2))))))
        inline = F.to_json(F.transform(F.split(F.regexp_extract(e["value"], r"^\[(.*)\]\s*$", 1), ","), _scalar))
        whole = lambda p: (F.size(more) > 0) & F.forall(more, lambda x: F.rlike(x, F.lit(p)))
        once = F.size(F.array_distinct(F.transform(more, lambda x: F.regexp_extract(x, pair, 1)))) == F.size(more)
        return (
            F.when(F.rlike(e["value"], F.lit(r"^\[.*\]\s*$")), inline)
            .when(whole(item), listed)
            .when(whole(pair) & once, mapped)
            .when(F.size(more) > 0, F.concat_ws(" ", F.nullif(F.regexp_replace(e["value"], r"^[|>][+-]?\s*$", ""), F.lit("")), F.array_join(F.transform(more, lambda x: F.trim(x)), " ")))
            .otherwise(_scalar(e["value"]))
        )

    entries = F.transform(F.aggregate(rows, F.array().cast(f"array<{block}>"), step), lambda e: F.struct(e["key"].alias("k"), value(e).alias("v")))
    return F.aggregate(F.filter(entries, lambda e: e["v"] != ""), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


def body(content: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(content), F.lit("")), FRONTMATTER, "")


def lines(text: Column | str) -> Column:
    return F.split(col(text), "\n")


def fences(lines_: Column) -> Column:
    """(start, stop, fence, info) of the closed code fences, by line index.

    Only lines that could open or close a fence are folded over, each with its place.
    """
    marks = F.filter(F.transform(lines_, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda z: z["x"].startswith("```") | z["x"].startswith("~~~"))
    first = F.struct(F.lit("").alias("fence"), F.lit("").alias("info"), F.lit(-1).alias("start"), F.array().cast(_BLOCK).alias("found"))

    def step(acc: Column, z: Column) -> Column:
        opens = F.regexp_extract(z["x"], r"^(`{3,}|~{3,})([^`]*)$", 1)
        outside, closes = acc["fence"] == "", F.rtrim(z["x"]) == acc["fence"]
        new = F.array(F.struct(acc["start"], z["i"], acc["fence"], acc["info"])).cast(_BLOCK)
        start = outside & (opens != "")
        end = ~outside & closes
        return F.struct(
            F.when(start, opens).when(end, "").otherwise(acc["fence"]).alias("fence"),
            F.when(start, F.trim(F.regexp_replace(z["x"], "^[`~]+", ""))).otherwise(acc["info"]).alias("info"),
            F.when(start, z["i"]).otherwise(acc["start"]).alias("start"),
            F.when(end, F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(marks, first, step, lambda acc: acc["found"])


def _outside(lines_: Column, fences_: Column) -> Column:
    """(n, x) of the lines outside the fences: the slices between them, put one after another."""
    numbered = F.transform(lines_, lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    ends = F.concat(F.array(F.lit(-1)), F.transform(fences_, lambda b: b["stop"]))
    starts = F.concat(F.transform(fences_, lambda b: b["start"]), F.array(F.size(lines_)))
    return F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(numbered, a + 2, F.greatest(b - a - 1, F.lit(0)))))


def parsed(pages: DataFrame, content: str = "content", compat: bool = False) -> DataFrame:
    """pages with front, title, headings, code_blocks, tables, links, raw_text and word_count."""
    own = [F.col(c) for c in pages.columns]
    rows = pages.select(*own, frontmatter(content).alias("front"), body(content).alias("_body"), lines(body(content)).alias("_lines"))
    own.append(F.col("front"))
    rows = rows.select(*own, "_body", "_lines", fences(F.col("_lines")).alias("_fences"))
    numbered = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    rows = rows.select(*own, "_body", "_lines", "_fences", (numbered if compat else _outside(F.col("_lines"), F.col("_fences"))).alias("_open"))
    if compat:
        blocks = F.transform(
            matches(F.col("_body"), FENCE, 4),
            lambda m: F.struct(m["g4"].alias("code"), language(m["g2"]).alias("language"), F.trim(F.coalesce(m["g3"], F.lit(""))).alias("title"), line_number(F.col("_body"), m["start"]).alias("line_number")),
        )
        raw = F.regexp_replace("_body", FENCE, "")
    else:
        blocks = F.transform(
            "_fences",
            lambda b: F.struct(
                F.array_join(F.slice(F.col("_lines"), b["start"] + 2, b["stop"] - b["start"] - 1), "\n").alias("code"),
                language(F.split(b["info"], r"\s+")[0]).alias("language"),
                F.trim(F.regexp_extract(b["info"], r"^\S+\s+(.*)$", 1)).alias("title"),
                (b["start"] + 1).alias("line_number"),
            ),
        )
        raw = F.array_join(F.transform("_open", lambda z: z["x"]), "\n")
    heads = F.filter("_open", lambda z: z["x"].startswith("#") & F.rlike(z["x"], F.lit(HEADING)))
    heads = F.transform(heads, lambda z: F.struct(strip(F.regexp_extract(z["x"], HEADING, 2)).alias("text"), F.length(F.regexp_extract(z["x"], HEADING, 1)).alias("level"), slugify(F.regexp_extract(z["x"], HEADING, 2)).alias("slug"), z["n"].alias("line_number")))
    link = lambda z: F.transform(
        F.arrays_zip(F.regexp_extract_all(z["x"], F.lit(LINK), F.lit(1)).alias("t"), F.regexp_extract_all(z["x"], F.lit(LINK), F.lit(2)).alias("u")),
        lambda m: F.struct(m["t"].alias("text"), m["u"].alias("url"), F.rlike(m["u"], F.lit(r"^(/|\./|\.\./|#)")).alias("is_internal"), z["n"].alias("line_number")),
    )
    linked = F.filter("_open", lambda z: z["x"].contains("]("))
    rows = rows.select(*own, blocks.alias("code_blocks"), heads.alias("headings"), F.flatten(F.transform(linked, link)).alias("links"), raw.alias("raw_text"), tables(F.col("_open")).alias("tables"))
    top = F.filter("headings", lambda h: h["level"] == 1)
    title = F.coalesce(F.nullif(F.try_element_at("front", F.lit("title")), F.lit("")), F.get(top, F.lit(0))["text"], F.get("headings", F.lit(0))["text"], F.lit(""))
    return rows.select("*", title.alias("title"), word_count("raw_text").alias("word_count"))


_TABLE = "struct<headers:array<string>,rows:array<array<string>>,context_heading:string,line_number:int>"


def tables(open_: Column) -> Column:
    """(headers, rows, context_heading, line_number) of pipe tables; rows end at the first line that is no pipe row.

    Only pipe rows, headings and the lines right after pipe rows matter, and only those are folded over, each once.
    """
    pipe = lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1)
    cells = lambda x: F.transform(F.split(F.trim(x, F.lit("|")), r"\|"), lambda c: F.trim(c))
    trimmed = F.transform(open_, lambda z, i: F.struct(i.alias("i"), z["n"].alias("n"), F.trim(z["x"]).alias("t"), z["x"].startswith("#").alias("h"), z["x"].alias("x")))
    some = F.filter(trimmed, lambda z: z["h"] | pipe(z["t"]))
    none = F.lit(None).cast(_TABLE)
    start = F.struct(F.lit(-2).alias("at"), F.lit("").alias("above"), F.lit(0).alias("n"), F.lit("").alias("head"), none.alias("now"), F.array().cast(f"array<{_TABLE}>").alias("found"))
    closed = lambda acc: F.when(acc["now"].isNotNull(), F.concat(acc["found"], F.array(acc["now"]))).otherwise(acc["found"])

    def step(acc: Column, z: Column) -> Column:
        row = pipe(z["t"])
        follows = row & (z["i"] == acc["at"] + 1)  # the line above was a pipe row too
        grows = follows & acc["now"].isNotNull()
        begins = follows & acc["now"].isNull() & F.rlike(z["t"], F.lit(SEPARATOR))
        grown = F.struct(acc["now"]["headers"], F.concat(acc["now"]["rows"], F.array(cells(z["t"]))), acc["now"]["context_heading"], acc["now"]["line_number"]).cast(_TABLE)
        new = F.struct(cells(acc["above"]), F.array().cast("array<array<string>>"), acc["head"], acc["n"]).cast(_TABLE)
        heading = F.when(z["h"] & F.rlike(z["x"], F.lit(HEADING)), strip(F.regexp_extract(z["x"], HEADING, 2))).otherwise(acc["head"])
        return F.struct(
            F.when(row, z["i"]).otherwise(F.lit(-2)).alias("at"),
            z["t"].alias("above"),
            z["n"].alias("n"),
            heading.alias("head"),
            F.when(grows, grown).when(begins, new).alias("now"),
            F.when(grows, acc["found"]).otherwise(closed(acc)).alias("found"),
        )

    return F.aggregate(some, start, step, closed)


def signatures(pages: DataFrame, key: str = "page_key", arrow: bool = False) -> DataFrame:
    """A row for each API signature in a page's code blocks: the first of each name on a page, in order of block, pattern and place."""
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    blocks = pages.select(key, F.posexplode("code_blocks").alias("block", "b")).withColumn("family", F.try_element_at(family, F.col("b.language"))).where("family IS NOT NULL")
    empty = F.lit("")
    every = []
    for order, lang, kind, pattern, name, params, returns in (*SIGNATURES, *((ARROW,) if arrow else ())):
        groups = max(name, params, returns)
        given = (lambda m, k=params: m[f"g{k}"]) if params else (lambda m: empty)
        gives = (lambda m, k=returns: F.regexp_replace(F.coalesce(m[f"g{k}"], empty), r"[:{;]+$", "")) if returns else (lambda m: empty)
        row = lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("pattern"), m[f"g{name}"].alias("name"), F.lit(kind).alias("kind"), given(m).alias("params"), gives(m).alias("return_type"))  # noqa: B023, E731
        found = F.transform(matches(F.col("b.code"), pattern, groups), row)
        every.append(F.when(F.col("family") == lang, found).otherwise(F.array().cast("array<struct<start:int,pattern:int,name:string,kind:string,params:string,return_type:string>>")))
    found = blocks.select(key, "block", "family", F.col("b.code").alias("code"), F.col("b.line_number").alias("block_line"), F.explode(F.concat(*every)).alias("m")).select(key, "block", "family", "code", "block_line", "m.*")
    found = found.where(~((F.col("family") == "py") & (F.col("kind") == "function") & F.col("name").startswith("_")) & ~((F.col("kind") == "decorator") & F.col("name").contains(".")))
    first = Window.partitionBy(key, "name").orderBy("block", "pattern", "start")
    found = found.withColumn("r", F.row_number().over(first)).where("r = 1")
    params = F.when(F.col("family") == "py", py_params(F.col("params"))).otherwise(ts_params(F.col("params")))
    return found.select(key, "name", "kind", line_at(F.col("code"), F.col("start")).alias("signature"), params.alias("parameters"), "return_type", "block", "pattern", "start", F.lit("EXTRACTED").alias("confidence"))
