"""Queries over composed Markdown pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.params import py_params, ts_params
from docweave.functions.text import language, slugify
from docweave.operators import markdown, merge

from . import compose
from .compose import CODE, PAGES
from .registry import query, table

_Q = "chr(96) || chr(96) || chr(96)"


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.parsed(compose.pages(spark, folder))


_BODY = "regexp_replace(content, '^---\\s*\\n[^-]*\\n---\\s*\\n', '')"
_LINES = f"""m AS ({PAGES}), b AS (SELECT page_key, {_BODY} AS body FROM m),
l AS (SELECT page_key, unnest(string_split(body, chr(10))) AS x, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS n FROM b),
f AS (SELECT page_key, min(n) AS a, max(n) AS z FROM l WHERE starts_with(x, {_Q}) GROUP BY page_key),
o AS (SELECT l.page_key, x, n FROM l JOIN f USING (page_key) WHERE n < a OR n > z)"""


@query("md_headings", f"""WITH {_LINES}
SELECT page_key, trim(regexp_extract(x, '^(#{{1,6}})\\s+(.+?)(?:\\s*#*)?$', 2)) AS text, len(regexp_extract(x, '^(#{{1,6}})', 1))::INTEGER AS level, n::INTEGER AS line_number,
trim(regexp_replace(regexp_replace(lower(trim(regexp_extract(x, '^(#{{1,6}})\\s+(.+?)(?:\\s*#*)?$', 2))), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g'), '-') AS slug
FROM o WHERE regexp_matches(x, '^#{{1,6}}\\s+.')""")
def md_headings(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("page_key", F.explode("headings").alias("h")).select("page_key", "h.*")


@query("md_links", f"""WITH {_LINES}
SELECT page_key, unnest(regexp_extract_all(x, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1)) AS text, unnest(regexp_extract_all(x, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2)) AS url, n::INTEGER AS line_number,
regexp_matches(unnest(regexp_extract_all(x, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2)), '^(/|\\./|\\.\\./|#)') AS is_internal FROM o WHERE x LIKE '%](%'""")
def md_links(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("page_key", F.explode("links").alias("l")).select("page_key", "l.*")


@query("md_tables", f"""WITH {_LINES},
t AS (SELECT page_key, x, n, lag(x) OVER w AS above, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY page_key ORDER BY n)),
h AS (SELECT page_key, n AS line_number FROM t WHERE x LIKE '| Name |%'),
r AS (SELECT page_key, x, row_number() OVER (PARTITION BY page_key ORDER BY n) AS k FROM o WHERE starts_with(x, '|') AND ends_with(x, '|'))
SELECT h.page_key, h.line_number::INTEGER AS line_number, 'Usage of ' || p_type AS context, trim(string_split(trim(x, '|'), '|')[1]) AS first_cell, trim(string_split(trim(x, '|'), '|')[2]) AS second_cell
FROM h JOIN r USING (page_key) JOIN m USING (page_key) WHERE k > 2""")
def md_tables(spark: SparkSession, folder: str) -> DataFrame:
    t = _parsed(spark, folder).select("page_key", F.explode("tables").alias("t")).select("page_key", "t.line_number", F.col("t.context_heading").alias("context"), F.explode("t.rows").alias("r"))
    return t.select("page_key", "line_number", "context", F.get("r", F.lit(0)).alias("first_cell"), F.get("r", F.lit(1)).alias("second_cell"))


@query("md_code_blocks", f"""WITH m AS ({PAGES})
SELECT page_key, CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'javascript' ELSE '' END AS language,
CASE WHEN p_size % 3 = 0 AND p_size % 4 <> 3 THEN 'Example ' || p_size ELSE '' END AS title, '# in code' || chr(10) || code AS code FROM m""")
def md_code_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("page_key", F.explode("code_blocks").alias("b")).select("page_key", "b.language", "b.title", "b.code")


@query("md_code_blocks_compat", f"""WITH m AS ({PAGES}), b AS (SELECT page_key, {_BODY} AS body FROM m)
SELECT page_key, trim(regexp_extract(body, '(?s)\\n' || {_Q} || '([^\\s]*)\\s+([^\\n]*)\\n', 2)) AS title, len(regexp_extract(body, '(?s)\\n' || {_Q} || '([^\\s]*)\\s+([^\\n]*)\\n(.*?)\\n' || {_Q}, 3))::INTEGER AS code_chars FROM b""")
def md_code_blocks_compat(spark: SparkSession, folder: str) -> DataFrame:
    rows = markdown.parsed(compose.pages(spark, folder), compat=True).select("page_key", F.explode("code_blocks").alias("b"))
    return rows.select("page_key", "b.title", F.length("b.code").alias("code_chars"))


@query("md_page_summary", f"""WITH {_LINES}, w AS (SELECT page_key, sum(len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')))::INTEGER AS word_count FROM o GROUP BY page_key)
SELECT page_key, CASE WHEN p_size % 5 = 0 THEN 'Front ' || p_brand ELSE p_name END AS title, word_count FROM m JOIN w USING (page_key)""")
def md_page_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select("page_key", "title", "word_count")


_PATTERNS = [(o, lang, k, p, g, a, r) for o, lang, k, p, g, a, r in markdown.SIGNATURES]
_SIGNATURE_SQL = " UNION ALL ".join(
    f"SELECT page_key, {o} AS pattern, '{k}' AS kind, unnest(regexp_extract_all(code, '{p}', {g})) AS name, unnest(range(len(regexp_extract_all(code, '{p}', {g})))) AS place FROM m WHERE " + ("p_size % 4 = 0" if lang == "py" else "p_size % 4 IN (1, 2)")
    for o, lang, k, p, g, a, r in _PATTERNS
)


@query("md_signatures", f"""WITH m AS ({PAGES}), s AS ({_SIGNATURE_SQL}),
k AS (SELECT *, row_number() OVER (PARTITION BY page_key, name ORDER BY pattern, place) AS r FROM s WHERE NOT (kind = 'function' AND starts_with(name, '_')))
SELECT page_key, name, kind, pattern::INTEGER AS pattern FROM k WHERE r = 1""")
def md_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.signatures(_parsed(spark, folder)).select("page_key", "name", "kind", "pattern")


@query("md_signature_kinds", f"""WITH m AS ({PAGES}), s AS ({_SIGNATURE_SQL}),
k AS (SELECT *, row_number() OVER (PARTITION BY page_key, name ORDER BY pattern, place) AS r FROM s WHERE NOT (kind = 'function' AND starts_with(name, '_')))
SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM k WHERE r = 1 GROUP BY kind""")
def md_signature_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return markdown.signatures(_parsed(spark, folder)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query("md_slugs", """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' & ' || p_type || ', v' || p_size || '! ')), '[^\\w\\s-]', '', 'g'), '\\s+', '-', 'g'), '-') AS slug FROM part""")
def md_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", slugify(F.concat("p_name", F.lit(" & "), "p_type", F.lit(", v"), "p_size", F.lit("! "))).alias("slug"))


@query("md_fence_languages", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'bash' WHEN 3 THEN 'yaml' WHEN 4 THEN 'rust' ELSE 'ruby' END AS language FROM part")
def md_fence_languages(spark: SparkSession, folder: str) -> DataFrame:
    given = F.element_at(F.array(*[F.lit(x) for x in ("Py", "tsx", "shell", "YML", "Rust", "rb")]), F.col("p_size") % 6 + 1)
    return table(spark, folder, "part").select("p_partkey", language(given).alias("language"))


@query("ts_params", """SELECT p_partkey, unnest(['a', 'b', '{c}', 'd']) AS name, unnest(['string', 'number', 'Opts', 'unknown']) AS type, unnest([true, false, true, false]) AS required, unnest([NULL, CAST(p_size AS STRING), NULL, NULL]) AS "default" FROM part""")
def ts_params_query(spark: SparkSession, folder: str) -> DataFrame:
    given = F.concat(F.lit("a: string, b?: number = "), F.col("p_size").cast("string"), F.lit(", {c}: Opts, d?,"))
    return table(spark, folder, "part").select("p_partkey", F.explode(ts_params(given)).alias("p")).select("p_partkey", "p.*")


@query("py_params", """SELECT p_partkey, unnest(['a', 'args', 'b', '', 'c']) AS name, unnest(['int', 'unknown', 'unknown', 'unknown', 'str']) AS type, unnest([false, true, false, true, true]) AS required, unnest([CAST(p_size AS STRING), NULL, '2', NULL, NULL]) AS "default" FROM part""")
def py_params_query(spark: SparkSession, folder: str) -> DataFrame:
    given = F.concat(F.lit("self, a: int = "), F.col("p_size").cast("string"), F.lit(", *args, b=2, *, c: str"))
    return table(spark, folder, "part").select("p_partkey", F.explode(py_params(given)).alias("p")).select("p_partkey", "p.*")


@query("guide_gate", f"""WITH m AS ({PAGES})
SELECT 'shop@1::guides/' || page_key AS id, CASE WHEN p_size % 5 = 0 THEN 'Front ' || p_brand ELSE p_name END AS title, 1 AS n_examples FROM m""")
def guide_gate(spark: SparkSession, folder: str) -> DataFrame:
    return merge.guides(_parsed(spark, folder), "shop@1").select("id", "title", F.size("code_examples").alias("n_examples"))


@query("merge_symbols", """WITH a AS (SELECT 'p' || p_size AS page_key, p_name AS name, min(p_partkey) AS k FROM part GROUP BY p_size, p_name),
b AS (SELECT 'p' || p_size AS page_key, p_name AS name, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'about ' || p_partkey END AS description FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 'p' || p_size, 'extra ' || p_brand, 5000000 + p_partkey, 'more' FROM part WHERE p_partkey % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY page_key, name ORDER BY ord) AS r FROM b)
SELECT a.page_key, a.name, CASE WHEN f.name IS NOT NULL THEN f.description ELSE 'own' END AS description, 'EXTRACTED' AS confidence FROM a LEFT JOIN f ON a.page_key = f.page_key AND a.name = f.name AND r = 1
UNION ALL SELECT b.page_key, b.name, b.description, 'INFERRED' FROM b WHERE starts_with(b.name, 'extra ')""")
def merge_symbols_query(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("page_key", F.concat(F.lit("p"), "p_size"))
    blank = [F.lit("function").alias("kind"), F.lit("").alias("signature"), F.array().cast("array<string>").alias("parameters"), F.lit("").alias("return_type"), F.lit(False).alias("deprecated"), F.lit(None).cast("string").alias("deprecated_by")]
    first = part.select("page_key", F.col("p_name").alias("name")).distinct().select("*", F.lit("own").alias("description"), *blank)
    text = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("about "), "p_partkey"))
    second = part.where("p_partkey % 2 = 0").select("page_key", F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), text.alias("description"))
    second = second.unionByName(part.where("p_partkey % 5 = 0").select("page_key", F.concat(F.lit("extra "), "p_brand").alias("name"), (F.col("p_partkey") + 5000000).alias("ord"), F.lit("more").alias("description")))
    return merge.merge_symbols(first, second.select("*", *blank)).select("page_key", "name", "description", "confidence")
