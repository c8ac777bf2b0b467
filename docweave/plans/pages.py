"""Queries over the pages table: HTML to Markdown, keys, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import graph, markdown, merge
from docweave.sources import html

from .registry import query, table

_KEY = "CASE WHEN k = '' THEN 'index.md' WHEN k LIKE '%.md' THEN k ELSE k || '.md' END"
_PATH = "trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')"
_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<nav\\b.*?</nav\\s*>', '', 'g'), '(?is)<header\\b.*?</header\\s*>', '', 'g'), '(?is)<footer\\b.*?</footer\\s*>', '', 'g')"
_MAIN = f"SELECT page_id, url, coalesce(nullif(regexp_extract(h, '(?is)<main\\b[^>]*>(.*?)</main\\s*>', 1), ''), nullif(regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), ''), nullif(regexp_extract(h, '(?is)<body\\b[^>]*>(.*?)</body\\s*>', 1), ''), h) AS m FROM (SELECT page_id, url, {_STRIPPED} AS h FROM pages)"


@query("page_key_from_url", f"SELECT page_id, {_KEY} AS page_key FROM (SELECT page_id, {_PATH} AS k FROM pages)")
def page_key_from_url(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.page_key("url").alias("page_key"))


@query("page_key_last_wins", f"SELECT page_key, max(page_id) AS page_id, count(*) AS n, max_by(url, page_id) AS url FROM (SELECT page_id, url, {_KEY} AS page_key FROM (SELECT page_id, url, {_PATH} AS k FROM pages)) GROUP BY page_key")
def page_key_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "pages").select("page_id", "url", text.page_key("url").alias("page_key"))
    return p.groupBy("page_key").agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"), F.max_by("url", "page_id").alias("url"))


@query("html_main_text_len", f"SELECT page_id, length(m) AS main_chars, length(regexp_replace(m, '(?s)<[^>]+>', '', 'g')) AS text_chars FROM ({_MAIN})")
def html_main_text_len(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "pages").select("page_id", html.main_html(F.col("html")).alias("m"))
    return m.select("page_id", F.length("m").cast("long").alias("main_chars"), F.length(F.regexp_replace("m", "(?s)<[^>]+>", "")).cast("long").alias("text_chars"))


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href=[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a\\s*>', 1)) AS url FROM pages")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """Of the whole pages, furniture included: these pages have no links elsewhere."""
    m = table(spark, folder, "pages").select("page_id", F.col("html").alias("m"))
    return m.select("page_id", F.explode(F.regexp_extract_all("m", F.lit(r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"), F.lit(1))).alias("url"))


@query("html_title", f"SELECT page_id, trim(regexp_replace(regexp_extract(m, '(?is)<h1\\b[^>]*>\\s*(.*?)\\s*</h1\\s*>', 1), '\\s+', ' ', 'g')) AS title FROM ({_MAIN})")
def html_title(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "pages").select("page_id", html.main_html(F.col("html")).alias("m"))
    return m.select("page_id", F.trim(F.regexp_replace(F.regexp_extract("m", r"(?is)<h1\b[^>]*>\s*(.*?)\s*</h1\s*>", 1), r"\s+", " ")).alias("title"))


@query("html_to_markdown")
def html_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Nested rewriting without an equal in one SQL text: held by tests on written-out pages."""
    return html.pages_from_html(table(spark, folder, "pages"))


@query("sitemap_urls", "SELECT url FROM (SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') ORDER BY page_id LIMIT 200)")
def sitemap_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The pages' addresses written as sitemaps of 1,000 ids each and read again; the limit is the operator's."""
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = table(spark, folder, "pages").groupBy(F.floor(F.col("page_id") / 1000).alias("ord"))
    rows = maps.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("l")))), lambda x: x["l"]), "").alias("l"))
    return html.sitemap_urls(rows.select("ord", F.concat(F.lit("<urlset>"), "l", F.lit("</urlset>")).alias("xml")), "https://")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Which guides there are for a term, what they link to and how long they are: HTML to a guide graph to a keyword query."""
    parsed = markdown.parsed(html.pages_from_html(table(spark, folder, "pages")))
    last = graph.nodes_last_wins(parsed.select("page_key", F.col("page_id").alias("ord"), "title", "word_count", "code_blocks", "links"), "page_key")
    nodes = merge.guides(last, "web@1", keep=("ord", "word_count", "links"))
    return nodes.where(F.contains(F.lower("title"), F.lit("e"))).select("id", F.col("title").alias("name"), "word_count", F.array_join(F.transform("links", lambda x: x["url"]), " ").alias("links"), "ord").orderBy("name", "ord").limit(20)


@query("guide_search")
def guide_search(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)
