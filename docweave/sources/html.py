"""HTML pages to Markdown pages: removal, choice of content and conversion as regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import page_key, strip

# Elements whose content never counts, and those that hold the main content, best first.
DROPPED = ("script", "style", "nav", "header", "footer")
MAIN = (r"(?is)<main\b[^>]*>(.*?)</main\s*>", r"(?is)<article\b[^>]*>(.*?)</article\s*>", r"(?is)<div\b[^>]*class=[\"'][^\"']*md-content[^\"']*[\"'][^>]*>(.*?)</div\s*>", r"(?is)<body\b[^>]*>(.*?)</body\s*>")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Pages with less text than this are dropped.
SHORTEST = 50


def main_html(html: Column) -> Column:
    """The main content, without scripts, styles and page furniture; elements of one kind are taken not to nest."""
    out = F.coalesce(html, F.lit(""))
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    found = [F.nullif(F.regexp_extract(out, p, 1), F.lit("")) for p in MAIN]
    return F.coalesce(*found, out)


def markdown(html: Column) -> Column:
    """ATX headings, links, bold and italic, list items, fenced code, entities; other tags go."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code\s*>\s*)?</pre\s*>", "\n```\n$1\n```\n")
    for k in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{k}\b[^>]*>\s*(.*?)\s*</h{k}\s*>", "\n" + "#" * k + " $1\n\n")
    out = F.regexp_replace(out, r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", "[$2]($1)")
    out = F.regexp_replace(out, r"(?is)<(b|strong)\b[^>]*>(.*?)</\1\s*>", "**$2**")
    out = F.regexp_replace(out, r"(?is)<(i|em)\b[^>]*>(.*?)</\1\s*>", "*$2*")
    out = F.regexp_replace(out, r"(?is)<code\b[^>]*>(.*?)</code\s*>", "`$1`")
    out = F.regexp_replace(out, r"(?is)<li\b[^>]*>\s*", "\n* ")
    out = F.regexp_replace(out, r"(?is)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?is)</?(p|div|ul|ol|table|tr|section|article)\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for entity, text in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(text))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def pages_from_html(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """page_key, content, source_url and file_type of pages with more than SHORTEST characters of text."""
    rest = [c for c in pages.columns if c not in (url, html)]
    out = pages.select(*rest, page_key(url).alias("page_key"), markdown(main_html(F.col(html))).alias("content"), F.col(url).alias("source_url"), F.lit("md").alias("file_type"))
    return out.where(F.length("content") > SHORTEST)


def sitemap_urls(sitemaps: DataFrame, base_url: str, limit: int = 200, xml: str = "xml") -> DataFrame:
    """The first locations under base_url, sitemap after sitemap (by their column ord, if there is one) in each one's order; base_url itself if there is none."""
    ord_ = F.col("ord") if "ord" in sitemaps.columns else F.lit(0)
    at = sitemaps.select(ord_.alias("ord"), F.posexplode(F.expr(f"xpath({xml}, '//*[local-name()=\"loc\"]/text()')")).alias("pos", "url")).withColumn("url", F.trim("url"))
    found = at.where(F.col("url").startswith(base_url)).orderBy("ord", "pos", "url").limit(limit).select("url")
    return found if not found.isEmpty() else sitemaps.sparkSession.sql(f"SELECT '{base_url}' AS url")
