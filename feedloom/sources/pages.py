"""Pages and texts, and facts read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.html import decoded
from feedloom.functions.text import nonempty, trimmed


def usable_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages long enough to be a paper; with ``http_status`` and ``content_type`` those must fit."""
    out = pages.where(F.octet_length("html") >= least)
    if "http_status" in pages.columns:
        out = out.where("http_status = 200")
    if "content_type" in pages.columns:
        out = out.where(F.startswith("content_type", F.lit("text/html")))
    return out


def _plain(s: Column) -> Column:
    return trimmed(F.regexp_replace(decoded(F.regexp_replace(s, "<[^>]+>", " ")), r"\s+", " "))


def page_title(html: Column) -> Column:
    """From the first 8 KB; a leading ``[id]`` is taken off."""
    title = _plain(F.regexp_extract(F.substring(html, 1, 8192), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.regexp_replace(title, r"^\[[^\]]*\]\s*", "")


def page_abstract(html: Column) -> Column:
    """From the meta tag, else from the abstract's block quote."""
    meta = F.regexp_extract(html, r'(?is)<meta[^>]*name="citation_abstract"[^>]*content="([^"]*)"', 1)
    quote = F.regexp_extract(html, r'(?is)<blockquote[^>]*class="[^"]*abstract[^"]*"[^>]*>(.*?)</blockquote>', 1)
    return F.regexp_replace(_plain(F.coalesce(nonempty(meta), nonempty(quote), F.lit(""))), r"^Abstract:\s*", "")


def first_success(html: Column, tex: Column, html_error: Column, tex_error: Column) -> Column:
    """``struct<text, error>``: HTML if there is any, else TeX, else both errors."""
    text = F.coalesce(nonempty(html), nonempty(tex))
    error = F.concat_ws("; ", nonempty(html_error), nonempty(tex_error))
    return F.struct(text.alias("text"), F.when(text.isNull(), error).alias("error"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files; ``~`` is the home folder."""
    import os

    rows = spark.read.text(os.path.expanduser(path) if path.startswith("~") else path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
