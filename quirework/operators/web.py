"""Work pages: metadata, download links, de-duplication by work."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import patterns as P
from ..functions import web as W
from ..functions.expr import compute, reuse
from ..functions.html import tokens
from ..functions.naming import safe_download_name


def page_metadata(df: DataFrame, keys, html: str = "html") -> DataFrame:
    read = compute(df.select(*keys, html), "_tokens", tokens(F.col(html)))
    named = read.select(
        *keys,
        reuse(("page_title",), lambda: W.page_title(F.col("_tokens"))).alias("title"),
        reuse(("page_author",), lambda: W.page_author(F.col("_tokens"))).alias("author"),
    )
    return named.withColumn(
        "file_stem", safe_download_name(F.concat("author", F.lit(" - "), "title"))
    )


def download_links(df: DataFrame, keys, html: str = "html", url: str = "url") -> DataFrame:
    """``(keys, links)`` with a map of format to URL."""
    links = compute(df.select(*keys, html, url), "links", W.download_links(F.col(html), F.col(url)))
    return links.select(*keys, "links")


def picked_formats(links: DataFrame, keys, preferred=P.DEFAULT_FORMAT_ORDER) -> DataFrame:
    best = compute(links, "best", W.pick_format(F.col("links"), preferred))
    return best.select(
        *keys,
        F.col("best.fmt").alias("fmt"),
        F.col("best.url").alias("url"),
        F.when(F.col("best").isNull(), "no_format").otherwise("ok").alias("status"),
    )


def work_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """One row per work, and one per different address that names no work."""
    normalized = df.select(F.col(url).alias("_url"), W.normalize_work_url(F.col(url)).alias("work_url"))
    bad = F.when(F.col("work_url").isNull(), F.col("_url"))
    return (
        normalized.groupBy("work_url", bad.alias("invalid_url"))
        .agg(F.count(F.lit(1)).alias("n_urls"))
        .withColumn("status", F.when(F.col("work_url").isNull(), "invalid").otherwise("ok"))
    )
