"""HTML listings, plain (``html``) and browser rendered (``js``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import once
from newsloom.functions.html import select_links
from newsloom.functions.urls import join_url
from newsloom.operators.caps import first_per_group
from newsloom.operators.filters import has_href, is_not_source
from newsloom.sources.articles import CONTENT_SELECTOR, TITLE_SELECTOR, WANTED, article_items, with_article


def links_of(opened: DataFrame, kind: str) -> DataFrame:
    """Links of opened listings of a kind in document order, without those back to the listing, with what is wanted
    of their pages."""
    howto = F.col(f"howto.{kind}")
    listings = opened.where(F.col("type") == kind).select(
        "source_id",
        F.col("url").alias("source_url"),
        F.lit(kind == "js").alias("rendered"),
        F.coalesce(howto["title_selector"], F.lit(TITLE_SELECTOR)).alias("title_selector"),
        howto["date_selector"].alias("date_selector"),
        F.coalesce(howto["content_selector"], F.lit(CONTENT_SELECTOR)).alias("content_selector"),
        F.explode(select_links(F.col("body"), howto["list_selector"])).alias("link"),
    )
    found = listings.where(has_href(F.col("link.href"))).withColumn("pos", F.col("link.pos"))
    linked = found.select("*", once(join_url(F.col("source_url"), F.col("link.href"))).alias("url"))
    return linked.where(is_not_source(F.col("url"), F.col("source_url"))).select("source_id", "pos", *WANTED)


def page_urls(opened: DataFrame, kind: str, limit: int) -> DataFrame:
    """Urls that listings offer; the cap counts links, whether or not they lead to an article."""
    return first_per_group(links_of(opened, kind).select("source_id", "pos", "url"), limit, ["source_id"], ["pos"])


def first_links(links: DataFrame, limit: int) -> DataFrame:
    """The first links of each listing. For rendered listings that is the cap: failures are not made up for."""
    return first_per_group(links, limit, ["source_id"], ["pos"])


def full_listings(links: DataFrame, articles: DataFrame, limit: int, hot: dict[int, int] | None = None) -> DataFrame:
    """Items of plain listings. The cap counts articles, so later links make up for those that give none.

    ``articles`` holds all that the links lead to. The cut is made on narrow links that lead to a readable article; only those before it
    get their contents.
    """
    return article_items(first_links(with_article(links, articles, hot), limit), articles, hot)
