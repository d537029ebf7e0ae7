"""Article pages behind feed entries and listing links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.binding import once
from newsloom.functions.html import read_article
from newsloom.functions.text import is_filled
from newsloom.operators.filters import is_extracted
from newsloom.operators.merge import with_body
from newsloom.operators.skew import spread_join
from newsloom.sources.capture_log import CaptureLog

#: Hot article keys, where the caller has counted them.
Hot = dict[int, int] | None

SELECTORS = ("title_selector", "date_selector", "content_selector")
#: What is read from which page: selectors may be null, ``rendered`` tells which kind of capture to read.
WANTED = ("url", "rendered", *SELECTORS)
# Selectors of an article page when a source names none, and what a feed entry stands for.
TITLE_SELECTOR = "h1"
CONTENT_SELECTOR = "article"


def article_key() -> Column:
    """One text for all that is wanted of a page, so that null selectors can be joined on."""
    return F.to_json(F.struct(*WANTED)).alias("article_key")


def read_articles(wanted: DataFrame, captures: DataFrame | CaptureLog) -> DataFrame:
    """(article_key, article, readable): each wanted page parsed once, however many links lead to it. One with a title and content is readable."""
    bodies = with_body(wanted.select(*WANTED).distinct(), captures)
    article = read_article(F.col("body"), *(F.col(name) for name in SELECTORS), F.col("rendered"))
    read = bodies.select(article_key(), once(article).alias("article"))
    return read.withColumn("readable", is_extracted(F.col("article.title"), F.col("article.content")))


def with_article(links: DataFrame, articles: DataFrame, hot: Hot = None) -> DataFrame:
    """Those of the links (source_id, pos, and what is wanted) that lead to a readable article. No content is read for this."""
    good = articles.where("readable").select("article_key")
    keyed = links.withColumn("article_key", article_key())
    return spread_join(keyed, good, ["article_key"], "left_semi", ["source_id", "pos"], hot=hot).select(*links.columns)


def article_items(links: DataFrame, articles: DataFrame, hot: Hot = None) -> DataFrame:
    """Items of links with their article."""
    good = articles.where("readable").select("article_key", "article")
    keyed = links.select("source_id", "pos", "url", article_key())
    joined = spread_join(keyed, good, ["article_key"], "inner", ["source_id", "pos"], hot=hot)
    date = F.nullif(F.col("article.date_text"), F.lit("")).alias("published_date")
    return joined.select("source_id", "pos", "url", "article.title", date, "article.content")


def wanted_texts(entries: DataFrame) -> DataFrame:
    """Entries with what is wanted of their pages: the text of the first article element, else the whole text."""
    nothing = F.lit(None).cast("string")
    return entries.withColumns(
        {
            "rendered": F.lit(False),
            "title_selector": nothing,
            "date_selector": nothing,
            "content_selector": F.lit(CONTENT_SELECTOR),
        }
    )


def with_full_text(entries: DataFrame, articles: DataFrame, hot: Hot = None) -> DataFrame:
    """Entries with the text of their article as ``full_text``, null or empty where there is none."""
    keyed = wanted_texts(entries).withColumn("article_key", article_key()).select(*entries.columns, "article_key")
    texts = articles.select("article_key", F.col("article.content").alias("full_text"))
    joined = spread_join(keyed, texts, ["article_key"], "left", ["source_id", "pos"], hot=hot)
    return joined.select(*entries.columns, "full_text")


def full_texts(urls: DataFrame, captures: DataFrame | CaptureLog) -> DataFrame:
    """Full text of each captured url: (url, text)."""
    wanted = wanted_texts(urls.select("url").distinct()).withColumn("article_key", article_key())
    read = wanted.join(read_articles(wanted, captures), "article_key").select("url", F.col("article.content").alias("text"))
    return read.where(is_filled(F.col("text")))
