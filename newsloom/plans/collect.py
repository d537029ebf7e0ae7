"""Collect job: sources and captures in, news and outcomes out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.store import News, append_news, as_news, create_news, ingest, instant
from newsloom.session import staged
from newsloom.sources.apis import unreadable_payloads
from newsloom.sources.capture_log import CaptureLog
from newsloom.sources.dispatch import LOOKBACK_DAYS, MAX_ITEMS, fetch_opened, open_sources
from newsloom.sources.feeds import unreadable_feeds
from newsloom.sources.registry import check_sources, source_name


def silent_sources(sources: DataFrame, opened: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sources that gave no item, and why: (source_id, name, type, reason). Every source either has an outcome or is here.

    ``no_capture``: nothing was fetched for it; ``unreadable``: its feed cannot be read, or its path leads to no list; ``no_items``: it was read, and all it
    offers is old, leads back to it or has no article.
    """
    unreadable = unreadable_feeds(opened).select("source_id").unionByName(unreadable_payloads(opened).select("source_id"))
    silent = sources.join(outcomes.select("source_id").distinct(), "source_id", "left_anti")
    marked = silent.join(opened.select("source_id", F.lit(True).alias("_opened")), "source_id", "left")
    marked = marked.join(unreadable.distinct().withColumn("_unreadable", F.lit(True)), "source_id", "left")
    reason = F.when(F.col("_opened").isNull(), "no_capture").when(F.col("_unreadable"), "unreadable").otherwise("no_items")
    return marked.select("source_id", source_name(F.col("name"), F.col("url")).alias("name"), "type", reason.alias("reason"))


def collect_and_report(
    spark: SparkSession,
    sources: DataFrame,
    captures: DataFrame | CaptureLog,
    news_path: str,
    now: datetime,
    lookback_days: int = LOOKBACK_DAYS,
    limit: int = MAX_ITEMS,
    batch: tuple[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ingest what the captures offer; gives every item with its outcome, and the sources that gave none with the reason.

    Running it again over the same captures inserts nothing: the store is asked first. A ``batch`` (stream, number) is remembered with the commit.
    """
    create_news(spark, news_path)
    table = News.now(spark, news_path)
    check_sources(sources)
    opened = staged(open_sources(sources, captures), "opened")
    outcomes = ingest(fetch_opened(opened, captures, instant(now), lookback_days, limit), table)
    append_news(as_news(outcomes, instant(now)), news_path, table, batch)
    return outcomes, silent_sources(sources, opened, outcomes)


def collect(
    spark: SparkSession,
    sources: DataFrame,
    captures: DataFrame | CaptureLog,
    news_path: str,
    now: datetime,
    lookback_days: int = LOOKBACK_DAYS,
    limit: int = MAX_ITEMS,
) -> DataFrame:
    """The outcomes of :func:`collect_and_report`."""
    return collect_and_report(spark, sources, captures, news_path, now, lookback_days, limit)[0]
