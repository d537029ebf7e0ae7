"""Incremental ingest of captures or items as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from newsloom.operators.store import News, append_news, as_news, create_news, ingest, instant
from newsloom.session import cut_lineage, cut_lineage_measured, staged
from newsloom.sources.capture_log import CaptureLog
from newsloom.sources.dispatch import LOOKBACK_DAYS, fetch, open_sources
from newsloom.sources.feeds import entries_of
from newsloom.sources.listings import links_of
from newsloom.sources.registry import check_sources

#: What a source leads to, kept beside the captures, in folders by a hash of the url.
LINKS = "source_id int, url string, slot int"
LINK_SLOTS = 16


def ingest_items(
    news_path: str, clock: Callable[[int], datetime], stream: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch function that ingests items. A batch that is run again finds its rows stored and adds nothing; where the ``stream`` has a
    name, each commit remembers its batch, and the same batch is not even looked at again. A writer that another one has overtaken fails, and its batch is run again."""

    def batch(items: DataFrame, batch_id: int) -> None:
        spark, name = items.sparkSession, (stream, batch_id) if stream else None
        create_news(spark, news_path)
        table = News.now(spark, news_path)
        if table.manifest.has(name):
            return
        outcomes = ingest(items, table)
        append_news(as_news(outcomes, instant(clock(batch_id))), news_path, table, name)

    return batch


def slot(url: Column) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(url), 40), F.lit(LINK_SLOTS)).cast("int")


class Links:
    """Which source has led to which url, each once."""

    def __init__(self, path: str) -> None:
        self.path = path

    def of(self, urls: DataFrame) -> DataFrame:
        """Links to those urls; only the folders of these urls are read."""
        asked, (slots,) = cut_lineage_measured(urls.select("url", slot(F.col("url")).alias("slot")).distinct(), F.collect_set("slot"))
        spark = urls.sparkSession
        spark.createDataFrame([], LINKS).write.mode("append").partitionBy("slot").parquet(self.path)
        links = spark.read.schema(LINKS).parquet(self.path).where(F.col("slot").isin(slots or []))
        return links.join(asked, ["slot", "url"], "left_semi").select("source_id", "url")

    def add(self, leads: DataFrame) -> None:
        """Keep those that are new."""
        leads = cut_lineage(leads.distinct())
        new = leads.join(self.of(leads), ["source_id", "url"], "left_anti")
        new.withColumn("slot", slot(F.col("url"))).write.mode("append").partitionBy("slot").parquet(self.path)


def ingest_captures(
    sources: DataFrame, log_path: str, news_path: str, clock: Callable[[int], datetime], stream: str | None = None, **limits: int
) -> Callable[[DataFrame, int], None]:
    """Batch function that takes captures, which may come in any order: a listing, its articles and what replaces them.

    Each batch is added to the capture log under ``log_path``; the sources that it touches, by their own url or one that they have led to, are
    read from all captures so far. A batch that is run again may add its captures twice, which changes nothing. What is stored stays: a
    feed entry whose article comes later keeps the text of the feed, and of items with the same url or title the one that could be read first counts.
    """
    check_sources(sources)
    store = ingest_items(news_path, clock, stream)

    def batch(captures: DataFrame, batch_id: int) -> None:
        spark, now = captures.sparkSession, instant(clock(batch_id))
        if stream and News.now(spark, news_path).manifest.has((stream, batch_id)):
            return
        log, links = CaptureLog(spark, f"{log_path}/captures"), Links(f"{log_path}/links")
        log.append(captures)
        arrived = cut_lineage(captures.select("url").distinct())
        renewed = sources.join(arrived, "url", "left_semi")
        opened = staged(open_sources(renewed, log), "renewed")
        entries = entries_of(opened, now, limits.get("lookback_days", LOOKBACK_DAYS))
        leads = (found.select("source_id", "url") for found in (entries, links_of(opened, "html"), links_of(opened, "js")))
        links.add(reduce(DataFrame.unionByName, leads))
        touched = cut_lineage(links.of(arrived).select("source_id").unionByName(renewed.select("source_id")).distinct())
        store(fetch(sources.join(touched, "source_id", "left_semi"), log, now, **limits), batch_id)

    return batch


def wall_clock(batch_id: int) -> datetime:
    return datetime.now(timezone.utc)


def start_ingest(
    arriving: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Run a batch function over a stream. State lives in the news table, not in the stream: keys never expire."""
    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
