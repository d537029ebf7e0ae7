"""Joins that fill one column from another table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import is_filled
from newsloom.operators.skew import HOT_ROWS, hot_keys, spread_join
from newsloom.sources.capture_log import CaptureLog


def with_body(
    rows: DataFrame, captures: DataFrame | CaptureLog, row_id: Sequence[str] = (), min_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows (``url``, ``rendered``) that have a successful capture of that kind, with the body of the newest one.

    Captures are a log by url, kind and time, in which a row may come twice. The newest capture is found on narrow columns, with map-side
    combining; of several with that time the one whose body has the least hash counts, so a url and kind has one body. Then each wanted body is read: from a
    :class:`CaptureLog` where it lies, from a frame by one join. Rows that may share a url come with a ``row_id``: if many do, each body is found
    once and given to all of them.
    """
    page = ["url", "rendered"]
    hot = hot_keys(rows, page, min_rows) if row_id else []
    if hot:
        bodies = with_body(rows.select(*page).distinct(), captures)
        return spread_join(rows, bodies, page, "inner", row_id, hot=hot)
    if isinstance(captures, CaptureLog):
        return captures.with_body(rows)
    usable = captures.where("ok").select(*page, "fetched_at", "body").withColumn("_hash", F.xxhash64("body"))
    wanted = usable.drop("body").join(rows.select(*page).distinct(), page, "left_semi")
    newest = wanted.groupBy(*page).agg(F.max(F.struct("fetched_at", F.bitwise_not("_hash").alias("_hash"))).alias("n"))
    chosen = newest.select(*page, "n.fetched_at", F.bitwise_not("n._hash").alias("_hash"))
    found = usable.join(chosen, [*page, "fetched_at", "_hash"])
    return rows.join(found.groupBy(*page).agg(F.first("body").alias("body")), page)


def fill_content(items: DataFrame, texts: DataFrame, row_id: Sequence[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Replace the content of items by the full text of their article, where there is one (``texts``: url, text)."""
    joined = spread_join(items, texts.select("url", F.col("text").alias("_text")), ["url"], "left", row_id, min_rows)
    full = F.when(is_filled(F.col("_text")), F.col("_text")).otherwise(F.col("content"))
    return joined.withColumn("content", full).drop("_text").select(*items.columns)


def fill_summaries(news: DataFrame, summaries: DataFrame) -> DataFrame:
    """Write new summaries into news rows by url (``summaries``: url, summary; both sides unique by url)."""
    new = summaries.select("url", F.col("summary").alias("_new"))
    merged = F.coalesce("_new", "summary")
    return news.join(new, "url", "left").withColumn("summary", merged).drop("_new").select(*news.columns)
