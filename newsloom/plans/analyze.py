"""Analyze job: summaries and digest of a window of news."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import times
from newsloom.operators.filters import awaits_summary
from newsloom.operators.merge import fill_summaries
from newsloom.operators.requests import first_sentences, responses_by_key, summarize, summary_requests
from newsloom.operators.rollup import PART_ENTRIES, digest_heads, digest_parts, entry_blocks, write_digests
from newsloom.operators.store import collected_between, create_news, instant, read_news, update_summaries
from newsloom.session import cut_lineage


def window(now: Column, days: int | None = None) -> tuple[Column, Column]:
    """The ISO week of ``now``, or the last ``days`` days with the current one."""
    if days is None:
        return times.week_start(now), times.week_end(now)
    return times.rolling_start(now, days), times.rolling_end(now)


def new_summaries(
    rows: DataFrame, summarizer: Callable[[Column], Column] | None, responses: DataFrame | None
) -> DataFrame:
    """Summaries for rows that lack one: (url, summary)."""
    pending = rows.where(awaits_summary(F.col("summary"), F.col("content")))
    if responses is not None:
        answers = responses_by_key(summary_requests(rows), responses)
        return answers.select(F.col("key").alias("url"), F.col("output").alias("summary"))
    return summarize(pending, summarizer or first_sentences).select("url", "summary")


def analyze(
    spark: SparkSession,
    news_path: str,
    now: datetime,
    days: int | None = None,
    skip_summaries: bool = False,
    summarizer: Callable[[Column], Column] | None = None,
    responses: DataFrame | None = None,
    output: str | None = None,
    part_entries: int = PART_ENTRIES,
    **layout,
) -> DataFrame:
    """Fill summaries of the window, update the table and give the digest of the current week in parts.

    A rolling window is labelled with the current week as well. Summaries come from ``responses`` of a model if
    given, else from ``summarizer``.
    """
    create_news(spark, news_path)
    moment = instant(now)
    start, end = window(moment, days)
    rows = collected_between(read_news(spark, news_path), start, end)
    if not skip_summaries:
        summaries = cut_lineage(new_summaries(rows, summarizer, responses))
        rows = fill_summaries(rows, summaries)
        update_summaries(spark, news_path, summaries, (start, end))
    label = {"iso_year": times.iso_year(moment), "iso_week": times.iso_week(moment)}
    heads = digest_heads(spark.range(1).withColumns(label), F.date_format(moment, "yyyy-MM-dd"), days, **layout)
    parts = cut_lineage(digest_parts(entry_blocks(rows.withColumns(label)), heads, part_entries=part_entries))
    if output:
        write_digests(parts, output)
    return parts
