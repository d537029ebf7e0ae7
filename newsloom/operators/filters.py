"""Predicates of the collect and analyze jobs, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import is_filled, strip
from newsloom.functions.urls import is_same_url, normalize_url


def recent_enough(published: Column, now: Column, lookback_days: int) -> Column:
    """Published within the lookback; items without a known date pass."""
    return published.isNull() | (published >= now - F.make_dt_interval(days=F.lit(lookback_days)))


def has_link_and_title(link: Column, title: Column) -> Column:
    return is_filled(link) & is_filled(strip(title))


def is_not_source(url: Column, source_url: Column) -> Column:
    """An item that only leads back to its source is none."""
    return ~F.coalesce(is_same_url(url, normalize_url(source_url)), F.lit(False))


def has_content(content: Column) -> Column:
    return is_filled(content)


def is_extracted(title: Column, content: Column) -> Column:
    return is_filled(title) & is_filled(content)


def has_href(href: Column) -> Column:
    return is_filled(href)


def awaits_summary(summary: Column, content: Column) -> Column:
    """Null and empty summaries both count as missing."""
    return ~is_filled(summary) & is_filled(content)
