"""Instants, ISO weeks and publication dates. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let_sql

# Zone names a mail-style date may carry, in minutes east of UTC. Other names count as UTC.
ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

# Day, month name, year, time and zone of a mail-style date, the day name being optional.
MAIL_DATE = (
    r"(?i)^\s*(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(\d{1,2})[\s-]+"
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[\s-]+(\d{4}|\d{2})"
    r",?\s+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\s*([+-]\d{4})|\s+([a-z]+))?"
)


def mail_date(text: Column) -> Column:
    """Instant of a mail-style date (RFC 2822), null when the text is none. Dates without a zone are UTC."""
    parts = F.split(F.regexp_replace(text, f"{MAIL_DATE}(?s:.*)", "\n".join(f"${i}" for i in range(1, 9))), "\n")
    year = "CASE WHEN length(p[2]) = 4 THEN p[2] WHEN p[2] > '68' THEN '19' || p[2] ELSE '20' || p[2] END"
    stamp = f"concat_ws(' ', {year}, initcap(p[1]), p[0], concat_ws(':', p[3], p[4], if(p[5] = '', '0', p[5])))"
    numeric = "(CAST(substring(p[6], 2, 2) AS INT) * 60 + CAST(substring(p[6], 4, 2) AS INT)) * if(startswith(p[6], '-'), -1, 1)"
    zones = f"map({', '.join(f"'{zone}', {minutes}" for zone, minutes in ZONES.items())})"
    east = f"coalesce(if(p[6] <> '', {numeric}, {zones}[upper(p[7])]), 0)"
    read = f"p -> try_to_timestamp({stamp}, 'y MMM d H:m:s') - make_dt_interval(0, 0, {east}, 0)"
    return let_sql(F.when(text.rlike(MAIL_DATE), parts), read)


def first_mail_date(*texts: Column) -> Column:
    """The first of several dates that can be read."""
    return F.coalesce(*(mail_date(text) for text in texts))


def any_date(text: Column) -> Column:
    """Best effort over the mixed dates of listings and payloads."""
    return F.coalesce(F.try_to_timestamp(text), mail_date(text))


def iso_text(instant: Column) -> Column:
    """ISO 8601 text of a UTC instant; a fraction is shown only where there is one."""
    stamp = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(stamp, r"\.000000$", ""), F.lit("+00:00"))


def iso_year(instant: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), instant).cast("int")


def iso_week(instant: Column) -> Column:
    return F.weekofyear(instant)


def week_start(instant: Column) -> Column:
    """Monday, midnight."""
    return F.date_trunc("WEEK", instant)


def week_end(instant: Column) -> Column:
    return week_start(instant) + F.make_dt_interval(days=F.lit(7))


def rolling_end(instant: Column) -> Column:
    """The midnight after: a rolling window takes in the whole current day."""
    return F.date_trunc("DAY", instant) + F.make_dt_interval(days=F.lit(1))


def rolling_start(instant: Column, days: int | Column) -> Column:
    return rolling_end(instant) - F.make_dt_interval(days=days if isinstance(days, Column) else F.lit(days))


def in_window(instant: Column, start: Column, end: Column) -> Column:
    """Half open: the start belongs to the window, the end does not."""
    return (instant >= start) & (instant < end)
