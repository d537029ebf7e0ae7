from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from newsloom.functions import times


def at(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def test_mail_dates_agree_with_the_standard_library(evaluate):
    texts = [
        "Fri, 06 Feb 2026 10:00:00 GMT", "06 Feb 2026 10:00 +0100", "Fri, 6 Feb 2026 10:00:00 EST",
        "Fri, 06 Feb 2026 10:00:00 -0000", "Fri, 06 Feb 26 10:00:00 +0000", "06 Feb 99 10:00:00 -0530",
        "Fri, 06 Feb 2026 10:00:00 Z", "Fri, 06 Feb 2026 10:00:00", "Fri, 06 Feb 2026 10:00:00 PDT",
        "Fri, 31 Dec 2027 23:59:59 +1400",
    ]
    got = evaluate([(t,) for t in texts], "t string", times.iso_text(times.mail_date(F.col("t"))))
    want = []
    for text in texts:
        parsed = parsedate_to_datetime(text)
        parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
        want.append(parsed.astimezone(timezone.utc).isoformat())
    assert got == want


def test_other_dates_are_unknown(evaluate):
    texts = ["2026-02-06T00:00:00Z", "2026-02-06 10:00:00", "junk", "", None, "31 Feb 2026 10:00:00 GMT"]
    assert evaluate([(t,) for t in texts], "t string", times.mail_date(F.col("t"))) == [None] * len(texts)


def test_first_readable_date(evaluate):
    rows = [("2026-02-06T00:00:00Z", "Fri, 06 Feb 2026 10:00:00 GMT", "01 Jan 2020 00:00 GMT")]
    got = evaluate(rows, "a string, b string, c string", times.iso_text(times.first_mail_date(*map(F.col, "abc"))))
    assert got == ["2026-02-06T10:00:00+00:00"]


def test_iso_text_shows_a_fraction_only_when_there_is_one(evaluate):
    moments = [at(2026, 2, 6), at(2026, 2, 6, 1, 2, 3, 450000)]
    got = evaluate([(m,) for m in moments], "t timestamp", times.iso_text(F.col("t")))
    assert got == [m.isoformat() for m in moments]


def test_iso_year_and_week(evaluate):
    days = [at(2027, 1, 1) + timedelta(days=97 * i) for i in range(60)] + [at(2026, 2, 6)]
    got = evaluate([(d,) for d in days], "t timestamp", times.iso_year(F.col("t")), times.iso_week(F.col("t")))
    assert got == [tuple(d.isocalendar())[:2] for d in days]


def test_week_and_rolling_bounds(spark):
    row = spark.createDataFrame([(at(2026, 2, 6, 5),)], "t timestamp").select(
        times.iso_text(times.week_start(F.col("t"))),
        times.iso_text(times.week_end(F.col("t"))),
        times.iso_text(times.rolling_start(F.col("t"), 3)),
        times.iso_text(times.rolling_end(F.col("t"))),
    )
    midnight = "T00:00:00+00:00"
    assert [v.removesuffix(midnight) for v in row.first()] == ["2026-02-02", "2026-02-09", "2026-02-04", "2026-02-07"]
