from datetime import datetime, timezone

from pyspark.sql import functions as F

from newsloom.operators import store
from newsloom.operators.rollup import tally
from newsloom.schemas import ITEMS, NEWS


def at(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def items(spark, *rows):
    return spark.createDataFrame([(s, p, u, t, None, c) for s, p, u, t, c in rows], ITEMS)


def outcomes(spark, path, rows, now=at(2026, 2, 6), **tuning):
    result = store.ingest(items(spark, *rows), store.read_news(spark, path), **tuning)
    found = {(r.source_id, r.pos): r.outcome for r in result.collect()}
    store.append_news(store.as_news(result, store.instant(now)), path)
    return found


def test_an_item_is_inserted_once(spark, tmp_path):
    path = str(tmp_path / "news")
    store.create_news(spark, path)
    item = (1, 0, "https://example.com/a", "Title A", "Hello world")
    assert outcomes(spark, path, [item]) == {(1, 0): "inserted"}
    assert outcomes(spark, path, [item]) == {(1, 0): "duplicate"}
    row = store.read_news(spark, path).first()
    assert (row.url, row.title, row.summary, row.content, row.iso_year, row.iso_week) == (item[2], "Title A", None, "Hello world", 2026, 6)


def test_creating_the_table_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "news")
    store.create_news(spark, path)
    assert store.read_news(spark, path).count() == 0
    outcomes(spark, path, [(1, 0, "u", "t", "c")])
    store.create_news(spark, path)
    assert store.read_news(spark, path).count() == 1


def test_outcomes_and_their_order(spark, tmp_path):
    path = str(tmp_path / "news")
    store.create_news(spark, path)
    outcomes(spark, path, [(1, 0, "u0", "t0", "c")])
    batch = [
        (2, 0, "u1", "t1", ""),  # empty, blocks nobody
        (2, 1, "u1", "t0", "c"),  # title is stored, blocks nobody
        (2, 2, "u1", "t2", "c"),
        (3, 0, "u3", "t2", "c"),  # title of the one before
        (3, 1, "u3", "t3", None),
        (10, 0, "u3", "t4", "c"),
    ]
    assert outcomes(spark, path, batch) == {
        (2, 0): "no_content", (2, 1): "duplicate", (2, 2): "inserted",
        (3, 0): "duplicate", (3, 1): "no_content", (10, 0): "inserted",
    }


def test_tally(spark):
    rows = [(1, "inserted"), (1, "duplicate"), (1, "inserted"), (2, "no_content")]
    got = tally(spark.createDataFrame(rows, "source_id int, outcome string")).orderBy("source_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 0), (2, 0, 0, 1)]


def news_rows(spark, *rows):
    full = [(u, t, None, None, when, n, c, s, *when.isocalendar()[:2]) for n, (u, t, when, c, s) in enumerate(rows)]
    return spark.createDataFrame(full, NEWS)


def test_range_is_half_open_and_prunes_weeks(spark, tmp_path):
    path = str(tmp_path / "news")
    store.append_news(
        news_rows(
            spark, ("https://example.com/a", "A", at(2026, 2, 5), "A", None), ("https://example.com/b", "B", at(2026, 2, 7), "B", None),
            ("c", "C", at(2026, 2, 8), "C", None), ("d", "D", at(2026, 2, 6), "D", None), ("e", "E", at(2025, 12, 30), "E", None),
        ),
        path,
    )
    day = lambda text: F.lit(f"{text} 00:00:00").cast("timestamp")
    found = store.news_between(store.read_news(spark, path), day("2026-02-06"), day("2026-02-08"))
    assert [r.title for r in found.collect()] == ["D", "B"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "iso_year" in filters and "iso_week" in filters
    assert "GreaterThanOrEqual(collected_at" in plan
    whole = store.collected_between(store.read_news(spark, path), day("2025-12-29"), day("2026-03-01"))
    assert whole.count() == 5


def test_summary_update_touches_its_weeks_only(spark, tmp_path):
    path = tmp_path / "news"
    store.append_news(
        news_rows(
            spark, ("a", "A", at(2026, 2, 5), "A", None), ("b", "B", at(2026, 2, 6), "B", "old"), ("c", "C", at(2026, 2, 16), "C", "kept"),
        ),
        str(path),
    )
    other = sorted(f.name for f in path.glob("iso_year=2026/iso_week=8/*.parquet"))
    summaries = spark.createDataFrame([("a", "new"), ("zzz", "lost")], "url string, summary string")
    store.update_summaries(spark, str(path), summaries)
    got = {r.url: r.summary for r in store.read_news(spark, str(path)).collect()}
    assert got == {"a": "new", "b": "old", "c": "kept"}
    assert sorted(f.name for f in path.glob("iso_year=2026/iso_week=8/*.parquet")) == other
    store.update_summaries(spark, str(path), summaries.where("url = 'zzz'"))
    assert store.read_news(spark, str(path)).count() == 3
