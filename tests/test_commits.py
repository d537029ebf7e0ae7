from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom.operators import commits, store
from newsloom.operators.store import News
from newsloom.schemas import ITEMS
from newsloom.streaming.ingest import ingest_items

NOW = datetime(2026, 2, 6, tzinfo=timezone.utc)


def items(spark, *rows):
    return spark.createDataFrame([(s, p, u, t, None, c) for s, p, u, t, c in rows], ITEMS)


def added(spark, path, rows, batch=None):
    table = News.now(spark, path)
    outcomes = store.ingest(items(spark, *rows), table)
    store.append_news(store.as_news(outcomes, store.instant(NOW)), path, table, batch)
    return sorted((r.source_id, r.pos, r.url, r.outcome) for r in outcomes.collect())


def urls(spark, path):
    return sorted(r.url for r in store.read_news(spark, path).collect())


def test_each_item_is_stored_once_however_often_it_comes(spark, tmp_path):
    path = str(tmp_path / "news")
    twice = [(1, 0, "u", "t", "c")] * 2 + [(1, 1, "v", "s", ""), (1, 1, "v", "s", "c"), (1, 2, "x", "a", "c"), (1, 2, "y", "b", "c")]
    got = added(spark, path, twice)
    assert [outcome for *_, outcome in got] == ["duplicate", "inserted", "inserted", "no_content"] + [o for *_, o in got[4:]]
    assert sorted(o for *_, o in got[4:]) == ["duplicate", "inserted"]
    rows = store.read_news(spark, path).collect()
    assert len(rows) == len({r.ingest_seq for r in rows}) == 3
    assert {o for *_, o in added(spark, path, twice[:2] + twice[3:4])} == {"duplicate"}


def test_outcomes_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    rows = [(1, 0, f"u{i % 7}", f"t{i % 5}", f"c{i}") for i in range(40)]
    first = added(spark, str(tmp_path / "a"), rows)
    assert added(spark, str(tmp_path / "b"), rows[::-1]) == first


def test_a_write_that_fails_half_way_leaves_no_row(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "news")
    added(spark, path, [(1, 0, "u", "t", "c")])

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        added(spark, path, [(1, 1, "v", "s", "c")])
    monkeypatch.undo()
    assert len(list((tmp_path / "news" / "rows").glob("part=*"))) == 2
    assert urls(spark, path) == ["u"]
    assert added(spark, path, [(1, 1, "v", "s", "c")]) == [(1, 1, "v", "inserted")]


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "news")
    table = News.now(spark, path)
    rows = [store.as_news(store.ingest(items(spark, (1, n, "u", f"t{n}", "c")), table), store.instant(NOW)) for n in (0, 1)]
    store.append_news(rows[0], path, table)
    with pytest.raises(commits.ConflictError):
        store.append_news(rows[1], path, table)
    assert store.read_news(spark, path).count() == 1


def test_a_version_that_its_writer_died_over_counts_for_nothing(spark, tmp_path):
    path = str(tmp_path / "news")
    added(spark, path, [(1, 0, "u", "t", "c")])
    (tmp_path / "news" / "commits" / f"{2:012d}.json").write_text('{"version": 2, "ro')
    assert urls(spark, path) == ["u"] and News.now(spark, path).manifest.version == 2
    added(spark, path, [(1, 1, "v", "s", "c")])
    assert urls(spark, path) == ["u", "v"] and News.now(spark, path).manifest.version == 3


def test_a_batch_of_a_named_stream_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "news")
    batch = ingest_items(path, lambda batch_id: NOW, "s")
    batch(items(spark, (1, 0, "u", "t", "c")), 0)
    broken = items(spark, (1, 1, "v", "s", "c")).withColumn("url", F.raise_error("looked at"))
    batch(broken, 0)
    batch(items(spark, (1, 1, "v", "s", "c")), 1)
    assert urls(spark, path) == ["u", "v"] and News.now(spark, path).manifest.batches == {"s": 1}


def test_new_items_read_no_urls_of_the_store(spark, tmp_path):
    path = str(tmp_path / "news")
    added(spark, path, [(1, n, f"u{n}", f"t{n}", "c") for n in range(50)])
    table = News.now(spark, path)
    new = spark.createDataFrame([("other", "else")], "url string, title string")
    plan = table.sharing_keys(new)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan <empty>" in plan or "PartitionFilters: [false]" in plan or "FileScan" not in plan
    known = spark.createDataFrame([("u3", "else"), ("other", "t4")], "url string, title string")
    assert {("u3", "t3"), ("u4", "t4")} <= {tuple(r) for r in table.sharing_keys(known).collect()}


def test_summaries_are_laid_over_rows_and_compacted(spark, tmp_path):
    path = str(tmp_path / "news")
    for n in range(3):
        added(spark, path, [(n, 0, f"u{n}", f"t{n}", "c")])
    files = sorted((tmp_path / "news" / "rows").rglob("*.parquet"))
    for number in range(2):
        store.update_summaries(spark, path, spark.createDataFrame([("u0", f"s{number}"), (f"u{number}", f"s{number}"), ("u9", "lost"), ("u2", None)], "url string, summary string").distinct().dropDuplicates(["url"]))
    got = {r.url: r.summary for r in store.read_news(spark, path).collect()}
    assert got == {"u0": "s1", "u1": "s1", "u2": None}
    assert sorted((tmp_path / "news" / "rows").rglob("*.parquet")) == files
    before = sorted(map(tuple, store.read_news(spark, path).collect()))
    kept = News.now(spark, path).manifest.rows[2]
    store.compact(spark, path)
    manifest = News.now(spark, path).manifest
    assert (len(manifest.rows), manifest.rows[0], manifest.summaries) == (2, kept, ())
    assert sorted(map(tuple, store.read_news(spark, path).collect())) == before
    assert {o for *_, o in added(spark, path, [(7, 0, "u0", "new", "c"), (7, 1, "new", "t1", "c")])} == {"duplicate"}
