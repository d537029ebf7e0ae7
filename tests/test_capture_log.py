import random
from datetime import datetime, timedelta, timezone

import pytest

from newsloom.operators.merge import with_body
from newsloom.schemas import CAPTURES
from newsloom.sources.capture_log import CaptureLog

START = datetime(2026, 2, 1, tzinfo=timezone.utc)


def some_captures(rng, number):
    return [
        (f"https://h{rng.randrange(40)}/", START + timedelta(hours=rng.randrange(100)), rng.random() < 0.8, rng.random() < 0.3, f"body {rng.randrange(500)}")
        for _ in range(number)
    ]


def pages(spark):
    return spark.createDataFrame([(i, f"https://h{i % 50}/", i % 3 == 0) for i in range(150)], "id int, url string, rendered boolean")


def test_a_log_gives_what_a_frame_gives(spark, tmp_path):
    rng = random.Random(2)
    batches = [some_captures(rng, 200) for _ in range(3)]
    batches += [batches[1], batches[0][:50] * 2]
    log = CaptureLog(spark, str(tmp_path / "log"), buckets=4)
    for batch in batches:
        log.append(spark.createDataFrame(batch, CAPTURES))
    frame = spark.createDataFrame([row for batch in batches for row in batch], CAPTURES)
    want = sorted((r.id, r.body) for r in with_body(pages(spark), frame).collect())
    assert len(want) > 80 and sorted((r.id, r.body) for r in with_body(pages(spark), log).collect()) == want
    again = CaptureLog(spark, str(tmp_path / "log"), buckets=9)
    assert again.buckets == 4 and sorted((r.id, r.body) for r in with_body(pages(spark), again).collect()) == want
    assert sorted((r.id, r.body) for r in with_body(pages(spark), log, ["id"], min_rows=2).collect()) == want


def test_another_catalog_finds_what_is_there(spark, tmp_path):
    log = CaptureLog(spark, str(tmp_path / "log"), buckets=2)
    log.append(spark.createDataFrame([("u", START, True, False, "x"), ("v", None, True, False, "y"), ("w", START, True, None, None)], CAPTURES))
    for table in (log._log, log._index):
        spark.sql(f"DROP TABLE {table}")
    again = CaptureLog(spark, str(tmp_path / "log"))
    wanted = spark.createDataFrame([("u", False), ("v", False), ("w", False)], "url string, rendered boolean")
    assert sorted((r.url, r.body) for r in with_body(wanted, again).collect()) == [("u", "x"), ("v", "y")]
    assert again.captures().count() == 3


def test_what_no_index_names_is_not_read(spark, tmp_path):
    """A batch that failed between its two writes leaves nothing that counts; added again, it counts once."""
    log = CaptureLog(spark, str(tmp_path / "log"), buckets=2)
    rows = spark.createDataFrame([("u", START, True, False, "x")], CAPTURES)
    index, log._index = log._index, "no_such_table"
    with pytest.raises(Exception, match="no_such_table"):
        log.append(rows)
    log._index = index
    wanted = spark.createDataFrame([("u", False)], "url string, rendered boolean")
    assert with_body(wanted, log).count() == 0
    log.append(rows)
    assert with_body(wanted, log).count() == 1


def test_an_empty_log_gives_nothing(spark, tmp_path):
    log = CaptureLog(spark, str(tmp_path / "log"), buckets=2)
    assert with_body(pages(spark), log).count() == 0
    log.append(spark.createDataFrame([], CAPTURES))
    assert with_body(pages(spark), log).count() == 0


def exchanged(plan):
    """Columns that pass an exchange, by the lines of the formatted plan."""
    lines = plan.splitlines()
    return " ".join(lines[i + 1] for i, line in enumerate(lines) if line.endswith("Exchange") and line.startswith("("))


def test_no_body_moves(spark, tmp_path):
    log = CaptureLog(spark, str(tmp_path / "log"), buckets=4)
    log.append(spark.createDataFrame(some_captures(random.Random(1), 300), CAPTURES))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = with_body(pages(spark), log)
        plan = rows._jdf.queryExecution().explainString(rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = exchanged(plan)
    assert "capture_key" in moved and "body" not in moved
    assert "Bucketed: true" in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
