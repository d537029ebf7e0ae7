import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.caps import first_per_group, sample_item
from newsloom.operators.merge import with_body
from newsloom.operators.skew import HOT_KEYS, hot_keys, rank_all, spread_join


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    left = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(80)}") for i in range(900)]
    right = [("hot", 1), *((f"k{i}", i) for i in range(0, 80, 2))]
    return spark.createDataFrame(left, "id int, k string"), spark.createDataFrame(right, "k string, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 100, 10**9])
def test_spread_join_is_a_join(sides, how, min_rows):
    left, right = sides
    got = spread_join(left, right, ["k"], how, ["id"], min_rows)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_rows_are_shared_out(sides):
    left, right = sides
    assert list(hot_keys(left, ["k"], 100).values()) == [4]
    assert list(hot_keys(left, ["k"], 10).values()).count(32) == 1
    assert len(hot_keys(left, ["id"], 1)) == 900
    assert len(hot_keys(left.sparkSession.range(2 * HOT_KEYS), ["id"], 1)) == HOT_KEYS
    joined = spread_join(left, right, ["k"], "inner", ["id"], 100).where("k = 'hot'")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_share" in plan


def test_rank_all_is_row_number(spark):
    rows = [("big" if i % 3 else f"g{i % 7}", (i * 37) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int")
    got = {(r.g, r.o): r["rank"] for r in rank_all(df, ["g"], ["o"]).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        for n, o in enumerate(sorted(o for h, o in rows if h == g), 1):
            want[g, o] = n
    assert got == want


@pytest.mark.parametrize("limit", [2, 1500])
def test_first_per_group(spark, limit):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), (6000 - F.col("id")).alias("o"))
    got = first_per_group(df, limit, ["g"], ["o"])
    assert got.columns == ["g", "o"]
    rows = sorted((r.g, r.o) for r in got.collect())
    assert rows == [(g, o) for g in (0, 1) for o in range(2 - g, 6001, 2)[:limit]]


def test_small_limits_are_applied_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"))
    assert "WindowGroupLimit" in first_per_group(df, 5, ["g"], ["o"])._jdf.queryExecution().toString()


def test_sample_item(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 0, "a"), (2, 5, "c")], "s int, pos int, v string")
    assert sorted(map(tuple, sample_item(df, ["s"]).select("s", "pos", "v").collect())) == [(1, 0, "a"), (2, 5, "c")]


@pytest.mark.parametrize("min_rows", [3, 10**6])
def test_many_rows_may_share_a_capture(spark, min_rows):
    rows = spark.createDataFrame([(n, "hot" if n % 2 else f"u{n}", False) for n in range(20)], "id int, url string, rendered boolean")
    log = [("hot", n, n != 2, False, f"b{n}") for n in range(3)] + [("u4", 0, True, False, "four"), ("u6", 0, True, True, "drawn")]
    captures = spark.createDataFrame(log, "url string, n int, ok boolean, rendered boolean, body string")
    captures = captures.withColumn("fetched_at", F.timestamp_seconds("n"))
    got = {r.id: r.body for r in with_body(rows, captures, ["id"], min_rows).collect()}
    assert got == {4: "four", **{n: "b1" for n in range(1, 20, 2)}}
