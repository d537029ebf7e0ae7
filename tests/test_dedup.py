import random

import pytest

from newsloom.operators.components import components
from newsloom.operators.dedup import drop_stored, first_blocks, first_kept, keep_first, only_stored, settled

SCHEMA = "seq bigint, url string, title string"


def one_by_one(rows, urls=(), titles=()):
    """What a loop over the rows in order would insert."""
    urls, titles, kept = set(urls), set(titles), []
    for seq, url, title in sorted(rows):
        if url not in urls and title not in titles:
            urls.add(url)
            titles.add(title)
            kept.append(seq)
    return kept


def kept_by_spark(spark, rows, **tuning):
    return sorted(r.seq for r in first_kept(spark.createDataFrame(rows, SCHEMA), "seq", **tuning).collect())


def test_a_dropped_item_blocks_nobody(spark):
    rows = [(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t3"), (4, "u1", "t4"), (5, "u5", "t4")]
    assert kept_by_spark(spark, rows) == [1, 3, 5]


@pytest.mark.parametrize("urls,titles", [(300, 300), (20, 500), (1000, 12)])
def test_rounds_agree_with_a_loop(spark, urls, titles):
    rng = random.Random(urls)
    rows = [(i * 7, f"u{rng.randrange(urls)}", f"t{rng.randrange(titles)}") for i in range(1000)]
    assert kept_by_spark(spark, rows) == one_by_one(rows)


def test_hot_keys_agree_with_a_loop(spark):
    rng = random.Random(5)
    rows = [
        (i, "hot" if rng.random() < 0.4 else f"u{rng.randrange(300)}", "hot" if rng.random() < 0.3 else f"t{rng.randrange(300)}")
        for i in range(1500)
    ]
    assert kept_by_spark(spark, rows, min_rows=50) == one_by_one(rows)


def chain(length, start=0):
    """Items each of which shares its url with the one before it and its title with the one after it, or the other way round."""
    return [(start + i, f"u{start}-{i // 2}", f"t{start}-{(i + 1) // 2}") for i in range(length)]


def test_a_long_chain_is_settled_in_blocks(spark):
    rows = chain(300)
    rng = random.Random(1)
    order = rng.sample(range(300), 300)
    rows = [(seq, url, title) for seq, (_, url, title) in zip(order, rows)]
    assert kept_by_spark(spark, rows, block_rows=60) == one_by_one(rows)


def test_many_chains_are_settled_side_by_side(spark):
    rng = random.Random(9)
    rows = [row for start in range(0, 3000, 20) for row in chain(15, start)]
    order = rng.sample(range(len(rows)), len(rows))
    rows = [(seq, url, title) for seq, (_, url, title) in zip(order, rows)]
    assert kept_by_spark(spark, rows) == one_by_one(rows)


def test_components_share_tasks_and_no_task_has_all(spark):
    """Settling 150 components of 10 rows takes as many tasks as a shuffle has, each with some of them."""
    rows = [(c * 100 + i, i // 2, (i + 1) // 2, c) for c in range(150) for i in range(10)]
    labelled = spark.createDataFrame(rows, "seq bigint, u bigint, t bigint, _component bigint")
    frame = settled(labelled, "seq", ["u", "t"], len(rows), 1_000_000)
    assert frame.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_part = frame.rdd.glom().map(len).collect()
    assert sum(by_part) == 150 * 5 and max(by_part) < 150 * 5 / 3


def test_first_blocks_are_bounded_and_hold_the_first_rows(spark):
    large = spark.range(10_000).selectExpr("id AS seq", "id % 2 AS _component")
    for component in (0, 1):
        block = sorted(r.seq for r in first_blocks(large, "seq", 5_000, 700).collect() if r._component == component)
        assert 0 < len(block) <= 700
        assert block == list(range(component, 2 * len(block), 2))


@pytest.mark.parametrize("min_rows", [500_000, 20])
def test_components_agree_with_union_find(spark, min_rows):
    rng = random.Random(3)
    edges = [(i + 1, i) for i in range(60)] + [(i, 100) for i in range(101, 300)] + [(5, 2)] * 3
    edges += [tuple(sorted(rng.sample(range(400, 700), 2), reverse=True)) for _ in range(200)]
    parent = {node: node for edge in edges for node in edge}

    def root(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), min_rows).collect()}
    assert got == {node: root(node) for node in parent if root(node) != node}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_empty_batch(spark):
    assert first_kept(spark.createDataFrame([], SCHEMA), "seq").count() == 0


def test_store_is_asked_first(spark):
    store = spark.createDataFrame([("u9", "t1")], "url string, title string")
    items = spark.createDataFrame([(1, "u1", "t1"), (2, "u1", "t2"), (3, "u9", "t3")], SCHEMA)
    new = drop_stored(items, store, ["seq"])
    assert [r.seq for r in keep_first(new, "seq").collect()] == [2]
    assert sorted(r.seq for r in only_stored(items, store, ["seq"]).collect()) == [1, 3]


def test_store_and_batch_agree_with_a_loop(spark):
    rng = random.Random(11)
    rows = [(i, f"u{rng.randrange(150)}", f"t{rng.randrange(150)}") for i in range(500)]
    stored = [(f"u{rng.randrange(150)}", f"t{rng.randrange(150)}") for _ in range(40)]
    new = drop_stored(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(stored, "url string, title string"), ["seq"], min_rows=5
    )
    got = sorted(r.seq for r in first_kept(new, "seq").collect())
    assert got == one_by_one(rows, *map(set, zip(*stored)))


def test_plans_have_no_nested_loops(spark):
    store = spark.createDataFrame([("u9", "t1")], "url string, title string")
    items = spark.createDataFrame([(1, "u1", "t1")], SCHEMA)
    plan = drop_stored(items, store, ["seq"])._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
