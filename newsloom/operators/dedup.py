"""Duplicates by url or title: against the stored table, and among the items of a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.components import components
from newsloom.operators.skew import HOT_ROWS, hot_keys, hot_keys_by, spread_join
from newsloom.session import cut_lineage, cut_lineage_measured

KEYS = ("url", "title")
#: Rows of a component that one task settles at a time.
BLOCK_ROWS = 1_000_000


def stored_keys(stored: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Those key values of ``items`` that the store has.

    Asked this way round, a small batch can be broadcast (Spark decides by its size) and the store is scanned in one
    column without a shuffle.
    """
    asked = items.select(key).distinct()
    return stored.select(key).join(asked, key, "left_semi").distinct()


def drop_stored(
    items: DataFrame, stored: DataFrame, row_id: Sequence[str], keys: Sequence[str] = KEYS, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Items that share no key with the store. One anti join per key: a join on ``a OR b`` would be a nested loop."""
    hot = hot_keys_by(items, keys, min_rows)
    return reduce(
        lambda rest, key: spread_join(rest, stored_keys(stored, items, key), [key], "left_anti", row_id, hot=hot[key]),
        keys,
        items,
    )


def only_stored(
    items: DataFrame, stored: DataFrame, row_id: Sequence[str], keys: Sequence[str] = KEYS, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Items that share a key with the store."""
    marks = [f"_{key}_stored" for key in keys]
    hot = hot_keys_by(items, keys, min_rows)
    marked = items
    for key, mark in zip(keys, marks):
        known = stored_keys(stored, items, key).withColumn(mark, F.lit(True))
        marked = spread_join(marked, known, [key], "left", row_id, hot=hot[key])
    found = reduce(lambda a, b: a | b, (F.col(mark).isNotNull() for mark in marks))
    return marked.where(found).drop(*marks).select(*items.columns)


def _settle(seq: str, keys: Sequence[str]):
    """Settle components one after another, each in order; what is in use is bounded by the largest of them."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, used = None, [set() for _ in keys]
        for batch in batches:
            keep = []
            for name, *row in zip(batch["_component"].tolist(), *(batch[key].tolist() for key in keys)):
                if name != component:
                    component, used = name, [set() for _ in keys]
                free = not any(value in taken for value, taken in zip(row, used))
                if free:
                    for value, taken in zip(row, used):
                        taken.add(value)
                keep.append(free)
            yield batch.loc[keep, [seq, *keys]]

    return task


def settled(labelled: DataFrame, seq: str, keys: Sequence[str], rows: int, block_rows: int) -> DataFrame:
    """The rows that stay of components of at most ``block_rows`` rows each, many of which share a task."""
    tasks = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows // block_rows))
    dealt = labelled.repartition(tasks, "_component").sortWithinPartitions("_component", seq)
    schema = labelled.select(seq, *keys).schema
    return dealt.mapInPandas(_settle(seq, keys), schema)


def first_blocks(large: DataFrame, seq: str, largest: int, block_rows: int) -> DataFrame:
    """The rows of each component that come first, at most ``block_rows`` of them; ``largest`` is the size of the largest one."""
    # The percentile is off by at most one row in ``fineness``, which is a quarter of a block.
    fineness = max(10_000, 4 * largest // block_rows)
    cut = large.groupBy("_component").agg(F.percentile_approx(seq, block_rows / largest / 2, fineness).alias("_cut"))
    return large.join(cut, "_component").where(F.col(seq) <= F.col("_cut")).drop("_cut")


def first_kept(
    items: DataFrame, seq: str, keys: Sequence[str] = KEYS, min_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``seq`` of the items to keep: in the order of ``seq`` (unique), an item stays unless an earlier item that
    stayed has its url or its title. A dropped item stands in nobody's way.

    Keys are numbered by the first item that has them, so that all steps move three BIGINTs per item. An item that is the first for all its
    keys stays, and all items that share a key with it go. The others are split into components of the graph in which
    items that share a key are neighbours: no item matters to another component, so components are settled in parallel, one task taking many. Of a component with more than
    ``block_rows`` items, those that come first are settled; what they leave starts over, as several components often enough. This is exact for any input: no later item
    matters to an earlier one. Hot keys are never gathered: aggregates combine on the map side and the joins are spread.
    """
    ids = [f"_{key}_id" for key in keys]

    def spread(rows: DataFrame, right: DataFrame, key: str, how: str, total: int) -> DataFrame:
        # Fewer rows than a hot key has need no count.
        hot = hot_keys(rows, [key], min_rows) if total >= min_rows else {}
        return spread_join(rows, right, [key], how, [seq], hot=hot)

    def numbered(rows: DataFrame, columns: Sequence[str], total: int) -> DataFrame:
        """(seq, ids): each key as the least seq that has it."""
        for key, number in zip(columns, ids):
            rows = spread(rows, rows.groupBy(key).agg(F.min(seq).alias(f"_least{number}")), key, "inner", total)
        return rows.select(seq, *(F.col(f"_least{number}").alias(number) for number in ids))

    def without(rows: DataFrame, winners: DataFrame, total: int) -> DataFrame:
        """The rows that share no key with a winner."""
        for number in ids:
            rows = spread(rows, winners.select(number), number, "left_anti", total)
        return rows

    live, (left,) = cut_lineage_measured(items.groupBy(*keys).agg(F.min(seq).alias(seq)), F.count("*"))
    columns: Sequence[str] = keys
    kept: list[DataFrame] = []
    while left:
        live = cut_lineage(numbered(live, columns, left))
        columns = ids
        winners = live.where(reduce(lambda a, b: a & b, (F.col(number) == F.col(seq) for number in ids)))
        kept.append(winners.select(seq))
        live, (left,) = cut_lineage_measured(without(live, winners, left), F.count("*"))
        if not left:
            break
        edges = reduce(DataFrame.unionAll, (live.select(F.greatest(ids[0], n).alias("a"), F.least(ids[0], n).alias("b")) for n in ids[1:]))
        roots = components(edges.where("a <> b"), min_rows).withColumnRenamed("node", ids[0])
        labelled = spread(live, roots, ids[0], "left", left).withColumn("_component", F.coalesce("root", ids[0])).drop("root")
        if left <= block_rows:
            # No component can be larger than that.
            kept.append(settled(labelled, seq, ids, left, block_rows).select(seq))
            break
        labelled = cut_lineage(labelled)
        large = labelled.groupBy("_component").count().where(F.col("count") > block_rows)
        found = large.agg(F.count("*").alias("n"), F.max("count").alias("rows")).first()
        if not found.n:
            kept.append(settled(labelled, seq, ids, left, block_rows).select(seq))
            break
        small = labelled.join(large.select("_component"), "_component", "left_anti")
        blocks = first_blocks(labelled.join(large.select("_component"), "_component", "left_semi"), seq, found.rows, block_rows)
        chosen = cut_lineage(blocks)
        first = cut_lineage(settled(chosen, seq, ids, left, block_rows))
        kept += [settled(small, seq, ids, left, block_rows).select(seq), first.select(seq)]
        rest = labelled.join(large.select("_component"), "_component", "left_semi").join(chosen.select(seq), seq, "left_anti")
        live, (left,) = cut_lineage_measured(without(rest.select(seq, *ids), first, left), F.count("*"))
        if len(kept) >= 32:
            kept = [cut_lineage(reduce(DataFrame.unionAll, kept))]
    return reduce(DataFrame.unionAll, kept) if kept else live.select(seq)


def keep_first(items: DataFrame, seq: str, keys: Sequence[str] = KEYS, **tuning: int) -> DataFrame:
    """The items of a batch that stay, see :func:`first_kept`."""
    return items.join(first_kept(items, seq, keys, **tuning), seq, "left_semi")
