"""Joins and rankings that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import cut_lineage

#: A key with fewer rows than this is left to one task.
HOT_ROWS = 500_000
#: Keys that are split at most. Those beyond hold at most 1/4096 of all rows each, since each split one holds as many:
#: no more than an even share in a stage of that many tasks.
HOT_KEYS = 4_096


def hot_keys(rows: DataFrame, on: Sequence[str], min_rows: int = HOT_ROWS) -> dict[int, int]:
    """Hashes of the most frequent keys with the shares that their rows are split into, counted with map-side combining."""
    keyed = rows.select(F.xxhash64(*on).alias("hash"), F.lit("").alias("key"))
    return _most_frequent(keyed, min_rows).get("", {})


def hot_keys_by(rows: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> dict[str, dict[int, int]]:
    """The hot keys of several columns, each a key of its own, counted in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(key).alias("key"), F.xxhash64(key).alias("hash")) for key in keys)))
    found = _most_frequent(rows.select(pairs.alias("p")).select("p.*"), min_rows)
    return {key: found.get(key, {}) for key in keys}


def _most_frequent(keyed: DataFrame, min_rows: int) -> dict[str, dict[int, int]]:
    """By key, hash and shares. A share holds ``min_rows`` rows, or as many as the last key that is split where there are more keys."""
    counts = keyed.groupBy("key", "hash").count().where(F.col("count") >= min_rows)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("count"), "hash"))
    top: dict[str, dict[int, int]] = {}
    for row in counts.withColumn("_place", place).where(F.col("_place") <= HOT_KEYS).collect():
        top.setdefault(row["key"], {})[row["hash"]] = row["count"]
    for found in top.values():
        size = max(min_rows, min(found.values()) if len(found) == HOT_KEYS else 1)
        # Powers of two, so that there are few different numbers of shares.
        found.update({hash_: 1 << (-(-count // size) - 1).bit_length() for hash_, count in found.items()})
    return top


def _shares(on: Sequence[str], hot: dict[int, int]) -> Column:
    """Into how many shares the rows of a key are split."""
    classes: dict[int, list[int]] = {}
    for hash_, number in hot.items():
        classes.setdefault(number, []).append(hash_)
    key, shares = F.xxhash64(*on), F.lit(None).cast("int")
    for number, hashes in classes.items():
        shares = F.when(key.isin(*hashes), F.lit(number)).otherwise(shares)
    return F.coalesce(shares, F.lit(1))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    row_id: Sequence[str],
    min_rows: int = HOT_ROWS,
    hot: dict[int, int] | None = None,
) -> DataFrame:
    """Equi join (inner, left, left_semi, left_anti) that shares out the rows of hot left keys over many tasks.

    ``right`` has one row per key. Rows of a hot key are spread by a hash of their ``row_id``, so a re-run task
    sends each row where it went before, and the matching right rows, at most ``HOT_KEYS``, are copied to every
    share; there are as many shares as the key's rows need. Without hot keys this is a plain join. Neither side is hinted; Spark broadcasts the right side
    by itself when its measured size allows.

    Hot keys are counted now, in one narrow aggregate over ``left``; so give a frame that is cheap to read twice, or
    the keys as ``hot`` where they are known.
    """
    hot = hot_keys(left, on, min_rows) if hot is None else hot
    if not hot:
        return left.join(right, list(on), how)
    shares = _shares(on, hot)
    spread = left.withColumn("_share", F.pmod(F.xxhash64(*row_id), shares).cast("int"))
    copied = right.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return spread.join(copied, [*on, "_share"], how).drop("_share")


def rank_all(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Exact row numbers (from 1) within groups of any size, ``order`` being unique within a group.

    ``row_number()`` sorts each group in one task. Here the rows are range partitioned and sorted once, frozen in the
    shared folder, and numbered from their position plus the number of rows of the group in earlier partitions. That
    table of spans has one row per group and partition.
    """
    spot, part = F.col("_spot"), F.shiftright("_spot", 33)
    frozen = cut_lineage(rows.orderBy(*by, *order).withColumn("_spot", F.monotonically_increasing_id()))
    frozen = frozen.withColumn("_part", part)
    spans = frozen.groupBy(*by, "_part").agg(F.min("_spot").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    keys = [*by, "_part"]
    return (
        frozen.join(spans, keys)
        .withColumn(name, spot - F.col("_first") + F.col("_before") + 1)
        .drop("_spot", "_part", "_first", "_before")
    )
