"""The first rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.skew import rank_all


def first_per_group(rows: DataFrame, limit: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``limit`` rows of each group. Rejects have to be filtered out before, so that later rows move up.

    Up to Spark's group limit threshold every map task keeps ``limit`` rows per group before the shuffle, so a hot
    group sends little. Larger limits are ranked without bringing a group to one task.
    """
    threshold = int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if limit <= threshold:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    return rank_all(rows, by, order, "_rank").where(F.col("_rank") <= limit).drop("_rank")


def sample_item(rows: DataFrame, by: Sequence[str], position: str = "pos") -> DataFrame:
    """The first item of each group, found by a combining aggregate instead of a sort."""
    others = [c for c in rows.columns if c not in by]
    first = F.min_by(F.struct(*others), F.col(position)).alias("_first")
    return rows.groupBy(*by).agg(first).select(*by, "_first.*")
