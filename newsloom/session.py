"""Where intermediate results live, and how lineage is cut so that lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A single-machine session without that setting gets a temporary folder; a cluster without it is an error,
    because a folder on one machine is of no use to the others.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="newsloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: later steps neither recompute nor re-plan it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_measured(df: DataFrame, *measures: Column) -> tuple[DataFrame, tuple]:
    """The same, with aggregates of its rows that are taken while they are written, without another job."""
    measured = Observation()
    named = [measure.alias(f"m{i}") for i, measure in enumerate(measures)]
    cut = cut_lineage(df.observe(measured, *named))
    return cut, tuple(measured.get[f"m{i}"] for i in range(len(named)))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a staged table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as a table and read from there: lineage ends, and readers take the columns they need."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
