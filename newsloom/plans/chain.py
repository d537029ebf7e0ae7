"""Stages in any combination that makes sense."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans.analyze import analyze
from newsloom.plans.collect import collect_and_report
from newsloom.plans.publish import label_now, publish
from newsloom.sources.digests import DIGEST_FOLDER, choose_digest, current_digest, read_digest

STAGES = ("collector", "analyzer", "blogger")


def stages_of(run: str) -> list[str]:
    """Stage names of a run: ``pipeline`` for all, else a comma-separated list."""
    names = list(STAGES) if run == "pipeline" else [name.strip() for name in run.split(",") if name.strip()]
    check_stages(names)
    return names


def check_stages(names: Sequence[str]) -> None:
    unknown = [name for name in names if name not in STAGES]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    if "collector" in names and "blogger" in names and "analyzer" not in names:
        raise ValueError("collector and blogger cannot run together without analyzer")


def run(
    spark: SparkSession,
    stages: Sequence[str],
    now: datetime,
    news_path: str,
    inputs: Mapping[str, Any],
    digest_path: str | None = None,
    digest_setting: str | None = None,
    digest_folder: str = DIGEST_FOLDER,
) -> dict[str, DataFrame]:
    """Run stages in their order; ``inputs`` holds the arguments of each stage by its name.

    The blogger takes the digest of ``digest_path`` if that is given, else the one that the analyzer hands on, else that of the setting,
    else the file of the current week in ``digest_folder``. The collector gives its outcomes and the sources that were silent.
    """
    check_stages(stages)
    results: dict[str, DataFrame] = {}
    if "collector" in stages:
        results["outcomes"], results["silent"] = collect_and_report(spark, news_path=news_path, now=now, **inputs["collector"])
    if "analyzer" in stages:
        results["digest"] = analyze(spark, news_path, now, **inputs.get("analyzer", {}))
    if "blogger" in stages:
        if "digest" in results and not digest_path:
            parts = results["digest"]
        else:
            path = choose_digest(digest_path, digest_setting, current_digest(digest_folder, now))
            parts = label_now(read_digest(spark, path), now)
        results["posts"] = publish(spark, parts, now=now, **inputs["blogger"])
    return results
