"""Headline figures of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import SETTINGS, Settings


def exec_metrics(sessions: DataFrame, clusters: DataFrame, risk: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row: totals, health, time saved and the riskiest device cell.  `clusters` are rows a cluster, or their count as one row num_root_causes.

    Time saved counts every failure against the clusters, those without a reason too.
    """
    total = sessions.agg(F.count(F.lit(1)).alias("total_tests"), F.count_if("is_failure").alias("failed"))
    groups = clusters if clusters.columns == ["num_root_causes"] else clusters.agg(F.count(F.lit(1)).alias("num_root_causes"))
    # the first row of the risk table, as it is ordered
    first = F.min_by(F.struct("device", "os_version", "os_label", "failure_rate", "risk_score", F.col("failed").alias("cell_failed"), "total", "low_sample"), F.struct(-F.col("risk_score"), -F.col("failure_rate"), "device", "os_version", "os_label"))
    worst = risk.agg(F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("worst"), first.alias("top_risk_cell"))
    one = total.join(F.broadcast(groups), F.lit(True)).join(F.broadcast(worst), F.lit(True))  # one row each
    rate = F.when(F.col("total_tests") > 0, F.col("failed") / F.col("total_tests")).otherwise(0.0)
    health = F.least(F.greatest(100 * F.when(F.col("total_tests") > 0, 1 - rate).otherwise(0.0) - 15 * F.col("worst"), F.lit(0.0)), F.lit(100.0))
    minutes = F.greatest(F.col("failed") - F.col("num_root_causes"), F.lit(0)) * settings.triage_minutes
    return one.select(
        "total_tests", (F.col("total_tests") - F.col("failed")).alias("passed"), "failed", F.when(F.col("total_tests") > 0, 1 - rate).otherwise(0.0).alias("pass_rate"),
        health.alias("suite_health_index"), "num_root_causes", minutes.alias("mttr_minutes_saved"), (minutes / 60).alias("mttr_hours_saved"), "top_risk_cell",
    )


def summary_cards(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "total_tests", "passed", "failed", F.round(F.col("pass_rate") * 100, 1).alias("pass_rate_pct"), F.round("suite_health_index", 1).alias("suite_health_index"), "num_root_causes", F.round("mttr_hours_saved", 1).alias("mttr_hours_saved")
    )
