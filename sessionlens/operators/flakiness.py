"""How unsteady each scenario is, within one build and across builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, duration_cov, shrink, status_variance
from ..settings import SETTINGS, Settings

def _rate():
    return F.avg(F.col("is_failure").cast("double"))


def in_build(sessions: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """A proxy for one build: mixed outcomes and uneven durations."""
    g = sessions.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("runs"), _rate().alias("r"), F.stddev_pop("duration").alias("sd"), F.avg("duration").alias("mean"))
    cov = duration_cov(F.col("sd"), F.col("mean"))
    raw = clip(0.65 * status_variance(F.col("r")) + 0.35 * cov)
    out = g.select(
        "name", "runs", F.round("r", 3).alias("failure_rate"), F.round(cov, 3).alias("duration_cov"), F.lit(0.0).alias("flip_rate"),
        F.round(raw, 3).alias("raw_flakiness"), F.round(shrink(raw, F.col("runs"), settings.flaky_smoothing), 3).alias("flakiness_index"),
        (F.col("runs") < settings.flaky_min_runs).alias("low_sample"),
    )
    return out.orderBy("low_sample", F.desc("flakiness_index"), "name")


def build_outcomes(history: DataFrame) -> DataFrame:
    """One row a scenario and build, with whether its outcome flipped against the build before."""
    per = history.where("name is not null and build_id is not null").groupBy("name", "build_id").agg(
        F.max(F.col("is_failure").cast("int")).alias("any_fail"), F.min(F.col("is_failure").cast("int")).alias("all_fail"), F.min("created_at").alias("first_seen"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_failure").cast("long")).alias("failed"), F.sum("duration").alias("d"), F.sum(F.col("duration") * F.col("duration")).alias("dd"),
    )
    order = Window.partitionBy("name").orderBy("first_seen", "build_id")
    return per.withColumn("flip", F.abs(F.col("any_fail") - F.lag("any_fail").over(order)))


def across_builds(history: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Pass and fail alternating from build to build, disagreement within builds, mixed outcomes, uneven durations."""
    per = build_outcomes(history).groupBy("name").agg(
        F.count(F.lit(1)).alias("builds"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"), F.avg((F.col("any_fail") > F.col("all_fail")).cast("double")).alias("mixed")
    )
    runs = history.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("runs"), _rate().alias("r"), F.stddev_pop("duration").alias("sd"), F.avg("duration").alias("mean"))
    g = per.join(runs, "name")
    flip = F.when(F.col("builds") > 1, F.col("flips") / (F.col("builds") - 1)).otherwise(0.0)
    cov = duration_cov(F.col("sd"), F.col("mean"))
    raw = clip(0.45 * flip + 0.25 * F.col("mixed") + 0.20 * status_variance(F.col("r")) + 0.10 * cov)
    out = g.select(
        "name", "runs", "builds", F.round("r", 3).alias("failure_rate"), F.round(cov, 3).alias("duration_cov"), F.round(flip, 3).alias("flip_rate"), F.round("mixed", 3).alias("mixed_rate"),
        F.round(raw, 3).alias("raw_flakiness"), F.round(shrink(raw, F.col("builds"), settings.flaky_build_smoothing), 3).alias("flakiness_index"),
        ((F.col("builds") < settings.flaky_min_builds)).alias("low_sample"),
    )
    return out.orderBy("low_sample", F.desc("flakiness_index"), "name")


def flakiness_index(sessions: DataFrame, history: DataFrame | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """The model across builds where there is a history, else the proxy."""
    if history is not None and "build_id" in history.columns and history.head(1):
        return across_builds(history, settings)
    return in_build(sessions, settings)
