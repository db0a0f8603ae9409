"""Failure rates by device, business area and platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson_lower
from ..functions.text import feature_area, os_label
from ..settings import SETTINGS, Settings

def _failed():
    return F.count_if(F.col("is_failure"))


def with_dimensions(sessions: DataFrame) -> DataFrame:
    """Adds feature_area and os_label."""
    return sessions.withColumns({"feature_area": feature_area(F.col("name")), "os_label": os_label(F.col("platform"), F.col("os_version"))})


CELL = ("device", "os_version", "os_label")


def device_counts(sessions: DataFrame) -> DataFrame:
    """total and failed of each device cell."""
    known = sessions.where(" and ".join(f"{k} is not null" for k in CELL))
    return known.groupBy(*CELL).agg(F.count("session_id").alias("total"), _failed().alias("failed"))


def rated_cells(counts: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Device cells (with total and failed) by the lower bound of their failure rate, riskiest first."""
    out = counts.withColumns({
        "failure_rate": F.round(F.col("failed") / F.col("total"), 3),
        "risk_score": F.round(wilson_lower(F.col("failed"), F.col("total"), settings.wilson_z), 3),
        "low_sample": F.col("total") < settings.device_min_sample,
    })
    return out.orderBy(F.desc("risk_score"), F.desc("failure_rate"), *CELL)


def device_risk(sessions: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return rated_cells(device_counts(sessions), settings)


def area_health(sessions: DataFrame) -> DataFrame:
    """Sessions, failures and tests of each business area, worst first."""
    out = sessions.where("feature_area is not null").groupBy("feature_area").agg(F.count("session_id").alias("sessions"), _failed().alias("failures"), F.countDistinct("name").alias("tests"))
    return out.withColumn("failure_rate", F.round(F.col("failures") / F.col("sessions"), 3)).orderBy(F.desc("failure_rate"), "feature_area")


def platform_breakdown(sessions: DataFrame) -> DataFrame:
    """Each platform of each project, with the builds it ran and the first day it ran; empty under two platforms."""
    known = sessions.where("platform is not null")
    by = known.groupBy("platform", "project").agg(F.count("session_id").alias("sessions"), _failed().alias("failures"), F.countDistinct("name").alias("tests"))
    versions = F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("app_version"), F.lit("")))), ", ")
    seen = known.groupBy("platform").agg(versions.alias("v"), F.left(F.min("created_at"), F.lit(10)).alias("ran_at"))
    seen = seen.withColumn("app_versions", F.when(F.col("v") == "", "unknown").otherwise(F.col("v"))).withColumn("platforms", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    out = by.join(seen, "platform").where("platforms > 1").withColumn("failure_rate", F.round(F.col("failures") / F.col("sessions"), 3))
    return out.select("platform", "project", "sessions", "failures", "tests", "failure_rate", "app_versions", "ran_at").orderBy("platform", "project")


def area_by_platform(sessions: DataFrame, platforms: list[str] | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """Rate of each area on each platform, with n__ and f__ counts; rates over few sessions are null and rows without any rate go."""
    known = sessions.where("platform is not null and feature_area is not null")
    platforms = platforms or sorted(r[0] for r in known.select("platform").distinct().collect())
    wide = known.groupBy("feature_area").pivot("platform", platforms).agg(F.count("session_id").alias("n"), _failed().alias("f"))
    cols = [F.col("feature_area")]
    for p in platforms:
        n, f = F.col(f"`{p}_n`"), F.col(f"`{p}_f`")
        cols += [F.when(n >= settings.min_group, F.round(f / n, 3)).alias(p), F.nullif(n, F.lit(0)).alias(f"n__{p}"), F.when(n > 0, f).alias(f"f__{p}")]
    out = wide.select(*cols)
    return out.where(" or ".join(f"`{p}` is not null" for p in platforms)).orderBy("feature_area") if len(platforms) > 1 else out.limit(0)


def perf_hotspots(sessions: DataFrame, top: int = 8) -> DataFrame:
    """The scenarios that use most CPU."""
    known = sessions.where("app_cpu_mean is not null")
    out = known.groupBy("name").agg(F.count("session_id").alias("sessions"), F.round(F.avg("app_cpu_mean"), 1).alias("cpu_mean"), F.round(F.max("app_cpu_max"), 1).alias("cpu_max"), F.round(F.max("app_mem_max_mb"), 1).alias("mem_max_mb"))
    return out.orderBy(F.desc("cpu_mean"), "name").limit(top)


def device_heatmap(risk: DataFrame, labels: list[str]) -> DataFrame:
    """Mean failure rate, devices by OS."""
    return risk.groupBy("device").pivot("os_label", labels).agg(F.round(F.avg("failure_rate"), 6)).orderBy("device")


def platform_comparability(sessions: DataFrame, max_gap_days: int = 1) -> DataFrame:
    """One row: comparable, reasons, stale.  Platforms compare if they ran the same builds at about the same time."""
    by = sessions.where("platform is not null").groupBy("platform").agg(
        F.array_sort(F.collect_set(F.nullif(F.col("app_version"), F.lit("")))).alias("versions"), F.max("created_at").alias("last")
    )
    by = by.withColumn("at", F.try_to_timestamp("last"))
    rows = by.agg(F.array_sort(F.collect_list(F.struct("platform", "versions", "at"))).alias("p"))  # one entry a platform
    p = F.col("p")
    seconds = lambda t: F.unix_micros(t)
    dated = F.filter(p, lambda x: x["at"].isNotNull())
    newest = F.array_max(F.transform(dated, lambda x: seconds(x["at"])))
    oldest = F.array_min(F.transform(dated, lambda x: seconds(x["at"])))
    days = lambda us: F.floor(us / 86_400_000_000)
    sets = F.array_distinct(F.filter(F.transform(p, lambda x: F.array_join(x["versions"], ", ")), lambda v: v != ""))
    shown = F.array_join(F.transform(p, lambda x: F.concat(x["platform"], F.lit(" on "), F.coalesce(F.nullif(F.array_join(x["versions"], ", "), F.lit("")), F.lit("unknown")))), "; ")
    two = F.size(p) >= 2
    r1 = F.when(two & (F.size(sets) > 1), F.concat(F.lit("different app builds ("), shown, F.lit(")")))
    gap = days(newest - oldest)
    r2 = F.when(two & (F.size(dated) > 1) & (gap > max_gap_days), F.concat(F.lit("runs "), gap.cast("string"), F.lit(" days apart")))
    reasons = F.array_compact(F.array(r1, r2))
    behind = F.filter(F.transform(dated, lambda x: F.struct(x["platform"].alias("platform"), days(newest - seconds(x["at"])).alias("d"), x["at"].alias("at"))), lambda x: x["d"] > max_gap_days)
    stale = F.transform(behind, lambda x: F.concat(x["platform"], F.lit(" is "), x["d"].cast("string"), F.lit(" days behind (last ran "), F.date_format(x["at"], "yyyy-MM-dd"), F.lit(")")))
    return rows.select((F.size(reasons) == 0).alias("comparable"), F.array_join(reasons, " | ").alias("reasons"), F.when(two & (F.size(dated) > 1), F.array_join(stale, " | ")).otherwise("").alias("stale"))
