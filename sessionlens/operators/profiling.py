"""Profiling series reduced to figures a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed

MIN_SLOPE_SAMPLES = 8
BLOCK = 1000  # samples of a partial sum


def app_prefix(series: Column) -> Column:
    """The name before _cpu, _mem, _netr or _nets of the first key of an app, rows and keys in order."""
    device = F.array(*map(F.lit, fixed.DEVICE_KEYS))
    rows = F.from_json(series, "array<string>")
    keys = F.flatten(F.transform(rows, lambda r: F.coalesce(F.json_object_keys(r), F.array().cast("array<string>"))))
    found = F.filter(keys, lambda k: ~F.array_contains(device, k) & k.rlike(r"(?i)^[a-z0-9]+_(cpu|mem|netr|nets)$"))
    return F.coalesce(F.regexp_extract(F.try_element_at(found, F.lit(1)), r"(?i)^([a-z0-9]+)_", 1), F.lit(""))


def _total(v: Column) -> Column:
    """Sum of doubles in their order, by blocks whose sums are added up then; one long sum would drift."""
    block = lambda at: F.aggregate(F.slice(v, at, BLOCK), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK)), F.lit(0.0), lambda a, at: a + block(at))


def _mean(v: Column, exact: bool) -> Column:
    """Mean of an array without nulls to one place; exact if added up as decimals, as a sum of doubles errs either way where the mean ends in a half."""
    n, total = F.size(v), "decimal(37,12)"
    plain = F.round(_total(v) / n, 1)
    if not exact:
        return plain
    decimals = F.aggregate(F.transform(v, lambda x: x.try_cast("decimal(30,12)")), F.lit(0).cast(total), lambda a, x: (a + x).try_cast(total))
    return F.coalesce(F.round(decimals / n, 1).cast("double"), plain)  # decimals end at 1e18, and none is infinite


def _stats(v: Column, exact: bool = True) -> tuple[Column, Column, Column]:
    """Mean, 95th percentile (interpolated) and maximum of an array without nulls; null if it is empty."""
    n = F.size(v)
    mean = F.when(n > 0, _mean(v, exact))
    s = F.array_sort(v)
    at = 0.95 * (n - 1)
    lo = F.try_element_at(s, F.floor(at).cast("int") + 1)
    hi = F.try_element_at(s, F.least(F.ceil(at).cast("int") + 1, F.greatest(n, F.lit(1))))
    p95 = F.when(n > 0, F.round(lo + (hi - lo) * (at - F.floor(at)), 1))
    return mean, p95, F.when(n > 0, F.round(F.array_max(v), 1))


def _slope_per_minute(ts: Column, v: Column) -> Column:
    """Least-squares slope of paired arrays, null under 8 pairs or without a span."""
    pairs = F.filter(F.zip_with(ts, v, lambda t, x: F.struct(t.alias("t"), x.alias("x"))), lambda p: p["t"].isNotNull() & p["x"].isNotNull())
    n = F.size(pairs)
    t0 = F.array_min(F.transform(pairs, lambda p: p["t"]))
    span = F.array_max(F.transform(pairs, lambda p: p["t"])) - t0
    zero = F.lit(0.0)
    st = F.aggregate(pairs, zero, lambda a, p: a + (p["t"] - t0) / 60)
    sx = F.aggregate(pairs, zero, lambda a, p: a + p["x"])
    stt = F.aggregate(pairs, zero, lambda a, p: a + ((p["t"] - t0) / 60) * ((p["t"] - t0) / 60))
    stx = F.aggregate(pairs, zero, lambda a, p: a + ((p["t"] - t0) / 60) * p["x"])
    return F.when((n >= MIN_SLOPE_SAMPLES) & (span > 0), F.round((n * stx - st * sx) / (n * stt - st * st), 2))


def parse_profiles(profiles: DataFrame, series: str = "series", exact: bool = True) -> DataFrame:
    """profiles plus the figures of its JSON series; all null where there is no sample. Means come from decimals if exact, else from doubles like SQL's avg."""
    rows = F.from_json(F.col(series), "array<map<string,double>>")
    df = profiles.withColumns({"_rows": F.filter(rows, lambda r: r.isNotNull()), "_prefix": app_prefix(F.col(series))})
    whole = lambda k: F.transform(F.col("_rows"), lambda r: F.try_element_at(r, k))
    names = {k: F.lit(k) for k in fixed.DEVICE_KEYS} | {"app_cpu": F.concat("_prefix", F.lit("_cpu")), "app_mem": F.concat("_prefix", F.lit("_mem"))}
    df = df.withColumns({f"_all_{k}": whole(name) for k, name in names.items()})
    df = df.withColumns({f"_{k}": F.filter(F.col(f"_all_{k}"), lambda x: x.isNotNull()) for k in names})
    c = {k: F.col(f"_{k}") for k in names}
    # totals and free memory are paired by place after nulls are dropped from each
    df = df.withColumn("_used", F.filter(F.zip_with(c["mem"], c["mema"], lambda a, b: a - b), lambda x: x.isNotNull()))
    dev_mean, _, dev_max = _stats(c["cpu"], exact)
    cpu_mean, cpu_p95, cpu_max = _stats(c["app_cpu"], exact)
    mem_max, used_max, temp_max = _stats(c["app_mem"])[2], _stats(F.col("_used"))[2], _stats(c["temp"])[2]
    ts, batt, temp = c["ts"], c["batt"], c["temp"]
    out = {
        "profile_samples": F.size("_rows").cast("long"),
        "profile_seconds": F.when(F.size(ts) > 1, F.round(F.array_max(ts) - F.array_min(ts), 1)).otherwise(0.0),
        "device_cpu_mean": dev_mean, "device_cpu_max": dev_max, "app_cpu_mean": cpu_mean, "app_cpu_p95": cpu_p95, "app_cpu_max": cpu_max,
        "app_cpu_samples": F.size(c["app_cpu"]).cast("long"), "app_mem_max_mb": mem_max, "app_mem_samples": F.size(c["app_mem"]).cast("long"),
        "app_mem_growth_mb_per_min": _slope_per_minute(F.col("_all_ts"), F.col("_all_app_mem")), "device_mem_used_max_mb": used_max,
        "battery_delta_pct": F.when(F.size(batt) > 1, F.round(F.try_element_at(batt, F.lit(1)) - F.try_element_at(batt, F.lit(-1)), 1)),
        "temp_max_c": temp_max, "temp_delta_c": F.when(F.size(temp) > 0, F.round(F.array_max(temp) - F.array_min(temp), 1)),
    }
    some = F.size("_rows") > 0
    df = df.withColumns({k: F.when(some, v) for k, v in out.items()})
    return df.drop(*(x for x in df.columns if x.startswith("_")))


def with_profiles(sessions: DataFrame, profiles: DataFrame, exact: bool = True) -> DataFrame:
    """sessions plus the figures of profiles (session_id, series) by session."""
    figures = parse_profiles(profiles, exact=exact).select("session_id", *fixed.PROFILE_COLUMNS)
    return sessions.drop(*fixed.PROFILE_COLUMNS).join(figures, "session_id", "left")
