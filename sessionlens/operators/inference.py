"""Which environments go with failures, and which durations stand out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.stats import chi2_tail, fisher_exact, mann_whitney_exact, normal_two_sided, odds_ratio, odds_ratio_bound
from ..settings import SETTINGS, Settings
from .graph import kept

DIMENSIONS = ("platform", "device", "os_label", "feature_area", "app_version")
RANGES = 200
EXACT_SIDE = 8
SKETCH, BRACKET = 1_000, 0.004
METRICS = ("app_cpu_mean", "app_cpu_max", "app_mem_max_mb", "device_cpu_mean", "device_mem_used_max_mb")


def _levels(sessions: DataFrame, dimensions: list[str]) -> DataFrame:
    """n and failed of every level of every dimension in one pass, with the totals of all sessions."""
    pairs = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for i, d in enumerate(dimensions)), F.struct(F.lit(-1).alias("rank"), F.lit("").alias("dimension"), F.lit("").alias("level")))
    long = sessions.select("is_failure", F.explode(pairs).alias("x")).select("is_failure", "x.*")
    counts = long.groupBy("rank", "dimension", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_failure").alias("failed"))
    totals = counts.where("rank = -1").select(F.col("n").alias("all_n"), F.col("failed").alias("all_failed"))
    return counts.where("rank >= 0 and level is not null and level <> ''").join(F.broadcast(totals), F.lit(True))  # one row


def attribute(sessions: DataFrame, dimensions: str | list[str], settings: Settings = SETTINGS) -> DataFrame:
    """Each level against the rest: exact test, odds ratio with its interval, rates."""
    dims = [dimensions] if isinstance(dimensions, str) else list(dimensions)
    dims = [d for d in dims if d in sessions.columns]
    g = _levels(sessions, dims).where((F.col("n") >= settings.min_group) & (F.col("all_n") - F.col("n") >= settings.min_group))
    a, b = F.col("failed"), F.col("n") - F.col("failed")
    c, d = F.col("all_failed") - F.col("failed"), F.col("all_n") - F.col("n") - F.col("all_failed") + F.col("failed")
    p = fisher_exact(a, b, c, d)
    out = g.select(
        "rank", "dimension", "level", F.col("n").alias("sessions"), F.col("failed").alias("failures"),
        F.round(F.col("failed") / F.col("n"), 3).alias("failure_rate"), F.round(c / (F.col("all_n") - F.col("n")), 3).alias("baseline_rate"),
        F.round(odds_ratio(a, b, c, d), 2).alias("odds_ratio"), F.round(odds_ratio_bound(a, b, c, d, -settings.wilson_z), 2).alias("ci_low"), F.round(odds_ratio_bound(a, b, c, d, settings.wilson_z), 2).alias("ci_high"),
        p.alias("p_value"),
    )
    return out.withColumn("significant", F.col("p_value") < settings.alpha)


def same_sessions(sessions: DataFrame, dimensions: list[str]) -> DataFrame:
    """d1, l1, d2, l2: levels of different dimensions that hold just the same sessions, by counts."""
    pairs = [(x, y) for i, x in enumerate(dimensions) for y in dimensions[i + 1 :]]
    if not pairs:
        return sessions.sparkSession.createDataFrame([], "d1 string, l1 string, d2 string, l2 string")
    level = lambda c: F.col(c).cast("string")
    cells = F.array(*(F.struct(F.lit(x).alias("d1"), level(x).alias("l1"), F.lit(y).alias("d2"), level(y).alias("l2")) for x, y in pairs))
    both = sessions.select(F.explode(cells).alias("x")).select("x.*").where("l1 is not null and l2 is not null").groupBy("d1", "l1", "d2", "l2").agg(F.count(F.lit(1)).alias("n12"))
    counts = _levels(sessions, dimensions).select("dimension", "level", "n")
    one = counts.select(F.col("dimension").alias("d1"), F.col("level").alias("l1"), F.col("n").alias("n1"))
    two = counts.select(F.col("dimension").alias("d2"), F.col("level").alias("l2"), F.col("n").alias("n2"))
    half = both.join(one, ["d1", "l1"]).join(two, ["d2", "l2"]).where("n12 = n1 and n12 = n2").select("d1", "l1", "d2", "l2")
    return half.unionByName(half.select(F.col("d2").alias("d1"), F.col("l2").alias("l1"), F.col("d1").alias("d2"), F.col("l1").alias("l2")))


def significant_findings(sessions: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, settings: Settings = SETTINGS) -> DataFrame:
    """Levels that fail significantly more than the rest, strongest first; of levels with the same sessions the first counts."""
    dims = [d for d in dimensions if d in sessions.columns]
    hits = attribute(sessions, dims, settings).where("significant and failure_rate > baseline_rate")
    twins = same_sessions(sessions, dims)
    rank = F.array_position(F.array(*map(F.lit, dims)), F.col("d2"))
    names = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "d2", "l2"))), lambda x: F.concat(x["d2"], F.lit("="), x["l2"]))
    with_twins = hits.join(twins.select(F.col("d1").alias("dimension"), F.col("l1").alias("level"), "d2", "l2"), ["dimension", "level"], "left")
    # the first of a set of twins that are findings themselves: the least rank
    found = hits.select(F.col("dimension").alias("d2"), F.col("level").alias("l2"), F.col("rank").alias("rank2"))
    with_twins = with_twins.join(found, ["d2", "l2"], "left")
    keys = [c for c in hits.columns]
    out = with_twins.groupBy(*keys).agg(F.coalesce(F.array_join(F.when(F.count("d2") > 0, names), ", "), F.lit("")).alias("confounded_with"), F.min("rank2").alias("other"))
    return out.where("other is null or other > rank").drop("rank", "other").orderBy(F.desc("odds_ratio"), "dimension", "level")


def category_by_dimension(failures: DataFrame, dimension: str = "os_label") -> DataFrame:
    """category, level, observed, expected, residual of the whole table, and its chi-square p (corrected for 2 x 2); null p under 2 x 2."""
    cells = failures.where(f"category is not null and {dimension} is not null").groupBy("category", F.col(dimension).alias("level")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("category").agg(F.sum("o").alias("row_n"))
    cols = cells.groupBy("level").agg(F.sum("o").alias("col_n"))
    size = rows.agg(F.count(F.lit(1)).alias("r"), F.sum("row_n").alias("n")).join(cols.agg(F.count(F.lit(1)).alias("c")), F.lit(True))
    # categories and levels are few: the grid is their product, not that of rows
    grid = rows.join(F.broadcast(cols), F.lit(True)).join(cells, ["category", "level"], "left").join(F.broadcast(size), F.lit(True))
    grid = grid.withColumns({"observed": F.coalesce("o", F.lit(0)), "expected": F.col("row_n") * F.col("col_n") / F.col("n")})
    df = (F.col("r") - 1) * (F.col("c") - 1)
    gap = F.abs(F.col("observed") - F.col("expected"))
    gap = F.when(df == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    whole = Window.partitionBy(F.lit(0))
    chi2 = F.sum(gap * gap / F.col("expected")).over(whole)
    some = (F.col("r") >= 2) & (F.col("c") >= 2)
    out = grid.select("category", "level", "observed", "expected", F.when(some, F.round((F.col("observed") - F.col("expected")) / F.sqrt("expected"), 2)).alias("residual"), chi2.alias("x"), df.alias("df"), some.alias("some"))
    return out.select("category", "level", "observed", "expected", "residual", F.when(F.col("some"), F.col("x")).alias("chi2"), F.when(F.col("some"), chi2_tail(F.col("x"), F.greatest(F.col("df"), F.lit(1)))).alias("p_value")).orderBy("category", "level")


def group_medians(values: DataFrame, key: str, v: str, least: int = 1) -> DataFrame:
    """key, n, med, top (largest), avg of v in every group of `least` rows or more; rows without key or value don't count.

    A sketch brackets the middle of each group closely; the values below the bracket
    are only counted and those in it are put in order, equal ones as one row, so a task
    never holds a group.  Where the sketch has missed the middle, the side that
    has it is put in order instead: the result is exact anyway.  The bracket is
    computed once: a sketch differs from run to run with the order in which its parts come.
    """
    rows = values.where(F.col(key).isNotNull() & F.col(v).isNotNull()).select(F.col(key).alias("key"), F.col(v).cast("double").alias("v"))
    near = F.percentile_approx("v", [0.5 - BRACKET, 0.5 + BRACKET], SKETCH)
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), near.alias("near"), F.max("v").alias("top"), F.avg("v").alias("avg")).where(F.col("n") >= least)
    stats = kept(stats.withColumns({"lo": F.get("near", F.lit(0)), "hi": F.get("near", F.lit(1))}).drop("near"))
    placed = rows.join(stats.select("key", "n", "lo", "hi"), "key").withColumn("side", F.when(F.col("v") < F.col("lo"), 0).when(F.col("v") <= F.col("hi"), 1).otherwise(2))
    sides = placed.groupBy("key", "side").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("key").orderBy("side").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # three rows a group
    sides = sides.withColumn("before", before)
    middles = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)))
    wanted = stats.select("key", F.explode(middles).alias("at")).join(sides, "key").where("before < at and at <= before + k").select("key", "side", "at", "before")
    held = placed.join(wanted.select("key", "side").distinct(), ["key", "side"], "left_semi").groupBy("key", "side", "v").agg(F.count(F.lit(1)).alias("t"))
    upto = F.sum("t").over(Window.partitionBy("key", "side").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("upto", upto)
    hits = held.join(wanted, ["key", "side"]).where((F.col("before") + F.col("upto") >= F.col("at")) & (F.col("before") + F.col("upto") - F.col("t") < F.col("at")))
    # one value or two; equal values at both places are two rows
    return stats.drop("lo", "hi").join(hits.groupBy("key").agg(F.avg("v").alias("med")), "key").withColumnRenamed("key", key)


def duration_outliers(sessions: DataFrame, z: float = 3.5, settings: Settings = SETTINGS) -> DataFrame:
    """Scenarios with a session far slower than their median, by robust scores."""
    known = sessions.where("name is not null and duration is not null").select("name", "duration")
    med = kept(group_medians(known, "name", "duration", settings.min_group).select("name", F.col("n").alias("sessions"), "med", F.col("top").alias("slowest")))
    gaps = known.join(med.select("name", "med"), "name").select("name", F.abs(F.col("duration") - F.col("med")).alias("gap"))
    spread = med.join(group_medians(gaps, "name", "gap").select("name", F.col("med").alias("mad"), F.col("avg").alias("ad")), "name")
    over = F.col("slowest") - F.col("med")
    score = F.when(F.col("mad") > 0, 0.6745 * over / F.col("mad")).when(F.col("ad") > 0, over / (1.253314 * F.col("ad")))
    out = spread.withColumn("score", score).where(F.col("score") >= z)
    ratio = F.when(F.col("med") != 0, F.round(F.col("slowest") / F.col("med"), 1)).otherwise(0.0)
    return out.select("name", "sessions", F.round("med", 1).alias("median_seconds"), F.round("slowest", 1).alias("slowest_seconds"), ratio.alias("ratio"), F.round("score", 1).alias("modified_z")).orderBy(F.desc("modified_z"), "name")


@pandas_udf(T.DoubleType())
def _exact_p(u: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_exact(float(a), int(b), int(c)) for a, b, c in zip(u, n, m, strict=True)])


def rank_sums(sessions: DataFrame, metrics: list[str]) -> DataFrame:
    """For each metric: sizes, medians, U of the failed and the tie term.

    Values are counted first.  They are dealt to ranges of about equal counts; running
    sums within a range and over the sums of the ranges before give ranks, and the
    middle values from the same counts.
    """
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))
    long = sessions.select("is_failure", F.explode(values).alias("x")).select("is_failure", "x.*").where("v is not null and not isnan(v)")
    ties = kept(long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("t"), F.count_if("is_failure").alias("tf")))
    cuts = ties.groupBy("metric").agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    placed = ties.join(F.broadcast(cuts), "metric")  # a row a metric
    placed = placed.select("metric", "v", "t", "tf", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("range"))
    sums = placed.groupBy("metric", "range").agg(F.sum("t").alias("t"), F.sum("tf").alias("tf"))
    over = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a metric
    whole = Window.partitionBy("metric")
    starts = sums.select("metric", "range", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}0") for c in ("t", "tf")), F.sum("tf").over(whole).alias("n1"), F.sum(F.col("t") - F.col("tf")).over(whole).alias("n2"))
    within = Window.partitionBy("metric", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumns({f"{c}1": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in ("t", "tf")}).join(F.broadcast(starts), ["metric", "range"])
    below, failed_below = F.col("t0") + F.col("t1"), F.col("tf0") + F.col("tf1")

    def median(before: Column, size: Column, n: Column) -> Column:
        low, high = F.floor((n + 1) / 2), F.ceil((n + 1) / 2)
        at = lambda place: F.max(F.when((before < place) & (before + size >= place), F.col("v")))
        return (at(low) + at(high)) / 2

    out = ranked.groupBy("metric").agg(
        F.sum((below + (F.col("t") + 1) / 2) * F.col("tf")).alias("rs"), F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"),
        median(failed_below, F.col("tf"), F.col("n1")).alias("m1"), median(below - failed_below, F.col("t") - F.col("tf"), F.col("n2")).alias("m2"),
    )
    return out.withColumn("u", F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2)


def performance_vs_failure(sessions: DataFrame, metrics: tuple[str, ...] = METRICS, settings: Settings = SETTINGS) -> DataFrame:
    """Rank test of each metric, failed against passed."""
    have = [m for m in metrics if m in sessions.columns]
    g = rank_sums(sessions, have).where((F.col("n1") >= settings.min_group) & (F.col("n2") >= settings.min_group))
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    top = F.greatest(F.col("u"), F.col("n1") * F.col("n2") - F.col("u"))
    z = (top - F.col("n1") * F.col("n2") / 2.0 - 0.5) / sd
    # the exact distribution where a side is small and nothing is tied, as the normal limit is rough there
    exact = (F.least("n1", "n2") <= EXACT_SIDE) & (F.col("ties") == 0)
    g = kept(g.withColumns({"z": z, "exact": exact}))  # a row a metric
    limit = F.when(F.col("z") <= 0, F.lit(1.0)).otherwise(normal_two_sided(F.col("z")))
    small, large = g.where("exact"), g.where("not exact").withColumn("p", limit)
    g = small.withColumn("p", _exact_p("u", "n1", "n2")).unionByName(large)
    out = g.select(
        "metric", F.round("m1", 1).alias("failed_median"), F.round("m2", 1).alias("passed_median"), F.col("n1").alias("failed_n"), F.col("n2").alias("passed_n"),
        F.round(2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1, 2).alias("effect"), "u", "z", F.col("p").alias("p_value"),
    )
    return out.withColumn("significant", F.col("p_value") < settings.alpha).orderBy("p_value", "metric")


def time_split(sessions: DataFrame) -> DataFrame:
    """Time of the platform and of the tests, and their shares; no row without any time."""
    t = sessions.agg(F.sum(F.coalesce("browserstack_seconds", F.lit(0.0))).alias("b"), F.sum(F.coalesce("user_seconds", F.lit(0.0))).alias("u")).where("b + u > 0")
    return t.select(
        F.round("b", 1).alias("browserstack_seconds"), F.round("u", 1).alias("user_seconds"),
        F.round(F.col("b") / (F.col("b") + F.col("u")) * 100, 1).alias("browserstack_pct"), F.round(F.col("u") / (F.col("b") + F.col("u")) * 100, 1).alias("user_pct"),
    )


