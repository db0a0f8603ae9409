"""Sessions, builds and profiles made from the events table, in DataFrame and in SQL form.

The events carry no test results, so fields are dealt out from ids by fixed
lists; both forms read the same lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "testGoldPriceChart testMutualFundDetail verifyDepositoMaturity testTabunganGoal checkSimpananInterestRate testAutoSaveToggle testBudgetLimit verifyInvestmentIntro testPortfolioTotals testSelfieUpload "
    "verifyPinjamanOffer testOrderHistoryFilter testMoneyLandingCards verifyExpenseChart testAddMoreAccounts testTopupFlow verifyRewardTab testDiraWidget testHelpSearch testArticleList "
    "testOnboardingSteps checkoutSmoke verifyTransferLimit testMFL2Returns pingOnly"
).split()
DEVICES = ("Pixel 8", "Pixel 7a", "Galaxy S24", "Galaxy A54", "Redmi 12", "iPhone 15", "iPhone 13")
REASONS = (
    "java.lang.NullPointerException: value was null for order %N%\n\tat androidx.core.View.draw(View.java:9)\n\tat com.gojek.app.Cart.total(Cart.java:213)",
    'NoSuchElementException: Can\'t locate an element by this strategy: AppiumBy.accessibilityId: "Pay now"',
    "org.junit.AssertionError: expected: %N% but was: 0",
    "java.lang.RuntimeException: wrapper\nCaused by: java.net.SocketTimeoutException: read timed out after %N%ms",
    "Header value cannot be null while calling https://api.example/v1/%N%",
    "'com.sample.app' is still running after 500ms timeout, attempt %N%",
    "Session not created on host %N%",
    "Savings icon is not visible after %N% seconds",
    "COMPLETED",
    "2026-08-05 04:51:22:421 - [cdea8165][HTTP] Proxying [POST /session] to host %N%",
    'WebDriverException: no such element with id: "balance_label" on HomeActivity',
    "Unable to locate element with xpath //*[@content-desc=\"Gold tab\"] in MainScreen %N%",
    "FATAL EXCEPTION: main process %N%",
    "Response code: 503 from gateway at https://api.example/v2/%N%",
    "TIMEOUT",
    "Toggle is off although it should be on, case %N%",
    "Savings icon is not visible after %N% seconds of waiting",
    "Toggle is off although it should be on for %N%",
    # two texts that only the words of all failures make alike
    "Wallet banner is not visible here",
    "org.junit.AssertionError: expected: wallet banner but was: coupon ribbon",
    "Coupon ribbon is not visible here",
    "org.junit.AssertionError: expected: coupon banner but was: wallet ribbon %N%",
)
STATUSES = ("failed", "error", "timeout")
VERSIONS = ("4.0", "4.1", "")


def sessions_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    i, u, bad = F.col("event_id"), F.col("user_id"), F.col("event_type") == "error"
    v = F.coalesce("value", F.lit(0.0))
    return e.select(
        i.alias("row_id"), i.cast("string").alias("session_id"), pick(NAMES, u).alias("name"), F.when(bad, pick(STATUSES, i)).otherwise("passed").alias("status"),
        F.when(bad, F.replace(pick(REASONS, i), F.lit("%N%"), i.cast("string"))).otherwise("").alias("reason"), v.alias("duration"),
        F.when(u % 2 == 1, "ios").otherwise("android").alias("platform"), pick(("alpha", "beta"), u).alias("project"), (12 + u % 4).cast("string").alias("os_version"), pick(DEVICES, u).alias("device"),
        pick(VERSIONS, i).alias("app_version"), F.lit("app.apk").alias("app_filename"), (v * 0.25).alias("browserstack_seconds"), (v * 0.75).alias("user_seconds"),
        F.concat(F.lit("https://host.example/s/"), i.cast("string"), F.lit("?auth=x#y")).alias("session_url"), F.lit("").alias("logs"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("build_id"), F.lit("").alias("log_text"), F.lit("").alias("terminal_logs_url"), bad.alias("is_failure"),
        F.when(i % 5 != 0, (i * 37 % 1000) / 10.0).alias("app_cpu_mean"), F.when(i % 5 != 0, (i * 53 % 1000) / 10.0).alias("app_cpu_max"), F.when(i % 7 != 0, (i * 91 % 4000) / 10.0).alias("app_mem_max_mb"),
    )


def builds_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build a day and project-less extras: one without sessions and one of two projects."""
    days = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd").alias("build_id")).distinct()
    day = F.col("build_id")
    own = days.select("build_id", F.when(F.substring(day, 10, 1).isin("0", "3", "6", "9"), "beta").otherwise("alpha").alias("project"), F.concat(F.lit("nightly "), day).alias("name"), F.lit("done").alias("status"), F.concat(day, F.lit("T00:00:00")).alias("created_at"))
    extra = spark.createDataFrame([("2024-02-01", "alpha", "empty", "done", "2024-02-01T00:00:00"), ("2024-02-02", "alpha + beta", "joined", "failed", "2024-02-02T00:00:00")], own.schema)
    return own.unionByName(extra)


def payloads_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and the fields of a raw payload for each session, before any normalisation."""
    s = sessions_from_events(spark, sf_dir)
    totals = F.struct(F.col("browserstack_seconds").alias("browserstack_time"), F.col("user_seconds").alias("user_time"))
    return s.select(
        "row_id", F.col("session_id").alias("hashed_id"), F.lit(None).cast("string").alias("session_id"), F.concat(F.lit("  "), "name", F.lit(" ")).alias("name"), F.upper("status").alias("status"), "reason", "duration",
        F.upper("platform").alias("os"), F.col("project").alias("project_name"), "os_version", "device", F.lit("").alias("browser_url"), F.col("session_url").alias("public_url"), "logs", "created_at", F.col("build_id").alias("build_hashed_id"),
        F.lit(None).cast("string").alias("session_terminal_logs_url"), F.struct("app_version", F.col("app_filename").alias("app_name")).alias("app_details"), F.struct(F.struct(totals.alias("totals")).alias("summary")).alias("insights"),
    )


def profiles_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, series: each user's events as one profiling series."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_seconds(F.col("ts").cast("timestamp")) % 100_000
    point = F.struct(
        at.cast("double").alias("ts"), F.coalesce("value", F.lit(0.0)).alias("cpu"), F.lit(8000.0).alias("mem"), (F.col("event_id") % 3000).cast("double").alias("mema"), (100 - F.col("event_id") % 50).cast("double").alias("batt"),
        (30 + F.col("event_id") % 9).cast("double").alias("temp"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 97).cast("double")).alias("app_cpu"), (F.col("event_id") % 211).cast("double").alias("app_mem"),
    )
    rows = F.array_sort(F.collect_list(F.struct("event_id", point.alias("p"))))
    return e.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.to_json(F.transform(rows, lambda x: x["p"]), {"ignoreNullFields": "false"}).alias("series"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, at: str) -> str:
    return f"list_extract({_list(values)}, CAST({at} % {len(values)} AS INTEGER) + 1)"


SESSIONS_SQL = f"""SELECT event_id AS row_id, CAST(event_id AS VARCHAR) AS session_id, {_pick(NAMES, 'user_id')} AS name,
  CASE WHEN event_type = 'error' THEN {_pick(STATUSES, 'event_id')} ELSE 'passed' END AS status,
  CASE WHEN event_type = 'error' THEN replace({_pick(REASONS, 'event_id')}, '%N%', CAST(event_id AS VARCHAR)) ELSE '' END AS reason,
  coalesce(value, 0.0) AS duration, CASE WHEN user_id % 2 = 1 THEN 'ios' ELSE 'android' END AS platform, {_pick(('alpha', 'beta'), 'user_id')} AS project,
  CAST(12 + user_id % 4 AS VARCHAR) AS os_version, {_pick(DEVICES, 'user_id')} AS device, {_pick(VERSIONS, 'event_id')} AS app_version, 'app.apk' AS app_filename,
  coalesce(value, 0.0) * 0.25 AS browserstack_seconds, coalesce(value, 0.0) * 0.75 AS user_seconds,
  'https://host.example/s/' || CAST(event_id AS VARCHAR) || '?auth=x#y' AS session_url, '' AS logs, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at,
  strftime(ts, '%Y-%m-%d') AS build_id, '' AS log_text, '' AS terminal_logs_url, event_type = 'error' AS is_failure,
  CASE WHEN event_id % 5 <> 0 THEN (event_id * 37 % 1000) / 10.0 END AS app_cpu_mean, CASE WHEN event_id % 5 <> 0 THEN (event_id * 53 % 1000) / 10.0 END AS app_cpu_max,
  CASE WHEN event_id % 7 <> 0 THEN (event_id * 91 % 4000) / 10.0 END AS app_mem_max_mb
FROM events"""

BUILDS_SQL = """SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS build_id, CASE WHEN strftime(ts, '%Y-%m-%d')[10] IN ('0', '3', '6', '9') THEN 'beta' ELSE 'alpha' END AS project,
  'nightly ' || strftime(ts, '%Y-%m-%d') AS name, 'done' AS status, strftime(ts, '%Y-%m-%d') || 'T00:00:00' AS created_at FROM events
UNION ALL SELECT '2024-02-01', 'alpha', 'empty', 'done', '2024-02-01T00:00:00'
UNION ALL SELECT '2024-02-02', 'alpha + beta', 'joined', 'failed', '2024-02-02T00:00:00'"""
