"""Sample sessions from hashes: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sessions import normalize_sessions

DEVICES = (("Pixel 8", "android", "14"), ("Pixel 7a", "android", "13"), ("Galaxy S24", "android", "14"), ("Galaxy A54", "android", "13"), ("Redmi 12", "android", "12"), ("iPhone 15", "ios", "17.3"), ("iPhone 13", "ios", "16.7"))
SHAKY = ("Galaxy A54", "Redmi 12")
SCENARIOS = ("testGoldPriceChart", "testDepositoMaturity", "testSelfieUpload", "testOrderHistoryFilter", "testBudgetSetup", "testAutoSaveToggle", "testTopupFlow", "testHelpArticle", "testPortfolioTotals", "checkoutSmoke")
FAULTS = (
    "java.lang.NullPointerException: value was null\n\tat com.sample.app.Cart.total(Cart.java:{n})",
    "NoSuchElementException: Can't locate an element by this strategy: AppiumBy.accessibilityId: Pay {n}",
    "AssertionError: expected: {n} but was: 0",
    "java.net.SocketTimeoutException: read timed out after {n}ms",
    "Header value cannot be null, request {n}",
    "'com.sample.app' is still running after {n}ms timeout",
    "Session not created on host {n}",
    "Tabungan icon is not visible after {n} seconds",
    "COMPLETED",
)


def sample_sessions(spark: SparkSession, sessions: int = 80, seed: int = 42, builds: int = 1) -> DataFrame:
    """`sessions` rows for each of `builds` builds; about a quarter fail, more on two devices."""
    ids = spark.range(sessions * builds).withColumns({"b": F.floor(F.col("id") / sessions), "i": F.col("id") % sessions})
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(n))
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (draw(k, len(values)) + 1).cast("int"))
    device = (draw(1, len(DEVICES)) + 1).cast("int")
    of = lambda j: F.element_at(F.array(*(F.lit(d[j]) for d in DEVICES)), device)
    chance = F.when(of(0).isin(*SHAKY), 420).otherwise(240)
    failed = draw(2, 1000) < chance
    reason = F.when(failed, F.replace(pick(3, FAULTS), F.lit("{n}"), draw(4, 900).cast("string"))).otherwise("")
    at = F.date_format(F.timestamp_seconds(F.lit(1_750_000_000) + F.col("b") * 86_400 + F.col("i") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = ids.select(
        F.col("id").alias("row_id"), F.format_string("s%06d", "id").alias("hashed_id"), F.lit(None).cast("string").alias("session_id"), pick(5, SCENARIOS).alias("name"),
        F.when(failed, pick(6, ("failed", "error", "timeout"))).otherwise("passed").alias("status"), reason.alias("reason"), (20 + draw(7, 1000) / 10).alias("duration"),
        of(1).alias("os"), F.lit("sample").alias("project_name"), of(2).alias("os_version"), of(0).alias("device"), F.lit("https://host.example/s?auth=1").alias("browser_url"), F.lit(None).cast("string").alias("public_url"),
        F.lit("").alias("logs"), at.alias("created_at"), F.format_string("b%04d", "b").alias("build_hashed_id"), F.lit("").alias("session_terminal_logs_url"),
        F.struct(F.concat(F.lit("4."), (F.col("b") % 5).cast("string")).alias("app_version"), F.lit("app.apk").alias("app_name")).alias("app_details"),
        F.struct(F.struct(F.struct((draw(8, 300) / 10).alias("browserstack_time"), (draw(9, 900) / 10).alias("user_time")).alias("totals")).alias("summary")).alias("insights"),
    )
    return normalize_sessions(raw)
