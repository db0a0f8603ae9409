"""Logs of failed sessions, joined to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import extract_error, has_error, looks_like_crash, strip, text_of
from ..settings import SETTINGS, Settings


def combine_logs(logs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """session_id, combined, crash of logs (session_id, source, text): sources in the configured order; an empty crash log is none."""
    # the signed address comes last, and as it is
    order = F.array_position(F.array(*map(F.lit, (*settings.log_sources, "terminal"))), F.col("source"))
    good = logs.where((order > 0) & (strip(F.col("text")) != "") & ((F.col("source") != "crash") | looks_like_crash(F.col("text"))))
    end = F.right("text", F.lit(settings.log_fetch_chars))
    part = F.when(F.col("source") == "terminal", end).otherwise(F.concat(F.lit("--- "), "source", F.lit(" ---\n"), end))
    parts = good.select("session_id", F.struct(order.alias("o"), part.alias("p")).alias("x"), (F.col("source") == "crash").alias("c"))
    return parts.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "\n").alias("combined"), F.bool_or("c").alias("crash"))


def enrich(sessions: DataFrame, logs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Failures get log_text, and a reason from the log only where their own tells no error."""
    one = combine_logs(logs, settings)
    out = sessions.join(one, "session_id", "left")
    take = F.col("is_failure") & F.col("combined").isNotNull()
    out = out.withColumn("_snippet", F.when(take, extract_error(F.col("combined"))).otherwise(""))
    marker = F.when(F.col("crash"), fixed.CRASH_MARKER + "\n").otherwise("")
    return out.withColumns({
        "log_text": F.when(take, F.concat(marker, "_snippet", F.lit("\n"), F.right("combined", F.lit(settings.log_store_chars)))).otherwise(F.col("log_text")),
        "reason": F.when(take & (F.col("_snippet") != "") & ~has_error(F.col("reason")), F.col("_snippet")).otherwise(text_of(F.col("reason"))),
    }).select(sessions.columns)
