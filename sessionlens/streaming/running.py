"""Trend and device risk of sessions that keep arriving, from counts that only grow.

Sessions sent again within the watermark are dropped by id, wherever they arrive.  Each
micro-batch adds its counts by build and by device cell under its own number, so
one that is run again replaces its own counts; sums over all batches are the
counts of all sessions.  Counts are additive, so the order of arrival doesn't matter.
What is later than the watermark's delay can't be told from a copy any more and is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.risk import CELL, device_counts, rated_cells, with_dimensions
from ..settings import SETTINGS, Settings
from ..sources.history import build_counts, trend_of_counts

COUNTS = "total long, failed long"


class RunningCounts:
    """Counts by build and by device cell, a folder a batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch function."""
        batch.persist()
        try:
            build_counts(batch).write.mode("overwrite").parquet(f"{self.path}/builds/batch={number}")
            device_counts(with_dimensions(batch)).write.mode("overwrite").parquet(f"{self.path}/cells/batch={number}")
        finally:
            batch.unpersist()

    def start(self, sessions: DataFrame, checkpoint: str, delay: str = "7 days", **trigger) -> StreamingQuery:
        """Counts a stream of sessions until it is stopped; `delay` is how late a session or a copy of one can be."""
        timed = sessions.withColumn("at", F.coalesce(F.try_to_timestamp("created_at"), F.current_timestamp()))
        once = timed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["session_id"])
        return once.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add).trigger(**(trigger or {"availableNow": True})).start()

    def _summed(self, name: str, keys: list[str]) -> DataFrame:
        kinds = ", ".join(f"{k} string" for k in keys)
        rows = self.spark.read.schema(f"{kinds}, {COUNTS}").parquet(f"{self.path}/{name}")
        return rows.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"))

    def trend(self, builds: DataFrame, projects: list[str], window: int = SETTINGS.history_window) -> DataFrame:
        return trend_of_counts(builds, self._summed("builds", ["build_id"]), projects, window)

    def device_risk(self, settings: Settings = SETTINGS) -> DataFrame:
        return rated_cells(self._summed("cells", list(CELL)), settings)
