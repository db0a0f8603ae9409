"""Sessions that keep arriving as JSON lines, folded into the history batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.history import History
from ..sources.sessions import RAW, normalize_sessions


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised sessions of every file that lands in the folder."""
    raw = spark.readStream.schema(T.StructType(RAW.fields)).json(folder)
    return normalize_sessions(raw.withColumn("row_id", F.xxhash64("hashed_id", "session_id")))


def fold_into(history: History):
    """A foreachBatch function; a batch given twice changes nothing, as sessions are replaced by id."""

    def run(batch: DataFrame, _: int) -> None:
        history.put_sessions(batch)

    return run
