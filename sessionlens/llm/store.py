"""Where intermediate tables go: the shared folder that the cluster names."""

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of our own only where none is set and all runs on one machine (as in tests)."""
    small_batches(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """At most `rows` rows travel to a Python worker at a time: whole texts and sets are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def spare(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As checkpointed, as a compressed table: for large intermediate results.  Also its path, for `discard`."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    return saved_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing will read again, in any store that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, and returns unused memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
