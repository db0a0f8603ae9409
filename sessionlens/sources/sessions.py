"""Raw session payloads to the flat sessions table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.text import or_default, strip, strip_token
from ..settings import SETTINGS, Settings
from .documents import array_objects

S, D = T.StringType(), T.DoubleType()
TOTALS = T.StructType().add("browserstack_time", D).add("user_time", D)
RAW = T.StructType(
    [T.StructField(c, S) for c in ("hashed_id", "session_id", "name", "status", "reason")]
    + [T.StructField("duration", D)]
    + [T.StructField(c, S) for c in ("os", "project_name", "os_version", "device", "browser_url", "public_url", "logs", "created_at", "build_hashed_id", "session_terminal_logs_url")]
    + [
        T.StructField("app_details", T.StructType().add("app_version", S).add("app_name", S)),
        T.StructField("insights", T.StructType().add("summary", T.StructType().add("totals", TOTALS))),
    ]
)
BUILD = T.StructType([T.StructField(c, S) for c in ("hashed_id", "name", "project", "suite", "user_name", "status", "created_at")])
DOCUMENT = T.StructType().add("build", BUILD).add("sessions", T.ArrayType(RAW))


class IngestionError(RuntimeError):
    """No usable build or session."""


def normalize_sessions(raw: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """raw (the payload's fields, and row_id) as sessions: every field has a default, tokens are gone from addresses."""
    c = F.col
    totals = c("insights.summary.totals")
    status = F.lower(or_default(c("status"), "unknown"))
    out = {
        "session_id": F.coalesce(F.nullif(c("hashed_id"), F.lit("")), F.nullif(c("session_id"), F.lit("")), F.lit("")),
        "name": strip(c("name")), "status": status, "reason": strip(c("reason")), "duration": F.coalesce("duration", F.lit(0.0)),
        "platform": F.lower(or_default(c("os"), "unknown")), "project": or_default(c("project_name"), ""), "os_version": or_default(c("os_version"), "unknown"), "device": or_default(c("device"), "unknown"),
        "app_version": or_default(c("app_details.app_version"), ""), "app_filename": or_default(c("app_details.app_name"), ""),
        "browserstack_seconds": F.coalesce(totals["browserstack_time"], F.lit(0.0)), "user_seconds": F.coalesce(totals["user_time"], F.lit(0.0)),
        "session_url": strip_token(F.coalesce(F.nullif(c("browser_url"), F.lit("")), c("public_url"))), "logs": strip_token(c("logs")), "created_at": or_default(c("created_at"), ""),
        "build_id": or_default(c("build_hashed_id"), ""), "log_text": F.lit(""), "terminal_logs_url": or_default(c("session_terminal_logs_url"), ""),
    }
    return raw.select("row_id", *(out[k].alias(k) for k in fixed.SESSION_COLUMNS), status.isin(*settings.failure_statuses).alias("is_failure"))


def _largest(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file under the path, in any store that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((x.getLen() for x in fs.globStatus(where) or [] for x in ([x] if x.isFile() else fs.listStatus(x.getPath()))), default=0)


def read_document(spark: SparkSession, path: str, whole_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sessions, builds) of the JSON documents {build, sessions} under the path; row_id is the place in the array, with the file before it if there are several.

    Documents of up to whole_bytes (as much as a task reads) are parsed whole; if there are larger
    ones, all are read by byte ranges, many tasks to a document.
    """
    limit = whole_bytes if whole_bytes is not None else int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    if _largest(spark, path) > limit:
        raw = array_objects(spark, path, "sessions").select("file", F.col("at").alias("row_id"), F.from_json("value", RAW).alias("s"))
        build = spark.read.schema(T.StructType().add("build", BUILD)).json(path, multiLine=True)
    else:
        raw = doc.select(F.col("_metadata.file_path").alias("file"), F.posexplode("sessions").alias("row_id", "s"))
        build = doc
    if len(doc.inputFiles()) > 1:
        raw = raw.withColumn("row_id", F.concat_ws("|", F.regexp_extract("file", "[^/]*$", 0), F.lpad(F.col("row_id").cast("string"), 12, "0")))
    sessions = normalize_sessions(raw.select("row_id", "s.*"))
    if not sessions.head(1):
        raise IngestionError(f"no sessions in {path}")
    return sessions, build.select("build.*")


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a folder of JSON lines, each a payload or one wrapped in automation_session; one row a session id."""
    wrapped = T.StructType([*RAW.fields, T.StructField("automation_session", RAW)])
    raw = spark.read.schema(wrapped).json(path)
    fields = [F.coalesce(F.col(f"automation_session.{f.name}"), F.col(f.name)).alias(f.name) for f in RAW.fields]
    rows = raw.select(*fields)
    key = F.coalesce(F.nullif(F.col("hashed_id"), F.lit("")), F.col("session_id"))
    rows = rows.withColumn("row_id", F.xxhash64(key))
    return normalize_sessions(rows.dropDuplicates(["row_id"]))


def order_rows(sessions: DataFrame) -> DataFrame:
    """row_id by build, time and session within each build: what `first` means after builds are put together."""
    w = Window.partitionBy("build_id").orderBy("created_at", "session_id")
    return sessions.withColumn("row_id", F.concat_ws("|", "build_id", F.lpad(F.row_number().over(w).cast("string"), 12, "0")))


def window_header(sessions: DataFrame, projects: list[str], name: str | None = None) -> DataFrame:
    """One row: how many builds, from and to which day, under which name."""
    day = F.nullif(F.left("created_at", F.lit(10)), F.lit(""))
    r = sessions.agg(F.countDistinct("build_id").alias("n_builds"), F.coalesce(F.min(day), F.lit("")).alias("date_from"), F.coalesce(F.max(day), F.lit("")).alias("date_to"))
    n = F.col("n_builds").cast("string")
    return r.withColumns({"project": F.lit(" + ".join(projects)), "hashed_id": F.concat(n, F.lit(" builds · "), "date_from", F.lit(" → "), "date_to"), "name": F.lit(name) if name else F.concat(F.lit("Last "), n, F.lit(" builds"))})


def window_meta(sessions: DataFrame, projects: list[str], user: str | None = None, name: str | None = None) -> dict:
    """Header of a run over several builds."""
    r = window_header(sessions, projects, name).head().asDict()
    return r | {"projects": projects, "is_multi_project": len(projects) > 1, "user_name": user, "status": "range", "created_at": r["date_to"], "is_range": True}
