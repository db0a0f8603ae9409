"""The history of builds and sessions: two tables under one folder.

Every change writes new files beside the old ones and then names the files of both
tables as the next version, so a reader never meets a half-written table, builds and
sessions always fit, and a lost executor costs a retry.  Only files that hold a row to
be replaced are written anew.  A version is named once only: of two writers at a time
one fails.  A writer first takes its number, then fills it in; one that is overtaken in
between, and one that has passed over a number filled in since, fail as well.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import SETTINGS

BUILDS = T.StructType([T.StructField(c, T.StringType()) for c in ("build_id", "project", "name", "status", "created_at", "ingested_at")])
SESSIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("session_id", "build_id", "project", "name", "status")]
    + [T.StructField("is_failure", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("duration", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("platform", "os_version", "device", "app_version", "created_at")]
)


BUCKETS = {"builds": 4, "sessions": 64}
#: A bucket with more files than this is put together when it is next written.
MOST_FILES = 16
KEYS = {"builds": "build_id", "sessions": "session_id"}
SCHEMAS = {"builds": BUILDS, "sessions": SESSIONS}


class History:
    """Builds and sessions; a session belongs to the build that was stored last with it.

    Rows lie in buckets by a hash of their id, a bucket in one or more files without
    common ids.  A version is a list of the files of both tables, named in one step.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: dict[str, int] = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm  # files of any store that Spark reaches
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[3:]) for n in self._names("versions") if n.startswith("at-"))

    def _files_of(self, version: int) -> dict | None:
        fs, path = self._at(f"versions/at-{version:012d}")
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None  # its writer is about to fill it, or was lost

    def version(self) -> tuple[int, dict]:
        """(number of the last version, its files: buckets and, by table, pairs of bucket and path; `at`, the number that names them)."""
        versions = self._versions()
        for v in reversed(versions):
            if found := self._files_of(v):
                return versions[-1], found | {"at": v}
        return versions[-1] if versions else 0, {"buckets": dict(self.buckets), "builds": [], "sessions": []}

    def _rows(self, table: str, files: list) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(f"{self.path}/{p}" for _, p in files))

    def read(self, table: str) -> DataFrame:
        """The table; columns that older files lack are null."""
        return self._rows(table, self.version()[1][table])

    def _write(self, table: str, buckets: int, rows: DataFrame, mark: str) -> list:
        """Writes rows by bucket; the files."""
        folder = f"{table}/v-{mark}-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64(KEYS[table]), F.lit(buckets)))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return [[int(n[7:]), f"{folder}/{n}"] for n in sorted(self._names(folder)) if n.startswith("bucket=")]

    def _holding(self, table: str, files: list, some: Callable[[DataFrame], DataFrame]) -> list:
        """Those of the files that hold rows of some(rows)."""
        if not files:
            return []
        rows = self._rows(table, files).withColumn("_file", F.input_file_name())
        found = some(rows).select(F.regexp_extract("_file", r"(v-[^/]+/bucket=\d+)/[^/]*$", 1).alias("f")).distinct().collect()  # a row a file at most
        names = {f"{table}/{r['f']}" for r in found}
        return [x for x in files if x[1] in names]

    def _replace(self, files: dict, table: str, dirty: list, make: Callable[[DataFrame], DataFrame]) -> None:
        """In `files`, make(their rows) instead of the dirty files."""
        if dirty:
            new = self._write(table, files["buckets"][table], make(self._rows(table, dirty)), "rest")
            files[table] = [x for x in files[table] if x not in dirty] + new

    def _put(self, files: dict, table: str, rows: DataFrame) -> None:
        """In `files`, rows by key: files without any of the keys stay as they are, those with some lose them."""
        key, schema = KEYS[table], SCHEMAS[table]
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
        new = self._write(table, files["buckets"][table], upsert(self.spark.createDataFrame([], schema), rows, key), "new")
        touched = {b for b, _ in new}
        there = [x for x in files[table] if x[0] in touched]
        ids = self._rows(table, new).select(key)
        dirty = self._holding(table, there, lambda old: old.join(ids, key, "left_semi"))
        many = Counter(b for b, _ in there)
        dirty += [x for x in there if many[x[0]] >= MOST_FILES and x not in dirty]
        self._replace(files, table, dirty, lambda old: old.join(ids, key, "left_anti").select(schema.names))
        files[table] = files[table] + new

    def _next(self, change: Callable[[dict], None]) -> None:
        """Names the files that change() leaves as the next version.  If another writer was faster that is an error, and nothing is changed.

        The version before stays for those who still read it; files of older ones go.
        """
        at, files = self.version()
        base = files.pop("at", 0)
        before = {p for t in KEYS for _, p in files[t]}
        try:
            change(files)
            fs, path = self._at(f"versions/at-{at + 1:012d}")
            try:
                out = fs.create(path, False)
            except Exception as e:
                raise RuntimeError("the history was changed by another writer meanwhile; try again") from e
            if any(self._files_of(v) for v in range(base + 1, at + 1) if v in self._versions()):
                fs.delete(path, False)
                raise RuntimeError("the history was changed by a slower writer meanwhile; try again")
        except BaseException:
            self._delete({p for t in KEYS for _, p in files[t]} - before)
            raise
        out.write(bytearray(json.dumps(files | {"base": base}).encode()))
        out.close()
        versions = self._versions()
        if any((self._files_of(v) or {}).get("base", 0) <= at for v in versions if v > at + 1):
            raise RuntimeError("the history was changed by a faster writer meanwhile; try again")
        old, kept = set(), set()
        for v in versions:
            own = {p for t in KEYS for _, p in (self._files_of(v) or {t: []}).get(t, [])}
            (kept if v in versions[-2:] else old).update(own)
        self._delete(old - kept)
        for v in versions[:-2]:
            fs, path = self._at(f"versions/at-{v:012d}")
            fs.delete(path, False)

    def _delete(self, paths: set[str]) -> None:
        for p in paths:
            fs, path = self._at(p)
            fs.delete(path, True)
        for folder in {p.rsplit("/", 1)[0] for p in paths}:
            if not any(n.startswith("bucket=") for n in self._names(folder)):
                fs, path = self._at(folder)
                fs.delete(path, True)

    def change(self, table: str, make: Callable[[DataFrame], DataFrame]) -> None:
        """make(the table) instead of the table: every file is written anew."""

        def whole(files: dict) -> None:
            new = self._write(table, files["buckets"][table], make(self._rows(table, files[table])).select(SCHEMAS[table].names), "rest")
            files[table] = new

        self._next(whole)

    def persist_build(self, meta: dict, sessions: DataFrame) -> None:
        """Stores a build and its sessions; rows of the same ids are replaced, also those of other builds."""
        build, project = str(meta.get("hashed_id") or ""), str(meta.get("project") or "")
        self.persist_builds([(project, meta)], sessions.withColumns({"build_id": F.lit(build), "project": F.lit(project)}))

    def persist_builds(self, builds: list[tuple[str, dict]], sessions: DataFrame) -> None:
        """Stores (project, build) pairs and their sessions (by build_id): both tables change in one step or not at all."""
        text = lambda b, k: str(b.get(k) or "")
        rows = [(text(b, "hashed_id"), p, text(b, "name"), text(b, "status"), text(b, "created_at")) for p, b in builds]
        new = self.spark.createDataFrame(rows, "build_id string, project string, name string, status string, created_at string").withColumn("ingested_at", F.current_timestamp().cast("string"))
        mine = sessions.drop("project").join(F.broadcast(new.select("build_id", "project")), "build_id")  # builds of one run

        def both(files: dict) -> None:
            self._put(files, "builds", new)
            self._put(files, "sessions", mine)

        self._next(both)

    def put_sessions(self, sessions: DataFrame) -> None:
        """Stores sessions whose builds are known or come later."""
        self._next(lambda files: self._put(files, "sessions", sessions))

    def drop_phantoms(self, apply: bool = False) -> DataFrame:
        """Builds without sessions and those of several projects at once; with `apply` they go, the latter with their sessions."""
        bad = phantom_builds(self.read("builds"), self.read("sessions"))
        if apply:
            made = bad.where("synthetic").select("build_id")

            def both(files: dict) -> None:
                for table, gone in (("sessions", made), ("builds", bad.select("build_id"))):
                    dirty = self._holding(table, files[table], lambda rows, gone=gone: rows.join(gone, "build_id", "left_semi"))
                    self._replace(files, table, dirty, lambda rows, gone=gone, table=table: rows.join(gone, "build_id", "left_anti").select(SCHEMAS[table].names))

            self._next(both)
        return bad

    def blank_corrupted(self, apply: bool = False) -> DataFrame:
        """Counts of failures whose reason is a log dump; with `apply` those reasons are emptied."""
        from ..functions.text import looks_corrupted

        report = repair_counts(self.read("sessions"))
        if apply:
            bad = F.col("is_failure") & looks_corrupted(F.col("reason"))

            def blank(files: dict) -> None:
                dirty = self._holding("sessions", files["sessions"], lambda rows: rows.where(bad))
                self._replace(files, "sessions", dirty, lambda rows: rows.withColumn("reason", F.when(bad, "").otherwise(F.col("reason"))))

            self._next(blank)
        return report


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new by key, new first; of several new rows of a key the last stored isn't known, so the largest."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    rest = [c for c in new.columns if c != key]
    top = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_v"), *(F.desc(c) for c in rest)))
    return both.withColumn("_rn", top).where("_rn = 1").drop("_rn", "_v")


def project_names(project: str | Sequence[str] | None) -> list[str]:
    """Names from a list, or from one string with commas or " + " between."""
    if project is None:
        return []
    parts = re.split(r" \+ |,", project) if isinstance(project, str) else list(project)
    return [p.strip() for p in parts if p and p.strip()]


def build_counts(sessions: DataFrame) -> DataFrame:
    """total and failed of each build."""
    return sessions.groupBy("build_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_failure").alias("failed"))


def suite_health_trend(builds: DataFrame, sessions: DataFrame, projects: list[str], window: int = SETTINGS.history_window) -> DataFrame:
    """Pass rate of the newest builds that have sessions, oldest first."""
    return trend_of_counts(builds, build_counts(sessions), projects, window)


def trend_of_counts(builds: DataFrame, counts: DataFrame, projects: list[str], window: int = SETTINGS.history_window) -> DataFrame:
    newest = builds.where(F.col("project").isin(projects)).join(counts, "build_id").orderBy(F.desc("created_at"), "build_id").limit(window)
    rate = F.round(1 - F.col("failed") / F.col("total"), 3)
    return newest.select("build_id", "name", "created_at", "total", "failed", rate.alias("pass_rate")).orderBy("created_at", F.desc("build_id"))


def recent_sessions(builds: DataFrame, sessions: DataFrame, projects: list[str], window: int = SETTINGS.history_window) -> DataFrame:
    """Sessions of the newest builds, those without sessions counted too."""
    newest = builds.where(F.col("project").isin(projects)).orderBy(F.desc("created_at"), "build_id").limit(window)
    return sessions.join(F.broadcast(newest.select("build_id")), "build_id", "left_semi")  # `window` rows at most


def phantom_builds(builds: DataFrame, sessions: DataFrame) -> DataFrame:
    counts = sessions.groupBy("build_id").agg(F.count(F.lit(1)).alias("n"))
    out = builds.join(counts, "build_id", "left").select("build_id", "project", F.coalesce("n", F.lit(0)).alias("sessions"), F.col("project").contains(" + ").alias("synthetic"))
    return out.where("synthetic or sessions = 0").orderBy("build_id")


def repair_counts(sessions: DataFrame) -> DataFrame:
    """One row: failures, corrupted ones, their share, builds touched."""
    from ..functions.text import looks_corrupted

    bad = F.col("is_failure") & looks_corrupted(F.col("reason"))
    return sessions.agg(
        F.count_if("is_failure").alias("failures"), F.count_if(bad).alias("corrupted"), F.round(100 * F.count_if(bad) / F.greatest(F.count_if("is_failure"), F.lit(1)), 1).alias("pct"), F.countDistinct(F.when(bad, F.col("build_id"))).alias("builds")
    )
