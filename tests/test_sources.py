import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sessionlens import cli, settings
from sessionlens.plans import report
from sessionlens.plans.triage import run_triage
from sessionlens.sources import api, history, sessions
from sessionlens.sources.generator import sample_sessions
from sessionlens.sources.logs import combine_logs, enrich

PAYLOAD = {
    "build": {"hashed_id": "b1", "name": "ann.lee triggered", "project": "alpha", "status": "done", "created_at": "2026-01-01T00:00:00Z"},
    "sessions": [
        {"hashed_id": "a", "name": " t ", "status": "FAILED", "reason": "FooError: x", "duration": 3, "os": "iOS", "os_version": "17", "device": "d", "app_details": {"app_version": "2"}, "browser_url": "https://h/x?auth=1", "insights": {"summary": {"totals": {"browserstack_time": 2, "user_time": 5}}}},
        {"session_id": "b", "status": None, "public_url": "https://h/y#z"},
    ],
}


def test_document(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(PAYLOAD, indent=1))
    rows, build = sessions.read_document(spark, str(tmp_path / "x.json"))
    a, b = rows.orderBy("row_id").collect()
    assert (a["session_id"], a["name"], a["status"], a["is_failure"], a["app_version"], a["session_url"], a["user_seconds"]) == ("a", "t", "failed", True, "2", "https://h/x", 5.0)
    assert (b["session_id"], b["status"], b["device"], b["duration"], b["session_url"], b["is_failure"]) == ("b", "unknown", "unknown", 0.0, "https://h/y", False)
    assert build.head()["project"] == "alpha"


def test_a_document_is_read_by_many_tasks(spark, tmp_path):
    """By splits of a few bytes, with braces, quotes and escapes in strings and other arrays around."""
    rng = random.Random(7)
    odd = ['{"', '\\"', "}", "[{", "\\\\", "a b", "é", '":[{"', "]}", "\n"]
    rows = [{"hashed_id": f"s{k}", "name": "".join(rng.choice(odd) for _ in range(rng.randint(0, 9))), "reason": "".join(rng.choice(odd) for _ in range(9)), "insights": {"summary": {"totals": {"user_time": k}}}, "tags": [{"x": [1, {"y": "}"}]}]} for k in range(120)]
    doc = {"notes": [{"a": 1}, {"sessions": [{"hashed_id": "no"}]}], "build": {"hashed_id": "b", "name": "n}"}, "sessions": rows, "after": [{"hashed_id": "no"}]}
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=1, ensure_ascii=False))
    whole, build = sessions.read_document(spark, str(tmp_path / "x.json"))
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 120
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97b", "500b", "5000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got, build = sessions.read_document(spark, str(tmp_path / "x.json"), 0)
            assert sorted(map(tuple, got.collect())) == want and build.head()["name"] == "n}"
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "x.json")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "y.json").write_text(json.dumps({"build": {}, "sessions": rows[:3]}))
    for limit in (None, 0):
        both, _ = sessions.read_document(spark, str(tmp_path), limit)
        ids = [r["row_id"] for r in both.collect()]
        assert len(set(ids)) == 123 and "y.json|000000000002" in ids


def test_empty_document_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"build": {}, "sessions": []}))
    with pytest.raises(sessions.IngestionError):
        sessions.read_document(spark, str(tmp_path / "x.json"))


BUILDS = [{"hashed_id": "1", "name": "nightly 17", "status": "done", "created_at": "2026-01-01"}, {"hashed_id": "2", "name": "nightly 174", "status": "running", "created_at": "2026-01-03"}, {"hashed_id": "3", "name": "smoke", "status": "failed", "created_at": "2026-01-02"}]


def transport():
    def fake(path, params=None):
        if path == "/projects.json":
            return [{"project": {"id": 7, "name": "Alpha"}}]
        if path == "/projects/7.json":
            return {"project": {"builds": BUILDS}}
        if path.endswith("sessions.json"):
            every = [{"automation_session": {"hashed_id": f"s{k}", "status": "failed" if k % 2 else "passed"}} for k in range(130)]
            return every[params["offset"] : params["offset"] + params["limit"]]
        raise OSError(path)

    return fake  # made in a function, so that it travels by value


fake = transport()


def test_builds_are_found():
    service = api.Service(fake)
    assert service.project_id(" alpha ") == 7
    assert [b["hashed_id"] for b in service.recent_builds(7, 5)] == ["3", "1"]
    assert service.find_builds(7, ["nightly 17"])[0][1]["hashed_id"] == "1"
    assert service.find_builds(7, ["174"])[0][1]["hashed_id"] == "2"
    with pytest.raises(api.IngestionError):
        service.find_builds(7, ["nightly"])
    with pytest.raises(api.IngestionError):
        service.resolve_builds(None, ["smoke", "nowhere"])


def test_pages(spark):
    assert len(list(api.fetch_sessions(fake, "1"))) == 130
    same = lambda path, params=None: [{"hashed_id": "x"}] * 100
    assert len(list(api.fetch_sessions(same, "1"))) == 1
    df = api.read_builds(spark, fake, [("Alpha", BUILDS[0]), ("Alpha", BUILDS[2])])
    assert df.count() == 260 and {r[0] for r in df.select("build_id").distinct().collect()} == {"1", "3"} and df.where("project = 'Alpha'").count() == 260


def service_in(folder, builds):
    """A transport that notes each request in a folder, as executors make them too."""

    def get(path, params=None):
        import os
        import uuid

        name = path.strip("/").replace("/", "~") + (f"~{params['offset']}" if params else "")
        open(os.path.join(folder, f"{name}@{uuid.uuid4().hex}"), "w").close()
        if path == "/projects.json":
            return [{"project": {"id": 7, "name": "Alpha"}}]
        if path == "/projects/7.json":
            return {"project": {"builds": builds}}
        if path.endswith("sessions.json"):
            n = 0 if "/none/" in path else 130
            every = [{"hashed_id": f"{path.split('/')[2]}-{k}", "name": "testGold", "status": "failed" if k % 2 else "passed", "reason": "FooError: x" if k % 2 else "", "created_at": "2026-01-01"} for k in range(n)]
            return every[params["offset"] : params["offset"] + params["limit"]]
        if path.endswith("appprofiling/v2"):
            return [{"ts": t, "cpu": 5.0, "mem": 1.0, "mema": 1.0, "batt": 1.0, "temp": 1.0, "app_cpu": 3.0, "app_mem": 2.0} for t in range(3)]
        raise OSError(path)

    return get


def test_every_page_is_fetched_once(spark, tmp_path, monkeypatch, caplog):
    asked = tmp_path / "asked"
    asked.mkdir()
    builds = [{"hashed_id": b, "name": f"{b} triggered", "status": "done", "created_at": f"2026-01-0{k}"} for k, b in enumerate(("one", "two", "none"), 1)]
    monkeypatch.setattr(cli, "SETTINGS", settings.Settings(history_path=str(tmp_path / "h")))
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    monkeypatch.setattr(cli, "run_triage", lambda s, past: {"profiles": s.select("session_id", "app_cpu_mean"), "past": past.select("session_id")})
    assert cli.main(["--source", "api", "--mode", "range", "--profile", "--project", "alpha", "--output", str(tmp_path / "r.html")], service_in(str(asked), builds)) == 0
    pages = [x.name.split("@")[0] for x in asked.iterdir() if "sessions.json" in x.name]
    assert sorted(pages) == sorted(f"builds~{b}~sessions.json~{o}" for b, o in (("one", 0), ("one", 100), ("two", 0), ("two", 100), ("none", 0)))
    profiled = [x.name.split("@")[0] for x in asked.iterdir() if "appprofiling" in x.name]
    assert len(profiled) == len(set(profiled)) == 260
    assert "none" in caplog.text
    out = spark.read.parquet(str(tmp_path / "r_artifacts" / "profiles"))
    assert out.count() == 260 and out.where("app_cpu_mean = 3.0").count() == 260
    assert history.History(spark, str(tmp_path / "h")).read("builds").count() == 2
    assert cli.main(["--source", "api", "--build", "none", "--output", str(tmp_path / "x.html")], service_in(str(asked), builds)) == 1


def test_default_project(monkeypatch):
    service = api.Service(fake, settings.Settings(target_project="Beta", target_project_id="31"))
    assert service.to_search(None) == [("Beta", 31)]


def test_signed_address_is_the_last_resort(spark):
    def get(path, params=None):
        if path == "https://logs/x":
            return "signed text"
        if "/a/" in path and path.endswith("appiumlogs"):
            return "api text"
        if path.endswith("crashlogs"):
            return "no crash found here at all"
        raise OSError(path)

    f = spark.createDataFrame([("a", "1", "https://logs/x"), ("b", "1", "https://logs/x"), ("c", "1", "")], "session_id string, build_id string, terminal_logs_url string")
    logs = api.fetch_logs(get, f)
    assert {tuple(r) for r in logs.collect()} == {("a", "appium", "api text"), ("b", "terminal", "signed text")}
    assert {r["session_id"]: r["combined"] for r in combine_logs(logs).collect()} == {"a": "--- appium ---\napi text", "b": "signed text"}


def test_requests_of_a_task_run_side_by_side():
    """16 requests of 0.05 s in less than half the time that one after the other takes; a failed one costs nobody else anything."""
    import time

    def get(path, params=None):
        time.sleep(0.05)
        if "/s5/" in path:
            raise OSError("simulated")
        return [{"ts": 1}] if "profiling" in path else f"NoSuchElementError: {path}"

    mine = settings.Settings(log_sources=("appium",), fetch_workers=8)
    for fetch, rows in ((api.logs_of, [(f"s{k}", "b", "") for k in range(16)]), (api.profiles_of, [(f"s{k}", "b") for k in range(16)])):
        start = time.perf_counter()
        got = [x[0] for part in fetch(get, rows, mine) for x in part]
        assert time.perf_counter() - start < 0.4
        assert got == [f"s{k}" for k in range(16) if k != 5]
    long = api.logs_of(lambda path, params=None: "x" * 300_000 + "end", [("a", "b", "")], mine)
    assert [len(x[2]) for part in long for x in part] == [200_000]


def test_retries(monkeypatch):
    """Busy and failing answers are asked for again with growing pauses, refused ones aren't."""
    import io
    import urllib.error

    pauses, answers = [], []

    class Answer(io.BytesIO):
        headers = {"Content-Type": "application/json"}

    def open_(request, timeout):
        assert timeout == 30.0 and request.headers["Authorization"].startswith("Basic ")
        code = answers.pop(0)
        if code == 0:
            raise urllib.error.URLError("no route")
        if code != 200:
            raise urllib.error.HTTPError(request.full_url, code, "x", {}, None)
        return Answer(b'{"a": 1}')

    monkeypatch.setattr(api.urllib.request, "urlopen", open_)
    monkeypatch.setattr(api.time, "sleep", pauses.append)
    get = api.HttpTransport("https://h/", "u", "k")
    answers[:] = [429, 503, 0, 200]
    assert get("/x", {"limit": 2}) == {"a": 1} and pauses == [0.5, 1.0, 2.0]
    answers[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        get("/x")
    answers[:] = [500] * 5
    with pytest.raises(urllib.error.HTTPError):
        get("/x")
    assert not answers
    with pytest.raises(sessions.IngestionError, match="credentials"):
        api.HttpTransport("https://h", "", "k")


def test_landing_leaves_the_schema_alone(spark, tmp_path):
    n = len(sessions.RAW.fields)
    (tmp_path / "x.json").write_text('{"hashed_id": "a"}\n{"automation_session": {"hashed_id": "b"}}\n{"hashed_id": "a"}\n')
    for _ in range(2):
        assert sessions.read_landing(spark, str(tmp_path)).count() == 2
    assert len(sessions.RAW.fields) == n


def test_logs_augment(spark):
    s = sample_sessions(spark, 20).where("is_failure").limit(2)
    a, b = [r["session_id"] for r in s.orderBy("row_id").collect()]
    logs = spark.createDataFrame([(a, "crash", "FATAL EXCEPTION: main thread died"), (a, "appium", "x\nNoSuchElementException: gone"), (b, "crash", "no crash found in this run")], "session_id string, source string, text string")
    assert combine_logs(logs).count() == 1
    got = {r["session_id"]: r for r in enrich(s, logs).collect()}
    assert got[a]["log_text"].startswith("BROWSERSTACK_CRASHLOG_PRESENT\nFATAL EXCEPTION") and got[b]["log_text"] == ""


def test_history(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    s = sample_sessions(spark, 10)
    meta = {"hashed_id": "b1", "project": "alpha", "created_at": "2026-01-01"}
    for _ in range(2):
        h.persist_build(meta, s)
    assert h.read("sessions").count() == 10 and h.read("builds").count() == 1
    h.persist_build({"hashed_id": "b2", "project": "beta", "created_at": "2026-01-02"}, s.limit(4))
    h.persist_build({"hashed_id": "b3", "project": "alpha + beta", "created_at": "2026-01-03"}, s.limit(0))
    moved = {r[0]: r[1] for r in h.read("sessions").groupBy("build_id").count().collect()}
    assert moved == {"b1": 6, "b2": 4}
    trend = history.suite_health_trend(h.read("builds"), h.read("sessions"), ["alpha", "beta"]).collect()
    assert [r["build_id"] for r in trend] == ["b1", "b2"]
    assert [r["build_id"] for r in h.drop_phantoms(apply=True).collect()] in ([], ["b3"])
    assert h.read("builds").count() == 2 and history.project_names("a + b, c") == ["a", "b", "c"]


def test_of_two_writers_one_fails(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    s = sample_sessions(spark, 6)
    meta = {"hashed_id": "b1", "project": "alpha", "created_at": "2026-01-01"}
    h.persist_build(meta, s)

    def slow(old):
        h.persist_build(meta, s.limit(2))  # another writer in between
        return old.limit(0)

    with pytest.raises(RuntimeError, match="another writer"):
        h.change("sessions", slow)
    assert h.read("sessions").count() == 6
    assert len(list((tmp_path / "h" / "versions").glob("at-*"))) == 2
    for _ in range(3):
        h.persist_build(meta, s)
    assert len(list((tmp_path / "h" / "versions").glob("at-*"))) == 2
    named = {p for v in h._versions() for t in ("builds", "sessions") for _, p in h._files_of(v)[t]}
    assert {str(x.relative_to(tmp_path / "h")) for x in (tmp_path / "h").glob("*/v-*/bucket=*")} == named


def test_a_build_rewrites_only_files_with_its_sessions(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"), {"builds": 2, "sessions": 5})
    s = sample_sessions(spark, 40)
    old, some = s.where("row_id % 2 = 0"), s.where("row_id % 2 = 1")
    h.persist_build({"hashed_id": "b1", "project": "p"}, old)
    first = h.version()[1]["sessions"]
    h.persist_build({"hashed_id": "b2", "project": "p"}, some)
    second = h.version()[1]["sessions"]
    assert all(x in second for x in first)  # new ids: nothing is written anew
    one = old.limit(1)
    h.persist_build({"hashed_id": "b3", "project": "p"}, one)
    third = h.version()[1]["sessions"]
    assert len([x for x in second if x not in third]) == 1
    rows = {r["session_id"]: r["build_id"] for r in h.read("sessions").collect()}
    assert len(rows) == h.read("sessions").count() == 40 and rows[one.head()["session_id"]] == "b3"


def test_a_crash_between_the_tables_changes_nothing(spark, tmp_path, monkeypatch):
    h = history.History(spark, str(tmp_path / "h"))
    s = sample_sessions(spark, 6)
    h.persist_build({"hashed_id": "b1", "project": "p"}, s)
    whole, plain = h.version(), h._put

    def broken(files, table, rows):
        if table == "sessions":
            raise OSError("lost")
        plain(files, table, rows)

    monkeypatch.setattr(h, "_put", broken)
    with pytest.raises(OSError, match="lost"):
        h.persist_build({"hashed_id": "b2", "project": "p"}, s)
    assert h.version() == whole and [r["build_id"] for r in h.read("builds").collect()] == ["b1"]
    (tmp_path / "h" / "versions" / "at-000000000002").write_text("")  # a writer that was lost before it named its files
    assert h.read("sessions").count() == 6
    monkeypatch.undo()
    h.persist_build({"hashed_id": "b2", "project": "p"}, s)
    assert h.version()[0] == 3 and {r["build_id"] for r in h.read("sessions").collect()} == {"b2"}


def test_a_writer_that_was_overtaken_fails(spark, tmp_path, monkeypatch):
    h = history.History(spark, str(tmp_path / "h"))
    s = sample_sessions(spark, 6)
    h.persist_build({"hashed_id": "b1", "project": "p"}, s)
    waiting = [{"hashed_id": "b3", "project": "p"}]

    def dumps(x):
        if waiting:  # another writer, after this one has taken its number and before it fills it in
            h.persist_build(waiting.pop(), s.limit(2))
        return json.dumps(x)

    monkeypatch.setattr(history, "json", SimpleNamespace(loads=json.loads, dumps=dumps))
    with pytest.raises(RuntimeError, match="faster writer"):
        h.persist_build({"hashed_id": "b2", "project": "p"}, s)
    assert {r["build_id"] for r in h.read("builds").collect()} == {"b1", "b3"} and h.read("sessions").count() == 6
    h.persist_build({"hashed_id": "b2", "project": "p"}, s)
    assert {r["build_id"] for r in h.read("builds").collect()} == {"b1", "b2", "b3"}


def test_a_number_filled_in_late_is_not_passed_over(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    s = sample_sessions(spark, 6)
    h.persist_build({"hashed_id": "b1", "project": "p"}, s)
    first, late = ((tmp_path / "h" / "versions" / f"at-{k:012d}") for k in (1, 2))
    late.write_text("")

    def slow(old):
        late.write_text(first.read_text())
        return old.limit(0)

    with pytest.raises(RuntimeError, match="slower writer"):
        h.change("sessions", slow)
    assert h.version()[0] == 2 and h.read("sessions").count() == 6


def test_many_small_files_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "MOST_FILES", 3)
    h = history.History(spark, str(tmp_path / "h"), {"builds": 1, "sessions": 1})
    for k in range(7):
        h.persist_build({"hashed_id": f"b{k}", "project": "p"}, sample_sessions(spark, 2).withColumn("session_id", F.concat(F.lit(f"{k}-"), "session_id")))
        assert len(h.version()[1]["sessions"]) <= 4
    assert h.read("sessions").count() == 14 and h.read("builds").count() == 7


def test_older_files_lack_columns(spark, tmp_path):
    import datetime

    h = history.History(spark, str(tmp_path / "h"))
    start = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None) - datetime.timedelta(seconds=1)
    h.persist_build({"hashed_id": "b1", "project": "p"}, sample_sessions(spark, 8))
    stored = datetime.datetime.fromisoformat(h.read("builds").head()["ingested_at"])
    assert start <= stored <= start + datetime.timedelta(minutes=5)
    for _, p in h.version()[1]["sessions"]:
        rows = spark.read.parquet(str(tmp_path / "h" / p)).drop("app_version").toPandas()
        for f in (tmp_path / "h" / p).iterdir():
            f.unlink()
        rows.to_parquet(tmp_path / "h" / p / "part-0.parquet")
    old = h.read("sessions")
    assert old.columns == history.SESSIONS.names and old.where("app_version is null").count() == 8
    h.persist_build({"hashed_id": "b2", "project": "p"}, sample_sessions(spark, 8).limit(3))
    assert h.read("sessions").where("app_version is null").count() == 5


def test_replayed_stream_batches_change_nothing(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    from sessionlens.streaming.incremental import fold_into

    fold, s = fold_into(h), sample_sessions(spark, 9)
    for k in (0, 1, 0):
        fold(s.where(f"row_id % 2 = {k}"), k)
    assert h.read("sessions").count() == 9


def test_pages_as_a_table_are_read_as_in_turn(spark):
    """Pages with repeats within and across, short, empty and missing ones: as the reader that asks page by page."""
    from sessionlens.sources import catalog

    mine = settings.Settings(page_size=3, most_pages=5)
    builds = {
        "plain": [["a", "b", "c"], ["d", "e", "f"], ["g"]],
        "stuck": [["a", "b", "c"], ["a", "b", "c"], ["x", "y", "z"]],
        "short": [["a", "b"], ["x", "y", "z"]],
        "overlap": [["a", "b", "c"], ["c", "d", "e"], ["e", "f", "g"], []],
        "within": [["a", "a", "b"], ["b", "c", "c"], ["d"]],
        "endless": [[f"{k}0", f"{k}1", f"{k}2"] for k in range(9)],
        "empty": [[]],
    }
    pages = spark.createDataFrame([(b, k, [(x,) for x in rows]) for b, every in builds.items() for k, rows in enumerate(every)], "build_id string, page long, rows array<struct<hashed_id:string>>")
    got = {}
    for r in sorted(catalog.payloads_of_pages(pages, F.col("r.hashed_id"), mine).collect()):
        got.setdefault(r["build_id"], []).append(r["r"]["hashed_id"])

    def get(path, params):
        every = builds[path.split("/")[2]]
        k = params["offset"] // 3
        return [{"hashed_id": x} for x in (every[k] if k < len(every) else [])]

    assert got == {b: [r["hashed_id"] for r in rows] for b in builds if (rows := list(api.fetch_sessions(get, b, mine)))}


def test_landed_pages_have_no_bound(spark):
    """A build of more pages than may be asked for at once is read to its end."""
    from sessionlens.sources import catalog

    size, n = settings.SETTINGS.page_size, settings.SETTINGS.most_pages + 3
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(F.concat_ws("-", F.col("id").cast("string"), k.cast("string")).alias("hashed_id")))
    pages = spark.range(n).select(F.lit("b").alias("build_id"), F.col("id").alias("page"), rows.alias("rows"))
    assert catalog.payloads_of_pages(pages, F.col("r.hashed_id")).count() == n * size


def test_fetched_profiles_tell_their_seconds(spark, tmp_path):
    from sessionlens.plans import queries

    rows = spark.range(3).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 5).cast("timestamp_ntz").alias("ts"), F.lit(2).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["session_id"]: (r["profile_samples"], r["device_cpu_mean"], r["profile_seconds"]) for r in queries.QUERIES["s20_fetched_profiles"](spark, str(tmp_path)).collect()}
    assert got == {"0": (None, None, None), "1": (None, None, None), "2": (3, 1.5, 10.0)}


def _half_means(spark, folder):
    """events of 40 users whose values have means of some tenths and five hundredths, in one row group."""
    rng, rows = random.Random(7), []
    for u in range(40):
        n = rng.choice([20, 50, 324])
        cents = [rng.randrange(20_000) for _ in range(n)]
        more = (5 * n - sum(cents)) % (10 * n)
        rows += [(u, (c + more // n + (k < more % n)) / 100) for k, c in enumerate(cents)]
    df = spark.createDataFrame([(k, 1_704_067_200 + k, u, v) for k, (u, v) in enumerate(rows)], "event_id long, at long, user_id long, value double")
    out = str(folder / "events.parquet")
    df.select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value").coalesce(1).sortWithinPartitions("event_id").write.parquet(out)
    return out


def _with_sql(spark, folder, name):
    """Rows of a query over _half_means, and those of its SQL."""
    from sessionlens.plans import queries

    duckdb = pytest.importorskip("duckdb")
    events = _half_means(spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{events}/*.parquet')")
    cur = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    ours = queries.QUERIES[name](spark, str(folder)).select(*columns).collect()
    key = lambda r: r[0]
    return sorted(map(tuple, ours), key=key), sorted(map(tuple, cur.fetchall()), key=key)


def test_profile_means_are_those_of_their_sql(spark, tmp_path):
    ours, sql = _with_sql(spark, tmp_path, "m16_profiles")
    assert len(ours) == 40 and ours == sql


def test_fetched_profile_means_are_those_of_their_sql(spark, tmp_path):
    ours, sql = _with_sql(spark, tmp_path, "s20_fetched_profiles")
    assert sum(r[3] is not None for r in ours) == 40 and ours == sql


def test_names_are_matched_as_the_service_does(spark):
    from sessionlens.sources import catalog

    rows = [("p", f"{k}", n, s, t) for k, (n, s, t) in enumerate([("nightly 17", "done", "1"), ("nightly 174", "running", "3"), ("smoke", "failed", "2"), ("smoke", "done", "4")])] + [("q", "9", "nightly 17", "running", "1"), ("r", "8", "other", "queued", "5")]
    builds = spark.createDataFrame(rows, "project string, build_id string, name string, status string, created_at string")
    assert {tuple(r) for r in catalog.match_names(builds, ["nightly 17", " smoke ", "OTH", "none", "smoke"]).collect()} == {("nightly 17", "p", "0"), ("smoke", "p", "2"), ("OTH", "r", "8")}
    assert [r[0] for r in catalog.unmatched_names(builds, ["nightly 17", "none"]).collect()] == ["none"]
    with pytest.raises(sessions.IngestionError, match="night"):
        catalog.match_names(builds, ["night"])
    newest = {(r["project"], r["place"]): r["build_id"] for r in catalog.recent_builds(builds, 2).collect()}
    assert newest == {("p", 1): "3", ("p", 2): "2", ("q", 1): "9", ("r", 1): "8"}
    assert [r["project"] for r in catalog.projects_of(builds, " P ").collect()] == ["p"]


def test_a_shuffled_and_replayed_stream_equals_the_batch(spark, tmp_path):
    from sessionlens.operators import risk
    from sessionlens.streaming.incremental import read_stream
    from sessionlens.streaming.running import RunningCounts

    rng = random.Random(3)
    rows = [{"hashed_id": f"s{k}", "name": f"t{k % 5}", "status": rng.choice(["passed", "failed"]), "os": "ios", "os_version": str(k % 2), "device": f"d{k % 3}", "created_at": f"2026-01-{1 + k % 9:02d}T00:00:00Z", "build_hashed_id": f"b{k % 4}"} for k in range(200)]
    (tmp_path / "in").mkdir()
    counts = RunningCounts(spark, str(tmp_path / "counts"))
    for k in range(4):
        part = rng.sample(rows, 120) if k < 3 else rows  # most sessions come several times, and not in order
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        query = counts.start(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "at"), "30 days")
        query.awaitTermination(120)
        assert query.exception() is None and not query.isActive
    batch = sessions.normalize_sessions(spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", sessions.RAW).alias("r")).select("r.*").withColumn("row_id", F.lit(1)))
    assert [tuple(r) for r in counts.device_risk().collect()] == [tuple(r) for r in risk.device_risk(risk.with_dimensions(batch)).collect()]
    builds = spark.createDataFrame([(f"b{k}", "p", f"n{k}", f"2026-01-0{k + 1}") for k in range(4)], "build_id string, project string, name string, created_at string")
    assert [tuple(r) for r in counts.trend(builds, ["p"]).collect()] == [tuple(r) for r in history.suite_health_trend(builds, batch, ["p"]).collect()]
    again = batch.where("build_id = 'b0'")
    before = counts.trend(builds, ["p"]).collect()
    counts.add(again, 99)
    counts.add(again.limit(0), 99)  # a batch that is run again replaces its own counts
    assert counts.trend(builds, ["p"]).collect() == before


def test_whole_run(spark, tmp_path):
    s = sample_sessions(spark, 60, builds=2)
    artifacts = run_triage(s)
    artifacts["trend"] = spark.createDataFrame([("b1", "one", 0.5), ("b2", "two & three", 0.75)], "build_id string, name string, pass_rate double")
    meta = {"name": "run <1>", "project": "alpha", "hashed_id": "b2"}
    parts = report.context(artifacts, meta, True)
    assert parts["flaky_source"] == "in-build" and parts["locator_omitted"] is not None and set(parts["platforms"]) <= {"android", "ios"}
    shown = {name for _, names in report.SECTIONS for name in names}
    assert shown | {"generated_at", "is_sample", "build"} == set(parts)
    page = report.write_html(artifacts, str(tmp_path / "r.html"), "run", meta, is_sample=True).read_text()
    assert "run &lt;1&gt;" in page and "Sample data" in page and "two &amp; three: 75.0%" in page and page.count("<svg") >= 6
    assert artifacts["metrics"].head()["total_tests"] == 120
    for name in ("clusters", "device_risk", "category_details"):
        table = page.split(f"<h3 id='{name}'>")[1].split("</table>")[0]
        assert table.count("<tr>") == artifacts[name].count() + 1  # no row is left out
    plain = report.write_html({}, str(tmp_path / "e.html"), "nothing").read_text()
    assert "Sample data" not in plain and "<svg" not in plain


def test_root_causes_by_category(spark):
    c = spark.createDataFrame([(0, "a", 3, 0.5, ["u"], "x"), (1, "b", 7, 1.0, [], "x"), (2, "c", 7, 1.0, [], None)], "cluster_id int, label string, size int, confidence double, session_urls array<string>, category string")
    got = {r["category"]: [tuple(x) for x in r["root_causes"]] for r in report.root_causes(c).collect()}
    assert got == {"x": [("b", 7, 100, ""), ("a", 3, 50, "u")], "uncategorized": [("c", 7, 100, "")]}

