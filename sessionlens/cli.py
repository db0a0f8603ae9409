"""Command line: ingest a run, store it, analyse it, write the report."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from .functions.text import owner_of_build
from .operators.profiling import with_profiles
from .plans.report import write_artifacts, write_html
from .plans.triage import run_triage
from .session import build_session
from .settings import SETTINGS
from .sources.api import HttpTransport, Service, as_project_list, fetch_logs, fetch_profiles, land_builds
from .sources.history import History, project_names, recent_sessions, suite_health_trend
from .sources.logs import enrich
from .sources.sessions import IngestionError, order_rows, read_document, window_meta


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sessionlens", description=__doc__)
    p.add_argument("--user")
    p.add_argument("--project", action="append", help="once for each project; all if left out with --build")
    p.add_argument("--source", choices=("file", "api"), default="file")
    p.add_argument("--mode", choices=("latest", "range"), default="latest")
    p.add_argument("--last", type=int, default=10, help="builds of a range")
    p.add_argument("--build", action="append", help="name, or a part of it that fits one build")
    p.add_argument("--mock-path", default="data/sessions.json")
    p.add_argument("--output", default="output/report.html")
    p.add_argument("--api-base", default=os.environ.get("API_BASE", ""))
    p.add_argument("--enrich-logs", action="store_true")
    p.add_argument("--profile", action="store_true", help="fetch performance figures of every session")
    p.add_argument("--verbose", action="store_true")
    return p


def _from_api(spark, args, get, folder: str) -> tuple[DataFrame, dict, list[tuple[str, dict]]]:
    """(sessions, header, builds): what the service has is written to the folder once and read from there."""
    service = Service(get)
    if args.build:
        builds = service.resolve_builds(args.project, args.build)
    else:
        n = args.last if args.mode == "range" else 1
        builds = [(name, b) for name, pid in service.to_search(args.project) for b in service.recent_builds(pid, n)]
    sessions, builds = land_builds(spark, get, builds, f"{folder}/sessions")
    kept = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.schema(df.schema).parquet(f"{folder}/{name}"))[1]
    if args.enrich_logs:
        sessions = enrich(sessions, kept(fetch_logs(get, sessions.where("is_failure")), "logs"))
    if args.profile or SETTINGS.profiling:
        sessions = with_profiles(sessions, kept(fetch_profiles(get, sessions), "profiles"))
    names = sorted({p for p, _ in builds})
    if len(builds) > 1:
        return sessions, window_meta(sessions, names, args.user), builds
    meta = builds[0][1] | {"project": names[0]}
    return sessions, meta | {"user_name": args.user or owner_of_build(str(meta.get("name") or ""))}, builds


def main(argv: list[str] | None = None, transport: Callable | None = None) -> int:
    """transport: stands in for the service, as in tests."""
    args = build_parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    args.project = [n for p in args.project or () for n in as_project_list(p)]
    spark = build_session()
    history = History(spark, SETTINGS.history_for(args.source))
    try:
        if args.source == "api":
            get = transport or HttpTransport(args.api_base, SETTINGS.username, SETTINGS.access_key)
            sessions, meta, builds = _from_api(spark, args, get, f"{history.path}/landing/{uuid.uuid4().hex}")
            history.persist_builds(builds, sessions)
        elif args.mode == "range":
            names = args.project or sorted({r[0] for r in history.read("builds").select("project").distinct().collect()})
            sessions = order_rows(recent_sessions(history.read("builds"), history.read("sessions"), names, args.last))
            if not sessions.head(1):
                raise IngestionError("the history is empty")
            meta = window_meta(sessions, names, args.user)
        else:
            sessions, build = read_document(spark, args.mock_path)
            meta = build.head().asDict()
            history.persist_build(meta, sessions)
    except IngestionError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    names = project_names(meta.get("project"))
    past = sessions if meta.get("is_range") else order_rows(recent_sessions(history.read("builds"), history.read("sessions"), names))
    artifacts = run_triage(sessions, past)
    artifacts["trend"] = suite_health_trend(history.read("builds"), history.read("sessions"), names)
    write_artifacts(artifacts, f"{os.path.splitext(args.output)[0]}_artifacts")
    print(json.dumps({"report": str(write_html(artifacts, args.output, "report", meta, is_sample=args.source == "file")), "artifacts": sorted(artifacts)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
