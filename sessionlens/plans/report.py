"""Artifacts shaped for readers, and a standalone HTML page of them."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import evidence_strength, owner_class
from ..operators.taxonomy import description_of
from ..settings import SETTINGS, Settings


def finding_cards(findings: DataFrame) -> DataFrame:
    """A sentence for each finding, with its figures as a footnote."""
    level = F.col("level")
    upper = F.concat(F.upper(F.left(level, F.lit(1))), F.substring(level, F.lit(2), F.length(level)))
    ratio = F.regexp_replace(F.round("odds_ratio", 1).cast("decimal(30,1)").cast("string"), r"\.0$", "")

    def of(k: int) -> Column:
        out = F.lit(fixed.FINDING_DEFAULT[k])
        for d, words in fixed.FINDING_WORDS.items():
            out = F.when(F.col("dimension") == d, words[k]).otherwise(out)
        return out

    headline = F.replace(F.replace(of(0), F.lit("{level}"), upper), F.lit("{ratio}"), ratio)
    return findings.select(
        headline.alias("headline"), "failures", "sessions", F.round(F.col("failure_rate") * 100).cast("int").alias("rate_pct"), F.round(F.col("baseline_rate") * 100).cast("int").alias("baseline_pct"),
        of(1).alias("comparison"), of(2).alias("so_what"), evidence_strength(F.col("p_value")).alias("strength"), "odds_ratio", "ci_low", "ci_high", "p_value", "confounded_with", "dimension", "level",
    )


def category_details(classified: DataFrame) -> DataFrame:
    """category, owner, count, test_count, tests (busiest first, each with its first device and first address)."""
    first = lambda c: F.min_by(c, "row_id")
    tests = classified.groupBy("category", "owner", F.coalesce(F.nullif("name", F.lit("")), F.lit("(unnamed test)")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), first("device").alias("device"), F.coalesce(F.min_by(F.col("session_url"), F.when(F.col("session_url") != "", F.col("row_id"))), F.lit("")).alias("session_url")
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name", "n", "device", "session_url")))
    out = tests.groupBy("category", "owner").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("test_count"), F.transform(order, lambda x: F.struct(x["name"].alias("name"), x["n"].alias("count"), x["device"].alias("device"), x["session_url"].alias("session_url"))).alias("tests"))
    return out.withColumns({"owner_class": owner_class(F.col("owner")), "description": description_of(F.col("category"))}).orderBy(F.desc("count"), "category")


def root_causes(clusters: DataFrame) -> DataFrame:
    """category, root_causes (largest first) of labelled clusters."""
    cause = F.struct((-F.col("size")).alias("k"), "cluster_id", "label", "size", F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"), F.coalesce(F.try_element_at("session_urls", F.lit(1)), F.lit("")).alias("session_url"))
    listed = F.transform(F.array_sort(F.collect_list(cause)), lambda x: F.struct(x["label"].alias("label"), x["size"].alias("size"), x["confidence_pct"].alias("confidence_pct"), x["session_url"].alias("session_url")))
    return clusters.groupBy(F.coalesce("category", F.lit("uncategorized")).alias("category")).agg(listed.alias("root_causes"))


def area_chart(areas: DataFrame, least: int = 3) -> DataFrame:
    """Areas with enough sessions to show a rate, lowest rate first."""
    return areas.where(F.col("sessions") >= least).orderBy("failure_rate", "feature_area")


def padded_labels(chart: DataFrame) -> DataFrame:
    """chart (few rows) with labels of equal width; no-break spaces, as others would collapse."""
    width = chart.agg(F.max(F.length("label")).alias("width"))
    return chart.join(F.broadcast(width), F.lit(True)).withColumn("label", F.rpad("label", F.col("width"), "\u00a0")).drop("width")


def platform_names(columns: list[str]) -> list[str]:
    """Of an area table's columns those that are platforms."""
    return [c for c in columns if c != "feature_area" and not c.startswith(("n__", "f__"))]


def records(df: DataFrame, limit: int | None = None) -> list[dict]:
    """Rows as dictionaries, NaN as None; for artifacts, which are small."""
    rows = (df.limit(limit) if limit else df).toJSON().collect()
    return [json.loads(r, parse_constant=lambda _: None) for r in rows]


def write_artifacts(artifacts: dict[str, DataFrame], folder: str) -> None:
    """Every artifact as Parquet in a folder of its own."""
    for name, df in artifacts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


STYLE = "body{font:14px sans-serif;margin:2em;max-width:1200px}table{border-collapse:collapse;margin:.5em 0}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left;vertical-align:top}.sample{background:#b45309;color:#fff;padding:.6em;font-weight:bold}.cards span{display:inline-block;border:1px solid #ccc;padding:.5em 1em;margin-right:.5em}svg text{font:11px ui-monospace,monospace}"


def _text(v) -> str:
    if isinstance(v, Row):
        v = v.asDict(recursive=True)
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return html.escape(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str))


def _shade(share: float | None, rgb: tuple[int, int, int]) -> str:
    """From white at 0 to the colour at 1."""
    x = min(max(share or 0.0, 0.0), 1.0)
    return "#" + "".join(f"{round(255 - (255 - c) * x):02x}" for c in rgb)


def bars(title: str, rows: list[tuple[str, float, str, str]]) -> str:
    """Level bars of (label, value, what is written beside it, colour); the whole label shows on hover."""
    if not rows:
        return ""
    most, side = max(r[1] for r in rows) or 1, 8 * min(max(len(r[0]) for r in rows), 58) + 10
    out = [f"<svg width='{side + 560}' height='{22 * len(rows) + 30}'><text x='0' y='14'>{_text(title)}</text>"]
    for k, (label, value, beside, colour) in enumerate(rows):
        y, short = 22 * k + 26, label if len(label) <= 58 else f"{label[:57]}…"
        out.append(f"<g><title>{_text(label)}</title><text x='0' y='{y + 12}'>{_text(short)}</text><rect x='{side}' y='{y}' width='{round(480 * value / most, 1)}' height='16' fill='{colour}' stroke='#999'/><text x='{side + round(480 * value / most, 1) + 4}' y='{y + 12}'>{_text(beside)}</text></g>")
    return "".join([*out, "</svg>"])


def status_ring(passed: int, failed: int) -> str:
    """Passed and failed sessions as parts of a ring."""
    whole, round_ = passed + failed, 2 * math.pi * 60
    if not whole:
        return ""
    part = round_ * failed / whole
    return (
        "<svg width='360' height='180'><text x='0' y='14'>Passed and failed</text><circle cx='90' cy='100' r='60' fill='none' stroke='#16a34a' stroke-width='24'/>"
        f"<circle cx='90' cy='100' r='60' fill='none' stroke='#dc2626' stroke-width='24' stroke-dasharray='{part:.2f} {round_:.2f}' transform='rotate(-90 90 100)'/>"
        f"<text x='180' y='95'>Passed {passed} ({passed / whole:.1%})</text><text x='180' y='115'>Failed {failed} ({failed / whole:.1%})</text></svg>"
    )


def trend_line(rows: list[tuple[str, float]]) -> str:
    """Pass rates (0 to 1) of builds, oldest first; nothing for fewer than two."""
    if len(rows) < 2:
        return ""
    at = [(40 + 640 * k / (len(rows) - 1), 150 - 120 * rate) for k, (_, rate) in enumerate(rows)]
    dots = "".join(f"<circle cx='{x:.1f}' cy='{y:.1f}' r='3' fill='#2563eb'><title>{_text(name)}: {rate:.1%}</title></circle>" for (x, y), (name, rate) in zip(at, rows, strict=True))
    return f"<svg width='720' height='180'><text x='0' y='14'>Pass rate, oldest build to newest</text><text x='0' y='34'>100%</text><text x='0' y='154'>0%</text><polyline fill='none' stroke='#2563eb' stroke-width='2' points='{' '.join(f'{x:.1f},{y:.1f}' for x, y in at)}'/>{dots}</svg>"


def heat_map(title: str, columns: list[str], rows: list[tuple[str, list[float | None]]]) -> str:
    """Rates (0 to 1) by row and column; cells without one stay empty."""
    if not rows:
        return ""
    out = [f"<svg width='{180 + 110 * len(columns)}' height='{24 * len(rows) + 50}'><text x='0' y='14'>{_text(title)}</text>"]
    out += [f"<text x='{184 + 110 * j}' y='34'>{_text(c)}</text>" for j, c in enumerate(columns)]
    for i, (label, values) in enumerate(rows):
        out.append(f"<text x='0' y='{24 * i + 56}'>{_text(label)}</text>")
        out += [f"<rect x='{180 + 110 * j}' y='{24 * i + 40}' width='106' height='22' fill='{_shade(v, (185, 28, 28))}'/><text x='{184 + 110 * j}' y='{24 * i + 56}'>{v:.0%}</text>" for j, v in enumerate(values) if v is not None]
    return "".join([*out, "</svg>"])


def context(artifacts: dict[str, DataFrame], meta: dict, is_sample: bool, settings: Settings = SETTINGS) -> dict:
    """What the page shows, by name: values, charts, and tables as DataFrames that are read when they are written."""
    have = artifacts.get
    few = lambda name: have(name).collect() if have(name) is not None else []  # noqa: E731  of charts and headers only
    head = (few("metrics") or [None])[0]
    flaky, areas = have("flakiness"), have("area_by_platform")
    heat = have("device_heatmap")
    out = {
        "generated_at": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M"), "is_sample": is_sample, "build": meta, "cards": (few("cards") or [None])[0], "top_risk_cell": head["top_risk_cell"] if head else None,
        "status_ring": status_ring(head["passed"], head["failed"]) if head else "", "trend_chart": trend_line([(r["name"] or r["build_id"], r["pass_rate"]) for r in few("trend")]),
        "flaky_rows": flaky.where("flakiness_index > 0").limit(8) if flaky is not None else None, "flaky_source": "history" if flaky is not None and "builds" in flaky.columns else "in-build", "min_builds": settings.flaky_min_builds,
        "cluster_chart": bars("Failure clusters by size (colour: confidence)", [(r["label"].rstrip("\u00a0"), r["failures"], str(r["failures"]), _shade(r["confidence"], (37, 99, 235))) for r in few("cluster_chart")]),
        "clusters": have("clusters"), "category_chart": bars("Failures by category", [(r["category"], r["count"], str(r["count"]), "#6b7280") for r in few("categories")]), "category_rows": have("categories"), "category_details": have("category_details"),
        "findings": have("finding_cards"), "alpha": settings.alpha, "min_group": settings.min_group,
        "device_heatmap": heat_map("Failure rate by device and system", heat.columns[1:], [(r[0], list(r[1:])) for r in few("device_heatmap")]) if heat is not None else "", "device_risk": have("device_risk"),
        "area_chart": bars("Failure rate by area", [(r["feature_area"], r["failure_rate"], f"{r['failure_rate']:.0%} of {r['sessions']}", _shade(r["failure_rate"], (185, 28, 28))) for r in few("area_chart")]), "area_rows": have("area_health"),
        "locator_rows": have("locator_hotspots"), "locator_omitted": None, "duration_rows": have("duration_outliers").limit(6) if have("duration_outliers") is not None else None, "time_split": (few("time_split") or [None])[0],
        "perf_rows": have("perf_hotspots"), "perf_findings": have("performance_vs_failure"), "category_by_os": have("category_by_os"),
        "platform_rows": have("platforms"), "platform_comparability": (few("comparability") or [None])[0], "area_by_platform": areas, "platforms": platform_names(areas.columns) if areas is not None else [],
    }
    if out["locator_rows"] is not None:
        found = out["locator_rows"].select("omitted").head()
        out["locator_omitted"], out["locator_rows"] = found[0] if found else 0, out["locator_rows"].drop("omitted")
    return out


SECTIONS = (
    ("Overview", ("cards", "status_ring", "trend_chart", "top_risk_cell")),
    ("What stands out", ("findings", "alpha", "min_group")),
    ("Root causes", ("cluster_chart", "clusters", "category_chart", "category_rows", "category_details", "category_by_os")),
    ("Locators", ("locator_rows", "locator_omitted")),
    ("Flaky scenarios", ("flaky_source", "min_builds", "flaky_rows")),
    ("Devices and platforms", ("device_heatmap", "device_risk", "platform_rows", "platform_comparability", "platforms", "area_by_platform")),
    ("Areas", ("area_chart", "area_rows")),
    ("Time and performance", ("time_split", "duration_rows", "perf_rows", "perf_findings")),
)


def _table(df: DataFrame) -> Iterator[str]:
    """A table row by row, one partition in memory at a time."""
    yield f"<table><tr>{''.join(f'<th>{_text(c)}</th>' for c in df.columns)}</tr>"
    for r in df.toLocalIterator():
        yield f"<tr>{''.join(f'<td>{_text(v)}</td>' for v in r)}</tr>"
    yield "</table>"


def _page(parts: dict) -> Iterator[str]:
    build = parts["build"]
    title = _text(str(build.get("name") or "report"))
    yield f"<!doctype html><meta charset='utf-8'><title>{title}</title><style>{STYLE}</style><h1>{title}</h1>"
    if parts["is_sample"]:
        yield "<p class='sample'>Sample data: this page shows made-up sessions, not a run of the service.</p>"
    yield f"<p>{' · '.join(f'{_text(k)}: {_text(build[k])}' for k in ('project', 'hashed_id', 'status', 'created_at', 'user_name', 'n_builds') if build.get(k))} · generated {parts['generated_at']}</p>"
    for heading, names in SECTIONS:
        yield f"<h2>{heading}</h2>"
        for name in names:
            x = parts[name]
            if isinstance(x, str) and x.startswith("<svg"):
                yield x
            elif isinstance(x, DataFrame):
                yield f"<h3 id='{name}'>{name.replace('_', ' ')}</h3>"
                yield from _table(x)
            elif isinstance(x, Row):
                yield f"<p class='cards' id='{name}'>{''.join(f'<span>{_text(k)}<br><b>{_text(v)}</b></span>' for k, v in x.asDict().items())}</p>"
            elif x not in (None, "", []):
                yield f"<p id='{name}'>{name.replace('_', ' ')}: {_text(x)}</p>"


def write_html(artifacts: dict[str, DataFrame], path: str, title: str, meta: dict | None = None, is_sample: bool = False, settings: Settings = SETTINGS) -> Path:
    """One page without outside references: every section whole, charts as inline SVG."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w", encoding="utf-8") as f:
        f.writelines(f"{x}\n" for x in _page(context(artifacts, (meta or {}) | {"name": (meta or {}).get("name") or title}, is_sample, settings)))
    return out
