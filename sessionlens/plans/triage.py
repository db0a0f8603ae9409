"""The whole analysis of a run: every artifact as a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, flakiness, inference, metrics, risk, taxonomy
from ..operators.graph import kept
from ..settings import SETTINGS, Settings
from . import report


def run_triage(sessions: DataFrame, history: DataFrame | None = None, settings: Settings = SETTINGS) -> dict[str, DataFrame]:
    """Artifacts by name.  `sessions` needs row_id: what comes first."""
    sessions = kept(risk.with_dimensions(sessions))  # all artifacts read it
    platforms = sorted(r[0] for r in sessions.where("platform is not null").select("platform").distinct().collect())
    classified = kept(taxonomy.classify_failures(sessions))  # most artifacts read it
    groups, failures = clusters.cluster_failures(sessions, settings)
    labelled = groups.join(clusters.label_clusters(failures, classified), "cluster_id", "left").orderBy(F.desc("size"), "cluster_id")
    cells = risk.device_risk(sessions, settings)
    out = {
        "clusters": labelled, "failures": failures, "classified": classified, "categories": taxonomy.category_counts(classified), "locator_hotspots": taxonomy.locator_hotspots(classified),
        "device_risk": cells, "area_health": risk.area_health(sessions), "platforms": risk.platform_breakdown(sessions), "area_by_platform": risk.area_by_platform(sessions, platforms, settings),
        "comparability": risk.platform_comparability(sessions), "flakiness": flakiness.flakiness_index(sessions, history, settings), "findings": inference.significant_findings(sessions, settings=settings),
        "category_by_os": inference.category_by_dimension(classified), "duration_outliers": inference.duration_outliers(sessions, settings=settings), "time_split": inference.time_split(sessions),
        "metrics": metrics.exec_metrics(sessions, groups, cells, settings),
    }
    out["cards"] = metrics.summary_cards(out["metrics"])
    out["finding_cards"] = report.finding_cards(out["findings"])
    out["category_details"] = report.category_details(classified).join(report.root_causes(labelled), "category", "left").orderBy(F.desc("count"), "category")
    out["cluster_chart"] = report.padded_labels(clusters.chart_rows(groups))
    out["area_chart"] = report.area_chart(out["area_health"])
    out["device_heatmap"] = risk.device_heatmap(cells, sorted(r[0] for r in cells.select("os_label").distinct().collect()))
    if "app_cpu_mean" in sessions.columns:
        out["perf_hotspots"] = risk.perf_hotspots(sessions)
        out["performance_vs_failure"] = inference.performance_vs_failure(sessions, settings=settings)
    return out
