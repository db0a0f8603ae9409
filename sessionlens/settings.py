"""Settings: plain values, read once and passed explicitly."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _words(name: str, default: str) -> tuple[str, ...]:
    return tuple(w.strip().lower() for w in os.environ.get(name, default).split(",") if w.strip())


@dataclass(frozen=True)
class Settings:
    """Thresholds and places; the environment overrides what users change."""

    failure_statuses: tuple[str, ...] = ("failed", "error", "timeout")
    build_statuses: tuple[str, ...] = ("done", "failed", "timeout")
    eps: float = 0.55
    min_samples: int = 2
    package_hints: tuple[str, ...] = field(default_factory=lambda: _words("APP_PACKAGE_HINTS", "gopay,gojek"))
    taxonomy_path: str = field(default_factory=lambda: os.environ.get("FAILURE_TAXONOMY_PATH", "config/taxonomy.json"))
    areas_path: str = field(default_factory=lambda: os.environ.get("FEATURE_AREAS_PATH", "config/feature_areas.json"))
    alpha: float = field(default_factory=lambda: float(os.environ.get("INFERENCE_ALPHA", "0.05")))
    min_group: int = 5
    min_valid_seconds: float = field(default_factory=lambda: float(os.environ.get("MIN_VALID_TEST_SECONDS", "60")))
    device_min_sample: int = 5
    wilson_z: float = 1.96
    flaky_min_runs: int = 5
    flaky_smoothing: float = 4.0
    flaky_min_builds: int = 3
    flaky_build_smoothing: float = 2.0
    history_path: str = field(default_factory=lambda: os.environ.get("HISTORY_DB_PATH", "data/history"))
    sample_history_path: str = "data/history_sample"
    history_window: int = 20
    triage_minutes: float = 12.0
    most_builds: int = 25
    page_size: int = 100
    most_pages: int = 100
    log_sources: tuple[str, ...] = field(default_factory=lambda: _words("LOG_SOURCES", "crash,appium"))
    fetch_workers: int = field(default_factory=lambda: max(1, int(os.environ.get("ENRICH_WORKERS", "8"))))
    log_fetch_chars: int = 200_000
    log_store_chars: int = 8_000
    target_project: str = field(default_factory=lambda: os.environ.get("TARGET_PROJECT", ""))
    target_project_id: str = field(default_factory=lambda: os.environ.get("TARGET_PROJECT_ID", ""))
    profiling: bool = field(default_factory=lambda: os.environ.get("PROFILE", "").lower() in ("1", "true", "yes"))
    username: str = field(default_factory=lambda: os.environ.get("API_USERNAME", ""))
    access_key: str = field(default_factory=lambda: os.environ.get("API_ACCESS_KEY", ""))

    def history_for(self, source: str) -> str:
        """API runs and sample runs keep separate histories."""
        return self.history_path if source == "api" else self.sample_history_path

    @property
    def has_credentials(self) -> bool:
        return bool(self.username and self.access_key)


SETTINGS = Settings()
