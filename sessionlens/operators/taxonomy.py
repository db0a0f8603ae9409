"""Ordered rules that name a failure's category and owner."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.literals import LiteralIndex
from ..functions.text import extract_locator, extract_screen, extract_selector, has_error, rx, text_of
from ..settings import SETTINGS, Settings


@dataclass(frozen=True)
class Rule:
    """A pattern hit decides; else, unless an exclusion hits, status or a short duration does."""

    category: str
    owner: str
    description: str = ""
    patterns: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    max_seconds: float | None = None

    def matches(self, text: Column, found: Column, index: LiteralIndex, duration: Column, status: Column) -> Column:
        """found: the literals of `index` that the text holds."""

        def any_of(patterns):
            out = F.lit(False)
            for p in patterns:
                out = out | (index.may_match(found, [p]) & text.rlike(rx(p, "i")))
            return index.may_match(found, list(patterns)) & out

        weak = F.lit(False)
        if self.statuses:
            weak = weak | F.lower(status).isin(*self.statuses)
        if self.max_seconds is not None:
            weak = weak | ((duration > 0) & (duration <= self.max_seconds))
        if self.excludes:
            weak = weak & ~any_of(self.excludes)
        return (any_of(self.patterns) | weak) if self.patterns else weak


def index_of(rules: list[Rule]) -> LiteralIndex:
    return LiteralIndex([p for r in rules for p in (*r.patterns, *r.excludes)])


def default_rules(settings: Settings = SETTINGS) -> list[Rule]:
    rules = [Rule(c, o, d, p) for c, o, d, p in fixed.TAXONOMY]
    last = rules.pop()
    return [*rules, Rule(last.category, last.owner, last.description, last.patterns, fixed.DID_NOT_RUN_EXCLUDES, fixed.DID_NOT_RUN_STATUSES, settings.min_valid_seconds)]


def load_rules(settings: Settings = SETTINGS) -> list[Rule]:
    """Rules of the file, if there is a good one, before the default ones."""
    try:
        own = [
            Rule(r["category"], r.get("owner", "Unassigned"), r.get("description", ""), tuple(r.get("patterns", ())), tuple(r.get("exclude_patterns", ())), tuple(s.lower() for s in r.get("statuses", ())), r.get("max_duration_seconds"))
            for r in json.loads(Path(settings.taxonomy_path).read_text(encoding="utf-8")).get("rules", [])
        ]
    except (OSError, ValueError, KeyError, AttributeError):
        own = []
    return [*own, *default_rules(settings)]


def classify(reason: Column, log_text: Column, duration: Column, status: Column, rules: list[Rule] | None = None) -> Column:
    """The category as one CASE over the rules; only patterns whose literals the text holds are run."""
    rules = rules or load_rules()
    index = index_of(rules)
    joined = F.concat(text_of(reason), F.lit("\n"), text_of(log_text))

    def of(x: Column) -> Column:
        text, found, out = x["text"], x["found"], None
        for r in rules:
            hit = F.coalesce(r.matches(text, found, index, x["duration"], x["status"]), F.lit(False))
            out = F.when(hit, r.category) if out is None else out.when(hit, r.category)
        return out.when(~has_error(text), fixed.NO_DIAGNOSTICS[0]).otherwise(fixed.UNCATEGORIZED[0])

    # text and literals are made once a row
    known = F.struct(joined.alias("text"), index.found(joined).alias("found"), F.coalesce(duration, F.lit(0.0)).alias("duration"), text_of(status).alias("status"))
    return F.get(F.transform(F.array(known), of), F.lit(0))


def _known(rules: list[Rule] | None) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for r in [*(rules or load_rules()), Rule(*fixed.NO_DIAGNOSTICS), Rule(*fixed.UNCATEGORIZED)]:
        out.setdefault(r.category, (r.owner, r.description))
    return out


def owner_of(category: Column, rules: list[Rule] | None = None) -> Column:
    out = F.lit("Unassigned")
    for c, (owner, _) in _known(rules).items():
        out = F.when(category == c, owner).otherwise(out)
    return out


def description_of(category: Column, rules: list[Rule] | None = None) -> Column:
    out = F.lit(fixed.UNCATEGORIZED[2])
    for c, (_, text) in _known(rules).items():
        out = F.when(category == c, text).otherwise(out)
    return out


def classify_failures(sessions: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The failures with category, owner, locator, selector, screen."""
    both = F.concat(text_of(F.col("reason")), F.lit("\n"), text_of(F.col("log_text")))
    out = sessions.where("is_failure").withColumn("category", classify(F.col("reason"), F.col("log_text"), F.col("duration"), F.col("status"), rules))
    return out.withColumns({"owner": owner_of(F.col("category"), rules), "locator": extract_locator(both), "selector": extract_selector(both), "screen": extract_screen(both)})


def category_counts(classified: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """category, owner, count, description; the busiest first."""
    out = classified.groupBy("category", "owner").agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("description", description_of(F.col("category"), rules)).orderBy(F.desc("count"), "category")


def locator_hotspots(classified: DataFrame, top: int = 6, min_tests: int = 2) -> DataFrame:
    """Locators that break several tests, widest first; `omitted` counts those left out for breaking too few."""
    hits = classified.where(F.length("locator") > 1)
    out = hits.groupBy("locator").agg(
        F.count("session_id").alias("failures"),
        F.countDistinct("name").alias("tests_affected"),
        F.countDistinct("device").alias("devices"),
        F.min_by("name", "row_id").alias("example_test"),
        F.coalesce(F.min(F.struct(-F.length("selector"), "selector"))["selector"], F.lit("")).alias("selector"),
    )
    omitted = out.agg(F.count_if(F.col("tests_affected") < min_tests).alias("omitted"))
    best = out.where(F.col("tests_affected") >= min_tests).orderBy(F.desc("tests_affected"), F.desc("failures"), "locator").limit(top)
    return best.join(F.broadcast(omitted), F.lit(True))  # one row
