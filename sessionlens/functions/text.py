"""Text functions as Column expressions; no Python runs on the executors.

Patterns carry Unicode classes and Unix line ends so that they search alike in
every engine; null input counts as empty.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..settings import SETTINGS, Settings


def rx(pattern: str, flags: str = "") -> str:
    """The pattern with Unicode classes; flags of i (any case) and m (lines)."""
    return f"(?dU{flags}{'u' if 'i' in flags else ''})" + pattern


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def or_default(c: Column, default: str) -> Column:
    """Null and empty both give the default."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_of(c), rx(r"^\s+|\s+\z"), "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), rx(r"\s+"), " "))


def lines(c: Column) -> Column:
    parts = F.split(text_of(c), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def first_line(c: Column) -> Column:
    return F.coalesce(F.try_element_at(lines(strip(c)), F.lit(1)), F.lit(""))


def strip_token(url: Column) -> Column:
    """The address without query and fragment."""
    return F.regexp_replace(text_of(url), r"(?s)[?#].*$", "")


def owner_from_build_name(name: Column) -> Column:
    head = strip(F.element_at(F.split(text_of(name), " triggered", 2), 1))
    return F.when((F.length(head) <= 40) & ~head.contains(" "), head).otherwise("")


def owner_of_build(name: str) -> str:
    """As owner_from_build_name, of one name on the driver."""
    head = name.split(" triggered", 1)[0].strip()
    return head if len(head) <= 40 and " " not in head else ""


def strip_log_prefix(line: Column) -> Column:
    return strip(F.regexp_replace(text_of(line), rx(fixed.LOG_PREFIX), ""))


def mask(reason: Column) -> Column:
    """Volatile tokens replaced by their kind."""
    out = text_of(reason)
    for pattern, word in fixed.MASKS:
        out = F.regexp_replace(out, rx(pattern), word)
    return F.trim(out)


def normalize(reason: Column) -> Column:
    return F.lower(mask(reason))


def has_error(text: Column) -> Column:
    return text_of(text).rlike(rx(fixed.HAS_ERROR, "i"))


def exception_type(reason: Column) -> Column:
    return F.regexp_extract(text_of(reason), rx(fixed.EXCEPTION), 1)


def root_exception(reason: Column) -> Column:
    """The class after the last "Caused by:", else the first one named."""
    causes = F.regexp_extract_all(text_of(reason), F.lit(rx(fixed.CAUSED_BY)), F.lit(1))
    return F.coalesce(F.try_element_at(causes, F.lit(-1)), exception_type(reason))


def _frames(reason: Column) -> Column:
    paths = F.regexp_extract_all(text_of(reason), F.lit(rx(fixed.FRAME)), F.lit(1))
    methods = F.regexp_extract_all(text_of(reason), F.lit(rx(fixed.FRAME)), F.lit(2))
    return F.zip_with(paths, methods, lambda p, m: F.struct(F.lower(p).alias("path"), F.concat(F.substring_index(p, ".", -1), F.lit("."), m).alias("label")))


def app_frame(reason: Column, hints: tuple[str, ...] = SETTINGS.package_hints) -> Column:
    """The first frame whose class path holds a hint, as Class.method; else empty."""

    def ours(f: Column) -> Column:
        out = F.lit(False)
        for h in hints:
            out = out | f["path"].contains(h)
        return out

    return F.coalesce(F.try_element_at(F.filter(_frames(reason), ours), F.lit(1))["label"], F.lit(""))


def top_frame(reason: Column, hints: tuple[str, ...] = SETTINGS.package_hints) -> Column:
    """As app_frame, with the first frame of any kind as a fallback."""
    first = F.coalesce(F.try_element_at(_frames(reason), F.lit(1))["label"], F.lit(""))
    return F.coalesce(F.nullif(app_frame(reason, hints), F.lit("")), first)


def message_signature(reason: Column, words: int = 8, most: int = 64) -> Column:
    """A template of the first line's message: tokens masked, eight words, ragged ends trimmed."""
    line = strip_log_prefix(first_line(reason))
    after = F.regexp_extract(line, rx(fixed.AFTER_CLASS), 1)
    body = F.when(after != "", after).otherwise(F.regexp_replace(line, rx(fixed.LEADING_CLASS), ""))
    cut = F.left(F.array_join(F.slice(F.split(mask(body), " "), 1, words), " "), F.lit(most))
    return strip(F.regexp_replace(cut, r"[ (\[{:,\-]+$", ""))


def fingerprint(reason: Column, hints: tuple[str, ...] = SETTINGS.package_hints) -> Column:
    exc, frame, sig = root_exception(reason), app_frame(reason, hints), message_signature(reason)
    return F.when(exc == "", "").when(frame != "", F.concat(exc, F.lit(" @ "), frame)).when(sig != "", F.concat(exc, F.lit(": "), sig)).otherwise(exc)


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def cluster_label(reason: Column, most: int = 100) -> Column:
    first = or_default(strip_log_prefix(first_line(reason)), "Unknown failure")
    exc = exception_type(reason)
    return ellipsis(F.when((exc != "") & ~F.lower(first).contains(F.lower(exc)), F.concat(exc, F.lit(": "), first)).otherwise(first), most)


def split_camel(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")


def load_areas(settings: Settings = SETTINGS) -> list[tuple[str, str]]:
    """Areas of the file, if there is a good one, before the fixed ones."""
    try:
        own = [(a, p) for a, p in json.loads(Path(settings.areas_path).read_text(encoding="utf-8")).get("feature_areas", [])]
    except (OSError, ValueError, AttributeError):
        own = []
    return [*own, *fixed.FEATURE_AREAS]


def feature_area(name: Column, areas: list[tuple[str, str]] | None = None) -> Column:
    words = split_camel(name)
    out = F.when(words == "", "unmapped")
    for area, pattern in areas or load_areas():
        out = out.when(words.rlike(rx(pattern, "i")), area)
    return out.otherwise("unmapped")


def os_label(platform: Column, version: Column) -> Column:
    v = strip(version)
    v = F.when(F.lower(v) == "unknown", "").otherwise(v)
    p = F.lower(strip(platform))
    family = F.lit("")
    for key, label in fixed.PLATFORM_LABELS.items():
        family = F.when(p == key, label).otherwise(family)
    return F.when(family == "", or_default(v, "unknown")).otherwise(F.trim(F.concat(family, F.lit(" "), v)))


def _unescape(text: Column) -> Column:
    return F.replace(F.replace(text_of(text), F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))


def trim_delimiters(value: Column) -> Column:
    """Quotes and brackets off the ends; a closing bracket that has its opening one stays."""
    bare = F.regexp_replace(strip(value), r"^['\"\[\]{},:; \\]+|['\"\[\]{},:; \\]+$", "")

    def count(c: Column, ch: str) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))

    def step(acc: Column, _: Column) -> Column:
        loose = F.lit(False)
        for a, b in ("()", "[]", "{}"):
            loose = loose | (F.right(acc, F.lit(1)) == b) & (count(acc, b) > count(acc, a))
        return F.when(loose, F.left(acc, F.length(acc) - 1)).otherwise(acc)

    # a fold, so that the expression stays as small as one step; no more steps than closing brackets at the end
    ends = F.length(F.regexp_extract(bare, r"[)\]}]*$", 0))
    return strip(F.aggregate(F.sequence(F.lit(0), ends), bare, step))


def extract_locator(text: Column, most: int = 70) -> Column:
    """The label, text or id that a failure looked for; the first that isn't a mere identifier."""
    plain = _unescape(text)
    found = F.concat(*(F.regexp_extract_all(plain, F.lit(rx(p)), F.lit(1)) for p in fixed.LOCATORS))
    values = F.transform(found, lambda v: trim_delimiters(squeeze(v)))
    good = F.filter(values, lambda v: (F.length(v) >= 2) & ~v.rlike(rx(fixed.LOCATOR_REJECT, "i")))
    return F.left(F.coalesce(F.try_element_at(good, F.lit(1)), F.lit("")), F.lit(most))


def extract_selector(text: Column, most: int = 300) -> Column:
    """The whole selector as written."""

    def clean(c: Column) -> Column:
        return F.regexp_replace(squeeze(c), r"[,;]+$", "")

    def long(c: Column) -> Column:
        return F.when(F.length(c) >= 4, F.left(c, F.lit(most)))

    plain = _unescape(text)
    out = [long(_unescape(clean(F.regexp_extract(text_of(text), rx(fixed.JSON_SELECTOR), 1))))]
    for p in fixed.SELECTORS:
        out.append(long(clean(F.regexp_extract(plain, rx(p), 1))))
    return F.coalesce(*out, F.lit(""))


def extract_screen(text: Column) -> Column:
    return F.regexp_extract(text_of(text), rx(fixed.SCREEN), 1)


def extract_error(log: Column, context: int = 6, most: int = 2000) -> Column:
    """The last line with the most specific signal and what follows; else the last lines."""
    full = F.filter(lines(log), lambda x: strip(x) != "")
    quiet = F.filter(full, lambda x: ~x.rlike(rx(fixed.LOG_NOISE, "im")))
    kept = F.when(F.size(quiet) > 0, quiet).otherwise(full)
    at = []
    for p in fixed.ERROR_SIGNALS:
        at.append(F.array_max(_hits(kept, rx(p, "i"))))
    start = F.coalesce(*at, F.greatest(F.size(kept) - context + 1, F.lit(1)))
    return F.left(F.array_join(F.slice(kept, start, F.lit(context)), "\n"), F.lit(most))


def _hits(parts: Column, pattern: str) -> Column:
    return F.transform(parts, lambda x, i: F.when(x.rlike(pattern), i + 1))


def looks_like_crash(text: Column) -> Column:
    t = strip(text)
    out = F.length(t) >= 20
    for w in fixed.CRASH_PLACEHOLDERS:
        out = out & ~F.lower(t).contains(w)
    return out


def looks_corrupted(reason: Column) -> Column:
    """A log dump that tells no error."""
    marked = F.lit(False)
    for m in fixed.LOG_DUMP_MARKERS:
        marked = marked | text_of(reason).contains(m)
    return ~has_error(reason) & marked


def evidence_strength(p: Column) -> Column:
    return F.when(p < 0.001, "very strong evidence").when(p < 0.01, "strong evidence").otherwise("moderate evidence")


def owner_class(owner: Column) -> Column:
    out = F.lit("own-test")
    for name, css in fixed.OWNER_CLASS.items():
        out = F.when(owner == name, css).otherwise(out)
    return out
