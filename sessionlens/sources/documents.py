"""JSON documents of any size: the objects of one top-level array, read by byte ranges.

A reader of whole documents gives each to one task.  Here the text source cuts a
document after closing braces, so its splits go to many tasks.  Whether a split begins
inside a string, and how deep, follows from the splits before it: each split tells
what it does to either case, and a short walk over these summaries on the driver, one
row a split, settles all beginnings.  A second pass counts the objects that begin in
each split, a third gives them out; objects across a border come as parts, and
only those are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "}"
_MARK = re.compile(r'"|\\.|[{}\[\]]', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$')


def _rows(batches) -> Iterator[tuple[str, int, str]]:
    """file, start of the split, text up to and with the next closing brace."""
    for batch in batches:
        yield from zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), (v + END for v in batch.column("value").to_pylist()), strict=True)


def _effect(text: str, inside: bool) -> tuple[bool, int, int]:
    """(inside a string at the end, change of brace depth, change of bracket depth)."""
    braces = brackets = 0
    for m in _MARK.finditer(text):
        c = m[0]
        if c == '"':
            inside = not inside
        elif not inside:
            braces += (c == "{") - (c == "}")
            brackets += (c == "[") - (c == "]")
    return inside, braces, brackets


class _Walk:
    """The objects of top-level arrays in the rows of one split, from a known beginning."""

    def __init__(self, state: tuple[bool, int, int]):
        self.inside, self.braces, self.brackets = state
        self.label: str | None = None  # of the array, once one has begun in this split
        self.open = self.braces > 1 and self.brackets >= 1
        self.begun_here = False
        self.text: list[str] = []

    def row(self, text: str) -> Iterator[tuple[str | None, bool, str]]:
        """(label, whether it began here, its text here) of each object that ends in this row."""
        start = 0 if self.open else None
        for m in _MARK.finditer(text):
            c = m[0]
            if c == '"':
                self.inside = not self.inside
            elif self.inside or c[0] == "\\":
                continue
            elif c == "{":
                if self.braces == 1 and self.brackets == 1:
                    self.open, self.begun_here, start = True, True, m.start()
                self.braces += 1
            elif c == "}":
                self.braces = max(self.braces - 1, 0)  # the text after the last brace got one too many
                if self.open and self.braces == 1 and self.brackets == 1:
                    self.text.append(text[start : m.end()])
                    yield self.label, self.begun_here, "".join(self.text)
                    self.open, start, self.text = False, None, []
            elif c == "[":
                if self.braces == 1 and self.brackets == 0:
                    key = _KEY.search(text[: m.start()])
                    self.label = key[1] if key else ""
                self.brackets += 1
            else:
                self.brackets -= 1
        if self.open:
            self.text.append(text[start:])


def _walked(batches, states: dict) -> Iterator[tuple[str, int, str | None, bool, bool, str]]:
    """file, start, label, begun here, ended here, text of all objects and parts of objects."""
    at, walk = None, None
    for file, start, text in _rows(batches):
        if (file, start) != at:
            if walk and walk.open:
                yield *at, walk.label, walk.begun_here, False, "".join(walk.text)
            at, walk = (file, start), _Walk(states[file, start])
        for label, begun, found in walk.row(text):
            yield file, start, label, begun, True, found
    if walk and walk.open:
        yield *at, walk.label, walk.begun_here, False, "".join(walk.text)


def array_objects(spark: SparkSession, path: str, key: str) -> DataFrame:
    """file, at (from 0 in each file), value: the objects of the array `key` of every document under the path, as JSON text."""
    lines = spark.read.option("lineSep", END).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def effects(batches):
        at, now = None, None
        out = []
        for file, start, text in _rows(batches):
            if (file, start) != at:
                if now:
                    out.append((*at, *now[0], *now[1]))
                at, now = (file, start), [(False, 0, 0), (True, 0, 0)]
            now = [(e[0], s[1] + e[1], s[2] + e[2]) for s in now for e in (_effect(text, s[0]),)]
        if now:
            out.append((*at, *now[0], *now[1]))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["file", "start", "a0", "a1", "a2", "b0", "b1", "b2"])

    summary = lines.mapInArrow(effects, "file string, start long, a0 boolean, a1 long, a2 long, b0 boolean, b1 long, b2 long").collect()  # a row a split
    states, last, state = {}, None, (False, 0, 0)
    for r in sorted(summary, key=lambda r: (r["file"], r["start"])):
        if r["file"] != last:
            last, state = r["file"], (False, 0, 0)
        states[r["file"], r["start"]] = state
        side = "b" if state[0] else "a"
        state = (r[f"{side}0"], state[1] + r[f"{side}1"], state[2] + r[f"{side}2"])
    states = spark.sparkContext.broadcast(states)

    def counts(batches):
        out: dict = {}
        for file, start, label, begun, _, _ in _walked(batches, states.value):
            n = out.setdefault((file, start), [0, 0, None])
            n[0] += begun and label is None
            n[1] += begun and label == key
            n[2] = label if label is not None else n[2]
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int64()), *(pa.array([v[j] for v in out.values()], t) for j, t in enumerate(kinds))], ["file", "start", "old", "new", "label"])

    bases, last, label, n = {}, None, None, 0
    got = {(r["file"], r["start"]): r for r in lines.mapInArrow(counts, "file string, start long, old long, new long, label string").collect()}  # a row a split
    for file, start in sorted(states.value):
        if file != last:
            last, label, n = file, None, 0
        bases[file, start] = (n, label == key)
        if r := got.get((file, start)):
            n += (r["old"] if label == key else 0) + r["new"]
            label = r["label"] if r["label"] is not None else label
    bases = spark.sparkContext.broadcast(bases)

    def objects(batches):
        at, n, mine, out = None, 0, False, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["file", "start", "at", "whole", "value"])

        for file, start, label, begun, ended, text in _walked(batches, states.value):
            if (file, start) != at:
                at, (n, mine) = (file, start), bases.value[file, start]
            if not (mine if label is None else label == key):
                continue
            out.append((file, start, n if begun else n - 1, begun and ended, text))
            n += begun
            if len(out) >= 1000:
                yield made()
                out = []
        yield made()

    rows = lines.mapInArrow(objects, "file string, start long, at long, whole boolean, value string")
    whole = rows.where("whole").select("file", "at", "value")
    parts = rows.where("not whole").groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "").alias("value"))
    return whole.unionByName(parts)
