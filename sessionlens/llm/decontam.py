"""Benchmark decontamination by pigeonhole edit matching.

An item within `k` edits of a passage shares with it at least one of any k + 1
pieces unchanged.  So every item is cut into its error budget plus one pieces,
an automaton finds all piece hits of a block of items in one pass over a text,
and the passage around each hit is verified with Myers' bit-parallel distance.
Nothing within the budget is missed.

Texts and items are compared as lower-case letters and digits with single spaces
between words.  The budget is `rate` of an item's length (rounded down); an item
too short for any edit has to stand between word borders.  Items without a letter
or digit match nothing, and nor do null or empty texts; texts of any length are
searched whole.  Of several equally near passages the first counts.  Repeated
documents give repeated rows, items listed twice are matched once, no rows give no
rows.  Further columns pass through `clean_documents` whatever their names.

Documents are judged row by row, with or without an id.  They are read once: the
items are dealt to blocks of about `block`, and each block is one step of the same
pass, which adds its hits to those of the steps before.  A step's worker holds one
block, the driver one at a time.
"""

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, spare

RATE = 0.05
BLOCK = 20_000
MEMO = 20_000

_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """Bounds of budget + 1 pieces of nearly equal length."""
    cut = [length * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def pattern_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def best_match(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of text, and where the first such substring ends (Myers, 1999)."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & high:
            score += 1
        if mh & high:
            score -= 1
        ph = ph << 1 & full
        plus = (mh << 1 | ~(xv | ph)) & full
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.memo = [], {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            if clean := normalise(text):
                budget = int(len(clean) * rate)
                if not budget:
                    clean = f" {clean} "
                for a, b in pieces(len(clean), budget):
                    places.setdefault(clean[a:b], []).append((len(self.items), a))
                self.items.append((item, clean, budget, pattern_masks(clean)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalised text) of every item within its budget, the best passage of each."""
        clean = normalise(text)
        if not clean or not self.items:
            return []
        clean = f" {clean} "
        spans: dict[int, list[list[int]]] = {}
        for last, (size, at) in self.automaton.iter(clean):
            for k, offset in at:
                _, item, budget, _ = self.items[k]
                lo = last + 1 - size - offset
                hi = lo + len(item) + budget
                mine = spans.setdefault(k, [])
                if mine and lo - budget <= mine[-1][1]:
                    mine[-1][0] = min(mine[-1][0], lo - budget)
                    mine[-1][1] = max(mine[-1][1], hi)
                else:
                    mine.append([lo - budget, hi])
        out = []
        for k, mine in spans.items():
            item_id, item, budget, masks = self.items[k]
            best, end = budget + 1, 0
            for lo, hi in mine:
                # the spaces around the text are there for items without a budget only
                lo, hi = (max(1, lo), min(hi, len(clean) - 1)) if budget else (max(0, lo), hi)
                passage = clean[lo:hi]
                key = (k, passage)
                if key not in self.memo:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[key] = best_match(masks, len(item), passage)
                d, e = self.memo[key]
                if d < best:
                    best, end = d, lo + e
            if best <= budget:
                out.append((item_id, best, end - 1 if budget else end - 2))
        return out


HITS = "array<struct<item_id:bigint,distance:int,item_chars:int,end_at:bigint>>"
_HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_chars", pa.int32()), ("end_at", pa.int64())])


def with_hits(docs: DataFrame, benchmark: DataFrame, hits: str, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """docs plus `hits`: the items that each row's text holds within the budget.  An item listed twice is matched once."""
    small_batches(docs.sparkSession)
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = max(1, -(-items.count() // block))
    out = docs.withColumn(hits, F.array().cast(HITS))
    for k in range(blocks):
        # a share of a hash, so a block may be a little over `block`
        part = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]

        def run(batches, part=part):
            matcher = Matcher(part, rate)
            length = {item: len(clean.strip()) for item, clean, _, _ in matcher.items}
            for batch in batches:
                at = batch.schema.get_field_index(hits)
                found = batch.column(at).to_pylist()
                for row, text in enumerate(batch.column("text").to_pylist()):
                    found[row] += [{"item_id": i, "distance": d, "item_chars": length[i], "end_at": e} for i, d, e in matcher.find(text)]
                columns = list(batch.columns)
                columns[at] = pa.array(found, pa.list_(_HIT))
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, item_chars, end_at: every pair of a document and an item that it holds within the budget.

    Repeated documents give repeated rows; an item listed twice is matched once a text.
    """
    found = with_hits(docs.select("doc_id", "text"), benchmark, "hits", rate, block)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no benchmark item; each row is judged by its own text."""
    name = spare("hits", docs.columns)
    return with_hits(docs, benchmark, name, rate).where(F.size(name) == 0).drop(name)
