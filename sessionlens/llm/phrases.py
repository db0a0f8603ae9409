"""Phrase collocations by hashed counting (PCY/DHP) with Apriori pruning.

Pass k over the texts counts phrases of k words exactly, and at the same time adds
the phrases of k + 1 words up in hash buckets.  Buckets that reach the least count,
and the phrases of k words that do, become two bitmaps of fixed size.  They are all
that the next pass gets: it counts a phrase only if its bucket and both its parts
of k words are in them.  A bit set for another phrase costs a count, never a result:
what is counted is counted by its words, and what stays has reached the least count.

Tasks count by word numbers within a block of texts, so blocks meet nothing by hash;
Spark adds the blocks up.  Bucket counts stop at the least count in one byte, as no
more is asked of them, and are added up by ranges of buckets.

Cutting a phrase gives its score; the counts of both parts come from joins with the
frequent phrases, to which every part of a frequent phrase belongs.  A phrase is
dropped for a longer one that has nearly all of its occurrences; among those one
word longer is always the most frequent, so no others need comparing.

All is per language, a null one being `und`.  Null and empty texts have no words;
texts of any length are read whole; phrases never cross texts or pieces.  Repeated
rows count again.  Equal scores rank by count, then by phrase in byte order.  No rows
give no rows.  Only lang and text are read, so other columns may have any name.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import blocks
from .store import discard, saved, saved_at, small_batches
from .text import LOWER, U64, mix64, span_hashes, utf8_chunks

LONGEST, LEAST, TOP = 4, 30, 2000
BITS, RANGE_BITS = 24, 14
BLOCK = 8 << 20
SALTS = 64
WORD, BLANK, BREAK = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK


def _unit_hashes(word, lang):
    return mix64(word ^ mix64(lang + U64(0x51)))


def _phrase_hashes(units: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k units from each place of `at` on."""
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = out * U64(0x9FB21C651E98DF25) + units[at + j]
    return mix64(out)


def _strings_hashed(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return span_hashes(data, offsets[:-1], offsets[1:])


class Bitmap:
    def __init__(self, packed: bytes):
        self.packed = np.frombuffer(packed, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> U64(64 - BITS)).astype(np.int64)
        return self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


class Words:
    """The words of a block of texts as numbers of (language, word), and which of them follow one another in a piece."""

    def __init__(self, langs: pa.Array, buf: np.ndarray, offsets: np.ndarray):
        buf = LOWER[buf]
        kind = _KIND[buf]
        word = kind == WORD
        filled = offsets[:-1] < offsets[1:]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        first[heads], last[tails] = word[heads], word[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        per_row = np.diff(np.searchsorted(starts, offsets))
        row = np.repeat(np.arange(len(offsets) - 1), per_row)
        piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
        self.joined = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buf[word])]).dictionary_encode()
        langs = langs.dictionary_encode()
        self.words, self.langs = words.dictionary, langs.dictionary
        size = max(len(self.words), 1)
        both, unit = np.unique(langs.indices.to_numpy().astype(np.int64)[row] * size + words.indices.to_numpy(), return_inverse=True)
        self.unit, self.unit_word, self.unit_lang = unit, both % size, both // size
        self.hashes = _unit_hashes(_strings_hashed(self.words)[self.unit_word], _strings_hashed(self.langs)[self.unit_lang])[unit] if len(unit) else np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Where phrases of k words begin."""
        n = len(self.unit) - k + 1
        whole = np.ones(max(n, 0), bool)
        for j in range(k - 1):
            whole &= self.joined[j : j + len(whole)]
        return np.flatnonzero(whole)

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """lang, phrase and count of the distinct phrases that begin at the places `at`."""
        ids, units = self.unit[at], len(self.unit_word)
        for j in range(1, k):
            if j > 1:  # numbers stay below the number of words
                _, ids = np.unique(ids, return_inverse=True)
            ids = ids * units + self.unit[at + j]
        _, one, n = np.unique(ids, return_index=True, return_counts=True)
        at = at[one]
        parts = [self.words.take(pa.array(self.unit_word[self.unit[at + j]])) for j in range(k)]
        return self.langs.take(pa.array(self.unit_lang[self.unit[at]])), pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], pa.array(n)


_ROWS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("range", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
_RANGES = "range int, places binary, counts binary"


def _as_ranges(counts: np.ndarray):
    """(range, places, counts) of the buckets that aren't empty, by ranges of buckets."""
    at = np.flatnonzero(counts)
    cut = np.searchsorted(at, np.arange(0, len(counts) + 1, 1 << RANGE_BITS))
    for k in np.flatnonzero(np.diff(cut)):
        own = at[cut[k] : cut[k + 1]]
        yield int(k), (own & (1 << RANGE_BITS) - 1).astype("<u2").tobytes(), counts[own].tobytes()


def _added(counts: np.ndarray, at: np.ndarray, n: np.ndarray, least: int) -> None:
    counts[at] = np.minimum(counts[at].astype(np.int64) + n, least)


def _bitmap(rows: DataFrame, least: int) -> bytes:
    """The bits of buckets that reach `least` in rows (range, places, counts): 2 ** BITS of them, whatever the input."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "places", "counts")), strict=True):
                own = sums.setdefault(k, np.zeros(1 << RANGE_BITS, np.uint8))
                _added(own, np.frombuffer(places, "<u2"), np.frombuffer(counts, np.uint8), least)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())], ["range", "bits"])

    packed = np.zeros(1 << BITS - 3, np.uint8)
    size = 1 << RANGE_BITS - 3
    for r in rows.repartition("range").mapInArrow(run, "range int, bits binary").collect():
        packed[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return packed.tobytes()


def _frequent_bitmap(frequent: DataFrame, k: int, least: int) -> bytes:
    """The bits of the phrases of k words (lang, phrase)."""

    def run(batches):
        counts = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            for lo, buf, offsets in utf8_chunks(batch.column("phrase"), BLOCK):
                starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(buf == 0x20) + 1]))
                ends = np.sort(np.concatenate([offsets[1:], np.flatnonzero(buf == 0x20)]))
                langs = batch.column("lang").slice(lo, len(offsets) - 1).dictionary_encode()
                lang = np.repeat(_strings_hashed(langs.dictionary)[langs.indices.to_numpy()], k)
                hashes = _phrase_hashes(_unit_hashes(span_hashes(buf, starts, ends), lang), np.arange(0, len(starts), k), k)
                counts[(hashes >> U64(64 - BITS)).astype(np.int64)] = least
        rows = list(_as_ranges(counts))
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["range", "places", "counts"])

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, _RANGES), least)


def _pass(texts: DataFrame, k: int, longest: int, least: int, parts: bytes | None, buckets: bytes | None) -> DataFrame:
    """Rows (lang, phrase, n) of the phrases of k words to be counted, by block, and rows (range, places, counts) of the buckets of longer ones, by task."""
    shared = texts.sparkSession.sparkContext.broadcast((parts, buckets))

    def candidates(words: Words) -> np.ndarray:
        at = words.grams(k)
        if k == 1:
            return at
        parts, buckets = map(Bitmap, shared.value)
        at = at[buckets.has(_phrase_hashes(words.hashes, at, k))]
        at = at[parts.has(_phrase_hashes(words.hashes, at, k - 1))]
        return at[parts.has(_phrase_hashes(words.hashes, at + 1, k - 1))]

    def run(batches):
        sums = np.zeros(1 << BITS, np.uint8)
        for batch in blocks(batches, BLOCK):
            for lo, buf, offsets in utf8_chunks(batch.column("text"), BLOCK):
                words = Words(batch.column("lang").slice(lo, len(offsets) - 1), buf, offsets)
                at = candidates(words)
                lang, phrase, n = words.counted(at, k)
                none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([lang, phrase, n, *none], schema=_ROWS)
                if k < longest:
                    there = np.zeros(len(words.unit) + 1, bool)
                    there[at] = True
                    longer = words.grams(k + 1)
                    longer = longer[there[longer] & there[longer + 1]]
                    bucket, many = np.unique(_phrase_hashes(words.hashes, longer, k + 1) >> U64(64 - BITS), return_counts=True)
                    _added(sums, bucket.astype(np.int64), many, least)
        rows = list(_as_ranges(sums))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in (pa.string(), pa.string(), pa.int64())), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], schema=_ROWS)

    return texts.mapInArrow(run, f"lang string, phrase string, n long, {_RANGES}")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f of all phrases of up to `longest` words that occur `least` times (255 at most); lang, n: all words)."""
    if not 1 <= least <= 255:
        raise ValueError("least has to be from 1 to 255")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    parts = buckets = total = out = None
    for k in range(1, longest + 1):
        rows, path = saved_at(_pass(texts, k, longest, least, parts, buckets))
        counts = rows.where("phrase is not null")
        if k == 1:
            total = saved(counts.groupBy("lang").agg(F.sum("n").alias("n")))
        found = saved(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"))
        out = found if out is None else out.unionByName(found)
        if k < longest:
            buckets = _bitmap(rows.where("phrase is null").select("range", "places", "counts"), least)
            parts = _frequent_bitmap(found, k, least)
        discard(spark, path)
    return out, total


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words."""
    found, total = frequent_phrases(docs, longest, least)
    f = found.select("lang", "phrase", "f")
    cand = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    longer = cand.where("k > 2").withColumn("w", words)
    longer = longer.select("lang", F.col("a").alias("b"), F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    wide = lambda c: c.cast("decimal(38,0)")
    left = cand.join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | (wide(F.col("b")) * 100 < wide(F.col("a")) * 80)).drop("b")
    cuts = left.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(38, 0)) div (cast(l as decimal(38, 0)) + r) as bigint)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are dealt out first, so that no task sorts all of them
    first = Window.partitionBy("lang", "salt").orderBy(*order)
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
