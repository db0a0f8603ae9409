"""Language identification by interpolated Kneser-Ney character models.

Texts become sequences of lower-cased letters in which every run of other
characters is one boundary mark; symbols, digits and case therefore say nothing.
n-grams of the highest order are counted over all training documents, each task
pre-aggregating its own; lower orders follow from them as continuation counts.
A model is a set of sorted hash arrays, one for each order, with a row of
probabilities and back-off weights for every language.  The language of the
lowest cross-entropy per character wins.

Every n-gram of every language is kept.  What travels with the tasks is bounded
by shards instead: all that a character's probability needs of orders 3 to 5
holds the two characters before it, so counts are dealt by these two and each
shard gives its own n-grams' whole probabilities.  Orders 1 and 2, whose number
follows the alphabets and not the texts, go with every shard.  A model of one
shard (`SHARD_BYTES`) scores in one pass; of more, each shard is a pass over the
texts, and a text's sums are added up.

Calibration: on all training documents of 40 letters or more the sharpness of the
softmax over cross-entropies is fitted, and for each language the cross-entropy
that nearly all of its documents stay under.  A document above that bound is
`rejected`: it is written in none of the learned languages; its score is then
halved, and `lang_pred` still names the nearest language.  `identify_languages`
scores every document once and calibrates on those of the scores that it may learn from.

Null, empty and other texts without a letter (Unicode category L) get `und` and
score 0, as does everything if no document is labelled.  Texts of any length are
scored whole; of languages at equal cross-entropy the first by name counts; equal
texts get equal answers and repeated rows an answer each; no rows give no rows.
Only doc_id, text and (for learning) lang are read, so further columns of any
name don't matter.
"""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import held_out
from .store import checkpointed, release, saved
from .text import U64, mix64, utf8_chunks

ORDER = 5
SHARD_BYTES = 64 << 20
CALIBRATION_LETTERS = 40
DISCOUNT = 0.75
CHUNK = 2 << 20
_STEP = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(ORDER)]


def folded(code: int) -> int:
    """The lower case of a letter (itself if that is several characters), 0 for any other character."""
    x = chr(code)
    low = x.lower()
    return 0 if not x.isalpha() else ord(low) if len(low) == 1 else code


def fold_table() -> np.ndarray:
    """`folded` of each code point under 65536."""
    return np.array([folded(c) for c in range(1 << 16)], np.uint32)


def code_points(buf):
    """Code points of valid UTF-8 and the byte at which each starts."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
    x = b[at]
    size = 1 + (x >= 0xC0).astype(np.int8) + (x >= 0xE0) + (x >= 0xF0)
    out = x.copy()
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        k = np.flatnonzero(size == n)
        if len(k):
            v = x[k] & mask
            for j in range(1, n):
                v = (v << 6) | (b[at[k] + j] & 0x3F)
            out[k] = v
    return out, at


def letter_sequence(buf, offsets, fold):
    """Letters with boundary marks (0), `ORDER - 1` marks before each row; where each row starts; letters a row."""
    codes, at = code_points(buf)
    big = codes >= 1 << 16
    letters = fold[np.where(big, 0, codes)]
    if big.any():
        kinds, back = np.unique(codes[big], return_inverse=True)
        letters[big] = np.array([folded(int(c)) for c in kinds], np.uint32)[back]
    starts = np.searchsorted(at, offsets)
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    filled = starts[:-1][starts[:-1] < starts[1:]]
    keep[filled] = letters[filled] != 0  # the marks before a row are boundary enough
    before = np.concatenate([[0], np.cumsum(keep)])[starts]
    count = np.concatenate([[0], np.cumsum(letters != 0)])[starts]
    n = np.diff(before)
    pad = ORDER - 1
    begin = before[:-1] + pad * np.arange(1, len(n) + 1)  # of each row's own characters
    out = np.zeros(int(before[-1]) + pad * len(n), np.uint32)
    place = np.arange(int(before[-1])) + np.repeat(pad * np.arange(1, len(n) + 1), n)
    out[place] = letters[keep]
    return out, place, np.repeat(np.arange(len(n)), n), np.diff(count), begin


def suffix_sums(seq, place, order):
    """Unmixed hash of the `order` characters that end at each place."""
    out = np.zeros(len(place), np.uint64)
    for j in range(order):
        out += (seq[place - j].astype(np.uint64) + U64(1)) * U64(_STEP[j])
    return out


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, a, b, n: counts of every n-gram of the highest order; a and b pack its code points, 21 bits each."""

    def run(batches):
        fold = fold_table()
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            codes, names = lang.indices.to_numpy(zero_copy_only=False).astype(np.uint64), lang.dictionary
            for lo, buf, offsets in utf8_chunks(batch.column("text"), CHUNK):
                seq, place, row, _, _ = letter_sequence(buf, offsets, fold)
                if not len(place):
                    continue
                tongue = codes[lo + row]
                key = mix64(suffix_sums(seq, place, ORDER)) + tongue * U64(0xD6E8FEB86659FD93)
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                c = [seq[place[first] - (ORDER - 1 - j)].astype(np.int64) for j in range(ORDER)]
                a, b = (c[0] << 42) | (c[1] << 21) | c[2], (c[3] << 21) | c[4]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(tongue[first].astype(np.int32))).cast(pa.string()), pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["lang", "a", "b", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def shard_of(before, last, shards):
    """The shard of a character by the two before it; for arrays and for Columns of longs alike (nothing overflows)."""
    return (before * 1_000_003 + last * 7_919 + 12_345) % 2_147_483_647 * 48_271 % 2_147_483_647 % shards


@dataclass(frozen=True)
class LanguageModels:
    """ngrams[n - 1]: sorted hashes, shares (one column a language) of order n; contexts[n - 1] likewise with back-off weights.

    part: which shard of how many this is.
    """

    langs: list[str]
    ngrams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    part: tuple[int, int] = (0, 1)


def _hash_codes(codes):
    """As mix64(suffix_sums()) for rows of code points, the last character last."""
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        out += (codes[:, -1 - j].astype(np.uint64) + U64(1)) * U64(_STEP[j])
    return mix64(out)


def _merge(parts):
    """Sorted union of keys and, for each of the parts, their values (0 where it has none)."""
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    out = np.zeros((len(keys), len(parts)), np.float32)
    for j, (k, v) in enumerate(parts):
        out[np.searchsorted(keys, k), j] = v
    return keys, out


def build_models(counts: dict[str, tuple[np.ndarray, np.ndarray]], pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, part: tuple[int, int] = (0, 1)) -> LanguageModels:
    """counts: code points (rows of ORDER) and their counts, by language; pairs: those of order 2 over all shards, if counts are of one shard."""
    langs = sorted(counts)
    ngrams, contexts = [[] for _ in range(ORDER)], [[] for _ in range(ORDER)]
    alphabet = []
    for lang in langs:
        codes, n = counts[lang]
        for order in range(ORDER, 0, -1):
            if order == 2 and pairs is not None:
                codes, n = pairs[lang]
            keys, first, inverse = np.unique(_hash_codes(codes), return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=n)
            codes = codes[first]
            context = _hash_codes(codes[:, :-1]) if order > 1 else np.zeros(len(codes), np.uint64)
            seen, back = np.unique(context, return_inverse=True)
            mass, kinds = np.bincount(back, weights=total), np.bincount(back)
            ngrams[order - 1].append((keys, np.maximum(total - DISCOUNT, 0) / mass[back]))
            contexts[order - 1].append((seen, DISCOUNT * kinds / mass))
            # one order lower, an n-gram counts as often as different characters come before it
            codes, n = codes[:, 1:], np.ones(len(codes))
        alphabet.append(len(keys))
    floor = np.array([1.0 / (k + 100) for k in alphabet], np.float32)
    return LanguageModels(langs, [_merge(p) for p in ngrams], [_merge(p) for p in contexts], floor, part)


def _lookup(table, keys, missing):
    if not len(table[0]):
        return np.full((len(keys), table[1].shape[1]), missing, np.float32)
    at = np.searchsorted(table[0], keys)
    at[at == len(table[0])] = 0
    found = table[0][at] == keys
    out = table[1][at]
    out[~found] = missing
    return out


def cross_entropies(m: LanguageModels, buf, offsets, fold):
    """Nats a character of each row under each language (of a shard, its characters' part of them), and letters a row."""
    seq, place, row, letters, _ = letter_sequence(buf, offsets, fold)
    rows = len(offsets) - 1
    n = np.maximum(np.bincount(row, minlength=rows), 1)
    mine, shards = m.part
    if shards > 1:
        own = shard_of(seq[place - 2].astype(np.int64), seq[place - 1].astype(np.int64), shards) == mine
        place, row = place[own], row[own]
    if not len(place):
        return np.zeros((rows, len(m.langs))), letters
    _, first, inverse = np.unique(suffix_sums(seq, place, ORDER), return_index=True, return_inverse=True)
    at = place[first]  # every different n-gram is looked up once
    p = np.broadcast_to(m.floor, (len(at), len(m.langs))).astype(np.float32)
    for order in range(1, ORDER + 1):
        share = _lookup(m.ngrams[order - 1], mix64(suffix_sums(seq, at, order)), 0.0)
        context = mix64(suffix_sums(seq, at - 1, order - 1)) if order > 1 else np.zeros(len(at), np.uint64)
        p = share + _lookup(m.contexts[order - 1], context, 1.0) * p
    nats = -np.log(np.maximum(p, 1e-12))
    return np.stack([np.bincount(row, weights=nats[inverse, k], minlength=rows) / n for k in range(len(m.langs))], 1), letters


@dataclass(frozen=True)
class Learned:
    """Counts of all n-grams (table: lang, a, b, n, shard), from which `models` makes those of one shard, and the calibration."""

    langs: list[str]
    table: DataFrame
    shards: int
    pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None
    whole: LanguageModels | None = None
    sharpness: float = 20.0
    limits: np.ndarray | None = None

    def models(self, shard: int) -> LanguageModels:
        if self.whole is not None:
            return self.whole
        mask = (1 << 21) - 1
        rows = self.table.where(F.col("shard") == shard) if self.shards > 1 else self.table
        counts = _by_language(rows.select("lang", "a", "b", "n"), self.langs, lambda a, b: [a >> 42, (a >> 21) & mask, a & mask, b >> 21, b & mask])
        return build_models(counts, self.pairs, (shard, self.shards))


def _by_language(rows: DataFrame, langs: list[str], codes) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The code points (in columns) and counts of rows (lang, packed characters, n) by language."""
    got = rows.toArrow()
    packed = codes(*(got.column(c).to_numpy() for c in got.column_names[1:-1]))
    n, lang = got.column("n").to_numpy().astype(float), got.column("lang").combine_chunks()
    at = pa.compute.index_in(lang, pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(len(langs) + 1))
    return {x: (np.stack([c[order[cut[k] : cut[k + 1]]] for c in packed], 1), n[order[cut[k] : cut[k + 1]]]) for k, x in enumerate(langs)}


def _learn(docs: DataFrame, shard_bytes: int) -> Learned | None:
    table = checkpointed(count_ngrams(docs))
    sizes = {r[0]: r[1] for r in table.groupBy("lang").agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    # of all orders and contexts together there are about two and a half times as many as of the highest order
    shards = max(1, -(-sum(sizes.values()) * 5 * (8 + 4 * len(langs)) // (2 * shard_bytes)))
    if shards == 1:
        whole = Learned(langs, table, 1)
        return replace(whole, whole=whole.models(0))
    mask = (1 << 21) - 1
    before, last = F.col("a").bitwiseAND(F.lit(mask)), F.shiftright("b", 21)
    table = saved(table.withColumn("shard", shard_of(before, last, shards).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard"))
    pairs = table.select("lang", before.alias("c"), "b").distinct().groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    return Learned(langs, table, shards, _by_language(pairs, langs, lambda b: [b >> 21, b & mask]))


def fit_models(docs: DataFrame, shard_bytes: int | None = None) -> Learned | None:
    """Models of every language of docs (text, lang, doc_id), all rows counting; None if no row is labelled."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    m = _learn(docs, SHARD_BYTES if shard_bytes is None else shard_bytes)
    if m is None:
        return None
    return _calibrated(m, saved(_entropies(docs, m, ["lang"])))


def _calibrated(m: Learned, scored: DataFrame) -> Learned:
    """m with sharpness and limits from all rows of scored (lang, nats, letters)."""
    own = F.element_at("nats", F.array_position(F.array(*map(F.lit, m.langs)), F.col("lang")).cast("int"))
    rows = scored.where(F.col("letters") >= CALIBRATION_LETTERS).select("lang", "nats", F.array_min("nats").alias("low"), own.alias("own"))
    sharps = [2.0**k for k in range(-1, 7)]

    def loss(t):
        return t * (F.col("own") - F.col("low")) + F.log(F.aggregate("nats", F.lit(0.0), lambda s, x: s + F.exp(-t * (x - F.col("low")))))

    r = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(loss(t)).alias(f"loss{k}") for k, t in enumerate(sharps))).head()
    if not r["n"]:
        return m
    sharp = sharps[min(range(len(sharps)), key=lambda k: r[f"loss{k}"])]
    found = _quantiles(rows.select("lang", "own"), 0.99)
    return replace(m, sharpness=sharp, limits=np.array([found[x][1] * 1.35 if x in found and found[x][0] >= 20 else np.inf for x in m.langs]))


def _quantiles(rows: DataFrame, share: float) -> dict[str, tuple[int, float]]:
    """n and the quantile (interpolated) of `own` of all rows of each lang.

    Equal values are counted first and dealt to ranges; what lies before a range comes
    from the ranges' counts, and only the ranges that hold the places are put in order.
    """
    values = rows.groupBy("lang", "own").agg(F.count(F.lit(1)).alias("t"))
    placed = checkpointed(values.repartitionByRange("lang", "own").withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("lang", "part").agg(F.sum("t").alias("k"))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.select("lang", "part", "k", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("start"), F.sum("k").over(Window.partitionBy("lang")).alias("n"))
    at = (F.col("n") - 1) * share
    wanted = parts.select("*", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("at")).where("start <= at and at < start + k")
    within = Window.partitionBy("lang", "part").orderBy("own").rowsBetween(Window.unboundedPreceding, 0)
    held = placed.join(F.broadcast(wanted.select("lang", "part").distinct()), ["lang", "part"], "left_semi").withColumn("upto", F.sum("t").over(within))
    got = held.join(F.broadcast(wanted), ["lang", "part"]).where("start + upto - t <= at and at < start + upto").select("lang", "n", "at", "own")
    places = {}
    for r in got.collect():  # two rows a language at most
        places.setdefault((r["lang"], r["n"]), {})[r["at"]] = r["own"]
    return {x: (n, float(np.interp((n - 1) * share, sorted(v), [v[k] for k in sorted(v)]))) for (x, n), v in places.items()}


def _shard_entropies(df: DataFrame, m: LanguageModels, keys: list[str]) -> DataFrame:
    """keys, nats (array, in order of m.langs), letters of each row."""

    def run(batches):
        fold = fold_table()
        for batch in batches:
            for lo, buf, offsets in utf8_chunks(batch.column("text"), CHUNK):
                nats, letters = cross_entropies(m, buf, offsets, fold)
                n = len(letters)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(m.langs)), pa.array(nats.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, n) for k in keys), lists, pa.array(letters.astype(np.int64))], [*keys, "nats", "letters"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, "text").mapInArrow(run, f"{kinds}, nats array<double>, letters long")


def _entropies(df: DataFrame, m: Learned, keys: list[str]) -> DataFrame:
    """As _shard_entropies under the whole models, shard after shard."""
    if m.shards == 1:
        return _shard_entropies(df, m.models(0), keys)
    text = F.coalesce("text", F.lit(""))
    names = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]  # equal texts have equal sums
    parts = None
    for k in range(m.shards):
        got = _shard_entropies(df.select(*names, "text"), m.models(k), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
        part = saved(got.withColumn("shard", F.lit(k)))
        parts = part if parts is None else parts.unionByName(part)
        release(df.sparkSession)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("shard", "nats"))), lambda x: x["nats"])
    none = F.array_repeat(F.lit(0.0), len(m.langs))
    total = F.aggregate(lists, none, lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    sums = parts.groupBy("h1", "h2").agg(total.alias("nats"), F.first("letters").alias("letters"))
    return df.select(*keys, *names).join(sums, ["h1", "h2"]).select(*keys, "nats", "letters")


def predict(docs: DataFrame, m: Learned | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    if m is None:
        return docs.select("doc_id", held_out(4, 2).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    return _decided(_entropies(docs, m, ["doc_id"]), m)


def _decided(scored: DataFrame, m: Learned) -> DataFrame:
    """As predict, from doc_id, nats and letters."""
    names, sharpness = np.array([*m.langs, "und"], object), m.sharpness
    limits = m.limits if m.limits is not None else np.full(len(m.langs), np.inf)

    def settle(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nats, letters = batch.column("nats").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("letters").to_numpy()
            best = nats.argmin(1)
            low = nats.min(1)
            p = 1 / np.exp(-sharpness * (nats - low[:, None])).sum(1)
            none = letters == 0
            rejected = none | (low > limits[best])
            score = np.where(none, 0.0, np.where(rejected, p / 2, p))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[np.where(none, len(names) - 1, best)], pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    kind = scored.schema["doc_id"].dataType.simpleString()
    out = scored.select("doc_id", "nats", "letters").mapInArrow(settle, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all."""
    docs = docs.select("doc_id", "text", "lang")
    learning = ~held_out(4, 2) & F.col("lang").isNotNull()
    m = _learn(docs.where(learning & F.col("text").isNotNull()), SHARD_BYTES)
    if m is None:
        return predict(docs, None)
    scored = saved(_entropies(docs, m, ["doc_id", "lang"]))
    return _decided(scored, _calibrated(m, scored.where(learning)))
