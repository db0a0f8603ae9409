"""Removal of repeated byte strings by per-shard suffix arrays.

Every string of `length` bytes is named by its anchor: the least of the hashes of
its `GRAM`-byte grams, so equal strings have equal anchors.  Neighbouring strings
of one anchor form a segment.  Segments are gathered by anchor, which keeps all
strings that can be equal together:

- anchors with one segment at one place are dropped: nothing there repeats;
- equal segments at several places repeat as a whole (pre-aggregation: a passage
  that a third of the documents share is one row);
- different segments of one anchor go to shards of bounded size.  A shard sorts
  its suffixes by Larsson-Sadakane refinement, measures common prefixes by
  Kasai's method, and reports the strings with a neighbour equal for `length`
  bytes.  An anchor too large for a shard is dealt over several; each sends its
  distinct strings as packed sorted runs of fingerprints, runs are merged by binary
  search within ranges of the distance to the anchor, and what they share is
  confirmed by its bytes.

Equal texts are one text from the start; where a text of at least `length` bytes
occurs twice, all of it goes.  Matches never cross documents.  Null texts are
empty; texts shorter than `length` are kept whole, longer ones of any length are
searched whole, in overlapping windows.  Repeated rows are copies of one another; rows may share an id; no rows
give no rows; columns other than doc_id and text are not read.  Equal segments are
found by a 64-bit hash among those of one 64-bit anchor, equal texts by 128 bits of
SHA-256; suffixes and merged runs are compared by their bytes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import checkpointed, release, saved
from .text import _BASE, _INVERSE, U64, _powers, mix64, utf8_chunks

LENGTH = 400
GRAM = 32
SHARD_BYTES = 2 << 20
#: Anchors that fit one shard are dealt over shards of a quarter of that on average, and texts read in
#: chunks of CHUNK bytes: arrays of that size stay in a core's cache.
SHARDS_A_TASK = 4
CHUNK = 1 << 17
#: Longer texts are searched in windows of this many strings, so that memory doesn't follow the text.
WINDOW = 1 << 22
_PLACE_BITS = 28
#: Shards are dealt over this many tasks at most; a task streams its shards one after another.
MOST_TASKS = 8_192


def _words_at(buf: np.ndarray, n: int, kind: str) -> np.ndarray:
    """The eight bytes from each of the first n places as one number."""
    return np.ndarray((n,), kind, buf, strides=(1,)).astype(np.uint64)


def suffix_order(buf: np.ndarray) -> np.ndarray:
    """The suffix array.

    Groups of equal 8-byte prefixes come first; every round sorts each group that
    is left by the ranks of the suffixes once and twice as many bytes further as are
    sorted so far, which triples that number.  Three ranks fit one word below 2^21
    bytes; a larger text takes one rank a round and doubles.
    """
    n = len(buf)
    first = _words_at(np.concatenate([buf, np.zeros(8, np.uint8)]), n, ">u8")
    order = np.argsort(first)
    key = first[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.int64)  # from 1; 0 past the end
    rank[order] = np.repeat(starts + 1, np.diff(np.append(starts, n)))
    done, three = 8, n < (1 << 21) - 1
    # places of the sorted array whose group has several suffixes
    alone = np.ones(n, bool)
    alone[:-1] = new[1:]
    todo = np.flatnonzero(~(new & alone))
    while len(todo):
        s = order[todo]
        if three:
            key = (((rank[s] << 21) | rank[np.minimum(s + done, n)]) << 21) | rank[np.minimum(s + 2 * done, n)]
        else:
            key = (rank[s] << 32) | rank[np.minimum(s + done, n)]
        k = np.argsort(key)
        s, key = s[k], key[k]
        order[todo] = s
        new = np.ones(len(todo), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        rank[s] = np.repeat(todo[starts] + 1, np.diff(np.append(starts, len(todo))))
        last = np.ones(len(todo), bool)
        last[:-1] = new[1:]
        todo = todo[~(new & last)]
        done *= 3 if three else 2
    return order


def common_prefixes(buf: np.ndarray, before: np.ndarray, most: int, block: int = 64) -> np.ndarray:
    """Common prefix of each suffix with suffix `before` (-1: none), up to `most`.

    Kasai's walk: from one suffix to the next in the text the prefix shrinks by one
    at most.  Blocks of the text walk side by side, each from its own start.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(most + 8, np.uint8)])
    out = np.zeros(n, np.int32)
    at = np.arange(0, n, block)
    end = np.minimum(at + block, n)
    have = np.zeros(len(at), np.int64)
    eight = _words_at(padded, len(padded) - 7, "<u8")
    while len(at):
        b = before[at]
        room = np.minimum(most, n - np.maximum(at, b)) - have
        i, j = np.minimum(at + have, len(eight) - 1), np.minimum(np.maximum(b, 0) + have, len(eight) - 1)
        differ = eight[i] ^ eight[j]
        low = differ & (~differ + U64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.int64) >> 3)  # equal bytes before the first that differs
        step = np.where(b < 0, 0, np.minimum(same, np.maximum(room, 0)))
        have += step
        stop = (step < 8) | (have >= most)
        k = np.flatnonzero(stop)
        out[at[k]] = np.where(b[k] < 0, 0, have[k])
        at[k] += 1
        have[k] = np.maximum(have[k] - 1, 0)
        go = at < end
        if not go.all():
            at, end, have = at[go], end[go], have[go]
    return out


def repeated_starts(buf: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes from each place also start at another place of buf."""
    n = len(buf)
    order = suffix_order(buf)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    long = np.flatnonzero(common_prefixes(buf, before, length) >= length)
    out = np.zeros(n, bool)
    out[long] = True
    out[before[long]] = True
    return out


def _gram_hashes(buf, size):
    """Hash of every `size` bytes, and what hashes any span: prefix sums and inverse powers."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U64(1)) * _powers(n, _BASE), out=sums[1:])
    back = _powers(n + 1, _INVERSE)
    return mix64((sums[size:] - sums[: n + 1 - size]) * back[: n + 1 - size]), sums, back


def segments(buf, offsets, length=LENGTH, gram=GRAM):
    """Row, first string, number of strings, anchor hash and content hash of each segment of every row.

    Each string starts in one window and lies in it whole; that a border cuts a segment
    in two changes no string's anchor.
    """
    if len(buf) < WINDOW + length:
        return _window_segments(buf, offsets, length, gram)
    out = []
    for at in range(0, len(buf) - length + 1, WINDOW):
        piece = buf[at : at + WINDOW + length - 1]
        first = int(np.searchsorted(offsets, at, "right")) - 1
        end = int(np.searchsorted(offsets, at + len(piece)))
        row, lo, *rest = _window_segments(piece, np.clip(offsets[first : end + 1] - at, 0, len(piece)), length, gram)
        row += first
        lo += np.maximum(at - offsets[row], 0)  # places within the row, not its part in the window
        out.append((row, lo, *rest))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _window_segments(buf, offsets, length, gram):
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes, sums, back = _gram_hashes(buf, gram)
    mask = U64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)  # equal heads: the first place counts
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if rest := width - reach:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & mask).astype(np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(anchor)]
    at = np.flatnonzero(np.repeat(offsets[1:], sizes)[: len(anchor)] - length >= np.arange(len(anchor)))
    if not len(at):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at][1:] != anchor[at][:-1]) | (row[at][1:] != row[at][:-1])
    lo = at[new]
    cut = np.flatnonzero(new)
    count = np.diff(np.append(cut, len(at)))
    end = lo + count - 1 + length
    content = mix64((sums[end] - sums[lo]) * back[lo] + count.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    return row[lo], lo - offsets[row[lo]], count, hashes[anchor[lo]], content


def _text_key(text):
    """128 bits that name a text."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def _segments_of(texts: DataFrame, length: int) -> DataFrame:
    """key (of the text), lo, n, anchor, content of every segment."""

    def run(batches):
        for batch in batches:
            for first, buf, offsets in utf8_chunks(batch.column("text"), CHUNK):
                row, lo, n, anchor, content = segments(buf, offsets, length)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(pa.array(first + row)), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                        ["key", "lo", "n", "anchor", "content"],
                    )

    return texts.mapInArrow(run, "key binary, lo long, n int, anchor long, content long")


def _cut_out(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, content, bytes of the wanted (key, lo, n, anchor, content) segments."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("lo", "n", "anchor", "content")).alias("parts"))
    one = texts.join(lists.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            anchors, contents, out = [], [], []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                raw = text.encode()
                for p in parts:
                    anchors.append(p["anchor"])
                    contents.append(p["content"])
                    out.append(raw[p["lo"] : p["lo"] + p["n"] - 1 + length])
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(contents, pa.int64()), pa.array(out, pa.binary())], ["anchor", "content", "bytes"])

    return one.join(lists, "key").mapInArrow(run, "anchor long, content long, bytes binary")


def _true_runs(mask):
    """Bounds of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _groups(batches, keys):
    """The rows of sorted batches as one table for each run of equal keys; one such table is held at a time."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = tuple(c[a] for c in columns)
            if held and mine != current:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            current = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _joined(raw):
    """Byte strings one after another, each ended by a byte that no UTF-8 text holds; where each begins; sizes."""
    sizes = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8), np.concatenate([[0], np.cumsum(sizes + 1)]), sizes


def _shard_repeats(parts: DataFrame, length: int) -> DataFrame:
    """anchor, content, a, b: runs of strings repeated within their shard."""

    def run(batches):
        for t in _groups(batches, ["shard"]):
            buf, begin, sizes = _joined(t.column("bytes").to_pylist())
            hit = repeated_starts(buf, length)
            runs = [_true_runs(hit[begin[k] : begin[k] + sizes[k] - length + 1]) for k in range(len(sizes))]
            k = np.repeat(np.arange(len(sizes)), [len(a) for a, _ in runs])
            a, b = (np.concatenate([r[j] for r in runs]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().take(pa.array(k)) for c in ("anchor", "content")), pa.array(a), pa.array(b)], ["anchor", "content", "a", "b"])

    return parts.mapInArrow(run, "anchor long, content long, a long, b long")


_PRINT = np.dtype([("f", "<u8"), ("content", "<i8"), ("a", "<i4")])


def _split_shard_runs(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """What the shards of anchors over several shards have found and what they send.

    kind 0: content, a, b, a run of strings repeated within the shard.  kind 1: prints,
    the packed strings of a shard (fingerprint, content, start), sorted by fingerprint,
    one row for each range of the distance to the anchor.  Equal strings lie as far
    before their anchor, so they share a range, and neighbours nearly always do.
    """
    schema = "anchor long, kind int, content long, a long, b long, reach int, part int, prints binary"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["anchor", "kind", "content", "a", "b", "reach", "part", "prints"]

    def solve(t):
        anchor, pieces = t.column("anchor")[0].as_py(), int(t.column("pieces")[0].as_py())
        contents = t.column("content").to_numpy()
        buf, begin, sizes = _joined(t.column("bytes").to_pylist())
        hit = repeated_starts(buf, length)
        count = sizes - length + 1
        own = np.zeros(len(buf) + 1, np.int8)
        own[begin[:-1]] += 1
        own[begin[:-1] + count] -= 1
        starts = np.cumsum(own[:-1], dtype=np.int8) > 0
        a, b = _true_runs(hit & starts)
        k = np.searchsorted(begin, a, "right") - 1
        found = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((np.full(len(a), anchor), np.zeros(len(a)), contents[k], a - begin[k], b - begin[k], [None] * len(a), [None] * len(a), [None] * len(a)), kinds, strict=True)], names)
        # of strings repeated here each occurrence is known to repeat; other shards need them once
        spans = _gram_hashes(buf, length)[0]
        again = np.flatnonzero(hit & starts)
        send = starts & ~hit
        send[again[np.unique(spans[again], return_index=True)[1]]] = True
        at = np.flatnonzero(send)
        k = np.searchsorted(begin, at, "right") - 1
        gram_at = np.flatnonzero(_gram_hashes(buf, gram)[0] == np.array([anchor]).view(np.uint64)[0])
        far = gram_at[np.searchsorted(gram_at, begin[k])] - at
        rows = np.empty(len(at), _PRINT)
        rows["f"], rows["content"], rows["a"] = spans[at], contents[k], at - begin[k]
        # four pieces' strings a range; beyond what distances can part, fingerprints do
        width = length - gram + 1
        ranges, parts_a_range = min(width, -(-pieces // 4)), max(1, -(-pieces // (4 * width)))
        name = (far * ranges // width) * parts_a_range + ((rows["f"] >> U64(32)).astype(np.int64) * parts_a_range >> 32)
        order = np.lexsort((rows["f"], name))
        rows, name = rows[order], name[order]
        cut = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
        n = len(cut) - 1
        which = name[cut[:-1]]
        packed = [rows[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
        prints = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((np.full(n, anchor), np.ones(n), [None] * n, [None] * n, [None] * n, which // parts_a_range, which % parts_a_range, packed), kinds, strict=True)], names)
        return [found, prints]

    def run(batches):
        for t in _groups(batches, ["shard", "anchor"]):
            yield from solve(t)

    return parts.mapInArrow(run, schema)


def _merged_runs(sent: DataFrame) -> DataFrame:
    """anchor, content, a, b, content2, a2: runs of strings a to b - 1 that have the fingerprints of those from a2 on in another shard.

    The sorted runs of a range become one, in which each string looks for its
    fingerprint by binary search: no shard sends a string twice.
    """

    def merge(t):
        anchor = t.column("anchor")[0].as_py()
        rows = np.concatenate([np.frombuffer(x, _PRINT) for x in t.column("prints").to_pylist()])
        rows = rows[np.argsort(rows["f"], kind="stable")]
        left, right = (np.searchsorted(rows["f"], rows["f"], side) for side in ("left", "right"))
        mine = np.flatnonzero(right - left > 1)
        other = np.where(left[mine] == mine, mine + 1, left[mine])
        x = np.stack([rows["content"][mine], rows["a"][mine], rows["content"][other], rows["a"][other]], 1).astype(np.int64)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:, 0] != x[:-1, 0]) | (x[1:, 2] != x[:-1, 2]) | (x[1:, 1] != x[:-1, 1] + 1) | (x[1:, 3] != x[:-1, 3] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(x)))
        x = x[first]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), anchor)), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 1] + n), pa.array(x[:, 2]), pa.array(x[:, 3])], ["anchor", "content", "a", "b", "content2", "a2"])

    dealt = sent.repartition("anchor", "reach", "part").sortWithinPartitions("anchor", "reach", "part")
    return dealt.mapInArrow(lambda batches: map(merge, _groups(batches, ["anchor", "reach", "part"])), "anchor long, content long, a long, b long, content2 long, a2 long")


def _same_bytes(runs: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """anchor, content, a, b of those runs whose bytes are those of the other place."""
    one = parts.select("anchor", "content", "bytes")
    two = parts.select("anchor", F.col("content").alias("content2"), F.col("bytes").alias("bytes2"))
    both = runs.join(one, ["anchor", "content"]).join(two, ["anchor", "content2"])
    size = F.col("b") - F.col("a") + (length - 1)
    cut = lambda c, a: F.substring(F.col(c), (F.col(a) + 1).cast("int"), size.cast("int"))
    return both.where(cut("bytes", "a") == cut("bytes2", "a2")).select("anchor", "content", "a", "b")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """key, ranges (array of lo, hi: bytes covered by repeated strings), whole (the text occurs twice), for texts (key, text).

    Only texts with something repeated have a row.
    """
    spark = texts.sparkSession
    long = texts.where(F.octet_length("text") >= length)
    every = saved(_segments_of(long, length)).withColumn("place", F.xxhash64("key", "lo"))
    groups = every.groupBy("anchor", "content").agg(F.min("place").alias("p"), F.max("place").alias("q"), F.first("n").alias("n"))
    several = groups.groupBy("anchor").agg(F.min("content").alias("c"), F.max("content").alias("d")).where("c <> d").select("anchor", F.lit(True).alias("several"))
    marked = groups.join(several, "anchor", "left").select("anchor", "content", (F.col("p") != F.col("q")).alias("repeats"), F.coalesce("several", F.lit(False)).alias("several"))
    used = saved(every.drop("place").join(marked.where("repeats or several"), ["anchor", "content"]))
    release(spark)
    # one place for each different segment that has others to be compared with
    least = F.min(F.struct("key", "lo")).alias("m")
    wanted = used.where("several").groupBy("anchor", "content", "n").agg(least).select("anchor", "content", "n", "m.key", "m.lo")
    parts = saved(_cut_out(long, wanted, length))
    release(spark)
    sizes = parts.groupBy("anchor").agg(F.sum(F.octet_length("bytes") + 1).alias("size"))
    total = sizes.agg(F.sum("size")).head()[0] or 0
    shards = max(64, 2 * int(total // shard_bytes + 1))
    tasks = min(shards, MOST_TASKS)
    shards *= SHARDS_A_TASK
    large = sizes.where(F.col("size") > shard_bytes).select("anchor", F.ceil(F.col("size") / shard_bytes).alias("pieces"))
    dealt = parts.join(large, "anchor", "left")
    # an anchor that is too large has shards of its own
    piece = F.xxhash64("anchor", F.pmod("content", "pieces"))
    name = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(piece)
    dealt = dealt.select("anchor", "content", "bytes", "pieces", name.cast("long").alias("shard"))
    small = dealt.where("pieces is null").repartition(tasks, "shard").sortWithinPartitions("shard", "anchor")
    runs = checkpointed(_shard_repeats(small, length))
    if large.head(1):
        big = saved(dealt.where("pieces is not null"))
        both = saved(_split_shard_runs(big.repartition(tasks, "shard").sortWithinPartitions("shard", "anchor"), length, GRAM))
        cross = _same_bytes(_merged_runs(both.where("kind = 1").select("anchor", "reach", "part", "prints")), big, length)
        runs = runs.unionByName(both.where("kind = 0").select("anchor", "content", "a", "b")).unionByName(cross)
    whole_segments = used.where("repeats").select("key", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + length).alias("b"))
    by_segment = runs.groupBy("anchor", "content").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    some = used.where("several and not repeats").join(by_segment, ["anchor", "content"]).select("key", "lo", F.explode("runs").alias("r"))
    some = some.select("key", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b") - 1 + length).alias("b"))
    ranges = whole_segments.unionByName(some).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    copies = long.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("whole"))
    return saved(ranges.join(copies, "key", "full").select("key", "ranges", F.coalesce("whole", F.lit(False)).alias("whole")))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", _text_key(F.col("text")))
    found = repeated_ranges(texts.select("key", "text"), length)
    release(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for text, ranges, whole in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                raw = text.encode()
                spans = [[0, len(raw)]] if whole else []
                if not whole:
                    for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                        if spans and r[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r[1])
                        else:
                            spans.append(list(r))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, count, sha, kept = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(found, "key", "left").select("doc_id", "text", "ranges", "whole")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
