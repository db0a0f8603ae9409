"""Near-duplicate groups by one-permutation hashing.

Each document's set of word shingles is hashed once.  The hash space is cut into
`BINS` bins and a bin keeps its least hash; an empty bin borrows from the first
filled bin of a fixed random sequence of its own (optimal densification).  Bands
of `ROWS` bins name buckets.  In each bucket the smallest id is the star's
centre: a bucket of n documents makes n - 1 candidate edges, never n squared.

Links to the smallest centre are then confirmed on the full sets.  That alone
misses links between members that are both unlike the centre.  All documents that share buckets,
directly or through others, are a crowd; crowds whose members are still in
several components are searched once more: member against member in bounded
blocks, by signature and then by full set, each two blocks giving a spanning
forest of the links between components.  Two things can miss a link at a similarity of
0.8: the pair shares no bucket, with a probability of (1 - 0.8^4)^32, under 5e-8;
or over MOST_DIFFERING of 128 bins differ, under 1e-8.  All other pairs that are
passed over are proven unlike by a bound.

Equal sets are one node from the start.  Rows of equal id are one document as
far as links go.  Rows without id are linked with nothing and have no component.
Empty sets (null, empty or blank texts) are their own component; texts of any
length are taken whole; no rows give no rows.  Ids have to be whole numbers (an
error else).  Further columns pass through `one_of_each_group` whatever their
names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import release, saved, spare
from .text import LOWER, U64, mix64, ngram_hashes, span_hashes, utf8_chunks, words

BINS, ROWS = 128, 4
BLOCK = 1024
MOST_FILTER_BITS = 1 << 27
#: More differing bins than this are taken for proof that two sets are unlike at 80 percent or more.
MOST_DIFFERING = 53


def shingle_sets(buf, offsets, size):
    """The sorted distinct shingle hashes of each row; a row of fewer words has its whole sequence as one."""
    low = LOWER[buf]
    starts, ends, rows, counts = words(low, offsets)
    h = span_hashes(low, starts, ends)
    grams, owner = ngram_hashes(h, rows, size)
    cut = np.searchsorted(owner, np.arange(len(counts) + 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    for row, n in enumerate(counts):
        if n >= size:
            s = np.sort(grams[cut[row] : cut[row + 1]])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            yield s[keep]
        elif n:
            yield ngram_hashes(h[first[row] : first[row + 1]], np.zeros(n, np.int64), int(n))[0]
        else:
            yield np.zeros(0, np.uint64)


def probes(bins, seed=1):
    """For each bin the sequence in which it asks others when it is empty."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def bin_minima(s, bins):
    """Least hash of each bin of a sorted non-empty set, and which bins hold any."""
    shift = U64(64 - int(bins).bit_length() + 1)
    edges = np.searchsorted(s, np.arange(bins, dtype=np.uint64) << shift)
    return s[np.minimum(edges, len(s) - 1)], np.append(edges[1:], len(s)) > edges


def densified(least, filled, ask):
    """Empty bins filled by borrowing."""
    empty = np.flatnonzero(~filled)
    if len(empty):
        seq = ask[empty]
        least = least.copy()
        least[empty] = least[seq[np.arange(len(empty)), filled[seq].argmax(1)]]
    return least


def signature(s, ask):
    """Least hash of each bin of a sorted non-empty set, empty bins filled by borrowing."""
    return densified(*bin_minima(s, len(ask)), ask)


def may_be_alike(sig, n, one, n_one, percent):
    """Whether sets (rows of bin minima, 0 for an empty bin, and sizes) may reach the threshold against one other.

    Bins cut the hash space, so each bin whose minima differ holds an element of one
    set only: with d such bins 100 * intersection >= percent * union needs
    d * (100 + percent) <= (100 - percent) * (sum of the sizes), whatever the texts.
    At 80 percent or more, each bin that the union fills differs with a probability of
    0.2 at most, so that over MOST_DIFFERING of BINS differ once in 1e8 links, whatever the sizes.
    """
    d = (sig != one).sum(1)
    ok = (d * (100 + percent) <= (100 - percent) * (n + n_one)) & (100 * np.minimum(n, n_one) >= percent * np.maximum(n, n_one))
    return ok & (d <= MOST_DIFFERING) if percent >= 80 else ok


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, k1, k2 (128 bits of the set), bands, sig (16 bits of each bin's minimum) of every document; bands and sig are null for empty sets."""

    def run(batches):
        ask = probes(BINS)
        weights = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        names = mix64(np.arange(1, BINS // ROWS + 1, dtype=np.uint64))
        for batch in batches:
            for lo, buf, offsets in utf8_chunks(batch.column("text")):
                n, k1, k2, bands, sigs = [], [], [], [], []
                for s in shingle_sets(buf, offsets, size):
                    n.append(len(s))
                    k1.append(np.add.reduce(mix64(s + U64(7))))
                    k2.append(np.add.reduce(mix64(s ^ U64(0x5851F42D4C957F2D))))
                    if len(s):
                        least, filled = bin_minima(s, BINS)
                        sig = densified(least, filled, ask)
                        bands.append(mix64((sig.reshape(-1, ROWS) * weights).sum(1, dtype=np.uint64) + names).view(np.int64))
                        sigs.append(np.where(filled, least & U64(0xFFFF) | U64(1), U64(0)).astype(np.uint16).tobytes())
                    else:
                        bands.append(None)
                        sigs.append(None)
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(n)), pa.array(n, pa.int64()), as_long(k1), as_long(k2), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "n", "k1", "k2", "bands", "sig"],
                )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary")


def id_filter(ids: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of hashed ids, 16 bits an id and at most MOST_FILTER_BITS in all: whatever is in ids has its bit set."""
    bits = 1 << min(MOST_FILTER_BITS.bit_length() - 1, max(16, (16 * rows).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    placed = ids.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) & 63 as int))").alias("m"))
    words = placed.groupBy("w").agg(F.bit_or("m").alias("m"))
    out = np.zeros(bits >> 6, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view(np.uint64)


def full_sets(docs: DataFrame, ids: DataFrame, rows: int, size: int) -> DataFrame:
    """id, set (sorted hashes as bytes) of the documents in ids and a few others, without moving any text.

    A bounded filter of the ids travels to the texts; where it is full, sets of more
    documents come out, which joins drop.
    """
    table = id_filter(ids, rows)

    def run(batches):
        bits = U64(len(table) * 64 - 1)
        for batch in batches:
            at = batch.column("bit").to_numpy().astype(np.uint64) & bits
            some = (table[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)
            batch = batch.filter(pa.array(some.astype(bool)))
            for lo, buf, offsets in utf8_chunks(batch.column("text")):
                sets = [s.tobytes() for s in shingle_sets(buf, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(sets)), pa.array(sets, pa.binary())], ["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    return texts.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(len(table) * 64))).mapInArrow(run, "id long, set binary")


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                s, t = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                if 100 * len(s) < percent * len(t):
                    continue
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum())
                keep[k] = 100 * both >= percent * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    pairs = edges.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _rest_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components among members (crowd, id, comp, n, sig, set), block against block.

    Each pair of blocks gives a spanning forest of the links it finds, so rows
    follow the members, not their pairs.
    """

    def alike(s, t):
        if len(s) > len(t):
            s, t = t, s
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        both = int((t[at] == s).sum())
        return 100 * both >= percent * (len(s) + len(t) - both)

    def links(ids, root, n, sig, sets, block, p, q):
        mine = np.flatnonzero(block == p)
        other = mine if p == q else np.flatnonzero(block == q)
        out = []
        for i in mine:
            them = other[other > i] if p == q else other
            them = them[root[them] != root[i]]
            if not len(them):
                continue
            for j in them[may_be_alike(sig[them], n[them], sig[i], n[i], percent)]:
                if root[j] != root[i] and alike(sets[i], sets[j]):
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
        return out

    def run(batches):
        held = None

        def flush(t):
            cols = {c: t.column(c).to_numpy() for c in ("crowd", "p", "q", "id", "comp", "n", "block")}
            sig = np.stack([np.frombuffer(v, np.uint16) for v in t.column("sig").to_pylist()])
            sets = [np.frombuffer(v, np.uint64) for v in t.column("set").to_pylist()]
            new = np.ones(len(sets) + 1, bool)
            new[1:-1] = (cols["crowd"][1:] != cols["crowd"][:-1]) | (cols["p"][1:] != cols["p"][:-1]) | (cols["q"][1:] != cols["q"][:-1])
            cut = np.flatnonzero(new)
            out = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                out += links(cols["id"][a:b], cols["comp"][a:b].copy(), cols["n"][a:b], sig[a:b], sets[a:b], cols["block"][a:b], cols["p"][a], cols["q"][a])
            x, y = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held.column(c)[held.num_rows - 1].as_py() for c in ("crowd", "p", "q")]
            cols = [held.column(c).to_numpy() for c in ("crowd", "p", "q")]
            whole = int(((cols[0] != last[0]) | (cols[1] != last[1]) | (cols[2] != last[2])).sum())
            if whole:
                yield flush(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield flush(held)

    blocks = members.groupBy("crowd").agg(F.count(F.lit(1)).alias("m")).select("crowd", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    m = members.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("crowd", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "comp", "n", "sig", "set", "block")
    parts = m.repartition("crowd", "p", "q").sortWithinPartitions("crowd", "p", "q", "id")
    return parts.mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id has to be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    all_rows = saved(sketch(docs, size))
    linked = all_rows.where("doc_id is not null and n > 0")
    nodes = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = saved(nodes)
    buckets = nodes.select(F.explode("bands").alias("key"), "id")
    crowded = buckets.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a")
    stars = saved(buckets.join(crowded, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    release(spark)
    near = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = full_sets(docs, near, near.count(), size)
    if linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").head(1):
        sets = sets.groupBy("id").agg(F.min("set").alias("set"))  # rows of one id count as one of their texts
    sets = saved(sets)
    release(spark)
    # one star a document, that of the smallest centre; the search of crowds finds what this leaves
    sure = saved(confirm(stars.groupBy("b").agg(F.min("a").alias("a")), sets, percent))
    labels = connected_components(sure)
    # all that share a bucket are one crowd; crowds of several components are searched member against member
    crowds = connected_components(stars).withColumnRenamed("comp", "crowd")
    seen = crowds.join(labels, "id", "left").select("crowd", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = seen.groupBy("crowd").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("crowd")
    one = nodes.groupBy("id").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    members = seen.join(mixed, "crowd").join(one, "id").join(sets, "id")
    more = saved(_rest_links(members, percent))
    release(spark)
    if more.head(1):
        labels = connected_components(sure.unionByName(more))
    of_set = nodes.select("k1", "k2", "id").join(labels, "id", "left").select("k1", "k2", F.coalesce("comp", "id").alias("comp"))
    out = all_rows.join(of_set, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("comp"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, all columns kept; of rows of equal id one.

    Documents without id are in no group and stay.
    """
    groups = near_duplicate_groups(docs, size, percent)
    name = spare("gone", docs.columns)
    gone = groups.where("doc_id is not null and not kept").select(F.col("doc_id").alias(name)).distinct()
    out = docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").head(1):
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
    return out
