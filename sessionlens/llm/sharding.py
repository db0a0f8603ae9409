"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Rows first fall into source partitions by a hash of their key.  The matrix says
how many rows each source partition sends to each shard; it is drawn exactly
from the multivariate hypergeometric law, so that the whole is a uniformly
random assignment with shard sizes fixed beforehand.  Each source partition
permutes its rows by keyed hashes and deals them by its line of the matrix; each
shard permutes what it got once more, in key-ranged pieces, which gives slots.

Only row counts reach the driver: (source partitions x shards) numbers.  Every
draw is a function of seed and data, so a recomputed task gives the same rows.
Null keys, null, empty and very long texts and repeated rows are dealt like
others: ties are broken by the columns named for that, and rows equal in all of
them are interchangeable.  Other columns pass through whatever their names; no
rows give no rows.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_A_PIECE = 1_000_000
LEAST_PIECES = 96
NUMPY_LIMIT = 500_000_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Row counts at most one apart."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows sent from each source partition to each shard, drawn exactly."""
    rng = np.random.default_rng(seed)
    left, matrix = np.array(sizes, np.int64), np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        # one conditional hypergeometric draw for each shard
        need, pool = int(n), int(left.sum())
        for s in range(len(left)):
            pool -= int(left[s])
            got = need if pool == 0 else hypergeometric(rng, int(left[s]), pool, need)
            matrix[p, s] = got
            need -= got
        left -= matrix[p]
    return matrix


def hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """How many of `draws` drawn without replacement are good, at any size.

    numpy's own draw ends at populations of 1e9.  Beyond, every element is first
    taken with the probability draws / population, which is two binomial draws; a set
    so taken is uniform among those of its size.  What it lacks is then drawn
    from the elements left, what it has too many from those taken: again
    hypergeometric, with the root of the number of draws.
    """
    draws, good, bad = int(draws), int(good), int(bad)
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good < NUMPY_LIMIT and bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    if draws <= 32:
        got = 0
        for k in range(draws):
            got += int(rng.integers(good + bad - k) < good - got)
        return got
    share = draws / (good + bad)
    x, y = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    if x + y <= draws:
        return x + hypergeometric(rng, good - x, bad - y, draws - x - y)
    return x - hypergeometric(rng, x, y, x + y - draws)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows or [], schema)


def shard_rows(df: DataFrame, key: str, shards: int = 24, seed: int = 7, ties: list[str] | None = None) -> DataFrame:
    """df plus `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard); columns of these names are replaced.

    ties: further columns that tell rows of one key apart.
    """
    spark = df.sparkSession
    every = df.columns
    key_and_ties = [F.col("row")[c] for c in (key, *(ties or []))]
    draw = lambda n: F.xxhash64(F.lit(seed), F.lit(n), *key_and_ties)
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in every)).alias("row"))  # so that no name clashes
    total = df.count()
    pieces = max(LEAST_PIECES, -(-total // ROWS_A_PIECE))
    dealt = packed.withColumns({"part": F.pmod(draw(1), F.lit(pieces)).cast("int"), "draw": draw(2)})
    found = {r[0]: r[1] for r in dealt.groupBy("part").count().collect()}  # one number a piece
    counts = [found.get(p, 0) for p in range(pieces)]
    matrix = communication_matrix(counts, shard_sizes(total, shards), seed)
    ends = np.cumsum(matrix, axis=1)
    bounds = _table(spark, [(p, [int(x) for x in ends[p]]) for p in range(pieces)], "part int, ends array<long>")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("draw", *key_and_ties))
    sent = dealt.withColumn("rank", rank).join(bounds, "part")
    sent = sent.select("row", F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int").alias("shard"))
    # exchange, then the second permutation in pieces of the draw's range
    subs = max(8, -(-total // (shards * ROWS_A_PIECE)))
    again = sent.withColumns({"again": draw(3), "sub": F.pmod(draw(4), F.lit(subs)).cast("int")})
    tally = {(r[0], r[1]): r[2] for r in again.groupBy("shard", "sub").count().collect()}
    starts = []
    for s in range(shards):
        at = 0
        for u in range(subs):
            if n := tally.get((s, u)):
                starts.append((s, u, at))
                at += n
    base = _table(spark, starts, "shard int, sub int, start long")
    place = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("again", *key_and_ties))
    out = again.withColumn("place", place).join(base, ["shard", "sub"])
    kept = [F.col("row")[c].alias(c) for c in every if c.lower() not in ("shard", "slot")]
    return out.select(*kept, "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """What the query returns of `shard_rows` over documents; null texts have no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = shard_rows(slim, "doc_id", shards, seed, ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
