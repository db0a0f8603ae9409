"""SpotSigs document fingerprints, by DataFrame functions only.

A spot is a common word (the anchor) with a content word right after it; its
signature is the chain of that and the following content words, `CHAIN` in all,
common words between them skipped.  Natural prose is full of spots where
navigation, tables and lists have few.  A document's fingerprint is its sorted
set of spot hashes; likeness is the Jaccard similarity of two sets.  A text
without spots has one signature, of its whole normalised text, so that equal
texts are always alike.

The fingerprint query compares the pairs that it is given, each document with its
edited text and with the next document.  `similar_pairs` compares all documents: equal sets become one class; classes are
partitioned by set length so that only lengths within the threshold of one
another meet, candidates share a signature among the rarest few of both (prefix
filter, exact), and the bound on the overlap prunes before the sets are compared.

Null texts count as empty, and empty ones have one signature; texts of any length
are taken whole.  Ids have to be whole numbers, or texts that hold one (an error else).
Rows of equal or null id are ordered by text; nulls come first.  Repeated rows are rows
of their own.  No rows give no rows.  Only doc_id and text are read, so further columns
of any name don't matter.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = 2
ROWS_A_BUCKET = 20_000
#: Beyond MOST_BUCKETS * ROWS_A_BUCKET rows the buckets hold more rows each, and their sorts spill.
LEAST_BUCKETS, MOST_BUCKETS = 96, 16_384

# Common words that serve as anchors.
ANCHORS = (
    "the a an of and to in is that it for on was be with as by this are at from or not have he she they which you we his her "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de et un une du des que en au aux pour dans ce il qui ne sur se pas plus par je avec tout "
    "el los las y del se por con para su al lo como más pero sus ya o si"
).split()


def _trie_pattern(words: list[str]) -> str:
    """An alternation that shares prefixes, so that a word is tried letter by letter."""

    def build(tails: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for t in tails:
            if t:
                heads.setdefault(t[0], []).append(t[1:])
        parts = [c + build(rest) for c, rest in sorted(heads.items())]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in tails else f"(?:{'|'.join(parts)})"
        return f"{body}?" if "" in tails else body

    return build(sorted(set(words)))


def spot_set(text: Column) -> Column:
    """Sorted distinct 64-bit spot hashes of a text."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(plain, f" {_trie_pattern(ANCHORS)}(?= )", " ·")
    chain = r"[^ ·]+ " + r"(?:· )*+[^ ·]+ " * (CHAIN - 1)
    found = F.regexp_extract_all(marked, F.lit(f"· (?=({chain}))"), F.lit(1))
    spots = F.array_sort(F.array_distinct(F.transform(found, lambda s: F.xxhash64(F.replace(s, F.lit("· "), F.lit(""))))))
    return F.when(F.size(spots) > 0, spots).otherwise(F.array(F.xxhash64(F.trim(plain))))


def fingerprint(spots: Column) -> Column:
    """Eight hexadecimal digits a spot."""
    return F.array_join(F.transform(spots, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """df plus _bucket: ascending ranges of `key` with about as many rows each."""
    rows = df.count()
    n = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-rows // ROWS_A_BUCKET)))
    cuts = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n).alias("c")).head()["c"] or []
    cuts = sorted(set(cuts))
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    if not groups:
        return df.withColumn("_bucket", F.lit(0))
    heads = F.array(*(F.lit(g[0]) for g in groups))
    tails = F.array(*(F.array(*map(F.lit, g)) for g in groups))
    k = F.col(key)
    group = F.size(F.filter(heads, lambda h: h <= k))
    within = F.size(F.filter(F.element_at(tails, F.greatest(group, F.lit(1))), lambda h: h <= k))
    return df.withColumn("_bucket", F.when(k.isNull() | (group == 0), 0).otherwise((group - 1) * step + within).cast("int"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, spots of every document with next_text, next_spots: those of the next by ascending key; the first after the last.

    Documents are sorted within ranges of the key; each range also gets a copy of the
    next range's first document, so no sort spans all rows.
    """
    slim = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    slim = _bucketed(slim, "_key")
    first = F.min(F.struct(F.col("_key").isNotNull().alias("has"), "_key", "_text")).alias("f")
    heads = slim.groupBy("_bucket").agg(first)
    there = sorted(r[0] for r in slim.select("_bucket").distinct().collect())  # at most MOST_BUCKETS numbers
    before = docs.sparkSession.createDataFrame([(b, there[i - 1]) for i, b in enumerate(there)], "_bucket int, _to int")
    extra = heads.join(before, "_bucket").select(F.lit(1).alias("_extra"), F.col("f._key").alias("_key"), F.col("f._text").alias("_text"), F.col("_to").alias("_bucket"))
    rows = slim.select(F.lit(0).alias("_extra"), "_key", "_text", "_bucket").unionByName(extra)
    # spots follow the shuffle, which the window takes over: texts alone travel
    rows = rows.repartition("_bucket").sortWithinPartitions("_bucket", "_extra", "_key", "_text").withColumn("_spots", spot_set(F.col("_text")))
    w = Window.partitionBy("_bucket").orderBy("_extra", "_key", "_text")
    rows = rows.withColumns({"_next": F.lead("_text").over(w), "_next_spots": F.lead("_spots").over(w)}).where("_extra = 0")
    return rows.select(F.col("_key").alias(key), F.col("_text").alias(text), F.col("_spots").alias("spots"), F.col("_next").alias("next_text"), F.col("_next_spots").alias("next_spots"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    df = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), "spots", edited.alias("edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))
    df = df.withColumn("edited_spots", spot_set(F.col("edited")))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        "near_next",
        F.size("spots").alias("n_spots"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b of class ids with their likeness; membership doc_id, class_id): every pair of classes at the threshold or above.

    A class is all documents with one set; its id is the smallest doc_id.  Documents without id have no class.
    """
    sets = docs.where(F.col("doc_id").isNotNull()).select("doc_id", spot_set(F.coalesce(F.col("text"), F.lit(""))).alias("spots"))
    classes = sets.groupBy("spots").agg(F.min("doc_id").alias("id"))
    members = sets.join(classes, "spots").select("doc_id", F.col("id").alias("class_id"))
    classes = classes.groupBy("id").agg(F.min("spots").alias("spots"))
    long = classes.select("id", F.explode("spots").alias("s"))
    rare = long.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = long.join(rare, "s").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("by_rarity"))
    n = F.size("by_rarity")
    prefix = F.slice("by_rarity", F.lit(1), n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1)
    base = math.log(1 / threshold) or 1e-9
    band = F.floor(F.log(n.cast("double")) / base).cast("int")  # lengths within the threshold are at most one partition apart
    index = ranked.select("id", n.alias("n"), band.alias("band"), F.explode(prefix).alias("s"))
    left = index.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "s", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = index.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "s", "band")
    near = left.join(right, ["s", "band"]).where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))).select("a", "b").distinct()
    full = near.join(classes.select(F.col("id").alias("a"), F.col("spots").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("spots").alias("y")), "b")
    return full.select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= threshold), members
