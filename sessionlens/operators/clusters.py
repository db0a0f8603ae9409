"""Failures grouped by root cause: exact fingerprints first, similar text for the rest.

Texts that tell no error share one group.  The rest are clustered by density over
the cosine similarity of their word and character n-gram weights; noise stands
alone.  Equal normalised texts are one text with a multiplicity; pairs meet
through an inverted index of their rare terms, in bands and blocks of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.text import cluster_label, fingerprint, has_error, normalize, root_exception
from ..settings import SETTINGS, Settings
from .graph import components, kept

BANDS, BLOCK = 8, 1_000
EXAMPLES, PARTS = 100, 64


def _word_grams(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.transform(F.filter(pairs, lambda p: p.isNotNull()), lambda p: F.concat(F.lit("w:"), p)))


def _char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Grams of each word with a space on both sides; a padded word no longer than the gram counts once, whole."""

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(w)
        every = []
        for n in range(low, high + 1):
            # a word that fits the gram counts once; longer grams of it are left out
            every.append(F.when((size >= n) | (F.lit(n) == low), _grams(w, size, n)).otherwise(F.array().cast("array<string>")))
        return F.concat(*every)

    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")
    return F.transform(F.flatten(F.transform(words, of)), lambda g: F.concat(F.lit("c:"), g))


def _grams(w: Column, size: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))


def term_weights(texts: DataFrame) -> DataFrame:
    """id, term, w: unit vectors of texts (id, text, m: how many rows have this text).

    Word and character blocks are normalised each for itself, then together.
    """
    terms = texts.select("id", "m", F.explode(F.concat(_word_grams(F.col("text")), _char_grams(F.col("text")))).alias("term"))
    tf = terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"), F.first("m").alias("m"))
    df = tf.groupBy("term").agg(F.sum("m").alias("df"))
    n = texts.agg(F.sum("m").alias("n"))
    w = tf.join(df, "term").join(F.broadcast(n), F.lit(True))  # one row
    w = w.withColumn("w", (1 + F.log("c")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).withColumn("block", F.left("term", F.lit(1)))
    norms = w.groupBy("id", "block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = w.join(norms, ["id", "block"]).withColumn("w", F.col("w") / F.col("norm"))
    blocks = norms.groupBy("id").agg(F.count(F.lit(1)).alias("blocks"))
    return unit.join(blocks, "id").select("id", "term", (F.col("w") / F.sqrt("blocks")).alias("w"))


def heads(w: DataFrame, least: float) -> DataFrame:
    """id, term, w, tail, after: where a text may meet another with a similarity of `least` or more first.

    Each unit vector is put in order of its terms' rarity; `tail` is the length of what
    is left of it from a term on, `after` without that term.  Where the tail is shorter than
    `least` a text can't be similar enough to one that shares nothing before, as that
    one's rest has length 1 at most.
    """
    rarity = w.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = Window.partitionBy("id").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    # terms of one text alone are the rarest and meet nobody, so they needn't be kept
    square = F.sum(F.col("w") * F.col("w")).over(order)
    out = w.join(rarity, "term").withColumn("square", square).where(F.col("square") >= least * least - 1e-9)
    return out.select("id", "term", "w", F.sqrt("square").alias("tail"), F.sqrt(F.greatest(F.col("square") - F.col("w") * F.col("w"), F.lit(0.0))).alias("after"))


def candidate_pairs(index: DataFrame, least: float) -> DataFrame:
    """a, b (a < b): pairs of heads that share a term and may be similar enough.

    At the rarest term that two texts share their similarity is at most the product of their
    tails there.  Tails are dealt to bands, and a term's list is read by pairs of bands
    whose product can reach `least`; common terms stand late in their texts, with
    short tails, so most of their lists never meet.  What does meet is cut into
    blocks: a pair of blocks is one group, so no term makes a large one.
    """
    width = max(math.log(1 / max(least, 1e-3)), 1e-9) / BANDS  # tails lie between least and 1
    band = F.least(F.greatest(F.floor(F.log(F.col("tail") / least) / width), F.lit(0)), F.lit(BANDS - 1)).cast("int")
    placed = index.withColumn("band", band)
    sizes = placed.groupBy("term", "band").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # of a term's bands those that can meet: the tops of two bands multiply to least or more
    other = sizes.select("term", F.col("band").alias("band2"), blocks.alias("blocks2"))
    meet = sizes.select("term", "band", blocks.alias("blocks")).join(other, "term").where((F.col("band") <= F.col("band2")) & (F.col("band") + F.col("band2") + 2 >= BANDS))
    # a pair of bands is read once: every block of one against every block of the other
    left = placed.join(meet, ["term", "band"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = left.select("term", "band", "band2", "i", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)).alias("j"), F.col("id").alias("x"), F.col("w").alias("wx"), F.col("tail").alias("tx"), F.col("after").alias("ax"))
    right = placed.withColumnRenamed("band", "band2").join(meet, ["term", "band2"]).withColumn("j", F.pmod(F.xxhash64("id"), F.col("blocks2")).cast("int"))
    right = right.select("term", "band", "band2", "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("id").alias("y"), F.col("w").alias("wy"), F.col("tail").alias("ty"), F.col("after").alias("ay"))
    most = F.col("wx") * F.col("wy") + F.col("ax") * F.col("ay")
    both = left.join(right, ["term", "band", "band2", "i", "j"]).where((F.col("x") != F.col("y")) & ((F.col("band") != F.col("band2")) | (F.col("x") < F.col("y"))) & (most >= least - 1e-9))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_texts(w: DataFrame, least: float) -> DataFrame:
    """a, b (a < b): unit vectors (id, term, w) with a cosine similarity of `least` or more."""
    w = kept(w)
    pairs = candidate_pairs(kept(heads(w, least)), least)
    both = pairs.join(w.select(F.col("id").alias("a"), "term", F.col("w").alias("x")), "a").join(w.select(F.col("id").alias("b"), "term", F.col("w").alias("y")), ["b", "term"])
    return both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s")).where(F.col("s") >= least - 1e-12).select("a", "b")


def text_components(texts: DataFrame, w: DataFrame, eps: float, min_samples: int = 2) -> DataFrame:
    """id, comp, noise: density clusters of texts (id, m) with unit vectors w at a cosine distance of eps; what is in none is noise.

    A text is a core if at least min_samples rows, its own m counted, are as near.  Cores
    near one another are one cluster; another text near cores joins the cluster of least id.
    """
    near = kept(similar_texts(w.join(texts.select("id"), "id", "left_semi"), 1 - eps))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(texts.select(F.col("id").alias("b"), F.col("m").alias("k")), "b").groupBy(F.col("a").alias("id")).agg(F.sum("k").alias("k"))
    core = texts.join(around, "id", "left").where(F.col("m") + F.coalesce("k", F.lit(0)) >= min_samples).select("id")
    core = kept(core)
    edges = near.join(core.select(F.col("id").alias("a")), "a").join(core.select(F.col("id").alias("b")), "b")
    own = core.join(components(edges.select("a", "b")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    border = both.join(own.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("least"))
    out = texts.select("id").join(own, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("comp", "least", "id").alias("comp"), F.coalesce("comp", "least").isNull().alias("noise"))


def assign_clusters(sessions: DataFrame, settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """(the failures that give a reason, with fingerprint, normalised text, and a group key; id, term, w of their texts).

    Term weights come from the texts of all these failures, those with a fingerprint too;
    then the ones without are compared by them.
    """
    f = sessions.where(F.col("is_failure") & (F.length("reason") > 0)).withColumns({"fp": fingerprint(F.col("reason"), settings.package_hints), "norm": normalize(F.col("reason")), "signal": has_error(F.col("reason"))})
    kind = F.when(F.col("fp") != "", "signature").when(~F.col("signal"), "low").otherwise("text")
    f = kept(f.withColumn("kind", kind))
    texts = kept(f.groupBy("norm").agg(F.min("row_id").alias("id"), F.count(F.lit(1)).alias("m"), F.count_if(F.col("kind") == "text").alias("loose")))
    w = kept(term_weights(texts.select("id", F.col("norm").alias("text"), "m")))
    comp = text_components(texts.where("loose > 0").select("id", F.col("loose").alias("m")), w, settings.eps, settings.min_samples)
    of_text = texts.join(comp, "id", "left").select("norm", "id", F.when(~F.col("noise"), F.col("comp")).alias("comp"))
    out = f.join(of_text.withColumnRenamed("id", "text_id"), "norm", "left")
    # each row of noise stands alone
    key = F.when(F.col("kind") == "signature", F.concat(F.lit("s:"), "fp")).when(F.col("kind") == "low", F.lit("l:")).when(F.col("comp").isNotNull(), F.concat(F.lit("t:"), F.col("comp").cast("string"))).otherwise(F.concat(F.lit("n:"), F.col("row_id").cast("string")))
    return out.withColumn("cluster_key", key).drop("loose"), w


def number_clusters(assigned: DataFrame) -> DataFrame:
    """cluster_key, cluster_id: signatures first, then texts, then the one without signal, each in order of first appearance.

    Clusters are sorted in ranges; what lies before a range comes from the ranges' counts.
    """
    first = assigned.groupBy("cluster_key").agg(F.min("row_id").alias("first"), F.first("kind").alias("kind"))
    order = F.when(F.col("kind") == "signature", 0).when(F.col("kind") == "text", 1).otherwise(2)
    ranged = first.select("cluster_key", order.alias("k"), "first").repartitionByRange("k", "first").withColumn("part", F.spark_partition_id())
    ranged = kept(ranged)
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("k", "first"))
    return ranged.withColumn("at", at).join(F.broadcast(starts), "part").select("cluster_key", (F.col("start") + F.col("at") - 1).cast("int").alias("cluster_id"))


def confidence(assigned: DataFrame, w: DataFrame) -> DataFrame:
    """cluster_key, confidence: mean similarity of all pairs of a cluster's rows (text_id), by unit vectors w.

    For unit vectors that is (|sum|^2 - k) / (k (k - 1)), so one aggregation by
    term serves, whatever the size; 1 for a single row.
    """
    per = assigned.groupBy("cluster_key", F.col("text_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    sums = per.join(w, "id").groupBy("cluster_key", "term").agg(F.sum(F.col("k") * F.col("w")).alias("s"))
    square = sums.groupBy("cluster_key").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    # texts without any term are zero vectors
    size = per.join(w.select("id").distinct(), "id", "left_semi").groupBy("cluster_key").agg(F.sum("k").alias("unit"))
    rows = per.groupBy("cluster_key").agg(F.sum("k").alias("k"))
    out = rows.join(square, "cluster_key", "left").join(size, "cluster_key", "left")
    mean = (F.coalesce("ss", F.lit(0.0)) - F.coalesce("unit", F.lit(0))) / (F.col("k") * (F.col("k") - 1))
    return out.select("cluster_key", F.when(F.col("k") > 1, mean).otherwise(1.0).alias("confidence"))


def count_clusters(sessions: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """One row: how many clusters there are; labels, examples and confidence aren't made for it."""
    assigned, _ = assign_clusters(sessions, settings)
    return assigned.select("cluster_key").distinct().agg(F.count(F.lit(1)).alias("num_root_causes"))


def _members(rows: DataFrame, examples: int | None) -> DataFrame:
    """cluster_key, session_ids and session_urls in order of appearance: the first `examples`, or all."""
    if examples is not None:
        # a cluster's first rows are sought within parts of it, so no task reads a whole one
        part = Window.partitionBy("cluster_key", F.pmod(F.xxhash64("row_id"), F.lit(PARTS))).orderBy("row_id")
        ids = rows.withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= examples)
        urls = rows.where("session_url <> ''").withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= examples)
    else:
        ids, urls = rows, rows.where("session_url <> ''")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("row_id", c))), lambda x: x[c])
    cut = (lambda c: F.slice(c, 1, examples)) if examples is not None else (lambda c: c)
    one = ids.groupBy("cluster_key").agg(cut(listed("session_id")).alias("session_ids"))
    two = urls.groupBy("cluster_key").agg(cut(listed("session_url")).alias("session_urls"))
    return one.join(two, "cluster_key", "left").withColumn("session_urls", F.coalesce("session_urls", F.array().cast("array<string>")))


def cluster_failures(sessions: DataFrame, settings: Settings = SETTINGS, examples: int | None = EXAMPLES) -> tuple[DataFrame, DataFrame]:
    """(clusters, largest first; failures with cluster_id).

    A cluster's row names its first `examples` sessions, all with None; the second table
    has every one, and `size` counts them.
    """
    assigned, w = assign_clusters(sessions, settings)
    assigned = kept(assigned)
    ids = number_clusters(assigned)
    with_ids = assigned.join(ids, "cluster_key")
    rolled = with_ids.groupBy("cluster_key", "cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("reason", "row_id").alias("example_reason"), F.min_by("fp", "row_id").alias("fp"), F.first("kind").alias("kind"),
        F.array_sort(F.collect_set(F.nullif(F.col("app_version"), F.lit("")))).alias("app_versions"),
    )
    label = F.when(F.col("kind") == "low", fixed.LOW_SIGNAL_LABEL).when(F.col("fp") != "", F.col("fp")).otherwise(cluster_label(F.col("example_reason")))
    out = rolled.join(confidence(assigned, w), "cluster_key").join(_members(assigned, examples), "cluster_key").select(
        "cluster_id", label.alias("label"), "size", F.round("confidence", 3).alias("confidence"), root_exception(F.col("example_reason")).alias("exception_type"), "session_ids", "session_urls", "app_versions", "example_reason"
    )
    return out.orderBy(F.desc("size"), "cluster_id"), with_ids.drop("cluster_key", "comp", "kind", "signal", "text_id")


def cluster_sessions(failures: DataFrame, cluster_ids: list[int]) -> DataFrame:
    """cluster_id, row_id, session_id, session_url of the clusters asked for, from the membership table.

    Written with `write_members`, the table is read by the ranges of cluster_id that are asked for.
    """
    return failures.where(F.col("cluster_id").isin(cluster_ids)).select("cluster_id", "row_id", "session_id", "session_url")


def write_members(failures: DataFrame, path: str) -> None:
    """The membership table in order of cluster and appearance, so that a cluster's rows lie side by side in few files."""
    rows = failures.select("cluster_id", "row_id", "session_id", "session_url")
    rows.repartitionByRange("cluster_id", "row_id").sortWithinPartitions("cluster_id", "row_id").write.mode("overwrite").parquet(path)


def label_clusters(failures: DataFrame, classified: DataFrame) -> DataFrame:
    """cluster_id, category, owner: the commonest category of its sessions; of equally common ones that met first."""
    both = failures.select("cluster_id", "session_id", "row_id").join(classified.select("session_id", "category", "owner"), "session_id")
    counts = both.groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.first("owner").alias("owner"))
    best = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rn", best).where("rn = 1").select("cluster_id", "category", "owner")


def chart_rows(clusters: DataFrame, top: int = 12) -> DataFrame:
    """label, failures, confidence of the largest clusters and one row for all smaller ones."""
    slim = clusters.select("cluster_id", "label", "size", "confidence")
    best = kept(slim.orderBy(F.desc("size"), "cluster_id").limit(top))
    rn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "cluster_id"))  # `top` rows
    named = best.select(rn.alias("rn"), F.concat(F.lit("#"), F.col("cluster_id").cast("string"), F.lit(": "), "label").alias("label"), F.col("size").alias("failures"), "confidence")
    rest = slim.join(F.broadcast(best.select("cluster_id")), "cluster_id", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("failures"), F.avg("confidence").alias("confidence")).where("n > 0")
    other = rest.select(F.lit(top + 1).alias("rn"), F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" smaller")).alias("label"), "failures", "confidence")
    return named.unionByName(other).orderBy("rn")
