"""What the two linear text classifiers share: labelled samples, hashed features, scoring.

Features are indicators: a document holds a feature or not.  Their hashes come
from whole texts.  A model is a sorted array of feature numbers with weights, so
it is small enough to travel with the task (its size is bounded by `2 ** bits`).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches
from .text import U64, utf8_chunks


def held_out(parts: int, out: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(parts)) == out


SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, most_bytes: int = SAMPLE_BYTES, seed: int = 11) -> DataFrame:
    """At most `rows` labelled documents (doc_id, text, label) of `most_bytes` together, chosen by a hash of doc_id among those that `keep` admits.

    Documents are taken whole in order of the hash; one that doesn't fit any more is
    passed over, and smaller ones after it are still taken.  If there are labelled
    documents and none fits, that is an error.  Of documents labelled twice the smaller
    label counts.  Rows without id or label are left out.
    """
    small_batches(docs.sparkSession)
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    ids = ids.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    ids = ids.orderBy(*order).limit(rows)
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(ids), "doc_id")  # `rows` ids at most
    sizes = sizes.groupBy("doc_id", "label").agg(F.sum("size").alias("size")).orderBy(*order).collect()  # `rows` numbers at most
    fits, room = [], most_bytes
    for r in sizes:
        if r["size"] <= room:
            fits.append((r["doc_id"], r["label"]))
            room -= r["size"]
    if sizes and not fits:
        raise ValueError(f"none of {len(sizes)} labelled documents is within {most_bytes} bytes")
    fits = docs.sparkSession.createDataFrame(fits, T.StructType([T.StructField("doc_id", ids.schema["doc_id"].dataType), T.StructField("label", T.IntegerType())]))
    return docs.select("doc_id", "text").join(F.broadcast(fits), "doc_id")


def bucket(hashes, bits):
    return (hashes >> U64(64 - bits)).astype(np.int64)


def distinct(rows, features, bits):
    """Distinct (row, feature) pairs, ordered."""
    both = np.unique((rows << bits) | features)
    return both >> bits, both & ((1 << bits) - 1)


def features_of(df: DataFrame, featurise, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and distinct feature numbers of a bounded sample, brought to the driver in order of doc_id."""

    def run(batches):
        for batch in batches:
            for lo, buf, offsets in utf8_chunks(batch.column("text")):
                n = len(offsets) - 1
                r, f = distinct(*featurise(buf, offsets, bits), bits)
                cut = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n).cast(pa.int64()), batch.column("label").slice(lo, n), lists], ["doc_id", "label", "f"])

    got = df.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, f array<int>").toArrow().sort_by("doc_id")
    column = got.column("f").combine_chunks()
    flat, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return got.column("label").to_numpy(), [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def with_scores(df: DataFrame, keep: list[str], featurise, bits: int, index: np.ndarray, weight: np.ndarray, bias: float, a: float, b: float, out: str = "score") -> DataFrame:
    """The columns `keep` of df and score = 1 / (1 + exp(-(a * margin + b))) of every row.

    The margin sums the weights of the distinct features of `text`; a null or empty
    text has the margin of the bias alone.
    """
    small_batches(df.sparkSession)

    def run(batches):
        table = np.zeros(1 << bits, np.float32)
        table[index] = weight
        for batch in batches:
            margin = np.empty(batch.num_rows)
            for lo, buf, offsets in utf8_chunks(batch.column("text")):
                n = len(offsets) - 1
                r, f = featurise(buf, offsets, bits)
                some = table[f] != 0
                r, f = distinct(r[some], f[some], bits)
                margin[lo : lo + n] = bias + np.bincount(r, weights=table[f], minlength=n)[:n]
            scores = pa.array(1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], [*keep, out])

    read = df.select(*dict.fromkeys([*keep, "text"]))
    return read.mapInArrow(run, T.StructType([df.schema[c] for c in keep]).add(out, "double"))


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by damped Newton steps.

    Labels are drawn towards the middle by one case of each class, so the curve stays
    finite where margins part the classes.
    """
    ones, size = labels.sum(), len(labels)
    target = np.where(labels > 0.5, (ones + 1) / (ones + 2), 1 / (size - ones + 2))
    unit = max(float(np.std(margins)), 1e-9)
    x, at = margins / unit, np.array([1.0, 0.0])
    loss = lambda at: (np.logaddexp(0, at[0] * x + at[1]) - target * (at[0] * x + at[1])).sum()
    now = loss(at)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -60, 60)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        h = np.array([[(v * x * x).sum() + 1e-9, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step, share = np.linalg.solve(h, g), 1.0
        while share > 1e-6 and loss(at - share * step) > now:
            share /= 2
        at = at - share * step
        before, now = now, loss(at)
        if before - now < 1e-10:
            break
    return float(at[0] / unit), float(at[1])
