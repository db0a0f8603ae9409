"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are maximal runs of ASCII letters, digits and bytes beyond ASCII, in lower
case.  Features: words, stems (the first four and five bytes of longer words),
pairs of neighbours, pairs with one word between.  Each
coordinate has its own learning rate; the L1 term keeps most weights at exactly
zero, so the model that travels with the tasks is small.

Scores are calibrated: margins of each third of the sample, under a model of the
other two, give a logistic curve; its offset is moved half the way to equally
frequent labels, as toxic texts are rare and few of them are known.

The model is fitted on a bounded sample, LABELLED_ROWS labelled documents of
SAMPLE_BYTES together at most; every document is scored on its whole text, however
long.  With no labelled row every score is the prior of 0.5.  Null and empty texts
get the score of the bias.  Equal texts get equal scores and repeated rows a row
each; of documents labelled twice the smaller label counts; rows without id or
label aren't learned from, but scored; no rows give no rows.  Only doc_id, text and
the label are read, so further columns of any name don't matter.
"""

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import bucket, features_of, held_out, labelled_sample, platt, with_scores
from .text import LOWER, ngram_hashes, span_hashes, words

BITS = 20
LABELLED_ROWS = 8_000
FOLDS = 3
STEMS = (4, 5)
THRESHOLD = 0.7


def toxic_features(buf, offsets, bits):
    """Rows and feature numbers, repeated as often as they occur."""
    low = LOWER[buf]
    plain = np.where((low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)), low, np.uint8(32))
    starts, ends, rows, _ = words(plain, offsets)
    h = span_hashes(plain, starts, ends)
    parts = [ngram_hashes(h, rows, 1)]
    for size in STEMS:
        long = ends - starts > size
        parts.append(ngram_hashes(span_hashes(plain, starts[long], starts[long] + size), rows[long], 1, seed=size))
    parts += [ngram_hashes(h, rows, 2), ngram_hashes(h, rows, 2, skip=1)]
    return np.concatenate([p[1] for p in parts]), bucket(np.concatenate([p[0] for p in parts]), bits)


@dataclass(frozen=True)
class Ftrl:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def margins(self, rows, bits):
        table = np.zeros(1 << bits, np.float32)
        table[self.index] = self.weight
        return np.array([table[f].sum() for f in rows]) + self.bias


def fit_ftrl(labels, rows, bits=BITS, alpha=1.0, beta=1.0, l1=4.0, l2=0.01, epochs=5, seed=5) -> Ftrl:
    """FTRL-proximal: w = -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2) where |z| > l1, else 0.

    The bias is a coordinate without the L1 term.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(rows) else 0):
        for k in rng.permutation(len(rows)):
            f, y = rows[k], labels[k]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) > l1, (np.sign(zf) * l1 - zf) / ((beta + np.sqrt(nf)) / alpha + l2), 0.0)
            wb = -zb / ((beta + nb**0.5) / alpha + l2)
            p = 1 / (1 + np.exp(-min(60.0, max(-60.0, wb + w.sum()))))
            g = p - y
            new = nf + g * g
            z[f] = zf + g - (np.sqrt(new) - np.sqrt(nf)) / alpha * w
            n[f] = new
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    index = np.flatnonzero(w)
    return Ftrl(index, w[index].astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha + l2)))


def fit_calibrated(labels, rows, bits=BITS) -> Ftrl:
    labels = np.asarray(labels)
    m = fit_ftrl(labels, rows, bits)
    if not len(rows) or labels.min() == labels.max():
        return m
    fold, margins = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        mine = np.flatnonzero(fold == k)
        if len(rest) and len(mine):
            margins[mine] = fit_ftrl(labels[rest], [rows[j] for j in rest], bits).margins([rows[j] for j in mine], bits)
    a, b = platt(margins, (labels == 1).astype(float))
    toxic = (labels == 1).mean()
    return replace(m, a=a, b=b + float(np.log((1 - toxic) / toxic)) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Ftrl:
    sample = labelled_sample(docs, labels, "toxic", ~held_out(3, 1), rows)
    return fit_calibrated(*features_of(sample, toxic_features, BITS))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    m = fit_toxicity(docs, labels, rows)
    out = with_scores(docs, ["doc_id"], toxic_features, BITS, m.index, m.weight, m.bias, m.a, m.b)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
