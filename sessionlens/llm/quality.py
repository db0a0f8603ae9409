"""Quality by naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their class frequencies; a
linear hinge-loss model is fitted to the scaled indicators by dual coordinate
descent, and its margins become probabilities by a logistic curve fitted on a
fifth of the sample that the first fit left out.

n-grams: single words as written, and one to three neighbouring word shapes.  A
shape says which kinds of bytes a word holds, whether capitals fill it, how it
ends and whether it repeats one of the words just before: what separates prose
from tables, shouting, symbol noise and stutter whatever the vocabulary.

The fit takes at most `rows` labelled documents (a documented bound); every
document is scored on its whole text, however long.  With no labelled row, or
labels of one class only, every score follows the prior.  Null and empty texts
get the score of the bias.  Equal texts get equal scores and repeated rows a row
each; of documents labelled twice the smaller label counts; rows without id or
label aren't learned from, but scored; no rows give no rows.  Further columns
pass through `good_documents` whatever their names.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import bucket, features_of, held_out, labelled_sample, platt, with_scores
from .store import spare
from .text import U64, mix64, ngram_hashes, span_hashes, words

BITS = 18
LABELLED_ROWS = 8_000
LEAST_DOCUMENTS = 8

_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[97:123] = 1
_LETTER[65:91] = 1
_LETTER[128:] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1


def _count(table, buf, starts, ends):
    sums = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(table[buf], out=sums[1:])
    return sums[ends] - sums[starts]


def word_shapes(buf, starts, ends, rows, hashes):
    """A small number for each word."""
    size = (ends - starts).astype(np.int32)
    upper, letters, digits = (_count(t, buf, starts, ends) for t in (_UPPER, _LETTER, _DIGIT))
    marks = size - letters - digits
    last = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    back = np.zeros(len(hashes), np.int32)
    for d in (1, 2, 3):
        back[d:] |= ((hashes[d:] == hashes[:-d]) & (rows[d:] == rows[:-d])).astype(np.int32)
    kinds = [upper > 0, (upper > 1) & (upper >= 0.6 * letters), letters > 0, digits > 0, marks > 0, marks > 1, marks > 2, (last == 46) | (last == 44), back > 0, size > 24]
    return sum(k.astype(np.uint64) << U64(i) for i, k in enumerate(kinds)) if len(hashes) else np.zeros(0, np.uint64)


def quality_features(buf, offsets, bits):
    """Rows and feature numbers, repeated as often as they occur."""
    starts, ends, rows, _ = words(buf, offsets)
    h = span_hashes(buf, starts, ends)
    s = mix64(word_shapes(buf, starts, ends, rows, h) + U64(1))
    parts = [ngram_hashes(h, rows, 1), *(ngram_hashes(s, rows, k, seed=77) for k in (1, 2, 3))]
    return np.concatenate([p[1] for p in parts]), bucket(np.concatenate([p[0] for p in parts]), bits)


@dataclass(frozen=True)
class NbSvm:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float


def _views(flat, cut):
    """Rows of one block of memory, which goes back whole when they are done with."""
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _dual_descent(rows, y, ratio, c, epochs, seed):
    """Weights and bias of min |w|^2 / 2 + c sum max(0, 1 - y (w x + b)), one dual variable at a time.

    The bias is a constant feature of 1.
    """
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    scaled = _views(ratio[np.concatenate(rows)], np.cumsum([0, *map(len, rows)]))
    norm = np.array([x @ x + 1.0 for x in scaled])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            f, x = rows[k], scaled[k]
            g = y[k] * (w[f] @ x + b) - 1
            new = min(max(alpha[k] - g / norm[k], 0.0), c)
            if (d := (new - alpha[k]) * y[k]) != 0:
                w[f] += d * x
                b += d
                alpha[k] = new
                moved = max(moved, abs(d))
        if moved < 1e-4 * c:
            break
    return w, b


def fit_nbsvm(labels, rows, bits=BITS, c=0.02, smooth=1.0, epochs=12, seed=3) -> NbSvm:
    labels = np.asarray(labels)
    if not len(rows) or labels.min() == labels.max():
        p = (labels.sum() + 1) / (len(labels) + 2)
        return NbSvm(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    counts = [np.bincount(np.concatenate([rows[k] for k in np.flatnonzero(labels == v)]), minlength=1 << bits) for v in (0, 1)]
    known = counts[0] + counts[1] >= min(LEAST_DOCUMENTS, max(1, len(rows) // 10))
    p = [(k + smooth) / (n + 2 * smooth) for k, n in zip(counts, ((labels == 0).sum(), (labels == 1).sum()), strict=True)]
    ratio = np.where(known, np.log(p[1] / p[0]), 0.0)
    flat, cut = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    keep = known[flat]
    rows = _views(flat[keep], np.concatenate([[0], np.cumsum(keep)])[cut])
    y = np.where(labels == 1, 1.0, -1.0)
    fit, test = np.arange(len(rows)) % 5 != 0, np.arange(len(rows)) % 5 == 0
    if len(set(labels[fit])) < 2 or len(set(labels[test])) < 2:
        fit = test = np.ones(len(rows), bool)
    of = lambda mask: [rows[k] for k in np.flatnonzero(mask)]
    w, b = _dual_descent(of(fit), y[fit], ratio, c, epochs, seed)
    margins = np.array([(w[f] * ratio[f]).sum() + b for f in of(test)])
    slope, offset = platt(margins, (labels[test] == 1).astype(float))
    weight = w * ratio
    index = np.flatnonzero(weight)
    return NbSvm(index, weight[index].astype(np.float32), float(b), slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> NbSvm:
    sample = labelled_sample(docs, labels, "quality", ~held_out(3, 1), rows)
    return fit_nbsvm(*features_of(sample, quality_features, BITS))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    m = fit_quality(docs, labels, rows)
    out = with_scores(docs, ["doc_id"], quality_features, BITS, m.index, m.weight, m.bias, m.a, m.b)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """The documents that the classifier doesn't reject, all columns kept."""
    m = fit_quality(docs, labels, rows)
    name = spare("quality_score", docs.columns)
    out = with_scores(docs, docs.columns, quality_features, BITS, m.index, m.weight, m.bias, m.a, m.b, name)
    return out.where(F.col(name) >= 0.5).drop(name)
