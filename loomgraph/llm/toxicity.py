"""Toxicity: a linear classifier over character n-grams scaled by naive-Bayes log-count ratios.

Features are the distinct 3- to 6-grams of characters of the lower-cased text (white space and
punctuation collapse to one blank), hashed into 2**20 buckets.  On a sample of at most
``max_train`` labelled documents (those with the smallest hash of their id; the bound is a parameter)
the log-count ratio r of each feature is taken; features seen in fewer than ``min_docs`` documents or
with \\|r\\| below ``min_ratio`` get weight 0.  Logistic regression over the indicator times r is fitted in
numpy, and the cut is the score with the best F1 on a fifth of the sample held out from the fit.

Defined results: null, empty and very short texts, which have no n-gram, have toxicity 0 and are never toxic; labels
that are null, or that name no document, are left out; of copies of one labelled id those with the smallest hash of the text count; repeated rows score alike; where the labels
hold fewer than two classes nothing is toxic and every score is 0; whole texts are scored whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import fresh

BITS, SIZES = 20, (3, 4, 5, 6)
MAX_TRAIN = 8192


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    cut: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, bucket) of every character n-gram of every text, in text order, with repeats."""
    n_docs = len(texts)
    low = K.lower(texts)
    raw, off = K.raw_bytes(low)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    cuts = lead[off]
    word = (chars >= 128) | ((chars >= 97) & (chars <= 122)) | ((chars >= 48) & (chars <= 57))
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(cuts))
    blank = ~word
    keep = word.copy()
    keep[1:] |= blank[1:] & (word[:-1] | (doc[1:] != doc[:-1]))
    if len(keep):
        keep[0] = True
    codes, doc = np.where(word, chars, np.uint32(32))[keep], doc[keep]
    h = codes * np.uint32(0x9E3779B1)
    docs, buckets = [], []
    for n in range(2, max(SIZES) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n - 1 :] * np.uint32(0xC2B2AE3D)
        if n in SIZES:
            inside = doc[:m] == doc[n - 1 :]
            x = h ^ (h >> np.uint32(13))
            docs.append(doc[:m][inside])
            buckets.append(((x * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))[inside])
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32), n_docs
    return np.concatenate(docs), np.concatenate(buckets), n_docs


def _distinct(docs: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((docs.astype(np.int64) << BITS) | buckets)
    return both >> BITS, both & ((1 << BITS) - 1)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Of every text; -inf without any n-gram."""
    out = np.full(len(texts), -np.inf)
    for lo, hi in K.chunks(texts):
        doc, bucket, _ = features(texts.slice(lo, hi - lo))
        out[lo:hi][np.bincount(doc, minlength=hi - lo) > 0] = model.bias
        hit = model.weights[bucket] != 0
        doc, bucket = _distinct(doc[hit], bucket[hit])
        out[lo:hi] += np.bincount(doc, model.weights[bucket], hi - lo)
    return out


def fit(texts: pa.Array, toxic: np.ndarray, min_docs: int = 4, min_ratio: float = 2.0, alpha: float = 0.5, l2: float = 1e-4, rounds: int = 60) -> Model:
    """Train on ``texts``; every fifth one only chooses the cut."""
    y = np.asarray(toxic, bool)
    size = 1 << BITS
    none = Model(np.zeros(size, np.float32), 0.0, np.inf)
    if y.all() or not y.any():
        return none
    held = np.arange(len(y)) % 5 == 4
    if y[~held].all() or not y[~held].any():
        held[:] = False
    # two passes: counts first, then only the features that got a weight are kept
    pos, neg = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for lo, hi in K.chunks(texts):
        doc, bucket = _distinct(*features(texts.slice(lo, hi - lo))[:2])
        use, bad = ~held[lo:hi][doc], y[lo:hi][doc]
        np.add.at(pos, bucket[use & bad], 1)
        np.add.at(neg, bucket[use & ~bad], 1)
    n_pos, n_neg = y[~held].sum(), (~y & ~held).sum()
    r = np.log((pos + alpha) / (n_pos + 2 * alpha)) - np.log((neg + alpha) / (n_neg + 2 * alpha))
    r[(pos + neg < min_docs) | (np.abs(r) < min_ratio)] = 0
    kept = np.flatnonzero(r)  # all others' weights stay 0
    number = np.full(size, -1, np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    r = r[kept]
    del pos, neg
    docs, buckets = [], []
    for lo, hi in K.chunks(texts):
        doc, bucket, _ = features(texts.slice(lo, hi - lo))
        live = number[bucket] >= 0
        doc, bucket = _distinct(doc[live], bucket[live])
        docs.append((doc + lo).astype(np.int32))
        buckets.append(number[bucket])
    doc, bucket = np.concatenate(docs), np.concatenate(buckets)
    train = ~held[doc]
    d, b = doc[train], bucket[train]
    w, bias = np.zeros(len(r)), float(np.log(n_pos / n_neg))
    m, v, mb, vb = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    n = (~held).sum()
    for t in range(1, rounds + 1):
        z = bias + np.bincount(d, (w * r)[b], len(y))
        err = np.where(held, 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(b, err[d], len(r)) * r + l2 * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= fix * m / (np.sqrt(v) + 1e-10)
        bias -= fix * mb / (np.sqrt(vb) + 1e-10)
    weights = np.zeros(size, np.float32)
    weights[kept] = w * r
    z = bias + np.bincount(doc, weights[kept][bucket], len(y))
    judge = held if held.any() and y[held].any() and not y[held].all() else ~held
    return Model(weights, bias, _best_cut(z[judge], y[judge]))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, a tenth of the way up from the score below it: a toxic document scores far
    above its least when it is long, so short ones need the lower part of the gap."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    best = int(np.argmax(f1))
    return float(0.1 * z[best] + 0.9 * z[best + 1]) if best + 1 < len(z) else float(z[best])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled documents, in one task; only the weights come to the driver."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(max_train)  # repeated ids do not lift the bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        order = np.lexsort((table["th"].to_numpy(), K.mix(table["doc_id"].to_numpy().astype(np.uint64))))
        texts = table["text"].cast(pa.large_string()).combine_chunks().take(pa.array(order))
        model = fit(texts, table["toxic"].to_numpy()[order] > 0)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pydict({"at": [at.astype(np.int32).tobytes()], "w": [model.weights[at].tobytes()], "bias": [model.bias], "cut": [model.cut]})

    got = rows.repartition(1).mapInArrow(K.tidy(run), "at binary, w binary, bias double, cut double").collect()
    weights = np.zeros(1 << BITS, np.float32)
    if not got:
        return Model(weights, 0.0, np.inf)
    weights[np.frombuffer(got[0]["at"], np.int32)] = np.frombuffer(got[0]["w"], np.float32)
    return Model(weights, got[0]["bias"], got[0]["cut"])


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: ``doc_id``, ``toxicity`` (probability, 0.5 at the cut) and ``toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            z = scores(model, K.column(batch, "text")) - model.cut
            p = np.where(np.isneginf(z), 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([K.column(batch, "doc_id"), pa.array(p), pa.array(z > 0)], names=["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.tidy(run), "doc_id long, toxicity double, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns kept; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train))

    @F.arrow_udf("boolean")
    def toxic(text: pa.Array) -> pa.Array:
        out = pa.array(scores(shared.value, text) > shared.value.cut)
        K.release()
        return out

    (flag,) = fresh(docs, "rejected")
    return docs.withColumn(flag, toxic("text")).filter(~F.col(flag)).drop(flag)
