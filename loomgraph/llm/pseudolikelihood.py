"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

Each word is predicted from the two words before and the two after it.  The network adds an embedding per
place and word, applies tanh, and predicts the word in two steps: its class, then the word within the class, so
the cost is 2 x 64 outputs a word and the probabilities still add up to 1 over the vocabulary.  The score of a
document is the sum of the log-probabilities of all its words.

Vocabulary: exact counts of all words of all documents; the 3,584 most frequent are words of their own, the
rest share 512 slots by hash.  The network gives a slot's probability; a word of it has the share n / (N + 1) of that,
by its own count n and the slot's count N, both exact over the corpus.  The share 1 / (N + 1) is kept for words that occur
nowhere.  The counts of the 262,144 most frequent words outside the vocabulary go to all tasks, those of all others reach the documents by a
shuffled join.  Documents are read twice: to count their words and to write them as numbers, from which training and scoring start.  Training: in each of ``ROUNDS`` rounds every partition trains, from the same start, on all
windows of all its documents, mixed by a hash of word and place within a run of documents, then the weights are averaged by the number of
windows (parameter mixing).  Averages are built by a shuffle per slice of the weights; the driver gets one model of 2 MB, whatever the input.

Defined results: null and empty texts have 0 words and a score of 0; words beyond either end of a document are a
pad; repeated rows score alike; without any word all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

TOP, HASHED, CLASSES, HIDDEN = 3584, 512, 64, 24
SIZE = TOP + HASHED
INSIDE = SIZE // CLASSES
REACH = (-2, -1, 1, 2)
ROUNDS, BATCH, STEP = 2, 2048, 0.25
LIMIT = 80.0
CACHED = 1 << 18  # words outside the vocabulary whose exact counts go to all tasks; others' come by a join
BLOCK, PART = 1 << 14, 1 << 11  # windows sorted at once for scores, and scored at once
FEW = 4  # uses of a row of the embeddings in a minibatch that are added one after another
SLICE = 1 << 14
SHAPES = ((len(REACH), SIZE + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, INSIDE), (CLASSES, INSIDE))


def unflat(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def start(counts: np.ndarray) -> np.ndarray:
    """Weights that predict the frequencies of words, with small random embeddings."""
    rng = np.random.default_rng(7)
    w = [(rng.standard_normal(s) * 0.05).astype(np.float32) for s in SHAPES]
    w[0][:, SIZE] = 0
    p = (counts + 0.5).reshape(INSIDE, CLASSES).T  # word v is in class v % CLASSES
    w[1][:] = 0
    w[3][:] = np.log(p.sum(axis=1) / p.sum())
    w[5][:] = np.log(p / p.sum(axis=1, keepdims=True))
    return np.concatenate([x.ravel() for x in w]).astype(np.float32)


class Vocabulary:
    def __init__(self, top: np.ndarray):
        order = np.argsort(top)
        self.sorted, self.number = top[order], order

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = TOP + (hashes >> np.uint64(20)) % np.uint64(HASHED)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == hashes, self.number[at], out)
        return out.astype(np.int32)


def contexts(ids: np.ndarray, offsets: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
    """Words around every word, or around those at ``pick``; SIZE beyond the ends of its document."""
    gap = max(REACH)
    size = np.diff(offsets)
    at = np.arange(gap, gap + len(ids)) + np.repeat(np.arange(0, gap * len(size), gap), size)
    apart = np.full(len(ids) + gap * (len(size) + 1), SIZE, ids.dtype)  # documents with pads between them
    apart[at] = ids
    if pick is not None:
        at = at[pick]
    return np.stack([apart[at + r] for r in REACH])


def _by_class(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts words by class, and where each class begins in it."""
    cls = (words % CLASSES).astype(np.uint8)
    return np.argsort(cls, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])


class Weights:
    """The weights as they are multiplied: embeddings of all places in one table, each bias as the last row of its matrix."""

    def __init__(self, weights: list[np.ndarray]):
        emb, self.b, wc, bc, ww, bw = weights
        self.emb = emb.reshape(-1, HIDDEN)
        self.c, self.w = np.concatenate([wc, bc[None]]), np.concatenate([ww, bw[:, None]], axis=1)
        self.each, self.back, self.c_back = list(self.w), [x[:-1].T for x in self.w], self.c[:-1].T  # views, made once

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.emb, self.b, self.c, self.w[:, :-1], self.w[:, -1])])


class Forward:
    """The hidden layer and the softmax of classes and words of up to n windows sorted by class; keeps its buffers.
    After a run, ``below`` is the hidden layer less 1, and ``parts`` has each class that occurs, its windows lo:hi, their hidden layer and their words' scores."""

    def __init__(self, n: int):
        self.e, self.h = np.empty((2 * n, HIDDEN), np.float32), np.ones((n, HIDDEN + 1), np.float32)
        self.p, self.ones = np.empty((2 * n, CLASSES), np.float32), np.ones(CLASSES, np.float32)

    def run(self, w: Weights, rows: np.ndarray, cut: list[int], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """``rows`` of the embeddings by place and window.  The hidden layer with a last column of ones; e**score of the classes and, below them, of
        the words; their sums; the scores themselves at the places ``at``."""
        n = rows.shape[1]
        x, more, h, p = self.e[:n], self.e[n : 2 * n], self.h[:n], self.p[: 2 * n]
        np.take(w.emb, rows[0], axis=0, out=x, mode="clip")
        for row in rows[1:]:
            np.take(w.emb, row, axis=0, out=more, mode="clip")
            x += more
        x += w.b
        # tanh(x) is 1 - 2 / (e**2x + 1), of which numpy has the faster loop
        x *= 2
        with np.errstate(over="ignore"):
            np.exp(x, out=x)
        x += 1
        self.below = np.divide(-2, x, out=x)
        np.add(x, 1, out=h[:, :HIDDEN])
        self.parts = [(c, lo, hi, h[lo:hi], p[n + lo : n + hi]) for c, lo, hi in zip(range(CLASSES), cut, cut[1:]) if lo < hi]
        for limit in (None, LIMIT):
            h.dot(w.c, p[:n])
            for c, _, _, own, q in self.parts:
                own.dot(w.each[c], q)
            got = None if at is None else p.ravel()[at]
            if limit:
                np.clip(p, -limit, limit, out=p)
            with np.errstate(over="ignore"):
                np.exp(p, out=p)
                total = p @ self.ones
            # sums of at most HIDDEN weights and a bias stay far from LIMIT, which only keeps them finite
            if total.min() > 1e-20 and total.max() < 1e34:
                break
        return h, p, total, got


def _rows(around: np.ndarray) -> np.ndarray:
    """The rows of the table of embeddings for the words around each window."""
    return around + np.arange(0, len(REACH) * (SIZE + 1), SIZE + 1)[:, None]


def log_probabilities(weights: list[np.ndarray] | Weights, around: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each word given the words around it."""
    w = weights if isinstance(weights, Weights) else Weights(weights)
    out = np.empty(len(words), np.float32)
    forward = Forward(min(PART, len(words)))
    for at in range(0, len(words), BLOCK):
        word = words[at : at + BLOCK]
        order, cut = _by_class(word)
        for lo in range(0, len(word), PART):  # few classes at once, so products are large and stay in the cache
            own = order[lo : lo + PART]
            n = len(own)
            _, _, total, z = forward.run(w, _rows(around[:, at + own]), np.clip(cut - lo, 0, n).tolist(), _targets(word[own]))
            z -= np.log(total)
            out[at + own] = z[:n] + z[n:]
    return out


def _targets(words: np.ndarray) -> np.ndarray:
    """Where the class of each word, and then each word in its class, lies among the scores."""
    return np.arange(0, 2 * len(words) * CLASSES, CLASSES) + np.concatenate([words % CLASSES, words // CLASSES])


class Trainer:
    """Adagrad on minibatches; gradients of embeddings touch only the rows in use."""

    def __init__(self, flat: np.ndarray):
        self.w = Weights(unflat(flat.copy()))
        self.seen = [np.full(x.shape, 1e-3, np.float32) for x in (self.w.emb[:, 0], self.w.b, self.w.c, self.w.w)]
        self.forward, self.more = Forward(BATCH), np.empty((BATCH, HIDDEN), np.float32)
        self.g_w = np.empty_like(self.w.w)
        self.g_each = list(self.g_w)
        # the largest lies where the scores were, so that less is in the cache
        self.room = [np.empty_like(self.w.b), np.empty_like(self.w.c), self.forward.p.ravel()[: self.w.w.size].reshape(self.w.w.shape)]
        self.pads = self.w.emb[SIZE :: SIZE + 1]
        self.pad = self.pads.copy()

    @property
    def flat(self) -> np.ndarray:
        return self.w.flat()

    def _step(self, i: int, x: np.ndarray, g: np.ndarray) -> None:
        seen, room = self.seen[i], self.room[i - 1]
        np.multiply(g, g, out=room)
        seen += room
        np.sqrt(seen, out=room)
        g *= STEP * 0.2
        g /= room
        x -= g

    def _backward(self, around: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the mean negative log-probability: by the hidden layer's input of each window, and by the matrices with their biases.
        The windows are sorted by class; the rows of their embeddings come in that order."""
        n = len(words)
        order, cut = _by_class(words)
        rows, cut = _rows(np.take(around, order, axis=1)), cut.tolist()
        h, p, total, _ = self.forward.run(self.w, rows, cut)
        total *= np.float32(n)
        p *= (1 / total)[:, None]
        p.reshape(-1)[_targets(words[order])] -= np.float32(1 / n)
        z, more = p[:n], self.more[:n]
        gh = z.dot(self.w.c_back)
        if len(self.forward.parts) < CLASSES:
            self.g_w[:] = 0
        for c, lo, hi, own, q in self.forward.parts:
            q.dot(self.w.back[c], more[lo:hi])
            own.T.dot(q, self.g_each[c])
        gh += more
        # by tanh: 1 - h**2 is (-2 - x) * x for x = h - 1
        np.subtract(-2, self.forward.below, out=more)
        more *= self.forward.below
        gh *= more
        return rows, gh, h.T.dot(z), self.g_w

    def gradients(self, around: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those of ``_backward`` apart, in the order of SHAPES after the words around each window."""
        rows, gx, g_c, g_w = self._backward(around, words)
        return rows % (SIZE + 1), gx, g_c[:-1], g_c[-1], g_w[:, :-1], g_w[:, -1]

    def train(self, around: np.ndarray, words: np.ndarray) -> None:
        rows, gx, g_c, g_w = self._backward(around, words)
        rows, g = sums_by_row(rows, gx)
        seen = self.seen[0][rows] + np.einsum("ij,ij->i", g, g) / HIDDEN
        self.seen[0][rows] = seen
        g *= (-STEP / np.sqrt(seen))[:, None]
        g += np.take(self.w.emb, rows, axis=0)
        self.w.emb[rows] = g
        self.pads[:] = self.pad  # not trained
        self._step(1, self.w.b, np.ones(len(gx), np.float32).dot(gx))
        self._step(2, self.w.c, g_c)
        self._step(3, self.w.w, g_w)


def sums_by_row(rows: np.ndarray, gx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``rows`` by place and window, each once, those of most uses first; and the sums of their windows' gradients."""
    key = rows.astype(np.int16).ravel()  # sorted by radix
    order = np.argsort(key, kind="stable")
    own, window = key[order], order % len(gx)
    new = np.ones(len(own) + 1, bool)
    np.not_equal(own[1:], own[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    times = first[1:] - first[:-1]
    rank = FEW - np.minimum(times, FEW + 1).astype(np.int8)  # -1: more than FEW
    most = np.argsort(rank, kind="stable")
    first, times = first[most], times[most]
    g = np.take(gx, window[first], axis=0)
    many, *ends = np.cumsum(np.bincount(rank + 1, minlength=FEW + 1)).tolist()
    # few uses: a pass over all rows for the second, the third, ...
    for k, end in enumerate(ends[-2::-1], 1):
        if many < end:
            g[many:end] += np.take(gx, window[first[many:end] + k], axis=0)
    if many:
        n = times[:many]
        start = np.cumsum(n) - n
        # two numbers are added at once
        parts = np.take(gx, window[np.arange(n.sum()) + np.repeat(first[:many] - start, n)], axis=0).view(np.complex64)
        g[:many] = np.add.reduceat(parts, start, axis=0).view(np.float32)
    return own[first].astype(np.int64), g


def word_counts(docs: DataFrame) -> DataFrame:
    """Exact count of every word of the corpus: word (hash), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.column(batch, "text")
            for first, end in K.chunks(texts, 1 << 23):
                part = texts.slice(first, end - first)  # words of small runs stay in the cache, counts are of large ones
                word, n = np.unique(np.concatenate([K.words(part.slice(lo, hi - lo)).hashes for lo, hi in K.chunks(part)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words(NamedTuple):
    """What the driver knows of the corpus's words, of bounded size."""

    vocabulary: Vocabulary
    flat: np.ndarray  # the weights to start with
    rest: np.ndarray  # by slot, how often its words occur
    known: np.ndarray  # sorted hashes of the most frequent words outside the vocabulary, and the logarithms of their counts
    logs: np.ndarray


def words_of(counts: DataFrame) -> Words:
    best = counts.orderBy(F.desc("n"), "word").limit(TOP + CACHED).toArrow()
    word, n = best["word"].to_numpy().view(np.uint64), best["n"].to_numpy().astype(np.float64)
    top, known = word[:TOP], np.zeros(SIZE)
    known[: len(top)] = n[:TOP]
    slot = F.pmod(F.shiftrightunsigned("word", 20), F.lit(HASHED))
    rest = np.zeros(HASHED)
    for r in counts.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).collect():
        rest[r["slot"]] = r["n"]
    np.subtract.at(rest, ((top >> np.uint64(20)) % np.uint64(HASHED)).astype(int), n[:TOP])
    known[TOP:] = rest
    order = np.argsort(word[TOP:])
    return Words(Vocabulary(top), start(known), rest, word[TOP:][order], np.log(n[TOP:])[order])


_ENCODED = "row long, doc_id long, n_words long, ids binary, sure double, tail array<struct<word: long, times: int>>"


def encode(docs: DataFrame, shared) -> DataFrame:
    """Every document as the numbers of its words, two bytes each.  ``sure``: the sum of the log-shares of its words outside the vocabulary as far as their
    counts are at hand; ``tail`` has the other words, whose counts come by a join, and ``sure`` only their slots' part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_ = shared.value
        kind = pa.struct([("word", pa.int64()), ("times", pa.int32())])
        for batch in batches:
            texts, rows, docs_ = K.column(batch, "text"), K.column(batch, "row"), K.column(batch, "doc_id")
            for lo, hi in K.chunks(texts):
                w = K.words(texts.slice(lo, hi - lo))
                ids = w_.vocabulary.ids(w.hashes).astype(np.int16)
                at = np.flatnonzero(ids >= TOP)
                doc = np.repeat(np.arange(hi - lo), np.diff(w.offsets))[at]
                hashes = w.hashes[at]
                value = -np.log(w_.rest[ids[at] - TOP] + 1)
                if len(w_.known):
                    place = np.minimum(np.searchsorted(w_.known, hashes), len(w_.known) - 1)
                    here = w_.known[place] == hashes
                    value += np.where(here, w_.logs[place], 0)
                else:
                    here = np.zeros(len(at), bool)
                sure = np.bincount(doc, value, hi - lo).astype(np.float64)
                doc, hashes = doc[~here], hashes[~here]
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(doc))).astype(np.int32)
                cut = np.searchsorted(doc[first], np.arange(hi - lo + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(times)], fields=list(kind)))
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((w.offsets * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), docs_.slice(lo, hi - lo), pa.array(np.diff(w.offsets).astype(np.int64)), raw, pa.array(sure), tail], names=["row", "doc_id", "n_words", "ids", "sure", "tail"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


def _numbers(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of a run of encoded documents, and their n+1 offsets."""
    off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = raw.buffers()[2]
    ids = np.frombuffer(data, np.int16)[off[0] // 2 : off[-1] // 2] if data is not None and off[-1] > off[0] else np.zeros(0, np.int16)
    return ids, (off - off[0]) // 2


def train(encoded: DataFrame, flat: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The mixed weights."""
    sc = encoded.sparkSession.sparkContext

    def local(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, done, held, n_held = Trainer(shared.value), 0, [], 0
            for batch in batches:
                raw, rows = K.column(batch, "ids"), K.column(batch, "row").to_numpy()
                for lo, hi in K.chunks(raw):
                    ids, offsets = _numbers(raw.slice(lo, hi - lo))
                    if not len(ids):
                        continue
                    doc = np.repeat(np.arange(hi - lo), np.diff(offsets))
                    # by word and place in the document, not by where the row lies
                    key = K.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(ids)) - offsets[doc]).astype(np.uint64))
                    pick = np.argsort((key >> np.uint64(48)).astype(np.uint16), kind="stable")
                    held.append((contexts(ids, offsets, pick), ids[pick]))
                    n_held += len(pick)
                    if n_held >= BATCH:
                        around, ids = np.concatenate([x for x, _ in held], axis=1), np.concatenate([y for _, y in held])
                        stop = n_held - n_held % BATCH
                        for a in range(0, stop, BATCH):
                            trainer.train(around[:, a : a + BATCH], ids[a : a + BATCH])
                        done += stop
                        held, n_held = [(around[:, stop:], ids[stop:])], n_held - stop
            if n_held:
                around, ids = np.concatenate([x for x, _ in held], axis=1), np.concatenate([y for _, y in held])
                trainer.train(around, ids)
                done += n_held
            if done:
                parts = [(trainer.flat[a : a + SLICE].astype(np.float64) * done).tobytes() for a in range(0, len(trainer.flat), SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([done] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["slice", "n", "w"])

        return run

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, total = None, 0, None
        out: list[tuple[int, bytes]] = []
        for batch in batches:
            for s, k, w in zip(*(K.column(batch, c) for c in ("slice", "n", "w"))):
                if s.as_py() != at:
                    if at is not None:
                        out.append((at, (total / n).astype(np.float32).tobytes()))
                    at, n, total = s.as_py(), 0, 0.0
                n, total = n + k.as_py(), total + np.frombuffer(w.as_py(), np.float64)
        if at is not None:
            out.append((at, (total / n).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([w for _, w in out], pa.binary())], names=["slice", "w"])

    for _ in range(rounds):
        shared = sc.broadcast(flat)
        trained = encoded.select("row", "ids").mapInArrow(local(shared), "slice int, n long, w binary")
        got = trained.repartition("slice").sortWithinPartitions("slice", "n", "w").mapInArrow(mixed, "slice int, w binary").collect()
        if not got:
            break
        flat = np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(got, key=lambda r: r["slice"])])
    return flat


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``pll`` (sum of log-probabilities) and ``pll_per_word``."""
    sc = docs.sparkSession.sparkContext
    counts = materialise(word_counts(docs), "words")
    known = words_of(counts)
    encoded = materialise(encode(docs, sc.broadcast(known)), "encoded")
    shared = sc.broadcast(train(encoded, known.flat, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(unflat(shared.value))
        for batch in batches:
            raw = K.column(batch, "ids")
            total = K.column(batch, "sure").to_numpy().copy()
            for lo, hi in K.chunks(raw):
                ids, offsets = _numbers(raw.slice(lo, hi - lo))
                lp = log_probabilities(weights, contexts(ids, offsets), ids)
                total[lo:hi] += np.bincount(np.repeat(np.arange(hi - lo), np.diff(offsets)), lp, hi - lo)
            yield pa.RecordBatch.from_arrays([K.column(batch, c) for c in ("row", "doc_id", "n_words")] + [pa.array(total)], names=["row", "doc_id", "n_words", "sure"])

    scored = encoded.select("row", "doc_id", "n_words", "ids", "sure").mapInArrow(run, "row long, doc_id long, n_words long, sure double")
    tails = encoded.filter(F.size("tail") > 0).select("row", F.inline("tail")).join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n").cast("double"))).alias("tail"))
    pll = F.col("sure") + F.coalesce(F.col("tail"), F.lit(0.0))
    return scored.join(tails, "row", "left").select("doc_id", "n_words", pll.alias("pll"), (pll / F.greatest("n_words", F.lit(1))).alias("pll_per_word"))
