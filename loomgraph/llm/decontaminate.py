"""Benchmark decontamination by the longest matches of every normalised test item.

A *span* of an item is a run of a document's words that occurs in the item, that neither neighbour in the document
prolongs, of ``SEED`` words or more.  Removed are spans of at least ``max_match`` words, and all spans of an item
if the document has at least the share ``max_coverage`` of the item's words: places of the item count, each once, however
often the document repeats them.  Every item is judged by itself, whatever longer items the document also matches.

Only stretches where every run of ``SEED`` words occurs in some item are looked at, since no span lies outside
them: a bit table over hashes of these runs skips the rest of the corpus in a few numpy passes.  The runs' places
in the items give the shares; the suffix automaton of each item to remove gives its spans.  Items are split into
tables of about ``shard_words`` words, on which no result depends.

Defined results: null or empty texts and items match nothing; an item shorter than ``SEED`` words is a span
by itself if all of it occurs; repeated items and rows count like single ones; whole texts stream,
whatever their length; without items nothing is removed.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import fresh
from .suffixes import without_spans

SEED, MAX_MATCH, MAX_COVERAGE = 5, 13, 0.5
SHARD_WORDS = 200_000
_BITS = 22


class Automaton:
    """Generalised suffix automaton over word hashes; ``items(state)`` are those that contain its strings."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("q", [-1]), array("q", [0])
        self.size = {k: len(w) for k, w in items}
        self.of: list[set[int]] = [set()]
        for _, word_list in items:
            last = 0
            for word in word_list:
                last = self._extend(last, word)
        for k, word_list in items:
            state = 0
            for word in word_list:
                state = self.next[state][word]
                at = state
                while at and k not in self.of[at]:
                    self.of[at].add(k)
                    at = self.link[at]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.of.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        state = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def spans(self, stream: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(first, end, state) of every match that the next word does not prolong."""
        state = size = 0
        for i, word in enumerate([*stream, None]):
            before, had = state, size
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                state = size = 0
            if size != had + 1 and had >= least:
                yield i - had, i, before


class Places:
    """Where each run of ``n`` words occurs in the items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n: int, fits: Callable[[int], bool]):
        own = [(k, K.grams(w, n)) for k, (_, w) in enumerate(items) if fits(len(w))]
        h = np.concatenate([g for _, g in own] or [np.zeros(0, np.uint64)])
        item = np.repeat(np.array([k for k, _ in own], np.int64), [len(g) for _, g in own])
        at = np.concatenate([np.arange(len(g)) for _, g in own] or [np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.hashes, self.first = np.unique(h[order], return_index=True)
        self.end = np.append(self.first[1:], len(h))

    def hit(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places in them of the distinct runs among ``hashes``."""
        _, _, at = np.intersect1d(hashes, self.hashes, return_indices=True)
        times = self.end[at] - self.first[at]
        row = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - self.first[at], times)
        return self.item[row], self.at[row]


class Matcher:
    """Items with the seed tables that lead to them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], seed: int, max_match: int = MAX_MATCH):
        self.items, self.seed, self.max_match = items, seed, max_match
        self.size = np.array([len(w) for _, w in items])
        self.places: dict[int, Places] = {}
        self.seeds: dict[int, np.ndarray] = {}
        self.table: dict[int, np.ndarray] = {}
        for n in sorted({min(seed, len(w)) for _, w in items}):
            self.places[n] = Places(items, n, lambda size, n=n: min(seed, size) == n)
            g = self.seeds[n] = self.places[n].hashes
            bit = np.zeros(1 << _BITS, bool)
            bit[g >> np.uint64(64 - _BITS)] = True
            self.table[n] = bit
        self.long = Places(items, max(seed, max_match), lambda size: size >= max(seed, max_match))

    def stretches(self, w: K.Words) -> list[tuple[int, int, int]]:
        """(document, first, end) of stretches made of seeds."""
        covered = np.zeros(len(w.hashes) + 1, np.int32)
        for n, g in self.seeds.items():
            h = K.grams(w.hashes, n)
            at = np.flatnonzero(self.table[n][h >> np.uint64(64 - _BITS)])
            at = at[g[np.minimum(np.searchsorted(g, h[at]), len(g) - 1)] == h[at]] if len(g) else at[:0]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
        live = np.cumsum(covered)[:-1] > 0
        if not live.any():
            return []
        edge = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]])))
        out = []
        for a, b in zip(edge[::2], edge[1::2]):
            d = int(np.searchsorted(w.offsets, a, "right")) - 1
            while a < b:  # a stretch may run on into the next documents
                end = min(b, w.offsets[d + 1])
                if end > a:
                    out.append((d, int(a - w.offsets[d]), int(end - w.offsets[d])))
                a, d = end, d + 1
        return out

    def find(self, w: K.Words, max_coverage: float) -> dict[int, list[tuple[int, int, tuple[int, ...]]]]:
        """Removed spans (first, end, items) by document."""
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for d, a, b in self.stretches(w):
            by_doc.setdefault(d, []).append((a, b))
        automata: dict[int, Automaton] = {}
        out = {}
        for d, parts in by_doc.items():
            words = w.doc(d)
            runs = lambda n: np.concatenate([K.grams(words[a:b], n) for a, b in parts])
            covered = np.zeros(len(self.items), np.int64)
            for n, places in self.places.items():
                item, at = places.hit(runs(n))
                key = np.unique(((item << 32) + at)[:, None] + np.arange(n))
                covered += np.bincount(key >> 32, minlength=len(self.items))
            over = (covered > 0) & (covered >= max_coverage * self.size)
            live = over | ((covered > 0) & (self.size < self.seed) & (self.size >= self.max_match))
            live[self.long.hit(runs(max(self.seed, self.max_match)))[0]] = True
            gone: dict[tuple[int, int], set[int]] = {}
            for k in np.flatnonzero(live).tolist():
                if k not in automata:
                    automata[k] = Automaton([(k, self.items[k][1].tolist())])
                for a, b in parts:
                    for lo, hi, _ in automata[k].spans(words[a:b].tolist(), min(self.seed, int(self.size[k]))):
                        if over[k] or hi - lo >= self.max_match:
                            gone.setdefault((a + lo, a + hi), set()).add(self.items[k][0])
            if gone:
                out[d] = [(lo, hi, tuple(sorted(ks))) for (lo, hi), ks in gone.items()]
        return out


def matchers(benchmark: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS, max_match: int = MAX_MATCH) -> Iterator[Matcher]:
    """Tables of bounded size, one after the other."""
    items: list[tuple[int, np.ndarray]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna(subset=["text"]).distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        w = K.words(pa.array([row["text"]])).hashes
        if not len(w):
            continue
        items.append((-1 if row["item_id"] is None else row["item_id"], w))
        size += len(w)
        if size >= shard_words:
            yield Matcher(items, seed, max_match)
            items, size = [], 0
    if items:
        yield Matcher(items, seed, max_match)


_SPAN = "array<struct<first_word: int, n_words: int, item_ids: array<long>>>"


def _search(docs: DataFrame, benchmark: DataFrame, max_match: int, shard_words: int = SHARD_WORDS) -> list:
    sc = docs.sparkSession.sparkContext
    return [sc.broadcast(m) for m in matchers(benchmark, shard_words=shard_words, max_match=max_match)]


def _found(shared: list, texts: pa.Array, max_coverage: float) -> Iterator[tuple[int, int, list]]:
    """(row, words, spans) of the rows with anything to remove."""
    for lo, hi in K.chunks(texts):
        w = K.words(texts.slice(lo, hi - lo))
        by_doc: dict[int, dict] = {}
        for one in shared:
            for d, spans in one.value.find(w, max_coverage).items():
                for first, end, ks in spans:
                    by_doc.setdefault(d, {}).setdefault((first, end), set()).update(ks)
        for d, spans in sorted(by_doc.items()):
            yield lo + d, int(w.offsets[d + 1] - w.offsets[d]), [(*at, tuple(sorted(ks))) for at, ks in sorted(spans.items())]


def _cut(text: pa.Array, spans: list) -> str:
    first, end = np.array([s[:2] for s in spans]).T
    return without_spans(text, np.zeros(len(first), np.int64), first, end)[0].as_py()


def contaminated(docs: DataFrame, benchmark: DataFrame, max_match: int = MAX_MATCH, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document with a removed span: ``doc_id``, ``n_words``, ``n_removed`` words, ``longest``
    match, ``item_ids``, ``spans`` and the cleaned ``text``."""
    shared = _search(docs, benchmark, max_match, shard_words)
    span = pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("item_ids", pa.list_(pa.int64()))])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int32()), ("n_removed", pa.int32()), ("longest", pa.int32()), ("item_ids", pa.list_(pa.int64())), ("spans", pa.list_(span)), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = K.column(batch, "text"), K.column(batch, "doc_id")
            rows = []
            for i, n, spans in _found(shared, texts, max_coverage):
                rows.append(
                    {
                        "doc_id": ids[i].as_py(),
                        "n_words": n,
                        "n_removed": len({x for lo, hi, _ in spans for x in range(lo, hi)}),
                        "longest": max(hi - lo for lo, hi, _ in spans),
                        "item_ids": sorted({k for *_, ks in spans for k in ks}),
                        "spans": [{"first_word": lo, "n_words": hi - lo, "item_ids": list(ks)} for lo, hi, ks in spans],
                        "text": _cut(texts.slice(i, 1), spans),
                    }
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        K.tidy(run), f"doc_id long, n_words int, n_removed int, longest int, item_ids array<long>, spans {_SPAN}, text string"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_match: int = MAX_MATCH, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with the spans cut out, all columns kept, in one pass without a shuffle.  ``n_chars``, where
    it is there, follows the text; a document of which no word is left is dropped, others are unchanged."""
    shared = _search(docs, benchmark, max_match)

    @F.pandas_udf("string")
    def cleaned(text):
        import pandas as pd

        out = text.to_numpy(dtype=object, copy=True)
        texts = pa.array(text, pa.large_string())
        for i, n, spans in _found(shared, texts, max_coverage):
            gone = len({x for lo, hi, _ in spans for x in range(lo, hi)})
            out[i] = "" if gone == n else _cut(texts.slice(i, 1), spans)
        return pd.Series(out)

    (new,) = fresh(docs, "clean_text")
    out = docs.withColumn(new, cleaned("text"))
    out = out.filter(F.col(new).eqNullSafe(F.col("text")) | (F.length(new) > 0))
    columns = [F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns = [F.when(F.col(new).eqNullSafe(F.col("text")), F.col(c)).otherwise(F.length(new).cast(kind)).alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, columns)]
    return out.select(*columns)
