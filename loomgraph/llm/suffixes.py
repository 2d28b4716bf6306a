"""Maximal repeats over a whole corpus, from the common-prefix interval tree of a suffix array.

A *repeat* is a run of at least ``MIN_WORDS`` words that stands at two places or more, in one document or in
several; it is maximal if its places can't all be extended by one word to either side.  ``maximal_repeats`` has every
maximal repeat with all its places, ``nested_repeats`` the same without listing a place under each of the repeats that begin there.

All suffixes that share ``MIN_WORDS`` words lie in one bucket of the suffix array, keyed by the hash of
those words, so buckets are sorted and scanned apart from each other.  Buckets travel by their *route*, the least
26-gram of those words, as suffixes of one document with the same route need its words only once.  Many buckets are
sorted at once in numpy: a member leads each group, binary search over prefix hashes gives every member's common
prefix with its leader, and groups split by it.  A stack scan closes the intervals of the prefix tree; an interval
is output if the words before its suffixes differ (the start of a document differs from all).

What is not needed never enters a bucket.  Every run of 50 words holds an *anchor*: a 26-gram whose hash is
least among 25 neighbours, chosen by content alone.  Only anchors that stand at two places matter, and
between two neighbouring anchors that stand at the same shifted places (seen from their counts and a
fingerprint of the places that shifts with them), no repeat can begin, as the word before would be the same everywhere.

Documents with the very same text go through as one, with the list of their ids; the result lists them once.

Defined results: null, empty or shorter texts hold no repeat; rows that repeat in full are one
document; a null id counts as one document and comes after all others; places may overlap, and a text with a
period of t words has a repeat for every multiple of t, whose places are given as one progression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import fresh, materialise, row_key

MIN_WORDS = 50
ANCHOR = 26
NEIGHBOURS = MIN_WORDS - ANCHOR + 1
_FLUSH = 1 << 17  # places expanded at a time
_NULL = np.iinfo(np.int64).max  # stands for a null id; sorts last


def _sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i+width] for every i that has a full window."""
    size = 1
    while size * 2 <= width:
        x, size = op(x[:-size], x[size:]), size * 2
    rest = width - size
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word position in it, hash) of the anchors of every document, and for every word the hash
    of the least anchor of the MIN_WORDS words from there, 0 if the document ends before."""
    n = len(w.hashes)
    none = np.zeros(0, np.int64)
    if n < MIN_WORDS:
        return none, none, none.astype(np.uint64), np.zeros(n, np.uint64)
    g = K.grams(w.hashes, ANCHOR)
    doc_of = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    least = _sliding(g, NEIGHBOURS, np.minimum)
    m = len(least)  # window j covers words j .. j + MIN_WORDS - 1
    least = np.where(doc_of[:m] == doc_of[MIN_WORDS - 1 : MIN_WORDS - 1 + m], least, np.uint64(0))
    pad = np.zeros(NEIGHBOURS - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), NEIGHBOURS, np.maximum)
    at = np.flatnonzero((g == most) & (most != 0))
    at = at[doc_of[at] == doc_of[at + ANCHOR - 1]]
    doc = doc_of[at]
    return doc, at - w.offsets[doc], g[at], np.concatenate([least, np.zeros(n - m, np.uint64)])


def _starts(n: int, at: np.ndarray, fp: np.ndarray, least: np.ndarray, count: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a maximal repeat may begin, and the end of the run of words it must stay in.

    ``at``, ``fp``: anchors of a document of n words; ``least``: of every word; ``count``: places of
    each anchor, 0 if not repeated; ``places``: their fingerprint.  A repeat holds all the windows of MIN_WORDS from its first word on, and
    these choose the same anchors wherever it stands; other anchors inside it may come from windows that reach out of it."""
    if n < MIN_WORDS or not len(at):
        return at[:0], at[:0]
    p = np.arange(n - MIN_WORDS + 1)
    before = np.searchsorted(at, p)
    own = before.copy()  # the anchor that the window at p chooses
    wrong = np.flatnonzero(fp[own] != least[p])
    while len(wrong):
        own[wrong] += 1
        wrong = wrong[fp[own[wrong]] != least[wrong]]
    rep = count > 0
    same = np.zeros(len(at), bool)
    same[1:] = rep[1:] & rep[:-1] & (count[1:] == count[:-1]) & (places[1:] == places[:-1] * K._WORDS.get(n + 1)[0][np.diff(at)])
    # no start where an anchor before p stands at the same places as the one of the window
    breaks = np.cumsum(~same)
    joined = (before > 0) & (breaks[own] == breaks[np.maximum(before - 1, 0)])
    # a run ends within the window of the first anchor that isn't repeated, or has one other place, which differs
    stop = np.ones(len(at), bool)
    stop[:-1] = ~rep[1:] | ((count[1:] == 2) & (count[:-1] == 2) & ~same[1:])
    last = np.flatnonzero(stop)[np.searchsorted(np.flatnonzero(stop), np.arange(len(at)))]
    end = np.where(last + 1 < len(at), np.minimum(at[np.minimum(last + 1, len(at) - 1)] + MIN_WORDS - 1, n), n)
    good = rep[own] & ~joined
    p, e = p[good], end[own[good]]
    fits = p + MIN_WORDS <= e
    return p[fits], e[fits]


def prefixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, down): (run[b] - run[a]) * down[a] is a hash of words[a:b]."""
    up, down = K._WORDS.get(len(words) + 1)
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=run[1:])
    return run, down


def suffix_array(words: np.ndarray, first: np.ndarray, end: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes words[first[i] : end[i]] sorted within their buckets, and the common prefix of each with the next, -1 at
    the end of a bucket.  The suffixes of one bucket share their first MIN_WORDS words."""
    n = len(first)
    order = np.lexsort((first, bucket))
    lcp = np.full(n, -1, np.int64)
    run, down = prefixes(words)
    size = end - first

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, at least MIN_WORDS."""
        pa_, pb = first[a], first[b]
        da, db, ra, rb = down[pa_], down[pb], run[pa_], run[pb]
        lo, hi = np.minimum(MIN_WORDS, np.minimum(size[a], size[b])), np.minimum(size[a], size[b])
        full = (run[pa_ + hi] - ra) * da == (run[pb + hi] - rb) * db
        lo = np.where(full, hi, lo)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live] + 1) >> 1
            good = (run[pa_[live] + mid] - ra[live]) * da[live] == (run[pb[live] + mid] - rb[live]) * db[live]
            lo[live] = np.where(good, mid, lo[live])
            hi[live] = np.where(good, hi[live], mid - 1)
            live = live[lo[live] < hi[live]]
        return lo

    key = bucket[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1  # of each slot
    slots = np.arange(n)
    big = np.int64(1) << 40
    while len(slots):
        start = np.flatnonzero(np.diff(group, prepend=-1))
        count = np.diff(np.append(start, len(slots)))
        lead = np.repeat(order[slots[start + count // 2]], count)
        own = order[slots]
        length = common(lead, own)
        nxt = np.where(length < size[own], words[np.minimum(first[own] + length, len(words) - 1)], np.uint64(0))
        other = np.where(length < size[lead], words[np.minimum(first[lead] + length, len(words) - 1)], np.uint64(0))
        side = (nxt > other).astype(np.int8) - (nxt < other).astype(np.int8)
        rank = np.where(side < 0, length, np.where(side > 0, 2 * big - length, big))
        by = np.lexsort((nxt, rank, group))
        order[slots] = own[by]
        length, nxt, side, rank = length[by], nxt[by], side[by], rank[by]
        inner = np.flatnonzero(group[1:] == group[:-1])
        lcp[slots[inner]] = np.where(side[inner] < 0, length[inner], length[inner + 1])
        cut = np.ones(len(slots), bool)
        cut[1:] = (group[1:] != group[:-1]) | (rank[1:] != rank[:-1]) | (nxt[1:] != nxt[:-1])
        part = np.cumsum(cut) - 1
        go = (side != 0) & (np.bincount(part)[part] > 1)
        slots, group = slots[go], part[go]
        group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
    return order, lcp


def tree(lcp: list[int], left: list[int], least: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the left-diverse intervals of a suffix array.  left: the word before each suffix,
    0 if it differs from all."""
    stack: list[list[int]] = []  # length, first, left word or 0 if they differ
    for i, depth in enumerate(lcp):
        first, word = i, left[i]
        while stack and stack[-1][0] > depth:
            length, first, other = stack.pop()
            if word != other:
                word = 0
            if not word and length >= least:
                yield length, first, i
        if depth >= 0:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != word:
                    stack[-1][2] = 0
            else:
                stack.append([depth, first, word])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(docs)).select("doc_id", "th", F.xxhash64("doc_id", "th").alias("dk"), "text")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, dk = K.column(batch, "text"), K.column(batch, "dk").to_numpy()
        for lo, hi in K.chunks(texts):
            doc, at, fp, _ = anchors(K.words(texts.slice(lo, hi - lo)))
            if len(doc):
                own = dk[lo:hi][doc]
                place = K.mix(own.view(np.uint64)) * K._WORDS.get(int(at.max()) + 1)[0][at]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(at.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(place.view(np.int64))], names=["dk", "at", "fp", "place"])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0] + [len(x) for x in parts]).astype(np.int32), np.concatenate(parts))


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["dk", "ids", "base", "words", "p", "e", "lh", "before", "route"]
    for batch in batches:
        texts, hits = K.column(batch, "text"), K.column(batch, "hits")
        ids, dks = K.column(batch, "ids"), K.column(batch, "dk")
        for lo, hi in K.chunks(texts):
            w = K.words(texts.slice(lo, hi - lo))
            doc, at, fp, least = anchors(w)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            rows, out = [], [[] for _ in range(7)]
            for i in range(hi - lo):
                mine = at[cut[i] : cut[i + 1]]
                h = hits[lo + i].values
                known, first = np.unique(h.field("at").to_numpy(), return_index=True)
                where = np.searchsorted(mine, known)
                count, places = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.uint64)
                count[where] = h.field("n").to_numpy()[first]
                places[where] = h.field("lo").to_numpy()[first].astype(np.uint64) + (h.field("hi").to_numpy()[first].astype(np.uint64) << np.uint64(32))
                hashes = w.doc(i)
                p, e = _starts(len(hashes), mine, fp[cut[i] : cut[i + 1]], least[w.offsets[i] : w.offsets[i + 1]], count, places)
                if not len(p):
                    continue
                base, end = int(p.min()), int(e.max())
                before = np.where(p > 0, hashes[p - 1], np.uint64(0)).view(np.int64)
                lh = K.grams(hashes, MIN_WORDS)[p].view(np.int64)
                route = least[w.offsets[i] + p].view(np.int64)
                rows.append(lo + i)
                for a, x in zip(out, (base, hashes[base:end].tobytes(), p.astype(np.int32), e.astype(np.int32), lh, before, route)):
                    a.append(x)
            if rows:
                base, words, *lists = out
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([dks.take(take), ids.take(take), pa.array(base, pa.int32()), pa.array(words, pa.binary()), *map(_lists, lists)], names=names)


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes by route.  Suffixes of one document with one route share their words, sent once."""
    for batch in batches:
        dk, ids, base, words, hits = (K.column(batch, c) for c in ("dk", "ids", "base", "words", "hits"))
        if not batch.num_rows:
            continue
        flat = hits.flatten()
        p, e, lh, before, route = (flat.field(c).to_numpy() for c in ("p", "e", "lh", "before", "route"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
        order = np.lexsort((p, route, row))
        p, e, lh, before, route, row = (x[order] for x in (p, e, lh, before, route, row))
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | np.concatenate([[True], route[1:] != route[:-1]]))
        stop = np.append(start[1:], len(row))
        reach = np.maximum.reduceat(e, start)
        base = base.to_numpy()
        lo = 0
        while lo < len(start):
            out, size, hi = [], 0, lo
            while hi < len(start) and size < 1 << 21:
                r, a = row[start[hi]], int(p[start[hi]])
                own = words[int(r)].as_buffer()[8 * (a - int(base[r])) : 8 * (int(reach[hi]) - int(base[r]))]
                out.append(own.to_pybytes())
                size += len(own) + 32 * (stop[hi] - start[hi])
                hi += 1
            part = slice(start[lo], stop[hi - 1])
            cuts = pa.array((np.append(start[lo:hi], stop[hi - 1]) - start[lo]).astype(np.int32))
            take = pa.array(row[start[lo:hi]])
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[part])) for x in (p, e, lh, before)]
            yield pa.RecordBatch.from_arrays([pa.array(route[start[lo:hi]]), dk.take(take), ids.take(take), pa.array(p[start[lo:hi]]), pa.array(out, pa.binary()), *lists], names=_SUFFIX)
            lo = hi


_SUFFIX = ["route", "dk", "ids", "base", "words", "p", "e", "lh", "before"]


class Scan:
    """The suffix array of some routes, whole ones, with what stands behind each suffix."""

    inner: np.ndarray | None = None  # of each suffix the innermost interval, -1 if none, where places go under that only

    def __init__(self, table: pa.Table):
        col = {c: table[c].combine_chunks() for c in _SUFFIX}
        raw = col["words"]
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        words = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
        begin = (offsets[:-1] - offsets[0]) // 8
        row = np.repeat(np.arange(len(raw)), np.diff(col["p"].offsets.to_numpy()))
        p, e, lh, before = (col[c].flatten().to_numpy() for c in ("p", "e", "lh", "before"))
        # texts in the order in which they keep what they share: by least id, then by hash
        dk, at, text = np.unique(col["dk"].to_numpy(), return_index=True, return_inverse=True)
        lists = col["ids"].take(pa.array(at))
        self.ids = lists.flatten().fill_null(_NULL).to_numpy()
        self.first_id = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        by = np.lexsort((dk, self.ids[self.first_id[:-1]]))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.dk, self.text_ids = dk[by], by
        text = place[text][row]
        _, once = np.unique(np.stack([text, p]), axis=1, return_index=True)  # rows that repeat in full
        text, p, e, lh, before, row = (x[once] for x in (text, p, e, lh, before, row))
        first = begin[row] + p - col["base"].to_numpy()[row]
        order, lcp = suffix_array(words, first, first + e - p, lh)
        self.text, self.p, self.lcp, self.size = text[order], p[order], lcp, (e - p)[order]
        self.left = before[order]
        self.words, self.first = words, first[order]
        found = list(tree(lcp.tolist(), self.left.tolist()))
        found = np.array(found, np.int64).reshape(-1, 3)
        # a text with copies is a repeat by itself where no other suffix shares all of it
        several = np.diff(self.first_id)[self.text_ids] > 1
        above = np.maximum(lcp, np.concatenate([[-1], lcp[:-1]]))
        alone = np.flatnonzero(several[self.text] & (self.p == 0) & (self.size > above))
        self.found = np.concatenate([found, np.stack([self.size[alone], alone, alone], axis=1)])

    def copies(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin, and how many there are."""
        t = self.text_ids[text]
        return self.first_id[t], self.first_id[t + 1] - self.first_id[t]

    def nested(self) -> Iterator[pa.RecordBatch]:
        """Each place under the longest repeat that begins there, and of each repeat the shorter one that has all its places."""
        n = len(self.found)
        inner, self.parent = np.full(len(self.p), -1, np.int64), np.full(n, -1, np.int64)
        for x in np.argsort(self.found[:, 1] - self.found[:, 2], kind="stable").tolist():  # outer intervals first
            _, lo, hi = self.found[x].tolist()
            self.parent[x] = inner[lo]
            inner[lo : hi + 1] = x
        self.inner = inner
        self.bare = np.bincount(inner[inner >= 0], minlength=n) == 0
        yield from self.repeats()

    def _names(self, found: np.ndarray) -> np.ndarray:
        length, lo, _ = found.T
        run, down = prefixes(self.words)
        begin = self.first[lo]
        return K.mix((run[begin + length] - run[begin]) * down[begin] + length.astype(np.uint64)).view(np.int64)

    def repeats(self) -> Iterator[pa.RecordBatch]:
        """All places of all repeats, about _FLUSH at a time."""
        size = self.found[:, 2] - self.found[:, 1] + 1
        at = 0
        while at < len(size):
            stop = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), _FLUSH, "right")))
            yield from self._places(at, stop)
            at = stop

    def _places(self, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        found = self.found[begin:end]
        length, lo, hi = found.T
        number = np.repeat(np.arange(len(lo)), hi - lo + 1)
        i = np.arange(len(number)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1) - lo, hi - lo + 1)
        text, place = self.text[i], self.p[i].astype(np.int64)
        order = np.lexsort((place, text, number))
        number, text, place, i = number[order], text[order], place[order], i[order]
        _, count = self.copies(text)
        new = np.ones(len(number), bool)  # the first place of a text in a repeat
        new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
        docs = np.bincount(number[new], count[new], len(lo)).astype(np.int32)
        places = np.bincount(number, count, len(lo)).astype(np.int64)
        if self.inner is not None:
            # a repeat of which every place has a longer one is listed at its first place
            own = self.inner[i] == number + begin
            own |= self.bare[begin:end][number] & (np.diff(number, prepend=-1) != 0)
            number, text, place, i = number[own], text[own], place[own], i[own]
            new = np.ones(len(number), bool)
            new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
        n = len(number)
        step = np.diff(place, prepend=0)
        step[new] = -1
        # places at equal distances are one progression
        step[:-1] = np.where(new[:-1] & ~new[1:], step[1:], step[:-1])
        head = new.copy()
        head[1:] |= step[1:] != step[:-1]
        head = np.flatnonzero(head)
        times = np.diff(np.append(head, n))
        number, text, place, step, i = number[head], text[head], place[head], np.where(times > 1, step[head], 0), i[head]
        first, count = self.copies(text)
        copies, count = count, np.where((place == 0) & (length[number] == self.size[i]), count, 1)
        name = self._names(found)
        if self.inner is not None:
            above = self.parent[begin:end]
            parent = self._names(self.found[above])
        reach = np.cumsum(count)
        at = 0
        while at < len(count):  # copies multiply the rows
            stop = at + max(1, int(np.searchsorted(reach[at:] - (reach[at - 1] if at else 0), 4 * _FLUSH, "right")))
            c = count[at:stop]
            k = np.repeat(np.arange(at, stop), c)
            ids = self.ids[np.arange(len(k)) - np.repeat(np.cumsum(c) - c - first[at:stop], c)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=ids == _NULL),
                    pa.array(name[number[k]]),
                    pa.array(length[number[k]].astype(np.int32)),
                    pa.array(docs[number[k]]),
                    pa.array(places[number[k]]),
                    pa.array(place[k].astype(np.int32)),
                    pa.array(step[k].astype(np.int32)),
                    pa.array(times[k].astype(np.int32)),
                    pa.array(copies[k].astype(np.int32)),
                ],
                names=["doc_id", "repeat_id", "n_words", "n_docs", "n_places", "first_word", "step", "times", "n_copies"],
            )
            yield out if self.inner is None else out.append_column("parent_id", pa.array(parent[number[k]], mask=above[number[k]] < 0))
            at = stop

    def cuts(self) -> Iterator[pa.RecordBatch]:
        """What to cut for the first place to keep each repeat: merged runs of words by text.

        Of two runs from one word the longer counts: for a text's least document that of the longest repeat of which the place
        isn't the first, for its copies that of the longest repeat."""
        n = len(self.p)
        rest, whole = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(self.found[:, 2] - self.found[:, 1], kind="stable")  # inner intervals before those around them
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.p, self.text))] = np.arange(n)
        open_: dict[int, list[int]] = {}  # suffixes without a longer run, by the first slot of the interval that has them
        nothing: list[int] = []
        skip = np.arange(n + 1)  # next slot not inside an interval that is done
        for length, lo, hi in self.found[order].tolist():
            own, i = [], lo
            while i <= hi:
                if skip[i] > i:
                    own += open_.pop(i, nothing)
                    i = int(skip[i])
                else:
                    own.append(i)
                    whole[i] = length
                    i += 1
            skip[lo] = hi + 1
            keeper = min(own, key=rank.__getitem__)
            for i in own:
                if i != keeper:
                    rest[i] = length
            open_[lo] = [keeper]
        _, count = self.copies(self.text)
        live, twice = np.flatnonzero(rest), np.flatnonzero((whole > 0) & (count > 1))
        i = np.concatenate([live, twice])
        kept = np.arange(len(i)) >= len(live)
        if not len(i):
            return
        text, first = self.text[i], self.p[i].astype(np.int64)
        end = first + np.where(kept, whole[i], rest[i])
        by = np.lexsort((first, kept, text))
        text, kept, first, end = text[by], kept[by], first[by], end[by]
        new = np.ones(len(i), bool)
        new[1:] = (text[1:] != text[:-1]) | (kept[1:] != kept[:-1])
        part = np.cumsum(new)
        reach = np.maximum.accumulate(end + part * (1 << 32)) - part * (1 << 32)  # greatest end so far in its part
        new[1:] |= first[1:] > reach[:-1]
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(i)) - 1
        least = self.ids[self.copies(text[at])[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.dk[text[at]]), pa.array(least, mask=least == _NULL), pa.array(kept[at]), pa.array(first[at].astype(np.int32)), pa.array(reach[stop].astype(np.int32))],
            names=["dk", "least", "kept", "first", "end"],
        )


_REPEAT = "doc_id long, repeat_id long, n_words int, n_docs int, n_places long, first_word int, step int, times int, n_copies int"
_CUT = "dk long, least long, kept boolean, first int, end int"
_SCAN_BYTES = 1 << 22


def _scanner(kind: str):
    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The results of complete routes, some at a time."""
        table = pa.Table.from_batches(parts).combine_chunks()
        route = table["route"].to_numpy()
        new = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
        size = np.concatenate([[0], np.cumsum(pc.binary_length(table["words"]).to_numpy().astype(np.int64) + 32 * pc.list_value_length(table["p"]).to_numpy())])
        at, ends = 0, np.append(new[1:], len(route))
        while at < len(route):
            stop = int(ends[min(np.searchsorted(size[ends], size[at] + _SCAN_BYTES), len(ends) - 1)])
            yield from getattr(Scan(table.slice(at, stop - at)), kind)()
            at = stop

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            route = K.column(batch, "route").to_numpy()
            cut = len(route) - int(np.argmax((route != route[-1])[::-1])) if route[0] != route[-1] else 0
            if cut or (held and key != route[0]):
                if cut:
                    held.append(batch.slice(0, cut))
                yield from whole(held)
                held = []
            held.append(batch.slice(cut))
            key = route[-1]
        if held:
            yield from whole(held)

    return scan


def repeats(docs: DataFrame, kind: str = "repeats", schema: str = _REPEAT) -> DataFrame:
    """What the method ``kind`` of Scan gives for the routes of all documents."""
    keyed = _keyed(docs)
    texts = (
        keyed.filter("text is not null")
        .groupBy("th")
        .agg(F.sort_array(F.collect_set("doc_id")).alias("ids"), F.max(F.col("doc_id").isNull()).alias("no_id"))
        .select("th", F.when(F.col("no_id"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids")).alias("ids"))
        .withColumn("dk", F.xxhash64(F.col("ids")[0], "th"))
    )
    everywhere = Window.partitionBy("fp")
    low, high = F.col("place").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("place", 32)
    places = (
        keyed.select("dk", "text")
        .mapInArrow(K.tidy(_anchor_rows), "dk long, at int, fp long, place long")
        .select("dk", "at", F.count("*").over(everywhere).alias("n"), F.sum(low).over(everywhere).alias("lo"), F.sum(high).over(everywhere).alias("hi"))
        .filter("n > 1")
        .groupBy("dk")
        .agg(F.collect_list(F.struct("at", "n", "lo", "hi")).alias("hits"))
        .join(texts, "dk")
        .select("dk", "ids", "hits")
    )
    candidates = materialise(
        keyed.select("th", "dk", "text").join(places, "dk").select(F.col("th").alias("dk"), "ids", "text", "hits").mapInArrow(
            K.tidy(_candidate_rows), "dk long, ids array<long>, base int, words binary, p array<int>, e array<int>, lh array<long>, before array<long>, route array<long>"
        ),
        "candidates",
    )
    bucket = Window.partitionBy("lh")
    # the documents' starts count as differing from every word
    differ = (F.min("before").over(bucket) != F.max("before").over(bucket)) | F.bool_or(F.col("before") == 0).over(bucket)
    several = (F.count("*").over(bucket) > 1) | (F.max("copies").over(bucket) > 1)
    starts = (
        candidates.select("dk", F.size("ids").alias("copies"), F.inline(F.arrays_zip("p", "e", "lh", "before", "route")))
        .withColumn("good", differ & several)
        .filter("good")
        .groupBy("dk")
        .agg(F.collect_set(F.struct("p", "e", "lh", "before", "route")).alias("hits"))
    )
    suffixes = (
        candidates.select("dk", "ids", "base", "words")
        .join(starts, "dk")
        .select("dk", "ids", "base", "words", "hits")
        .mapInArrow(K.tidy(_suffix_rows), "route long, dk long, ids array<long>, base int, words binary, p array<int>, e array<int>, lh array<long>, before array<long>")
    )
    return suffixes.repartition("route").sortWithinPartitions("route").mapInArrow(K.tidy(_scanner(kind)), schema)


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """Every maximal repeat in each document that has it: ``doc_id``, ``repeat_id`` (a hash of its words), ``n_words``, ``n_docs`` and
    ``n_places`` of it everywhere, and its places in the document: ``first_word``, and ``times`` - 1 more at every ``step`` words.

    A document has a row for each run of places at equal distances; mostly each place is a row of its own, with step 0.
    ``n_copies`` documents have the very same text: the one with the least id has all rows, as the others have the same places,
    and these have one row each, under the repeat that is their whole text.  So copies add to the rows and don't multiply them."""
    return repeats(docs)


def nested_repeats(docs: DataFrame) -> DataFrame:
    """The same as ``maximal_repeats`` with each place once: under the longest repeat that begins there.  ``parent_id`` is the next shorter
    repeat, which stands at all places of this one and at others, null if there is none; so the places of a repeat are its own rows' and those of all
    repeats below it.  A repeat of which every place has a longer one has a row for its first place alone.

    Rows are at most as many as places and repeats, where places under every repeat that begins there grow with clusters of near copies as their square."""
    return repeats(docs, "nested", _REPEAT + ", parent_id long")


def without_spans(texts: pa.Array, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """``texts`` without the words first[i] .. end[i] - 1 of text row[i] and all between them."""
    raw, off = K.raw_bytes(texts)
    s, e, docs = K.bounds(raw, off)
    gone = np.zeros(len(raw) + 1, np.int32)
    np.add.at(gone, s[docs[row] + first], 1)
    np.subtract.at(gone, e[docs[row] + end - 1], 1)
    keep = np.cumsum(gone)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(keep)])[off].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(left), pa.py_buffer(raw[keep]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeat cut from all its places but the first (by id, nulls last, then place in the text).

    A word goes if any place that is not the first covers it, so of a run with a period one period stays.  All columns
    are kept and ``n_chars``, where it is there, follows the text; documents of which no word is left are dropped, others come back as
    they were.  Copies of one text keep what the text has first only under the least id."""
    run = F.struct("first", "end")
    cuts = (
        repeats(docs, "cuts", _CUT)
        .groupBy("dk")
        .agg(F.collect_list(F.when(~F.col("kept"), run)).alias("every"), F.collect_list(run).alias("copies"), F.first("least").alias("least"))
    )
    k, d, c, *names = fresh(docs, "cut_dk", "own_dk", "cut_spans", "cut_every", "cut_copies", "cut_least")
    cuts = cuts.select(F.col("dk").alias(k), *(F.col(x).alias(y) for x, y in zip(("every", "copies", "least"), names)))

    @F.arrow_udf("string")
    def trimmed(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = [pa.array([], pa.large_string())]
        for lo, hi in K.chunks(text):
            own = spans.slice(lo, hi - lo)
            flat = own.flatten()
            row = np.repeat(np.arange(hi - lo), pc.fill_null(pc.list_value_length(own), 0).to_numpy())
            out.append(without_spans(text.slice(lo, hi - lo), row, flat.field("first").to_numpy(), flat.field("end").to_numpy()))
        out = pa.concat_arrays(out).cast(pa.string())
        K.release()
        return out

    joined = docs.withColumn(d, F.xxhash64("text")).join(cuts, F.col(d) == F.col(k), "left")
    # the least id cuts what it doesn't keep; its copies lose what it keeps too
    joined = joined.withColumn(c, F.when(F.col("doc_id").cast("long").eqNullSafe(F.col(names[2])), F.col(names[0])).otherwise(F.col(names[1])))
    joined = joined.withColumn(c, F.when(F.size(c) > 0, F.col(c)))
    less = F.col(c).isNotNull()
    joined = joined.withColumn(k, trimmed(F.when(less, F.col("text")), F.col(c)))
    joined = joined.filter(~less | F.col(k).rlike(r"[0-9a-zA-Z\u0080-\x{10FFFF}]"))
    new = {"text": F.col(k)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(k).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(F.when(less, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in docs.columns))
