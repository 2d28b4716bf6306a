"""Packing: vector bin packing by the dot-product heuristic.

An example has a demand vector (tokens, segments, loss-bearing tokens) and a bin has limits on all three.
One bin is open at a time.  The next example is the one, among those that fit, whose demands have the
largest dot product with what the bin has left, both divided by the limits and each dimension weighted by the mean
demand for it; ties go to the earliest example.  When none fits, the bin closes.

Examples are packed in batches of at most ``batch_items`` pieces and ``batch_bytes`` bytes of text, in order of id and text within a
partition, so a repeated task gives the same bins, documents need no shuffle, memory is bounded, and an example costs the same at
every size.  Only the last bins of a batch can be left part empty: a batch of 8,192 documents fills about 97 % of its bins' tokens.
``bin_id`` names the partition, batch and bin.

An example above the token limit is first cut into pieces of at most that many tokens; a piece above the limit of
loss-bearing tokens is cut at that too, so every piece fits an empty bin and nothing is dropped.  A *token* is a
word, or a mark that is neither word nor white space.

Defined results: null or empty texts are examples of 0 tokens and take one segment; equal rows are
packed one by one; null ids stay null; an empty table has no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 16, 3072
BATCH_ITEMS, BATCH_BYTES = 8192, 1 << 25

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_starts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every token, and the offsets of documents in tokens."""
    s, _, _ = K.bounds(raw, off)
    mark = ~K._IS_WORD[raw] & ~_SPACE[raw]
    start = mark
    start[s] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, off)


def assign(demand: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """Bin of every example of one batch.  Every demand must fit an empty bin."""
    n = len(demand)
    share = demand / np.asarray(limits, float)
    weight = share.mean(axis=0) if n else share.sum(axis=0)
    # equal demand vectors are one kind with a queue of examples: candidates are kinds, not examples
    kinds, which = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")
    head = np.searchsorted(which[order], np.arange(len(kinds)))
    stop = np.append(head[1:], n)
    earliest = order[head] if n else head
    kinds_share = kinds / np.asarray(limits, float) * weight
    out = np.full(n, -1)
    live = np.arange(len(kinds))
    bin_, placed = 0, 0
    while placed < n:
        left = np.asarray(limits, float)
        fit = live
        while len(fit):
            score = kinds_share[fit] @ (left / np.asarray(limits, float))
            best = np.flatnonzero(score == score.max())
            k = fit[best[np.argmin(earliest[best_kinds])]] if len(best_kinds := fit[best]) > 1 else fit[best[0]]
            out[order[head[k]]] = bin_
            left = left - kinds[k]
            placed += 1
            head[k] += 1
            if head[k] == stop[k]:
                live = live[live != k]
                fit = fit[fit != k]
            else:
                earliest[k] = order[head[k]]
            fit = fit[(kinds[fit] <= left).all(axis=1)]
        bin_ += 1
    return out


def cut(loss: np.ndarray, limits: tuple[int, int, int]) -> Iterator[tuple[int, int, int]]:
    """(first token, end, loss-bearing tokens) of the pieces of an example; loss: 0/1 for each token."""
    run = np.concatenate([[0], np.cumsum(loss)])
    a, n = 0, len(loss)
    while True:
        b = min(n, a + limits[0], int(np.searchsorted(run, run[a] + limits[2], "right")) - 1)
        yield a, b, int(run[b] - run[a])
        a = b
        if a >= n:
            return


def pack(examples: DataFrame, id_col: str, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS), batch_items: int = BATCH_ITEMS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece.  ``examples``: ``id_col``, ``parts`` (array of struct<text, loss boolean>).

    Gives ``bin_id``, ``id_col``, ``piece``, ``position`` in the bin, ``first_token`` and ``n_tokens`` of the
    example, ``loss_tokens`` and the ``text`` of the piece."""
    if min(limits) < 1:
        raise ValueError("every limit of a bin must be 1 or more")
    id_type = examples.schema[id_col].dataType.simpleString()

    def pieces(texts: list[str], bears: list[bool]) -> Iterator[tuple[int, int, int, str]]:
        raw, off = K.raw_bytes(pa.array(texts, pa.large_string()))
        at, docs = token_starts(raw, off)
        loss = np.repeat(np.array(bears, bool), np.diff(docs))
        for a, b, n in cut(loss, limits):
            lo = at[a] if a else 0
            hi = at[b] if b < len(at) else len(raw)
            yield a, b, n, raw[lo:hi].tobytes().decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, flushed = TaskContext.get().partitionId(), 0
        items: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            bins = assign(np.array([[x[3] - x[2], 1, x[4]] for x in items], np.int64).reshape(-1, 3), limits)
            order = np.argsort(bins, kind="stable")
            place = np.arange(len(order)) - np.searchsorted(bins[order], bins[order])
            rows = [items[i] for i in order]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part:06d}-{flushed:06d}-{bins[i]:06d}" for i in order]),
                    pa.array([x[0] for x in rows], kind),
                    pa.array([x[1] for x in rows], pa.int32()),
                    pa.array(place, pa.int32()),
                    pa.array([x[2] for x in rows], pa.int32()),
                    pa.array([x[3] - x[2] for x in rows], pa.int32()),
                    pa.array([x[4] for x in rows], pa.int32()),
                    pa.array([x[5] for x in rows], pa.string()),
                ],
                names=["bin_id", id_col, "piece", "position", "first_token", "n_tokens", "loss_tokens", "text"],
            )

        kind = None
        for batch in batches:
            ids, parts = K.column(batch, id_col), K.column(batch, "parts")
            kind = ids.type
            for i, own in enumerate(parts):
                own = own.as_py() or []
                for piece, (a, b, n, text) in enumerate(pieces([x["text"] or "" for x in own if x], [bool(x["loss"]) for x in own if x])):
                    items.append((ids[i].as_py(), piece, a, b, n, text))
                    size += len(text.encode())
                    if len(items) >= batch_items or size >= batch_bytes:
                        yield flush()
                        items, size, flushed = [], 0, flushed + 1
        if items:
            yield flush()

    return examples.select(id_col, "parts").sortWithinPartitions(id_col, F.xxhash64("parts")).mapInArrow(
        K.tidy(run), f"bin_id string, {id_col} {id_type}, piece int, position int, first_token int, n_tokens int, loss_tokens int, text string"
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """Plain documents: every token bears loss."""
    parts = F.array(F.struct(F.col("text"), F.lit(True).alias("loss")))
    return pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), parts.alias("parts")), "doc_id", (MAX_TOKENS, MAX_SEGMENTS, MAX_TOKENS))


def pack_conversations(turns: DataFrame) -> DataFrame:
    """Conversations: only the tokens of assistants' turns bear loss.  Turns stand in the order of
    ``turn``, role and text, nulls first; turns with a null ``conv_id`` form one conversation."""
    turn = F.struct("turn", "role", "text")
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.coalesce(t["text"], F.lit("")), F.lit("\n")).alias("text"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")))
    return pack(grouped.select("conv_id", parts.alias("parts")), "conv_id")
