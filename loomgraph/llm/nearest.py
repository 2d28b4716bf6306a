"""Exact nearest neighbours by columnar branch-and-bound.

Vectors lie in blocks stored dimension by dimension.  For a tile of queries, squared distances to a block are
accumulated a few dimensions at a time.  What the rest can add lies between (|q'| - |x'|)**2 and
(|q'| + |x'|)**2 with the masses q', x' of the remaining dimensions; a candidate whose lower bound is above the k-th smallest
upper bound so far is dropped, and survivors are compacted before the next dimensions.  Survivors of
all dimensions are measured again in double precision, so distances and ties are exact.

Queries are the rows whose id is divisible by ``every`` (with 1 all rows, those without an id too), each against all other rows.  A task has one block of
queries and a share of the data blocks, which it meets one at a time, carrying the k best of each query along; the k best
of all shares are merged.  So a task holds one block of either side, and only blocks and k rows a query and share are shuffled.

Defined results: vectors that are null, of another length than most, or with null or non-finite parts are left out; a
row is no neighbour of itself, but rows that repeat are neighbours at distance 0; ties go to the
smaller id, null ids last; fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import materialise

NEIGHBOURS, DIMS_AT_ONCE = 10, 16
EVERY = 50  # of the query op7: one row in so many ids is a query
SHARES = 32  # tasks that few queries are spread over
DATA_ROWS, TILE, PAIRS, PIVOTS = 8192, 128, 1 << 14, 64
_LAST = np.iinfo(np.int64).max  # stands for a null id
_SLACK = 1e-4  # single precision sums are off by far less than this share of the masses


class Block:
    """Vertical layout: one contiguous row per dimension, and the masses left from each step on."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, step: int = DIMS_AT_ONCE):
        self.exact = vectors.astype(np.float64)
        self.columns = np.ascontiguousarray(vectors.T.astype(np.float32))
        self.ids, self.rows, self.step = ids, rows, step
        starts = range(0, vectors.shape[1] + step, step)
        self.mass = [np.sqrt((self.exact[:, s:] ** 2).sum(axis=1)).astype(np.float32) for s in starts]
        self.square = [(self.columns[s : s + step] ** 2).sum(axis=0) for s in range(0, vectors.shape[1], step)]


class Best:
    """The k smallest (distance, id, row) of each of n queries; infinite where there are fewer."""

    def __init__(self, n: int, k: int):
        self.d = np.full((n, k), np.inf)
        self.id, self.row = np.full((n, k), _LAST), np.full((n, k), _LAST)

    def add(self, lo: int, hi: int, q: np.ndarray, d: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge pairs of the queries lo + q with those that are there."""
        k = self.d.shape[1]
        q = np.concatenate([np.repeat(np.arange(hi - lo), k), q])
        d, ids, rows = (np.concatenate([x[lo:hi].ravel(), y]) for x, y in ((self.d, d), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, d, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(hi - lo))
        top = order[(first[:, None] + np.arange(k)).ravel()]
        for mine, x in ((self.d, d), (self.id, ids), (self.row, rows)):
            mine[lo:hi] = x[top].reshape(-1, k)


def search(q: Block, x: Block, best: Best) -> int:
    """Improve ``best`` with block x; gives the count of pairs that were measured in full.

    A tile of queries goes through the dimensions together: a candidate stays while any query of the tile may need it."""
    n, k, reached = len(q.rows), best.d.shape[1], 0
    for lo in range(0, n, TILE):
        hi = min(n, lo + TILE)
        bound = best.d[lo:hi, -1] * (1 + 1e-9)
        live, acc = np.arange(len(x.rows)), np.float32(0)
        columns, off = x.columns, _SLACK * (q.mass[0][lo:hi, None] ** 2 + x.mass[0][None, :] ** 2)
        for step in range(len(q.square)):
            dim = slice(step * q.step, (step + 1) * q.step)
            acc = acc + q.square[step][lo:hi, None] + x.square[step][live][None, :] - 2 * (q.columns[dim, lo:hi].T @ columns[dim])
            a, b = q.mass[step + 1][lo:hi, None], x.mass[step + 1][live][None, :]
            if len(live) > k and (step in (0, len(q.square) - 1) or np.isinf(bound).any()):
                # the row itself may be among the candidates
                bound = np.minimum(bound, np.partition(acc + (a + b) ** 2 + off, k, axis=1)[:, k])
            near = acc + (a - b) ** 2 - off <= np.nextafter(bound.astype(np.float32), np.float32(np.inf))[:, None]
            keep = near.any(axis=0)
            if step + 1 < len(q.square) and keep.mean() < 0.7:
                live, acc, off, columns = live[keep], acc[:, keep], off[:, keep], columns[:, keep]
        i, j = np.nonzero(near)
        j = live[j]
        other = x.rows[j] != q.rows[lo + i]
        i, j = i[other], j[other]
        reached += len(i)
        d = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            own = slice(at, at + PAIRS)
            d[own] = ((x.exact[j[own]] - q.exact[lo + i[own]]) ** 2).sum(axis=1)
        best.add(lo, hi, i, d, x.ids[j], x.rows[j])
    return reached


def neighbours(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = 1) -> DataFrame:
    """``vec_id``, ``rank`` from 1, ``neighbour_id`` and Euclidean ``distance`` of the k nearest of every row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    )
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    rows = rows.join(F.broadcast(usual), F.size("v") == F.col("d"))
    # ids of rows are fixed by writing them, so that a repeated task sees the same ones
    stored = materialise(rows.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    asks = F.lit(True) if every == 1 else F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    count, most, asked = stored.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs))), F.count_if(asks)).first()
    # a power of two keeps all squares finite and changes no digit
    scale = 2.0 ** -np.frexp(most)[1] if most else 1.0
    blocks, own_blocks = max(1, -(-count // DATA_ROWS)), max(1, -(-asked // DATA_ROWS))
    shares = min(blocks, -(-SHARES // own_blocks))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        numbered = df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
        return materialise(numbered.groupBy("block").agg(F.collect_list(F.struct("vec_id", "row", "v")).alias("rows")), name)

    number = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name))
    queries, data = packed(stored.filter(asks), own_blocks, "queries"), packed(stored, blocks, "blocks")
    sides = (
        queries.withColumnRenamed("block", "own").crossJoin(number(shares, "share")).select("own", "share", F.lit(-1).alias("other"), "rows")
        .union(data.crossJoin(number(own_blocks, "own")).select("own", F.col("block") % shares, "block", "rows"))
    )

    def block(rows: pa.Array) -> Block:
        flat = rows.flatten()
        v = flat.field("v")
        values = v.flatten().to_numpy().reshape(len(v), -1) * scale
        ids = flat.field("vec_id").fill_null(_LAST).to_numpy()
        pivots = values[np.argsort(flat.field("row").to_numpy(), kind="stable")[:PIVOTS]]
        order = np.argsort(((pivots**2).sum(axis=1) - 2 * values @ pivots.T).argmin(axis=1), kind="stable")  # like vectors share a tile
        return Block(values[order], ids[order], flat.field("row").to_numpy()[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best, at = None, None, None

        def result() -> pa.RecordBatch:
            i, r = np.nonzero(np.isfinite(best.d))
            own, other = q.ids[i], best.id[i, r]
            return pa.RecordBatch.from_arrays(
                [pa.array(q.rows[i]), pa.array(own, mask=own == _LAST), pa.array(best.d[i, r]), pa.array(other, mask=other == _LAST), pa.array(best.row[i, r])], names=["row", "vec_id", "d", "neighbour_id", "other"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                rows = K.column(batch, "rows").slice(i, 1)
                own, share, other = (K.column(batch, c)[i].as_py() for c in ("own", "share", "other"))
                if (own, share) != at:
                    if q is not None:
                        yield result()
                    q, at = None, (own, share)
                if other < 0:
                    q = block(rows)
                    best = Best(len(q.rows), k)
                elif q is not None:  # no queries may have fallen into the block
                    search(q, block(rows), best)
        if q is not None:
            yield result()

    found = sides.repartition(own_blocks * shares, "own", "share").sortWithinPartitions("own", "share", "other").mapInArrow(run, "row long, vec_id long, d double, neighbour_id long, other long")
    nearest_first = Window.partitionBy("row").orderBy("d", F.col("neighbour_id").asc_nulls_last(), "other")
    ranked = found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k)
    return ranked.select("vec_id", "rank", "neighbour_id", F.round(F.sqrt("d") / scale, 6).alias("distance"))


ORACLE = f"""
SELECT vec_id, rank::INTEGER AS rank, neighbour_id, round(sqrt(d), 6) AS distance FROM (
SELECT a.vec_id, b.vec_id AS neighbour_id, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b,
LATERAL (SELECT list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d)
WHERE a.vec_id <> b.vec_id AND a.vec_id % {EVERY} = 0) WHERE rank <= {NEIGHBOURS}"""
