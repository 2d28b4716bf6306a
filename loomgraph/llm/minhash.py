"""MinHash near-duplicate groups with circulant permutations, banding and exact Jaccard verification.

A document is the set of hashes of its runs of ``SHINGLE`` words (a shorter one is a single shingle of
all its words).  Shingles fall into D slots; a first permutation spreads the slots, a second one, shifted
circularly by 1 .. 160, gives all 160 coordinates of the signature.  Documents that agree in one of 40 bands of 4
coordinates are candidates; pairs count when the Jaccard similarity of their whole shingle sets is at
least ``threshold``; groups are the connected components of such pairs.

Word-for-word copies collapse first.  Candidates are then compared with the smallest member of their
bucket, and every pair of one bucket that is still in two components is compared too, so the groups
equal those of comparing all candidate pairs, while a group of n copies costs n comparisons.

Defined results: texts that are null or have no words belong to no group; rows that repeat
in full belong together; the member kept is the one with the smallest id, null ids last, then by hash
of the text; equal rows count as copies, of which one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import fresh, materialise, row_key

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
SLOT_BITS = 20
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def permutations(bits: int = SLOT_BITS, coordinates: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a view whose row i has the second at slots i-1 .. i-coordinates, circularly."""
    if bits not in _TABLES:
        rng = np.random.default_rng(20240611)
        first, second = rng.permutation(1 << bits).astype(np.uint32), rng.permutation(1 << bits).astype(np.uint32)
        round_ = np.concatenate([second[-coordinates:], second])
        _TABLES[bits] = first, np.lib.stride_tricks.sliding_window_view(round_, coordinates)
    return _TABLES[bits]


def shingles(hashes: np.ndarray) -> np.ndarray:
    return K.grams(hashes, max(1, min(SHINGLE, len(hashes))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Signature of one document with at least one word."""
    first, second = permutations()
    at = first[shingles(hashes) >> np.uint64(64 - SLOT_BITS)]
    best = second[at[:1024]].min(axis=0)
    for lo in range(1024, len(at), 1024):
        np.minimum(best, second[at[lo : lo + 1024]].min(axis=0), out=best)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and document."""
    x = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for j in range(ROWS):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j])
    return key


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th, cid (hash of the word sequence), bands; for documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = K.column(batch, "text")
            for lo, hi in K.chunks(texts):
                w = K.words(texts.slice(lo, hi - lo))
                live = np.flatnonzero(np.diff(w.offsets))
                if not len(live):
                    continue
                each = [w.doc(i) for i in live]
                keys = band_keys(np.stack([signature(x) for x in each]))
                cid = np.array([K.grams(x, len(x))[0] for x in each], np.uint64) ^ K.mix(np.array([len(x) for x in each], np.uint64))
                at = pa.array(live + lo)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel().view(np.int64))
                yield pa.RecordBatch.from_arrays([K.column(batch, "doc_id").take(at), K.column(batch, "th").take(at), pa.array(cid.view(np.int64)), bands], names=["doc_id", "th", "cid", "bands"])

    return docs.select(*row_key(docs)).mapInArrow(K.tidy(run), "doc_id long, th long, cid long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold.  All rows of one a stand together, its own text
    first, so a task keeps one shingle set however many partners there are."""
    roles = pairs.select("a", F.col("b").alias("cid"), F.lit(1).alias("role")).union(
        pairs.select("a", F.col("a").alias("cid"), F.lit(0).alias("role")).distinct()
    )
    rows = roles.join(texts, "cid").repartition("a").sortWithinPartitions("a", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, cid, role = (K.column(batch, c).to_numpy(zero_copy_only=False) for c in ("a", "cid", "role"))
            texts = K.column(batch, "text")
            good = np.zeros(len(a), bool)
            for lo, hi in K.chunks(texts):
                w = K.words(texts.slice(lo, hi - lo))
                for i in range(lo, hi):
                    mine = np.unique(shingles(w.doc(i - lo)))
                    if role[i] == 0:
                        hub, own = a[i], mine
                    elif hub == a[i]:
                        good[i] = jaccard(own, mine) >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(cid[good])], names=["a", "b"])

    return rows.select("a", "cid", "role", "text").mapInArrow(K.tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """cid, comp (smallest cid of its component) of every vertex, by alternating large and small stars."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    star = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = mark(star)
    while before[0]:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        star = materialise(small, "star")
        after = mark(star)
        if after == before:
            break
        before = after
    return star.select(F.col("u").alias("cid"), F.col("v").alias("comp")).union(star.select(F.col("v").alias("cid"), F.col("v").alias("comp"))).distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, kept_doc_id, kept_th and n_docs of every row that is in a group of two rows or more."""
    made = materialise(sketches(docs), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = made.groupBy("cid").agg(F.min(first).alias("first"), F.first("bands").alias("bands"))
    buckets = (
        classes.select("cid", F.explode("bands").alias("band"))
        .groupBy("band")
        .agg(F.sort_array(F.collect_set("cid")).alias("cids"))
        .filter(F.size("cids") > 1)
        .select("cids")
        .distinct()
    )
    buckets = materialise(buckets, "buckets")
    pairs = buckets.select(F.col("cids")[0].alias("a"), F.explode(F.slice("cids", 2, F.size("cids"))).alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    needed = buckets.select(F.explode("cids").alias("cid")).distinct().join(classes.select("cid", "first.doc_id", "first.th"), "cid")
    d = docs.select(*row_key(docs))
    # one row for each class: a class whose first row repeats would join more than once
    texts = needed.join(d, needed["doc_id"].eqNullSafe(d["doc_id"]) & (needed["th"] == d["th"])).select("cid", d["text"])
    texts = materialise(texts.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("cid"))).filter("n = 1").drop("n"), "texts")
    sure = materialise(verified(pairs, texts, threshold), "sure")
    comp = components(sure)

    # pairs of a bucket that are in two components after the first round
    member = buckets.select(F.xxhash64("cids").alias("bucket"), F.explode("cids").alias("cid")).join(comp, "cid", "left")
    member = member.select("bucket", "cid", F.coalesce("comp", "cid").alias("comp"))
    mixed = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket")
    member = materialise(member.join(mixed, "bucket"), "mixed")
    l, r = member.alias("l"), member.alias("r")
    left = l.join(r, (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.cid") < F.col("r.cid")) & (F.col("l.comp") != F.col("r.comp")))
    left = left.select(F.col("l.cid").alias("a"), F.col("r.cid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialise(verified(left, texts, threshold), "more")
    comp = components(comp.select(F.col("cid").alias("a"), F.col("comp").alias("b")).union(more))

    rows = made.drop("bands").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    kept = rows.groupBy("comp").agg(F.min(first).alias("kept"), F.count("*").alias("n_docs")).filter("n_docs > 1")
    return rows.join(kept, "comp").select("doc_id", "th", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.th").alias("kept_th"), "n_docs")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of a group: ``doc_id``, ``kept_doc_id`` (the member that stays) and ``n_docs``."""
    return groups(docs, threshold).select("doc_id", "kept_doc_id", "n_docs")


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group, all columns kept."""
    i, t, k, n = fresh(docs, "dup_id", "dup_th", "dup_kept", "dup_n")
    verdict = groups(docs, threshold).groupBy("doc_id", "th").agg(F.max((F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))) & (F.col("th") == F.col("kept_th"))).alias(k))
    verdict = verdict.select(F.col("doc_id").alias(i), F.col("th").alias(t), k)
    hashed = docs.withColumn(n, F.xxhash64("text"))
    ours = hashed[docs.columns[[c.lower() for c in docs.columns].index("doc_id")]].cast("long")
    joined = hashed.join(verdict, ours.eqNullSafe(verdict[i]) & (hashed[n] == verdict[t]), "left")
    # rows that repeat in full are copies of which one stays
    order = F.row_number().over(Window.partitionBy(i, t).orderBy(F.lit(1)))
    stay = joined.filter(F.col(k).isNull()).select(*docs.columns)
    return stay.unionByName(joined.filter(F.col(k)).withColumn(n, order).filter(F.col(n) == 1).select(*docs.columns))
