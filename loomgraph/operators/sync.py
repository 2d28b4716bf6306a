"""Incremental operators: change detection, keyed replacement, quiet periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, modified, removed) from two listings (path, hash)."""
    o, n = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("now"))
    change: Column = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert by key: rows of ``new`` win."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def quiet_sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Bursts of events of a key that end with a pause of ``gap``; runs in batch and, with a watermark, as a stream."""
    s = F.session_window("ts", gap)
    return events.groupBy(key, s).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).drop("session_window")


def pending_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: added, modified, removed."""
    change = F.col("change")
    return diff(old, new).agg(*(F.count_if(change == c).alias(c) for c in ("added", "modified", "removed")))


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose content may differ: new ones, and those of another size or time; others needn't be hashed.  Both: path, size, modified_at."""
    o = old.select("path", F.col("size").alias("old_size"), F.col("modified_at").alias("old_time"))
    both = new.join(o, "path", "left")
    return both.filter(~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("modified_at").eqNullSafe(F.col("old_time")))).select("path")


def pending(events: DataFrame, synced_at: Column) -> DataFrame:
    """path, first_seen and last_seen of files with events after the last sync began."""
    seen = events.groupBy("path").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return seen.filter(F.col("last_seen") > synced_at)


def sync_store(store, tree: DataFrame, version: str = "1", only: list[str] | None = None) -> dict:
    """Bring a store in line with a tree (path, content, size, modified_at, language): extract what changed, drop what went, bind references anew.

    Files of the same size and time aren't read again.  Another ``version`` of the extractor takes all files.  References are kept, so those of unchanged files to names that
    came or went are bound again too."""
    from loomgraph.operators.lineage import cut_lineage
    from loomgraph.operators.resolve import filled, implements_edges, override_calls, resolve
    from loomgraph.sources.extract import extract

    old = store.read("files")
    tree = tree.filter(F.col("path").isin(*only)) if only is not None else tree
    full = store.get_metadata("extractor") != version
    candidates = tree if full else tree.join(touched(old, tree), "path", "left_semi")
    hashed = candidates.withColumn("content_hash", F.sha2("content", 256))
    changed = cut_lineage(hashed if full else hashed.join(old.select("path", "content_hash"), ["path", "content_hash"], "left_anti"))
    gone = old.join(tree.select("path"), "path", "left_anti").select("path") if only is None else old.filter(F.col("path").isin(*only)).join(tree.select("path"), "path", "left_anti").select("path")
    gone = cut_lineage(gone)
    known = old.select("path")
    counts = {"added": changed.join(known, "path", "left_anti").count(), "modified": changed.join(known, "path", "left_semi").count(), "removed": gone.count()}
    if not any(counts.values()):
        return counts
    if full:
        store.delete_files(changed.select("path"))
    store.delete_files(gone)
    bundles = cut_lineage(extract(changed.select("path", "language", "content")))
    store.replace_files(bundles, changed.select("path", "content_hash", "language", "size", "modified_at"))
    nodes = store.read("nodes")
    refs = filled(store.read("refs").withColumn("ref_id", F.concat_ws("|", "from_node", "kind", "name", F.col("line").cast("string"), F.col("col").cast("string"))).dropDuplicates(["ref_id"]), nodes)
    plain = cut_lineage(store.read("edges").filter("kind = 'contains' or provenance in ('modfile', 'package.json')"))
    bound = resolve(refs, nodes, plain).join(refs.select("ref_id", "line"), "ref_id").select("source", "target", "kind", "line", F.lit(None).cast("string").alias("provenance"))
    bound = cut_lineage(bound)
    base = plain.select("source", "target", "kind", "line", "provenance").unionByName(bound)
    made = implements_edges(nodes, base)
    base = cut_lineage(base.unionByName(made))
    store.write("edges", base.unionByName(override_calls(nodes, base).withColumn("line", F.lit(None).cast("int"))).join(plain.select("source", "target", "kind", "metadata").filter("metadata is not null"), ["source", "target", "kind"], "left"))
    store.set_metadata(extractor=version)
    return counts
