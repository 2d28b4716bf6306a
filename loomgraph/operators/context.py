"""Assembling an answer from a graph: recovered edges, glue, trails, caps and file scores."""

from __future__ import annotations

from functools import cmp_to_key, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import USES, induced_edges, neighbours

RECOVERED = ("calls", "extends", "implements", "references", "overrides")


def recovered_edges(edges: DataFrame, ids: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of five kinds between the nodes that aren't known yet."""
    more = induced_edges(edges.filter(F.col("kind").isin(*RECOVERED)), ids)
    return more.join(known.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti").select(*edges.columns)


def merged_edges(*parts: DataFrame) -> DataFrame:
    """Union with one row for each source, target and kind, that of the least line."""
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("source", "target", "kind").agg(F.min("line").alias("line"))


def dynamic_links(edges: DataFrame, named: DataFrame, limit: int = 6) -> DataFrame:
    """Edges found by heuristics that touch a named node, one for each pair."""
    touch = edges.filter("provenance = 'heuristic'").select("source", "target", "kind", "line")
    own = named.select("id").distinct()
    hit = touch.join(own.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(touch.join(own.withColumnRenamed("id", "target"), "target", "left_semi"))
    return hit.groupBy("source", "target").agg(F.min(F.struct("line", "kind")).alias("e")).select("source", "target", "e.kind", "e.line").orderBy("source", "target").limit(limit)


def annotation(metadata: Column, provenance: Column, kind: Column) -> Column:
    """How an edge came about, in words; null for those that stand in the source."""
    by = F.try_element_at(metadata, F.lit("synthesizedBy"))
    words = {"callback": "registered as a callback", "event": "by an event", "interface": "through an interface", "route": "by a route"}
    named = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.coalesce(named[by], by, F.when((provenance == "heuristic") & (kind == "calls"), "through an interface").when(provenance == "heuristic", "by its members"))


def glue(nodes: DataFrame, edges: DataFrame, roots: DataFrame, files: DataFrame, limit: int = 60) -> DataFrame:
    """Neighbours of the roots, either way, that lie in files which are shown already."""
    near = neighbours(nodes, edges, roots, True).unionByName(neighbours(nodes, edges, roots, False)).join(roots.select("id"), "id", "left_anti")
    return near.join(files.select("file_path"), "file_path", "left_semi").groupBy("id").agg(F.min("line").alias("line")).orderBy("line", "id").limit(limit)


def trail(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int = 12) -> DataFrame:
    """The first callers and callees of a node: side, id, name, line."""
    side = lambda incoming, name: neighbours(nodes, edges, seeds, incoming).orderBy("line", "id").limit(limit).select(F.lit(name).alias("side"), "id", "name", "line")
    return side(True, "caller").unionByName(side(False, "callee"))


def outline(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What the seeds contain, in the order of lines."""
    inside = edges.filter("kind = 'contains'").join(seeds.select(F.col("id").alias("source")), "source", "left_semi").select("source", F.col("target").alias("id")).distinct()
    place = F.row_number().over(Window.partitionBy("source").orderBy("start_line", "id"))
    return inside.join(nodes, "id").select("source", "id", "name", "kind", "start_line", place.alias("place"))


def import_definitions(nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with imports and exports replaced by what they lead to."""
    own = hits.select("id").distinct().join(nodes.select("id", "kind"), "id")
    through = own.filter("kind in ('import', 'export')").select(F.col("id").alias("source"))
    there = edges.filter("kind in ('imports', 'exports')").join(through, "source", "left_semi").select(F.col("target").alias("id"))
    return own.filter("kind not in ('import', 'export')").select("id").unionByName(there).distinct()


def capped(hits: DataFrame, is_plain: Column, limit: int) -> DataFrame:
    """Hits (id, file_path, priority) by priority, with at most a fifth of ``limit``, or 5, from one file, and at most 15 %, or 3, of those
    outside of production code."""
    w = Window.partitionBy("file_path").orderBy(F.desc("priority"), "id")
    own = hits.withColumn("of_file", F.row_number().over(w)).filter(F.col("of_file") <= max(5, limit // 5)).withColumn("plain", is_plain)
    own = own.withColumn("of_rest", F.row_number().over(Window.partitionBy("plain").orderBy(F.desc("priority"), "id")))
    return own.filter(F.col("plain") | (F.col("of_rest") <= max(3, limit * 15 // 100))).orderBy(F.desc("priority"), "id").limit(limit).select("id", "file_path", "priority")


def file_scores(nodes: DataFrame, edges: DataFrame, entries: DataFrame, named: DataFrame, terms: list[str]) -> DataFrame:
    """By file: the sum of weights of its nodes (50 for entries, 10 for named ones, 3 for neighbours of entries, else 1), how many distinct terms its
    path and names have, and its count of nodes."""
    e = entries.select("id", F.lit(50).alias("e")).distinct()
    n = named.select("id", F.lit(10).alias("m")).distinct()
    uses = edges.filter(F.col("kind").isin(*USES))
    near = uses.join(entries.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).unionByName(uses.join(entries.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")))
    near = near.distinct().withColumn("k", F.lit(3))
    rows = nodes.select("id", "file_path", F.lower("name").alias("low")).join(e, "id", "left").join(n, "id", "left").join(near, "id", "left")
    has = [F.max(F.contains("low", F.lit(t)) | F.contains(F.lower("file_path"), F.lit(t))).cast("int") for t in terms]
    return rows.groupBy("file_path").agg(F.sum(F.coalesce("e", "m", "k", F.lit(1))).alias("score"), reduce(lambda a, b: a + b, has, F.lit(0)).alias("n_terms"), F.count("*").alias("n_nodes"))


def explore_order(files: list[dict], tolerance: float = 0.01) -> list[dict]:
    """A short list of files, best first: with a named seed, by graph score unless the two differ by less than the tolerance of the greater, by terms,
    ordinary before low-value and generated ones, by score, by nodes, by path.  The tolerance makes the order depend on pairs, so it
    runs on the driver over the few files that are shown."""

    def compare(a: dict, b: dict) -> int:
        for key in ("seed", "graph", "n_terms", "low_value", "generated", "score", "n_nodes"):
            x, y = a.get(key, 0), b.get(key, 0)
            if key == "graph" and abs(x - y) <= tolerance * max(x, y):
                continue
            if x != y:
                return (1 if x > y else -1) if key in ("low_value", "generated") else (-1 if x > y else 1)
        return (a["file_path"] > b["file_path"]) - (a["file_path"] < b["file_path"])

    return sorted(files, key=cmp_to_key(compare))
