"""Least distances from a set of nodes over any number of levels.

Level by level a chain of n links takes n rounds.  Here links are joined first: a node with one way in, or one way out, is taken out and the
ways over it become single links with their lengths added, which leaves all other distances as they are and never gives more links.  Nodes
of which no two are neighbours go at once, about a third of a chain in a round; the few links that stay are solved on the driver, and
nodes come back in reverse, each behind its nearest way in."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.lineage import cut_lineage

#: So many links are solved on the driver.
LOCAL = 50_000


def distances(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """id and least depth of all that is reached from the seeds (id) over links (source, target)."""
    start = cut_lineage(seeds.select("id").distinct())
    rest = links.select(F.col("source").alias("a"), F.col("target").alias("b")).filter("a != b").distinct().withColumn("w", F.lit(1))
    rest = cut_lineage(rest.join(start.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b", "w"))
    n, out, k = rest.count(), [], 0
    while n > LOCAL:
        k, before = k + 1, n
        rest, ways = _without_some(rest, start, k)
        out.append(ways)
        n = rest.count()
        if n > 0.95 * before:  # nothing but knots is left
            break
    found = _solved(rest, start) if n <= LOCAL else _relaxed(rest, start)
    for ways in reversed(out):
        back = ways.join(found.select(F.col("id").alias("a"), "depth"), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        found = cut_lineage(found.unionByName(back))
    return found


def _without_some(links: DataFrame, start: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Links without some of the nodes that have one way in or out at most, and the ways into those."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(links.select(F.col("b").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    free = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o <= 1 or i <= 1").select("id").join(start, "id", "left_anti")
    free = cut_lineage(free)
    inner = links.join(free.select(F.col("id").alias("a")), "a", "left_semi").join(free.select(F.col("id").alias("b")), "b", "left_semi")
    order = lambda c: F.struct(F.xxhash64(F.lit(k), c), c)
    later = inner.select(F.when(order("a") < order("b"), F.col("b")).otherwise(F.col("a")).alias("id"))
    gone = free.join(later, "id", "left_anti")
    mark = lambda c: gone.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_goes"))
    marked = cut_lineage(links.join(mark("a"), "a", "left").join(mark("b"), "b", "left"))
    ways = marked.filter("b_goes").select("a", "b", "w")
    over = ways.select("a", F.col("b").alias("v"), "w").join(marked.filter("a_goes").select(F.col("a").alias("v"), "b", F.col("w").alias("more")), "v").filter("a != b")
    stay = marked.filter("a_goes is null and b_goes is null").select("a", "b", "w")
    return cut_lineage(stay.unionByName(over.select("a", "b", (F.col("w") + F.col("more")).alias("w"))).groupBy("a", "b").agg(F.min("w").alias("w"))), ways


def _solved(links: DataFrame, start: DataFrame) -> DataFrame:
    out: dict = {}
    for r in links.collect():
        out.setdefault(r["a"], []).append((r["b"], r["w"]))
    first = start.join(links.select(F.col("a").alias("id")), "id", "left_semi").collect()
    depth: dict = {}
    heap = [(0, r["id"]) for r in first]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in depth:
            depth[x] = d
            for y, w in out.get(x, ()):
                if y not in depth:
                    heapq.heappush(heap, (d + w, y))
    reached = start.sparkSession.createDataFrame([(x, d) for x, d in depth.items() if d], f"id {start.schema['id'].dataType.simpleString()}, depth int")
    return start.withColumn("depth", F.lit(0)).unionByName(reached)


def _relaxed(links: DataFrame, start: DataFrame) -> DataFrame:
    """Round by round, from the nodes whose depth has changed."""
    changed = found = start.withColumn("depth", F.lit(0))
    while True:
        new = links.join(changed.select(F.col("id").alias("a"), "depth"), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        known = found.select("id", F.col("depth").alias("before"))
        changed = cut_lineage(new.join(known, "id", "left").filter("before is null or depth < before").select("id", "depth"))
        if changed.isEmpty():
            return found
        found = cut_lineage(found.unionByName(changed).groupBy("id").agg(F.min("depth").alias("depth")))
