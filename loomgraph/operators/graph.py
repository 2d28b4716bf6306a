"""Graph operators over nodes (id, kind, name, file_path, …) and edges (source, target, kind, line).

Traversals are loops over frontiers: each level is one join of the frontier with the edges, and the lineage
is cut by a checkpoint in the shared folder where the session names one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.distance import distances
from loomgraph.operators.lineage import cut_lineage
from loomgraph.operators.walk import walk

USES = ("calls", "references", "imports")
CONTAINERS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
RANKED = ("calls", "references", "extends", "implements", "overrides", "instantiates", "returns", "type_of", "imports")
LINKS = ("extends", "implements")


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, incoming: bool, kinds: tuple[str, ...] = USES) -> DataFrame:
    """Callers (incoming) or callees of the seeds (a column ``id``): each neighbour once, with its first edge."""
    near, far = ("target", "source") if incoming else ("source", "target")
    hits = edges.filter(F.col("kind").isin(*kinds)).join(seeds.select(F.col("id").alias(near)), near, "left_semi").filter("source != target")
    first = hits.groupBy(F.col(far).alias("id")).agg(F.min(F.struct("line", F.col("kind").alias("edge_kind"))).alias("e"))
    return first.join(nodes, "id").select("id", "name", "kind", "file_path", "start_line", F.col("e.line").alias("line"), F.col("e.edge_kind").alias("edge_kind"))


def children(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    inside = edges.filter("kind = 'contains'").join(seeds.select(F.col("id").alias("source")), "source", "left_semi")
    return inside.join(nodes.select(F.col("id").alias("target"), "name", "start_line"), "target").select("source", "target", "name", "start_line")


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``; also the endpoint check of inserts and the cascade of deletes."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)


def file_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct pairs of files of which one depends on the other."""
    own = nodes.select("id", "file_path")
    return (
        edges.filter(~F.col("kind").isin("contains", "imports"))
        .join(own.select(F.col("id").alias("source"), F.col("file_path").alias("from_file")), "source")
        .join(own.select(F.col("id").alias("target"), F.col("file_path").alias("to_file")), "target")
        .filter("from_file != to_file")
        .select("from_file", "to_file")
        .distinct()
    )


def dominant_file(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """Files by the count of edges inside them, with the count of the runner-up."""
    own = nodes.select("id", "file_path")
    inside = (
        edges.join(own.select(F.col("id").alias("source"), F.col("file_path").alias("file")), "source")
        .join(own.select(F.col("id").alias("target"), F.col("file_path").alias("other")), "target")
        .filter("file = other")
        .groupBy("file")
        .agg(F.count("*").alias("n_edges"))
        .orderBy(F.desc("n_edges"), "file")
        .limit(top)
    )
    return inside.withColumn("runner_up", F.lead("n_edges").over(Window.orderBy(F.desc("n_edges"), "file")))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None, both: bool = False) -> DataFrame:
    """id and least depth of everything reached from the seeds along source -> target; depth None: until no
    more is found.  Cycles end as each id enters once."""
    step = edges.select("source", "target")
    if both:
        step = step.union(step.select(F.col("target").alias("source"), F.col("source").alias("target")))
    if depth is None:
        return distances(step, seeds)
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier, level = seen, 0
    while level < depth:
        level += 1
        found = step.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        frontier = cut_lineage(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Everything that uses the seeds within ``depth`` steps, 1 to 10, with its least depth.

    Containers above the last level take what they contain along at their own depth, as using a member is using its container; other
    edges than containment are followed backwards."""
    inside = edges.filter("kind = 'contains'").join(nodes.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("source")), "source", "left_semi").select("source", "target")
    back = edges.filter("kind != 'contains'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    seen, frontier = None, cut_lineage(seeds.select("id").distinct().join(nodes.select("id"), "id", "left_semi").withColumn("depth", F.lit(0)))
    for level in range(max(1, min(10, depth))):
        seen = frontier if seen is None else seen.unionByName(frontier)
        members = frontier
        while True:
            members = cut_lineage(_next(inside, members, level).join(seen, "id", "left_anti"))
            if members.isEmpty():
                break
            seen, frontier = seen.unionByName(members), frontier.unionByName(members)
        frontier = cut_lineage(_next(back, frontier, level + 1).join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
    return seen.unionByName(frontier).join(nodes, "id").select("id", "name", "kind", "file_path", "start_line", "depth")


def _next(step: DataFrame, frontier: DataFrame, depth: int) -> DataFrame:
    found = step.join(frontier.select(F.col("id").alias("source")), "source", "left_semi")
    return found.select(F.col("target").alias("id")).distinct().withColumn("depth", F.lit(depth))


def affected_tests(uses: DataFrame, changed: DataFrame, is_test, depth: int = 5) -> DataFrame:
    """Tests among the changed files and among those that depend on them, with their least distance.

    ``uses``: (from_file, to_file); ``changed``: (file); a test is an end: what depends on it doesn't count."""
    back = cut_lineage(uses.select(F.col("to_file").alias("file"), F.col("from_file").alias("next")).filter("file != next").distinct())
    seen = changed.select("file").distinct().withColumn("distance", F.lit(0))
    frontier = seen.filter(~is_test(F.col("file")))
    for level in range(1, depth + 1):
        found = back.join(frontier.select("file"), "file", "left_semi").select(F.col("next").alias("file")).distinct()
        frontier = cut_lineage(found.join(seen, "file", "left_anti").withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        frontier = frontier.filter(~is_test(F.col("file")))
    return seen.filter(is_test(F.col("file")))


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", edge_kinds: tuple[str, ...] = (), node_kinds: tuple[str, ...] = (), limit: int = 1000) -> DataFrame:
    """Breadth first with filters: id, depth and ``ord``, the place in the walk: by depth, then contained nodes, called ones and
    others, then id; the first ``limit`` in this order."""
    kept = edges.filter(F.col("kind").isin(*edge_kinds)) if edge_kinds else edges
    rank = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2).alias("rank")
    out, back = kept.select("source", "target", rank), kept.select(F.col("target").alias("source"), F.col("source").alias("target"), rank)
    step = out if direction == "out" else back if direction == "in" else out.unionByName(back)
    if node_kinds:
        step = step.join(nodes.filter(F.col("kind").isin(*node_kinds)).select(F.col("id").alias("target")), "target", "left_semi")
    seen = frontier = seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(0).alias("rank"))
    for level in range(1, depth + 1):
        found = step.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.lit(level).alias("depth"), F.min("rank").alias("rank"))
        frontier = cut_lineage(found.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    first = seen.orderBy("depth", "rank", "id").limit(limit)
    return first.select("id", "depth", F.row_number().over(Window.orderBy("depth", "rank", "id")).alias("ord"))


def flow_path(edges: DataFrame, named: DataFrame, hops: int = 7, bridge: int = 1, seeds: int = 8) -> DataFrame:
    """The longest chain of calls between named nodes: ord, id.  At most ``hops`` nodes, at most ``bridge`` in a row that aren't named;
    each node is reached once from a seed, over the least path; the first ``seeds`` named ids start.  Fewer than 3 nodes are no path."""
    calls = cut_lineage(edges.filter("kind = 'calls' and source != target").select("source", "target").distinct())
    names = cut_lineage(named.select(F.col("id").alias("target"), F.lit(True).alias("known")).distinct())
    start = names.select(F.col("target").alias("seed")).orderBy("seed").limit(seeds)
    frontier = cut_lineage(start.select("seed", F.col("seed").alias("id"), F.lit(0).alias("streak"), F.array("seed").alias("path"), F.lit(True).alias("known")))
    seen = frontier
    for _ in range(hops - 1):
        found = frontier.select("seed", F.col("id").alias("source"), "streak", "path").join(calls, "source").join(names, "target", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        found = found.withColumn("streak", F.when(F.col("known"), 0).otherwise(F.col("streak") + 1)).filter(F.col("streak") <= bridge)
        best = found.groupBy("seed", F.col("target").alias("id")).agg(F.min(F.struct("path", "streak", "known")).alias("b"))
        best = best.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        frontier = cut_lineage(best.select("seed", "id", "b.streak", F.concat("b.path", F.array("id")).alias("path"), "b.known"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    longest = seen.filter("known").select("path", F.size("path").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "path").limit(1)
    return longest.select(F.posexplode("path").alias("ord", "id"))


def matched(nodes: DataFrame, symbol: str) -> DataFrame:
    """What a verb works on: of the 50 best hits those with the very name, ``.name`` or ``::name`` at the end; the best hit if there is just one."""
    from loomgraph.functions.text import is_exact_verb
    from loomgraph.operators.search import search

    hits = cut_lineage(search(nodes, symbol, 50).select("id", "name", "rank"))
    return hits.withColumn("exact", is_exact_verb(F.col("name"), symbol) | (F.lit(hits.count()) == 1))


def callers_of(nodes: DataFrame, edges: DataFrame, symbol: str, incoming: bool = True, limit: int = 20) -> DataFrame:
    """Callers or callees of what matches a symbol, the first ``limit`` by line; where that gives nothing, those of the best hit."""
    hits = matched(nodes, symbol)
    found = cut_lineage(neighbours(nodes, edges, hits.filter("exact"), incoming))
    if found.isEmpty():
        found = neighbours(nodes, edges, hits.filter("rank = 1"), incoming)
    return found.orderBy("line", "id").limit(limit)


def impact_of(nodes: DataFrame, edges: DataFrame, symbol: str, depth: int = 2) -> DataFrame:
    """Impact of what matches a symbol, else of the best hit, by name, file and line."""
    hits = matched(nodes, symbol)
    seeds = hits.filter("exact")
    return impact(nodes, edges, hits.filter("rank = 1") if seeds.isEmpty() else seeds, depth).orderBy("name", "file_path", "start_line", "id")


def hierarchy(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ancestors and descendants over extends and implements."""
    links = edges.filter(F.col("kind").isin(*LINKS)).select("source", "target")
    up = reach(links, seeds, None).withColumn("side", F.lit("ancestor"))
    down = reach(links.select(F.col("target").alias("source"), F.col("source").alias("target")), seeds, None).withColumn("side", F.lit("descendant"))
    return up.unionByName(down).filter("depth > 0").select("id", "side", "depth")


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 25, restart: float = 0.25) -> DataFrame:
    """Random walk with restart on the undirected multigraph; a node without edges keeps its mass, without seeds all nodes are."""
    return walk(nodes, edges, seeds.select("id").distinct().join(nodes.select("id"), "id", "left_semi"), rounds, restart)


def fan_in(edges: DataFrame, least: int = 3) -> DataFrame:
    return edges.filter(F.col("kind").isin(*LINKS)).groupBy("target").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def blast_radius(nodes: DataFrame, edges: DataFrame, is_test=None) -> DataFrame:
    """Distinct callers of every node that is used, and their files: tests and others apart if ``is_test`` is given."""
    uses = edges.filter(F.col("kind").isin(*USES) & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    own = nodes.select(F.col("id").alias("source"), "file_path")
    by_file = uses.join(own, "source").groupBy("target", "file_path").agg(F.count("*").alias("n"))
    files = [F.count("*").alias("n_files")] if is_test is None else [F.count_if(is_test(F.col("file_path"))).alias("n_test_files"), F.count_if(~is_test(F.col("file_path"))).alias("n_files")]
    return by_file.groupBy(F.col("target").alias("id")).agg(F.sum("n").alias("n_callers"), *files)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges, all and by kind, and of files by language; each table is read once for its kinds."""

    def kinds(df: DataFrame, what: str) -> DataFrame:
        return df.rollup("kind").agg(F.count("*").alias("n"), F.grouping("kind").alias("g")).select(F.lit(what).alias("what"), F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("value"), "n")

    files = nodes.select("file_path", "language").distinct().groupBy("language").agg(F.count("*").alias("n"))
    return reduce(DataFrame.union, [kinds(nodes, "nodes"), kinds(edges, "edges"), files.select(F.lit("files"), "language", "n")])


def rollup(edges: DataFrame, own: DataFrame, values: list[str]) -> DataFrame:
    """Sums over each node and all it contains, at any depth: id and ``values``.  A node that is reached twice counts once."""
    inside = cut_lineage(edges.filter("kind = 'contains' and source != target").select(F.col("source").alias("up"), F.col("target").alias("id")).distinct())
    pairs = frontier = inside.select(F.col("up").alias("id"), F.col("id").alias("member"))
    while True:
        found = frontier.select(F.col("id"), F.col("member").alias("up")).join(inside.select("up", F.col("id").alias("member")), "up").select("id", "member").distinct()
        frontier = cut_lineage(found.join(pairs, ["id", "member"], "left_anti"))
        if frontier.isEmpty():
            break
        pairs = cut_lineage(pairs.unionByName(frontier))
    each = own.select("id", F.col("id").alias("member")).unionByName(pairs).distinct().join(own.withColumnRenamed("id", "member"), "member")
    return each.groupBy("id").agg(*(F.sum(v).alias(v) for v in values))
