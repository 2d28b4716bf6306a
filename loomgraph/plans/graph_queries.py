"""Queries of traversals and of assembling answers from the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import context, graph
from loomgraph.plans.registry import SYMBOLS_CTE, query
from loomgraph.plans.search_queries import _rank_sql
from loomgraph.sources import projection as P

C = F.col
PART, HUB = "blue anvil", "part:7"
_CONTAINERS = ", ".join(f"'{k}'" for k in graph.CONTAINERS)


def _impact_sql(seeds: str, depth: int) -> str:
    """CTEs that end in ``hit``: id, depth."""
    return f""", step AS (SELECT target AS a, source AS b, 1 AS cost FROM edges WHERE kind <> 'contains' UNION SELECT e.source, e.target, 0 FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind = 'contains' AND n.kind IN ({_CONTAINERS})),
r AS (SELECT id, 0 AS depth FROM ({seeds}) UNION SELECT step.b, r.depth + step.cost FROM r JOIN step ON step.a = r.id WHERE r.depth < {depth}), hit AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)"""


_REFS = " SELECT n.id, n.name, n.kind, n.file_path, n.start_line, h.depth FROM hit h JOIN nodes n USING (id)"
_SEEDS = f"SELECT id FROM nodes WHERE name = '{PART}' OR id IN ('nation:3', 'region:2')"


@query(_impact_sql(_SEEDS, 2) + _REFS)
def impact_depth2(spark, sf_dir):
    """Seeds are parts, a module, which takes its customers and suppliers along, and a namespace, which doesn't."""
    nodes, edges = P.graph(spark, sf_dir)
    return graph.impact(nodes, edges, nodes.filter((C("name") == PART) | C("id").isin("nation:3", "region:2")), 2)


def _full(nodes):
    return nodes.select("*", C("name").alias("qualified_name"), F.lit("").alias("docstring"), F.lit("").alias("signature"))


def _match_sql(symbol: str) -> str:
    """CTEs that end in ``found``: the nodes that a verb works on."""
    ranked = _rank_sql(symbol, "words", 50)
    inner = ranked[len(SYMBOLS_CTE) :]
    at = inner.index("\nSELECT '")
    return f""", symbols AS (SELECT *, name AS qualified_name, '' AS docstring, '' AS signature FROM nodes){inner[:at]},
top50 AS ({inner[at:]}), found AS (SELECT id FROM top50 WHERE name = '{symbol}' OR ends_with(name, '.{symbol}') OR ends_with(name, '::{symbol}') OR (SELECT count(*) FROM top50) = 1)"""


def _verb_sql(symbol: str, near: str, far: str) -> str:
    return _match_sql(symbol) + f""", links AS (SELECT e.{far} AS id, e.line, e.kind AS edge_kind FROM edges e JOIN found s ON s.id = e.{near} WHERE e.kind IN ('calls', 'references', 'imports') AND source <> target),
firsts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, edge_kind) AS r FROM links)
SELECT n.id, n.name, n.kind, n.file_path, n.start_line, b.line, b.edge_kind FROM firsts b JOIN nodes n ON n.id = b.id WHERE r = 1 ORDER BY b.line, n.id LIMIT 20"""


@query(_verb_sql(PART, "target", "source"))
def callers_first_edge(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.callers_of(_full(nodes), edges, PART)


@query(_verb_sql(PART, "source", "target"))
def callees_of_symbol(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.callers_of(_full(nodes), edges, PART, incoming=False)


@query(_match_sql("red widget") + _impact_sql("SELECT id FROM found", 2).replace(" r AS", " rr AS").replace("FROM r ", "FROM rr ").replace("SELECT step.b, r.depth", "SELECT step.b, rr.depth").replace("= r.id WHERE r.depth", "= rr.id WHERE rr.depth").replace("\nr AS (", "\nrr AS (") + _REFS)
def impact_of_symbol(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.impact_of(_full(nodes), edges, "red widget")


# -- files ----------------------------------------------------------------------------------------------------------

# each symbol's file uses the file of the symbol with a third of its number; files of tests are ends
_USES = f"uses AS (SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file FROM symbols a JOIN symbols b ON b.seq = floor(a.seq / 3) AND a.file_path <> b.file_path)"
_IS_TEST = f"regexp_matches({{}}, '{paths.AFFECTED_TEST}')"


@query(
    f"""{SYMBOLS_CTE}, {_USES}, changed AS (SELECT DISTINCT file_path AS file FROM symbols WHERE seq < 40),
r AS (SELECT file, 0 AS distance FROM changed UNION SELECT u.from_file, r.distance + 1 FROM r JOIN uses u ON u.to_file = r.file WHERE r.distance < 3 AND NOT {_IS_TEST.format('r.file')})
SELECT file, min(distance) AS distance FROM r WHERE {_IS_TEST.format('file')} GROUP BY file""",
    with_graph=False,
)
def affected_files(spark, sf_dir):
    s = P.symbols(spark, sf_dir).select("seq", "file_path")
    used = s.select((C("seq")).alias("k"), C("file_path").alias("to_file"))
    uses = s.join(used, F.floor(C("seq") / 3) == C("k")).select(C("file_path").alias("from_file"), "to_file").filter("from_file != to_file").distinct()
    return graph.affected_tests(uses, s.filter("seq < 40").select(C("file_path").alias("file")), paths.is_affected_test, 3)


@query(f"SELECT target AS id, count(DISTINCT source) AS n_callers, count(DISTINCT file_path) FILTER (WHERE contains(file_path, 'URGENT')) AS n_test_files, count(DISTINCT file_path) FILTER (WHERE NOT contains(file_path, 'URGENT')) AS n_files FROM edges JOIN nodes ON nodes.id = edges.source WHERE edges.kind IN ('calls', 'references', 'imports') AND source <> target GROUP BY 1")
def blast_radius_split(spark, sf_dir):
    return graph.blast_radius(*P.graph(spark, sf_dir), is_test=lambda p: F.contains(p, F.lit("URGENT")))


@query("SELECT 'part:' || cast(p_partkey % 900 AS string) AS target, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3", with_graph=False)
def polymorphic_fanin(spark, sf_dir):
    parts = P.table(spark, sf_dir, "part")
    return graph.fan_in(parts.select(F.concat(F.lit("part:"), (C("p_partkey") % 900).cast("string")).alias("target"), F.lit("extends").alias("kind")))


# -- walks ----------------------------------------------------------------------------------------------------------


def _walk_sql(rounds: int = 25) -> str:
    """All rounds as CTEs: each is materialised, since the next reads it three times."""
    ctes = [
        "pairs AS MATERIALIZED (SELECT source, target FROM edges WHERE kind <> 'contains' UNION ALL SELECT target, source FROM edges WHERE kind <> 'contains')",
        "deg AS MATERIALIZED (SELECT source, count(*) AS k FROM pairs GROUP BY 1)",
        "share AS MATERIALIZED (SELECT b.source, b.target, count(*) / any_value(d.k)::DOUBLE AS w FROM pairs b JOIN deg d USING (source) GROUP BY 1, 2)",
        f"base AS MATERIALIZED (SELECT id, CASE WHEN id = '{HUB}' THEN 1.0 ELSE 0.0 END::DOUBLE AS r, id NOT IN (SELECT source FROM deg) AS lone FROM nodes)",
        "m0 AS MATERIALIZED (SELECT id, r AS m FROM base)",
    ]
    for i in range(1, rounds + 1):
        ctes.append(f"m{i} AS MATERIALIZED (SELECT b.id, 0.25 * b.r + 0.75 * (coalesce(g.got, 0) + CASE WHEN b.lone THEN p.m ELSE 0 END) AS m FROM base b JOIN m{i - 1} p ON p.id = b.id LEFT JOIN (SELECT s.target, sum(q.m * s.w) AS got FROM share s JOIN m{i - 1} q ON q.id = s.source GROUP BY 1) g ON g.target = b.id)")
    return ", " + ", ".join(ctes)


def _walk(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return nodes, graph.pagerank(nodes, edges.filter("kind != 'contains'"), nodes.filter(C("id") == HUB))


@query(_walk_sql() + " SELECT id, round(m, 6) AS mass FROM m25")
def pagerank_rwr(spark, sf_dir):
    return _walk(spark, sf_dir)[1].select("id", F.round("mass", 6).alias("mass"))


@query(_walk_sql() + " SELECT file_path, round(sum(m), 6) AS score FROM m25 JOIN nodes USING (id) GROUP BY 1")
def file_graph_score(spark, sf_dir):
    nodes, mass = _walk(spark, sf_dir)
    return nodes.join(mass, "id").groupBy("file_path").agg(F.round(F.sum("mass"), 6).alias("score"))


@query(
    f""", step AS (SELECT target AS a, source AS b, CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END AS rank FROM edges WHERE kind IN ('calls', 'contains', 'imports') AND source IN (SELECT id FROM nodes WHERE kind IN ('function', 'interface', 'module'))
UNION ALL SELECT source, target, CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END FROM edges WHERE kind IN ('calls', 'contains', 'imports') AND target IN (SELECT id FROM nodes WHERE kind IN ('function', 'interface', 'module'))),
l1 AS (SELECT b AS id, min(rank) AS rank FROM step WHERE a = '{HUB}' AND b <> '{HUB}' GROUP BY 1), l2 AS (SELECT b AS id, min(rank) AS rank FROM step WHERE a IN (SELECT id FROM l1) AND b <> '{HUB}' AND b NOT IN (SELECT id FROM l1) GROUP BY 1),
u AS (SELECT '{HUB}' AS id, 0 AS depth, 0 AS rank UNION ALL SELECT id, 1, rank FROM l1 UNION ALL SELECT id, 2, rank FROM l2)
SELECT id, depth, row_number() OVER (ORDER BY depth, rank, id)::INTEGER AS ord FROM u ORDER BY depth, rank, id LIMIT 70"""
)
def traverse_filtered(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.traverse(nodes, edges, nodes.filter(C("id") == HUB), 2, "both", ("calls", "contains", "imports"), ("function", "interface", "module"), 70)


_CALLS = "calls AS (SELECT DISTINCT cast(l_orderkey % 40 AS string) AS a, cast(l_partkey % 40 AS string) AS b FROM lineitem WHERE l_orderkey % 11 = 0 AND l_orderkey % 40 <> l_partkey % 40)"
_NAMED = "'1', '5', '9', '14', '22', '30', '37'"


@query(
    f"""WITH RECURSIVE {_CALLS}, start AS (SELECT DISTINCT unnest([{_NAMED}]) AS seed),
l0 AS (SELECT seed, seed AS id, 0 AS streak, [seed] AS path FROM start), """
    + ", ".join(
        f"""l{i} AS MATERIALIZED (SELECT seed, b AS id, streak, list_append(path, b) AS path FROM (SELECT p.seed, c.b, p.path, CASE WHEN c.b IN ({_NAMED}) THEN 0 ELSE p.streak + 1 END AS streak, row_number() OVER (PARTITION BY p.seed, c.b ORDER BY p.path, p.streak) AS k FROM l{i - 1} p JOIN calls c ON c.a = p.id
WHERE CASE WHEN c.b IN ({_NAMED}) THEN 0 ELSE p.streak + 1 END <= 1 AND {" AND ".join(f"NOT EXISTS (SELECT 1 FROM l{j} o WHERE o.seed = p.seed AND o.id = c.b)" for j in range(i))}) WHERE k = 1)"""
        for i in range(1, 7)
    )
    + f""", u AS ({" UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(7))}), best AS (SELECT path FROM u WHERE id IN ({_NAMED}) AND len(path) >= 3 ORDER BY len(path) DESC, path LIMIT 1)
SELECT (unnest(range(1, len(path) + 1)) - 1)::INTEGER AS ord, unnest(path) AS id FROM best""",
    with_graph=False,
)
def flow_path(spark, sf_dir):
    lines = P.table(spark, sf_dir, "lineitem").filter("l_orderkey % 11 = 0 and l_orderkey % 40 != l_partkey % 40")
    edges = lines.select((C("l_orderkey") % 40).cast("string").alias("source"), (C("l_partkey") % 40).cast("string").alias("target"), F.lit("calls").alias("kind"))
    return graph.flow_path(edges, spark.createDataFrame([(x.strip("' "),) for x in _NAMED.split(",")], "id string"))


# -- answers --------------------------------------------------------------------------------------------------------

_SET = "(SELECT id FROM nodes WHERE file_path LIKE 'catalog/%' OR id IN (SELECT 'order:' || cast(o_orderkey AS string) FROM orders WHERE o_orderkey % 7 = 0))"


def _chosen(nodes):
    return nodes.filter(C("file_path").startswith("catalog/") | (C("id").startswith("order:") & (F.substring_index("id", ":", -1).cast("long") % 7 == 0)))


@query(f" SELECT * FROM edges WHERE kind IN ('calls', 'extends', 'implements', 'references', 'overrides') AND source IN {_SET} AND target IN {_SET} AND NOT (kind = 'calls' AND line = 1)")
def recovered_edges(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return context.recovered_edges(edges, _chosen(nodes), edges.filter("kind = 'calls' and line = 1"))


@query(" SELECT source, target, kind, min(line) AS line FROM (SELECT * FROM edges WHERE kind = 'calls' UNION ALL SELECT source, target, kind, line + 1 FROM edges WHERE kind IN ('calls', 'extends')) GROUP BY ALL")
def merged_subgraphs(spark, sf_dir):
    edges = P.graph(spark, sf_dir)[1]
    return context.merged_edges(edges.filter("kind = 'calls'"), edges.filter("kind in ('calls', 'extends')").withColumn("line", C("line") + 1))


_MARKED = "marked AS (SELECT *, CASE WHEN line % 5 = 0 THEN 'heuristic' END AS provenance, CASE line % 15 WHEN 0 THEN 'event' WHEN 5 THEN 'plugin' END AS by_ FROM edges)"


@query(f", {_MARKED}, t AS (SELECT source, target, kind, line, row_number() OVER (PARTITION BY source, target ORDER BY line, kind) AS k FROM marked WHERE provenance = 'heuristic' AND ({HUB!r} IN (source, target) OR 'part:9' IN (source, target) OR 'supplier:10' IN (source, target))) SELECT source, target, kind, line FROM t WHERE k = 1 ORDER BY source, target LIMIT 6")
def dynamic_links(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    marked = edges.withColumn("provenance", F.when(C("line") % 5 == 0, "heuristic"))
    return context.dynamic_links(marked, nodes.filter(C("id").isin(HUB, "part:9", "supplier:10")))


@query(f", {_MARKED} SELECT source, target, kind, CASE WHEN by_ = 'event' THEN 'by an event' WHEN by_ IS NOT NULL THEN by_ WHEN provenance = 'heuristic' AND kind = 'calls' THEN 'through an interface' WHEN provenance = 'heuristic' THEN 'by its members' END AS how FROM marked")
def edge_annotations(spark, sf_dir):
    edges = P.graph(spark, sf_dir)[1]
    by = F.when(C("line") % 15 == 0, "event").when(C("line") % 15 == 5, "plugin")
    meta = F.when(by.isNotNull(), F.create_map(F.lit("synthesizedBy"), by))
    return edges.select("source", "target", "kind", context.annotation(meta, F.when(C("line") % 5 == 0, F.lit("heuristic")), C("kind")).alias("how"))


_NEIGHBOURS = "SELECT {far} AS id, min(line) AS line FROM edges WHERE kind IN ('calls', 'references', 'imports') AND source <> target AND {near} = 'part:7' GROUP BY 1"


@query(f" SELECT id, min(line) AS line FROM ({_NEIGHBOURS.format(far='source', near='target')} UNION ALL {_NEIGHBOURS.format(far='target', near='source')}) JOIN nodes USING (id) WHERE id <> 'part:7' AND (file_path LIKE 'sales/1%' OR file_path LIKE 'geo/A%') GROUP BY id ORDER BY line, id LIMIT 60")
def graph_glue(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    files = nodes.filter(C("file_path").startswith("sales/1") | C("file_path").startswith("geo/A")).select("file_path").distinct()
    return context.glue(nodes, edges, nodes.filter(C("id") == HUB), files)


def _side_sql(side: str, far: str, near: str) -> str:
    return f"(SELECT '{side}' AS side, n.id, n.name, x.line FROM ({_NEIGHBOURS.format(far=far, near=near)}) x JOIN nodes n USING (id) ORDER BY x.line, n.id LIMIT 12)"


@query(f" SELECT * FROM {_side_sql('caller', 'source', 'target')} UNION ALL SELECT * FROM {_side_sql('callee', 'target', 'source')}")
def node_trail(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return context.trail(nodes, edges, nodes.filter(C("id") == HUB))


@query(" SELECT e.source, n.id, n.name, n.kind, n.start_line, row_number() OVER (PARTITION BY e.source ORDER BY n.start_line, n.id)::INTEGER AS place FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'contains' AND source IN ('nation:3', 'nation:4', 'region:1')) e JOIN nodes n ON n.id = e.target")
def container_outline(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return context.outline(nodes, edges, nodes.filter(C("id").isin("nation:3", "nation:4", "region:1")))


@query(
    f"""{SYMBOLS_CTE}, p AS (SELECT id, file_path, seq % 50 AS priority, NOT regexp_matches(lower(file_path), '{paths.TEST_LOWER}') AS plain FROM symbols),
a AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY priority DESC, id) AS of_file FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY priority DESC, id) AS of_rest FROM a WHERE of_file <= 20)
SELECT id, file_path, priority FROM b WHERE plain OR of_rest <= 15 ORDER BY priority DESC, id LIMIT 100""",
    with_graph=False,
)
def context_caps(spark, sf_dir):
    hits = P.symbols(spark, sf_dir).select("id", "file_path", (C("seq") % 50).alias("priority"))
    return context.capped(hits, ~F.lower("file_path").rlike(paths.TEST_LOWER), 100)


@query(
    """, e AS (SELECT id FROM nodes WHERE id IN ('part:7', 'part:9')), near AS (SELECT DISTINCT target AS id FROM edges WHERE kind IN ('calls', 'references', 'imports') AND source IN (SELECT id FROM e) UNION SELECT source FROM edges WHERE kind IN ('calls', 'references', 'imports') AND target IN (SELECT id FROM e))
SELECT file_path, sum(CASE WHEN id IN (SELECT id FROM e) THEN 50 WHEN name = 'blue anvil' THEN 10 WHEN id IN (SELECT id FROM near) THEN 3 ELSE 1 END)::BIGINT AS score,
max(contains(lower(name), 'anvil') OR contains(lower(file_path), 'anvil'))::INTEGER + max(contains(lower(name), 'brand#1') OR contains(lower(file_path), 'brand#1'))::INTEGER AS n_terms, count(*) AS n_nodes FROM nodes GROUP BY 1"""
)
def file_scores(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return context.file_scores(nodes, edges, nodes.filter(C("id").isin("part:7", "part:9")), nodes.filter(C("name") == PART), ["anvil", "brand#1"])


@query(
    """, k AS (SELECT id, CASE WHEN id LIKE 'part:%' THEN 'import' ELSE kind END AS kind FROM nodes), h AS (SELECT id FROM k WHERE id IN ('part:3', 'part:5', 'order:1', 'nation:2'))
SELECT id FROM h WHERE id NOT LIKE 'part:%' UNION SELECT target FROM edges WHERE kind = 'imports' AND source IN (SELECT id FROM h)"""
)
def import_definitions(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    marked = nodes.withColumn("kind", F.when(C("id").startswith("part:"), "import").otherwise(C("kind")))
    return context.import_definitions(marked, edges, nodes.filter(C("id").isin("part:3", "part:5", "order:1", "nation:2")))


@query(
    """, own AS (SELECT id, start_line % 7 AS covered, start_line % 3 AS uncovered FROM nodes), up AS (SELECT source AS id, target AS member FROM edges WHERE kind = 'contains' UNION SELECT up.id, e.target FROM up JOIN edges e ON e.source = up.member AND e.kind = 'contains'),
p AS (SELECT id, id AS member FROM own UNION SELECT id, member FROM up) SELECT p.id, sum(o.covered)::BIGINT AS covered, sum(o.uncovered)::BIGINT AS uncovered FROM p JOIN own o ON o.id = p.member GROUP BY 1"""
)
def coverage_rollup(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    own = nodes.select("id", (C("start_line") % 7).alias("covered"), (C("start_line") % 3).alias("uncovered"))
    return graph.rollup(edges, own, ["covered", "uncovered"])
