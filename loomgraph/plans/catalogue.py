"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import coverage, graph, resolve, search, sync
from loomgraph.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from loomgraph.sources import projection as P

FLAGSHIP = "impact_depth2"
PART, HUB, WORDS = "blue anvil", "part:7", ["the", "ing"]


def _seeds(nodes: DataFrame, name: str = PART) -> DataFrame:
    return nodes.filter(F.col("name") == name).select("id")


@query(
    """SELECT * FROM (SELECT 'nodes' AS what, 'all' AS value, count(*) AS n FROM nodes UNION ALL SELECT 'edges', 'all', count(*) FROM edges
UNION ALL SELECT 'nodes', kind, count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind
UNION ALL SELECT 'files', language, count(*) FROM (SELECT DISTINCT file_path, language FROM nodes) GROUP BY language)"""
)
def graph_stats(spark, sf_dir):
    return graph.stats(*P.graph(spark, sf_dir))


@query("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def nodes_by_kind(spark, sf_dir):
    return P.graph(spark, sf_dir)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(spark, sf_dir):
    return P.graph(spark, sf_dir)[1].groupBy("kind").agg(F.count("*").alias("n"))


def _neighbour_sql(near: str, far: str) -> str:
    return f""", hits AS (SELECT e.{far} AS id, e.line, e.kind AS edge_kind FROM edges e JOIN nodes s ON s.id = e.{near} AND s.name = '{PART}'
WHERE e.kind IN ('calls', 'references', 'imports') AND source <> target),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line, edge_kind) AS r FROM hits)
SELECT n.id, n.name, n.kind, n.file_path, n.start_line, b.line, b.edge_kind FROM best b JOIN nodes n ON n.id = b.id WHERE r = 1"""


@query(_neighbour_sql("target", "source"))
def callers(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.neighbours(nodes, edges, _seeds(nodes), True)


@query(_neighbour_sql("source", "target"))
def callees(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.neighbours(nodes, edges, _seeds(nodes), False)


@query("SELECT e.source, e.target, n.name, n.start_line FROM edges e JOIN nodes n ON n.id = e.target WHERE e.kind = 'contains' AND e.source IN (SELECT id FROM nodes WHERE kind = 'module')")
def children(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.children(nodes, edges, nodes.filter("kind = 'module'"))


@query("SELECT * FROM edges WHERE source IN (SELECT id FROM nodes WHERE language = 'geo') AND target IN (SELECT id FROM nodes WHERE language = 'geo')")
def induced_edges(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.induced_edges(edges, nodes.filter("language = 'geo'"))


_FILE_EDGES = """SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target
WHERE e.kind NOT IN ('contains', 'imports') AND a.file_path <> b.file_path"""


@query(_FILE_EDGES)
def file_deps(spark, sf_dir):
    return graph.file_edges(*P.graph(spark, sf_dir))


@query(f"SELECT to_file AS file, count(*) AS n_dependents FROM ({_FILE_EDGES}) GROUP BY to_file")
def file_dependents(spark, sf_dir):
    return graph.file_edges(*P.graph(spark, sf_dir)).groupBy(F.col("to_file").alias("file")).agg(F.count("*").alias("n_dependents"))


@query(
    """, f AS (SELECT a.file_path AS file, count(*) AS n_edges FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target
WHERE a.file_path = b.file_path GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT file, n_edges, lead(n_edges) OVER (ORDER BY n_edges DESC, file) AS runner_up FROM f"""
)
def dominant_file(spark, sf_dir):
    return graph.dominant_file(*P.graph(spark, sf_dir))


@query("SELECT * FROM edges WHERE source IN (SELECT id FROM nodes WHERE kind <> 'struct') AND target IN (SELECT id FROM nodes WHERE kind <> 'struct')")
def endpoint_filter(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.induced_edges(edges, nodes.filter("kind != 'struct'"))


@query(
    f""", links AS (SELECT source, target FROM edges WHERE kind = 'extends'),
up AS (SELECT '{HUB}' AS id, 0 AS depth UNION SELECT l.target, up.depth + 1 FROM up JOIN links l ON l.source = up.id WHERE up.depth < 400),
down AS (SELECT '{HUB}' AS id, 0 AS depth UNION SELECT l.source, down.depth + 1 FROM down JOIN links l ON l.target = down.id WHERE down.depth < 400)
SELECT id, 'ancestor' AS side, min(depth) AS depth FROM up GROUP BY id HAVING min(depth) > 0
UNION ALL SELECT id, 'descendant', min(depth) FROM down GROUP BY id HAVING min(depth) > 0"""
)
def type_hierarchy(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.hierarchy(edges, nodes.filter(F.col("id") == HUB))


@query(
    f""", step AS (SELECT source AS a, target AS b FROM edges WHERE kind = 'imports' UNION SELECT target, source FROM edges WHERE kind = 'imports'),
r AS (SELECT '{HUB}' AS id, 0 AS depth UNION SELECT step.b, r.depth + 1 FROM r JOIN step ON step.a = r.id WHERE r.depth < 2)
SELECT id, min(depth) AS depth FROM r GROUP BY id ORDER BY depth, id LIMIT 1000"""
)
def bfs_both_limit(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    return graph.reach(edges.filter("kind = 'imports'"), nodes.filter(F.col("id") == HUB), 2, both=True).orderBy("depth", "id").limit(1000)


@query(
    """SELECT target AS id, count(DISTINCT source) AS n_callers, count(DISTINCT file_path) AS n_files FROM edges JOIN nodes ON nodes.id = edges.source
WHERE edges.kind IN ('calls', 'references', 'imports') AND source <> target GROUP BY 1"""
)
def blast_radius(spark, sf_dir):
    return graph.blast_radius(*P.graph(spark, sf_dir))


def _bm25_sql(terms: list[str]) -> str:
    counts = ", ".join(
        f"len(list_filter(a, lambda x: starts_with(x, '{t}'))) * 1.0 + len(list_filter(b, lambda x: starts_with(x, '{t}'))) * 5.0 AS f{i}, "
        f"len(list_filter(a, lambda x: starts_with(x, '{t}'))) + len(list_filter(b, lambda x: starts_with(x, '{t}'))) > 0 AS s{i}"
        for i, t in enumerate(terms)
    )
    seen = " OR ".join(f"s{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN d{i} * 2 >= n THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(terms)))
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(source), '[a-z0-9]+') AS b FROM documents),
r AS (SELECT doc_id, len(a) + len(b) AS size, {counts} FROM w),
c AS (SELECT count(*) AS n, avg(size) AS mean, {", ".join(f"count(*) FILTER (WHERE s{i}) AS d{i}" for i in range(len(terms)))} FROM r)
SELECT doc_id, round({score}, 6) AS score FROM r, c WHERE {seen}"""


@query(_bm25_sql(["ableth", "idiot", "tionho"]), with_graph=False)
def search_bm25(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return search.bm25(docs, "doc_id", {"text": 1.0, "source": 5.0}, ["ableth", "idiot", "tionho"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'anvil') AND NOT starts_with(lower(name), 'anvil') ORDER BY length(name), name, id LIMIT 50")
def name_substring(spark, sf_dir):
    low = F.lower("name")
    return P.graph(spark, sf_dir)[0].filter(F.contains(low, F.lit("anvil")) & ~low.startswith("anvil")).select("id", "name").orderBy(F.length("name"), "name", "id").limit(50)


_REFS = "refs AS (SELECT 'order:' || cast(l_orderkey AS string) || ':' || cast(l_linenumber AS string) AS ref_id, p_name AS name, 'catalog/' || p_brand || '.src' AS file_path FROM lineitem JOIN part ON p_partkey = l_partkey)"
_BEST = f""", {_REFS}, named AS (SELECT DISTINCT name, file_path FROM refs),
c AS (SELECT r.name, r.file_path, n.id AS target, n.file_path AS tf, n.start_line,
 CASE WHEN n.file_path = r.file_path THEN 100 WHEN regexp_replace(n.file_path, '/[^/]*$', '') = regexp_replace(r.file_path, '/[^/]*$', '') THEN 50 ELSE 0 END AS proximity
 FROM named r JOIN nodes n ON n.name = r.name),
b AS (SELECT *, row_number() OVER (PARTITION BY name, file_path ORDER BY proximity DESC, tf, start_line, target) AS r, count(*) OVER (PARTITION BY name, file_path) AS n_candidates FROM c)"""


def _refs(spark, sf_dir):
    lines, parts = (P.table(spark, sf_dir, t) for t in ("lineitem", "part"))
    ref_id = F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(ref_id.alias("ref_id"), F.col("p_name").alias("name"), F.concat(F.lit("catalog/"), "p_brand", F.lit(".src")).alias("file_path"))


@query(_BEST + " SELECT ref_id, target, proximity, n_candidates FROM refs JOIN b USING (name, file_path) WHERE r = 1")
def resolve_generic(spark, sf_dir):
    # references that agree in name and file have the same answer: rank each such pair once
    refs = _refs(spark, sf_dir)
    pairs = refs.select("name", "file_path").distinct().withColumn("ref_id", F.struct("name", "file_path"))
    best = resolve.generic(pairs, P.graph(spark, sf_dir)[0])
    best = best.select("ref_id.name", "ref_id.file_path", "target", "proximity", "n_candidates")
    return refs.join(best, ["name", "file_path"]).select("ref_id", "target", "proximity", "n_candidates")


@query(", refs AS (SELECT 'c:' || cast(o_orderkey AS string) AS ref_id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey), u AS (SELECT name, min(id) AS target FROM nodes GROUP BY name HAVING count(*) = 1) SELECT ref_id, target FROM refs JOIN u USING (name)")
def resolve_unique_only(spark, sf_dir):
    orders, customers = (P.table(spark, sf_dir, t) for t in ("orders", "customer"))
    refs = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("c:"), F.col("o_orderkey").cast("string")).alias("ref_id"), F.col("c_name").alias("name"), F.lit("sales/x.src").alias("file_path"))
    return resolve.unique_only(refs, P.graph(spark, sf_dir)[0])


_MEMBERS = "SELECT DISTINCT p_brand AS id, p_type AS member FROM part WHERE p_size < 12"


@query(
    f"""WITH m AS ({_MEMBERS}), s AS (SELECT id, count(*) AS size FROM m GROUP BY id)
SELECT a.id AS owner, b.id AS wanted FROM m a JOIN m b ON a.member = b.member AND a.id <> b.id JOIN s ON s.id = b.id GROUP BY a.id, b.id, s.size HAVING count(*) = s.size""",
    with_graph=False,
)
def implements_containment(spark, sf_dir):
    members = P.table(spark, sf_dir, "part").filter("p_size < 12").select(F.col("p_brand").alias("id"), F.col("p_type").alias("member"))
    return resolve.containment(members, members)


_LINES = "lines AS (SELECT CAST(floor(doc_id / 100) AS bigint) AS file, doc_id AS line, quality = 1 AS hit FROM labels)"


def _lines(spark, sf_dir):
    return P.table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 100).alias("file"), F.col("doc_id").alias("line"), (F.col("quality") == 1).alias("hit"))


@query(f"WITH {_LINES} SELECT file, count(*) FILTER (WHERE hit) AS covered, count(*) FILTER (WHERE NOT hit) AS uncovered, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6)::DOUBLE AS pct FROM lines GROUP BY file", with_graph=False)
def coverage_lines(spark, sf_dir):
    return coverage.totals(_lines(spark, sf_dir))


@query(
    f"""WITH {_LINES}, f AS (SELECT *, CASE WHEN line = lag(line) OVER w + 1 AND hit = lag(hit) OVER w THEN 0 ELSE 1 END AS new FROM lines WINDOW w AS (PARTITION BY file ORDER BY line)),
g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY line) AS run FROM f)
SELECT file, min(line) AS start, max(line) AS "end", bool_and(hit) AS hit FROM g GROUP BY file, run""",
    with_graph=False,
)
def coverage_rle(spark, sf_dir):
    return coverage.runs(_lines(spark, sf_dir))


@query(f"WITH {_LINES} SELECT file, line, hit FROM lines", with_graph=False)
def coverage_rle_roundtrip(spark, sf_dir):
    return coverage.lines_of(coverage.runs(_lines(spark, sf_dir)))


_SPANS = "spans AS (SELECT CAST(floor(s_suppkey / 100) AS bigint) AS file, s_suppkey AS id, s_suppkey AS start, s_suppkey + s_suppkey % 13 AS \"end\" FROM supplier)"


@query(
    f"""WITH {_LINES}, {_SPANS} SELECT file, line, id, hit FROM (SELECT l.file, l.line, s.id, l.hit, row_number() OVER (PARTITION BY l.file, l.line ORDER BY s."end" - s.start, s.id) AS r
FROM lines l JOIN spans s ON s.file = l.file AND l.line BETWEEN s.start AND s."end") WHERE r = 1""",
    with_graph=False,
)
def coverage_innermost(spark, sf_dir):
    key = F.col("s_suppkey")
    spans = P.table(spark, sf_dir, "supplier").select(F.floor(key / 100).alias("file"), key.alias("id"), key.alias("start"), (key + key % 13).alias("end"))
    return coverage.innermost(_lines(spark, sf_dir), spans)


_OLD = "SELECT cast(doc_id AS string) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0"
_NEW = "SELECT cast(doc_id AS string) AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0"


def _listings(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")
    old = docs.filter("doc_id % 13 != 0").select("path", F.sha2("text", 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old, docs.filter("doc_id % 11 != 0").select("path", F.sha2(changed, 256).alias("hash"))


@query(
    f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM (SELECT coalesce(o.path, n.path) AS path,
CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path) WHERE change IS NOT NULL""",
    with_graph=False,
)
def sync_diff(spark, sf_dir):
    return sync.diff(*_listings(spark, sf_dir))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.path, o.hash, n.hash IS DISTINCT FROM o.hash AS stale FROM o LEFT JOIN n ON o.path = n.path", with_graph=False)
def coverage_stale(spark, sf_dir):
    return coverage.stale(*_listings(spark, sf_dir))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT path, hash FROM n UNION ALL SELECT path, hash FROM o WHERE path NOT IN (SELECT path FROM n)", with_graph=False)
def keyed_replace(spark, sf_dir):
    return sync.replaced(*_listings(spark, sf_dir), "path")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS n_events, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY user_id, n""",
    with_graph=False,
)
def debounce_sessions(spark, sf_dir):
    return sync.quiet_sessions(P.table(spark, sf_dir, "events"), "user_id", "6 hours")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)", with_graph=False)
def pending_files(spark, sf_dir):
    events = P.table(spark, sf_dir, "events")
    half = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.col("a") + (F.col("b") - F.col("a")) / 2).alias("half"))
    seen = events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return seen.crossJoin(F.broadcast(half)).filter("last_seen > half").drop("half")


@query("SELECT language AS scope, count(*) AS n_nodes, count(DISTINCT file_path) AS n_files FROM nodes GROUP BY 1")
def manifest_counts(spark, sf_dir):
    return P.graph(spark, sf_dir)[0].groupBy(F.col("language").alias("scope")).agg(F.count("*").alias("n_nodes"), F.countDistinct("file_path").alias("n_files"))


@query(
    """, u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY language, id) AS r FROM nodes) SELECT id, name, language FROM u WHERE r = 1 ORDER BY name, id LIMIT 50 OFFSET 10"""
)
def scope_merge_topk(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("name").orderBy("language", "id"))
    return P.graph(spark, sf_dir)[0].withColumn("r", first).filter("r = 1").select("id", "name", "language").orderBy("name", "id").offset(10).limit(50)


@query("SELECT id, kind || ':' || substr(sha256(file_path || ':' || kind || ':' || name || ':' || cast(start_line AS string)), 1, 32) AS node_id FROM nodes")
def node_ids_sha(spark, sf_dir):
    c = F.col
    return P.graph(spark, sf_dir)[0].select("id", X.node_id(c("kind"), c("file_path"), c("name"), c("start_line")).alias("node_id"))


@query(
    """, k AS (SELECT file_path, start_line, end_line, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 THEN 0 ELSE 1 END AS new, id FROM nodes),
g AS (SELECT *, sum(new) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT file_path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS n FROM g GROUP BY file_path, run"""
)
def line_clusters(spark, sf_dir):
    w = Window.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = P.graph(spark, sf_dir)[0].withColumn("new", F.when(F.col("start_line") <= reach + 8, 0).otherwise(1))
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).groupBy("file_path", "run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n")).drop("run")


@query(", r AS (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY start_line DESC, id) AS rank FROM nodes) SELECT * FROM r WHERE rank <= 5")
def per_file_cap(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("start_line"), "id"))
    return P.graph(spark, sf_dir)[0].select("id", "file_path", rank.alias("rank")).filter("rank <= 5")


@query("SELECT id, name, kind, file_path, start_line FROM nodes WHERE id IN ('part:7', 'order:9', 'nation:3', 'absent:1')")
def batch_lookup(spark, sf_dir):
    nodes, _ = P.graph(spark, sf_dir)
    return nodes.filter(F.col("id").isin("part:7", "order:9", "nation:3", "absent:1")).select("id", "name", "kind", "file_path", "start_line")


@query("SELECT * FROM nodes WHERE kind IN ('class', 'struct') AND language IN ('geo') AND (contains(lower(file_path), 'asia') OR contains(lower(file_path), 'europe'))")
def hard_filters(spark, sf_dir):
    low = F.lower("file_path")
    return P.graph(spark, sf_dir)[0].filter(F.col("kind").isin("class", "struct") & F.col("language").isin("geo") & (F.contains(low, F.lit("asia")) | F.contains(low, F.lit("europe"))))


@query("SELECT * FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE file_path = 'catalog/Brand#11.src') AND target NOT IN (SELECT id FROM nodes WHERE file_path = 'catalog/Brand#11.src')")
def cascade_delete(spark, sf_dir):
    nodes, edges = P.graph(spark, sf_dir)
    gone = nodes.filter("file_path = 'catalog/Brand#11.src'")
    return edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").join(gone.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target", "kind", "line")


from loomgraph.plans import graph_queries, resolve_queries, search_queries, source_queries  # noqa: E402, F401  (they register more)
