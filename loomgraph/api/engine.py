"""The library: index a tree, keep it in sync, ask it questions.  Results are DataFrames; ``render`` makes text of small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators import context, coverage, graph, search, sync
from loomgraph.sources import files, recordset
from loomgraph.sources.store import TABLES, GraphStore

VERSION = "2"


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, GraphStore(spark, folder)

    # building
    def index(self, root: str) -> dict:
        return sync.sync_store(self.store, files.scan(self.spark, root), VERSION)

    def sync_files(self, root: str, only: list[str]) -> dict:
        return sync.sync_store(self.store, files.scan(self.spark, root), VERSION, only)

    def changes(self, root: str) -> DataFrame:
        """path, change; nothing is written."""
        now = files.scan(self.spark, root).select("path", F.sha2("content", 256).alias("hash"))
        return sync.diff(self.store.read("files").select("path", F.col("content_hash").alias("hash")), now)

    # questions
    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    def query(self, raw: str, limit: int = 10, offset: int = 0) -> DataFrame:
        return search.search(self.nodes, raw, limit, offset).select("rank", "id", "kind", "name", "file_path", "start_line", "signature", "score").orderBy("rank")

    def callers(self, symbol: str, limit: int = 20) -> DataFrame:
        return graph.callers_of(self.nodes, self.edges, symbol, True, max(1, min(100, limit)))

    def callees(self, symbol: str, limit: int = 20) -> DataFrame:
        return graph.callers_of(self.nodes, self.edges, symbol, False, max(1, min(100, limit)))

    def impact(self, symbol: str, depth: int = 2) -> DataFrame:
        return graph.impact_of(self.nodes, self.edges, symbol, depth)

    def files(self, folder: str = "", glob: str = "") -> DataFrame:
        return self.store.read("files").filter(paths.in_folder(F.col("path"), folder, glob)).select("path", "language", "node_count", "size").orderBy("path")

    def affected(self, changed: list[str], depth: int = 5, glob: str | None = None) -> DataFrame:
        """Tests that depend on the changed files, over imports into files and over every other use of one file by another."""
        own = self.nodes.select("id", "file_path")
        imports = self.edges.filter("kind = 'imports'").join(own.select(F.col("id").alias("source"), F.col("file_path").alias("from_file")), "source").join(own.select(F.col("id").alias("target"), F.col("file_path").alias("to_file")), "target")
        uses = imports.select("from_file", "to_file").unionByName(graph.file_edges(self.nodes, self.edges))
        seeds = self.spark.createDataFrame([(c,) for c in changed], "file string")
        return graph.affected_tests(uses, seeds, lambda p: paths.is_affected_test(p, glob), depth).orderBy("distance", "file")

    def node(self, symbol: str, file: str = "", line: int = 0) -> DataFrame:
        """What matches a symbol: of a file if one is named, around a line, or nearest to it."""
        hits = graph.matched(self.nodes, symbol).filter("exact").select("id").join(self.nodes, "id")
        hits = hits.filter(F.contains("file_path", F.lit(file))) if file else hits
        if line:
            around = hits.filter((F.col("start_line") <= line) & (F.col("end_line") >= line))
            hits = hits.orderBy(F.abs(F.col("start_line") - line), "id").limit(1) if around.isEmpty() else around
        return hits.orderBy("file_path", "start_line")

    def source(self, root: str, symbol: str) -> DataFrame:
        """Nodes of a symbol with their lines; files outside of the root have none."""
        tree = files.read_tree(self.spark, root).select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("text"))
        hits = self.node(symbol).join(tree, "file_path")
        return hits.select("id", "file_path", "start_line", files.source_slice(F.col("text"), F.col("start_line"), F.col("end_line")).alias("source"))

    def explore(self, question: str, limit: int = 12) -> DataFrame:
        """Files for a question, best first, with their nodes that it names."""
        from loomgraph.functions.words import search_terms

        terms = search_terms(question, with_stems=True)
        nodes = self.nodes
        hits = [search.by_words(nodes, t, (), (), limit).select("id", F.lit(t).alias("term"), "score") for t in terms] or [nodes.limit(0).select("id", F.lit("").alias("term"), F.lit(0.0).alias("score"))]
        found = hits[0]
        for h in hits[1:]:
            found = found.unionByName(h)
        entries = graph.cut_lineage(search.merged_terms(found).orderBy(F.desc("score"), "id").limit(limit))
        scores = context.file_scores(nodes, self.edges, entries, entries, terms)
        mass = graph.pagerank(nodes, self.edges.filter(F.col("kind").isin(*graph.RANKED)), entries)
        by_file = nodes.join(mass, "id").groupBy("file_path").agg(F.sum("mass").alias("graph"))
        seeds = nodes.join(entries, "id", "left_semi").select("file_path", F.lit(1).alias("seed")).distinct()
        p = F.col("file_path")
        top = scores.join(by_file, "file_path").join(seeds, "file_path", "left").filter("score > n_nodes or seed = 1").withColumns({"seed": F.coalesce("seed", F.lit(0)), "low_value": paths.is_low_value(p, explore=True).cast("int"), "generated": paths.is_generated(p).cast("int")})
        rows = context.explore_order([r.asDict() for r in top.orderBy(F.desc("graph"), "file_path").limit(4 * limit).collect()])[:limit]
        return self.spark.createDataFrame([(i + 1, r["file_path"], float(r["graph"]), r["n_terms"], r["n_nodes"]) for i, r in enumerate(rows)], "rank int, file_path string, graph double, n_terms int, n_nodes long")

    def status(self) -> dict:
        return self.store.status()

    # coverage and snapshots
    def ingest_coverage(self, profile: str, module: str = "") -> dict:
        """Lines of a cover profile to files and nodes; says how many files it names that aren't there."""
        tracked = self.store.read("files")
        lines, unknown = coverage.ingest(coverage.block_lines(coverage.profile_blocks(self.spark.read.text(profile))), tracked, module)
        lines = graph.cut_lineage(lines)
        hashes = tracked.select(F.col("path").alias("file_path"), "content_hash")
        run = F.unix_millis(F.current_timestamp())
        names = {"covered": "lines_covered", "uncovered": "lines_uncovered", "pct": "pct_covered"}
        by_file = coverage.file_coverage(lines).withColumnRenamed("file", "file_path").withColumnsRenamed(names).join(hashes, "file_path")
        self.store.put_coverage(by_file.withColumns({"mode": F.lit("set"), "run_at": run}))
        spans = self.nodes.filter(F.col("kind").isin("function", "method")).select(F.col("file_path").alias("file"), "id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
        own = coverage.node_coverage(lines, spans).withColumnRenamed("id", "node_id").withColumnsRenamed(names)
        where = self.nodes.select(F.col("id").alias("node_id"), "file_path").join(hashes, "file_path").select("node_id", "content_hash")
        self.store.put_node_coverage(own.join(where, "node_id").withColumn("run_at", run))
        return {"files": by_file.count(), "skipped": unknown.count()}

    def export(self, folder: str, ref: str = "") -> dict:
        edges = self.edges.withColumn("id", F.concat_ws("|", "source", "target", "kind", F.coalesce(F.col("line"), F.lit(0)).cast("string")))
        tables = {"nodes": (self.nodes, "id"), "edges": (edges.dropDuplicates(["id"]).withColumn("scope_key", F.coalesce("scope_key", F.lit("all"))), "id"), "files": (self.store.read("files").drop("indexed_at"), "path")}
        return recordset.export_scoped(self.spark, tables, folder, ref)

    def load(self, folder: str) -> None:
        """A store from exported recordsets; nodes and files must be there."""
        for name in ("nodes", "files", "edges"):
            self.store.write(name, recordset.read_recordset(self.spark, f"{folder}/*/{name}.rec", TABLES[name], required=True))


def render(rows: list[dict], limit: int = 15_000) -> str:
    """Lines grouped by file, cut at a length."""
    out, last = [], None
    for r in rows:
        if r.get("file_path") and r["file_path"] != last:
            last = r["file_path"]
            out.append(f"## {last}")
        rest = " ".join(f"{k}={v}" for k, v in r.items() if v is not None and k not in ("id", "file_path", "name", "kind", "start_line"))
        out.append(f"- {r.get('kind', '')} **{r.get('name', r.get('path', ''))}**:{r.get('start_line', '')} {rest}".rstrip())
    text = "\n".join(out) or "Nothing was found."
    return text if len(text) <= limit else text[: text.rfind("\n", 0, limit)] + "\n… (cut)"


def file_tree(names: list[str]) -> str:
    """Paths as an indented tree."""
    root: dict = {}
    for n in names:
        at = root
        for part in n.split("/"):
            at = at.setdefault(part, {})
    walk = lambda node, deep: [line for k in sorted(node) for line in ("  " * deep + k + ("/" if node[k] else ""), *walk(node[k], deep + 1))]
    return "\n".join(walk(root, 0))
