"""The graph as tables in a folder: every change writes a new version of a table and then points to it.

A reader holds the version that it opened; a writer that is lost leaves only an unnamed version behind."""

from __future__ import annotations

import json
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import induced_edges
from loomgraph.sources import extract as X

TABLES = {
    "nodes": X.NODE + ", scope_key string", "edges": X.EDGE + ", scope_key string", "refs": X.REF + ", file_path string, language string, scope_key string",
    "files": "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, errors array<string>, scope_key string",
    "coverage": "file_path string, content_hash string, mode string, ranges array<struct<start:int,end:int,kind:string>>, lines_covered int, lines_uncovered int, pct_covered double, run_at long",
    "node_coverage": "node_id string, content_hash string, lines_covered int, lines_uncovered int, pct_covered double, run_at long", "metadata": "key string, value string",
}


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs, self.base = fs.FileSystem.from_uri(self.folder)

    def _current(self, name: str) -> str | None:
        at = f"{self.base}/{name}/_current"
        if self.fs.get_file_info(at).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(at) as f:
            return f.read().decode()

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/{version}")

    def write(self, name: str, rows: DataFrame) -> None:
        """A whole new version; the one before the last is removed."""
        version, old = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", self._current(name)
        columns = self.spark.createDataFrame([], TABLES[name]).schema
        cast = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns]
        rows.select(*cast).write.parquet(f"{self.folder}/{name}/{version}")
        with self.fs.open_output_stream(f"{self.base}/{name}/_current.tmp") as f:
            f.write(version.encode())
        self.fs.move(f"{self.base}/{name}/_current.tmp", f"{self.base}/{name}/_current")
        for info in self.fs.get_file_info(fs.FileSelector(f"{self.base}/{name}")):
            if info.type == fs.FileType.Directory and info.base_name not in (version, old):
                self.fs.delete_dir(info.path)

    def upsert(self, name: str, rows: DataFrame, key: list[str]) -> None:
        """Rows win over those with the same key."""
        self.write(name, self.read(name).join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def put_nodes(self, rows: DataFrame) -> None:
        """Nodes by id; those without id, kind, name, path or language are skipped."""
        valid = " and ".join(f"coalesce({c}, '') != ''" for c in ("id", "kind", "name", "file_path", "language"))
        named = rows.filter(valid).dropDuplicates(["id"])
        if "qualified_name" in named.columns:
            named = named.withColumn("qualified_name", F.coalesce(F.nullif("qualified_name", F.lit("")), "name"))
        self.upsert("nodes", named, ["id"])

    def add_edges(self, rows: DataFrame) -> None:
        """Edges whose ends are there; others are dropped."""
        own = self.read("nodes")
        self.write("edges", self.read("edges").unionByName(induced_edges(rows, own), allowMissingColumns=True))

    def add_refs(self, rows: DataFrame) -> None:
        self.write("refs", self.read("refs").unionByName(rows.withColumn("language", F.coalesce("language", F.lit("unknown"))), allowMissingColumns=True))

    def delete_files(self, paths: DataFrame) -> None:
        """Files (path) with their nodes and references, the edges that lose an end, and coverage of nodes that are gone."""
        own = paths.select(F.col("path").alias("file_path"))
        self.write("nodes", self.read("nodes").join(own, "file_path", "left_anti"))
        self.write("edges", induced_edges(self.read("edges"), self.read("nodes")))
        self.write("refs", self.read("refs").join(own, "file_path", "left_anti"))
        self.write("files", self.read("files").join(paths.select("path"), "path", "left_anti"))
        self.write("node_coverage", self.read("node_coverage").join(self.read("nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi"))

    def replace_files(self, bundles: DataFrame, listing: DataFrame) -> None:
        """New contents of files: ``bundles`` of the extractor and their ``listing`` (path, content_hash, language, size, modified_at).  Files whose hash is the one that is
        stored are left alone."""
        same = self.read("files").select("path", "content_hash")
        changed = listing.join(same, ["path", "content_hash"], "left_anti").withColumn("scope_key", F.col("language"))
        fresh = bundles.join(changed.select("path"), "path", "left_semi")
        nodes, edges, refs, files = X.tables(fresh)
        self.delete_files(changed)
        self.put_nodes(nodes.withColumn("scope_key", F.col("language")))
        self.add_edges(edges)
        self.add_refs(refs.withColumn("scope_key", F.col("language")))
        stored = changed.join(files.select("path", "node_count", "errors"), "path", "left").withColumn("indexed_at", F.unix_millis(F.current_timestamp()))
        self.upsert("files", stored, ["path"])

    def put_coverage(self, rows: DataFrame) -> None:
        self.upsert("coverage", rows, ["file_path"])

    def put_node_coverage(self, rows: DataFrame) -> None:
        """Coverage of nodes that are there."""
        self.upsert("node_coverage", rows.join(self.read("nodes").select(F.col("id").alias("node_id")), "node_id", "left_semi"), ["node_id"])

    def set_metadata(self, **values: str) -> None:
        self.upsert("metadata", self.spark.createDataFrame(sorted(values.items()), "key string, value string"), ["key"])

    def get_metadata(self, key: str) -> str | None:
        row = self.read("metadata").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def clear(self) -> None:
        for name in TABLES:
            self.write(name, self.spark.createDataFrame([], TABLES[name]))

    def status(self) -> dict:
        from loomgraph.operators.graph import stats

        out: dict = {"nodes": {}, "edges": {}, "files": {}}
        for r in stats(self.read("nodes"), self.read("edges")).collect():
            out[r["what"]][r["value"]] = r["n"]
        files = self.read("files").agg(F.count("*").alias("n"), F.max("indexed_at").alias("last")).first()
        return out | {"fileCount": files["n"], "lastIndexed": files["last"]}

    def lock(self, owner: str, stale_s: float = 120) -> bool:
        """An advisory lock for writers: false if another holds it that isn't stale."""
        at = f"{self.base}/_lock"
        if self.fs.get_file_info(at).type == fs.FileType.File:
            with self.fs.open_input_stream(at) as f:
                held = json.loads(f.read())
            if held["owner"] != owner and time.time() - held["at"] < stale_s:
                return False
        self.fs.create_dir(self.base)
        with self.fs.open_output_stream(at) as f:
            f.write(json.dumps({"owner": owner, "at": time.time()}).encode())
        return True

    def unlock(self) -> None:
        if self.fs.get_file_info(f"{self.base}/_lock").type == fs.FileType.File:
            self.fs.delete_file(f"{self.base}/_lock")
