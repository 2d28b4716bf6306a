"""Recordsets: a header of typed columns, one JSON value a line for each field, a footer with the count."""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "RECORDS"
_TYPES = {"int": "int", "bigint": "long", "double": "float", "boolean": "bool"}
_BACK = {"int": "int", "long": "bigint", "float": "double", "bool": "boolean"}


def write_recordset(df: DataFrame, path: str, name: str, key: str, compress: tuple[str, ...] = ()) -> int:
    """One file, sorted by key, so that equal rows give equal bytes; with copies compressed by gzip or zstd.  The executors render and sort, the driver only
    joins the parts; the file gets its name when it is whole.  Returns the count of records."""
    columns = [key, *(c for c in df.columns if c != key)]
    kinds = {c: t for c, t in df.dtypes}
    value = lambda c: F.expr(f"substring(to_json(array(`{c}`)), 2, length(to_json(array(`{c}`))) - 2)")
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    df.orderBy(key).select(F.concat_ws("\n", *map(value, columns)).alias("value")).write.text(parts)
    system, base = fs.FileSystem.from_uri(path)
    folder = fs.FileSystem.from_uri(parts)[1]
    system.create_dir(base.rpartition("/")[0])
    head = ", ".join(("$ID" if c == key else c) + (f":{_TYPES[kinds[c]]}" if kinds[c] in _TYPES else "") for c in columns)
    outs = {"": system.open_output_stream(f"{base}.tmp")} | {x: system.open_output_stream(f"{base}.{x}.tmp", compression={"gz": "gzip", "zst": "zstd"}[x]) for x in compress}
    n = 0

    def put(data: bytes) -> None:
        for out in outs.values():
            out.write(data)

    put(f"# {FORMAT} | {name}: {head}\n".encode())
    for part in sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if re.search(r"/part-[^/]*$", f.path)):
        with system.open_input_stream(part, compression=None) as source:
            while block := source.read(1 << 20):
                put(block)
                n += block.count(b"\n")
    put(f"# {n // len(columns)} records\n".encode())
    for x, out in outs.items():
        out.close()
        system.move(f"{base}{'.' if x else ''}{x}.tmp", f"{base}{'.' if x else ''}{x}")
    system.delete_dir(folder)
    return n // len(columns)


def parse_recordset(text: str) -> tuple[list[tuple[str, str]], list[list]]:
    """Columns with their types, and rows; the count in the footer must be right."""
    lines = text.rstrip("\n").split("\n")
    m = re.match(r"# [^|]*\| *([^:]+): *(.*)$", lines[0])
    f = re.match(r"# (\d+) records?$", lines[-1])
    if not m or not f:
        raise ValueError("not a recordset")
    columns = [tuple(c.strip().partition(":")[::2]) for c in m[2].split(",")]
    values = [json.loads(x) for x in lines[1:-1]]
    if len(values) != int(f[1]) * len(columns):
        raise ValueError(f"{f[1]} records expected")
    return columns, [values[i : i + len(columns)] for i in range(0, len(values), len(columns))]


def read_recordset(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """Rows of recordsets, a file or many by pattern, one task a file; columns that a file lacks are null.  No file gives no rows, or an error if required."""
    system, base = fs.FileSystem.from_uri(path)
    if not re.search(r"[*?\[{]", path) and system.get_file_info(base).type == fs.FileType.NotFound:
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([], schema).schema
    names = wanted.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else pa.input_stream(pa.BufferReader(raw), compression="zstd").read() if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
                columns, rows = parse_recordset(data.decode())
                at = {("id" if c == "$ID" else c): i for i, (c, _) in enumerate(columns)}
                out = [json.dumps({n: r[at[n]] for n in names if n in at}) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["j"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "j string")
    return rows.select(F.from_json("j", wanted).alias("r")).select("r.*")


def export_scoped(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], folder: str, ref: str = "") -> dict:
    """For each scope a folder with its recordsets, plain and compressed, and a manifest of counts and sizes.  ``tables``: name to (rows with
    ``scope_key``, key); scopes are few."""
    scopes = sorted({r[0] for df, _ in tables.values() for r in df.select("scope_key").distinct().collect()})
    manifest: dict = {"ref": ref, "scopes": []}
    system, base = fs.FileSystem.from_uri(folder)
    for scope in scopes:
        entry: dict = {"scope": scope, "counts": {}, "bytes": {}}
        for name, (df, key) in sorted(tables.items()):
            path = f"{folder}/{scope}/{name}.rec"
            entry["counts"][name] = write_recordset(df.filter(F.col("scope_key") == scope).drop("scope_key"), path, name, key, ("gz", "zst"))
            entry["bytes"][name] = {x or "plain": system.get_file_info(f"{base}/{scope}/{name}.rec{x}").size for x in ("", ".gz", ".zst")}
        manifest["scopes"].append(entry)
    with system.open_output_stream(f"{base}/manifest.json.tmp") as out:
        out.write(json.dumps(manifest, indent=1, sort_keys=True).encode())
    system.move(f"{base}/manifest.json.tmp", f"{base}/manifest.json")
    return manifest
