"""Listing and reading source trees: ignore rules as column expressions, languages, the size gate."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import language_of, language_of_content

IGNORED_DIRS = sorted(
    """.angular .bloop .build .cache .cxx .dart_tool .docusaurus .eggs .externalNativeBuild .git .gradle .hypothesis .ipynb_checkpoints .luarocks .metals .mypy_cache .netlify
.next .nitro .nox .nuxt .nyc_output .output .parcel-cache .pdm-build .pixi .pnpm-store .pub-cache .pytest_cache .ruff_cache .svelte-kit .swiftpm .tox .turbo .venv .vercel .vinxi .vite
.wrangler .yarn Carthage DerivedData Pods __history __pycache__ __pypackages__ __recovery bower_components build coverage dist jspm_packages lua_modules node_modules obj out out-tsc
storybook-static target vcpkg_installed vendor venv web_modules""".split()
)


class Rule(NamedTuple):
    pattern: str  # over the path from the root
    negated: bool


def ignore_rules(text: str, folder: str = "") -> list[Rule]:
    """The rules of an ignore file that lies in ``folder``: a slash inside anchors, one at the end wants a folder, ``!`` takes back."""
    out = []
    for line in text.split("\n"):
        line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r"))
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        only_dir, anchored = line.endswith("/"), "/" in line.rstrip("/")
        body = re.sub(
            r"\*\*/|/\*\*|\*\*|\*|\?|\[!?[^\]]*\]|[^*?\[/]+|/|\[",
            lambda m: {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or (m[0].replace("[!", "[^") if m[0][0] == "[" and len(m[0]) > 1 else re.escape(m[0])),
            line.strip("/"),
        )
        base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        out.append(Rule(f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/' if only_dir else '(?:/|$)'}", negated))
    return out


DEFAULT_RULES = [r for d in IGNORED_DIRS for r in ignore_rules(d + "/")]


def ignored(path: Column, rules: list[Rule]) -> Column:
    """The last rule that matches decides."""
    return reduce(lambda rest, r: F.when(path.rlike(r.pattern), F.lit(not r.negated)).otherwise(rest), rules, F.lit(False))


def ignored_by_default(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(map(re.escape, IGNORED_DIRS)) + ")/")


def read_tree(spark: SparkSession, root: str, keep: Callable[[str], bool] | None = None) -> DataFrame:
    """Every file under ``root``, a folder or URL that all executors can read: path from the root, content, size, modified_at.

    The driver lists names only, for Spark's own reader leaves empty and hidden files out; executors read what is kept."""
    system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    base = base.rstrip("/")
    found = (i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File)
    rows = [(i.path[len(base) + 1 :], i.size, int(i.mtime.timestamp() * 1000)) for i in found]
    rows = [r for r in rows if keep is None or keep(r[0])]
    listing = spark.createDataFrame(rows, "path string, size long, modified_at long").repartition(max(1, min(len(rows) // 256, 10_000)))
    url = root if "://" in root else f"file://{root}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(url)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                content = []
                for name in part.column(0).to_pylist():
                    with system.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None) as f:
                        content.append(f.read())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), part.column(1), part.column(2)], names=["path", "content", "size", "modified_at"])

    return listing.mapInArrow(run, "path string, content binary, size long, modified_at long")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files that no rule ignores, with their language, sorted by path.  Ignore files of folders apply below them, after those above."""
    url = root if "://" in root else f"file://{root}"
    system, base = fs.FileSystem.from_uri(url)
    default = re.compile("(^|/)(" + "|".join(map(re.escape, IGNORED_DIRS)) + ")/")
    names = [i.path[len(base.rstrip("/")) + 1 :] for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.base_name == ".gitignore"]
    rules: list[Rule] = []
    for name in sorted((n for n in names if not default.search(n)), key=lambda n: (n.count("/"), n)):
        with system.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
            rules += ignore_rules(f.read().decode("utf-8", "replace"), name.rpartition("/")[0])
    compiled = [(re.compile(r.pattern), r.negated) for r in rules]

    def keep(name: str) -> bool:
        hit = next((negated for pattern, negated in reversed(compiled) if pattern.search(name)), True)
        return hit and not default.search(name)

    return with_language(read_tree(spark, root, keep)).orderBy("path")


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of_content(language_of(F.col("path")), F.substring(F.col("content"), 1, 4096).cast("string")))


def size_gate(files: DataFrame, limit: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Files to read, and those of known languages that are too large."""
    large = (F.col("size") > limit) & (F.col("language") != "unknown")
    return files.filter(~large), files.filter(large)


def git_listing(root: str) -> list[str]:
    """Tracked files and untracked ones that aren't ignored, embedded repositories too; empty outside of a repository."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=False).stdout.split("\0")
    names = {n for n in [*run("ls-files", "-z", "--recurse-submodules"), *run("ls-files", "-z", "-o", "--exclude-standard")] if n}
    for inner in [n for n in names if n.endswith("/")]:
        names |= {inner + n for n in git_listing(f"{root}/{inner}")}
    bad = re.compile("(^|/)(" + "|".join(map(re.escape, IGNORED_DIRS)) + ")/")
    return sorted(n for n in names if not n.endswith("/") and not bad.search(n))


def source_slice(text: Column, start: Column, end: Column) -> Column:
    """The lines start to end, from 1, of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")
