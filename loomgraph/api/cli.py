"""The command line: ``python -m loomgraph.api.cli VERB …``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from loomgraph.api.engine import VERSION, Engine, file_tree, render


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--store", default="file:///tmp/loomgraph-store", help="folder of the store, shared by all executors")
    p.add_argument("--json", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    more: dict[str, tuple] = {
        "index": ("root",), "sync": ("root", "--only"), "changes": ("root",), "status": (), "query": ("text", "--limit", "--offset"), "files": ("--folder", "--glob"), "callers": ("symbol", "--limit"),
        "callees": ("symbol", "--limit"), "impact": ("symbol", "--depth"), "node": ("symbol", "--file", "--line"), "explore": ("text",), "affected": ("changed", "--depth", "--glob", "--stdin"), "coverage": ("profile", "--module"),
        "export": ("folder", "--ref"), "import": ("folder",), "serve": (), "unlock": (), "clear": (), "version": (),
    }
    for verb, arguments in more.items():
        v = verbs.add_parser(verb)
        for a in arguments:
            if a in ("--limit", "--offset", "--depth", "--line"):
                v.add_argument(a, type=int, default={"--limit": 20, "--depth": 5 if verb == "affected" else 2}.get(a, 0))
            elif a == "--stdin":
                v.add_argument(a, action="store_true")
            elif a in ("changed", "--only"):
                v.add_argument(a, nargs="*", default=None if a == "--only" else [])
            else:
                v.add_argument(a, **({} if a[0] != "-" else {"default": None if a == "--glob" and verb == "affected" else ""}))
    return p


def answer(engine: Engine, a: argparse.Namespace, stdin: Callable[[], str] = sys.stdin.read) -> object:
    """A verb's result: rows, or a value."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    match a.verb:
        case "index":
            return engine.index(a.root)
        case "sync":
            return engine.sync_files(a.root, a.only) if a.only is not None else engine.index(a.root)
        case "changes":
            return rows(engine.changes(a.root))
        case "status":
            return engine.status()
        case "query":
            return rows(engine.query(a.text, a.limit, a.offset))
        case "files":
            return rows(engine.files(a.folder, a.glob))
        case "callers" | "callees":
            return rows(getattr(engine, a.verb)(a.symbol, a.limit))
        case "impact":
            return rows(engine.impact(a.symbol, a.depth))
        case "node":
            return rows(engine.node(a.symbol, a.file, a.line))
        case "explore":
            return rows(engine.explore(a.text))
        case "affected":
            return rows(engine.affected([*a.changed, *(stdin().split("\n") if a.stdin else [])], a.depth, a.glob))
        case "coverage":
            return engine.ingest_coverage(a.profile, a.module)
        case "export":
            return engine.export(a.folder, a.ref)
        case "import":
            return engine.load(a.folder)
        case "unlock":
            return engine.store.unlock()
        case "clear":
            return engine.store.clear()
    return VERSION


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.verb == "version":
        print(VERSION)
        return
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("loomgraph").getOrCreate(), a.store)
    if a.verb == "serve":
        from loomgraph.api.tools import serve

        serve(engine, sys.stdin, sys.stdout)
        return
    out = answer(engine, a)
    if a.json or not isinstance(out, list):
        print(json.dumps(out, default=str, indent=1))
    else:
        print(file_tree([r["path"] for r in out]) if a.verb == "files" else render(out))


if __name__ == "__main__":
    main()
