"""A tool server: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable
from typing import TextIO

from loomgraph.api.cli import answer
from loomgraph.api.engine import VERSION, Engine, file_tree, render

_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
TOOLS: dict[str, tuple[str, str, dict, list[str]]] = {
    "search": ("query", "Find symbols by words, names or spelling", {"text": _TEXT, "limit": _NUMBER}, ["text"]),
    "callers": ("callers", "What uses a symbol", {"symbol": _TEXT, "limit": _NUMBER}, ["symbol"]),
    "callees": ("callees", "What a symbol uses", {"symbol": _TEXT, "limit": _NUMBER}, ["symbol"]),
    "impact": ("impact", "What a change of a symbol reaches", {"symbol": _TEXT, "depth": _NUMBER}, ["symbol"]),
    "node": ("node", "A symbol's place and signature", {"symbol": _TEXT, "file": _TEXT, "line": _NUMBER}, ["symbol"]),
    "explore": ("explore", "Files for a question", {"text": _TEXT}, ["text"]),
    "status": ("status", "Counts of the index", {}, []),
    "files": ("files", "Files of the index", {"folder": _TEXT, "glob": _TEXT}, []),
}
SMALL_FILES, SMALL_TOOLS, MAX_OUTPUT = 500, ("search", "node", "explore"), 15_000
_DEFAULTS = {"limit": 20, "offset": 0, "depth": 2, "file": "", "line": 0, "folder": "", "glob": ""}


def listed(n_files: int) -> list[dict]:
    """Tools on offer: few for a small project."""
    names = TOOLS if n_files >= SMALL_FILES else SMALL_TOOLS
    return [{"name": n, "description": TOOLS[n][1], "inputSchema": {"type": "object", "properties": TOOLS[n][2], "required": TOOLS[n][3]}} for n in names]


def handle(engine: Engine, message: dict) -> dict | None:
    """The response to one message; none to a notification."""
    id_, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if id_ is None:
        return None

    def reply(**body: object) -> dict:
        return {"jsonrpc": "2.0", "id": id_, **body}

    if method == "initialize":
        return reply(result={"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": VERSION}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": listed(engine.status()["fileCount"])})
    if method != "tools/call":
        return reply(error={"code": -32601, "message": f"no method {method}"})
    name, arguments = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        return reply(error={"code": -32602, "message": f"no tool {name}"})
    verb, _, known, required = TOOLS[name]
    if missing := [k for k in required if not arguments.get(k)]:
        return reply(result={"isError": True, "content": [{"type": "text", "text": f"{missing[0]} is missing"}]})
    try:
        out = answer(engine, argparse.Namespace(verb=verb, **(_DEFAULTS | {k: v for k, v in arguments.items() if k in known})))
        text = json.dumps(out, default=str) if not isinstance(out, list) else file_tree([r["path"] for r in out]) if name == "files" else render(out, MAX_OUTPUT)
        return reply(result={"content": [{"type": "text", "text": text[:MAX_OUTPUT]}]})
    except Exception as e:  # a failed question must not end the server
        return reply(result={"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"[:2000]}]})


def serve(engine: Engine, lines: Iterable[str], out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            response = handle(engine, json.loads(line))
        except ValueError:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if response is not None:
            out.write(json.dumps(response, default=str) + "\n")
            out.flush()
