"""Scalar functions of the engine as column expressions; all run inside code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.paths import base_name, dir_name, is_test
from loomgraph.functions.words import base_terms

KIND_BONUS = {
    "function": 10, "method": 10, "interface": 9, "trait": 9, "protocol": 9, "route": 9, "class": 8, "component": 8, "type_alias": 6, "struct": 6, "enum": 5,
    "module": 4, "namespace": 4, "property": 3, "field": 3, "constant": 3, "enum_member": 3, "variable": 2, "import": 1, "export": 1,
}
LANGUAGES = {
    "py": "python", "pyi": "python", "go": "go", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "jsx", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sc": "scala", "cs": "csharp", "fs": "fsharp", "fsi": "fsharp",
    "fsx": "fsharp", "rb": "ruby", "rs": "rust", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "m": "objc", "mm": "objc", "swift": "swift", "dart": "dart", "lua": "lua", "sh": "bash", "bash": "bash", "ps1": "powershell", "psm1": "powershell",
    "psd1": "powershell", "pl": "perl", "pm": "perl", "r": "r", "jl": "julia", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "hs": "haskell",
    "sql": "sql", "sqlite": "sqlite", "sqlite3": "sqlite", "db": "sqlite", "yaml": "yaml", "yml": "yaml",
}
BASE_NAMES = {"go.mod": "go.mod", "package.json": "package.json"}


def node_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    """kind, a colon and 32 hex digits of the SHA-256 over path, kind, name and line."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line.cast("string")), 256), 1, 32))


def language_of(path: Column) -> Column:
    """By the name of the file, else by its extension."""
    ext, base = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), F.element_at(F.split(path, "/"), -1)
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    named = F.create_map(*(F.lit(x) for kv in BASE_NAMES.items() for x in kv))
    return F.coalesce(named[base], table[ext], F.lit("unknown"))


def language_of_content(language: Column, head: Column) -> Column:
    """What the first bytes of a file, as text, say beyond its name: headers of C, databases without an extension."""
    objc, cpp = r"@(interface|protocol|implementation|import)\b|#import\b", r"(^|\n)\s*(class|namespace|template)\b|std::|\b(public|private|protected):"
    header = F.when(head.rlike(objc), "objc").when(head.rlike(cpp), "cpp").otherwise("c")
    return F.when(head.startswith("SQLite format 3"), "sqlite").when((language == "c"), header).otherwise(language)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def kind_bonus(kind: Column) -> Column:
    table = F.create_map(*(x for k, v in KIND_BONUS.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(table[kind], F.lit(0.0))


def name_bonus(name: Column, query: str) -> Column:
    """Exact 80, one of several words 60, prefix 10 to 40 by the share of the name's bytes, all parts of the query 15, containment 10."""
    low, q = F.lower(name), re.sub(r"[ \t\n\r]", "", query).lower()
    if not q:
        return F.lit(0.0)
    words, parts = query.lower().split(), base_terms(query, "_.-", 2)
    out = F.when(low == q, 80.0)
    if len(words) > 1:
        out = out.when(low.isin(*words), 60.0)
    out = out.when(low.startswith(q), F.floor(F.lit(10.5) + F.lit(30.0) * (F.lit(float(len(q.encode()))) / F.octet_length(low))).cast("double"))
    if len(parts) > 1:
        out = out.when(reduce(lambda a, b: a & b, (F.contains(low, F.lit(t)) for t in parts)), 15.0)
    return out.when(F.contains(low, F.lit(q)), 10.0).otherwise(0.0)


def path_bonus(path: Column, query: str, project: frozenset[str] | set[str] = frozenset()) -> Column:
    """For each word of the query 10 if the file's name has a part of it, and 5 for its folder or else 3 for the path; 15 off for
    files of tests unless the query is about them.  Words that name the project count only if there are no others."""
    words = query.split()
    if not words:
        return F.lit(0.0)
    words = [w for w in words if re.sub(r"[^a-z0-9]", "", w.lower()) not in project] or words
    low, total = F.lower(path), F.lit(0.0)
    name, folder = base_name(low), dir_name(low)
    for parts in filter(None, map(base_terms, words)):
        has = lambda c: reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in parts))  # noqa: B023, E731
        total = total + F.when(has(name), 10.0).otherwise(0.0) + F.when(has(folder), 5.0).when(has(low), 3.0).otherwise(0.0)
    if "test" in query.lower() or "spec" in query.lower():
        return total
    return total - F.when(is_test(path), 15.0).otherwise(0.0)


def matches_symbol(name: Column, kind: Column, qualified: Column, path: Column, symbol: str) -> Column:
    """By name, a file's name without its extension, or a qualified name whose container is in the qualified name or the path."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    out = (name == symbol) | ((kind == "file") & (stem(name) == symbol))
    parts = [p for p in re.split(r"::|[./#]", symbol) if p]
    if len(parts) < 2:
        return out
    hints = [p for p in parts[:-1] if p not in ("crate", "super", "self")]
    segments = F.split(path, "/")
    inside = lambda h: F.exists(segments, lambda s: (s == h) | (stem(s) == h))
    near = reduce(lambda a, b: a & b, map(inside, hints), F.lit(bool(hints)))
    return out | ((name == parts[-1]) & (F.contains(qualified, F.lit("::".join(parts))) | near))


def is_exact_verb(name: Column, symbol: str) -> Column:
    return (name == symbol) | name.endswith("." + symbol) | name.endswith("::" + symbol)


def scope_version(version: Column) -> Column:
    """v and the major number of a version or range, v0 where there is none."""
    major = F.regexp_extract(version, r"^[\s^~>=<v]*(\d+)", 1)
    return F.concat(F.lit("v"), F.when(F.coalesce(major, F.lit("")) == "", "0").otherwise(major))


def affinity(declared: Column) -> Column:
    """The type affinity of a declared SQL type."""
    up, has = F.upper(F.coalesce(declared, F.lit(""))), lambda c, *xs: reduce(lambda a, b: a | b, (F.contains(c, F.lit(x)) for x in xs))
    return F.when(has(up, "INT"), "INTEGER").when(has(up, "CHAR", "CLOB", "TEXT"), "TEXT").when((up == "") | has(up, "BLOB"), "BLOB").when(has(up, "REAL", "FLOA", "DOUB"), "REAL").otherwise("NUMERIC")


def word_overlap(a: Column, b: Column) -> Column:
    """How many of the camel-case words of a, repeats counted, b has too."""
    split = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")), "[^a-z0-9]+"), lambda t: F.length(t) > 1)
    return F.size(F.filter(split(a), lambda t: F.array_contains(split(b), t)))


def numbered(text: Column, first: Column) -> Column:
    """Lines with their numbers and a tab."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + first).cast("string"), F.lit("\t"), line)), "\n")


def remote_parts(remote: Column) -> Column:
    """host/owner/repository of a git remote."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(remote, r"^[a-z+]+://([^@/]*@)?", ""), r"^[^@/]*@([^:/]+):", "$1/"), r"(\.git)?/*$", "")


def balanced(text: str, at: int = 0) -> str:
    """The text between the first bracket from ``at`` on and the one that closes it; quotes are skipped."""
    start = text.find("(", at)
    depth, quote = 0, ""
    for i in range(max(start, 0), len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return text[start + 1 : i]
    return ""
