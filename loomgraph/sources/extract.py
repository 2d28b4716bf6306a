"""Extraction: source files to nodes, containment and references, one file at a time in Arrow batches.

Python is read with its own parser, databases with sqlite3, manifests as JSON or lines.  Every other language is a
``Spec``: how comments and strings look, how a body ends, and regular expressions of definitions, imports and bases.  The scanner blanks
comments and strings, places definitions, nests them by their spans, and gives the calls inside to the innermost one.

Defined results: a file without text, of an unknown language or in YAML is one bare file node; a file that its parser refuses is its file node
and an error; names that are empty are skipped, ids that repeat are kept once."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import sqlite3
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FILE = 1 << 20
NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, is_exported boolean, metadata map<string,string>, ord int"
EDGE = "source string, target string, kind string, metadata map<string,string>, line int, provenance string"
REF = "from_node string, name string, kind string, line int, col int"
BUNDLE = f"path string, language string, nodes array<struct<{NODE.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean').replace(' map<', ':map<')}>>, edges array<struct<{EDGE.replace(' string', ':string').replace(' int', ':int').replace(' map<', ':map<')}>>, refs array<struct<{REF.replace(' string', ':string').replace(' int', ':int')}>>, errors array<string>"
_S, _I = pa.string(), pa.int32()
_NODE = pa.struct([("id", _S), ("kind", _S), ("name", _S), ("qualified_name", _S), ("file_path", _S), ("language", _S), ("start_line", _I), ("end_line", _I), ("docstring", _S), ("signature", _S), ("is_exported", pa.bool_()), ("metadata", pa.map_(_S, _S)), ("ord", _I)])
_EDGE = pa.struct([("source", _S), ("target", _S), ("kind", _S), ("metadata", pa.map_(_S, _S)), ("line", _I), ("provenance", _S)])
_REF = pa.struct([("from_node", _S), ("name", _S), ("kind", _S), ("line", _I), ("col", _I)])


def node_id(kind: str, path: str, name: str, line: int) -> str:
    return f"{kind}:" + hashlib.sha256(f"{path}:{kind}:{name}:{line}".encode()).hexdigest()[:32]


def shortened(value: str, limit: int = 100) -> str:
    raw = value.encode()
    return value if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore") + "..."


class Bundle:
    """What one file gives."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.text = path, language, text
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.refs: list[dict] = []
        self.errors: list[str] = []
        self.ids: set[str] = set()
        self.file = f"file:{path}"
        lines = text.count("\n") + (not text.endswith("\n")) if text else 1
        self._put(self.file, "file", path.rsplit("/", 1)[-1], path, 1, max(1, lines))

    def _put(self, id_: str, kind: str, name: str, qualified: str, line: int, end: int, doc: str | None = None, signature: str | None = None, exported: bool = False, metadata: dict | None = None) -> bool:
        if id_ in self.ids:
            return False
        self.ids.add(id_)
        self.nodes.append({"id": id_, "kind": kind, "name": name, "qualified_name": qualified, "file_path": self.path, "language": self.language, "start_line": line, "end_line": end, "docstring": doc or None, "signature": signature or None, "is_exported": exported, "metadata": list(metadata.items()) if metadata else None, "ord": len(self.nodes)})
        return True

    def node(self, kind: str, name: str, line: int, end: int | None = None, within: tuple[str, ...] = (), parent: str | None = None, **more) -> str | None:
        if not name:
            return None
        id_ = node_id(kind, self.path, name, line)
        if self._put(id_, kind, name, "::".join((*within, name)), line, end or line, **more):
            self.edge(parent or self.file, id_, "contains")
        return id_

    def edge(self, source: str, target: str, kind: str, line: int | None = None, metadata: dict | None = None, provenance: str | None = None) -> None:
        self.edges.append({"source": source, "target": target, "kind": kind, "metadata": list(metadata.items()) if metadata else None, "line": line, "provenance": provenance})

    def ref(self, source: str | None, name: str, kind: str, line: int, col: int = 0) -> None:
        if name:
            self.refs.append({"from_node": source or self.file, "name": name, "kind": kind, "line": line, "col": col})


# -- Python ---------------------------------------------------------------------------------------------------------


def _dotted(x: ast.AST) -> str:
    if isinstance(x, ast.Name):
        return x.id
    if isinstance(x, ast.Attribute):
        head = _dotted(x.value)
        return x.attr if not head or head in ("self", "cls", "super") else f"{head.rsplit('.', 1)[-1]}.{x.attr}"
    if isinstance(x, ast.Call) and _dotted(x.func) == "super":
        return "super"
    return ""


def python(b: Bundle) -> None:
    lines = b.text.split("\n")

    def assigned(target: ast.expr, value: ast.expr | None, at: int, parent, within, in_class, fields) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            return
        signature = "= " + shortened(ast.get_source_segment(b.text, value) or "") if value else None
        if isinstance(target, ast.Name):
            upper = re.fullmatch(r"[A-Z][A-Z0-9_]*|__\w+__", target.id)
            b.node("field" if in_class else "constant" if upper else "variable", target.id, at, within=within, parent=parent, signature=signature)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and fields:
            b.node("field", target.attr, at, within=fields[1], parent=fields[0], signature=signature)

    def calls(x: ast.AST, owner: str | None) -> None:
        for c in ast.walk(x):
            if isinstance(c, ast.Call) and (name := _dotted(c.func)) and name != "super":
                b.ref(owner, name, "calls", c.lineno, c.col_offset)

    def visit(body: list, parent: str | None, within: tuple[str, ...], in_class: bool, fields) -> None:
        for x in body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                heads = [_dotted(d.func if isinstance(d, ast.Call) else d) for d in x.decorator_list]
                kind = "property" if in_class and any(h.rsplit(".", 1)[-1] in ("property", "cached_property") for h in heads) else "method" if in_class else "function"
                args = ast.unparse(x.args)
                id_ = b.node(kind, x.name, x.lineno, x.end_lineno, within, parent, doc=ast.get_docstring(x), signature=f"({args})" + (f" -> {ast.unparse(x.returns)}" if x.returns else ""), exported=not x.name.startswith("_"))
                for h in filter(None, heads):
                    b.ref(id_, h, "decorates", x.lineno)
                visit(x.body, id_, (*within, x.name), False, fields)
            elif isinstance(x, ast.ClassDef):
                id_ = b.node("class", x.name, x.lineno, x.end_lineno, within, parent, doc=ast.get_docstring(x), exported=not x.name.startswith("_"))
                for base in x.bases:
                    b.ref(id_, _dotted(base).rsplit(".", 1)[-1], "extends", x.lineno, base.col_offset)
                for d in x.decorator_list:
                    b.ref(id_, _dotted(d.func if isinstance(d, ast.Call) else d), "decorates", x.lineno)
                visit(x.body, id_, (*within, x.name), True, (id_, (*within, x.name)))
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                names = [(a.asname or (a.name if a.name != "*" else x.module or "")) for a in x.names]
                if isinstance(x, ast.ImportFrom) and x.module:
                    names.insert(0, x.module)
                for name in dict.fromkeys(names):
                    b.node("import", name, x.lineno, x.end_lineno, signature=lines[x.lineno - 1].strip())
                    b.ref(None, name, "imports", x.lineno, x.col_offset)
            else:
                if isinstance(x, (ast.Assign, ast.AnnAssign)):
                    for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                        assigned(t, x.value, x.lineno, parent, within, in_class, fields)
                inner = [s for f in ("body", "orelse", "finalbody") for s in getattr(x, f, [])] + [s for h in getattr(x, "handlers", []) for s in h.body]
                if inner:
                    for f in ("test", "iter", "items", "subject"):
                        for y in (v if isinstance(v := getattr(x, f, None), list) else [v] if v else []):
                            calls(y, parent)
                    visit(inner, parent, within, in_class, fields)
                else:
                    calls(x, parent)

    try:
        visit(ast.parse(b.text).body, None, (), False, None)
    except (SyntaxError, ValueError, RecursionError) as e:
        b.errors.append(f"parse: {e}")


# -- languages by pattern -------------------------------------------------------------------------------------------


class Spec(NamedTuple):
    defs: tuple[tuple[str, str], ...]  # (kind, pattern with the groups name and perhaps bases and recv), tried in this order at each place
    imports: tuple[str, ...] = ()  # patterns with the group name
    comment: str = r"//[^\n]*|/\*.*?\*/"
    string: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    body: str = "brace"  # brace, end (a line that begins with it, no deeper), indent, clause (up to the next definition)
    call: str = r"(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*!?)\s*(?=\()"
    made: str = r"\bnew\s+(?P<name>[A-Za-z_][\w.]*)"
    method: bool = True  # functions inside of containers are methods


_CONTAINERS = {"class", "struct", "interface", "trait", "enum", "module", "namespace"}
_NOT_NAMES = set("if for while switch catch return function elif elseif unless until foreach synchronized sizeof typeof match where in throw lock await else do end".split())
_NOT_CALLS = set("super import package require source readonly export local declare module behaviour record my our property include if for while switch catch return function func fun fn def sub elif elseif unless until foreach synchronized sizeof typeof when match where and or not in new throw print using lock fixed nameof await else do end".split())
_N = r"(?P<name>[A-Za-z_$][\w$]*)"
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|open|data|override|virtual|async|readonly|export|default|declare|pub(?:\([a-z]+\))?|inner|case|implicit|lazy|const|fileprivate|mutating|unsafe|extern|inline|suspend|companion|value|final|base|mixin|external|required|convenience|@\w+)\s+)*"
_BASES = r"(?P<bases>[^{};\n]*)"
_TYPED = r"^[ \t]*" + _MOD + r"(?!(?:return|new|else|throw|case|goto|delete|await|yield|using|package|import|typedef)\b)(?:[A-Za-z_][\w:.]*(?:<[^;{}()]*>)?(?:\[\])*[ \t*&?]+)+(?P<name>~?[A-Za-z_]\w*)\s*\([^;{}]*?\)\s*(?:const|noexcept|override|final|async|throws\s+[\w,. ]+)*\s*(?:=\s*(?:0|default|delete)\s*)?(?=\{|;|=>)"
_FIELD = r"^[ \t]+" + _MOD + r"(?!(?:return|new|else|throw|case|goto|delete|await|yield|using|package|import|typedef|var|let|val)\b)[A-Za-z_][\w:.]*(?:<[^;{}()]*>)?(?:\[\])*[ \t*&?]+(?P<name>[A-Za-z_]\w*)\s*(?=;|=[^=>])"


def _type(word: str) -> str:
    return rf"^[ \t]*{_MOD}{word}\s+{_N}\s*(?:<[^{{}};\n]*?>)?{_BASES}"


_HASH = r"#[^\n]*"
SPECS: dict[str, Spec] = {
    "go": Spec(
        (("method", rf"^func\s*\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*{_N}\s*\("), ("function", rf"^func\s+{_N}\s*[(\[]"), ("struct", rf"^type\s+{_N}(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"^type\s+{_N}\s+interface\b"), ("type_alias", rf"^type\s+{_N}\s+(?!struct|interface)"),
         ("constant", rf"^const\s+{_N}\b"), ("variable", rf"^var\s+{_N}\b")),
        (r"^import\s+(?:[\w.]+\s+)?\"(?P<name>[^\"]+)\"", r"^\s+(?:[\w.]+\s+)?\"(?P<name>[^\"]+)\"\s*$"), string=r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'"),
    "typescript": Spec(
        (("function", rf"^[ \t]*{_MOD}function\s*\*?\s*{_N}\s*[(<]"), ("function", rf"^[ \t]*{_MOD}(?:const|let|var)\s+{_N}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::\s*[\w<>\[\]. |]+)?=>|\w+\s*=>)"), ("class", _type("class")), ("interface", _type("interface")), ("enum", _type("enum")),
         ("type_alias", rf"^[ \t]*{_MOD}type\s+{_N}\s*(?:<[^=]*>)?="), ("constant", rf"^(?:export\s+)?const\s+{_N}\b"), ("variable", rf"^(?:export\s+)?(?:let|var)\s+{_N}\b"), ("method", rf"^[ \t]+{_MOD}(?:get\s+|set\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_N}\s*(?:<[^>()]*>)?\([^()]*\)\s*(?::\s*[^{{;\n]+)?(?=\{{)")),
        (r"^\s*import\s+(?:type\s+)?(?:[^'\"]*?\s+from\s+)?['\"](?P<name>[^'\"]+)['\"]", r"^\s*export\s+[^'\"=]*?\s+from\s+['\"](?P<name>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<name>[^'\"]+)['\"]\s*\)"), string=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "java": Spec((("class", _type("class")), ("class", _type("record")), ("interface", _type("@?interface")), ("enum", _type("enum")), ("method", _TYPED), ("method", rf"^[ \t]+{_MOD}{_N}\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w,. ]+)?(?=\{{)"), ("field", _FIELD)),
                 (r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;",)),
    "kotlin": Spec((("class", _type("(?:data |sealed |enum |annotation )?class")), ("interface", _type("(?:fun )?interface")), ("class", _type("object")), ("type_alias", rf"^[ \t]*{_MOD}typealias\s+{_N}"), ("function", rf"^[ \t]*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_N}\s*\("), ("property", rf"^[ \t]*{_MOD}va[lr]\s+{_N}\b")), (r"^\s*import\s+(?P<name>[\w.]+(?:\.\*)?)",)),
    "scala": Spec((("interface", _type("(?:sealed )?trait")), ("class", _type("(?:case )?class")), ("class", _type("(?:case )?object")), ("enum", _type("enum")), ("function", rf"^[ \t]*{_MOD}def\s+{_N}"), ("field", rf"^[ \t]*{_MOD}va[lr]\s+{_N}\b"), ("type_alias", rf"^[ \t]*{_MOD}type\s+{_N}")), (r"^\s*import\s+(?P<name>[\w.]+(?:\.(?:_|\*|\{{[^}}]*\}}))?)",)),
    "csharp": Spec((("namespace", r"^[ \t]*namespace\s+(?P<name>[\w.]+)"), ("class", _type("(?:record |static )?class")), ("class", _type("record")), ("struct", _type("(?:readonly )?struct")), ("interface", _type("interface")), ("enum", _type("enum")), ("property", r"^[ \t]+" + _MOD + r"[A-Za-z_][\w<>.,\[\]? ]*\s+(?P<name>[A-Za-z_]\w*)\s*(?=\{\s*(?:get|set|init))"), ("method", _TYPED), ("method", rf"^[ \t]+{_MOD}{_N}\s*\([^;{{}}()]*\)\s*(?::\s*(?:base|this)\([^)]*\)\s*)?(?=\{{)"), ("field", _FIELD)), (r"^\s*using\s+(?:static\s+|\w+\s*=\s*)?(?P<name>[\w.]+)\s*;",)),
    "fsharp": Spec((("namespace", r"^namespace\s+(?P<name>[\w.]+)"), ("module", r"^[ \t]*module[ \t]+(?:rec[ \t]+)?(?P<name>[\w.]+)"), ("class", rf"^[ \t]*type\s+{_N}\s*\([^)\n]*\)"), ("interface", rf"^[ \t]*type\s+{_N}\s*=\s*\n\s+abstract\b"), ("struct", rf"^[ \t]*type\s+{_N}\s*=\s*\{{"), ("enum", rf"^[ \t]*type\s+{_N}\s*=\s*\n?\s*\|"), ("type_alias", rf"^[ \t]*type\s+{_N}\s*="), ("method", rf"^[ \t]*(?:member|override|abstract|static member|default)\s+(?:\w+\.)?{_N}"), ("function", rf"^[ \t]*let\s+(?:rec\s+|inline\s+)?{_N}\s+(?:\(|\w)[^=\n]*="), ("variable", rf"^let\s+(?:mutable\s+)?{_N}\s*(?::[^=\n]+)?=")), (r"^\s*open\s+(?P<name>[\w.]+)",), comment=r"//[^\n]*|\(\*.*?\*\)", body="indent"),
    "ruby": Spec((("module", r"^[ \t]*module\s+(?P<name>[\w:]+)"), ("class", r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)(?P<bases>\s*<\s*[\w:]+)?"), ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)"), ("constant", r"^[ \t]*(?P<name>[A-Z][A-Z0-9_]*)\s*=[^=]")), (r"^\s*require(?:_relative)?\s*\(?['\"](?P<name>[^'\"]+)['\"]", r"^\s*(?:include|extend|prepend)\s+(?P<name>[A-Z][\w:]*)"), comment=_HASH + r"|^=begin.*?^=end", body="end", call=r"(?P<name>(?:[A-Za-z_@][\w]*(?:\.|::))?[A-Za-z_]\w*[?!]?)(?:\s*\(|(?<=[.])(?!\w)|(?<=\.new)\b)"),
    "rust": Spec((("module", rf"^[ \t]*{_MOD}mod\s+{_N}\s*(?=\{{)"), ("interface", rf"^[ \t]*{_MOD}trait\s+{_N}{_BASES}"), ("struct", rf"^[ \t]*{_MOD}struct\s+{_N}"), ("enum", rf"^[ \t]*{_MOD}enum\s+{_N}"), ("type_alias", rf"^[ \t]*{_MOD}type\s+{_N}"), ("constant", rf"^[ \t]*{_MOD}(?:static\s+)?(?!fn\b){_N}\s*:\s*[^=;{{}}()\n]+=\s*[^;]+;(?<=;)"), ("function", rf"^[ \t]*{_MOD}fn\s+{_N}"), ("impl", r"^[ \t]*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^>{]*>)?\s+for\s+)?(?P<name>\w+)")), (r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+(?:::\*)?)",), string=r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", made=r"\b(?P<name>[A-Z]\w*)\s*\{(?=\s*\w+\s*[:,}])"),
    "php": Spec((("namespace", r"^\s*namespace\s+(?P<name>[\w\\]+)"), ("class", _type("class")), ("interface", _type("interface")), ("trait", _type("trait")), ("enum", _type("enum")), ("function", rf"^[ \t]*{_MOD}function\s+&?{_N}"), ("constant", rf"^[ \t]*{_MOD}const\s+(?:\w+\s+)?(?P<name>[A-Z_][A-Z0-9_]*)\s*=".replace("const|", "")), ("field", r"^[ \t]+(?:(?:public|private|protected|static|readonly|var)\s+)+(?:[\w?|\\]+\s+)?\$(?P<name>\w+)")), (r"^\s*use\s+(?P<name>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<name>[^'\"]+)['\"]"), comment=r"//[^\n]*|#[^\n\[]*|/\*.*?\*/"),
    "c": Spec((("struct", rf"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+{_N}\s*(?=\{{)"), ("enum", rf"^[ \t]*(?:typedef\s+)?enum\s+{_N}\s*(?=\{{)"), ("constant", r"^[ \t]*#\s*define\s+(?P<name>[A-Z_][A-Z0-9_]*)\b"), ("function", _TYPED.replace("=>", "\\{").replace(";|", ""))), (r"^\s*#\s*(?:include|import)\s*[<\"](?P<name>[^>\"]+)[>\"]",)),
    "cpp": Spec((("namespace", rf"^[ \t]*namespace\s+{_N}"), ("class", _type("class").replace(r"\s+(?P<name>", r"\s+(?P<name>") + r"(?=\{)"), ("struct", _type("struct") + r"(?=\{)"), ("enum", rf"^[ \t]*enum\s+(?:class\s+)?{_N}"), ("constant", r"^[ \t]*#\s*define\s+(?P<name>[A-Z_][A-Z0-9_]*)\b"), ("method", r"^[ \t]*(?:[\w:<>*&]+[ \t*&]+)*(?P<recv>\w+)::(?P<name>~?\w+)\s*\([^;{}]*\)[^;{}]*(?=\{)"), ("function", _TYPED)), (r"^\s*#\s*include\s*[<\"](?P<name>[^>\"]+)[>\"]", r"^\s*using\s+(?:namespace\s+)?(?P<name>[\w:]+)\s*;")),
    "objc": Spec((("interface", rf"^@protocol\s+{_N}(?P<bases>\s*<[^>\n]*>)?"), ("class", rf"^@interface\s+{_N}(?P<bases>\s*:\s*\w+\s*(?:<[^>\n]*>)?)?"), ("impl", rf"^@implementation\s+{_N}"), ("method", r"^[-+]\s*\([^)\n]*\)\s*(?P<name>\w+:?)"), ("property", r"^@property\s*(?:\([^)]*\))?\s*[\w<>* ]*?[ *](?P<name>\w+)\s*;"), ("function", _TYPED.replace(_MOD, "").replace("=>", "\\{").replace(";|", ""))), (r"^\s*#\s*(?:include|import)\s*[<\"](?P<name>[^>\"]+)[>\"]",), body="objc", call=r"\[\s*(?P<name>\w+\s+\w+)|(?P<plain>[A-Za-z_]\w*)\s*\("),
    "swift": Spec((("interface", _type("protocol")), ("struct", _type("struct")), ("class", _type("(?:class|actor)")), ("enum", _type("(?:indirect )?enum")), ("extension", _type("extension")), ("type_alias", rf"^[ \t]*{_MOD}typealias\s+{_N}"), ("function", rf"^[ \t]*{_MOD}func\s+{_N}"), ("method", rf"^[ \t]+{_MOD}(?P<name>init)\??\s*\("), ("field", rf"^[ \t]+{_MOD}(?:let|var)\s+{_N}\s*[:=]"), ("constant", rf"^{_MOD}let\s+{_N}\b"), ("variable", rf"^{_MOD}var\s+{_N}\b")), (r"^\s*(?:@testable\s+)?import\s+(?P<name>[\w.]+)",)),
    "dart": Spec((("class", _type("(?:abstract )?class")), ("class", _type("mixin")), ("enum", _type("enum")), ("type_alias", rf"^typedef\s+{_N}"), ("function", _TYPED), ("method", rf"^[ \t]+(?:factory\s+|const\s+)?(?P<name>[A-Z]\w*(?:\.\w+)?)\s*\([^;{{}}]*?\)\s*(?=;|\{{|:|=>)"), ("field", _FIELD)), (r"^\s*(?:import|export|part)\s+['\"](?P<name>[^'\"]+)['\"]",)),
    "lua": Spec((("function", r"^[ \t]*(?:local\s+)?function\s+(?:(?P<recv>[\w.]+)[.:])?(?P<name>\w+)"), ("function", rf"^[ \t]*local\s+{_N}\s*=\s*function\b"), ("variable", rf"^local\s+{_N}\s*=")), (r"\brequire\s*\(?\s*['\"](?P<name>[^'\"]+)['\"]",), comment=r"--\[\[.*?\]\]|--[^\n]*", body="end", call=r"(?P<name>[A-Za-z_]\w*(?:[.:][A-Za-z_]\w*)*)\s*(?=[({])"),
    "bash": Spec((("function", r"^[ \t]*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*(?=\{|\n)"), ("constant", rf"^[ \t]*(?:readonly|declare\s+-r)\s+{_N}="), ("variable", rf"^(?:export\s+)?{_N}=")), (r"^\s*(?:source|\.)\s+(?P<name>[\w./-]+)",), comment=r"(?<![$\w{])#[^\n]*", call=r"^[ \t]*(?:if |while |! )?(?P<name>[A-Za-z_][\w-]*)(?=\s|$|;)"),
    "powershell": Spec((("class", r"^[ \t]*class\s+(?P<name>\w+)(?P<bases>\s*:\s*[\w, ]+)?"), ("enum", r"^[ \t]*enum\s+(?P<name>\w+)"), ("function", r"^[ \t]*function\s+(?P<name>[\w-]+)"), ("method", r"^[ \t]+(?:static\s+|hidden\s+)*(?:\[[\w.\[\]]+\]\s*)?(?P<name>[A-Za-z]\w*)\s*\([^)]*\)\s*(?=\{)"), ("variable", r"^\$(?P<name>\w+)\s*=")), (r"^\s*(?:\.\s+|Import-Module\s+|using\s+module\s+)(?P<name>[\w./\\-]+)",), comment=r"<#.*?#>|#[^\n]*", call=r"(?P<name>\b[A-Z]\w*-\w+)|\$\w+(?P<plain>\.\w+)\(", made=r"\[(?P<name>\w+)\]::new"),
    "perl": Spec((("module", r"^[ \t]*package\s+(?P<name>[\w:]+)"), ("function", r"^[ \t]*sub\s+(?P<name>\w+)"), ("variable", r"^(?:my|our)\s+[$@%](?P<name>\w+)")), (r"^\s*(?:use|require)\s+(?!strict|warnings|parent|base)(?P<name>[A-Z][\w:]*)",), comment=r"(?<![$\w])#[^\n]*|^=\w+.*?^=cut", call=r"(?P<name>(?:[A-Z]\w*(?:::\w+)*|\$\w+)?(?:->|::)?[a-z_]\w*)\s*(?=\()", body="brace"),
    "r": Spec((("function", r"^[ \t]*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b"), ("class", r"^[ \t]*(?:\w+\s*<-\s*)?(?:setClass|setRefClass|R6Class)\(\s*['\"](?P<name>\w+)['\"]"), ("variable", r"^(?P<name>[\w.]+)\s*<-\s*(?!function)")), (r"^\s*(?:library|require|source|requireNamespace)\(\s*['\"]?(?P<name>[\w./]+)['\"]?",), comment=_HASH, call=r"(?P<name>[A-Za-z.][\w.]*(?:::[\w.]+)?)\s*(?=\()"),
    "julia": Spec((("module", r"^[ \t]*module\s+(?P<name>\w+)"), ("interface", r"^[ \t]*abstract\s+type\s+(?P<name>\w+)(?P<bases>\s*<:\s*\w+)?"), ("struct", r"^[ \t]*(?:mutable\s+)?struct\s+(?P<name>\w+)(?P<bases>\s*<:\s*\w+)?"), ("function", r"^[ \t]*(?:function|macro)\s+(?:\w+\.)?(?P<name>\w+!?)"), ("function", r"^[ \t]*(?P<name>[a-z_]\w*!?)\([^()\n]*\)\s*(?:::\w+\s*)?=(?!=)"), ("constant", r"^[ \t]*const\s+(?P<name>\w+)")), (r"^\s*(?:using|import)\s+\.*(?P<name>[\w.]+)", r"^\s*include\(\s*\"(?P<name>[^\"]+)\""), comment=r"#=.*?=#|#[^\n]*", body="end", method=False),
    "elixir": Spec((("module", r"^[ \t]*defmodule\s+(?P<name>[\w.]+)"), ("interface", r"^[ \t]*defprotocol\s+(?P<name>[\w.]+)"), ("impl", r"^[ \t]*defimpl\s+(?P<bases>[\w.]+)\s*,\s*for:\s*(?P<name>[\w.]+)"), ("function", r"^[ \t]*def(?:p|macro|macrop)?\s+(?P<name>[a-z_]\w*[?!]?)"), ("struct", r"^[ \t]*(?P<name>defstruct)\b")), (r"^\s*(?:alias|import|use|require)\s+(?P<name>[A-Z][\w.]*)",), comment=_HASH, string=r"\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"", body="end", call=r"(?P<name>(?:[A-Z][\w]*\.)*[a-z_]\w*[?!]?)\s*(?=\()", method=False),
    "erlang": Spec((("module", r"^-module\(\s*(?P<name>\w+)"), ("struct", r"^-record\(\s*(?P<name>\w+)"), ("constant", r"^-define\(\s*(?P<name>\w+)"), ("function", r"^(?P<name>[a-z]\w*)\s*\([^.]*?\)\s*(?:when[^.]*?)?->")), (r"^-(?:include|include_lib)\(\s*\"(?P<name>[^\"]+)\"", r"^-import\(\s*(?P<name>\w+)"), comment=r"%[^\n]*", string=r"\"(?:\\.|[^\"\\])*\"", body="clause", call=r"(?P<name>[a-z]\w*(?::[a-z]\w*)?)\s*(?=\()", method=False),
    "haskell": Spec((("module", r"^module\s+(?P<name>[\w.]+)"), ("interface", r"^class\s+(?:\([^)]*\)\s*=>\s*|\w+\s+\w+\s*=>\s*)?(?P<name>[A-Z]\w*)"), ("struct", r"^(?:data|newtype)\s+(?P<name>[A-Z]\w*)"), ("type_alias", r"^type\s+(?P<name>[A-Z]\w*)"), ("impl", r"^instance\s+(?:\([^)]*\)\s*=>\s*)?(?P<bases>[A-Z]\w*)\s+\(?(?P<name>[A-Z]\w*)"), ("function", r"^(?P<name>[a-z_][\w']*)\s*::"), ("method", r"^[ \t]+(?P<name>[a-z_][\w']*)\s*::")), (r"^import\s+(?:qualified\s+)?(?P<name>[\w.]+)",), comment=r"\{-.*?-\}|--[^\n]*", string=r"\"(?:\\.|[^\"\\\n])*\"", body="indent", call=r"(?<=[=( $])(?P<name>[A-Z]\w*\.[a-z]\w*|[a-z]\w*)(?=\s+(?!where\b)[\w(\"])", method=False),
}
for _same, _of in {"javascript": "typescript", "tsx": "typescript", "jsx": "typescript"}.items():
    SPECS[_same] = SPECS[_of]
ROUTE = re.compile(r"\.(?P<verb>GET|POST|PUT|DELETE|PATCH|HandleFunc|Handle|Get|Post|Put|Delete|Patch)\(\s*\"(?P<path>/[^\"]*)\"")


class _Def(NamedTuple):
    kind: str
    name: str
    at: int
    end: int
    match: re.Match


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _spans(spec: Spec, code: str, line_starts: list[int], at: int, head: int, kind: str = "", opens: str = "") -> int:
    """Where the body of the definition at ``at``, whose head ends at ``head``, ends."""
    n = len(code)
    line = code.find("\n", head)
    line = n if line < 0 else line
    if kind in ("constant", "variable", "field", "property", "type_alias") or code[head - 1 : head] == "=" or spec.body == "end" and re.search(r"\bend\s*$", code[head:line]):
        return line
    if spec.body == "end" and opens and not re.search(opens, code[at:line]):
        return line
    if spec.body in ("brace", "objc"):
        stop = re.compile(r"[;{]|\n\s*\n" if spec.body == "brace" else r"[;{]|\n").search(code, head)
        if spec.body == "objc" and code.startswith("@", at):
            end = code.find("@end", head)
            return n if end < 0 else end + 4
        if not stop or stop[0] != "{":
            return line
        depth = 0
        for m in re.compile(r"[{}]").finditer(code, stop.start()):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.end()
        return n
    first = code.rfind("\n", 0, at) + 1
    indent = len(re.match(r"[ \t]*", code[first:])[0])
    k = bisect_right(line_starts, at)
    last = line
    if spec.body == "end" and re.search(r"(?<!\w)(?:=(?!=).*|do:.*)$", code[head:last]) and not re.search(r"\bfunction\b|\bdo\s*$", code[at:last]):
        return last
    for i in range(k, len(line_starts)):
        line = code[line_starts[i] : line_starts[i + 1] if i + 1 < len(line_starts) else n]
        text = line.strip()
        if not text or line_starts[i] <= head - 1 and spec.body != "end":
            continue
        deep = len(line) - len(line.lstrip(" \t"))
        if spec.body == "end" and deep <= indent and re.match(r"end\b", text):
            return line_starts[i] + deep + 3
        if spec.body == "indent" and deep <= indent:
            return line_starts[i] - 1
    return n if spec.body != "end" else last


def by_pattern(b: Bundle) -> None:
    spec = SPECS[b.language]
    both = re.compile(f"(?P<c>{spec.comment})|(?P<s>{spec.string})", re.S | re.M)
    plain = both.sub(lambda m: _blank(m) if m["c"] is not None else m[0], b.text)
    code = both.sub(_blank, b.text)
    starts = [0, *(m.end() for m in re.finditer("\n", b.text))]
    line_of = lambda i: bisect_right(starts, i)
    taken: dict[int, _Def] = {}
    begun: set[int] = set()
    for kind, pattern in spec.defs:
        named_in_text = "['\\\"]" in pattern
        for m in re.finditer(pattern, plain if named_in_text else code, re.M):
            at = m.start("name")
            if m["name"] in _NOT_NAMES or at in taken or m.start() in begun:
                continue
            begun.add(m.start())
            opens = r"\bdo\b" if b.language == "elixir" else ""
            taken[at] = _Def(kind, m["name"], at, _spans(spec, code, starts, m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), kind, opens), m)
    defs = sorted(taken.values(), key=lambda d: (d.match.start(), -d.end))
    if spec.body == "clause":
        defs = [d._replace(end=defs[i + 1].match.start() - 1 if i + 1 < len(defs) else len(code)) for i, d in enumerate(defs)]
        module = next((d for d in defs if d.kind == "module"), None)
        defs = [d._replace(end=len(code)) if d is module else d for d in defs]
        seen: set[tuple[str, str]] = set()
        defs = [d for d in defs if (d.kind, d.name) not in seen and not seen.add((d.kind, d.name))]
    if b.language in ("perl", "fsharp", "haskell", "csharp", "php", "go"):  # a package or namespace without a body goes on to the end
        defs = [d._replace(end=len(code)) if d.kind in ("module", "namespace") and "{" not in code[d.at : d.end] else d for d in defs]
    stack: list[tuple[_Def, str | None, tuple[str, ...]]] = []
    spans: list[tuple[int, int, str | None]] = []
    types: dict[str, str | None] = {}
    for d in defs:
        start = d.match.start() + len(d.match[0]) - len(d.match[0].lstrip())
        while stack and stack[-1][0].end <= start:
            stack.pop()
        parent, within = (stack[-1][1], stack[-1][2]) if stack else (None, ())
        inside = any(x[0].kind in _CONTAINERS | {"impl", "extension"} and x[0].kind not in ("module", "namespace") or x[0].kind in ("module",) and b.language in ("ruby",) for x in stack[-1:])
        kind = "method" if d.kind == "function" and inside and spec.method else d.kind
        if kind in ("field", "property", "constant", "variable") and stack and stack[-1][0].kind in ("function", "method"):
            continue  # a local
        if kind == "field" and not inside or kind in ("function", "method") and stack and stack[-1][0].kind in ("function", "method") and b.language in ("c", "cpp", "objc", "java", "csharp", "dart") and code[d.match.end() : d.match.end() + 1] == ";":
            continue
        recv = d.match.groupdict().get("recv")
        bases = d.match.groupdict().get("bases") or ""
        if kind in ("impl", "extension"):
            own = types.get(d.name)
            for base in _base_names(bases):
                b.ref(own, base, "implements", line_of(start), start - starts[line_of(start) - 1])
            stack.append((d, own, (d.name,)))
            continue
        if recv:
            kind, within, parent = "method" if b.language != "lua" else kind, (recv.rsplit(".", 1)[-1],), types.get(recv)
        line, end = line_of(start), line_of(max(start, d.end - 1))
        head = b.text[start : d.match.end()].strip().split("\n")[0]
        id_ = b.node(kind, d.name, line, max(line, end), within, parent, doc=_doc(b.text, starts, line, spec), signature=shortened(head), exported=_exported(b.language, d.name, head))
        if recv and parent:
            b.edge(b.file, id_, "contains")
        if kind in _CONTAINERS:
            types.setdefault(d.name, id_)
            for i, base in enumerate(_base_names(bases)):
                b.ref(id_, base, "implements" if re.search(rf"\bimplements\b.*\b{re.escape(base)}\b", bases) else "extends", line, start - starts[line - 1])
        if kind in ("function", "method") or kind in _CONTAINERS:
            stack.append((d, id_, (*within, d.name)))
        spans.append((start, d.end, id_))
    declared = re.search(r"^(?:func|type|var|const)\b", code, re.M) if b.language == "go" else None
    for pattern in spec.imports:
        for m in re.finditer(pattern, plain, re.M):
            if declared and m.start() > declared.start():
                continue
            if code[m.start() : m.start("name")].strip(" \t\n") == "" and "^" not in pattern:
                continue
            line = line_of(m.start("name"))
            b.node("import", m["name"], line, signature=shortened(b.text[starts[line - 1] :].split("\n")[0].strip()))
            b.ref(None, m["name"], "imports", line)
    heads = {d.at for d in defs}
    class_heads = [(d.match.start(), d.match.end()) for d in defs if d.kind in _CONTAINERS]
    callable_ = [s for s in spans if s[2]]

    def owner(at: int) -> str | None:
        best = None
        for lo, hi, id_ in callable_:
            if lo > at:
                break
            if at < hi and (best is None or hi - lo <= best[0]):
                best = hi - lo, id_
        return best[1] if best else None

    bodies = {x["id"] for x in b.nodes if x["kind"] in ("function", "method")}
    made = {m.start("name"): m["name"] for m in re.finditer(spec.made, code)} if spec.made else {}
    for at, name in made.items():
        b.ref(owner(at), name.rsplit(".", 1)[-1], "instantiates", line_of(at), at - starts[line_of(at) - 1])
    for m in re.finditer(spec.call, code, re.M):
        name = m["name"] or (m.groupdict().get("plain") or "")
        at = m.start()
        name = ".".join(name.split()) if b.language == "objc" else name
        name = re.sub(r"^(?:self|this|super|\$this|\$self|parent|static)(?:\.|->|::)", "", name).replace("?.", ".").replace("->", ".").lstrip(".$")
        if not name or name in _NOT_CALLS or at in heads or m.start("name") in made or m["name"] and m.end("name") - len(re.split(r"[.:>]", name)[-1]) in heads or any(lo <= at < hi for lo, hi in class_heads):
            continue
        own = owner(at)
        if b.language in ("c", "cpp", "objc") and own not in bodies:  # a declaration
            continue
        b.ref(own, name, "calls", line_of(at), at - starts[line_of(at) - 1])
    if b.language == "go":
        for m in ROUTE.finditer(plain):
            line, verb = line_of(m.start()), m["verb"].upper() if m["verb"].upper() in ("GET", "POST", "PUT", "DELETE", "PATCH") else "ANY"
            id_ = f"route:{b.path}:{line}:{verb}:{m['path']}"
            if b._put(id_, "route", f"{verb} {m['path']}", f"{verb} {m['path']}", line, line):
                b.edge(b.file, id_, "contains")


def _base_names(text: str) -> list[str]:
    text = re.sub(r"\([^()]*\)|<[^<>]*>(?=\s*[,{(]|\s*$)", "", text) if "<:" not in text else text
    words = re.findall(r"[A-Za-z_][\w.:\\]*", re.sub(r"\b(?:extends|implements|with|public|private|protected|virtual|where\b.*)", " ", text.replace("<:", " ")))
    return list(dict.fromkeys(re.split(r"[.:\\]+", w)[-1] for w in words if w.strip(":"))) if re.search(r"extends|implements|with|:|<", text) or text.strip().isidentifier() else []


def _exported(language: str, name: str, head: str) -> bool:
    if language == "go":
        return name[:1].isupper()
    if language in ("typescript", "javascript", "tsx", "jsx"):
        return "export" in head.split()
    return not re.search(r"\b(?:private|internal|fileprivate|defp|local|static)\b", head) and not name.startswith("_")


def _doc(text: str, starts: list[int], line: int, spec: Spec) -> str | None:
    """The comment that ends on the line above."""
    if line < 2:
        return None
    above = text[: starts[line - 1] - 1]
    m = re.search(rf"(?:(?:^|\n)[ \t]*(?:{spec.comment}))+[ \t]*$", above[-4000:], re.S | re.M)
    if not m:
        return None
    return re.sub(r"^[ \t]*(?:///?!?|#+|--+|%+|/\*+|\*+/|\*|\(\*|\{-|=begin)[ \t]?|[ \t]*\*+/$", "", m[0].strip("\n"), flags=re.M).strip() or None


# -- SQL, databases, manifests, artifacts ---------------------------------------------------------------------------

_IDENT = r"(?:[\"`\[]?[A-Za-z_]\w*[\"`\]]?\.)?[\"`\[]?[A-Za-z_]\w*[\"`\]]?"


def _sql_refs(b: Bundle, source: str | None, text: str, offset: int, line_of: Callable[[int], int]) -> None:
    alias = r"(?:\s+(?:AS\s+)?(?!(?:JOIN|LEFT|RIGHT|INNER|OUTER|FULL|CROSS|NATURAL|WHERE|ON|USING|GROUP|ORDER|HAVING|SET|VALUES|LIMIT|UNION|SELECT)\b)\w+)?"
    for m in re.finditer(rf"\b(?:FROM|JOIN|INTO|UPDATE)\s+({_IDENT}{alias}(?:\s*,\s*{_IDENT}{alias})*)", text, re.I):
        for part in m[1].split(",") if m[0][:4].upper() == "FROM" else [m[1]]:
            name = re.sub(r"[\"`\[\]]", "", part.split()[0]).rsplit(".", 1)[-1]
            if name.upper() not in ("SELECT", "SET", "VALUES", "LATERAL", "ONLY"):
                b.ref(source, name, "references", line_of(offset + m.start()))


def sql(b: Bundle) -> None:
    code = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'", _blank, b.text, flags=re.S)
    starts = [0, *(m.end() for m in re.finditer("\n", b.text))]
    line_of = lambda i: bisect_right(starts, i)
    at = 0
    for statement in re.split(r"(?<=;)", code):
        begin = at + len(statement) - len(statement.lstrip())
        m = re.match(rf"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+|MATERIALIZED\s+)?(TABLE|VIEW|FUNCTION|PROCEDURE)\s+(?:IF\s+NOT\s+EXISTS\s+)?({_IDENT})", statement, re.I)
        source = None
        if m:
            full = re.sub(r"[\"`\[\]]", "", m[2])
            name, line, end = full.rsplit(".", 1)[-1], line_of(begin), line_of(at + len(statement.rstrip()) - 1)
            kind = "struct" if m[1].upper() in ("TABLE", "VIEW") else "function"
            id_ = b.node(kind, name, line, end, tuple(full.split(".")[:-1]))
            source = id_ if m[1].upper() == "VIEW" else None
            if m[1].upper() == "TABLE" and "(" in statement:
                open_ = statement.index("(")
                depth, start = 0, open_ + 1
                for i in range(open_, len(statement)):
                    c = statement[i]
                    depth += (c == "(") - (c == ")")
                    if depth == 1 and c == "," or depth == 0:
                        column = statement[start:i]
                        w = re.match(r"\s*[\"`\[]?(\w+)[\"`\]]?\s+([A-Za-z]\w*(?:\s*\([^)]*\))?)", column)
                        if w and w[1].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "KEY", "INDEX", "EXCLUDE"):
                            where = at + start + len(column) - len(column.lstrip())
                            b.node("field", w[1], line_of(where), within=(*full.split("."),), parent=id_, signature=w[2])
                        start = i + 1
                    if depth == 0:
                        break
                for r in re.finditer(rf"\bREFERENCES\s+({_IDENT})", statement, re.I):
                    b.ref(id_, re.sub(r"[\"`\[\]]", "", r[1]).rsplit(".", 1)[-1], "references", line_of(at + r.start()))
        _sql_refs(b, source, statement, at, line_of)
        at += len(statement)


def sqlite(b: Bundle, raw: bytes) -> None:
    """The catalog of a database: tables, views, columns, keys, indexes and triggers."""
    from loomgraph.functions.text import balanced

    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(raw)
        rows = con.execute("SELECT type, name, tbl_name, sql FROM sqlite_master WHERE name NOT LIKE 'sqlite_%' ORDER BY type = 'view', type = 'trigger', type = 'index', name").fetchall()
        virtual = {n for t, n, _, s in rows if s and re.match(r"\s*CREATE\s+VIRTUAL", s, re.I)}
        tables: dict[str, str] = {}
        q = lambda name: '"' + name.replace('"', '""') + '"'
        for type_, name, table, text in rows:
            if type_ in ("table", "view"):
                if any(name.startswith(f"{v}_") for v in virtual if name != v):
                    continue
                words = (text or "").upper()
                meta = {"objectType": "virtual table" if name in virtual else type_, "withoutRowid": str("WITHOUT ROWID" in words).lower(), "strict": str(bool(re.search(r"\)\s*STRICT", words))).lower()}
                if type_ == "table" and name not in virtual:
                    meta["rowCount"] = str(con.execute(f"SELECT count(*) FROM {q(name)}").fetchone()[0])
                id_ = tables[name] = b.node("struct", name, 1, metadata=meta, signature=shortened(text or ""))
                keys = []
                for cid, column, declared, notnull, default, pk, hidden in con.execute(f"PRAGMA table_xinfo({q(name)})"):
                    if hidden == 1:
                        continue
                    keys += [(pk, column)] if pk else []
                    more = {"notNull": str(bool(notnull)).lower(), "pkPosition": str(pk)} | ({"default": str(default)} if default is not None else {})
                    b.node("field", f"{name}.{column}", cid + 1, within=(), parent=id_, signature=declared, metadata=more)
                if keys:
                    b.node("constraint", f"{name}.pk", 1, parent=id_, metadata={"columns": ",".join(c for _, c in sorted(keys))})
                groups: dict[int, list] = {}
                for k, _, other, own, theirs, *_ in con.execute(f"PRAGMA foreign_key_list({q(name)})"):
                    groups.setdefault(k, []).append((other, own, theirs))
                for parts in groups.values():
                    c = b.node("constraint", f"{name}.fk_{'_'.join(p[1] for p in parts)}", 1, parent=id_)
                    b.ref(c, parts[0][0], "references", 1)
                    for other, _, theirs in parts:
                        b.ref(c, f"{other}.{theirs}" if theirs else other, "references", 1)
                for _, index, unique, origin, _ in con.execute(f"PRAGMA index_list({q(name)})"):
                    columns = [c for _, _, c in con.execute(f"PRAGMA index_info({q(index)})") if c]
                    if origin == "u":
                        b.node("constraint", f"{name}.unique_{'_'.join(columns)}", 1, parent=id_)
                    elif origin == "c":
                        i = b.node("index", index, 1, parent=id_, metadata={"unique": str(bool(unique)).lower()})
                        for c in columns:
                            b.ref(i, f"{name}.{c}", "references", 1)
                for n, m in enumerate(re.finditer(r"\bCHECK\s*\(", text or "", re.I), 1):
                    b.node("constraint", f"{name}.check_{n}", 1, parent=id_, signature=balanced(text, m.start()))
                if type_ == "view":
                    _sql_refs(b, id_, text or "", 0, lambda _: 1)
            elif type_ == "trigger":
                m = re.search(r"\b(BEFORE|AFTER|INSTEAD\s+OF)?\s*(INSERT|UPDATE|DELETE)\b", text or "", re.I)
                b.node("trigger", name, 1, parent=tables.get(table), metadata={"timing": (m[1] or "BEFORE").upper(), "event": m[2].upper()} if m else None)
    except sqlite3.DatabaseError as e:
        b.errors.append(f"database: {e}")
    finally:
        con.close()


def go_mod(b: Bundle) -> None:
    """The module, and edges to what it requires, replaces and excludes."""
    module, block = None, ""
    for n, line in enumerate(b.text.split("\n"), 1):
        text, _, note = line.partition("//")
        text = text.strip()
        if m := re.match(r"module\s+(\S+)", text):
            module = b.node("module", m[1].strip('"'), n)
        elif m := re.match(r"(require|replace|exclude|retract)\s*\($", text):
            block = m[1]
        elif text == ")":
            block = ""
        elif text and module and (block or re.match(r"(require|replace|exclude)\s", text)):
            verb, rest = (block, text) if block else text.split(None, 1)
            words = rest.replace("=>", " ").split()
            if verb == "retract":
                continue
            other = b.node("module", words[0], n)
            meta = {"version": words[1]} if len(words) > 1 and "=>" not in rest else {"to": " ".join(rest.split("=>")[1].split())} if "=>" in rest else {}
            if "indirect" in note:
                meta["indirect"] = "true"
            b.edge(module, other, verb + "s", n, meta, "modfile")


def package_json(b: Bundle) -> None:
    try:
        top = json.loads(b.text)
        own = b.node("module", str(top.get("name") or b.path), 1, metadata={"version": str(top["version"])} if top.get("version") else None)
        lines = b.text.split("\n")
        for key, category in (("dependencies", "prod"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
            for name, version in sorted((top.get(key) or {}).items()):
                line = next((i for i, x in enumerate(lines, 1) if f'"{name}"' in x), 1)
                other = b.node("module", name, line)
                b.edge(own, other, "requires", line, {"version": str(version), "category": category}, "package.json")
    except (ValueError, AttributeError) as e:
        b.errors.append(f"json: {e}")


def artifact(b: Bundle) -> None:
    """A specification in Markdown: features, ideas and plans with their tasks and requirements."""
    lines = b.text.split("\n")
    head = re.match(r"---\n(.*?)\n---", b.text, re.S)
    kind = next((k for k in ("feature", "idea", "plan") if head and re.search(rf"\b{k}-spec", head[1])), None)
    if not kind:
        return
    top = b.path.rsplit("/", 1)
    slug = top[0].rsplit("/", 1)[-1] if top[-1].lower() == "readme.md" and len(top) > 1 else top[-1].rsplit(".", 1)[0]
    title = next((x for x in lines if x.startswith("# ")), "# ")
    own = b.node(kind, slug, 1, len(lines), signature=title[2:])
    current = own
    for n, line in enumerate(lines, 1):
        if m := re.match(r"#{2,4}\s+(?:Task\s+(\d+)|REQ(?:uirement)?:?\s*([\w-]+))\b:?\s*(.*)", line, re.I):
            current = b.node("task" if m[1] else "requirement", m[1] and f"task-{m[1]}" or m[2], n, within=(slug,), parent=own, signature=m[3] or None)
        elif m := re.match(r"\*\*([\w-]+):\*\*\s*(.+)", line):
            how = {"source": "references", "promotes-to": "promotes_to", "supersedes": "supersedes", "depends-on": "depends_on", "verifies": "references", "implements": "references"}.get(m[1].lower())
            for word in re.findall(r"[\w:/#.-]*\w[\w:/#.-]*", m[2]) if how else ():
                b.ref(current, f"task-{word}" if word.isdigit() else re.sub(r"^(?:idea|feature|plan):", "", word).split("#")[0], how, n)
        for m in re.finditer(r"\]\(([^)#\s]+\.md|[^)#\s]+/)[^)]*\)", line):
            b.ref(current, m[1], "references", n)


SPECIAL: dict[str, Callable] = {"python": python, "sql": sql, "go.mod": go_mod, "package.json": package_json, "artifact": artifact, "markdown": artifact}


def extract_one(path: str, language: str, raw: bytes) -> Bundle:
    text = "" if language == "sqlite" else raw.decode("utf-8", "replace").replace("\r\n", "\n")
    if language == "c" and path.endswith(".h"):
        language = "objc" if re.search(r"@(?:interface|protocol)\b|#import\b", text) else "cpp" if re.search(r"^\s*(?:class|namespace|template)\b|std::", text, re.M) else "c"
    b = Bundle(path, language, text)
    if language == "sqlite":
        sqlite(b, raw)
    elif language in SPECIAL:
        SPECIAL[language](b)
    elif language in SPECS and b.text:
        by_pattern(b)
    return b


def extract(files: DataFrame, max_bytes: int = MAX_FILE) -> DataFrame:
    """A row for each of ``files`` (path, language, content as bytes): path, language, nodes, edges, refs, errors.  Known languages above the size limit
    give their file node and an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = raw or b""
                if len(raw) > max_bytes and (language in SPECS or language in SPECIAL):
                    b = Bundle(path, language, "")
                    b.errors.append(f"larger than {max_bytes} bytes")
                else:
                    b = extract_one(path, language, raw)
                rows.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.path for b in rows], _S), pa.array([b.language for b in rows], _S), pa.array([b.nodes for b in rows], pa.list_(_NODE)), pa.array([b.edges for b in rows], pa.list_(_EDGE)), pa.array([b.refs for b in rows], pa.list_(_REF)), pa.array([b.errors for b in rows], pa.list_(_S))],
                names=["path", "language", "nodes", "edges", "refs", "errors"],
            )

    return files.select("path", "language", F.col("content").cast("binary")).mapInArrow(run, BUNDLE)


def tables(bundles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, edges, references and files of bundles."""
    nodes = bundles.select(F.inline("nodes"))
    edges = bundles.select(F.inline("edges"))
    refs = bundles.select("path", "language", F.explode("refs").alias("r")).select("r.*", F.col("path").alias("file_path"), "language")
    files = bundles.select("path", "language", F.size("nodes").alias("node_count"), "errors")
    return nodes, edges, refs, files


def error_counts(bundles: DataFrame) -> DataFrame:
    """Errors by what stands before their colon."""
    return bundles.select(F.explode("errors").alias("e")).groupBy(F.substring_index("e", ":", 1).alias("code")).agg(F.count("*").alias("n"))
