"""A compiler for chat templates: text to syntax tree, constants folded, tree to Python closures.

The language: ``{{ expression }}``, ``{% for x in xs if c %} … {% else %} … {% endfor %}`` with ``break`` and ``continue``,
``{% if %}``, ``{% elif %}``, ``{% else %}``, ``{% endif %}``, ``{% set x = … %}``, ``{% macro f(a) %} … {% endmacro %}``, ``{# comment #}`` and
``{% generation %} … {% endgeneration %}``, whose output is what the model is to learn.  ``-`` inside a delimiter strips white
space on that side.  Expressions: literals, lists, maps, names, ``a.b``, ``a['b']``, ``a[0]``, ``a[1:3]``, ``+ - * / // % ~``, comparisons,
``in``, ``not in``, ``and``, ``or``, ``not``, ``a if c else b``, ``is`` tests, filters, and calls of macros, of ``namespace``,
``range`` and ``raise_exception``, and of the listed methods of strings and maps.  It is sandboxed: values
are strings, numbers, booleans, none, lists and maps; lookups read maps and lists only, never attributes of Python
objects.  What is set in a loop is gone in its next iteration, except in a namespace.

Defined results: a name or key that does not exist, or null, renders as the empty text and is false; conversations
without turns render with an empty list of messages; turns are ordered by turn, role and text,
nulls first; turns with a null conv_id are one conversation; rows that repeat are rendered again.  A rendering that fails (values that
can't be compared, ``raise_exception``, more than 2 GB of text) gives no text, no spans and the reason in ``error``; the others are unaffected.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K

MAX_BYTES, FLUSH_BYTES = (1 << 31) - (1 << 16), 1 << 25
CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content }}<|im_end|>{% endgeneration %}{% else %}{{ m.content }}<|im_end|>{% endif %}\n"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


class Text(NamedTuple):
    value: str


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Op(NamedTuple):
    name: str
    args: tuple


class Filter(NamedTuple):
    name: str
    of: Any
    args: tuple
    named: tuple = ()


class Out(NamedTuple):
    value: Any


class If(NamedTuple):
    cases: tuple  # of (condition, body)
    other: tuple


class For(NamedTuple):
    names: tuple
    over: Any
    test: Any
    body: tuple
    other: tuple


class Call(NamedTuple):
    of: Any
    args: tuple
    named: tuple  # of (name, value)


class Is(NamedTuple):
    test: str
    of: Any


class Macro(NamedTuple):
    name: str
    params: tuple  # of (name, default or None)
    body: tuple


class Jump(NamedTuple):
    kind: str


class Break(Exception):
    pass


class Continue(Exception):
    pass


class Namespace(dict):
    """The one kind of map that ``set`` may change."""


class Set(NamedTuple):
    name: str
    value: Any


class Generation(NamedTuple):
    body: tuple


def text_of(x: Any) -> str:
    if x is None:
        return ""
    if x is True or x is False:
        return "true" if x else "false"
    return x if isinstance(x, str) else str(x)


def lookup(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key) if isinstance(key, (str, int, float, bool)) else None
    if isinstance(of, (list, str)) and isinstance(key, int) and not isinstance(key, bool) and -len(of) <= key < len(of):
        return of[key]
    return None


def _arith(f: Callable) -> Callable:
    def run(a: Any, b: Any) -> Any:
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            try:
                return f(a, b)
            except ZeroDivisionError:
                raise TemplateError("division by zero") from None
        raise TemplateError("numbers expected")

    return run


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) or isinstance(b, str):
        return text_of(a) + text_of(b)
    if isinstance(a, list) and isinstance(b, list):
        return a + b
    return _arith(lambda x, y: x + y)(a, b)


def _order(f: Callable) -> Callable:
    def run(a: Any, b: Any) -> bool:
        if type(a) is type(b) or isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return f(a, b)
        raise TemplateError("values can't be compared")

    return run


def _contains(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return text_of(a) in b
    return a in b if isinstance(b, (list, dict)) else False


OPS: dict[str, Callable] = {
    "+": _plus,
    "~": lambda a, b: text_of(a) + text_of(b),
    "-": _arith(lambda a, b: a - b),
    "*": _arith(lambda a, b: a * b),
    "/": _arith(lambda a, b: a / b),
    "//": _arith(lambda a, b: a // b),
    "%": _arith(lambda a, b: a % b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _order(lambda a, b: a < b),
    "<=": _order(lambda a, b: a <= b),
    ">": _order(lambda a, b: a > b),
    ">=": _order(lambda a, b: a >= b),
    "in": _contains,
    "not in": lambda a, b: not _contains(a, b),
    "not": lambda a: not a,
    "neg": lambda a: _arith(lambda x, y: x - y)(0, a),
}
FILTERS: dict[str, Callable] = {
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "default": lambda x, d: d if x is None else x,
    "join": lambda x, by="": text_of(by).join(map(text_of, x or [])),
    "replace": lambda x, a, b: text_of(x).replace(text_of(a), text_of(b)),
    "first": lambda x: lookup(x, 0),
    "last": lambda x: lookup(x, -1),
    "string": text_of,
    "tojson": lambda x, indent=None: json.dumps(x, ensure_ascii=False, indent=indent),
    "list": lambda x: list(x) if isinstance(x, (str, list, dict)) else [],
    "items": lambda x: [list(i) for i in x.items()] if isinstance(x, dict) else [],
    "reverse": lambda x: x[::-1] if isinstance(x, (str, list)) else x,
    "int": lambda x, d=0: _number(int, x, d),
    "float": lambda x, d=0.0: _number(float, x, d),
    "abs": lambda x: abs(x) if isinstance(x, (int, float)) else 0,
    "capitalize": lambda x: text_of(x).capitalize(),
    "title": lambda x: text_of(x).title(),
    "map": lambda x, attribute: [lookup(i, attribute) for i in x or []],
    "selectattr": lambda x, key, test="", value=None: [i for i in x or [] if _chosen(lookup(i, key), test, value)],
    "rejectattr": lambda x, key, test="", value=None: [i for i in x or [] if not _chosen(lookup(i, key), test, value)],
}
TESTS: dict[str, Callable] = {
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "mapping": lambda x: isinstance(x, dict),
    "iterable": lambda x: isinstance(x, (str, list, dict)),
    "sequence": lambda x: isinstance(x, (str, list)),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "true": lambda x: x is True,
    "false": lambda x: x is False,
}
METHODS: dict[type, dict[str, Callable]] = {
    str: {n: getattr(str, n) for n in ("strip", "lstrip", "rstrip", "upper", "lower", "title", "capitalize", "split", "startswith", "endswith", "replace", "find", "join")},
    dict: {"items": lambda d: [list(i) for i in d.items()], "keys": list, "values": lambda d: list(d.values()), "get": lambda d, k, other=None: d.get(k, other)},
}


def _number(kind: type, x: Any, other: Any) -> Any:
    try:
        return kind(x)
    except (TypeError, ValueError):
        return other


def _chosen(x: Any, test: str, value: Any) -> bool:
    if test in ("equalto", "==", "eq"):
        return x == value
    if test == "in":
        return _contains(x, value)
    return bool(x) if test in ("", "defined") else TESTS[test](x)


def _fail(message: Any = "") -> None:
    raise TemplateError(text_of(message))


def _range(*args: Any) -> list:
    if not 1 <= len(args) <= 3 or not all(isinstance(x, int) for x in args) or len(r := range(*args)) > 100_000:
        raise TemplateError("bad range")
    return list(r)


FUNCTIONS: dict[str, Callable] = {"namespace": lambda **named: Namespace(named), "raise_exception": _fail, "range": _range, "dict": lambda **named: named}

_INSIDE = r"""(-?)((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?)(-?)"""
_TAG = re.compile(r"\{\{" + _INSIDE + r"\}\}|\{%" + _INSIDE + r"%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>|.,()\[\]{}:=]))", re.S)
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Parser:
    """Recursive descent over the tags of a template."""

    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at, strip = 0, False
        for m in _TAG.finditer(source):
            text = source[at : m.start()]
            text = text.lstrip() if strip else text
            before, strip = (next((i for i in (m[k] for k in (1, 4, 7)) if i), ""), bool(m[3] or m[6] or m[8]))
            if text := text.rstrip() if before else text:
                self.parts.append(("text", text))
            if m[2] is not None:
                self.parts.append(("out", m[2]))
            elif m[5] is not None:
                self.parts.append(("tag", m[5].strip()))
            at = m.end()
        if rest := source[at:].lstrip() if strip else source[at:]:
            self.parts.append(("text", rest))
        self.at = 0

    def parse(self) -> tuple:
        body, end = self.block(())
        return body

    def block(self, ends: tuple[str, ...]) -> tuple[tuple, str]:
        body: list = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                body.append(Text(value))
            elif kind == "out":
                body.append(Out(expression(value)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(body), value
                body.append(self.tag(word, rest.strip()))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(body), ""

    def tag(self, word: str, rest: str) -> Any:
        if word == "if":
            cases, test = [], expression(rest)
            while True:
                body, end = self.block(("elif", "else", "endif"))
                cases.append((test, body))
                if end.startswith("elif"):
                    test = expression(end[4:])
                    continue
                other = self.block(("endif",))[0] if end == "else" else ()
                return If(tuple(cases), other)
        if word == "for":
            t, at = tokens(rest), 0
            names = []
            while at < len(t) and t[at][0] == "name" and (not names or _is(t, at - 1, ",")):
                names.append(t[at][1])
                at += 2 if _is(t, at + 1, ",") else 1
            at = _expect(t, at, "in")
            if not names:
                raise TemplateError(f"bad for: {rest}")
            over, at = _logic(t, at, ("or", "and"))
            test = None
            if _is(t, at, "if"):
                test, at = _choice(t, at + 1)
            if at != len(t):
                raise TemplateError(f"bad for: {rest}")
            body, end = self.block(("else", "endfor"))
            other = self.block(("endfor",))[0] if end == "else" else ()
            return For(tuple(names), over, test, body, other)
        if word == "set":
            name, equals, value = rest.partition("=")
            if not equals or not all(x.isidentifier() for x in name.strip().split(".", 1)):
                raise TemplateError(f"bad set: {rest}")
            return Set(name.strip(), expression(value))
        if word == "macro":
            t = tokens(rest)
            if not t or t[0][0] != "name":
                raise TemplateError(f"bad macro: {rest}")
            plain, named, at = _arguments(t, _expect(t, 1, "("))
            if at != len(t) or not all(isinstance(x, Name) for x in plain):
                raise TemplateError(f"bad macro: {rest}")
            return Macro(t[0][1], tuple((x.name, None) for x in plain) + named, self.block(("endmacro",))[0])
        if word in ("break", "continue"):
            return Jump(word)
        if word == "generation":
            return Generation(self.block(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word}")


def tokens(source: str) -> list[tuple[str, Any]]:
    out: list[tuple[str, Any]] = []
    at = 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"bad expression: {source}")
        at = m.end()
        if m[1]:
            out.append(("const", float(m[1]) if "." in m[1] else int(m[1])))
        elif m[2]:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[2][1:-1], flags=re.S)))
        elif m[3]:
            out.append(("word" if m[3] in _WORDS else "name", m[3]))
        else:
            out.append(("op", m[4]))
    return out


def expression(source: str) -> Any:
    t = tokens(source)
    tree, at = _choice(t, 0)
    if at != len(t):
        raise TemplateError(f"bad expression: {source}")
    return tree


def _is(tokens: list, at: int, *values: str) -> bool:
    return at < len(tokens) and tokens[at][0] in ("op", "word") and tokens[at][1] in values


def _choice(t: list, at: int) -> tuple[Any, int]:
    value, at = _logic(t, at, ("or", "and"))
    if _is(t, at, "if"):
        test, at = _logic(t, at + 1, ("or", "and"))
        other: Any = Const(None)
        if _is(t, at, "else"):
            other, at = _choice(t, at + 1)
        value = Op("if", (test, value, other))
    return value, at


def _logic(t: list, at: int, words: tuple[str, ...]) -> tuple[Any, int]:
    if not words:
        if _is(t, at, "not"):
            value, at = _logic(t, at + 1, ())
            return Op("not", (value,)), at
        return _compare(t, at)
    value, at = _logic(t, at, words[1:])
    while _is(t, at, words[0]):
        right, at = _logic(t, at + 1, words[1:])
        value = Op(words[0], (value, right))
    return value, at


_LEVELS = (("~",), ("+", "-"), ("*", "/", "//", "%"))


def _compare(t: list, at: int) -> tuple[Any, int]:
    value, at = _binary(t, at, _LEVELS)
    while True:
        if _is(t, at, "not") and _is(t, at + 1, "in"):
            name, at = "not in", at + 2
        elif _is(t, at, "==", "!=", "<", "<=", ">", ">=", "in"):
            name, at = t[at][1], at + 1
        elif _is(t, at, "is"):
            no = _is(t, at + 1, "not")
            at += 2 if no else 1
            test = str(t[at][1]).lower() if at < len(t) else ""
            if test not in TESTS and test not in ("defined", "undefined"):
                raise TemplateError(f"unknown test {test}")
            value, at = Is(test, value), at + 1
            value = Op("not", (value,)) if no else value
            continue
        else:
            return value, at
        right, at = _binary(t, at, _LEVELS)
        value = Op(name, (value, right))


def _binary(t: list, at: int, levels: tuple) -> tuple[Any, int]:
    if not levels:
        return _unary(t, at)
    value, at = _binary(t, at, levels[1:])
    while _is(t, at, *levels[0]):
        name = t[at][1]
        right, at = _binary(t, at + 1, levels[1:])
        value = Op(name, (value, right))
    return value, at


def _unary(t: list, at: int) -> tuple[Any, int]:
    if _is(t, at, "-"):
        value, at = _unary(t, at + 1)
        return Op("neg", (value,)), at
    value, at = _atom(t, at)
    while at < len(t):
        if _is(t, at, ".") and at + 1 < len(t) and t[at + 1][0] in ("name", "word"):
            value, at = Item(value, Const(t[at + 1][1])), at + 2
        elif _is(t, at, "["):
            parts: list = []
            at += 1
            while True:
                key: Any = None
                if not _is(t, at, ":", "]"):
                    key, at = _choice(t, at)
                parts.append(key)
                if not _is(t, at, ":"):
                    break
                at += 1
            at = _expect(t, at, "]")
            if parts == [None] or len(parts) > 3:
                raise TemplateError("bad index")
            value = Item(value, parts[0]) if len(parts) == 1 else Op("slice", (value, *(Const(None) if x is None else x for x in parts)))
        elif _is(t, at, "("):
            args, named, at = _arguments(t, at + 1)
            value = Call(value, args, named)
        elif _is(t, at, "|"):
            if at + 1 >= len(t) or t[at + 1][1] not in FILTERS:
                raise TemplateError("unknown filter")
            name, at, args, named = t[at + 1][1], at + 2, (), ()
            if _is(t, at, "("):
                args, named, at = _arguments(t, at + 1)
            value = Filter(name, value, args, named)
        else:
            break
    return value, at


def _atom(t: list, at: int) -> tuple[Any, int]:
    if at >= len(t):
        raise TemplateError("expression ends too early")
    kind, value = t[at]
    if kind == "const":
        return Const(value), at + 1
    if kind == "name":
        return Name(value), at + 1
    if kind == "word" and value.lower() in ("true", "false", "none"):
        return Const({"true": True, "false": False, "none": None}[value.lower()]), at + 1
    if (kind, value) == ("op", "("):
        value, at = _choice(t, at + 1)
        return value, _expect(t, at, ")")
    if (kind, value) == ("op", "["):
        items, at = _list(t, at + 1, "]")
        return Op("list", tuple(items)), at
    if (kind, value) == ("op", "{"):
        pairs, at = [], at + 1
        while not _is(t, at, "}"):
            key, at = _choice(t, at)
            item, at = _choice(t, _expect(t, at, ":"))
            pairs += [key, item]
            if not _is(t, at, "}"):
                at = _expect(t, at, ",")
        return Op("map", tuple(pairs)), at + 1
    raise TemplateError(f"unexpected {value}")


def _list(t: list, at: int, end: str) -> tuple[list, int]:
    out: list = []
    while not _is(t, at, end):
        value, at = _choice(t, at)
        out.append(value)
        if not _is(t, at, end):
            at = _expect(t, at, ",")
    return out, at + 1


def _arguments(t: list, at: int) -> tuple[tuple, tuple, int]:
    plain, named = [], []
    while not _is(t, at, ")"):
        if at + 1 < len(t) and t[at][0] == "name" and _is(t, at + 1, "="):
            name = t[at][1]
            value, at = _choice(t, at + 2)
            named.append((name, value))
        else:
            value, at = _choice(t, at)
            plain.append(value)
        if not _is(t, at, ")"):
            at = _expect(t, at, ",")
    return tuple(plain), tuple(named), at + 1


def _expect(t: list, at: int, what: str) -> int:
    if not _is(t, at, what):
        raise TemplateError(f"{what} expected")
    return at + 1


def fold(node: Any) -> Any:
    """The tree with constant parts computed; a part that fails is left for the rendering to report."""
    if isinstance(node, (Op, Filter, Item)):
        if isinstance(node, Op):
            node = Op(node.name, tuple(map(fold, node.args)))
            args = node.args
            if node.name == "if" and isinstance(args[0], Const):
                return args[1] if args[0].value else args[2]
            if node.name in ("and", "or") and isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        elif isinstance(node, Filter):
            node = Filter(node.name, fold(node.of), tuple(map(fold, node.args)), tuple((n, fold(v)) for n, v in node.named))
            args = (node.of, *node.args, *(v for _, v in node.named))
        else:
            node = Item(fold(node.of), fold(node.key))
            args = tuple(node)
        if all(isinstance(x, Const) for x in args):
            try:
                return Const(_expr(node)({}))
            except (TemplateError, TypeError):
                return node
        return node
    if isinstance(node, Call):
        return Call(Item(fold(node.of.of), node.of.key) if isinstance(node.of, Item) else node.of, tuple(map(fold, node.args)), tuple((n, fold(v)) for n, v in node.named))
    return node


def fold_block(body: tuple) -> tuple:
    out: list = []
    for node in body:
        if isinstance(node, Out):
            value = fold(node.value)
            node = Text(text_of(value.value)) if isinstance(value, Const) else Out(value)
        elif isinstance(node, Set):
            node = Set(node.name, fold(node.value))
        elif isinstance(node, Generation):
            node = Generation(fold_block(node.body))
        elif isinstance(node, For):
            node = For(node.names, fold(node.over), node.test and fold(node.test), fold_block(node.body), fold_block(node.other))
        elif isinstance(node, Macro):
            node = Macro(node.name, tuple((n, v and fold(v)) for n, v in node.params), fold_block(node.body))
        elif isinstance(node, If):
            cases, other = [], fold_block(node.other)
            for test, own in node.cases:
                test = fold(test)
                if isinstance(test, Const):
                    if test.value:
                        other = fold_block(own)
                        break
                    continue
                cases.append((test, fold_block(own)))
            if not cases:
                out.extend(other)
                continue
            node = If(tuple(cases), other)
        out.append(node)
    merged: list = []
    for node in out:
        if isinstance(node, Text) and merged and isinstance(merged[-1], Text):
            merged[-1] = Text(merged[-1].value + node.value)
        elif not (isinstance(node, Text) and not node.value):
            merged.append(node)
    return tuple(merged)


def _expr(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = _expr(node.of), _expr(node.key)
        return lambda env: lookup(of(env), key(env))
    if isinstance(node, Is):
        if node.test in ("defined", "undefined"):
            there = _defined(node.of)
            return there if node.test == "defined" else lambda env: not there(env)
        of, test = _expr(node.of), TESTS[node.test]
        return lambda env: test(of(env))
    args = [_expr(x) for x in node.args]
    if isinstance(node, (Filter, Call)):
        named = [(n, _expr(v)) for n, v in node.named]
    if isinstance(node, Call):
        return _call(node.of, args, named)
    if isinstance(node, Filter):
        f, of = FILTERS[node.name], _expr(node.of)

        def filtered(env: dict) -> Any:
            try:
                return f(of(env), *(a(env) for a in args), **{n: v(env) for n, v in named})
            except (TypeError, ValueError, KeyError) as e:
                raise TemplateError(f"filter {node.name}: {e}") from None

        return filtered
    if node.name == "list":
        return lambda env: [a(env) for a in args]
    if node.name == "map":
        return lambda env: {text_of(k(env)): v(env) for k, v in zip(args[::2], args[1::2])}
    if node.name == "slice":
        return lambda env: _slice(*(a(env) for a in args))
    if node.name == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    f = OPS[node.name]
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    a, b = args
    return lambda env: f(a(env), b(env))


def _slice(of: Any, *parts: Any) -> Any:
    if not isinstance(of, (str, list)):
        return None
    if not all(x is None or isinstance(x, int) for x in parts) or len(parts) == 3 and parts[2] == 0:
        raise TemplateError("bad slice")
    return of[slice(*parts)]


def _defined(node: Any) -> Callable[[dict], bool]:
    if isinstance(node, Name):
        return lambda env, n=node.name: n in env or n in FUNCTIONS
    if isinstance(node, Item):
        of, key = _expr(node.of), _expr(node.key)
        return lambda env: key(env) in x if isinstance(x := of(env), dict) else lookup(x, key(env)) is not None
    return lambda env: True


def _call(of: Any, args: list, named: list) -> Callable[[dict], Any]:
    """Of a macro or function by name, or of a listed method."""
    if isinstance(of, Name):
        find = lambda env, n=of.name: env[n] if isinstance(env.get(n), _Callable) else FUNCTIONS.get(n)
        what, first = of.name, lambda env: ()
    elif isinstance(of, Item) and isinstance(of.key, Const):
        value, what = _expr(of.of), of.key.value
        find = lambda env: next((m[what] for kind, m in METHODS.items() if what in m and isinstance(value(env), kind)), None)
        first = lambda env: (value(env),)
    else:
        raise TemplateError("this can't be called")

    def run(env: dict) -> Any:
        f = find(env)
        if f is None:
            raise TemplateError(f"{what} can't be called")
        try:
            return f(*first(env), *(a(env) for a in args), **{n: v(env) for n, v in named})
        except (TypeError, ValueError) as e:
            raise e if isinstance(e, TemplateError) else TemplateError(f"{what}: {e}") from None

    return run


class _Callable:
    """A macro."""

    def __init__(self, params: list, body: Callable, env: dict):
        self.params, self.body, self.env = params, body, env

    def __call__(self, *args: Any, **named: Any) -> str:
        own = dict(self.env)
        for i, (name, default) in enumerate(self.params):
            own[name] = args[i] if i < len(args) else named[name] if name in named else default(self.env) if default else None
        out = Sink()
        self.body(own, out)
        return "".join(out.parts)


class Sink:
    """Rendered text, and the spans of it that a generation marker covers."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.size += len(text)
        self.parts.append(text)


def _block(body: tuple) -> Callable[[dict, Sink], None]:
    steps = [_step(x) for x in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Sink) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: Any) -> Callable[[dict, Sink], None]:
    if isinstance(node, Text):
        return lambda env, out, v=node.value: out.add(v)
    if isinstance(node, Out):
        value = _expr(node.value)
        return lambda env, out: out.add(text_of(value(env)))
    if isinstance(node, Set):
        value = _expr(node.value)
        name, _, field = node.name.partition(".")

        def assign(env: dict, out: Sink) -> None:
            if not field:
                env[name] = value(env)
            elif isinstance(env.get(name), Namespace):
                env[name][field] = value(env)
            else:
                raise TemplateError(f"{name} is no namespace")

        return assign
    if isinstance(node, Macro):
        params, own = [(n, v and _expr(v)) for n, v in node.params], _block(node.body)
        return lambda env, out: env.__setitem__(node.name, _Callable(params, own, env))
    if isinstance(node, Jump):
        kind = Break if node.kind == "break" else Continue

        def jump(env: dict, out: Sink) -> None:
            raise kind

        return jump
    if isinstance(node, Generation):
        body = _block(node.body)

        def generation(env: dict, out: Sink) -> None:
            start = out.size
            body(env, out)
            out.spans.append((start, out.size))

        return generation
    if isinstance(node, If):
        cases, other = [(_expr(t), _block(b)) for t, b in node.cases], _block(node.other)

        def branch(env: dict, out: Sink) -> None:
            for test, body in cases:
                if test(env):
                    return body(env, out)
            return other(env, out)

        return branch
    names, over, body, other = node.names, _expr(node.over), _block(node.body), _block(node.other)
    test = _expr(node.test) if node.test else None

    def bound(env: dict, item: Any) -> dict:
        inner = dict(env)
        if len(names) == 1:
            inner[names[0]] = item
        else:
            inner |= {n: lookup(list(item) if isinstance(item, tuple) else item, i) for i, n in enumerate(names)}
        return inner

    def loop(env: dict, out: Sink) -> None:
        items = over(env)
        items = list(items.items() if len(names) > 1 else items) if isinstance(items, dict) else items
        if test and isinstance(items, list):
            items = [x for x in items if test(bound(env, x))]
        if not isinstance(items, list) or not items:
            return other(env, out)
        n = len(items)
        for i, item in enumerate(items):
            inner = bound(env, item)
            inner["loop"] = {
                "index": i + 1, "index0": i, "revindex": n - i, "revindex0": n - i - 1, "first": i == 0, "last": i == n - 1, "length": n,
                "previtem": items[i - 1] if i else None, "nextitem": items[i + 1] if i + 1 < n else None,
            }
            try:
                body(inner, out)
            except Continue:
                continue
            except Break:
                break
        return None

    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the rendered text and the spans of its generation markers, in characters."""
    run = _block(fold_block(Parser(source).parse()))

    def render(env: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Sink()
        try:
            run(dict(env), out)
        except (Break, Continue):
            raise TemplateError("break or continue outside of a loop") from None
        except RecursionError:
            raise TemplateError("macros call each other too deeply") from None
        return "".join(out.parts), out.spans

    return render


def render_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """One row per conversation: ``conv_id``, ``rendered``, ``n_turns``, ``n_generated`` spans and
    ``generated_chars``, with ``spans`` (start and end in characters) as array, and ``error``, null if there was none."""
    compile_template(template)  # errors show at once
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ids: list = []
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            n, text, spans, error = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.string()), pa.array(spans, span), pa.array(error, pa.string())], names=["conv_id", "n_turns", "rendered", "spans", "error"])

        for batch in batches:
            for i, own in zip(K.column(batch, "conv_id"), K.column(batch, "turns")):
                messages = [{"role": t["role"], "content": t["text"], "turn": t["turn"]} for t in own.as_py()]
                try:
                    text, spans = render({"messages": messages})
                    bytes_ = len(text) if text.isascii() else len(text.encode("utf-8", "replace"))
                    if bytes_ > MAX_BYTES:
                        raise TemplateError("the rendering has more than 2 GB")
                    row = len(messages), text, [{"start": a, "end": b} for a, b in spans], None
                except TemplateError as e:
                    row, bytes_ = (len(messages), None, [], str(e)), 0
                if rows and size + bytes_ > FLUSH_BYTES:
                    yield made()
                    ids, rows, size = [], [], 0
                ids.append(i.as_py())
                rows.append(row)
                size += bytes_
        if rows:
            yield made()

    out = grouped.select("conv_id", "turns").mapInArrow(run, "conv_id long, n_turns int, rendered string, spans array<struct<start: int, end: int>>, error string")
    return out.withColumns({"n_generated": F.size("spans"), "generated_chars": F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])})
