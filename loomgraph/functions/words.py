"""Query-side word work: on the driver, as queries are short."""

from __future__ import annotations

import re

_STOP = set(
    "a affect affected all also an and are as at be been break breaks bug but by called can class code could did do does done each every failing file files "
    "fix for found from function give had happen happens has have he how i if implement implemented in into is it its just look made may me method might "
    "more my need needs no not of on only or our out over shall she should show so some such tell than that the then they this to type up used using want "
    "was we what when where which who why will with work works would you your".split()
)
_COMMON = set(
    "about add affect affected affects after again all also and any are been before being between both but call called calling can change changed changes "
    "changing check checked checks class classes code could create created creates data decide decides did does doing done during each else failed failing "
    "find flow flows for found from further get had handle handles handling has have having here how implement implementation implements incoming interface "
    "interfaces into its just layer level levels like look made make may method methods more most need needs not once only other outgoing read reads request "
    "requests response responses return returned returns run running runs same set should show silently some start starts stop stops such system take taken "
    "takes than that the them then there this through trigger triggers use used using very want wants was were what when where which who why will with "
    "without work works would write writes written".split()
)


def camel_split(text: str) -> str:
    return re.sub(r"([A-Z]+)(?=[A-Z][a-z])", r"\1 ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text))


def base_terms(word: str, separators: str = "_.", least: int = 3) -> list[str]:
    parts = re.sub(f"[{re.escape(separators)}]", " ", camel_split(word)).lower().split()
    return [p for p in parts if len(p.encode()) >= least]


def stems(term: str) -> list[str]:
    """Shorter forms of a word by its ending, sorted; of 3 letters or more."""
    t, out = term.lower(), set()

    def doubled(base: str) -> None:
        out.update((base, base + "e"))
        if len(base) > 1 and base[-1] == base[-2]:
            out.add(base[:-1])

    n = len(t)
    if t.endswith("ing") and n > 5:
        doubled(t[:-3])
    if t.endswith(("tion", "sion")) and n > 5:
        out.add(t[:-3])
    if t.endswith("ment") and n > 6:
        out.add(t[:-4])
    if n > 4:
        if t.endswith("ies"):
            out.add(t[:-3] + "y")
        elif t.endswith("es"):
            out.add(t[:-2])
        elif t.endswith("s") and not t.endswith("ss"):
            out.add(t[:-1])
        if t.endswith("ed") and not t.endswith("eed"):
            out.update((t[:-1], t[:-2]))
            if t.endswith("ied") and n > 5:
                out.add(t[:-3] + "y")
        if t.endswith("er"):
            doubled(t[:-2])
    return sorted(v for v in out if len(v) >= 3 and v != t)


def search_terms(query: str, with_stems: bool = False) -> list[str]:
    """Compound and snake-case words as a whole, then the parts of all words without stop words, then stems."""
    whole = [*re.findall(r"\b([a-zA-Z][a-zA-Z0-9]*(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+)\b", query), *re.findall(r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b", query)]
    found = [w.lower() for w in whole if len(w) >= 3]
    parts = re.split(r"[^a-zA-Z0-9]+", re.sub(r"[_.]+", " ", camel_split(query)).lower())
    found = list(dict.fromkeys(found + [p for p in parts if len(p) >= 3 and p not in _STOP]))
    if with_stems:
        found = list(dict.fromkeys(found + [s for t in found for s in stems(t) if s not in _STOP]))
    return found


def symbols(query: str) -> list[str]:
    """Words of a question that may be names: camel case, snake case, capitals, acronyms, dotted, plain."""
    found = re.findall(r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]*)+)\b", query)
    found = [w for w in found if len(w) >= 2] + re.findall(r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b", query)
    found += re.findall(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b", query) + re.findall(r"\b[A-Z]{2,}\b", query)
    for dotted in re.findall(r"\b[a-zA-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+\b", query):
        found += [dotted, *(p for p in dotted.split(".") if len(p) >= 2)]
    found += re.findall(r"\b[a-z][a-z0-9]{2,}\b", query)
    return [w for w in dict.fromkeys(found) if w.lower() not in _COMMON]


def is_distinctive(token: str) -> bool:
    return bool(re.search(r"[_0-9]", token)) or bool(re.search(r"[A-Z]", token[1:]))


def project_tokens(*names: str) -> set[str]:
    """Names of the project (of a module's last part, a package without its scope, a folder), as letters and digits only."""
    short = (re.sub(r"^@[^/]+/", "", n).rsplit("/", 1)[-1] for n in names if n)
    return {t for n in short if len(t := re.sub(r"[^a-z0-9]", "", n.lower())) >= 5}
