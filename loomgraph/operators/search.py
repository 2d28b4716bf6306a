"""Ranked search over symbols: query language, words by BM25, substrings, spelling, bonuses.

Nodes need id, kind, name, qualified_name, docstring, signature, file_path, language and start_line; ties that the
ranking leaves go to the id.  Terms and phrases are few and known on the driver, so every step is built-in expressions over
the nodes; ids of candidates are the only rows that are joined."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.paths import is_generated
from loomgraph.functions.text import BASE_NAMES, KIND_BONUS, LANGUAGES, kind_bonus, name_bonus, path_bonus, tokens
from loomgraph.operators.lineage import cut_lineage

K1, B = 1.2, 0.75
FIELDS = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
KINDS = {*KIND_BONUS, "file", "parameter", "decorator", "table", "column", "index", "trigger", "constraint", "feature", "idea", "plan", "task", "requirement"}
KNOWN_LANGUAGES = {*LANGUAGES.values(), *BASE_NAMES.values(), "node", "unknown", "markdown", "html", "css", "shell", "dockerfile", "terraform", "protobuf", "graphql", "artifact"}


class Query(NamedTuple):
    text: str = ""
    kinds: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


def parse(raw: str) -> Query:
    """``kind:``, ``lang:`` or ``language:``, ``path:`` and ``name:`` filters, values perhaps in double quotes; everything else, and
    filters with an empty or unknown value, is text."""
    found: dict[str, list[str]] = {"text": [], "kinds": [], "languages": [], "paths": [], "names": []}
    for token in re.findall(r'(?:"[^"]*(?:"|$)|[^\s"])+', raw):
        key, colon, value = token.partition(":")
        if len(value) >= 2 and value[0] == value[-1] == '"':
            value = value[1:-1]
        key = key.lower()
        if colon and value and key == "kind" and value in KINDS:
            found["kinds"].append(value)
        elif colon and value and key in ("lang", "language") and value.lower() in KNOWN_LANGUAGES:
            found["languages"].append(value.lower())
        elif colon and value and key in ("path", "name"):
            found[key + "s"].append(value)
        else:
            found["text"].append(token)
    return Query(" ".join(found.pop("text")).strip(), **{k: tuple(v) for k, v in found.items()})


def phrases(text: str) -> list[list[str]]:
    """A phrase per term: its words in a row, of which the last is a prefix."""
    terms = re.sub(r"['\"*():^]", "", text.replace("::", " ")).split()
    split = (re.findall(r"[^\W_]+", t.lower()) for t in terms if t.upper() not in ("AND", "OR", "NOT", "NEAR"))
    return [p for p in split if p]


def _count(words: Column, phrase: list[str]) -> Column:
    """Times a phrase stands in an array of words."""
    last = phrase[-1]
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w.startswith(last)))
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1)))
    here = lambda i: reduce(lambda a, b: a & b, (F.try_element_at(words, (i + k).cast("int")) == w for k, w in enumerate(phrase[:-1])), F.try_element_at(words, (i + len(phrase) - 1).cast("int")).startswith(last))
    return F.size(F.filter(at, here))


def bm25(docs: DataFrame, id_col: str, fields: dict[str, float], terms: list[str] | list[list[str]]) -> DataFrame:
    """id and score of the documents with any of the phrases; words of all fields, weighted 0 or not, count for the length
    and for how many documents have a phrase.  Texts are read once: what is kept of each is its length and counts."""
    terms = [[t] if isinstance(t, str) else t for t in terms]
    words = docs.select(F.col(id_col), *(tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"w_{f}") for f in fields))
    size = reduce(lambda a, b: a + b, (F.size(f"w_{f}") for f in fields))
    found = []
    for i, phrase in enumerate(terms):
        counts = {f: _count(F.col(f"w_{f}"), phrase) for f in fields}
        found.append(F.struct(sum((counts[f] * F.lit(w) for f, w in fields.items() if w), F.lit(0.0)).alias("f"), (reduce(lambda a, b: a + b, counts.values()) > 0).alias("s")).alias(f"p{i}"))
    rows = cut_lineage(words.select(id_col, size.alias("size"), *found))
    corpus = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(f"p{i}.s").alias(f"d{i}") for i in range(len(terms))))
    hits = rows.filter(reduce(lambda a, b: a | b, (F.col(f"p{i}.s") for i in range(len(terms))))).crossJoin(F.broadcast(corpus))
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        f = F.col(f"p{i}.f")
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return hits.select(id_col, score.alias("score"))


def filtered(nodes: DataFrame, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """Any of the kinds, and any of the languages."""
    out = nodes.filter(F.col("kind").isin(*kinds)) if kinds else nodes
    return out.filter(F.col("language").isin(*languages)) if languages else out


def hard_filtered(hits: DataFrame, paths: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> DataFrame:
    """Any of the parts of the path, and any of those of the name, whatever their case."""
    for column, parts in (("file_path", paths), ("name", names)):
        if parts:
            hits = hits.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(column), F.lit(p.lower())) for p in parts)))
    return hits


def like(nodes: DataFrame, query: str) -> DataFrame:
    """1.0 for the name as it is, 0.9 for its start, 0.8 inside, 0.7 in the qualified name; ``%`` and ``_`` are wild, case doesn't matter."""
    name, qualified = F.col("name"), F.col("qualified_name")
    score = F.when(name == query, 1.0).when(name.ilike(f"{query}%"), 0.9).when(name.ilike(f"%{query}%"), 0.8).when(qualified.ilike(f"%{query}%"), 0.7)
    return nodes.withColumn("score", score).filter("score is not null")


def fuzzy(nodes: DataFrame, query: str, limit: int = 20, per_name: int = 5) -> DataFrame:
    """Distinct names within distance 2, or 1 for up to 4 bytes, nearest first; the names are cut at twice the limit, 50 at least."""
    low = query.lower()
    bound = 1 if len(low.encode()) <= 4 else 2
    names = nodes.select("name").distinct().withColumn("d", F.levenshtein(F.lower("name"), F.lit(low), bound)).filter("d >= 0")
    names = names.orderBy("d", "name").limit(max(2 * limit, 50))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    found = nodes.join(F.broadcast(names), "name").withColumn("r", rank).filter(F.col("r") <= per_name)
    return found.orderBy("d", "name", "id").limit(limit).withColumn("score", 1 / (1 + F.col("d"))).select(*nodes.columns, "score")


def exact_names(nodes: DataFrame, raw: str, per_term: int = 20) -> DataFrame:
    """Nodes whose name is one of the words of two bytes or more, at most ``per_term`` of each."""
    words = sorted({w.lower() for w in raw.split() if len(w.encode()) >= 2})
    rank = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))
    return nodes.filter(F.lower("name").isin(*words)).withColumn("r", rank).filter(F.col("r") <= per_term).drop("r") if words else nodes.limit(0)


def supplemented(nodes: DataFrame, hits: DataFrame, raw: str) -> DataFrame:
    """Hits, and exact names that they lack at the greatest score among them."""
    best = hits.agg(F.max("score").alias("score"))
    more = exact_names(nodes, raw).join(hits.select("id"), "id", "left_anti").crossJoin(F.broadcast(best)).filter("score is not null")
    return hits.unionByName(more.select(*hits.columns))


def rescored(hits: DataFrame, query: str, limit: int, project: set[str] | frozenset[str] = frozenset()) -> DataFrame:
    """Score plus the bonuses for kind, path and name, in this order; best first."""
    score = F.col("score") + kind_bonus(F.col("kind")) + path_bonus(F.col("file_path"), query, project) + name_bonus(F.col("name"), query)
    return hits.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)


def by_words(nodes: DataFrame, text: str, kinds: tuple[str, ...], languages: tuple[str, ...], limit: int, offset: int = 0) -> DataFrame:
    terms = phrases(text)
    if not terms:
        return nodes.limit(0).withColumn("score", F.lit(0.0))
    hits = filtered(nodes, kinds, languages).join(bm25(nodes, "id", FIELDS, terms), "id")
    return hits.select(*nodes.columns, "score").orderBy(F.desc("score"), "id").offset(offset).limit(max(5 * limit, 100))


def search(nodes: DataFrame, raw: str, limit: int = 10, offset: int = 0, kinds: tuple[str, ...] = (), languages: tuple[str, ...] = ()) -> DataFrame:
    """The whole ranking: words, else substrings (2 bytes of text or more), else spelling (3 or more); exact names; bonuses; the limit; only then
    the filters on path and name; generated files last.  ``rank`` starts at 1."""
    q = parse(raw)
    kinds, languages = (*kinds, *q.kinds), (*languages, *q.languages)
    own = filtered(nodes, kinds, languages)
    if q.text:
        hits = cut_lineage(by_words(nodes, q.text, kinds, languages, limit, offset))
        if hits.isEmpty() and len(q.text.encode()) >= 2:
            hits = cut_lineage(like(own, q.text).orderBy(F.desc("score"), F.length("name"), "id").offset(offset).limit(limit))
        if hits.isEmpty() and len(q.text.encode()) >= 3:
            hits = cut_lineage(fuzzy(own, q.text, limit))
    else:
        hits = own.withColumn("score", F.lit(1.0)).orderBy("name", "id").limit(5 * limit)
    ranked = rescored(supplemented(own, hits, raw), q.text or raw, limit)
    ranked = hard_filtered(ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), q.paths, q.names)
    last = F.row_number().over(Window.orderBy(is_generated(F.col("file_path")), "rank"))
    return ranked.withColumn("rank", last)


def colocated(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Exact names; 20 more in a file that also has a distinctive one (a name of 1 to 9 files), and 20 for each other distinct name of the file."""
    hits = nodes.filter(F.lower("name").isin(*(n.lower() for n in names))).withColumn("low", F.lower("name"))
    files = hits.groupBy("low").agg(F.countDistinct("file_path").alias("n"))
    marked = hits.join(F.broadcast(files), "low")
    own = marked.groupBy("file_path").agg(F.max(F.col("n") < 10).alias("near"), F.countDistinct("low").alias("names"))
    return marked.join(own, "file_path").select("id", "name", "file_path", (F.when(F.col("near"), 20).otherwise(0) + 20 * (F.col("names") - 1)).alias("bonus"))


def merged_terms(hits: DataFrame) -> DataFrame:
    """Hits (id, term, score) of several terms: the greatest score, and 5 more for each further term."""
    return hits.groupBy("id").agg((F.max("score") + 5 * (F.countDistinct("term") - 1)).alias("score"), F.countDistinct("term").alias("n_terms"))


def budgeted(items: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Items of each group taken in order while their sizes fit the budget: one that does not fit is skipped, not the end; the first always is taken."""
    entry = F.struct(*order, F.col(size).alias("size"), F.col("id"))
    step = lambda a, x: F.when((F.size(a["ids"]) == 0) | (a["used"] + x["size"] <= budget), F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{items.schema['id'].dataType.simpleString()}>").alias("ids"))
    rows = items.groupBy(group).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return rows.select(group, F.aggregate("all", start, step).alias("a")).select(group, F.explode("a.ids").alias("id"))
