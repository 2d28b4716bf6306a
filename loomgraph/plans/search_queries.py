"""Queries of search, names and paths over the projected symbols, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomgraph.functions import paths, words
from loomgraph.functions import text as X
from loomgraph.operators import search
from loomgraph.plans.registry import SYMBOLS_CTE, query
from loomgraph.sources import projection as P

C = F.col


def symbols(sql: str):
    return query(SYMBOLS_CTE + sql, with_graph=False)


# -- BM25 over five columns -----------------------------------------------------------------------------------------


def _count_sql(column: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({column}, lambda w: starts_with(w, '{phrase[0]}')))"
    here = " AND ".join([f"{column}[i + {k}] = '{w}'" for k, w in enumerate(phrase[:-1])] + [f"starts_with({column}[i + {len(phrase) - 1}], '{phrase[-1]}')"])
    return f"len(list_filter(range(1, greatest(len({column}) - {len(phrase)} + 2, 1)), lambda i: {here}))"


def _words_sql(text: str, where: str = "TRUE") -> str:
    """CTEs that end in ``words``: id, score."""
    terms = search.phrases(text)
    fields = list(search.FIELDS.items())
    split = ", ".join(f"regexp_extract_all(lower({f}), '[a-z0-9]+') AS w_{f}" for f, _ in fields)
    counts = ", ".join(
        " + ".join(f"{_count_sql('w_' + f, t)} * {w}" for f, w in fields) + f" AS f{i}, " + " + ".join(_count_sql("w_" + f, t) for f, _ in fields) + f" > 0 AS s{i}" for i, t in enumerate(terms)
    )
    score = " + ".join(
        f"(CASE WHEN d{i} * 2 >= n THEN 1e-6 ELSE ln((n - d{i} + 0.5) / (d{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(terms))
    )
    return f""", tok AS (SELECT id, {split} FROM symbols), r AS (SELECT id, {" + ".join(f"len(w_{f})" for f, _ in fields)} AS size, {counts} FROM tok),
c AS (SELECT count(*) AS n, avg(size) AS mean, {", ".join(f"count(*) FILTER (WHERE s{i}) AS d{i}" for i in range(len(terms)))} FROM r),
words AS (SELECT id, ({score})::DOUBLE AS score FROM r JOIN symbols USING (id), c WHERE ({" OR ".join(f"s{i}" for i in range(len(terms)))}) AND {where})"""


@symbols(_words_sql("blue_anvil get NOT lib::Gizmo") + " SELECT id, round(score, 6) AS score FROM words")
def symbol_bm25(spark, sf_dir):
    return search.bm25(P.symbols(spark, sf_dir), "id", search.FIELDS, search.phrases("blue_anvil get NOT lib::Gizmo")).select("id", F.round("score", 6).alias("score"))


# -- substrings and spelling ----------------------------------------------------------------------------------------


def _like_sql(q: str) -> str:
    return f"CASE WHEN name = '{q}' THEN 1.0 WHEN name ILIKE '{q}%' THEN 0.9 WHEN name ILIKE '%{q}%' THEN 0.8 WHEN qualified_name ILIKE '%{q}%' THEN 0.7 END::DOUBLE"


@symbols(f" SELECT * FROM (SELECT id, name, {_like_sql('an_il')} AS score FROM symbols) WHERE score IS NOT NULL")
def search_like(spark, sf_dir):
    return search.like(P.symbols(spark, sf_dir), "an_il").select("id", "name", "score")


_FUZZY = """, d AS (SELECT name, levenshtein(lower(name), '{q}') AS d FROM (SELECT DISTINCT name FROM symbols)),
m AS (SELECT * FROM d WHERE d <= {b} ORDER BY d, name LIMIT 50),
z AS (SELECT id, name, d, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM symbols JOIN m USING (name)),
spelled AS (SELECT id, name, 1.0::DOUBLE / (1 + d) AS score FROM z WHERE r <= 5 ORDER BY d, name, id LIMIT {n})"""


@symbols(_FUZZY.format(q="blueanvl", b=2, n=20) + " SELECT * FROM spelled")
def search_fuzzy(spark, sf_dir):
    return search.fuzzy(P.symbols(spark, sf_dir), "BlueAnvl").select("id", "name", "score")


@symbols(" SELECT id, name, row_number() OVER (ORDER BY name, id)::INTEGER AS rank FROM (SELECT * FROM symbols WHERE kind IN ('class', 'enum') AND language IN ('go', 'rust') ORDER BY name, id LIMIT 50)")
def search_filters_only(spark, sf_dir):
    from pyspark.sql import Window

    hits = search.filtered(P.symbols(spark, sf_dir), ("class", "enum"), ("go", "rust")).orderBy("name", "id").limit(50)
    return hits.select("id", "name", F.row_number().over(Window.orderBy("name", "id")).alias("rank"))


_SUPPLEMENT = """, named AS (SELECT id, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS r FROM symbols WHERE lower(name) IN ({names})),
hits AS (SELECT id, score FROM {base} UNION ALL SELECT id, (SELECT max(score) FROM {base}) FROM named WHERE r <= 20 AND id NOT IN (SELECT id FROM {base}) AND (SELECT count(*) FROM {base}) > 0)"""


def _supplement_sql(base: str, raw: str) -> str:
    names = ", ".join(f"'{w.lower()}'" for w in raw.split() if len(w) >= 2)
    return _SUPPLEMENT.format(base=base, names=names)


@symbols(_words_sql("get") + ", top AS (SELECT * FROM words ORDER BY score DESC, id LIMIT 100)" + _supplement_sql("top", "get Anvil blue_anvil") + " SELECT id, round(score, 6) AS score FROM hits")
def search_exact_supplement(spark, sf_dir):
    nodes = P.symbols(spark, sf_dir)
    return search.supplemented(nodes, search.by_words(nodes, "get", (), (), 10), "get Anvil blue_anvil").select("id", F.round("score", 6).alias("score"))


# -- bonuses --------------------------------------------------------------------------------------------------------


def _name_sql(q: str) -> str:
    one, parts, split = re.sub(r"\s", "", q).lower(), words.base_terms(q, "_.-", 2), q.lower().split()
    out = f"CASE WHEN lower(name) = '{one}' THEN 80.0"
    if len(split) > 1:
        out += " WHEN lower(name) IN (" + ", ".join(f"'{w}'" for w in split) + ") THEN 60.0"
    out += f" WHEN starts_with(lower(name), '{one}') THEN floor(10.5 + 30.0::DOUBLE * ({len(one)}.0::DOUBLE / strlen(name)))"
    if len(parts) > 1:
        out += " WHEN " + " AND ".join(f"contains(lower(name), '{t}')" for t in parts) + " THEN 15.0"
    return f"({out} WHEN contains(lower(name), '{one}') THEN 10.0 ELSE 0.0 END)::DOUBLE"


def _test_sql(p: str = "file_path") -> str:
    return f"(regexp_matches(lower({p}), '{paths.TEST_LOWER}') OR regexp_matches({p}, '{paths.TEST_CASED}'))"


def _path_sql(q: str) -> str:
    base, folder = "regexp_extract(lower(file_path), '[^/]*$')", "CASE WHEN contains(file_path, '/') THEN regexp_replace(lower(file_path), '/[^/]*$', '') ELSE '.' END"
    out = []
    for w in q.split():
        parts = words.base_terms(w)
        if parts:
            has = lambda c: "(" + " OR ".join(f"contains({c}, '{t}')" for t in parts) + ")"  # noqa: B023, E731
            out.append(f"CASE WHEN {has(base)} THEN 10 ELSE 0 END + CASE WHEN {has(folder)} THEN 5 WHEN {has('lower(file_path)')} THEN 3 ELSE 0 END")
    if "test" not in q.lower() and "spec" not in q.lower():
        out.append(f"CASE WHEN {_test_sql()} THEN -15 ELSE 0 END")
    return f"({' + '.join(out) or '0'})::DOUBLE"


_KIND_SQL = "(CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.KIND_BONUS.items()) + " ELSE 0 END)::DOUBLE"
_BONUS_QUERIES = ("blue anvil", "anvil", "getBlue", "anvil test", "core_an")


@symbols(" " + " UNION ALL ".join(f"SELECT '{q}' AS query, id, {_KIND_SQL} AS of_kind, {_path_sql(q)} AS of_path, {_name_sql(q)} AS of_name FROM symbols" for q in _BONUS_QUERIES))
def search_rescore(spark, sf_dir):
    nodes = P.symbols(spark, sf_dir)
    each = [nodes.select(F.lit(q).alias("query"), "id", X.kind_bonus(C("kind")).alias("of_kind"), X.path_bonus(C("file_path"), q).alias("of_path"), X.name_bonus(C("name"), q).alias("of_name")) for q in _BONUS_QUERIES]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


# -- the whole ranking ----------------------------------------------------------------------------------------------


def _rank_sql(raw: str, stage: str, limit: int) -> str:
    q = search.parse(raw)
    where = " AND ".join([f"{c} IN ({', '.join(repr(v) for v in vs)})" for c, vs in (("kind", q.kinds), ("language", q.languages)) if vs]) or "TRUE"
    if stage == "words":
        sql = _words_sql(q.text, where) + f", base AS (SELECT id, score FROM words ORDER BY score DESC, id LIMIT {max(100, 5 * limit)})"
    elif stage == "like":
        sql = f", base AS (SELECT id, score FROM (SELECT id, name, {_like_sql(q.text)} AS score FROM symbols WHERE {where}) WHERE score IS NOT NULL ORDER BY score DESC, length(name), id LIMIT {limit})"
    elif stage == "spelling":
        sql = _FUZZY.format(q=q.text.lower(), b=1 if len(q.text) <= 4 else 2, n=limit) + ", base AS (SELECT id, score FROM spelled)"
    else:
        sql = f", base AS (SELECT id, 1.0::DOUBLE AS score FROM symbols WHERE {where} ORDER BY name, id LIMIT {5 * limit})"
    scoring = q.text or raw
    hard = " AND ".join("(" + " OR ".join(f"contains(lower({c}), '{p.lower()}')" for p in ps) + ")" for c, ps in (("file_path", q.paths), ("name", q.names)) if ps) or "TRUE"
    return f"""{SYMBOLS_CTE}{sql}{_supplement_sql("base", raw)},
best AS (SELECT s.id, s.name, s.file_path, h.score + {_KIND_SQL} + {_path_sql(scoring)} + {_name_sql(scoring)} AS score FROM hits h JOIN symbols s USING (id) ORDER BY 4 DESC, id LIMIT {limit})
SELECT '{raw.replace("'", "''")}' AS query, id, name, round(score, 6) AS score, row_number() OVER (ORDER BY regexp_matches(lower(file_path), '{paths.GENERATED_RANK}'), score DESC, id)::INTEGER AS rank FROM best WHERE {hard}"""


_RANKED = (("blue anvil", "words", 20), ("getBlue kind:method lang:go", "words", 15), ("nvi path:core", "like", 30), ("BlueAnvl", "spelling", 12), ('kind:class name:"anvil" zzz:', "like", 10), ("kind:route language:Rust path:src path:app", "filters", 25), ("kind:nonsense lang:bash anvil", "words", 10))


@query(" UNION ALL ".join(f"(SELECT * FROM ({_rank_sql(*r)}))" for r in _RANKED if r[1] != "none"), with_graph=False)
def search_pipeline(spark, sf_dir):
    nodes = P.symbols(spark, sf_dir)
    out = None
    for raw, _, limit in _RANKED:
        one = search.search(nodes, raw, limit).select(F.lit(raw).alias("query"), "id", "name", F.round("score", 6).alias("score"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


@symbols(
    """, h AS (SELECT id, name, file_path, lower(name) AS low FROM symbols WHERE lower(name) IN ('blue_anvil', 'anvil', 'hotgear', 'anvil3')),
d AS (SELECT low, count(DISTINCT file_path) AS n FROM h GROUP BY 1), m AS (SELECT * FROM h JOIN d USING (low)),
f AS (SELECT file_path, bool_or(n < 10) AS near, count(DISTINCT low) AS k FROM m GROUP BY 1)
SELECT id, name, file_path, CASE WHEN near THEN 20 ELSE 0 END + 20 * (k - 1) AS bonus FROM m JOIN f USING (file_path)"""
)
def exact_name_colocation(spark, sf_dir):
    return search.colocated(P.symbols(spark, sf_dir), ["blue_anvil", "Anvil", "hotGear", "anvil3"])


@symbols(
    """, t AS (SELECT id, term, CASE WHEN lower(name) = term THEN 2.0 ELSE 1.0 END::DOUBLE AS score FROM symbols JOIN (VALUES ('anvil'), ('blue'), ('get')) v(term) ON contains(lower(name), term))
SELECT id, max(score) + 5 * (count(DISTINCT term) - 1) AS score, count(DISTINCT term) AS n_terms FROM t GROUP BY id"""
)
def multi_term_scores(spark, sf_dir):
    nodes, low = P.symbols(spark, sf_dir), F.lower("name")
    term = F.explode(F.array(*map(F.lit, ("anvil", "blue", "get")))).alias("term")
    hits = nodes.select("id", "name", term).filter(F.contains(low, C("term")))
    return search.merged_terms(hits.select("id", "term", F.when(F.lower("name") == C("term"), 2.0).otherwise(1.0).alias("score")))


@symbols(
    """, o AS (SELECT language AS g, start_line, id, length(docstring)::BIGINT AS size, row_number() OVER (PARTITION BY language ORDER BY start_line, length(docstring), id) AS k FROM symbols),
t AS (SELECT g, id, k, size AS used, TRUE AS taken FROM o WHERE k = 1
UNION ALL SELECT o.g, o.id, o.k, CASE WHEN t.used + o.size <= 900 THEN t.used + o.size ELSE t.used END, t.used + o.size <= 900 FROM t JOIN o ON o.g = t.g AND o.k = t.k + 1)
SELECT g AS language, id FROM t WHERE taken"""
)
def budgeted_take(spark, sf_dir):
    nodes = P.symbols(spark, sf_dir).withColumn("chars", F.length("docstring").cast("long"))
    return search.budgeted(nodes, "language", ["start_line"], "chars", 900)


# -- names and paths ------------------------------------------------------------------------------------------------

_GLOBS = ("src/**/*.go", "*/tests/?*.js", "**/anvil_*")


@symbols(
    f""" SELECT id, file_path, {_test_sql()} AS is_test, regexp_matches(lower(file_path), '{paths.GENERATED_RANK}') AS is_generated, regexp_matches(file_path, '{paths.GENERATED_SOURCE}') AS is_generated_source,
regexp_matches(file_path, '{paths.AFFECTED_TEST}') AS is_affected_test, regexp_matches(lower(file_path), '{paths.LOW_VALUE_DOMINANT}') AS low_value, regexp_matches(lower(file_path), '{paths.LOW_VALUE_EXPLORE}') AS low_explore,
CASE WHEN starts_with(file_path, 'src/') THEN regexp_matches(file_path, '^src/(.*/)?[^/]*\\.go$') ELSE FALSE END AS listed FROM symbols"""
)
def path_predicates(spark, sf_dir):
    p = C("file_path")
    return P.symbols(spark, sf_dir).select(
        "id", p, paths.is_test(p).alias("is_test"), paths.is_generated(p).alias("is_generated"), paths.is_generated_source(p).alias("is_generated_source"),
        paths.is_affected_test(p).alias("is_affected_test"), paths.is_low_value(p).alias("low_value"), paths.is_low_value(p, explore=True).alias("low_explore"), paths.in_folder(p, "src/", "src/**/*.go").alias("listed"),
    )


@symbols(f" SELECT id, file_path, row_number() OVER (ORDER BY regexp_matches(lower(file_path), '{paths.GENERATED_RANK}'), id)::INTEGER AS rank FROM symbols")
def generated_last(spark, sf_dir):
    from pyspark.sql import Window

    return P.symbols(spark, sf_dir).select("id", "file_path", F.row_number().over(Window.orderBy(paths.is_generated(C("file_path")), "id")).alias("rank"))


@symbols(
    " SELECT id, CASE regexp_extract(file_path, '[^/]*$') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.BASE_NAMES.items()) + " ELSE CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + " ELSE 'unknown' END END AS language FROM symbols"
)
def language_detect(spark, sf_dir):
    return P.symbols(spark, sf_dir).select("id", X.language_of(C("file_path")).alias("language"))


_HEADS = ("'@interface A : B'", "'  class A {'", "'int f(void);'", "'SQLite format 3' || chr(0)", "'template<T>'", "'std::string s;'")


@symbols(f" SELECT id, CASE p_head WHEN 0 THEN 'objc' WHEN 1 THEN 'cpp' WHEN 2 THEN 'c' WHEN 3 THEN 'sqlite' WHEN 4 THEN 'cpp' ELSE 'cpp' END AS language FROM (SELECT id, seq % {len(_HEADS)} AS p_head FROM symbols)")
def language_by_content(spark, sf_dir):
    head = F.expr("CASE seq % 6 " + " ".join(f"WHEN {i} THEN {h}" for i, h in enumerate(_HEADS)) + " END")
    return P.symbols(spark, sf_dir).select("id", X.language_of_content(F.lit("c"), head).alias("language"))


@symbols(
    """ SELECT id, regexp_extract(file_path, '[^/]*$') AS base, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS dir,
replace(replace(file_path, 'deep/../', ''), '/./', '/') AS clean, name = 'anvil.blue' OR (name = 'anvil' AND (contains(qualified_name, 'blue::anvil') OR regexp_matches(file_path, '(^|/)blue(\\.[^./]*)?(/|$)'))) AS exact,
name = 'Anvil' OR (name = 'anvil' AND (contains(qualified_name, 'src::core::anvil') OR (regexp_matches(file_path, '(^|/)src(\\.[^./]+)?(/|$)') AND regexp_matches(file_path, '(^|/)core(\\.[^./]+)?(/|$)')))) AS symbol FROM symbols"""
)
def path_parts(spark, sf_dir):
    p, c = C("file_path"), (C("name"), C("kind"), C("qualified_name"), C("file_path"))
    exact = X.is_exact_verb(C("name"), "anvil.blue") | X.matches_symbol(*c, "blue.anvil")
    return P.symbols(spark, sf_dir).select(
        "id", paths.base_name(p).alias("base"), paths.dir_name(p).alias("dir"), paths.clean(p).alias("clean"), exact.alias("exact"), (X.matches_symbol(*c, "Anvil") | X.matches_symbol(*c, "crate::src::core::anvil")).alias("symbol")
    )


@symbols(
    """ SELECT id, coalesce(nullif('v' || regexp_extract(v, '^[\\s^~>=<v]*([0-9]+)', 1), 'v'), 'v0') AS major, CASE WHEN contains(upper(t), 'INT') THEN 'INTEGER' WHEN contains(upper(t), 'CHAR') OR contains(upper(t), 'TEXT') THEN 'TEXT'
WHEN t = '' OR contains(upper(t), 'BLOB') THEN 'BLOB' WHEN contains(upper(t), 'REAL') OR contains(upper(t), 'DOUB') THEN 'REAL' ELSE 'NUMERIC' END AS affinity, 'host.org/own/' || name AS remote, strlen(name) AS n_bytes,
cast(seq % 9 AS string) || chr(9) || name || chr(10) || cast(seq % 9 + 1 AS string) || chr(9) || kind AS numbered
FROM (SELECT *, CASE seq % 5 WHEN 0 THEN '^' || seq || '.2' WHEN 1 THEN '>=' || seq WHEN 2 THEN 'latest' WHEN 3 THEN 'v' || seq ELSE '~> ' || seq || '.0' END AS v,
CASE seq % 6 WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar(9)' WHEN 2 THEN '' WHEN 3 THEN 'double' WHEN 4 THEN 'decimal(3)' ELSE 'text' END AS t FROM symbols)"""
)
def scalar_functions(spark, sf_dir):
    k = C("seq").cast("string")
    version = F.when(C("seq") % 5 == 0, F.concat(F.lit("^"), k, F.lit(".2"))).when(C("seq") % 5 == 1, F.concat(F.lit(">="), k)).when(C("seq") % 5 == 2, "latest").when(C("seq") % 5 == 3, F.concat(F.lit("v"), k)).otherwise(F.concat(F.lit("~> "), k, F.lit(".0")))
    declared = F.element_at(F.array(*map(F.lit, ("bigint", "varchar(9)", "", "double", "decimal(3)", "text"))), (C("seq") % 6 + 1).cast("int"))
    remote = F.when(C("seq") % 2 == 0, F.concat(F.lit("git@host.org:own/"), "name", F.lit(".git"))).otherwise(F.concat(F.lit("https://u:p@host.org/own/"), "name", F.lit("/")))
    return P.symbols(spark, sf_dir).select(
        "id", X.scope_version(version).alias("major"), X.affinity(declared).alias("affinity"), X.remote_parts(remote).alias("remote"), F.octet_length("name").cast("long").alias("n_bytes"),
        X.numbered(F.concat("name", F.lit("\n"), "kind"), (C("seq") % 9).cast("int")).alias("numbered"),
    )


_WORD_ROWS = (
    ("stem", "running", "runn run runne"), ("stem", "queries", "query"), ("stem", "classes", "class"), ("stem", "action", "act"), ("stem", "parser", "pars parse"), ("stem", "copied", "copi copie copy"), ("stem", "bus", ""),
    ("term", "where is getUserName handled", "getusername get user name handled"), ("term", "how does the snake_case_name work", "snake_case_name snake case name"),
    ("symbol", "how does DoThing call io.ReadAll and MAX_SIZE", "DoThing ReadAll MAX_SIZE io.ReadAll io"), ("distinct", "a_b", "True"), ("distinct", "Plain", "False"), ("distinct", "camelCase", "True"),
    ("project", "@scope/my-engine", "myengine"), ("project", "x/y/tool", ""),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{' '.join(sorted(c.split()))}')" for a, b, c in _WORD_ROWS) + ") v(what, word, found)", with_graph=False)
def query_words(spark, sf_dir):
    made = {"stem": words.stems, "term": words.search_terms, "symbol": words.symbols, "distinct": lambda w: [str(words.is_distinctive(w))], "project": lambda w: words.project_tokens(w)}
    return spark.createDataFrame([(a, b, " ".join(sorted(made[a](b)))) for a, b, _ in _WORD_ROWS], "what string, word string, found string")


@symbols(" SELECT id, greatest(0, (list_contains(['blue', 'anvil', 'get', 'handler'], split_part(lower(p), ' ', 1)))::INTEGER + (list_contains(['blue', 'anvil', 'get', 'handler'], split_part(lower(p), ' ', 2)))::INTEGER) AS overlap FROM (SELECT id, regexp_replace(docstring, '^.* part of ', '') AS p FROM symbols)")
def name_word_overlap(spark, sf_dir):
    two = F.initcap(F.regexp_replace("docstring", "^.* part of ", ""))
    return P.symbols(spark, sf_dir).select("id", X.word_overlap(F.regexp_replace(two, " ", ""), F.lit("getBlueAnvilHandler")).alias("overlap"))
