"""Queries of reference resolution over projected definitions of all languages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import resolve
from loomgraph.plans.registry import query
from loomgraph.sources import projection as P

LANGS = tuple(sorted(resolve.STRATEGIES))
N = len(LANGS)
C = F.col
_L = lambda key: "CASE " + f"{key} % {N} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGS)) + " END"
_S = lambda expr: f"cast({expr} AS string)"
_FILE = lambda k: f"'d' || {_S(f'{k} % 5')} || '/s' || {_S(f'{k} % 3')} || '/f' || {_S(f'{k} % 13')} || '.src'"


def _def(prefix: str, kind: str, name: str, qualified: str, signature: str) -> str:
    k = "p_partkey"
    return f"SELECT '{prefix}:' || {_S(k)} AS id, {kind} AS kind, {name} AS name, {qualified} AS qualified_name, {_FILE(k)} AS file_path, {_L(k)} AS language, cast({k} % 97 + 1 AS bigint) AS start_line, {signature} AS signature FROM {{part}}"


_CN, _MN = f"'C' || {_S('p_partkey % 23')}", f"'m' || {_S('p_partkey % 31')}"
DEFS = "\nUNION ALL ".join(
    (
        _def("C", P._pick("p_partkey", ["'class'", "'struct'", "'enum'", "'module'", "'interface'"]), _CN, _CN, "''"),
        _def("M", P._pick("p_partkey", ["'method'", "'function'", "'property'"]), _MN, f"{_CN} || '::' || {_MN}", "''"),
        _def("F", "'function'", f"'f' || {_S('p_partkey % 41')}", f"'f' || {_S('p_partkey % 41')}", "''"),
        _def("V", "'variable'", f"'v' || {_S('p_partkey % 7')}", f"'v' || {_S('p_partkey % 7')}", f"'= ' || {_CN} || '(x)'"),
        _def("I", "'import'", f"'f' || {_S('(p_partkey * 3) % 41')}", f"'f' || {_S('(p_partkey * 3) % 41')}", f"'a' || {_S('p_partkey % 7')} || '=d' || {_S('(p_partkey + 1) % 5')}"),
        f"SELECT 'file:' || language || ':' || file_path AS id, 'file' AS kind, regexp_extract(file_path, '[^/]*$', 0) AS name, file_path AS qualified_name, file_path, language, cast(1 AS bigint) AS start_line, '' AS signature FROM (SELECT DISTINCT {_FILE('p_partkey')} AS file_path, {_L('p_partkey')} AS language FROM {{part}}) x",
    )
)
BASES = f"SELECT 'C:' || {_S('p_partkey')} AS source, 'C:' || {_S('(p_partkey * 3 + 1) % (SELECT count(*) FROM {part})')} AS target, 'extends' AS kind, cast(1 AS bigint) AS line FROM {{part}}"
_O = "o_orderkey"
_NAMES = (
    f"'f' || {_S(f'{_O} % 41')}", f"'v' || {_S(f'{_O} % 7')} || '.m' || {_S(f'{_O} % 31')}", f"'C' || {_S(f'{_O} % 23')} || '::m' || {_S(f'{_O} % 31')}", f"'C' || {_S(f'{_O} % 23')} || '.new'",
    f"'a' || {_S(f'{_O} % 7')} || '.f' || {_S(f'{_O} % 41')}", f"'C' || {_S(f'{_O} % 23')}", f"'d' || {_S(f'{_O} % 5')} || 'S' || {_S(f'{_O} % 3')} || '.m' || {_S(f'{_O} % 31')}", f"'f' || {_S(f'{_O} % 13')} || '.src'",
    f"'../s' || {_S(f'({_O} + 1) % 3')} || '/f' || {_S(f'{_O} % 13')} || '.src'", f"'f' || {_S(f'{_O} % 41')}", f"'C' || {_S(f'{_O} % 23')}", f"'m' || {_S(f'{_O} % 31')}",
)
_FORM = f"cast(floor({_O} / {N}) AS bigint) % {len(_NAMES)}"
REFS = f"""SELECT 'r:' || {_S(_O)} AS ref_id, 'F:' || {_S(f'{_O} % 200')} AS from_node, CASE {_FORM} {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_NAMES))} END AS name,
CASE WHEN {_FORM} IN (7, 8, 9) THEN 'imports' WHEN {_FORM} = 10 THEN 'extends' ELSE 'calls' END AS kind, {_FILE(_O)} AS file_path, {_L(_O)} AS language FROM {{orders}}"""


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows) + ")"


_STEPS = _values([(lang, i, s.how, " ".join(s.kinds), " ".join(s.for_kinds), s.dotted, s.imported) for lang, steps in resolve.STRATEGIES.items() for i, s in enumerate(steps)])
_MADE = _values([(k, v) for k, vs in resolve.CONSTRUCTED.items() for v in vs])
_NEAR = "CASE WHEN c.file_path = t.file_path THEN 0 WHEN c.dir = t.dir THEN 1 ELSE 2 END"
_KIND = "(t.kinds = '' OR list_contains(string_split(t.kinds, ' '), c.kind))"


def _best(how: str, condition: str, pool: str = "plain", where: str = "TRUE", unique: bool = False) -> str:
    n = "count(*) OVER (PARTITION BY t.ref_id, t.step)" if unique else "1"
    return f"SELECT ref_id, step, '{how}' AS how, target FROM (SELECT t.ref_id, t.step, c.id AS target, {n} AS n, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY {_NEAR}, c.file_path, c.start_line, c.id) AS k FROM todo t JOIN {pool} c ON {condition} AND {_KIND} WHERE t.how = '{how}' AND {where}) WHERE k = 1 AND n = 1"


_SQL = f"""WITH RECURSIVE n0 AS ({P.plain(DEFS)}), bases AS ({P.plain(BASES)}), r0 AS ({P.plain(REFS)}),
n AS (SELECT *, CASE WHEN language = 'sqlite' THEN 'sql' ELSE language END AS lang, regexp_replace(file_path, '/[^/]*$', '') AS dir, string_split(qualified_name, '::')[-2] AS owner FROM n0),
plain AS (SELECT * FROM n WHERE kind NOT IN ('import', 'file')), imports AS (SELECT * FROM n WHERE kind = 'import'), files AS (SELECT * FROM n WHERE kind = 'file'),
r AS (SELECT *, CASE WHEN language = 'sqlite' THEN 'sql' ELSE language END AS lang, regexp_replace(file_path, '/[^/]*$', '') AS dir, list_filter(regexp_split_to_array(name, '::|[.:#]'), lambda x: x <> '') AS parts FROM r0),
steps AS (SELECT * FROM {_STEPS} v(lang, step, how, kinds, for_kinds, dotted, imported)),
todo AS (SELECT r.*, s.step, s.how, s.kinds, parts[-1] AS last, parts[-2] AS receiver, len(parts) > 1 AS is_dotted FROM r JOIN steps s ON s.lang = r.lang
 WHERE (s.dotted IS NULL OR s.dotted = (len(parts) > 1)) AND (s.for_kinds = '' OR list_contains(string_split(s.for_kinds, ' '), r.kind)) AND (NOT s.imported OR EXISTS (SELECT 1 FROM imports i WHERE i.file_path = r.file_path AND i.name = r.name))),
made AS (SELECT file_path, name AS receiver, min(regexp_extract(signature, '^= ([A-Za-z_0-9]+)\\(', 1)) AS owner FROM plain WHERE kind = 'variable' GROUP BY 1, 2),
known AS (SELECT t.*, m.owner FROM todo t JOIN made m ON m.file_path = t.file_path AND m.receiver = t.receiver WHERE t.how = 'inferred'),
inferred AS (SELECT ref_id, step, target FROM (SELECT t.ref_id, t.step, c.id AS target, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY {_NEAR}, c.file_path, c.start_line, c.id) AS k FROM known t JOIN plain c ON c.lang = t.lang AND c.owner = t.owner AND c.name = t.last AND {_KIND}) WHERE k = 1),
base AS (SELECT DISTINCT a.lang, a.name AS owner, b.name AS base FROM bases e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target),
up AS (SELECT lang, owner, base, 1 AS hops FROM base UNION SELECT up.lang, up.owner, base.base, up.hops + 1 FROM up JOIN base ON base.lang = up.lang AND base.owner = up.base WHERE up.hops < 5),
every AS ({_best("def", "c.lang = t.lang AND c.name = t.name")}
UNION ALL {_best("shadow", "c.lang = t.lang AND c.name = t.name", where="EXISTS (SELECT 1 FROM imports i WHERE i.file_path = t.file_path)")}
UNION ALL {_best("unique", "c.lang = t.lang AND c.name = t.last", unique=True)}
UNION ALL {_best("near", "c.lang = t.lang AND c.name = t.last")}
UNION ALL {_best("member", "c.lang = t.lang AND c.name = t.last AND c.owner = t.receiver")}
UNION ALL {_best("construct", "c.lang = t.lang AND c.name = CASE WHEN t.is_dotted THEN t.receiver ELSE t.name END", where="(NOT t.is_dotted OR t.last = 'new')")}
UNION ALL {_best("generic", "c.name = t.name", "n")}
UNION ALL {_best("file", "c.lang = t.lang AND regexp_replace(c.name, '[.][A-Za-z0-9]+$', '') = regexp_replace(regexp_extract(t.name, '[^/]*$'), '[.][A-Za-z0-9]+$', '')", "files")}
UNION ALL SELECT ref_id, step, 'local', target FROM (SELECT t.ref_id, t.step, i.id AS target, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY i.start_line, i.id) AS k FROM todo t JOIN imports i ON i.lang = t.lang AND i.name = t.name AND i.file_path = t.file_path WHERE t.how = 'local') WHERE k = 1
UNION ALL SELECT ref_id, step, 'inferred', target FROM inferred
UNION ALL SELECT k.ref_id, k.step, 'veto', NULL FROM known k WHERE NOT EXISTS (SELECT 1 FROM inferred i WHERE i.ref_id = k.ref_id AND i.step = k.step)
UNION ALL SELECT ref_id, step, 'drop', NULL FROM todo WHERE how = 'drop'
UNION ALL SELECT ref_id, step, 'alias', target FROM (SELECT t.ref_id, t.step, c.id AS target, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY c.file_path, c.start_line, c.id) AS k FROM todo t JOIN imports i ON i.file_path = t.file_path AND regexp_extract(i.signature, '^([^=]*)=', 1) = t.receiver
 JOIN plain c ON c.lang = t.lang AND c.name = t.last AND (c.dir = regexp_replace(i.signature, '^[^=]*=', '') OR starts_with(c.dir, regexp_replace(i.signature, '^[^=]*=', '') || '/')) WHERE t.how = 'alias') WHERE k = 1
UNION ALL SELECT ref_id, step, 'overlap', target FROM (SELECT t.ref_id, t.step, c.id AS target, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY c.file_path, c.id) AS k FROM todo t JOIN plain c ON c.lang = t.lang AND c.name = t.last AND c.kind IN ('method', 'function')
 WHERE t.how = 'overlap' AND regexp_matches(t.receiver, '^d[0-9]S[0-9]$') AND c.dir = lower(replace(t.receiver, 'S', '/S'))) WHERE k = 1
UNION ALL SELECT ref_id, step, 'package', target FROM (SELECT t.ref_id, t.step, c.id AS target, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY CASE WHEN c.dir = t.dir THEN 0 WHEN EXISTS (SELECT 1 FROM imports i WHERE i.file_path = t.file_path AND i.name = t.name AND regexp_replace(i.signature, '^[^=]*=', '') = c.dir) THEN 1 ELSE 2 END, c.file_path, c.start_line, c.id) AS k
 FROM todo t JOIN plain c ON c.lang = t.lang AND c.name = t.name WHERE t.how = 'package') WHERE k = 1
UNION ALL SELECT ref_id, step, 'include', target FROM (SELECT t.ref_id, t.step, f.id AS target, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY f.id) AS k FROM todo t JOIN files f ON f.file_path = CASE WHEN starts_with(t.name, '../') THEN regexp_replace(t.dir, '/[^/]*$', '') || '/' || substr(t.name, 4) ELSE t.dir || '/' || t.name END WHERE t.how = 'include') WHERE k = 1
UNION ALL SELECT ref_id, step, 'inherited', target FROM (SELECT t.ref_id, t.step, c.id AS target, row_number() OVER (PARTITION BY t.ref_id, t.step ORDER BY u.hops, c.id) AS k FROM todo t JOIN up u ON u.lang = t.lang AND u.owner = t.receiver JOIN plain c ON c.lang = t.lang AND c.owner = u.base AND c.name = t.last WHERE t.how = 'inherited') WHERE k = 1),
first AS (SELECT ref_id, how, target FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY step, how, target) AS k FROM every) WHERE k = 1 AND target IS NOT NULL)
SELECT f.ref_id, r.from_node AS source, f.target, CASE WHEN r.kind = 'calls' AND EXISTS (SELECT 1 FROM {_MADE} m(lang, kind) WHERE m.lang = r.lang AND m.kind = c.kind) THEN 'instantiates' WHEN r.kind = 'extends' AND c.kind IN ('interface', 'protocol', 'trait') THEN 'implements' ELSE r.kind END AS kind, f.how AS strategy
FROM first f JOIN r USING (ref_id) JOIN n c ON c.id = f.target WHERE r.from_node <> f.target"""


def _inputs(spark, sf_dir, langs: tuple[str, ...] = ()):
    refs, nodes, edges = (P.run(spark, sf_dir, x) for x in (REFS, DEFS, BASES))
    return (refs.filter(C("language").isin(*langs)) if langs else refs), nodes, edges


def _some(*langs: str) -> str:
    return f"SELECT x.* FROM ({_SQL}) x JOIN ({P.plain(REFS)}) q USING (ref_id) WHERE q.language IN ({', '.join(map(repr, langs))})"


@query(_SQL, with_graph=False)
def resolve_strategies(spark, sf_dir):
    return resolve.resolve(*_inputs(spark, sf_dir))


@query(_some("java", "kotlin", "scala"), with_graph=False)
def resolve_tiers(spark, sf_dir):
    return resolve.resolve(*_inputs(spark, sf_dir, ("java", "kotlin", "scala")))


@query(_some("python", "perl"), with_graph=False)
def resolve_veto(spark, sf_dir):
    return resolve.resolve(*_inputs(spark, sf_dir, ("python", "perl")))


@query(_some("go"), with_graph=False)
def resolve_import_alias(spark, sf_dir):
    return resolve.resolve(*_inputs(spark, sf_dir, ("go",)))


@query(f"SELECT r.ref_id, r.name, coalesce(nullif(CASE WHEN hash_ = 0 THEN '' ELSE r.language END, ''), n.language) AS language, coalesce(nullif(CASE WHEN hash_ = 1 THEN '' ELSE r.file_path END, ''), n.file_path) AS file_path FROM (SELECT *, length(ref_id) % 3 AS hash_ FROM ({P.plain(REFS)})) r LEFT JOIN ({P.plain(DEFS)}) n ON n.id = r.from_node", with_graph=False)
def reference_fill(spark, sf_dir):
    refs, nodes, _ = _inputs(spark, sf_dir)
    k = F.length("ref_id") % 3
    blank = refs.withColumns({"language": F.when(k == 0, "").otherwise(C("language")), "file_path": F.when(k == 1, "").otherwise(C("file_path"))})
    return resolve.filled(blank, nodes).select("ref_id", "name", "language", "file_path")


@query(f"SELECT ref_id, name, file_path FROM ({P.plain(REFS)}) WHERE file_path = 'd1/s1/f1.src' OR name IN ('f3', 'C5')", with_graph=False)
def sync_reresolve(spark, sf_dir):
    refs, _, _ = _inputs(spark, sf_dir)
    files, names = spark.createDataFrame([("d1/s1/f1.src",)], "file_path string"), spark.createDataFrame([("f3",), ("C5",)], "name string")
    return resolve.to_reresolve(refs, files, names).select("ref_id", "name", "file_path")


@query(f"SELECT ref_id FROM ({P.plain(REFS)}) ORDER BY ref_id LIMIT 100 OFFSET 200", with_graph=False)
def reference_pages(spark, sf_dir):
    return _inputs(spark, sf_dir)[0].select("ref_id").orderBy("ref_id").offset(200).limit(100)


# -- interfaces -----------------------------------------------------------------------------------------------------

_IFACE = """own AS (SELECT 'S:' || p_brand AS id, 'struct' AS kind, p_brand AS name, cast(1 AS bigint) AS start_line FROM {part} GROUP BY p_brand UNION ALL SELECT 'N:' || p_brand, 'interface', p_brand, cast(2 AS bigint) FROM {part} WHERE p_size < 9 GROUP BY p_brand
UNION ALL SELECT 'SM:' || p_brand || ':' || p_type, 'method', p_type, cast(3 AS bigint) FROM {part} WHERE p_size < 40 GROUP BY p_brand, p_type UNION ALL SELECT 'NM:' || p_brand || ':' || p_type, 'method', p_type, cast(4 AS bigint) FROM {part} WHERE p_size < 9 GROUP BY p_brand, p_type)"""
_IFACE_EDGES = """links AS (SELECT 'S:' || p_brand AS source, 'SM:' || p_brand || ':' || p_type AS target, 'contains' AS kind FROM {part} WHERE p_size < 40 GROUP BY p_brand, p_type UNION ALL SELECT 'N:' || p_brand, 'NM:' || p_brand || ':' || p_type, 'contains' FROM {part} WHERE p_size < 9 GROUP BY p_brand, p_type)"""
_IMPLEMENTS = f"""WITH {P.plain(_IFACE)}, {P.plain(_IFACE_EDGES)}, m AS (SELECT l.source AS id, o.kind, c.name AS member, c.id AS member_id FROM links l JOIN own o ON o.id = l.source JOIN own c ON c.id = l.target),
size AS (SELECT id, count(DISTINCT member) AS k FROM m WHERE kind = 'interface' GROUP BY id),
imp AS (SELECT s.id AS source, i.id AS target FROM m s JOIN m i ON i.member = s.member AND i.kind = 'interface' JOIN size z ON z.id = i.id WHERE s.kind = 'struct' GROUP BY s.id, i.id, z.k HAVING count(DISTINCT s.member) = z.k)"""


def _interfaces(spark, sf_dir):
    return P.run(spark, sf_dir, f"WITH {_IFACE} SELECT * FROM own"), P.run(spark, sf_dir, f"WITH {_IFACE_EDGES} SELECT * FROM links").withColumn("line", F.lit(1).cast("long"))


@query(_IMPLEMENTS + " SELECT source, target, 'implements' AS kind, 1::BIGINT AS line, 'heuristic' AS provenance FROM imp", with_graph=False)
def implements_edges(spark, sf_dir):
    return resolve.implements_edges(*_interfaces(spark, sf_dir))


@query(_IMPLEMENTS + " SELECT DISTINCT i.member_id AS source, s.member_id AS target, 'calls' AS kind, 'heuristic' AS provenance FROM imp JOIN m s ON s.id = imp.source JOIN m i ON i.id = imp.target AND i.member = s.member", with_graph=False)
def override_calls(spark, sf_dir):
    nodes, edges = _interfaces(spark, sf_dir)
    found = resolve.implements_edges(nodes, edges).select("source", "target", "kind", "line")
    return resolve.override_calls(nodes, edges.unionByName(found))
