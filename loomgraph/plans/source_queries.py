"""Queries of extraction, ignore rules, coverage profiles and sync over generated inputs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import coverage, sync
from loomgraph.operators.lineage import cut_lineage
from loomgraph.plans.registry import query
from loomgraph.sources import extract, files
from loomgraph.sources.samples import SAMPLES
from loomgraph.sources import projection as P

C = F.col
_LANGS = tuple(SAMPLES)
_K = f"SELECT p_partkey AS k, p_partkey % {len(_LANGS)} AS lang FROM {{part}}"


def _esc(x: str) -> str:
    return x.replace("'", "''")


def _tree(spark, sf_dir):
    """A source file for every part, in all languages in turn."""
    rows = [(i, lang, p, t.replace("\x00", "\x01")) for i, (lang, (p, t, *_)) in enumerate(SAMPLES.items())]
    shapes = spark.createDataFrame(rows, "lang int, language string, path string, text string")
    own = P.table(spark, sf_dir, "part").select(C("p_partkey").cast("string").alias("k"), (C("p_partkey") % len(_LANGS)).cast("int").alias("lang"))
    own = own.repartition(max(1, min(own.count() // 4096, 10_000)), "k")  # a small table, of which one task would extract every file
    named = own.join(F.broadcast(shapes), "lang")
    fill = lambda c: F.replace(F.replace(C(c), F.lit("@"), C("k")), F.lit("\x01"), F.lit("@"))
    return named.select("language", F.concat(C("k"), F.lit("/"), fill("path")).alias("path"), fill("text").cast("binary").alias("content"))


def _expected(which: int) -> str:
    rows = ", ".join(f"({i}, '{lang}', '{_esc(SAMPLES[lang][0])}', '{kind}', '{_esc(name)}', {line})" for i, lang in enumerate(_LANGS) for kind, name, line in SAMPLES[lang][which])
    return f"SELECT replace(k || '/' || v.path, '@', k) AS file_path, v.language, v.kind, replace(v.name, '@', k) AS name, v.line FROM (SELECT cast(p_partkey AS string) AS k, p_partkey % {len(_LANGS)} AS lang FROM part) p JOIN (VALUES {rows}) v(lang, language, path, kind, name, line) ON v.lang = p.lang"


# the file's own key stands twice in its path: once for the folder
@query(_expected(2).replace("replace(k || '/' || v.path, '@', k)", "k || '/' || replace(v.path, '@', k)"), with_graph=False)
def extract_nodes(spark, sf_dir):
    nodes, _, _, _ = extract.tables(extract.extract(_tree(spark, sf_dir)))
    return nodes.filter("kind != 'file'").select("file_path", "language", "kind", "name", C("start_line").alias("line"))


@query(_expected(3).replace("replace(k || '/' || v.path, '@', k)", "k || '/' || replace(v.path, '@', k)"), with_graph=False)
def extract_references(spark, sf_dir):
    _, _, refs, _ = extract.tables(extract.extract(_tree(spark, sf_dir)))
    return refs.select("file_path", "language", "kind", "name", "line")


@query(f"SELECT file_path, 'file:' || file_path AS id, 1 + count(line) AS n_nodes FROM (SELECT k || '/' || replace(CASE lang {' '.join(f'WHEN {i} THEN {chr(39)}{_esc(SAMPLES[x][0])}{chr(39)}' for i, x in enumerate(_LANGS))} END, '@', k) AS file_path FROM (SELECT cast(p_partkey AS string) AS k, p_partkey % {len(_LANGS)} AS lang FROM part)) LEFT JOIN ({_expected(2).replace(chr(114) + 'eplace(k || ' + chr(39) + '/' + chr(39) + ' || v.path, ' + chr(39) + '@' + chr(39) + ', k)', 'k || ' + chr(39) + '/' + chr(39) + ' || replace(v.path, ' + chr(39) + '@' + chr(39) + ', k)')}) e USING (file_path) GROUP BY 1", with_graph=False)
def extract_files(spark, sf_dir):
    nodes, _, _, listed = extract.tables(extract.extract(_tree(spark, sf_dir)))
    own = nodes.filter("kind = 'file'").select("file_path", "id")
    return listed.select(C("path").alias("file_path"), C("node_count").cast("long").alias("n_nodes")).join(own, "file_path")


@query("SELECT p_partkey AS k, CASE WHEN p_size > 30 AND p_type <> 'ECONOMY' THEN 'large' ELSE 'read' END AS what FROM part", with_graph=False)
def size_gate(spark, sf_dir):
    listing = P.table(spark, sf_dir, "part").select(C("p_partkey").alias("k"), C("p_size").alias("size"), F.when(C("p_type") == "ECONOMY", "unknown").otherwise("go").alias("language"))
    small, large = files.size_gate(listing, 30)
    return small.select("k", F.lit("read").alias("what")).unionByName(large.select("k", F.lit("large").alias("what")))


_RULES = "# notes\n*.go\n!src/core/*.go\n/app/\nvendor\nlib/test_*.py\n**/generated/**\nm/?mall*.dart\n"


@query(
    f"WITH symbols AS ({P.plain(P.SYMBOLS)}) SELECT id, file_path, CASE WHEN regexp_matches(file_path, '^m/.mall[^/]*[.]dart$') OR regexp_matches(file_path, '(^|/)generated/') OR regexp_matches(file_path, '^lib/test_[^/]*[.]py$') OR regexp_matches(file_path, '(^|/)vendor(/|$)') OR starts_with(file_path, 'app/') THEN TRUE "
    "WHEN regexp_matches(file_path, '^src/core/[^/]*[.]go$') THEN FALSE ELSE ends_with(file_path, '.go') END AS ignored FROM symbols",
    with_graph=False,
)
def ignore_rules(spark, sf_dir):
    return P.symbols(spark, sf_dir).select("id", "file_path", files.ignored(C("file_path"), files.ignore_rules(_RULES)).alias("ignored"))


@query(f"WITH symbols AS ({P.plain(P.SYMBOLS)}) SELECT id FROM symbols WHERE NOT regexp_matches(file_path, '(^|/)(vendor|build|dist|target|node_modules|out|obj)/')", with_graph=False)
def default_ignores(spark, sf_dir):
    return P.symbols(spark, sf_dir).filter(~files.ignored_by_default(C("file_path"))).select("id")


_BLOCKS = "SELECT 'pkg/f' || cast(l_partkey % 50 AS string) || '.go' AS file, cast(l_orderkey % 400 + 1 AS integer) AS s, cast(l_orderkey % 400 + 1 + l_linenumber AS integer) AS e, cast(l_quantity AS integer) % 4 AS n FROM lineitem"
_COVER = f"lines AS (SELECT file, line, bool_or(n > 0) AS hit FROM (SELECT file, unnest(range(s, e + 1)) AS line, n FROM ({_BLOCKS})) GROUP BY 1, 2)"


def _profile(spark, sf_dir):
    rows = P.table(spark, sf_dir, "lineitem")
    s = C("l_orderkey") % 400 + 1
    text = F.concat(F.lit("pkg/f"), (C("l_partkey") % 50).cast("string"), F.lit(".go:"), s.cast("string"), F.lit(".3,"), (s + C("l_linenumber")).cast("string"), F.lit(".9 2 "), (C("l_quantity").cast("int") % 4).cast("string"))
    return rows.select(text.alias("value")).unionByName(spark.createDataFrame([("mode: set",), ("",)], "value string"))


@query(f"WITH {_COVER} SELECT file, line::INTEGER AS line, hit FROM lines", with_graph=False)
def coverage_profile(spark, sf_dir):
    return coverage.block_lines(coverage.profile_blocks(_profile(spark, sf_dir)))


@query(f"WITH {_COVER} SELECT file, count(*) FILTER (WHERE hit) AS covered, count(*) FILTER (WHERE NOT hit) AS uncovered, count(*) FILTER (WHERE FALSE) AS bad FROM lines GROUP BY file", with_graph=False)
def coverage_ranges(spark, sf_dir):
    made = coverage.file_coverage(coverage.block_lines(coverage.profile_blocks(_profile(spark, sf_dir))))
    bad = coverage.violations(made).groupBy("file").agg(F.count("*").alias("bad"))
    return made.select("file", "covered", "uncovered").join(bad, "file", "left").withColumn("bad", F.coalesce("bad", F.lit(0)).cast("long"))


_SPANS = "spans AS (SELECT 'pkg/f' || cast(p_partkey % 50 AS string) || '.go' AS file, p_partkey AS id, p_partkey % 300 + 1 AS s, p_partkey % 300 + 1 + p_size AS e FROM part)"


@query(
    f"""WITH {_COVER}, {_SPANS}, own AS (SELECT id, hit FROM (SELECT s.id, l.hit, row_number() OVER (PARTITION BY l.file, l.line ORDER BY s.e - s.s, s.id) AS k FROM lines l JOIN spans s ON s.file = l.file AND l.line BETWEEN s.s AND s.e) WHERE k = 1)
SELECT id, count(*) FILTER (WHERE hit) AS covered, count(*) FILTER (WHERE NOT hit) AS uncovered, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6)::DOUBLE AS pct FROM own GROUP BY id""",
    with_graph=False,
)
def coverage_by_node(spark, sf_dir):
    k = C("p_partkey")
    spans = P.table(spark, sf_dir, "part").select(F.concat(F.lit("pkg/f"), (k % 50).cast("string"), F.lit(".go")).alias("file"), k.alias("id"), (k % 300 + 1).alias("start"), (k % 300 + 1 + C("p_size")).alias("end"))
    return coverage.node_coverage(coverage.block_lines(coverage.profile_blocks(_profile(spark, sf_dir))), spans)


@query(f"WITH {_COVER}, tracked AS (SELECT DISTINCT 'f' || cast(p_partkey % 30 AS string) || '.go' AS path FROM part) SELECT replace(file, 'pkg/', '') AS file, count(*) AS n, replace(file, 'pkg/', '') IN (SELECT path FROM tracked) AS known FROM lines GROUP BY file", with_graph=False)
def coverage_ingest(spark, sf_dir):
    tracked = P.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (C("p_partkey") % 30).cast("string"), F.lit(".go")).alias("path")).distinct()
    lines = cut_lineage(coverage.block_lines(coverage.profile_blocks(_profile(spark, sf_dir))))  # read three times
    own, unknown = coverage.ingest(lines, tracked, "pkg")
    rest = lines.join(unknown, "file").select(F.regexp_replace("file", "^pkg/", "").alias("file"))
    return own.groupBy("file").agg(F.count("*").alias("n")).withColumn("known", F.lit(True)).unionByName(rest.groupBy("file").agg(F.count("*").alias("n")).withColumn("known", F.lit(False)))


_OLD = "SELECT doc_id, cast(doc_id AS string) AS path, n_chars AS size, doc_id * 10 AS modified_at, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0"
_NEW = "SELECT doc_id, cast(doc_id AS string) AS path, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 5 = 0 THEN doc_id * 10 + 1 ELSE doc_id * 10 END AS modified_at, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0"


def _two(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents")
    k = C("doc_id")
    text = F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(C("text"))
    old = d.filter(k % 13 != 0).select(k.cast("string").alias("path"), C("n_chars").alias("size"), (k * 10).alias("modified_at"), F.sha2("text", 256).alias("hash"))
    return old, d.filter(k % 11 != 0).select(k.cast("string").alias("path"), F.when(k % 7 == 0, C("n_chars") + 1).otherwise(C("n_chars")).alias("size"), F.when(k % 5 == 0, k * 10 + 1).otherwise(k * 10).alias("modified_at"), F.sha2(text, 256).alias("hash"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT count(*) FILTER (WHERE o.path IS NULL) AS added, count(*) FILTER (WHERE o.hash <> n.hash) AS modified, count(*) FILTER (WHERE n.path IS NULL) AS removed FROM o FULL JOIN n ON o.path = n.path", with_graph=False)
def sync_counts(spark, sf_dir):
    return sync.pending_counts(*_two(spark, sf_dir))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT n.path FROM n LEFT JOIN o ON o.path = n.path WHERE o.path IS NULL OR o.size <> n.size OR o.modified_at <> n.modified_at", with_graph=False)
def sync_touched(spark, sf_dir):
    return sync.touched(*_two(spark, sf_dir))


@query("SELECT e.user_id::VARCHAR AS path, min(ts) AS first_seen, max(ts) AS last_seen FROM events e GROUP BY 1 HAVING max(ts) > (SELECT max(ts) - INTERVAL 2 DAY FROM events)", with_graph=False)
def pending_state(spark, sf_dir):
    events = P.table(spark, sf_dir, "events").select(C("user_id").cast("string").alias("path"), "ts")
    last = events.agg(F.max("ts").alias("m")).first()["m"]
    return sync.pending(events, F.lit(last) - F.expr("INTERVAL 2 DAYS"))


@query("SELECT p_partkey AS k, array_to_string(list_slice(string_split('a' || chr(10) || p_name || chr(10) || p_brand || chr(10) || 'z', chr(10)), 1 + p_partkey % 3, 1 + p_partkey % 3 + 1), chr(10)) AS part FROM part", with_graph=False)
def source_slices(spark, sf_dir):
    text = F.concat_ws("\n", F.lit("a"), "p_name", "p_brand", F.lit("z"))
    at = (1 + C("p_partkey") % 3).cast("int")
    return P.table(spark, sf_dir, "part").select(C("p_partkey").alias("k"), files.source_slice(text, at, at + 1).alias("part"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'parse' WHEN 1 THEN 'json' ELSE 'database' END AS code, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1", with_graph=False)
def error_breakdown(spark, sf_dir):
    code = F.element_at(F.array(F.lit("parse: "), F.lit("json: "), F.lit("database: ")), (C("p_partkey") % 3 + 1).cast("int"))
    bundles = P.table(spark, sf_dir, "part").select(F.when(C("p_size") > 10, F.array(F.concat(code, "p_name"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    return extract.error_counts(bundles)
