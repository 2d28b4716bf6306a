import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths, words
from loomgraph.operators import context, coverage, graph, resolve, search, sync
from loomgraph.sources import extract, files, recordset
from loomgraph.sources.samples import SAMPLES, source
from loomgraph.sources.store import GraphStore


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_samples(language):
    path, text = source(language, 7)
    b = extract.extract_one(path, language, text.encode())
    fill = lambda rows: sorted((k, n.replace("@", "7"), line) for k, n, line in rows)
    assert sorted((n["kind"], n["name"], n["start_line"]) for n in b.nodes[1:]) == fill(SAMPLES[language][2])
    assert sorted((r["kind"], r["name"], r["line"]) for r in b.refs) == fill(SAMPLES[language][3])
    assert b.nodes[0]["id"] == f"file:{path}" and not b.errors
    known = {n["id"] for n in b.nodes}
    assert all(e["source"] in known and e["target"] in known for e in b.edges)
    assert {e["target"] for e in b.edges if e["kind"] == "contains"} == known - {b.file}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_extractors_take_any_text(language):
    for raw in (b"", b"\n\n", b"\xff\xfe\x00junk", ("{" * 50 + "\n(" * 50).encode(), b'"unclosed /* "', "é class Ä { ".encode()):
        b = extract.extract_one("x/y.z", language, raw)
        assert b.nodes[0]["kind"] == "file"


def test_python_details():
    text = '''"""Doc."""
from a.b import c as d, e
import f
class G(h.I, J):
    """Of G."""
    x: int = 1
    @property
    def p(self): return self.q()
    def __init__(self):
        self.y = K()
@deco(1)
async def fun(a, *b) -> int:
    return super().z(a.b.c())
X_Y = fun(2)
'''
    b = extract.extract_one("m.py", "python", text.encode())
    got = {(n["kind"], n["qualified_name"]) for n in b.nodes[1:]}
    assert got == {("import", "a.b"), ("import", "d"), ("import", "e"), ("import", "f"), ("class", "G"), ("field", "G::x"), ("property", "G::p"), ("method", "G::__init__"), ("field", "G::y"), ("function", "fun"), ("constant", "X_Y")}
    assert {(r["kind"], r["name"]) for r in b.refs} >= {("extends", "I"), ("extends", "J"), ("decorates", "property"), ("decorates", "deco"), ("calls", "q"), ("calls", "K"), ("calls", "b.c"), ("calls", "fun")}
    assert extract.extract_one("m.py", "python", b"def (").errors


def test_go_routes_and_nesting():
    b = extract.extract_one("m.go", "go", b'package m\n\nfunc Run() {\n\tmux.HandleFunc("/a", f)\n\tr.GET("/b/:id", g)\n}\n\ntype T struct{}\n\nfunc (t T) Do() { Run() }\n')
    assert {n["name"] for n in b.nodes if n["kind"] == "route"} == {"ANY /a", "GET /b/:id"}
    do = next(n for n in b.nodes if n["name"] == "Do")
    assert do["qualified_name"] == "T::Do" and do["is_exported"]
    assert sum(e["target"] == do["id"] for e in b.edges) == 2  # by the file and by the type


def test_databases(tmp_path):
    at = tmp_path / "x.db"
    con = sqlite3.connect(at)
    con.executescript("CREATE TABLE a (id INTEGER PRIMARY KEY, n TEXT UNIQUE CHECK (length(n) > 1), b_id INT REFERENCES b(id)); CREATE TABLE b (id INTEGER PRIMARY KEY) STRICT; CREATE INDEX i ON a (n); CREATE VIEW v AS SELECT * FROM a JOIN b ON 1; CREATE TRIGGER t AFTER INSERT ON a BEGIN DELETE FROM b; END; INSERT INTO a VALUES (1, 'xx', 2);")
    con.close()
    b = extract.extract_one("x.db", "sqlite", at.read_bytes())
    got = {(n["kind"], n["name"]) for n in b.nodes[1:]}
    assert got == {("struct", "a"), ("struct", "b"), ("struct", "v"), ("field", "a.id"), ("field", "a.n"), ("field", "a.b_id"), ("field", "b.id"), ("field", "v.id"), ("field", "v.n"), ("field", "v.b_id"), ("field", "v.id:1")} | {
        ("constraint", "a.pk"), ("constraint", "b.pk"), ("constraint", "a.unique_n"), ("constraint", "a.check_1"), ("constraint", "a.fk_b_id"), ("index", "i"), ("trigger", "t")}
    assert {r["name"] for r in b.refs} == {"b", "b.id", "a.n", "a"}
    assert dict(next(n for n in b.nodes if n["name"] == "a")["metadata"])["rowCount"] == "1"
    assert extract.extract_one("x.db", "sqlite", b"nonsense").errors


def test_manifest_edges():
    path, text = source("go.mod", 3)
    b = extract.extract_one(path, "go.mod", text.encode())
    assert [(e["kind"], dict(e["metadata"])) for e in b.edges if e["provenance"]] == [("requires", {"version": "v1.2.0"}), ("requires", {"version": "v0.1.0", "indirect": "true"})]
    path, text = source("package.json", 3)
    b = extract.extract_one(path, "package.json", text.encode())
    assert [dict(e["metadata"])["category"] for e in b.edges if e["provenance"]] == ["prod", "dev"]


def test_scan_layers_ignore_files(spark, tmp_path):
    for name, text in {".gitignore": "*.log\n/gen/\n!keep.log\n", "a.py": "x = 1\n", "b.log": "", "keep.log": "", "gen/c.py": "", "sub/gen/d.py": "", "sub/.gitignore": "e.py\n", "sub/e.py": "", "e.py": "", "node_modules/f.js": "", "h.h": "@interface A\n@end\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: r["language"] for r in files.scan(spark, f"file://{tmp_path}").collect()}
    assert got == {".gitignore": "unknown", "a.py": "python", "keep.log": "unknown", "sub/gen/d.py": "python", "sub/.gitignore": "unknown", "e.py": "python", "h.h": "objc"}
    assert files.git_listing(str(tmp_path)) == []


def test_extract_in_spark_bounds_files(spark):
    rows = [("a.py", "python", bytearray(b"def f(): g()")), ("b.py", "python", bytearray(b"#" * 2000)), ("c.bin", "unknown", None), ("d.py", "python", bytearray(b"def ("))]
    bundles = extract.extract(spark.createDataFrame(rows, "path string, language string, content binary"), max_bytes=1000)
    nodes, edges, refs, listed = extract.tables(bundles)
    assert {(r["path"], r["node_count"], len(r["errors"])) for r in listed.collect()} == {("a.py", 2, 0), ("b.py", 1, 1), ("c.bin", 1, 0), ("d.py", 1, 1)}
    assert edges.count() == 1 and refs.first()["name"] == "g"
    assert extract.error_counts(bundles).count() == 2
    assert extract.extract(bundles.select("path", "language", F.lit(b"").alias("content")).limit(0)).count() == 0


def test_recordsets_round_trip(spark, tmp_path):
    rows = [("b", 2, None, [1, 2], "py"), ("a", 1, 'x "y"\né', [], "py"), ("c", None, "", None, "go")]
    df = spark.createDataFrame(rows, "id string, line int, doc string, more array<int>, scope_key string")
    for n in (1, 3):
        assert recordset.write_recordset(df.repartition(n).drop("scope_key"), f"file://{tmp_path}/r{n}.rec", "things", "id", ("gz", "zst")) == 3
    assert (tmp_path / "r1.rec").read_bytes() == (tmp_path / "r3.rec").read_bytes()
    text = (tmp_path / "r1.rec").read_text()
    assert text.split("\n")[0] == "# RECORDS | things: $ID, line:int, doc, more" and text.rstrip().endswith("# 3 records")
    for name in ("r1.rec", "r1.rec.gz", "r1.rec.zst"):
        back = recordset.read_recordset(spark, f"file://{tmp_path}/{name}", "id string, line int, doc string, more array<int>, extra string")
        assert sorted((r["id"], r["line"], r["doc"], r["more"], r["extra"]) for r in back.collect()) == [("a", 1, 'x "y"\né', [], None), ("b", 2, None, [1, 2], None), ("c", None, "", None, None)]
    assert recordset.read_recordset(spark, f"file://{tmp_path}/none.rec", "id string").count() == 0
    with pytest.raises(FileNotFoundError):
        recordset.read_recordset(spark, f"file://{tmp_path}/none.rec", "id string", required=True)
    with pytest.raises(ValueError):
        recordset.parse_recordset("# R | a: $ID\n1\n# 2 records\n")
    manifest = recordset.export_scoped(spark, {"things": (df, "id")}, f"file://{tmp_path}/out", "main")
    assert [(s["scope"], s["counts"]) for s in manifest["scopes"]] == [("go", {"things": 1}), ("py", {"things": 2})]
    assert json.loads((tmp_path / "out/manifest.json").read_text()) == manifest


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/s")
    node = lambda i, f: (i, "function", i, "", f, "go")
    store.put_nodes(spark.createDataFrame([node("a", "f"), node("b", "g"), node("", "g")], "id string, kind string, name string, qualified_name string, file_path string, language string"))
    store.add_edges(spark.createDataFrame([("a", "b", "calls", 1), ("a", "z", "calls", 2)], "source string, target string, kind string, line int"))
    assert {r["id"]: r["qualified_name"] for r in store.read("nodes").collect()} == {"a": "a", "b": "b"} and store.read("edges").count() == 1
    store.put_node_coverage(spark.createDataFrame([("a", 1, 2), ("z", 1, 1)], "node_id string, lines_covered int, lines_uncovered int"))
    store.set_metadata(x="1", y="2")
    store.set_metadata(x="3")
    assert store.get_metadata("x") == "3" and store.get_metadata("y") == "2" and store.get_metadata("z") is None
    store.delete_files(spark.createDataFrame([("f",)], "path string"))
    assert [r["id"] for r in store.read("nodes").collect()] == ["b"] and store.read("edges").count() == 0 == store.read("node_coverage").count()
    assert store.lock("me") and store.lock("me") and not store.lock("you") and store.lock("you", stale_s=-1)
    store.unlock()
    store.clear()
    assert store.status()["fileCount"] == 0


def test_query_language():
    q = search.parse('kind:function  lang:Go path:"a b" name:X foo kind:nonsense zzz: :x "quoted words" language:bash open"')
    assert q == search.Query('foo kind:nonsense zzz: :x "quoted words" open"', ("function",), ("go", "bash"), ("a b",), ("X",))
    assert search.phrases("user_orders AND a::B 'x'* (y)") == [["user", "orders"], ["a"], ["b"], ["x"], ["y"]]
    assert search.parse("") == search.Query()


def test_published_score(spark):
    """The score of a small schema's table by its name, as the formula gives it: 9 nodes of 5 columns."""
    nodes = [("f1", "file", "schema.sql", "schema.sql"), ("f2", "file", "queries.sql", "queries.sql"), ("t1", "struct", "users", "users"), ("c1", "field", "id", "users::id"), ("c2", "field", "name", "users::name"), ("t2", "struct", "orders", "orders"), ("c3", "field", "id", "orders::id"), ("c4", "field", "user_id", "orders::user_id"), ("v", "struct", "user_orders", "user_orders")]
    df = spark.createDataFrame([(i, k, n, q, None, None, "db.sql", "sql", 1) for i, k, n, q in nodes], "id string, kind string, name string, qualified_name string, docstring string, signature string, file_path string, language string, start_line int")
    top = search.search(df, "users").orderBy("rank").collect()
    assert top[0]["id"] == "t1" and top[0]["score"] > 86
    none = search.search(df.limit(0), "users")
    assert none.count() == 0


def test_globs_and_paths():
    import re

    m = lambda g, p: bool(re.search(paths.glob_pattern(g), p))
    assert m("src/**/*.go", "src/a/b/c.go") and m("src/**/*.go", "src/c.go") and not m("src/*.go", "src/a/c.go") and m("a?.p(y)", "ab.p(y)") and not m("*.go", "x/y.go")
    assert words.stems("running") == ["run", "runn", "runne"] and words.camel_split("HTTPServerName") == "HTTP Server Name"


def test_traversals_on_small_graphs(spark):
    kinds = {"M": "module", "m1": "function", "m2": "class", "k": "function", "u": "function", "w": "function", "n": "namespace", "p": "function"}
    nodes = spark.createDataFrame([(i, k, i, "f.x", 1) for i, k in kinds.items()], "id string, kind string, name string, file_path string, start_line int")
    pairs = [("M", "m1", "contains"), ("M", "m2", "contains"), ("m2", "k", "contains"), ("u", "k", "calls"), ("w", "u", "calls"), ("n", "p", "contains"), ("u", "u", "calls"), ("M", "M", "contains")]
    edges = spark.createDataFrame([(*p, 1) for p in pairs], "source string, target string, kind string, line int")
    seed = lambda *ids: nodes.filter(F.col("id").isin(*ids))
    depth = lambda df: {r["id"]: r["depth"] for r in df.collect()}
    assert depth(graph.impact(nodes, edges, seed("M"), 1)) == {"M": 0, "m1": 0, "m2": 0, "k": 0, "u": 1}
    assert depth(graph.impact(nodes, edges, seed("M"), 99)) == {"M": 0, "m1": 0, "m2": 0, "k": 0, "u": 1, "w": 2}
    assert depth(graph.impact(nodes, edges, seed("n"), 2)) == {"n": 0} and graph.impact(nodes, edges, seed("none"), 2).count() == 0
    own = nodes.select("id", F.lit(1).alias("x"))
    assert {r["id"]: r["x"] for r in graph.rollup(edges, own, ["x"]).collect()}["M"] == 4
    chain = spark.createDataFrame([(a, b, "calls", 1) for a, b in (("a", "x"), ("x", "b"), ("b", "c"), ("a", "c"), ("c", "y"), ("y", "z"), ("z", "d"))], "source string, target string, kind string, line int")
    named = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert [r["id"] for r in graph.flow_path(chain, named).orderBy("ord").collect()] == ["a", "x", "b"]
    assert graph.flow_path(chain.limit(0), named).count() == 0
    uses = spark.createDataFrame([("t_test.go", "a.go"), ("b.go", "a.go"), ("c_test.go", "b.go"), ("d_test.go", "t_test.go"), ("a.go", "b.go")], "from_file string, to_file string")
    changed = spark.createDataFrame([("a.go",), ("z_test.go",)], "file string")
    assert {r["file"]: r["distance"] for r in graph.affected_tests(uses, changed, paths.is_affected_test).collect()} == {"t_test.go": 1, "c_test.go": 2, "z_test.go": 0}


def test_explore_order_has_a_tolerance():
    rows = [{"file_path": "a", "graph": 1.0, "n_terms": 1}, {"file_path": "b", "graph": 0.995, "n_terms": 2}, {"file_path": "c", "graph": 0.5, "seed": 1}, {"file_path": "d", "graph": 0.2, "low_value": 1}]
    assert [r["file_path"] for r in context.explore_order(rows)] == ["c", "b", "a", "d"]


def test_operators_take_empty_tables_and_nulls(spark):
    lines = spark.createDataFrame([], "file string, line int, hit boolean")
    assert coverage.file_coverage(lines).count() == 0 and coverage.runs(lines).count() == 0
    assert coverage.profile_blocks(spark.createDataFrame([(None,), ("x",)], "value string")).count() == 0
    listing = spark.createDataFrame([(None, "h"), ("a", None)], "path string, hash string")
    assert sync.diff(listing, listing.limit(0)).filter("change = 'removed'").count() == 1
    refs = spark.createDataFrame([("r", "x", None, "calls", "f", "go"), ("s", None, "f", "calls", None, None)], "ref_id string, from_node string, name string, kind string, file_path string, language string")
    nodes = spark.createDataFrame([("n", "function", "f", "f", "f", "go", 1, None)], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, signature string")
    edges = spark.createDataFrame([], "source string, target string, kind string, line int")
    assert resolve.resolve(refs, nodes, edges).count() == 0 and resolve.resolve(refs.limit(0), nodes.limit(0), edges).count() == 0
    bad = spark.createDataFrame([("f", [(5, 4, "hit")], 0, 0), ("g", [(1, 2, "hit"), (2, 3, "miss")], 2, 2), ("h", [(1, 2, "hit"), (3, 3, "miss")], 2, 1), ("i", [], 0, 0)], "file string, ranges array<struct<start:int,end:int,kind:string>>, covered int, uncovered int")
    assert sorted(r["file"] for r in coverage.violations(bad).collect()) == ["f", "g"]


def test_generated_trees_are_spread(spark):
    """A small table of parts is one split, yet its files are extracted by several tasks."""
    from loomgraph.plans import source_queries

    assert source_queries._tree(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 20_000 // 4096
    assert source_queries._tree(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1
