import duckdb
import numpy as np
import pytest

from loomgraph.plans import catalogue
from loomgraph.sources import projection

SF = "/root/testdata/sf0.001"
# every query but the slowest, which are checked at one size larger by hand: several walks or rankings each
SLOW = {"callers_first_edge", "callees_of_symbol", "impact_of_symbol", "pagerank_rwr", "file_graph_score", "resolve_strategies", "resolve_tiers", "resolve_veto", "search_pipeline"}
NAMES = sorted(set(catalogue.ORACLES) - SLOW)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in projection.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    show = lambda rows: sorted(tuple(repr(round(float(v), 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(got.select(*columns).collect()) == show(want.fetchall())


def test_pagerank_keeps_mass(spark):
    from loomgraph.operators.graph import pagerank

    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    got = {r["id"]: r["mass"] for r in pagerank(nodes, edges, nodes.filter("id = 'a'"), rounds=6).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["b"] > got["c"] == 0


def test_without_corpus_operators(tmp_path):
    """The rest imports and answers with both folders and the pipeline deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "loomgraph", tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op1_') or k == 'pipeline' for k in q); print('ok')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.stdout.strip() == "ok", done.stderr


def test_registered_walk_equals_numpy(spark):
    nodes, edges = projection.graph(spark, SF)
    number = {r["id"]: i for i, r in enumerate(nodes.select("id").collect())}
    ends = edges.filter("kind != 'contains'").select("source", "target").collect()
    a, b = (np.array([number[r[k]] for r in ends]) for k in ("source", "target"))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    degree = np.bincount(a, minlength=len(number))
    start = np.zeros(len(number))
    start[number[catalogue.HUB]] = 1
    mass = start
    for _ in range(25):
        moved = np.bincount(b, mass[a] / degree[a], len(number)) + np.where(degree == 0, mass, 0)
        mass = 0.25 * start + 0.75 * moved
    got = {r["id"]: r["mass"] for r in catalogue.QUERIES["pagerank_rwr"](spark, SF).collect()}
    assert set(got) == set(number) and max(abs(got[k] - mass[i]) for k, i in number.items()) < 1e-6
    assert abs(sum(got.values()) - 1) < 1e-2


def test_walk_in_parts_leaves_little_on_disk(spark, monkeypatch):
    """Several parts and shuffles give the masses of the plain sums; what stays in the shared folder is no larger than the answer."""
    from pathlib import Path

    from loomgraph.operators import graph, lineage, walk

    monkeypatch.setattr(walk, "PART", 3_000)
    monkeypatch.setattr(walk, "SLICE", 7_000)
    ends = np.random.default_rng(5).integers(0, 2_000, (8_000, 2))
    ends[:40] = 7  # loops and repeats
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(2_010)], "id string")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in ends.tolist()], "source string, target string")
    folder = Path(lineage.checkpoint_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    for seeds in ("id = 'n3' or id = 'n2005'", "id = 'absent'"):
        got = {int(r["id"][1:]): r["mass"] for r in graph.pagerank(nodes, edges, nodes.filter(seeds), rounds=9).collect()}
        a, b = np.concatenate([ends, ends[:, ::-1]]).T
        degree = np.bincount(a, minlength=2_010)
        start = np.zeros(2_010)
        start[[3, 2005] if "n3" in seeds else slice(None)] = 0.5 if "n3" in seeds else 1 / 2_010
        mass = start
        for _ in range(9):
            mass = 0.25 * start + 0.75 * (np.bincount(b, mass[a] / degree[a], 2_010) + np.where(degree == 0, mass, 0))
        assert len(got) == 2_010 and max(abs(got[i] - mass[i]) for i in got) < 1e-12
    assert size() - before < 2 * 2_010 * 60


def test_hierarchy_of_many_levels(spark, monkeypatch):
    """Links are joined until few are left: fewer jobs than levels; trees, cycles and knots keep their least depths."""
    from collections import deque

    from loomgraph.operators import distance, graph

    rng = np.random.default_rng(3)
    knot = [(int(a), int(b)) for a, b in rng.integers(2000, 2020, (80, 2))] + [(2000, 30), (50, 2000)]
    pairs = [(i, i + 1) for i in range(300)] + [(300, 0)] + [(1000 + i, 1000 + (i - 1) // 2) for i in range(1, 100)] + [(1000, 290)] + knot
    links = [(f"n{a}", f"n{b}") for a, b in pairs]
    seeds = ["n7", "n1005", "n7", "lone"]

    def plain(pairs):
        step = {}
        for a, b in pairs:
            step.setdefault(a, []).append(b)
        depth, todo = dict.fromkeys(seeds, 0), deque(dict.fromkeys(seeds))
        while todo:
            x = todo.popleft()
            for y in step.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    todo.append(y)
        return {(x, d) for x, d in depth.items()}

    start = spark.createDataFrame([(x,) for x in seeds], "id string")
    edges = spark.createDataFrame([(a, b, "extends") for a, b in links], "source string, target string, kind string")
    monkeypatch.setattr(distance, "LOCAL", 150)
    group = "hierarchy of many levels"
    spark.sparkContext.setJobGroup(group, group)
    got = [tuple(r) for r in graph.reach(edges, start, None).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(set(got)) and set(got) == plain(links) and jobs < 300
    monkeypatch.setattr(distance, "LOCAL", 10**6)
    got = [tuple(r) for r in graph.hierarchy(edges, start).collect()]
    up, down = plain(links), plain([(b, a) for a, b in links])
    assert sorted(got) == sorted((x, side, d) for side, found in (("ancestor", up), ("descendant", down)) for x, d in found if d)
    # where nothing can be joined, round by round
    seeds = ["n2003"]
    own = edges.filter("source rlike '^n20..$' and target rlike '^n20..$'").selectExpr("source as a", "target as b", "1 as w")
    got = [tuple(r) for r in distance._relaxed(own, spark.createDataFrame([("n2003",)], "id string")).collect()]
    assert sorted(got) == sorted(plain([(a, b) for a, b in links if len(a) == len(b) == 5 and a[1] == b[1] == "2"]))


def most_rows(df):
    """The most rows that a node of the plan that ran gave."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        x = todo.pop()
        inner = [getattr(x, f)() for kind, f in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan")) if x.getClass().getSimpleName().endswith(kind)]
        todo += inner + [x.children().apply(i) for i in range(x.children().size())]
        got = x.metrics().get("numOutputRows")
        most = max(most, got.get().value() if got.isDefined() else 0)
    return most


def test_references_meet_no_pairs(spark):
    """Of a name that all use, references and candidates grow each by itself; rows between them don't grow with the product."""
    from loomgraph.operators import resolve

    n = 600
    nodes = [(f"{lang}:{i}", "method", "go", "Base::go", f"core/pool/f{i % 3}.src", lang, i + 1, "") for lang in ("go", "cpp") for i in range(n)]
    nodes += [("own", "class", "Own", "Own", "a/b.src", "cpp", 1, ""), ("base", "class", "Base", "Base", "a/b.src", "cpp", 2, "")]
    nodes += [(f"i{i}", "import", "x", "x", "lib/a.src", "go", i + 1, "p=core/pool") for i in range(n)]
    refs = [(f"{lang}:r{i}", f"from{i}", name, "calls", "lib/a.src", lang) for lang, name in (("go", "p.go"), ("go", "corePool.go"), ("cpp", "Own::go")) for i in range(n)]
    refs = [(f"{name}:{r}", *rest) for r, *rest in refs for name in [rest[1]]]
    refs = spark.createDataFrame(refs, "ref_id string, from_node string, name string, kind string, file_path string, language string")
    nodes = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, signature string")
    edges = spark.createDataFrame([("own", "base", "extends", 1)], "source string, target string, kind string, line int")
    got = resolve.resolve(refs, nodes, edges)
    found = {}
    for r in got.collect():
        found.setdefault((r["ref_id"].rpartition(":")[0].rpartition(":")[0], r["strategy"], r["target"]), []).append(r["ref_id"])
    assert {k: len(v) for k, v in found.items()} == {("p.go", "alias", "go:0"): n, ("corePool.go", "overlap", "go:0"): n, ("Own::go", "inherited", "cpp:0"): n}
    assert most_rows(got) < 20 * n


def test_spans_of_the_same_lines_meet_lines_once(spark):
    from loomgraph.operators import coverage

    lines = spark.createDataFrame([("f", i, i % 2 == 0) for i in range(1, 101)], "file string, line int, hit boolean")
    spans = spark.createDataFrame([("f", i, 1, 100) for i in range(2_000)] + [("f", 3_000 + i, 5, 10) for i in range(500)], "file string, id long, start long, end long")
    got = coverage.node_coverage(lines, spans)
    assert sorted((r["id"], r["covered"], r["uncovered"]) for r in got.collect()) == [(0, 47, 47), (3_000, 3, 3)]
    assert most_rows(got) < 5_000


def test_profile_of_many_runs(spark):
    """A block's lines are listed once however often it stands there; names may hold colons and blanks, lines that don't fit are left out."""
    from loomgraph.operators import coverage

    odd = [("a b:1.2,3.4 c.go:2.1,3.5 7 0",), ("x.go:1.1,2.2 1 9\n",), (":1.1,2.2 1 1",), ("x.go:1.1,2.2 1",), ("x.go:1.1,2.2  1 1",), ("mode: set",), ("",), (None,), ("x.go:9.1,8.2 1 1",)]
    rows = spark.createDataFrame(odd + [("y.go:1.1,100.2 3 0",)] * 4_000 + [("y.go:1.1,100.2 3 1",)], "value string")
    blocks = coverage.profile_blocks(rows)
    assert sorted(tuple(r) for r in blocks.filter("file != 'y.go'").collect()) == [("a b:1.2,3.4 c.go", 2, 3, 7, 0), ("x.go", 1, 2, 1, 9), ("x.go", 9, 8, 1, 1)]
    got = coverage.block_lines(blocks)
    assert {(r["file"], r["line"], r["hit"]) for r in got.collect()} == {("a b:1.2,3.4 c.go", i, False) for i in (2, 3)} | {("x.go", i, True) for i in (1, 2)} | {("y.go", i, True) for i in range(1, 101)}
    assert most_rows(got) < 10_000


def test_lines_are_spread_by_their_number(spark):
    """What a task of the edges' sums holds is bounded by rows in a part, not by the splits and shuffles that a session happens to have."""
    parts = spark.read.parquet("/root/testdata/sf0.1/part.parquet")
    assert projection.spread(parts, 1_000, "p_partkey").rdd.getNumPartitions() == 20
    assert projection.spread(parts, 10**6, "p_partkey").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = projection.graph(spark, SF)[1].filter("kind = 'calls'")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert projection.symbols(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
