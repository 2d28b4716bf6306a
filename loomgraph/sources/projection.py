"""A property graph projected from star-schema tables, in the engine's node and edge layout.

The same SQL text serves Spark (tables given as ``{name}``) and any ANSI engine (plain names)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()

_NODE = "SELECT {id} AS id, '{kind}' AS kind, {name} AS name, {path} AS file_path, '{lang}' AS language, cast({key} + 1 AS bigint) AS start_line, cast({key} + 10 AS bigint) AS end_line FROM {src}"


def _node(prefix: str, kind: str, name: str, path: str, lang: str, key: str, src: str) -> str:
    return _NODE.format(id=f"'{prefix}:' || cast({key} AS string)", kind=kind, name=name, path=path, lang=lang, key=key, src=src)


NODES = "\nUNION ALL ".join(
    [
        _node("region", "namespace", "r_name", "'geo/' || r_name || '/index.src'", "geo", "r_regionkey", "{region}"),
        _node("nation", "module", "n_name", "'geo/' || r_name || '/' || n_name || '.src'", "geo", "n_nationkey", "{nation} JOIN {region} ON n_regionkey = r_regionkey"),
        _node("customer", "class", "c_name", "'geo/' || r_name || '/' || n_name || '.src'", "geo", "c_custkey", "{customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"),
        _node("supplier", "struct", "s_name", "'geo/' || r_name || '/' || n_name || '.src'", "geo", "s_suppkey", "{supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"),
        _node("part", "interface", "p_name", "'catalog/' || p_brand || '.src'", "catalog", "p_partkey", "{part}"),
        _node("order", "function", "'order_' || cast(o_orderkey AS string)", "'sales/' || o_orderpriority || '.src'", "sales", "o_orderkey", "{orders}"),
    ]
)
_EDGE = "SELECT '{a}:' || cast({x} AS string) AS source, '{b}:' || cast({y} AS string) AS target, '{kind}' AS kind, cast({line} AS bigint) AS line FROM {src}"
EDGES = "\nUNION ALL ".join(
    _EDGE.format(a=a, x=x, b=b, y=y, kind=kind, line=line, src=src)
    for a, x, b, y, kind, line, src in (
        ("region", "n_regionkey", "nation", "n_nationkey", "contains", "n_nationkey", "{nation}"),
        ("nation", "c_nationkey", "customer", "c_custkey", "contains", "c_custkey", "{customer}"),
        ("nation", "s_nationkey", "supplier", "s_suppkey", "contains", "s_suppkey", "{supplier}"),
        ("order", "l_orderkey", "part", "l_partkey", "calls", "l", "(SELECT l_orderkey, l_partkey, min(l_linenumber) AS l FROM {lineitem} GROUP BY l_orderkey, l_partkey) c"),
        ("customer", "o_custkey", "order", "o_orderkey", "references", "o_orderkey", "{orders}"),
        ("part", "l_partkey", "supplier", "l_suppkey", "imports", "l_suppkey", "(SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) i"),
        ("part", "p_partkey", "part", "(p_partkey * 7 + 1) % (SELECT count(*) FROM {part})", "extends", "p_partkey", "{part}"),
    )
)


PATHS = (
    "src/core/#.go", "src/core/anvil_#.go", "src/anvil/#.py", "src/api/#_test.go", "test/#.py", "pkg/tests/#.js", "pkg/#.spec.ts", "lib/test_#.py", "app/AnvilTests/#.swift", "app/#Test.java",
    "gen/#.pb.go", "vendor/x/#.go", "a/vendor/x/#.go", "a/generated/#.ts", "ui/#.generated.ts", "ui/icons/#.tsx", "examples/#.rb", "svc/mock_#.go", "mock_#.go", "svc/#_pb2.py", "svc/#_pb2_grpc.py",
    "m/#.freezed.dart", "m/#Grpc.cs", "db/#.sql", "db/#.sqlite3", "go.mod", "web/package.json", "README#", "e2e/x/e2e/#.ts", "k/#Spec.kt", "h/#.hpp", "i18n/#.json", "svc/#_mocks.go", "deep/../up/./#.rs", "x/#_spec.rb",
)
_KINDS = "function method interface trait protocol route class component type_alias struct enum module namespace property field constant enum_member variable import export file parameter".split()
_CASED = "(upper(substr({0}, 1, 1)) || substr({0}, 2))"
_A, _B = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


def _pick(key: str, values: tuple[str, ...] | list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# names in several cases, of all kinds, in files of all sorts
SYMBOLS = f"""SELECT 'sym:' || cast(p_partkey AS string) AS id, kind, name, file_path, language, cast(p_partkey % 997 + 1 AS bigint) AS start_line, cast(p_partkey % 997 + 1 + p_partkey % 40 AS bigint) AS end_line,
'lib::' || owner || '::' || name AS qualified_name, lower(p_type) || ' part of ' || p_name AS docstring, 'f(' || p_brand || ')' AS signature, p_partkey AS seq
FROM (SELECT *, {_pick("p_partkey", [f"'{k}'" for k in _KINDS])} AS kind, {_CASED.format(_B)} AS owner,
{_pick("p_partkey", [f"{_A} || '_' || {_B}", f"{_CASED.format(_A)} || {_CASED.format(_B)}", f"{_A} || {_CASED.format(_B)}", _B, f"'get' || {_CASED.format(_A)} || {_CASED.format(_B)} || 'Handler'", f"{_B} || '.' || {_A}", f"{_B} || cast(p_partkey % 7 AS string)"])} AS name,
replace({_pick("p_partkey", [f"'{x}'" for x in PATHS])}, '#', lower(p_type) || cast(p_partkey % 90 AS string)) AS file_path, {_pick("p_partkey", ["'go'", "'python'", "'rust'"])} AS language
FROM {{part}}) x"""


def plain(sql: str) -> str:
    """The text for an engine that has the tables as views."""
    return sql.format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """In parts of so many rows by the key, one for each core at least, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows), key)


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    tables["lineitem"] = spread(tables["lineitem"], 500_000, "l_partkey")  # both edges made of it group by parts

    return run(spark, sf_dir, NODES, tables), run(spark, sf_dir, EDGES, tables)


def run(spark: SparkSession, sf_dir: str, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of a projection."""
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: tables[t] if tables else table(spark, sf_dir, t) for t in used})


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread, since a small table is one split and a search reads it again and again."""
    return run(spark, sf_dir, SYMBOLS, {"part": spread(table(spark, sf_dir, "part"), 50_000, "p_partkey")})
