"""Resolution of textual references: strategies as data, compiled to equi-joins.

A strategy looks candidates up by language and name.  A reference never meets all its candidates: these are reduced
first to the best of each name in a file, in a folder and overall, so a name that everybody uses costs one row for each of
them and not references times candidates."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import dir_name
from loomgraph.operators.lineage import cut_lineage


def proximity(refs: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """The best candidate of each reference with the same ``key``: of its file (100), else of its folder (50), else any (0), first by file, line and
    id; ``n_candidates`` with the key.  refs: ref_id, file_path and the key; nodes: id, file_path, start_line and the key."""
    place = F.struct("file_path", "start_line", "id")
    c = nodes.withColumn("folder", dir_name(F.col("file_path")))
    best = lambda *by: c.groupBy(*key, *by).agg(F.min(place).alias("b"))
    any_ = c.groupBy(*key).agg(F.min(place).alias("b0"), F.count("*").alias("n_candidates"))
    r = refs.withColumn("folder", dir_name(F.col("file_path"))).join(any_, key)
    r = r.join(best("folder").withColumnRenamed("b", "b50"), [*key, "folder"], "left").join(best("file_path").withColumnRenamed("b", "b100"), [*key, "file_path"], "left")
    near = F.when(F.col("b100").isNotNull(), 100).when(F.col("b50").isNotNull(), 50).otherwise(0)
    return r.select("ref_id", F.coalesce("b100", "b50", "b0")["id"].alias("target"), near.alias("proximity"), "n_candidates")


def generic(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best candidate of each reference (ref_id, name, file_path) by name alone, whatever its language."""
    return proximity(refs, nodes, ["name"])


def unique_only(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Only references with exactly one candidate."""
    return generic(refs, nodes).filter("n_candidates = 1").select("ref_id", "target")


def containment(owners: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs (owner, wanted) where the owner has every member that is wanted; both are (id, member).

    Candidates are the owners of each wanted set's rarest member, so a member that all have makes no pairs."""
    need, own = wanted.distinct(), owners.distinct().select(F.col("id").alias("owner"), "member")
    often = own.groupBy("member").agg(F.count("*").alias("n"))
    rarest = need.join(often, "member", "left").groupBy(F.col("id").alias("wanted")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "member"))["member"].alias("member"), F.count("*").alias("size"))
    pairs = own.join(rarest, "member").filter("owner != wanted").select("owner", "wanted", "size")
    have = pairs.join(need.select(F.col("id").alias("wanted"), "member"), "wanted").join(own, ["owner", "member"], "left_semi")
    return have.groupBy("owner", "wanted", "size").agg(F.count("*").alias("n")).filter("n = size").select("owner", "wanted")


def members_of(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, member, member_id): the methods that nodes of these kinds contain."""
    inside = edges.filter("kind = 'contains'").select("source", "target")
    owners = nodes.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("source"))
    methods = nodes.filter("kind = 'method'").select(F.col("id").alias("target"), F.col("name").alias("member"))
    return inside.join(owners, "source", "left_semi").join(methods, "target").select(F.col("source").alias("id"), "member", F.col("target").alias("member_id"))


def implements_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from structs to the interfaces whose methods they all have, by name; an interface without methods has none."""
    has, wants = members_of(nodes, edges, ("struct",)), members_of(nodes, edges, ("interface",))
    pairs = containment(has.select("id", "member"), wants.select("id", "member"))
    new = pairs.join(nodes.select(F.col("id").alias("owner"), "start_line"), "owner").select(F.col("owner").alias("source"), F.col("wanted").alias("target"), F.lit("implements").alias("kind"), F.col("start_line").alias("line"), F.lit("heuristic").alias("provenance"))
    return new.join(edges.filter("kind = 'implements'").select("source", "target"), ["source", "target"], "left_anti")


def override_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls from an interface's methods to those of the same name in what implements it; run after the edges above are there."""
    has = members_of(nodes, edges, ("struct", "class")).select(F.col("id").alias("source"), "member", F.col("member_id").alias("concrete"))
    wants = members_of(nodes, edges, ("interface",)).select(F.col("id").alias("target"), "member", F.col("member_id").alias("abstract"))
    pairs = edges.filter("kind = 'implements'").select("source", "target").distinct().join(has, "source").join(wants, ["target", "member"]).filter("abstract != concrete")
    new = pairs.select(F.col("abstract").alias("source"), F.col("concrete").alias("target"), F.lit("calls").alias("kind"), F.lit("heuristic").alias("provenance")).distinct()
    return new.join(edges.filter("kind = 'calls'").select("source", "target"), ["source", "target"], "left_anti")


# -- strategies by language -----------------------------------------------------------------------------------------

TYPES = ("class", "struct", "enum", "interface", "trait", "protocol", "type_alias")
CALLABLE = ("method", "function")


class Step(NamedTuple):
    """One way to bind a reference; of the steps of its language the first that binds it, or vetoes, decides.

    how: ``local`` (an import of the file), ``def`` (name, same language, no import or file), ``unique`` (last part, one candidate only), ``near`` (last part, best), ``member`` (last
    part, in the container that the receiver names), ``inferred`` (in the type of the receiver's variable in the file; known type without the member: veto),
    ``construct`` (a type, by receiver of ``new`` or by name), ``shadow`` (def, if any import stands in the file), ``alias`` (in the folder that the receiver's import
    names), ``overlap`` (last part, receiver's words shared with the path, 2 at least), ``package`` (def in the file's package, an imported one, any), ``file`` (a file by
    name), ``include`` (a file by its path from this one, else a unique one by name), ``inherited`` (member in a base of the container), ``generic`` (any language), ``drop`` (no edge)."""

    how: str
    kinds: tuple[str, ...] = ()
    for_kinds: tuple[str, ...] = ()  # of references; all if empty
    dotted: bool | None = None
    imported: bool = False  # needs an import of the very name in the file


_BARE = {"dotted": False}
_DEF, _GENERIC = Step("def", dotted=False), Step("generic", dotted=False)
_DEF_IMPORTED = Step("def", dotted=False, imported=True)
_UNIQUE = Step("unique", CALLABLE, dotted=True)
_MEMBER, _INFERRED, _CONSTRUCT = Step("member", dotted=True), Step("inferred", CALLABLE, dotted=True), Step("construct", TYPES, ("calls", "instantiates"), dotted=True)
_NEAR = Step("near", ("method", "function", "property"), dotted=True)
_FILE, _INCLUDE, _SHADOW = Step("file", ("file",), ("imports",)), Step("include", ("file",), ("imports",)), Step("shadow", dotted=False)
STRATEGIES: dict[str, tuple[Step, ...]] = {
    "go": (Step("local", (), ("imports",)), Step("alias", dotted=True), _UNIQUE, Step("overlap", CALLABLE, dotted=True), _DEF),
    "python": (_INFERRED, _UNIQUE, _DEF_IMPORTED, _GENERIC),
    "ruby": (_CONSTRUCT, _INFERRED, _UNIQUE, _DEF, _GENERIC),
    "julia": (_MEMBER, Step("unique", ("function",), dotted=True), _DEF, _GENERIC),
    "perl": (_CONSTRUCT, _MEMBER, _INFERRED, _UNIQUE, _DEF, _GENERIC),
    "php": (_MEMBER, _INFERRED, _UNIQUE, _DEF_IMPORTED, _GENERIC),
    "rust": (_CONSTRUCT, _MEMBER, _DEF_IMPORTED, Step("def", ("function",), **_BARE), Step("def", ("method",), **_BARE)),
    "csharp": (_NEAR, _DEF_IMPORTED, _GENERIC),
    "swift": (_NEAR, Step("construct", ("class", "struct", "enum"), ("calls",), dotted=False), Step("def", ("function",), **_BARE), Step("def", ("method",), **_BARE), _GENERIC),
    "dart": (_CONSTRUCT, Step("near", ("method",), dotted=True), _INCLUDE, _DEF, _GENERIC),
    "lua": (_FILE, _MEMBER, _UNIQUE, _DEF_IMPORTED, _GENERIC),
    "bash": (_FILE, Step("def", ("function",), **_BARE), Step("drop")),
    "r": (_FILE, _DEF, Step("generic")),
    "powershell": (_FILE, _DEF, Step("drop")),
    "c": (_INCLUDE, _DEF, _GENERIC),
    "objc": (_INCLUDE, _DEF, _GENERIC),
    "cpp": (_INCLUDE, _MEMBER, Step("inherited", dotted=True), Step("near", dotted=True), _DEF, _GENERIC),
    "elixir": (_MEMBER, _UNIQUE, _SHADOW, _DEF, _GENERIC),
    "erlang": (_MEMBER, _UNIQUE, _SHADOW, _DEF, _GENERIC),
    "haskell": (_MEMBER, _UNIQUE, _SHADOW, _DEF, _GENERIC),
    "fsharp": (Step("near", dotted=True), _DEF, _GENERIC),
    "java": (Step("near", CALLABLE, dotted=True), Step("package", dotted=False), _GENERIC),
    "kotlin": (Step("near", CALLABLE, dotted=True), Step("package", dotted=False), _GENERIC),
    "scala": (Step("near", CALLABLE, dotted=True), Step("package", dotted=False), _GENERIC),
    "sql": (Step("def", ("struct",)),),
    "sqlite": (Step("def", ("struct",)),),
    "artifact": (_FILE, _DEF),
    "typescript": (Step("near", CALLABLE, dotted=True), _GENERIC),
}
ONE_LANGUAGE = {"sqlite": "sql", "tsx": "typescript", "javascript": "typescript", "jsx": "typescript"}
CONSTRUCTED = {"python": ("class", "struct"), "ruby": ("class",), "julia": ("struct",), "perl": ("module",), "php": ("class",), "rust": ("struct", "enum"), "csharp": ("class", "struct"), "swift": ("class", "struct", "enum"), "dart": ("class",), "c": ("class", "struct"), "cpp": ("class", "struct"), "objc": ("class",), "java": ("class", "struct"), "kotlin": ("class", "struct"), "scala": ("class", "struct"), "go": ("class", "struct"), "typescript": ("class", "struct")}
BUILTINS = {
    "go": "append cap clear close complex copy delete imag len make max min new panic print println real recover", "c": "printf malloc free memcpy memset strlen strcmp sizeof abort exit",
    "cpp": "printf malloc free memcpy move forward make_unique make_shared static_cast", "objc": "NSLog printf malloc free", "fsharp": "printfn sprintf failwith ignore not fst snd id raise",
}


def _strategy_rows(spark) -> DataFrame:
    rows = [(lang, i, s.how, list(s.kinds), list(s.for_kinds), s.dotted, s.imported) for lang, steps in STRATEGIES.items() for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "lang string, step int, how string, kinds array<string>, for_kinds array<string>, dotted boolean, imported boolean")


def resolve(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ref_id, source, target, kind, strategy of every reference that a step of its language binds.

    refs: ref_id, from_node, name, kind, file_path, language; nodes: id, kind, name, qualified_name, file_path, language, start_line, signature;
    edges (extends) for inherited members.  References to a type by call become ``instantiates``; ``extends`` to an interface becomes ``implements``."""
    spark = refs.sparkSession
    lang = lambda c: reduce(lambda e, kv: e.when(c == kv[0], kv[1]), ONE_LANGUAGE.items(), F.when(F.lit(False), "")).otherwise(c)
    stop = spark.createDataFrame([(k, w) for k, ws in BUILTINS.items() for w in ws.split()], "lang string, name string")
    r = refs.withColumn("lang", lang(F.col("language"))).join(F.broadcast(stop), ["lang", "name"], "left_anti")
    parts = F.filter(F.split("name", r"::|[.:#]"), lambda x: x != "")
    r = r.withColumn("parts", parts).withColumn("is_dotted", F.size("parts") > 1).withColumn("last", F.try_element_at("parts", F.lit(-1))).withColumn("receiver", F.try_element_at("parts", F.lit(-2)))
    r = cut_lineage(r)  # both sides are read by every strategy: derive them once
    present = [x["lang"] for x in r.select("lang").distinct().collect()]  # one row for each language there is
    hows = {s.how for k in present for s in STRATEGIES.get(k, ())}
    n = nodes.withColumn("lang", lang(F.col("language"))).withColumn("owner", F.try_element_at(F.filter(F.split("qualified_name", "::"), lambda x: x != ""), F.lit(-2)))
    n = cut_lineage(n)
    plain = n.filter("kind not in ('import', 'file')")
    imports = n.filter("kind = 'import'")
    todo = r.join(F.broadcast(_strategy_rows(spark)), "lang").filter("(dotted is null or dotted = is_dotted) and (size(for_kinds) = 0 or array_contains(for_kinds, kind))")
    named = imports.select("file_path", "name").distinct().withColumn("has_import", F.lit(True))
    todo = todo.join(named, ["file_path", "name"], "left").filter("not imported or has_import")
    todo = cut_lineage(todo)
    any_import = imports.select("file_path").distinct()
    nothing = todo.limit(0).select("ref_id", "step", "how", F.lit(None).cast("string").alias("target"))

    def bound(how: str, some: DataFrame, candidates: DataFrame, key: list[str], only_one: bool = False) -> DataFrame:
        """Of the step's references, those with a candidate of the same key and of the step's kinds."""
        if how not in hows:
            return nothing
        some = some.filter(F.col("how") == how).withColumn("kinds_key", F.array_join("kinds", " "))
        sets = {" ".join(s.kinds) for steps in STRATEGIES.values() for s in steps if s.how == how}
        pools = [candidates.filter(F.col("kind").isin(*k.split())).withColumn("kinds_key", F.lit(k)) if k else candidates.withColumn("kinds_key", F.lit("")) for k in sorted(sets)]
        pool = reduce(DataFrame.unionByName, pools)
        keyed = some.select(F.struct("ref_id", "step").alias("ref_id"), "file_path", "kinds_key", *key)
        got = proximity(keyed, pool.select("id", "file_path", "start_line", "kinds_key", *key), ["kinds_key", *key])
        got = got.filter("n_candidates = 1") if only_one else got
        return got.select("ref_id.ref_id", "ref_id.step", F.lit(how).alias("how"), "target")

    lastly = todo.withColumn("name", F.col("last"))
    own = plain.select("id", "kind", "name", "lang", "owner", "file_path", "start_line")
    found = [
        bound("def", todo, plain, ["lang", "name"]),
        todo.filter("how = 'local'").join(imports.groupBy("lang", "name", "file_path").agg(F.min(F.struct("start_line", "id"))["id"].alias("target")), ["lang", "name", "file_path"]).select("ref_id", "step", "how", "target"),
        bound("shadow", todo.join(any_import, "file_path", "left_semi"), plain, ["lang", "name"]),
        bound("unique", lastly, own, ["lang", "name"], True),
        bound("near", lastly, own, ["lang", "name"]),
        bound("member", lastly.withColumn("owner", F.col("receiver")), own, ["lang", "owner", "name"]),
        bound("construct", todo.filter("not is_dotted or last = 'new'").withColumn("name", F.when(F.col("is_dotted"), F.col("receiver")).otherwise(F.col("name"))), own, ["lang", "name"]),
        bound("generic", todo, n, ["name"]),
        bound("file", todo.withColumn("name", F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.[A-Za-z0-9]+$", "")), n.filter("kind = 'file'").withColumn("name", F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "")), ["lang", "name"]),
    ]
    # the type that a variable of the file was made of; known without the member: veto
    made = plain.filter("kind in ('variable', 'constant', 'field')").select("file_path", F.col("name").alias("receiver"), F.regexp_extract("signature", r"^= *(?:new +)?([A-Za-z_][A-Za-z0-9_]*)(?:\.new|::new|->new)?\(", 1).alias("owner"))
    made = made.filter("owner != ''").groupBy("file_path", "receiver").agg(F.min("owner").alias("owner"))
    known = lastly.filter("how = 'inferred'").join(made, ["file_path", "receiver"])
    sure = bound("inferred", known, own, ["lang", "owner", "name"])
    veto = known.select("ref_id", "step").join(sure, ["ref_id", "step"], "left_anti").select("ref_id", "step", F.lit("veto").alias("how"), F.lit(None).cast("string").alias("target"))
    drop = todo.filter("how = 'drop'").select("ref_id", "step", "how", F.lit(None).cast("string").alias("target"))
    # the folder that an import's signature names for an alias, or folders inside it
    aliases = imports.select("file_path", F.regexp_extract("signature", "^([A-Za-z_][A-Za-z0-9_]*)=", 1).alias("receiver"), F.regexp_replace("signature", "^[^=]*=", "").alias("folder")).filter("receiver != ''").distinct()
    via = lastly.filter("how = 'alias'").join(aliases, ["file_path", "receiver"])
    there = own.withColumn("dir", dir_name(F.col("file_path")))
    ups = there.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))))
    aliased = via.join(ups.groupBy("lang", "name", "folder").agg(F.min(F.struct("file_path", "start_line", "id")).alias("b")), ["lang", "name", "folder"]).select("ref_id", "step", "how", F.col("b.id").alias("target"))
    # words of the receiver in the candidate's path, two at least; of one language and name: each receiver meets each file once
    from loomgraph.functions.text import word_overlap

    key = ["lang", "name", "receiver"]
    asked = lastly.filter("how = 'overlap'").select("ref_id", "step", "how", *key)
    offered = own.filter(F.col("kind").isin(*CALLABLE)).groupBy("lang", "name", F.col("file_path").alias("there")).agg(F.min("id").alias("id"))
    shared = asked.select(*key).distinct().join(offered, ["lang", "name"])
    shared = shared.withColumn("n", word_overlap(F.col("receiver"), F.regexp_replace("there", "[/._]", " "))).filter("n >= 2")
    overlap = asked.join(shared.groupBy(*key).agg(F.min(F.struct(-F.col("n"), "there", "id"))["id"].alias("target")), key).select("ref_id", "step", "how", "target")
    # packages: the folder of the file stands for it; imports by name, then any
    pack = todo.filter("how = 'package'").withColumn("package", dir_name(F.col("file_path")))
    in_pack = own.withColumn("package", dir_name(F.col("file_path"))).groupBy("lang", "name", "package").agg(F.min(F.struct("file_path", "start_line", "id")).alias("b"))
    explicit = imports.select("file_path", F.col("name"), F.regexp_replace("signature", "^[^=]*=", "").alias("package")).distinct()
    tier0 = pack.join(in_pack, ["lang", "name", "package"]).select("ref_id", "step", F.lit(0).alias("tier"), "b")
    tier1 = pack.drop("package").join(explicit, ["file_path", "name"]).join(in_pack, ["lang", "name", "package"]).select("ref_id", "step", F.lit(1).alias("tier"), "b")
    tier2 = pack.join(own.groupBy("lang", "name").agg(F.min(F.struct("file_path", "start_line", "id")).alias("b")), ["lang", "name"]).select("ref_id", "step", F.lit(2).alias("tier"), "b")
    packed = tier0.unionByName(tier1).unionByName(tier2).groupBy("ref_id", "step").agg(F.min(F.struct("tier", "b"))["b"]["id"].alias("target")).select("ref_id", "step", F.lit("package").alias("how"), "target")
    # includes: the path from this file, else the only file of that name
    from loomgraph.functions.paths import base_name, clean

    files = n.filter("kind = 'file'")
    inc = todo.filter("how = 'include'")
    by_path = inc.withColumn("path", clean(F.concat_ws("/", dir_name(F.col("file_path")), "name"))).join(files.groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("target")), "path").select("ref_id", "step", "how", "target", F.lit(0).alias("tier"))
    single = files.groupBy(base_name(F.col("file_path")).alias("base")).agg(F.min("id").alias("target"), F.count("*").alias("n")).filter("n = 1")
    by_base = inc.withColumn("base", base_name(F.col("name"))).join(single, "base").select("ref_id", "step", "how", "target", F.lit(1).alias("tier"))
    included = by_path.unionByName(by_base).groupBy("ref_id", "step", "how").agg(F.min(F.struct("tier", "target"))["target"].alias("target"))
    # members of bases, nearest first
    base = edges.filter("kind = 'extends'").join(n.select(F.col("id").alias("source"), F.col("name").alias("owner"), "lang"), "source").join(n.select(F.col("id").alias("target"), F.col("name").alias("base")), "target").select("lang", "owner", "base").distinct()
    up = hop = base.select("lang", "owner", "base", F.lit(1).alias("hops"))
    for k in range(2, 6):
        hop = hop.select("lang", "owner", F.col("base").alias("b")).join(base.select("lang", F.col("owner").alias("b"), "base"), ["lang", "b"]).select("lang", "owner", "base", F.lit(k).alias("hops")).distinct()
        up = up.unionByName(hop)
    up = up.groupBy("lang", "owner", "base").agg(F.min("hops").alias("hops"))
    key = ["lang", "owner", "name"]
    asked = lastly.filter("how = 'inherited'").withColumn("owner", F.col("receiver")).select("ref_id", "step", "how", *key)
    offered = own.groupBy("lang", F.col("owner").alias("base"), "name").agg(F.min("id").alias("id"))
    nearest = asked.select(*key).distinct().join(up, ["lang", "owner"]).join(offered, ["lang", "base", "name"]).groupBy(*key).agg(F.min(F.struct("hops", "id"))["id"].alias("target"))
    inherited = asked.join(nearest, key).select("ref_id", "step", "how", "target")

    more = {"inferred": (sure, veto), "drop": (drop,), "alias": (aliased,), "overlap": (overlap,), "package": (packed,), "include": (included,), "inherited": (inherited,)}
    every = reduce(DataFrame.unionByName, [*found, *(x for how, xs in more.items() if how in hows for x in xs)], nothing)
    first = every.groupBy("ref_id").agg(F.min(F.struct("step", "how", "target")).alias("b")).select("ref_id", F.col("b.how").alias("strategy"), F.col("b.target").alias("target")).filter("target is not null")
    return _edges(first, r, nodes)


def _edges(first: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    made = F.create_map(*(x for k, v in CONSTRUCTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    out = first.join(refs.select("ref_id", "from_node", "kind", "lang"), "ref_id").join(nodes.select(F.col("id").alias("target"), F.col("kind").alias("target_kind")), "target")
    kind: Column = F.when((F.col("kind") == "calls") & F.coalesce(F.array_contains(made[F.col("lang")], F.col("target_kind")), F.lit(False)), "instantiates")
    kind = kind.when((F.col("kind") == "extends") & F.col("target_kind").isin("interface", "protocol", "trait"), "implements").otherwise(F.col("kind"))
    return out.filter("from_node != target").select("ref_id", F.col("from_node").alias("source"), "target", kind.alias("kind"), "strategy")


def filled(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blank languages and files of references taken from the node that they stand in."""
    own = nodes.select(F.col("id").alias("from_node"), F.col("language").alias("own_language"), F.col("file_path").alias("own_file"))
    blank = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(other)).alias(c)
    rest = [c for c in refs.columns if c not in ("language", "file_path")]
    return refs.join(own, "from_node", "left").select(*rest, blank("language", "own_language"), blank("file_path", "own_file"))


def to_reresolve(refs: DataFrame, changed_files: DataFrame, changed_names: DataFrame) -> DataFrame:
    """References to bind again after a change: those of changed files, and all that name something which came or went."""
    own = refs.join(changed_files.select("file_path"), "file_path", "left_semi")
    others = refs.join(changed_files.select("file_path"), "file_path", "left_anti").join(changed_names.select("name"), "name", "left_semi")
    return own.unionByName(others.select(*own.columns))
