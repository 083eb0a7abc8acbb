"""Queries over edge tables, model tables and libraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import cluster, graph, libraries, matching, relations
from quillmesh.plans.params import DEFAULTS
from quillmesh.plans.registry import query, read
from quillmesh.sources import parse, sinks

_EDGES = "SELECT CAST(n_nationkey AS VARCHAR) AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer"


def _edges(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    c = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.col("c_nationkey").cast("string"))
    return n.union(c)


@query(f"WITH e AS ({_EDGES}) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def neighbours(spark, d):
    return graph.neighbours(_edges(spark, d))


@query("SELECT DISTINCT o_custkey AS src, o_orderpriority AS dst FROM orders")
def edge_dedup(spark, d):
    return graph.out_neighbours(read(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst")))


@query("""WITH mp AS (SELECT n_regionkey AS pair, n_nationkey AS cls, (n_nationkey * 7) % 25 AS to_cls FROM nation WHERE n_nationkey % 5 < 4),
p AS (SELECT a.n_regionkey AS pair, a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
b AS (SELECT DISTINCT pair, (src * 7) % 25 AS src, (dst * 7) % 25 AS dst FROM p WHERE (src + dst) % 3 < 1 + pair % 2),
u AS (SELECT pair, src, dst FROM b UNION SELECT pair, dst, src FROM b),
e AS (SELECT p.pair, x.to_cls AS a, y.to_cls AS b FROM p JOIN mp x ON x.pair = p.pair AND x.cls = p.src JOIN mp y ON y.pair = p.pair AND y.cls = p.dst),
r AS (SELECT e.pair, count(u.pair) / count(*) AS r FROM e LEFT JOIN u ON u.pair = e.pair AND u.src = e.a AND u.dst = e.b GROUP BY e.pair)
SELECT pair, round(CASE WHEN r IS NULL THEN 1.0 WHEN r < 0.33 THEN 0.0 ELSE r END, 6) + 0.0 AS ratio FROM (SELECT DISTINCT pair FROM mp) LEFT JOIN r USING (pair)""")
def association_ratio(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("pair"))
    other = lambda c: (F.col(c) * 7) % 25
    m = n.filter("k % 5 < 4").select("pair", F.col("k").alias("cls"), other("k").alias("to_cls"))
    p = n.withColumnRenamed("k", "src").join(n.withColumnRenamed("k", "dst"), "pair").filter("src < dst")
    b = p.filter("(src + dst) % 3 < 1 + pair % 2").select("pair", other("src").alias("src"), other("dst").alias("dst"))
    return graph.association_ratio(m, p, b).select("pair", (F.round("ratio", 6) + F.lit(0.0)).alias("ratio"))


_TREE = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 AND p_size % 5 <> 0"


def _tree(spark, d):
    return read(spark, d, "part").filter("p_partkey > 1 AND p_size % 5 <> 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))


@query(f"WITH RECURSIVE e AS ({_TREE}), c AS (SELECT p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT e.dst FROM c JOIN e ON c.node = e.src) SELECT DISTINCT node FROM c")
def closure_reach(spark, d):
    return graph.closure(_tree(spark, d), read(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("node")))


@query(f"WITH RECURSIVE e AS ({_TREE}), c AS (SELECT p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT e.src FROM c JOIN e ON c.node = e.dst) SELECT DISTINCT node FROM c")
def symbol_closure(spark, d):
    t = _tree(spark, d).select(F.col("src").cast("string").alias("from_symbol"), F.col("dst").cast("string").alias("to_symbol"))
    kept = read(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").cast("string").alias("node"))
    return graph.references_closure(t, kept).select(F.col("node").cast("long").alias("node"))


@query(f"WITH RECURSIVE e AS ({_TREE}), c AS (SELECT p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT e.dst FROM c JOIN e ON c.node = e.src) SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM c)")
def removal_closure(spark, d):
    t = _tree(spark, d).select(F.col("src").alias("from_symbol"), F.col("dst").alias("to_symbol"))
    p = read(spark, d, "part")
    return graph.unused(p.select(F.col("p_partkey").alias("node"), F.lit(None).cast("long").alias("owner")), t, p.filter("p_size = 7").select(F.col("p_partkey").alias("node"))).select("node")


@query(f"WITH RECURSIVE e AS ({_TREE}), c AS (SELECT p_partkey AS node FROM part WHERE p_size = 11 UNION SELECT e.src FROM c JOIN e ON c.node = e.dst) SELECT DISTINCT node FROM c")
def local_closure(spark, d):
    t = _tree(spark, d).select(F.col("src").alias("from_symbol"), F.col("dst").alias("to_symbol"))
    return graph.reaches(t, read(spark, d, "part").filter("p_size = 11").select(F.col("p_partkey").alias("node")))


@query(f"""WITH RECURSIVE e AS ({_TREE}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c AS (SELECT p_partkey AS node, p_partkey AS lab FROM part UNION SELECT u.b, c.lab FROM c JOIN u ON c.node = u.a WHERE c.lab < u.b)
SELECT p_partkey AS cluster_id, (SELECT min(lab) FROM c WHERE c.node = p_partkey) AS merged FROM part""")
def cluster_merge(spark, d):
    pairs = _tree(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return cluster.merge_pairs(read(spark, d, "part").select(F.col("p_partkey").alias("cluster_id")), pairs)


@query(f"WITH e AS ({_TREE}), k AS (SELECT p_partkey AS node FROM part WHERE p_size % 2 = 0) SELECT node FROM k WHERE node NOT IN (SELECT src FROM e WHERE dst IN (SELECT node FROM k))")
def subtype_removal(spark, d):
    kept = read(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("node"))
    return graph.subtypes_removed(kept, _tree(spark, d).select(F.col("src").alias("sub"), F.col("dst").alias("super")))


_CLASSES = "SELECT p_brand AS model_id, p_partkey AS class_id, p_type AS name, p_brand || '.' || p_type || p_size AS full_name, p_size FROM part"


@query(f"WITH c AS ({_CLASSES}), s AS (SELECT model_id, class_id, unnest([model_id || '.' || name || (p_size + 1), 'none']) AS n FROM c) SELECT DISTINCT s.model_id, s.class_id, c.class_id AS super_id FROM s JOIN c ON s.model_id = c.model_id AND (s.n = c.name OR s.n = c.full_name)")
def inherited(spark, d):
    p = read(spark, d, "part")
    full = F.concat("p_brand", F.lit("."), "p_type", F.col("p_size").cast("string"))
    up = F.concat("p_brand", F.lit("."), "p_type", (F.col("p_size") + 1).cast("string"))
    c = p.select(F.col("p_brand").alias("model_id"), F.col("p_partkey").alias("class_id"), F.col("p_type").alias("name"), full.alias("full_name"), F.array(up, F.lit("none")).alias("supers"))
    return graph.inherited(c)


@query("""WITH c AS (SELECT n_regionkey AS model_id, n_nationkey AS dst, 'N' || n_nationkey AS name FROM nation), u AS (SELECT n_regionkey AS model_id, n_nationkey AS src, unnest(['N' || ((n_nationkey + 5) % 25), 'N' || ((n_nationkey * 3) % 25), 'Map', 'N' || n_nationkey]) AS name FROM nation)
SELECT DISTINCT u.model_id, src, dst FROM u JOIN c USING (model_id, name) WHERE src <> dst""")
def type_dependencies(spark, d):
    k = F.col("n_nationkey")
    n = lambda x: F.concat(F.lit("N"), x.cast("string"))
    t = read(spark, d, "nation")
    c = t.select(F.col("n_regionkey").alias("model_id"), k.alias("class_id"), n(k).alias("name"), n(k).alias("full_name"))
    u = t.select(F.col("n_regionkey").alias("model_id"), k.alias("class_id"), F.concat(F.lit("Map<"), n((k + 5) % 25), F.lit(","), n((k * 3) % 25), F.lit("["), n(k), F.lit("]>")).alias("type"))
    return graph.type_dependencies(u, c)


@query("""WITH mp AS (SELECT DISTINCT l_partkey AS from_name FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) SELECT p_partkey AS missing FROM part WHERE p_partkey NOT IN (SELECT from_name FROM mp)""")
def missing_members(spark, d):
    m = read(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("missing"))
    return relations.missing_names(read(spark, d, "part").select(F.col("p_partkey").alias("missing")), m, "missing")


@query("""SELECT round(c / m, 6) AS classes_per_model, round(e / m, 6) AS edges_per_model, round(o / c, 6) AS ops_per_class, round(a / c, 6) AS attrs_per_class FROM
(SELECT count(*) AS c, count(DISTINCT c_nationkey) AS m FROM customer), (SELECT count(*) AS e FROM orders), (SELECT count(*) AS o FROM lineitem), (SELECT count(*) AS a FROM part)""")
def size_report(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("model_id"))
    r = sinks.size_report(c, read(spark, d, "orders"), read(spark, d, "lineitem"), read(spark, d, "part"))
    return r.select(*[F.round(x, 6).alias(x) for x in r.columns])


@query("""WITH i AS (SELECT DISTINCT l_partkey AS cluster_id, CASE l_suppkey % 3 WHEN 0 THEN 'java.util.X' ELSE 'p' || (l_suppkey % 7) || '.C' || l_suppkey END AS import FROM lineitem) SELECT cluster_id, import FROM i WHERE NOT starts_with(import, 'java.') AND NOT starts_with(import, 'p3.')""")
def import_report(spark, d):
    k = F.col("l_suppkey")
    i = read(spark, d, "lineitem").select(F.col("l_partkey").alias("cluster_id"), F.when(k % 3 == 0, "java.util.X").otherwise(F.concat(F.lit("p"), (k % 7).cast("string"), F.lit(".C"), k.cast("string"))).alias("import"))
    return libraries.import_report(i, spark.createDataFrame([("p3",)], "pkg string"))


def _coverage(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("lib_id"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("lib_name"), F.concat(F.lit("p."), F.col("l_partkey").cast("string"), F.lit(".x")).alias("import")).distinct()


@query()
def set_cover(spark, d):
    """Suppliers that cover the parts, greedily."""
    return graph.set_cover(_coverage(spark, d))


@query()
def prefix_cover(spark, d):
    c = spark.createDataFrame([("org.apache.foo", "org.apache.foo.A"), ("org.apache", "org.apache.foo.A"), ("com.x", "org.apache.bar.B"), ("org.apache.bar.z", "org.apache.bar.B")], "lib_id string, import string")
    name = lambda k, last: F.concat(F.lit("org.p"), (F.col(k) % 20).cast("string"), F.lit(last))
    c = c.union(read(spark, d, "lineitem").select(name("l_suppkey", ".s"), F.concat(name("l_partkey", ".c"), F.col("l_partkey").cast("string"))))
    chosen, _ = graph.prefix_cover(c)
    return spark.createDataFrame(list(enumerate(chosen)), "step int, lib_id string")


@query()
def find_libraries(spark, d):
    cov = _coverage(spark, d)
    imports = cov.select("import").distinct().union(spark.createDataFrame([("nowhere.to.Find",)], "import string"))
    project = cov.filter("lib_id = 's1'").select("lib_id", "import", F.lit(0).alias("ord"))
    libs, missing = libraries.find_libraries(imports, project, cov.select("lib_id", "import"), cov.select("lib_id", "lib_name").distinct())
    return libs.select(F.lit("library").alias("what"), F.col("lib_id").alias("name")).union(missing.select(F.lit("missing"), "import"))


# a contact manager as pattern and as three candidate models
def contacts(spark):
    """Flat model tables of a pattern (pat), a like model (near), one with other names (far) and an unrelated one (none)."""
    shape = {"Address": (6, 1), "ContactDAO": (0, 3), "Phone": (2, 1), "Contact": (7, 6)}
    edges = [("ContactDAO", "Contact"), ("Contact", "Address"), ("Contact", "Phone")]
    types = ("STRING", "NUMBER", "DATE")
    classes, attrs, ops, params, deps = [], [], [], [], []
    for model, rename, keep in (("pat", str, 1.0), ("near", str, 0.9), ("far", lambda x: x[::-1], 1.0), ("none", lambda x: "Z" + x, 0.0)):
        for c, (na, no) in shape.items():
            k = rename(c)
            classes.append((model, k, k, f"{model}.{k}", c == "ContactDAO", False, True, None, [], None))
            for i in range(round(na * keep)):
                attrs.append((model, k, f"{k}.a{i}", f"a{i}{c}", f"{model}.{k}.a{i}", types[i % 3], "x", "private"))
            for i in range(round(no * keep)):
                o = f"{k}.o{i}"
                ops.append((model, k, o, f"op{i}", f"{model}.{o}", o, types[i % 3], "x", False, False, "public"))
                params.append((model, o, f"{o}.p", 0, "p", f"{model}.{o}.p", "USERTYPE", "x"))
        deps += [(model, rename(a), rename(b)) for a, b in edges]
    s = "string"
    return (
        spark.createDataFrame(classes, "model_id string, class_id string, name string, full_name string, is_interface boolean, is_enum boolean, is_matchable boolean, super_name string, ifaces array<string>, enum_consts array<string>"),
        spark.createDataFrame(attrs, ", ".join(f"{c} {s}" for c in "model_id class_id attr_id name full_name arg_type type_name access".split())),
        spark.createDataFrame(ops, "model_id string, class_id string, op_id string, name string, full_name string, map_name string, ret_arg_type string, ret_type string, is_ctor boolean, is_static boolean, access string"),
        spark.createDataFrame(params, "model_id string, op_id string, param_id string, pos int, name string, full_name string, arg_type string, type_name string"),
        spark.createDataFrame(deps, "model_id string, src string, dst string"),
    )


@query()
def model_match(spark, d):
    m = matching.nested_models(*contacts(spark))
    pattern = m.filter("model_id = 'pat'").first().asDict(recursive=True)
    r = matching.match_models(m.filter("model_id <> 'pat'"), pattern)
    return r.select("model_id", F.round("score", 6).alias("score"), F.array_join(F.array_sort(F.transform(F.map_entries("name_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("names")).orderBy(F.desc("score"), "model_id")


@query()
def contains_model(spark, d):
    """Models that contain the pattern: a match of any score."""
    return model_match(spark, d).select("model_id")


@query()
def class_merge(spark, d):
    """Class pairs of two models whose members assign well enough to merge."""
    _, a, _, _, _ = contacts(spark)
    l, r = (a.filter(f"model_id = '{m}'").select("class_id", F.col("attr_id").alias(c), F.col("name").alias(f"{c}_name"), F.col("arg_type").alias("arg_type")) for m, c in (("pat", "left"), ("near", "right")))
    x = matching.attribute_scores(l.withColumnRenamed("left_name", "a_name"), r.withColumnRenamed("right_name", "b_name"), ["class_id"])
    n = lambda t, c: t.groupBy("class_id").agg(F.count("*").alias(c))
    x = x.join(n(l, "n_left"), "class_id").join(n(r, "n_right"), "class_id").withColumnRenamed("class_id", "pair")
    return cluster.merge_members(x, "pair", tha=DEFAULTS.field_min_match, thb=DEFAULTS.field_max_match)


@query()
def model_xml(spark, d):
    c, a, o, p, e = contacts(spark)
    models = c.select("model_id").distinct().select("model_id", F.col("model_id").alias("name"), F.lit("pkg").alias("package"))
    return sinks.model_xml(models, c, a, o, p, e).join(sinks.pattern_source(models, c, a, o, p, e), "model_id")


@query()
def gradle_and_headers(spark, d):
    script = "dependencies {\n compile 'a:b:1'\n testCompile project(':x')\n compileOnly c:d:2\n}\ncompile 'no:no:1'"
    lines = spark.createDataFrame([("f", i, s) for i, s in enumerate(script.split("\n"))], "file string, pos int, line string")
    head = spark.createDataFrame([("t", '@Pattern(library="a:b:1")\n@Pattern(suggestedTerms={"x","y"})\n@PatternPackage\ninterface P {\n@PatternClass(uses={B.class})\nclass A {}\n@PatternClass\nclass B {}\n}')], "file string, text string")
    g = parse.gradle_libraries(lines).select(F.lit("gradle").alias("what"), F.col("lib").alias("value"))
    h = parse.pattern_headers(head).select(F.col("key"), "value")
    return g.union(h).union(parse.pattern_edges(head).select(F.lit("edge"), F.concat("src", F.lit(">"), "dst")))
