"""Queries of the rewriting plans, and of limits, gates and lookups that other queries don't show."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import filters, libraries, matching, planning, relations
from quillmesh.plans.registry import query, read
from quillmesh.sources import parse


def _type_name():
    return F.concat(F.lit("a."), "p_type", F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(".")))


_TYPE = "'a.' || p_type || '.' || replace(p_brand, '#', '.')"


@query(f"""WITH n AS (SELECT p_partkey AS use, {_TYPE} || '.x' AS name FROM part), p AS (SELECT DISTINCT 'a.' || p_type AS package FROM part UNION SELECT 'a.' || p_type || '.Brand' FROM part WHERE p_size = 7)
SELECT use, name, substr(name, max(length(package)) + 2) AS to_name FROM n JOIN p ON starts_with(name, package || '.') GROUP BY use, name""")
def package_fixes(spark, d):
    p = read(spark, d, "part")
    packages = p.select(F.concat(F.lit("a."), "p_type").alias("package")).union(p.filter("p_size = 7").select(F.concat(F.lit("a."), "p_type", F.lit(".Brand"))))
    return planning.package_fixes(p.select(F.col("p_partkey").alias("use"), F.concat(_type_name(), F.lit(".x")).alias("name")), packages)


_INNER = """c AS (SELECT 'p.O' || (o_custkey % 20) || '.I' || o_orderkey AS name, 'p.O' || (o_custkey % 20) AS owner, o_orderkey AS k, o_orderstatus = 'P' AS is_interface, o_orderkey % 3 = 0 AS is_static FROM orders),
m AS (SELECT name AS from_name, CASE k % 4 WHEN 0 THEN 'q' || substr(name, 2) ELSE 'q.I' || k END AS to_name FROM c WHERE k % 2 = 0),
i AS (SELECT name, to_name, owner, owner || '_I' || k AS lifted, NOT is_static AS make_static FROM c JOIN m ON name = from_name WHERE NOT is_interface AND k % 4 <> 0)"""


def _inner(spark, d):
    o = read(spark, d, "orders").withColumn("c", F.col("o_custkey") % 20)
    k = F.col("o_orderkey")
    c = o.select(F.concat(F.lit("p.O"), "c", F.lit(".I"), k).alias("name"), F.concat(F.lit("p.O"), "c").alias("outer"), (F.col("o_orderstatus") == "P").alias("is_interface"), (k % 3 == 0).alias("is_static"), k.alias("k"))
    to = F.when(F.col("k") % 4 == 0, F.concat(F.lit("q"), F.expr("substring(name, 2)"))).otherwise(F.concat(F.lit("q.I"), "k"))
    m = c.filter("k % 2 = 0").select(F.col("name").alias("from_name"), to.alias("to_name"))
    return c.drop("k"), m


@query(f"WITH {_INNER} SELECT name, to_name, lifted, make_static FROM i")
def inner_classes(spark, d):
    return planning.inner_classes(*_inner(spark, d))


@query(f"""WITH {_INNER}, r AS (SELECT DISTINCT c.name, 'p.O' || (l_suppkey % 20) AS owner, 's' || l_linenumber AS s FROM lineitem JOIN c ON l_orderkey = k)
SELECT r.name, r.owner || '.' || s AS symbol FROM r JOIN i ON r.name = i.name AND r.owner = i.owner WHERE make_static""")
def outer_uses(spark, d):
    c, m = _inner(spark, d)
    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("p.O"), F.col("o_custkey") % 20, F.lit(".I"), "o_orderkey").alias("in_class"))
    of = F.concat(F.lit("p.O"), F.col("l_suppkey") % 20)
    r = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("in_class", F.concat(of, F.lit(".s"), "l_linenumber").alias("symbol"), of.alias("owner"))
    return planning.outer_uses(r.select("in_class", "symbol"), planning.inner_classes(c, m), r.select("symbol", "owner").distinct())


@query(f"""WITH {_INNER}, e AS (SELECT from_name, to_name FROM m UNION ALL SELECT from_name || '.m(p.O1.I1)', to_name || '.n' FROM m)
SELECT DISTINCT i.lifted || substr(from_name, length(name) + 1) AS from_name, e.to_name FROM e JOIN i ON from_name = name OR starts_with(from_name, name || '.')""")
def lifted_names(spark, d):
    c, m = _inner(spark, d)
    e = m.union(m.select(F.concat("from_name", F.lit(".m(p.O1.I1)")), F.concat("to_name", F.lit(".n"))))
    return planning.lifted_names(e, planning.inner_classes(c, m))


def _fields(spark, d):
    p = read(spark, d, "part")
    f = p.select(F.col("p_partkey").alias("field"), F.col("p_brand").alias("type"))
    m = p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("from_name"), (-F.col("p_partkey")).alias("to_name"))
    return planning.field_types(f, m, p.select((-F.col("p_partkey")).alias("field"), F.lit("Brand#5").alias("type")))


@query("SELECT p_partkey AS field, p_brand AS type, 'Brand#5' AS to_type FROM part WHERE p_size % 2 = 0 AND p_brand <> 'Brand#5'")
def field_types(spark, d):
    return _fields(spark, d)


@query("SELECT l_orderkey * 10 + l_linenumber AS use, l_partkey AS field, 'Brand#5' AS to_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0 AND p_brand <> 'Brand#5'")
def field_casts(spark, d):
    u = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use"), F.col("l_partkey").alias("field"))
    return planning.field_casts(u, _fields(spark, d))


@query("""SELECT l_orderkey * 10 + l_linenumber AS use, -p_partkey AS to_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 30 AND p_partkey % 2 = 0 AND (l_linenumber % 3 < 2 OR l_linestatus <> 'F')""")
def post_rename(spark, d):
    kind = F.element_at(F.array(F.lit("TYPE"), F.lit("FIELD"), F.lit("CALL")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    u = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use"), kind.alias("kind"), F.col("l_partkey").alias("name"), (F.col("l_linestatus") == "F").alias("resolved"))
    p = read(spark, d, "part")
    m = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("from_name"), (-F.col("p_partkey")).alias("to_name"))
    return planning.test_renames(u, m, p.filter("p_size < 30").select(F.col("p_partkey").alias("name")))


@query(f"""WITH i AS (SELECT p_partkey AS use, {_TYPE} AS name, 'a.STANDARD' AS own, p_size % 2 = 0 AS st, p_size % 3 = 0 AS od FROM part),
f AS (SELECT *, CASE WHEN name = 'a.PROMO.Brand.5' THEN name WHEN starts_with(name, 'a.PROMO.Brand.') THEN 'a.PROMO.Brand' WHEN starts_with(name, 'a.PROMO.') THEN 'a.PROMO' WHEN starts_with(name, 'a.SMALL.') THEN 'a.SMALL' END AS front FROM i),
g AS (SELECT *, coalesce(front, CASE WHEN starts_with(name, own || '.') THEN own END) AS x, NOT st AND front IS NOT NULL AND front = CASE WHEN od THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') END AS gone FROM f)
SELECT use, CASE WHEN gone THEN 'remove' WHEN x IS NULL THEN 'keep' ELSE 'rename' END AS action, CASE WHEN gone THEN NULL WHEN x IS NULL THEN name ELSE 'z.t' || substr(name, length(x) + 1) END AS to_name FROM g""")
def post_imports(spark, d):
    i = read(spark, d, "part").select(F.col("p_partkey").alias("use"), _type_name().alias("name"), F.lit("a.STANDARD").alias("own"), (F.col("p_size") % 2 == 0).alias("is_static"), (F.col("p_size") % 3 == 0).alias("on_demand"))
    return planning.test_imports(i, spark.createDataFrame([("a.PROMO",), ("a.PROMO.Brand",), ("a.PROMO.Brand.5",), ("a.SMALL",)], "package string"), "z.t")


@query("""WITH t AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), used AS (SELECT 'o' || o_orderkey AS node FROM t UNION SELECT 'c' || o_custkey FROM t UNION SELECT 'n' || c_nationkey FROM t JOIN customer ON o_custkey = c_custkey UNION SELECT 'p' || l_partkey FROM lineitem JOIN t ON l_orderkey = o_orderkey)
SELECT node FROM (SELECT 'o' || o_orderkey AS node FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'p' || p_partkey FROM part) WHERE node NOT IN (SELECT node FROM used)""")
def non_tests(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    n = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    nothing = F.lit(None).cast("string")
    items = o.select(n("o", "o_orderkey").alias("node"), n("c", "o_custkey").alias("owner")).union(c.select(n("c", "c_custkey"), nothing)).union(read(spark, d, "nation").select(n("n", "n_nationkey"), nothing)).union(read(spark, d, "part").select(n("p", "p_partkey"), nothing))
    methods = o.select(n("o", "o_orderkey").alias("node"), n("c", "o_custkey").alias("owner"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "org.junit.Test").otherwise("Override")).alias("annotations"))
    refs = read(spark, d, "lineitem").select(n("o", "l_orderkey").alias("from_symbol"), n("p", "l_partkey").alias("to_symbol"))
    return planning.untested(items, refs, methods, c.select(n("c", "c_custkey").alias("sub"), n("n", "c_nationkey").alias("super"))).select("node")


@query("""WITH RECURSIVE l AS (SELECT 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS node, l_orderkey AS k, l_linenumber % 2 = 0 AS del, l_returnflag = 'R' AND l_linestatus <> 'O' AS back FROM lineitem WHERE l_quantity > 45),
r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT k FROM l WHERE NOT del OR back) UNION SELECT o_orderkey FROM orders JOIN r ON o_orderkey - 1 = r.k WHERE o_orderkey % 3 <> 0)
SELECT node FROM l WHERE del UNION SELECT 'o' || k FROM r""")
def undefined_nodes(spark, d):
    n = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    no, text = F.lit(False), F.lit(None).cast("string")
    leaves = li.select(F.concat_ws("-", n("l", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").alias("node"), n("o", "l_orderkey").alias("parent"), text.alias("defines"), (F.col("l_linenumber") % 2 == 0).alias("deletable"), (F.col("l_returnflag") == "R").alias("returns"), (F.col("l_linestatus") == "O").alias("in_decl"), (F.col("l_quantity") > 45).alias("is_error"))
    nodes = leaves.union(o.select(n("o", "o_orderkey"), n("c", "o_custkey"), n("s", "o_orderkey"), F.lit(True), no, no, no))
    refs = o.filter("o_orderkey % 3 <> 0").select(n("o", "o_orderkey").alias("node"), F.concat(F.lit("s"), (F.col("o_orderkey") - 1).cast("string")).alias("symbol"))
    return planning.undefined(nodes, refs)


@query("""SELECT n_regionkey AS model_id, 0 AS level, 'CLASS' AS kind, 'n' || n_nationkey AS element, NULL AS owner FROM nation UNION ALL SELECT n_regionkey, 1, 'ATTRIBUTE', 's' || s_suppkey, 'n' || s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, 1, 'OPERATION', 'c' || c_custkey, 'n' || c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_regionkey, 2, 'PARAMETER', 'o' || o_orderkey, 'c' || o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_regionkey, 1, 'DEPENDENCY', 'n' || ((n_nationkey + 1) % 25), 'n' || n_nationkey FROM nation""")
def model_elements(spark, d):
    n = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    na = read(spark, d, "nation").select(F.col("n_regionkey").alias("model_id"), "n_nationkey")
    s = read(spark, d, "supplier").join(na, F.col("s_nationkey") == F.col("n_nationkey")).select("model_id", n("s", "s_suppkey").alias("attr_id"), n("n", "n_nationkey").alias("class_id"))
    c = read(spark, d, "customer").join(na, F.col("c_nationkey") == F.col("n_nationkey"))
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("model_id", n("o", "o_orderkey").alias("param_id"), n("c", "c_custkey").alias("op_id"))
    dep = na.select("model_id", n("n", "n_nationkey").alias("src"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"))
    return planning.model_elements(na.select("model_id", n("n", "n_nationkey").alias("class_id")), s, c.select("model_id", n("c", "c_custkey").alias("op_id"), n("n", "n_nationkey").alias("class_id")), o, dep)


@query("""SELECT DISTINCT a.n_regionkey AS model_id, b.n_nationkey AS class_id, a.n_nationkey AS sub_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE b.n_nationkey IN ((a.n_nationkey + 1) % 25, (a.n_nationkey * 2) % 25)""")
def sub_classes(spark, d):
    n = F.col("n_nationkey")
    c = read(spark, d, "nation").select(F.col("n_regionkey").alias("model_id"), n.alias("class_id"), F.concat(F.lit("N"), n).alias("name"), F.concat(F.lit("p.N"), n).alias("full_name"), F.array(F.concat(F.lit("N"), (n + 1) % 25), F.concat(F.lit("p.N"), n * 2 % 25)).alias("supers"))
    return planning.sub_classes(c)


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS lib_id, CAST(l_suppkey % 3 AS VARCHAR) AS version FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = s_suppkey % 5)")
def library_exists(spark, d):
    k, s = F.col("l_suppkey"), F.col("s_suppkey")
    libs = read(spark, d, "lineitem").select(k.cast("string").alias("lib_id"), (k % 3).cast("string").alias("version")).distinct()
    return libraries.exists(libs, read(spark, d, "supplier").select(s.cast("string").alias("lib_id"), (s % 5).cast("string").alias("version")))


@query("SELECT l_orderkey AS test_id FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 45 GROUP BY l_orderkey HAVING count(*) = count(p_partkey)")
def viable_tests(spark, d):
    t = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("test_id")).agg(F.collect_set("l_partkey").alias("imports"))
    return filters.viable_tests(t, read(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("import"))).select("test_id")


@query("""SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= least(50 * (1 + c_nationkey % 2), 30 + 5 * c_nationkey)""")
def limited_results(spark, d):
    k = F.col("n_nationkey")
    q = read(spark, d, "nation").select(k.alias("c_nationkey"), F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("packages"), (30 + 5 * k).alias("limit"))
    return relations.limited_results(read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), q, "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "c_nationkey")


@query("SELECT p_brand AS brand, string_agg(p_type, ',' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand")
def sorted_sets(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_type")
    return relations.sorted_sets(p, "brand", "p_type", "types").select("brand", F.array_join("types", ",").alias("types"))


@query("SELECT p_type AS grp, p_brand AS name, arg_min(p_name, p_partkey) AS version FROM part GROUP BY p_type, p_brand")
def unique_libraries(spark, d):
    p = read(spark, d, "part").select(F.col("p_type").alias("grp"), F.col("p_brand").alias("name"), F.col("p_name").alias("version"), F.col("p_partkey").alias("ord"))
    return relations.unique_libraries(p, "ord").drop("ord")


@query("SELECT c_custkey AS result FROM customer WHERE c_nationkey < 15 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def test_result_union(spark, d):
    c = read(spark, d, "customer")
    return relations.union_of(c.filter("c_nationkey < 15").select(F.col("c_custkey").alias("result")), c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("result")))


@query("SELECT p_type AS grp, p_brand AS artifact, p_name AS version, CASE p_size % 2 WHEN 0 THEN 'jar' ELSE 'pom' END AS packaging, p_partkey AS stamp FROM part")
def paged_docs(spark, d):
    """Pages of a hundred documents, and answers that are none."""
    p = read(spark, d, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "jar").otherwise("pom")
    doc = F.struct(F.col("p_type").alias("g"), F.col("p_brand").alias("a"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("v"), F.col("p_name").alias("latestVersion"), kind.alias("p"), F.col("p_partkey").alias("timestamp"))
    pages = p.groupBy(F.floor(F.col("p_partkey") / 100)).agg(F.to_json(F.struct(F.struct(F.count("*").alias("numFound"), F.collect_list(doc).alias("docs")).alias("response"))).alias("body"))
    return parse.paged_docs(pages.select("body").union(spark.createDataFrame([("",), ("{}",), (None,)], "body string")))


@query(f"SELECT p_partkey, replace('List<' || {_TYPE} || '>', 'a.' || p_type || '.', '') AS name FROM part")
def output_names(spark, d):
    pkg = F.concat(F.lit("a."), "p_type")
    return read(spark, d, "part").select("p_partkey", T.output_name(F.concat(F.lit("List<"), _type_name(), F.lit(">")), pkg).alias("name"))


_PLAN = """a AS (SELECT c_nationkey AS op, c_custkey AS pos, c_custkey % 7 AS name, c_custkey % 4 AS type, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 4 ORDER BY c_custkey) AS k FROM customer),
b AS (SELECT s_nationkey AS op, s_suppkey AS to_pos, s_suppkey % 7 AS to_name, s_suppkey % 4 AS type, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 4 ORDER BY s_suppkey) AS k FROM supplier),
same AS (SELECT op, pos, to_pos, name, to_name, type, type AS to_type FROM a JOIN b USING (op, type, k)),
ra AS (SELECT op, pos, name, type, row_number() OVER (PARTITION BY op ORDER BY pos) AS k FROM a WHERE (op, pos) NOT IN (SELECT (op, pos) FROM same)),
rb AS (SELECT op, to_pos, to_name, type AS to_type, row_number() OVER (PARTITION BY op ORDER BY to_pos) AS k FROM b WHERE (op, to_pos) NOT IN (SELECT (op, to_pos) FROM same)),
plan AS (SELECT op, pos, to_pos, to_name, to_type, CASE WHEN pos IS NULL THEN 'add' WHEN to_pos IS NULL THEN 'drop' WHEN type <> to_type THEN 'retype' WHEN pos <> to_pos THEN 'move' WHEN name <> to_name THEN 'rename' ELSE 'keep' END AS action
FROM (SELECT * FROM same UNION ALL SELECT op, pos, to_pos, name, to_name, type, to_type FROM ra FULL JOIN rb USING (op, k)))"""


def _plan(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    own = read(spark, d, "customer").select(F.col("c_nationkey").alias("op"), c.alias("pos"), (c % 7).alias("name"), (c % 4).alias("type"))
    wanted = read(spark, d, "supplier").select(F.col("s_nationkey").alias("op"), s.alias("pos"), (s % 7).alias("name"), (s % 4).alias("type"))
    return relations.parameter_plan(own, wanted)


@query(f"WITH {_PLAN} SELECT op, CAST(pos AS VARCHAR) AS pos, CAST(to_pos AS VARCHAR) AS to_pos, CAST(to_name AS VARCHAR) AS to_name, CAST(to_type AS VARCHAR) AS to_type, action FROM plan")
def parameter_plan(spark, d):
    return _plan(spark, d).select("op", *[F.col(c).cast("string").alias(c) for c in ("pos", "to_pos", "to_name", "to_type")], "action")


@query(f"""WITH {_PLAN} SELECT o_orderkey AS call, pos, to_pos, CASE WHEN action = 'retype' THEN CAST(to_type AS VARCHAR) END AS "cast" FROM orders JOIN customer ON o_custkey = c_custkey JOIN plan ON op = c_nationkey AND pos = c_custkey WHERE to_pos IS NOT NULL""")
def call_plan(spark, d):
    calls = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relations.call_plan(calls.select(F.col("o_orderkey").alias("call"), F.col("c_nationkey").alias("op"), F.col("c_custkey").alias("pos")), _plan(spark, d)).withColumn("cast", F.col("cast").cast("string"))


@query("""WITH p AS (SELECT l_orderkey, list_sort(list(l_returnflag)) AS params FROM lineitem GROUP BY l_orderkey), o AS (SELECT * FROM orders JOIN p ON o_orderkey = l_orderkey)
SELECT a.o_orderkey AS i, b.o_orderkey AS j FROM o a JOIN o b USING (o_custkey) WHERE a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AND a.params = b.params""")
def compatible_methods(spark, d):
    p = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_returnflag").alias("params"))
    a = read(spark, d, "orders").join(p, "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("i"), F.col("o_orderstatus").alias("static"), F.col("o_orderpriority").alias("ret"), "params")
    b = a.select("o_custkey", F.col("i").alias("j"), F.col("static").alias("b_static"), F.col("ret").alias("b_ret"), F.col("params").alias("b_params"))
    return matching.compatible_signatures(a, b, ["o_custkey"]).select("i", "j")


@query("""WITH c AS (SELECT p_partkey % 40 AS package, p_partkey AS node, p_partkey % 40 < 25 AND p_size < 20 AS own FROM part), o AS (SELECT node FROM c WHERE own), top AS (SELECT node FROM o WHERE NOT (node % 3 = 0 AND node - 1 IN (SELECT node FROM o))),
r AS (SELECT node FROM top UNION SELECT node + 1 FROM top WHERE node % 4 = 0), kept AS (SELECT package, node FROM c WHERE node IN (SELECT node FROM r))
SELECT * FROM kept UNION ALL SELECT package, node FROM c WHERE package NOT IN (SELECT package FROM kept)""")
def package_components(spark, d):
    p, k = read(spark, d, "part"), F.col("p_partkey")
    c = p.select((k % 40).alias("package"), k.alias("node"), F.when((k % 40 < 25) & (F.col("p_size") < 20), "USERTYPE").otherwise("JAVA").alias("kind"))
    return relations.package_components(c, p.filter(k % 3 == 0).select(k.alias("sub"), (k - 1).alias("super")), p.filter(k % 4 == 0).select(k.alias("src"), (k + 1).alias("dst")))


_GATE = "(({t} = 2 AND {f} = 0) OR ({t} = 3 AND {f} <= 1) OR ({t} = 4 AND {f} <= 2) OR ({t} > 4 AND {f} / {t} < 0.5))"


@query(f"""WITH x AS (SELECT p_partkey, p_size % 6 AS a, least(p_size % 6, p_partkey % 5) AS af, p_size % 4 AS o, least(p_size % 4, p_partkey % 3) AS "of", (p_partkey % 11) / 10 AS name, (p_partkey % 7) / 10 AS words FROM part),
s AS (SELECT *, CASE WHEN {_GATE.format(t="a", f="af")} OR {_GATE.format(t="o", f='"of"')} OR (o = 1 AND "of" = 0) THEN 0.0 WHEN a > 0 OR o > 0 THEN (af + "of") / (a + o) ELSE 1.0 END AS score FROM x),
w AS (SELECT *, CASE a + o WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.8 END AS f FROM s)
SELECT p_partkey, round(score, 6) AS score, round(score * f + least(1.0, name * 0.75 + words * 0.75) * (1 - f), 6) AS blended, round(CASE WHEN score < 0.5 THEN 0.0 ELSE 0.8 * score + 0.2 * name END, 6) AS assigned FROM w""")
def class_scores(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    a, o = n % 6, n % 4
    name, words = (k % 11) / 10, (k % 7) / 10
    x = read(spark, d, "part").select(k, a.alias("a"), o.alias("o"), F.least(a, k % 5).alias("af"), F.least(o, k % 3).alias("of"), name.alias("name"), words.alias("words"))
    score = matching.class_score(F.col("a"), F.col("af"), F.col("o"), F.col("of"))
    x = x.withColumn("score", score)
    blended = matching.blended_class_score(F.col("score"), F.col("name"), F.col("words"), F.col("a") + F.col("o"))
    return x.select("p_partkey", F.round("score", 6).alias("score"), F.round(blended, 6).alias("blended"), F.round(matching.assignment_class_score(F.col("score"), F.col("name")), 6).alias("assigned"))
