"""Queries of member extraction, test candidates and planning joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import filters, matching, members
from quillmesh.plans.registry import query, read


@query("""SELECT o_custkey AS class_id, 'METHOD' AS kind, unnest(list(DISTINCT o_orderpriority)) AS name FROM orders GROUP BY o_custkey UNION ALL SELECT o_custkey, 'FIELD', unnest(list(DISTINCT o_orderstatus)) FROM orders GROUP BY o_custkey
UNION ALL SELECT DISTINCT o_custkey, 'FIELD', '<OUTER>' FROM orders WHERE o_custkey % 2 = 0""")
def class_members(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("class_id")).agg(F.collect_set("o_orderpriority").alias("methods"), F.collect_set("o_orderstatus").alias("fields"))
    return members.class_members(o.withColumn("constants", F.array().cast("array<string>")).withColumn("is_inner", F.col("class_id") % 2 == 0))


@query("""SELECT DISTINCT p_brand AS package, p_type AS class_id FROM part UNION SELECT DISTINCT p_brand, p_type || '$In' FROM part""")
def package_members(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("package"), F.col("p_type").alias("class_id"), F.array(F.concat("p_type", F.lit("$In"))).alias("nested"))
    return members.package_members(p)


_M = """SELECT l_orderkey AS class_id, 'f' || (l_partkey % 5) AS name, CASE l_linenumber % 4 WHEN 0 THEN 'FIELD' WHEN 1 THEN 'GETTER' WHEN 2 THEN 'SETTER' ELSE 'CTOR' END AS kind, CAST(l_quantity AS INTEGER) % 16 AS mods, 'f' || (l_suppkey % 5) AS field, l_linenumber % 2 AS n_params FROM lineitem"""


@query(f"""WITH m AS ({_M}), f AS (SELECT class_id, name FROM m WHERE kind = 'FIELD' AND ((mods & 1) <> 0 OR (mods & 7) = 0) AND (mods & 8) = 0)
SELECT class_id, name, 'field' AS why FROM f UNION ALL SELECT DISTINCT class_id, field, 'getter' FROM m WHERE kind = 'GETTER' AND (mods & 1) <> 0 AND (class_id, field) NOT IN (SELECT (class_id, name) FROM f) UNION ALL SELECT class_id, name, 'ctor' FROM m WHERE kind = 'CTOR' AND (mods & 1) <> 0 AND n_params = 0""")
def public_surface(spark, d):
    k = F.col("l_linenumber")
    kind = F.when(k % 4 == 0, "FIELD").when(k % 4 == 1, "GETTER").when(k % 4 == 2, "SETTER").otherwise("CTOR")
    f = lambda c: F.concat(F.lit("f"), (F.col(c) % 5).cast("string"))
    m = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("class_id"), f("l_partkey").alias("name"), kind.alias("kind"), (F.col("l_quantity").cast("int") % 16).alias("mods"), f("l_suppkey").alias("field"), (k % 2).alias("n_params"))
    return members.public_surface(m)



@query("""WITH t AS (SELECT doc_id AS test_id, source AS parent, 'import ' || text AS text, split_part(text, ' ', 1) AS package FROM documents), c AS (SELECT doc_id AS candidate, split_part(text, ' ', 1) AS package FROM documents)
SELECT candidate, min(test_id) AS test_id FROM c JOIN t USING (package) GROUP BY candidate, md5(text)""")
def candidate_tests(spark, d):
    x = read(spark, d, "documents").select("doc_id", "source", "text", F.split_part("text", F.lit(" "), F.lit(1)).alias("package"))
    t = x.select(F.col("doc_id").alias("test_id"), F.col("source").alias("parent"), F.concat(F.lit("import "), "text").alias("text"), "package")
    return members.candidate_tests(x.select(F.col("doc_id").alias("candidate"), "package"), t)


@query("""SELECT min(doc_id) AS test_id FROM documents GROUP BY md5('import ' || text)""")
def global_tests(spark, d):
    x = read(spark, d, "documents").select(F.col("doc_id").alias("test_id"), F.col("source").alias("parent"), F.concat(F.lit("import "), "text").alias("text"), F.split_part("text", F.lit(" "), F.lit(1)).alias("package"))
    return members.candidate_tests(x, x, own=False)


@query("""SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR contains(text, 'import ' || lang) OR contains(text, 'package ' || lang)""")
def relevant_tests(spark, d):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("import "), "lang", F.lit(" "))).otherwise(F.lit(""))
    t = read(spark, d, "documents").select("doc_id", F.concat(head, "text").alias("text"), F.array("lang").alias("packages"))
    return filters.relevant_tests(t).select("doc_id")


@query("""SELECT o_orderkey AS file, o_orderpriority AS symbol, m.to_name, CASE WHEN to_name IS NULL THEN 'keep' WHEN o_orderstatus IS DISTINCT FROM to_type THEN 'retype' WHEN o_orderpriority <> to_name THEN 'rename' ELSE 'same' END AS action FROM orders LEFT JOIN (VALUES ('1-URGENT', 'now', 'O'), ('2-HIGH', '2-HIGH', 'F')) m(from_name, to_name, to_type) ON o_orderpriority = from_name""")
def rename_plan(spark, d):
    s = read(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("type_name"))
    return members.rename_plan(s, spark.createDataFrame([("1-URGENT", "now", "O"), ("2-HIGH", "2-HIGH", "F")], "from_name string, to_name string, to_type string"))


@query("""SELECT DISTINCT p_brand AS name, p_partkey AS element FROM part""")
def name_lookup(spark, d):
    p = read(spark, d, "part")
    return members.elements_by_name(p.select(F.col("p_brand").alias("name")).distinct(), p.select(F.col("p_partkey").alias("element"), F.concat("p_brand", F.lit("(int)")).alias("full_name")))


@query("""WITH c AS (SELECT n_regionkey AS k, n_nationkey AS id, lower(n_name) AS nm FROM nation) SELECT a.id, b.id AS other, round(1 + 1 - levenshtein(a.nm, b.nm) / greatest(length(a.nm), length(b.nm)), 6) AS score FROM c a JOIN c b USING (k) WHERE a.id < b.id""")
def component_scores(spark, d):
    c = read(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("id"), F.array("n_name", F.lit("toString")).alias("a"))
    x = c.join(c.select("k", F.col("id").alias("other"), F.array(F.get("a", F.lit(0)), F.lit("equals")).alias("b")), "k").filter("id < other")
    return x.select("id", "other", F.round(matching.component_score(F.lit(True), F.col("a"), F.col("b")), 6).alias("score"))


@query()
def dictionary_split(spark, d):
    """Names without borders as dictionary words."""
    x = spark.createDataFrame([("gethttpserver",), ("xyz",), ("serverget",)], "name string")
    return members.split_by_dictionary(x, {"get", "http", "server"}).select("name", F.array_join("parts", " ").alias("parts"))
