"""Queries that read models from declarations, page through answers, and report containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import cluster, matching
from quillmesh.plans.graph_queries import contacts
from quillmesh.plans.registry import query, read
from quillmesh.sources import models, parse


def _sources(spark, d):
    """A file of declarations for each brand: a class a part, which uses the brand's class of the same type that comes first."""
    k, first = F.col("p_partkey").cast("string"), F.col("first").cast("string")
    p = read(spark, d, "part")
    p = p.join(p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first")), ["p_brand", "p_type"])
    kind = F.when(F.col("p_size") % 3 == 0, "int").when(F.col("p_size") % 3 == 1, "String").otherwise(F.concat(F.lit("List<P"), first, F.lit(">")))
    body = F.concat(F.lit("@PatternClass\nabstract class P"), k, F.lit(" {\n  private "), kind, F.lit(" f = make(1, 2), g[];  // class X {}\n  public P"), k, F.lit("(int size) { this.f = size; }\n  public abstract P"), first, F.lit(" with(String name, long... rest);\n}\n"))
    text = F.concat(F.lit("package a.b;\nimport java.util.*;\n@PatternPackage\ninterface M {\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", body.alias("body")))), lambda x: x["body"]), "\n"), F.lit("}\n"))
    return p.groupBy(F.col("p_brand").alias("file")).agg(text.alias("text"))


_PARTS = "WITH p AS (SELECT p_brand AS model_id, 'P' || p_partkey AS c, 'P' || min(p_partkey) OVER (PARTITION BY p_brand, p_type) AS first, p_size FROM part)"


@query(f"""{_PARTS}, t AS (SELECT *, CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'String' ELSE 'List<' || first || '>' END AS type, CASE p_size % 3 WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'STRING' ELSE 'COLLECTION' END AS arg FROM p),
m AS (SELECT model_id, 'CLASS' AS kind, 'a.b.M.' || c AS full_name, NULL AS type_name, NULL AS arg_type FROM t
UNION ALL SELECT model_id, 'ATTRIBUTE', 'a.b.M.' || c || '.f', type, arg FROM t
UNION ALL SELECT model_id, 'ATTRIBUTE', 'a.b.M.' || c || '.g', type || '[]', 'ARRAY' FROM t
UNION ALL SELECT model_id, 'CONSTRUCTOR', 'a.b.M.' || c || '.' || c || '(int)', 'void', 'VOID' FROM t
UNION ALL SELECT model_id, 'OPERATION', 'a.b.M.' || c || '.with(String,long_ARR_)', first, CASE WHEN c = first THEN 'THISTYPE' ELSE 'USERTYPE' END FROM t
UNION ALL SELECT model_id, 'PARAMETER', 'a.b.M.' || c || '.' || c || '.size', 'int', 'NUMBER' FROM t
UNION ALL SELECT model_id, 'PARAMETER', 'a.b.M.' || c || '.with.name', 'String', 'STRING' FROM t
UNION ALL SELECT model_id, 'PARAMETER', 'a.b.M.' || c || '.with.rest', 'long[]', 'ARRAY' FROM t)
SELECT * FROM m""")
def loaded_elements(spark, d):
    """Every element of the models that are read from sources."""
    m = models.load_models(_sources(spark, d))
    row = lambda t, kind, name, type_, arg: t.select("model_id", kind.alias("kind"), name.alias("full_name"), type_.alias("type_name"), arg.alias("arg_type"))
    c, none = F.col, F.lit(None).cast("string")
    out = row(m.classes, F.lit("CLASS"), c("full_name"), none, none).union(row(m.attributes, F.lit("ATTRIBUTE"), c("full_name"), c("type_name"), c("arg_type")))
    out = out.union(row(m.operations, F.when(c("is_ctor"), "CONSTRUCTOR").otherwise("OPERATION"), c("map_name"), c("ret_type"), c("ret_arg_type")))
    return out.union(row(m.parameters, F.lit("PARAMETER"), c("full_name"), c("type_name"), c("arg_type")))


@query(f"{_PARTS} SELECT DISTINCT model_id, c AS src, first AS dst FROM p WHERE c <> first")
def loaded_edges(spark, d):
    return models.load_models(_sources(spark, d)).edges


@query("SELECT p_type AS query, CAST(start AS BIGINT) AS start FROM (SELECT p_type, max(p_size) * 100 AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY p_type), range(0, 4000, 100) r(start) WHERE start > 0 AND start < n")
def next_pages(spark, d):
    """Pages that first pages say are still to come."""
    p = read(spark, d, "part").filter("p_partkey % 2 = 0")
    body = F.to_json(F.struct(F.struct((F.col("p_size") * 100).cast("long").alias("numFound")).alias("response")))
    return parse.next_pages(p.select(F.col("p_type").alias("query"), F.lit(0).alias("start"), body.alias("body")))


@query("SELECT p_type AS query, CASE WHEN length(max(p_name) FILTER (p_size > 25)) >= 10 THEN max(p_name) FILTER (p_size > 25) END AS body, count(*) FILTER (p_size > 25) = 0 AS fetch FROM part GROUP BY p_type")
def cached_answers(spark, d):
    p = read(spark, d, "part")
    return parse.cached_answers(p.select(F.col("p_type").alias("query")), p.filter("p_size > 25").select(F.col("p_type").alias("query"), F.col("p_name").alias("body")))


@query()
def growing_clusters(spark, d):
    """Leader clusters whose leaders gain what joins them."""
    p = read(spark, d, "part").select("p_brand", "p_partkey", F.split("p_type", " ").alias("words"))
    return cluster.leader_clusters(p, "p_brand", "p_partkey", "words", 0.5, grow=True)


@query("SELECT * FROM (VALUES ('a', 'near'), ('a', 'far'), ('b', 'pat'), ('b', 'far'), ('c', 'pat'), ('c', 'near'), ('c', 'far')) AS t(cluster_id, model_id)")
def containment_report(spark, d):
    """Models that contain a model of each cluster: every other one of like shape; classes without members (c) fit any."""
    m = matching.nested_models(*contacts(spark))
    members = spark.createDataFrame([("a", "pat"), ("b", "near"), ("c", "none")], "cluster_id string, model_id string")
    candidates = spark.createDataFrame([(c, x) for c in "abc" for x in ("pat", "near", "far", "none")], "cluster_id string, model_id string")
    return matching.containment_report(members, m, candidates)
