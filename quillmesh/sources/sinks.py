"""Writers: count tables, model XML, annotated source, size report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.sources.parse import KGRAM_MARK


def write_counts(words: DataFrame, n: int, grams: DataFrame, n_grams: int, path: str) -> None:
    """Count tables as Parquet: words, kgrams (term, df) and corpus size."""
    spark = words.sparkSession
    words.select("term", "df").write.mode("overwrite").parquet(f"{path}/df_words")
    grams.select("term", "df").write.mode("overwrite").parquet(f"{path}/df_kgrams")
    spark.createDataFrame([("word", n), ("kgram", n_grams)], "kind string, n long").write.mode("overwrite").parquet(f"{path}/corpus_size")


def count_lines(words: DataFrame, n: int, grams: DataFrame, n_grams: int) -> DataFrame:
    """The text form of count tables, a line a row, to be written in this order."""
    spark = words.sparkSession
    line = lambda df, k: df.select(F.lit(k).alias("part"), "term", F.concat_ws(" ", F.col("df").cast("string"), "term").alias("line"))
    head = spark.createDataFrame([(0, "", str(n)), (2, "", KGRAM_MARK), (3, "", str(n_grams))], "part int, term string, line string")
    return head.unionByName(line(words, 1)).unionByName(line(grams, 4)).orderBy("part", "term").select("line")


def _escape(c):
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _tag(name: str, attrs: dict, body=None):
    parts = [F.lit(f"<{name}")]
    for k, v in attrs.items():
        parts.append(F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), _escape(v.cast("string")), F.lit('"'))).otherwise(F.lit("")))
    return F.concat(*parts, F.lit(">"), body if body is not None else F.lit(""), F.lit(f"</{name}>"))


def _joined(df: DataFrame, keys: list[str], xml: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", xml))), lambda x: x[xml]), "").alias(out))


def model_xml(models: DataFrame, classes: DataFrame, attributes: DataFrame, operations: DataFrame, parameters: DataFrame, edges: DataFrame) -> DataFrame:
    """(model_id, xml): MODEL, PACKAGE, CLASS/INTERFACE/ENUM, ATTRIBUTE, OPERATION, PARAMETER, ASSOCIATION; one value per model."""
    c = F.col
    p = parameters.select("model_id", "op_id", F.lpad(c("pos").cast("string"), 9, "0").alias("ord"), _tag("PARAMETER", {"NAME": c("name"), "TYPE": c("type_name")}).alias("x"))
    p = _joined(p, ["model_id", "op_id"], "x", "params")
    o = operations.join(p, ["model_id", "op_id"], "left")
    o = o.select("model_id", "class_id", F.concat(F.lit("2"), "op_id").alias("ord"), _tag("OPERATION", {"NAME": c("name"), "RETURN": c("ret_type"), "ACCESS": c("access")}, F.coalesce("params", F.lit(""))).alias("x"))
    a = attributes.select("model_id", "class_id", F.concat(F.lit("1"), "attr_id").alias("ord"), _tag("ATTRIBUTE", {"NAME": c("name"), "TYPE": c("type_name"), "ACCESS": c("access")}).alias("x"))
    m = _joined(a.unionByName(o), ["model_id", "class_id"], "x", "members")
    k = classes.join(m, ["model_id", "class_id"], "left")
    body = F.coalesce("members", F.lit(""))
    tag = F.when(c("is_enum"), _tag("ENUM", {"NAME": c("name"), "SUPER": c("super_name")}, body)).when(c("is_interface"), _tag("INTERFACE", {"NAME": c("name"), "SUPER": c("super_name")}, body)).otherwise(_tag("CLASS", {"NAME": c("name"), "SUPER": c("super_name")}, body))
    k = _joined(k.select("model_id", c("class_id").alias("ord"), tag.alias("x")), ["model_id"], "x", "class_xml")
    e = edges.select("model_id", F.concat("src", F.lit(" "), "dst").alias("ord"), _tag("ASSOCIATION", {"FROM": c("src"), "TO": c("dst")}).alias("x"))
    e = _joined(e, ["model_id"], "x", "edge_xml")
    d = models.join(k, "model_id", "left").join(e, "model_id", "left")
    return d.select("model_id", _tag("MODEL", {"NAME": c("name")}, _tag("PACKAGE", {"NAME": c("package")}, F.concat(F.coalesce("class_xml", F.lit("")), F.coalesce("edge_xml", F.lit(""))))).alias("xml"))


def pattern_source(models: DataFrame, classes: DataFrame, attributes: DataFrame, operations: DataFrame, parameters: DataFrame, edges: DataFrame, headers: DataFrame | None = None, notes: tuple[str, str, str] = ("Pattern", "PatternPackage", "PatternClass")) -> DataFrame:
    """(model_id, source): a model as annotated declarations. headers (model_id, key, value) stand before it, a key's values together in order; notes name the annotations of headers, packages and classes."""
    c = F.col
    p = _joined(parameters.select("model_id", "op_id", F.lpad(c("pos").cast("string"), 9, "0").alias("ord"), F.concat(F.when(c("pos") > 0, ", ").otherwise(""), "type_name", F.lit(" "), "name").alias("x")), ["model_id", "op_id"], "x", "params")
    o = operations.join(p, ["model_id", "op_id"], "left").select("model_id", "class_id", F.concat(F.lit("2"), "op_id").alias("ord"), F.concat(F.lit("      "), F.when(c("is_ctor"), F.lit("")).otherwise(F.concat("ret_type", F.lit(" "))), "name", F.lit("("), F.coalesce("params", F.lit("")), F.lit(");\n")).alias("x"))
    a = attributes.select("model_id", "class_id", F.concat(F.lit("1"), "attr_id").alias("ord"), F.concat(F.lit("      "), "type_name", F.lit(" "), "name", F.lit(";\n")).alias("x"))
    m = _joined(a.unionByName(o), ["model_id", "class_id"], "x", "members")
    u = edges.join(classes.select("model_id", c("class_id").alias("dst"), "name"), ["model_id", "dst"]).groupBy("model_id", c("src").alias("class_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("name", F.lit(".class")))), ",").alias("uses"))
    k = classes.join(m, ["model_id", "class_id"], "left").join(u, ["model_id", "class_id"], "left")
    word = F.when(c("is_enum"), "enum ").when(c("is_interface"), "interface ").otherwise("class ")
    k = k.select("model_id", c("class_id").alias("ord"), F.concat(F.lit(f"   @{notes[2]}"), F.when(c("uses").isNotNull(), F.concat(F.lit("(uses={"), "uses", F.lit("})"))).otherwise(""), F.lit("\n   "), word, "name", F.lit(" {\n"), F.coalesce("members", F.lit("")), F.lit("   }\n")).alias("x"))
    k = _joined(k, ["model_id"], "x", "body")
    m = models.join(k, "model_id", "left").withColumn("head", F.lit(""))
    if headers is not None:
        quoted = F.transform(F.array_sort(F.collect_list("value")), lambda v: F.concat(F.lit('"'), v, F.lit('"')))
        h = headers.groupBy("model_id", "key").agg(quoted.alias("v"))
        line = F.concat(F.lit(f"@{notes[0]}("), "key", F.lit("="), F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("v", ","), F.lit("}"))), F.lit(")\n"))
        h = _joined(h.select("model_id", c("key").alias("ord"), line.alias("x")), ["model_id"], "x", "lines")
        m = m.join(h, "model_id", "left").withColumn("head", F.coalesce("lines", F.lit("")))
    return m.select("model_id", F.concat("head", F.lit(f"@{notes[1]}\ninterface "), "name", F.lit(" {\n"), F.coalesce("body", F.lit("")), F.lit("}\n")).alias("source"))


def size_report(classes: DataFrame, edges: DataFrame, operations: DataFrame, attributes: DataFrame) -> DataFrame:
    """Averages: classes and edges per model, operations and attributes per class; null where there is nothing to divide by. Counts only are joined."""
    one = lambda df, n, *k: df.agg(F.count("*").alias(n), *[F.countDistinct(x).alias(f"{n}_{x}") for x in k])
    c, e, o, a = one(classes, "c", "model_id").first(), one(edges, "e").first(), one(operations, "o").first(), one(attributes, "a").first()
    rate = lambda x, y: float(x) / y if y else None
    row = (rate(c["c"], c["c_model_id"]), rate(e["e"], c["c_model_id"]), rate(o["o"], c["c"]), rate(a["a"], c["c"]))
    return classes.sparkSession.createDataFrame([row], "classes_per_model double, edges_per_model double, ops_per_class double, attrs_per_class double")
