"""Members of classes and packages, test candidates, and the planning joins of renames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import filters
from quillmesh.operators.graph import written


def class_members(classes: DataFrame) -> DataFrame:
    """(class_id, kind, name) of classes (class_id, methods, fields, constants, is_inner): inner ones have <OUTER> too."""
    each = lambda col, kind: classes.select("class_id", F.lit(kind).alias("kind"), F.explode(col).alias("name"))
    outer = classes.filter("is_inner").select("class_id", F.lit("FIELD").alias("kind"), F.lit("<OUTER>").alias("name"))
    return each("methods", "METHOD").unionByName(each("fields", "FIELD")).unionByName(each("constants", "CONSTANT")).unionByName(outer)


def package_members(classes: DataFrame) -> DataFrame:
    """(package, class_id) of top-level and nested types (package, class_id, nested array)."""
    top = classes.select("package", "class_id")
    return top.union(classes.select("package", F.explode("nested"))).distinct()


def public_surface(members: DataFrame) -> DataFrame:
    """(class_id, name, why) of members (class_id, name, kind, mods, field, n_params): open fields that aren't static, fields behind public getters, public constructors without parameters.

    kind is FIELD, GETTER, SETTER, METHOD or CTOR; setters are left out.
    """
    open_fields = members.filter((F.col("kind") == "FIELD") & filters.accessible(F.col("mods"), "FIELD") & ~filters.has(F.col("mods"), filters.STATIC)).select("class_id", "name", F.lit("field").alias("why"))
    got = members.filter((F.col("kind") == "GETTER") & filters.has(F.col("mods"), filters.PUBLIC)).select("class_id", F.col("field").alias("name"), F.lit("getter").alias("why"))
    got = got.join(open_fields.select("class_id", "name"), ["class_id", "name"], "left_anti").distinct()
    ctor = members.filter((F.col("kind") == "CTOR") & filters.has(F.col("mods"), filters.PUBLIC) & (F.col("n_params") == 0)).select("class_id", "name", F.lit("ctor").alias("why"))
    return open_fields.unionByName(got).unionByName(ctor)


TILE = 2048  # candidates and tests that meet in one piece of a package's pairs
MOST_TASKS = 100_000


def candidate_tests(candidates: DataFrame, tests: DataFrame, own: bool = True, viable: Column | bool = True) -> DataFrame:
    """(candidate, test_id): viable tests (test_id, parent, text, package) of each candidate's package (candidate, package), one per digest.

    own=False gives all viable tests to every package that has candidates by their digest once (the global tests).
    The pairs of a candidate of one package are never shuffled: they are as many as the result.
    """
    named = tests.filter(F.lit(viable) if isinstance(viable, bool) else viable).filter(F.col("text").contains(F.concat(F.lit("import "), F.col("package"))) | F.col("text").contains(F.concat(F.lit("package "), F.col("package"))))
    if not own:
        return named.groupBy(F.md5("text").alias("digest")).agg(F.min("test_id").alias("test_id")).select("test_id")
    # a package's tests are one per digest before its candidates meet them
    once = written(named.groupBy("package", F.md5("text").alias("digest")).agg(F.min("test_id").alias("test_id")))
    of = written(candidates.groupBy("candidate").agg(F.collect_set("package").alias("packages")))
    single = _met(of.filter(F.size("packages") == 1).select("candidate", F.get("packages", F.lit(0)).alias("package")), once.select("package", "test_id"))
    several = of.filter(F.size("packages") > 1)
    if several.isEmpty():
        return single
    # only here a digest can come from two packages
    x = _met(several.select("candidate", F.explode("packages").alias("package")), once).groupBy("candidate", "digest").agg(F.min("test_id").alias("test_id"))
    return single.unionByName(x.select("candidate", "test_id"))


def _met(candidates: DataFrame, tests: DataFrame) -> DataFrame:
    """candidates (candidate, package) joined with their package's tests; a large package is cut into tiles, a task's work each."""
    size = lambda t, n: t.groupBy("package").agg(F.count("*").alias(n))
    sizes = written(size(candidates, "nc").join(size(tests, "nt"), "package"))
    work = sizes.agg(F.sum(F.col("nc").cast("double") * F.col("nt"))).first()[0] or 0
    tasks = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(work // TILE**2) + 1, MOST_TASKS))
    cuts = sizes.select("package", F.ceil(F.col("nc") / TILE).alias("ni"), F.ceil(F.col("nt") / TILE).alias("nj"))

    def tiled(t, key, own, ni, other, nj):
        t = t.join(cuts, "package").withColumn(own, F.pmod(F.xxhash64(key), F.col(ni)))
        return t.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(nj) - 1))).drop("ni", "nj").repartition(tasks, "package", "i", "j")

    x = tiled(candidates, "candidate", "i", "ni", "j", "nj").join(tiled(tests, "test_id", "j", "nj", "i", "ni"), ["package", "i", "j"])
    return x.drop("package", "i", "j")


def rename_plan(symbols: DataFrame, name_map: DataFrame) -> DataFrame:
    """(file, symbol, to_name, action) of symbols (file, symbol, type_name): what the name map renames, retypes or leaves.

    name_map: (from_name, to_name, to_type).
    """
    m = name_map.withColumnRenamed("from_name", "symbol")
    action = F.when(F.col("to_name").isNull(), "keep").when(~F.col("type_name").eqNullSafe(F.col("to_type")), "retype").when(F.substring_index("symbol", ".", -1) != F.substring_index("to_name", ".", -1), "rename").otherwise("same")
    return symbols.join(m, "symbol", "left").select("file", "symbol", "to_name", action.alias("action"))


def elements_by_name(names: DataFrame, elements: DataFrame) -> DataFrame:
    """(name, element): elements (element, full_name) of the name itself, or of the name before its parameter list."""
    e = elements.select("element", F.explode(F.array_distinct(F.array(F.col("full_name"), F.regexp_extract("full_name", r"^([^(]*)", 1)))).alias("name"))
    return names.join(e, "name").distinct()


def split_by_dictionary(names: DataFrame, words: set[str], name: str = "name", least: int = 3) -> DataFrame:
    """(name, parts): a name as dictionary words of `least` letters or more, the longest first; itself where there is no such split."""

    def cut(s: str) -> list[str] | None:
        low, best = s.lower(), [None] * (len(s) + 1)
        best[len(s)] = []
        for i in range(len(s) - least, -1, -1):
            for j in range(len(s), i + least - 1, -1):
                if best[j] is not None and low[i:j] in words:
                    best[i] = [s[i:j], *best[j]]
                    break
        return best[0]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({name: pdf[name], "parts": [None if s is None else cut(s) or [s] for s in pdf[name]]})

    return names.select(name).mapInPandas(run, f"{name} string, parts array<string>")
