"""From imports to libraries: lookup tables instead of remote services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import filters as flt
from quillmesh.operators import graph


def works_for(coordinates: DataFrame, imports: DataFrame) -> DataFrame:
    """(lib_id, import): imports that a coordinate's classes (lib_id, cls) serve, as they are or by an outer class."""
    from quillmesh.functions import text as T

    i = imports.select("import", F.explode(T.import_prefixes(F.col("import"))).alias("cls"))
    return i.join(coordinates.select("lib_id", "cls"), "cls").select("lib_id", "import").distinct()


def same_package(imports: DataFrame, answers: DataFrame) -> DataFrame:
    """(import, lib_id): an import's own answer, or that of the first class of its package."""
    pkg = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)
    own = imports.join(answers, "import", "left")
    first = answers.groupBy(pkg(F.col("import")).alias("pkg")).agg(F.min_by("lib_id", "import").alias("sibling"))
    return own.withColumn("pkg", pkg(F.col("import"))).join(first, "pkg", "left").select("import", F.coalesce("lib_id", "sibling").alias("lib_id"))


def fixed_versions(libs: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """libs (lib_id, version): null and LATEST versions by id, from known libraries, else from the first jar row (lib_id, version, packaging, ord)."""
    k = known.groupBy("lib_id").agg(F.min("version").alias("known"))
    j = rows.filter("packaging = 'jar'").groupBy("lib_id").agg(F.min_by("version", "ord").alias("found"))
    v = F.when(F.col("version").isNull() | (F.col("version") == "LATEST"), F.coalesce("known", "found", "version")).otherwise(F.col("version"))
    return libs.join(k, "lib_id", "left").join(j, "lib_id", "left").select("lib_id", v.alias("version"))


def named_libraries(rows: DataFrame, group: str, most: int = 100) -> DataFrame:
    """Jar rows of each group's first `most` rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy("ord")
    return rows.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= most) & (F.col("packaging") == "jar")).drop("_r")


def exists(libs: DataFrame, rows: DataFrame) -> DataFrame:
    return libs.join(rows.select("lib_id", "version"), ["lib_id", "version"], "left_semi")


def project_libraries(needed: DataFrame, serves: DataFrame) -> DataFrame:
    """(import, lib_id): the first project library (by ord) that serves each needed import."""
    return needed.join(serves, "import").groupBy("import").agg(F.min_by("lib_id", "ord").alias("lib_id"))


def join_user(user: DataFrame, candidates: DataFrame) -> DataFrame:
    """User libraries (lib_id, grp, version) with candidates by id, else by group and equal version."""
    c = candidates.select(F.col("lib_id").alias("cand_id"), F.col("grp"), F.col("version").alias("cand_version"))
    by_id = user.join(c.drop("grp"), F.col("lib_id") == F.col("cand_id"))
    rest = user.join(by_id.select("lib_id"), "lib_id", "left_anti")
    by_group = rest.join(c, "grp").filter("version <=> cand_version")
    return by_id.select("lib_id", "cand_id", F.lit("id").alias("how")).unionByName(by_group.select("lib_id", "cand_id", F.lit("group").alias("how")))


def find_libraries(imports: DataFrame, project: DataFrame, coverage: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(libraries, missing imports): project libraries first, then by name, then the greedy cover.

    imports (import), project (lib_id, import, ord), coverage (lib_id, import), names (lib_id, lib_name).
    """
    spark = imports.sparkSession
    own = project_libraries(imports, project)
    left = imports.join(own, "import", "left_anti")
    cov = coverage.join(left, "import", "left_semi")
    preferred, rest = graph.prefix_cover(cov)
    greedy = graph.set_cover(rest.join(names, "lib_id"))
    libs = own.select("lib_id").distinct().unionByName(spark.createDataFrame([(x,) for x in preferred], "lib_id string")).unionByName(greedy.select("lib_id")).distinct()
    return libs, left.join(coverage.select("import").distinct(), "import", "left_anti")


def import_report(used: DataFrame, related: DataFrame) -> DataFrame:
    """(cluster_id, import): non-standard imports that are not of a related package (pkg), once a cluster."""
    nothing = used.sparkSession.createDataFrame([], "import string")
    ok = flt.new_imports(used, nothing, nothing)
    u = used.select("cluster_id", "import").distinct().join(ok, "import", "left_semi")
    fronts = F.expr(r"transform(sequence(1, size(split(import, '[.]'))), i -> substring_index(import, '.', i))")
    of = u.select("import", F.explode(fronts).alias("pkg")).filter("pkg <> import").join(related.select("pkg"), "pkg", "left_semi")
    return u.join(of.select("import").distinct(), "import", "left_anti").select("cluster_id", "import")
