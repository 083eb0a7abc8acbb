"""Threshold filters, fallbacks, relevance filters, digest and containment deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.plans.params import DEFAULTS, Parameters

#: Modifier bits of members (the class file's values).
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL, ABSTRACT = 0x1, 0x2, 0x4, 0x8, 0x10, 0x400


def has(mods: Column, bit: int) -> Column:
    return mods.bitwiseAND(bit) != 0


def accept(scores, kind: str, tight: bool = False, p: Parameters = DEFAULTS) -> Column:
    """Whether a result's scores pass for a PACKAGE, CLASS or METHOD search. scores: name -> Column; flags are 0 or 1."""
    s = lambda k: F.coalesce(scores(k), F.lit(0))
    ok = s("ABSTRACT") == 0
    if kind == "PACKAGE":
        ok &= (s("TERMMATCHES") >= p.min_package_term_match) & (s("FIELDS") >= p.min_fields) & (s("METHODS") >= p.min_methods) & s("TYPES").between(p.min_types, p.max_types)
    elif kind == "CLASS":
        ok &= (s("TERMMATCHES") >= 10) & (s("ACCESSIBLE") >= 2) & (s("FIELDS") != 0) & (s("METHODS") >= 2) & (s("TESTCASE") == 0)
    elif kind == "METHOD":
        ok &= (s("TERMMATCHES") >= 1) & (s("TESTCASE") == 0) & (s("NO_LOOPS") == 0) & (s("TRIVIAL") == 0)
    return ok & ~((s("TERMTITLEMATCH") == 0) & (s("KEYMATCH") != 1)) if tight else ok


def tight_or_loose(df: DataFrame, tight: Column, loose: Column, least: int = 4) -> DataFrame:
    """Rows that pass the tight filter, or, where at most `least` do, rows that pass the loose one. One pass counts, one filters."""
    n = df.filter(tight).limit(least + 1).count()
    return df.filter(tight if n > least else loose)


def relevant_tests(tests: DataFrame, text: str = "text", packages: str = "packages") -> DataFrame:
    """Rows whose text names one of their packages in a package or import line."""
    says = lambda p: F.col(text).contains(F.concat(F.lit("package "), p)) | F.col(text).contains(F.concat(F.lit("import "), p))
    return tests.filter(F.exists(packages, says))


def relevant_member(mods: Column, kind: str, search: str) -> Column:
    """CLASS searches leave out abstract members, PACKAGE searches private ones; fields must not be static or final."""
    ok = ~has(mods, ABSTRACT) if search == "CLASS" else ~has(mods, PRIVATE) if search == "PACKAGE" else F.lit(True)
    return ok & ~has(mods, STATIC) & ~has(mods, FINAL) if kind == "FIELD" else ok


def accessible(mods: Column, kind: str, package_fields: bool = DEFAULTS.use_package_fields) -> Column:
    shared = ~has(mods, PRIVATE) & ~has(mods, PROTECTED) & ~has(mods, PUBLIC)
    if kind == "METHOD":
        return ~has(mods, ABSTRACT) & (has(mods, PUBLIC) | shared)
    return has(mods, PUBLIC) | shared if package_fields else has(mods, PUBLIC)


def ignorable_class(mods: Column, is_enum: Column, n_methods: Column, is_test: Column) -> Column:
    return has(mods, PRIVATE) | is_enum | (n_methods == 0) | is_test


def symbol_threshold(members: DataFrame, cls: str = "class_id", score: str = "term_match", title: str = "title_match", always: Column | None = None) -> DataFrame:
    """Members whose score reaches min(class average, 0.5) - 0.01 (to nine digits), or with a title match, or that always stay."""
    mean = F.avg(score).over(Window.partitionBy(cls))
    m = members.withColumn("_over", F.round(F.col(score) - F.least(mean, F.lit(0.5)) + 0.01, 9))
    keep = (F.col("_over") >= 0) | (F.col(title) >= 1)
    return m.filter(keep if always is None else keep | always).drop("_over")


def getter(n_params: Column, returns: Column, n_statements: Column, n_returns: Column, n_fields: Column) -> Column:
    return (n_params == 0) & (returns != "VOID") & (n_statements == 1) & (n_returns == 1) & (n_fields == 1)


def setter(name: Column, n_params: Column, n_statements: Column, n_assigned: Column) -> Column:
    return name.startswith("set") & (n_params > 0) & (n_statements == n_params) & (n_assigned == n_params)


def matchable(classes: DataFrame, defined: DataFrame) -> DataFrame:
    """classes (class_id, supers array) with is_matchable: all super types are in `defined` (name)."""
    missing = classes.select("class_id", F.explode("supers").alias("name")).join(defined.select("name"), "name", "left_anti").select("class_id").distinct()
    return classes.join(missing.withColumn("_m", F.lit(True)), "class_id", "left").withColumn("is_matchable", F.col("_m").isNull()).drop("_m")


def new_imports(imports: DataFrame, done: DataFrame, missing: DataFrame, standard=("java.", "javax.", "org.w3c.dom.", "org.xml.sax.", "sun.")) -> DataFrame:
    """Distinct imports (import) that are not null, standard, done or known to be missing."""
    ok = F.col("import").isNotNull()
    for s in standard:
        ok &= ~F.col("import").startswith(s)
    return imports.filter(ok).select("import").distinct().join(done, "import", "left_anti").join(missing, "import", "left_anti")


def imports_in_use(types: DataFrame, imports: DataFrame) -> DataFrame:
    """(model_id, import): distinct imports that used types need, by equality or by their package's star; java.lang left out.

    A type's package is one key, so both kinds of import are equi-joins.
    """
    t = types.filter(~F.col("type").startswith("java.lang.")).select("model_id", "type").distinct()
    t = t.select("model_id", F.explode(F.array(F.col("type"), F.concat(F.regexp_extract("type", r"^(.*)\.[^.]*$", 1), F.lit(".*")))).alias("import"))
    return t.join(imports.select("model_id", "import").distinct(), ["model_id", "import"]).distinct()


def viable_tests(tests: DataFrame, resolvable: DataFrame | None = None) -> DataFrame:
    """All tests; with `resolvable` (import), those whose imports (array) all resolve."""
    if resolvable is None:
        return tests
    bad = tests.select("test_id", F.explode("imports").alias("import")).join(resolvable, "import", "left_anti").select("test_id").distinct()
    return tests.join(bad, "test_id", "left_anti")


def test_counts(methods: DataFrame, owner: str = "file") -> DataFrame:
    """Distinct methods that carry a Test annotation (of JUnit or unqualified), constructors left out."""
    is_test = F.exists("annotations", lambda a: (a == "Test") | a.rlike(r"junit.*Test$"))
    return methods.filter(is_test & ~F.col("is_ctor")).groupBy(owner).agg(F.countDistinct("method_id").alias("n_tests"))


def first_per_digest(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each distinct text, with the number of rows that have it."""
    return df.groupBy(F.md5(F.col(text)).alias("digest")).agg(F.min(F.struct(order, *[c for c in df.columns if c != order])).alias("r"), F.count("*").alias("copies")).select("digest", "copies", "r.*")


def drop_contained(results: DataFrame, project: str, ident: str, items: str) -> DataFrame:
    """Within a project, results whose set of items no other's contains; of equal sets the first stays.

    A set that is contained shares its rarest item with its container, so the sets meet by that item
    only, after equal sets are collapsed.
    """
    r = results.withColumn("_s", F.array_sort(F.array_distinct(items)))
    sets = r.groupBy(project, "_s").agg(F.min(ident).alias(ident))
    each = sets.select(project, "_s", F.explode("_s").alias("_i"))
    often = each.groupBy(project, "_i").agg(F.count("*").alias("_n"))
    key = each.join(often, [project, "_i"]).groupBy(project, "_s").agg(F.min(F.struct("_n", "_i"))["_i"].alias("_i"))
    bigger = each.select(project, "_i", F.col("_s").alias("_b"))
    inside = key.join(bigger, [project, "_i"]).filter((F.size("_b") > F.size("_s")) & (F.size(F.array_except("_s", "_b")) == 0)).select(project, "_s").distinct()
    nothing = sets.filter((F.size("_s") == 0)).join(sets.filter(F.size("_s") > 0).select(project).distinct(), project, "left_semi").select(project, "_s")
    keep = sets.join(inside.unionByName(nothing), [project, "_s"], "left_anti")
    return results.join(keep.select(project, ident), [project, ident], "left_semi")


def greatest_priority(df: DataFrame, priority: str, by: list[str]) -> DataFrame:
    """Rows of the highest priority present in each group."""
    top = df.groupBy(*by).agg(F.max(priority).alias(priority))
    return df.join(top, [*by, priority], "left_semi")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
