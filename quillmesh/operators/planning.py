"""Plans of source rewriting as joins: packages, inner classes, types of fields, test code, undefined and untested parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import graph


def _fronts(name: Column) -> Column:
    """The dotted prefixes of a name, itself included; none of a null."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def _last(name: Column, n: int) -> Column:
    return F.substring_index(name, ".", -n)


def _longest_front(rows: DataFrame, name: str, packages: DataFrame, whole: bool) -> DataFrame:
    """rows with `_front`: the longest dotted prefix of a name that is a package (package), the name itself only if `whole`; null where none is.

    Distinct names meet packages by equality, so a frequent name is looked up once.
    """
    p = packages.select(F.col("package").alias("_front")).dropna().distinct()
    n = rows.select(name).dropna().distinct()
    cand = n.select(name, F.explode(_fronts(F.col(name))).alias("_front"))
    if not whole:
        cand = cand.filter(F.col("_front") != F.col(name))
    best = cand.join(p, "_front").groupBy(name).agg(F.max_by("_front", F.length("_front")).alias("_front"))
    return rows.join(best, name, "left")


def package_fixes(names: DataFrame, packages: DataFrame) -> DataFrame:
    """(use, name, to_name) of qualified names (use, name) in code: what is left of each once the longest package it starts with is taken off.

    Names without such a package are left out, and so are a package's own name and nulls. Names of package
    and import lines aren't to be given.
    """
    x = _longest_front(names.select("use", "name"), "name", packages, False).filter("_front IS NOT NULL")
    return x.select("use", "name", F.expr("substring(name, length(_front) + 2)").alias("to_name"))


def inner_classes(classes: DataFrame, name_map: DataFrame) -> DataFrame:
    """(name, to_name, lifted, make_static) of inner classes (name, outer, is_interface, is_static) to move out of their outer class.

    Those are classes with an outer one that aren't interfaces and that the name map (from_name, to_name) leads to a
    name with other last two parts. `lifted` is Outer_Inner in the outer class's package.
    """
    m = name_map.select(F.col("from_name").alias("name"), "to_name")
    x = classes.filter("outer IS NOT NULL AND NOT is_interface").join(m, "name").filter(_last(F.col("name"), 2) != _last(F.col("to_name"), 2))
    return x.select("name", "to_name", F.concat("outer", F.lit("_"), _last(F.col("name"), 1)).alias("lifted"), (~F.col("is_static")).alias("make_static"))


def outer_uses(references: DataFrame, inner: DataFrame, members: DataFrame) -> DataFrame:
    """(name, symbol): members (symbol, owner) of the outer class that an inner class to be made static reads.

    references: (in_class, symbol). Such a class needs a reference to an object of its outer class.
    """
    r = references.select(F.col("in_class").alias("name"), "symbol").distinct()
    i = inner.filter("make_static").select("name", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("owner"))
    return r.join(i, "name").join(members.select("symbol", "owner"), ["symbol", "owner"]).select("name", "symbol")


def lifted_names(name_map: DataFrame, inner: DataFrame) -> DataFrame:
    """(from_name, to_name): what the name map gains as inner classes (name, lifted) move: their own and their members' new names.

    A map entry meets the classes by the dotted prefixes of its name before a parameter list.
    """
    e = name_map.select("from_name", "to_name", F.explode(_fronts(F.substring_index("from_name", "(", 1))).alias("name"))
    return e.join(inner.select("name", "lifted"), "name").select(F.expr("lifted || substring(from_name, length(name) + 1)").alias("from_name"), "to_name").distinct()


def field_types(fields: DataFrame, name_map: DataFrame, wanted: DataFrame) -> DataFrame:
    """(field, type, to_type) of fields (field, type) that the name map leads to a wanted field (field, type) of another type."""
    w = wanted.select(F.col("field").alias("to_name"), F.col("type").alias("to_type"))
    return fields.join(name_map.select(F.col("from_name").alias("field"), "to_name"), "field").join(w, "to_name").filter("type <> to_type").select("field", "type", "to_type")


def field_casts(uses: DataFrame, changed: DataFrame) -> DataFrame:
    """(use, field, to_type): uses (use, field) of a field whose type changes, with the type to cast to."""
    return uses.join(changed.select("field", "to_type"), "field").select("use", "field", "to_type")


def test_renames(uses: DataFrame, name_map: DataFrame, model: DataFrame) -> DataFrame:
    """(use, to_name) of uses (use, kind, name, resolved) in test code by names of the model before it was rewritten.

    Types and fields that the model (name) has get their new names; calls only where they no longer resolve.
    """
    x = uses.filter("kind IN ('TYPE', 'FIELD') OR (kind = 'CALL' AND NOT resolved)").join(model.select("name").distinct(), "name", "left_semi")
    return x.join(name_map.select(F.col("from_name").alias("name"), "to_name"), "name").select("use", "to_name")


def test_imports(imports: DataFrame, packages: DataFrame, target: str) -> DataFrame:
    """(use, to_name, action) of imports (use, name, own, is_static, on_demand) of test code that moves to a target package.

    An import in a package of the base result (package; the longest) is removed if it is of that very package and
    not static, else that front becomes the target. Others change so where they start with the file's own package.
    """
    x = _longest_front(imports, "name", packages, True)
    of = F.when(F.col("on_demand"), F.col("name")).otherwise(F.regexp_extract("name", r"^(.*)\.[^.]*$", 1))
    own = F.when((F.col("name") == F.col("own")) | F.startswith("name", F.concat("own", F.lit("."))), F.col("own"))
    front = F.coalesce("_front", own)
    gone = ~F.col("is_static") & F.col("_front").isNotNull() & (of == F.col("_front"))
    to = F.concat(F.lit(target), F.expr("substring(name, length(_f) + 1)"))
    x = x.withColumn("_f", front).withColumn("action", F.when(gone, "remove").when(F.col("_f").isNotNull(), "rename").otherwise("keep"))
    return x.select("use", F.when(F.col("action") == "rename", to).when(F.col("action") == "keep", F.col("name")).alias("to_name"), "action")


def test_seeds(methods: DataFrame, owners: DataFrame) -> DataFrame:
    """(node): methods (node, owner, annotations) that are tests, their classes, and what those extend or stand in (sub, super).

    A test has an annotation of JUnit, or one that is called Test.
    """
    t = methods.filter(F.exists("annotations", lambda a: a.contains("junit") | a.rlike(r"(^|\.)Test$")))
    up = graph.closure(owners.select(F.col("sub").alias("src"), F.col("super").alias("dst")), t.select(F.col("owner").alias("node")).dropna())
    return t.select("node").unionByName(up).distinct()


def untested(items: DataFrame, references: DataFrame, methods: DataFrame, owners: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Items (node, owner) that no test and no element of the target model (node) needs; they are removed."""
    seeds = test_seeds(methods, owners)
    return graph.unused(items, references, seeds if model is None else seeds.unionByName(model.select("node")))


def undefined(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """(node): syntax nodes to remove as they, or what they use, are undefined.

    nodes (node, parent, defines, deletable, returns, in_decl, is_error): an error spreads to the parent until a node that
    can be deleted; from there only if it holds a return and isn't a member of a type or method (in_decl). A spoilt
    node's symbol (defines) spoils the nodes that refer to it: references (node, symbol).
    """
    up = nodes.filter("parent IS NOT NULL AND (NOT deletable OR (returns AND NOT in_decl))").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    used = nodes.select(F.col("node").alias("src"), F.col("defines").alias("symbol")).join(references.select("symbol", F.col("node").alias("dst")), "symbol").select("src", "dst")
    bad = graph.closure(up.unionByName(used), nodes.filter("is_error").select("node"))
    return bad.join(nodes.filter("deletable").select("node").distinct(), "node", "left_semi")


def model_elements(classes: DataFrame, attrs: DataFrame, ops: DataFrame, params: DataFrame, deps: DataFrame) -> DataFrame:
    """(model_id, level, kind, element, owner): every element of a model, classes before members before parameters."""
    row = lambda t, level, kind, element, owner: t.select("model_id", F.lit(level).alias("level"), F.lit(kind).alias("kind"), element.alias("element"), owner.alias("owner"))
    c = F.col
    parts = [row(classes, 0, "CLASS", c("class_id"), F.lit(None).cast("string")), row(attrs, 1, "ATTRIBUTE", c("attr_id"), c("class_id")), row(ops, 1, "OPERATION", c("op_id"), c("class_id"))]
    parts += [row(params, 2, "PARAMETER", c("param_id"), c("op_id")), row(deps, 1, "DEPENDENCY", c("dst"), c("src"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sub_classes(classes: DataFrame) -> DataFrame:
    """(model_id, class_id, sub_id): the classes that extend or implement each class of a model."""
    return graph.inherited(classes).select("model_id", F.col("super_id").alias("class_id"), F.col("class_id").alias("sub_id"))
