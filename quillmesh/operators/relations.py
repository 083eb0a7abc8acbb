"""Small relational operators: groups, limits, unions, differences, texts of elements, planning joins by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators import graph


def coverage_groups(coverage: DataFrame, lib: str, item: str, out: str = "imports") -> DataFrame:
    """(lib, out): the set of items that each library covers."""
    return coverage.groupBy(lib).agg(F.collect_set(item).alias(out))


def sorted_sets(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): each key's distinct values in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(out))


def first_per_group(df: DataFrame, group: str | list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def unique_libraries(libs: DataFrame, order: str) -> DataFrame:
    """Libraries (grp, name, version, ..) once per group and name, whatever the version: the first by order stays."""
    return first_per_group(libs, ["grp", "name"], [order], 1)


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either, once."""
    return a.unionByName(b).distinct()


def left_over(needed: DataFrame, covered: DataFrame, on: str | list[str]) -> DataFrame:
    """What is needed and not covered."""
    return needed.join(covered, on, "left_anti")


def set_differences(needed: Column, covered: Column) -> tuple[Column, Column]:
    """Common and missing members of two arrays."""
    return F.array_intersect(needed, covered), F.array_except(needed, covered)


def result_limit(packages: Column | int, limit: Column | int, each: int = 50) -> Column:
    """How many results a request may give: `each` a package, `limit` at most."""
    return F.least(F.lit(each) * packages, F.lit(limit) if isinstance(limit, int) else limit)


def limited_results(results: DataFrame, requests: DataFrame, request: str, order: list, each: int = 50) -> DataFrame:
    """Results of each request (request, packages array, limit), the first as many as it may give."""
    r = requests.select(request, result_limit(F.size("packages"), F.col("limit"), each).alias("_most"))
    n = F.row_number().over(Window.partitionBy(request).orderBy(*order))
    return results.join(r, request).withColumn("_r", n).filter("_r <= _most").drop("_r", "_most")


def keyword_requests(packages: DataFrame, pkg: str, words: tuple[str, ...] = ("package ", "import ")) -> DataFrame:
    """(pkg, k): a keyword set of each kind for each package, once."""
    return packages.select(pkg, F.explode(F.array(*[F.lit(w) for w in words])).alias("k")).distinct()


def merged_types(types: DataFrame, key: str, count: str, name: str) -> DataFrame:
    """(key, use_count, names): uses summed and names united."""
    return types.groupBy(key).agg(F.sum(count).alias("use_count"), F.array_sort(F.collect_set(name)).alias("names"))


def joined_texts(parts: DataFrame, key: str, order: str, text: str, out: str = "comments") -> DataFrame:
    """(key, out): an element's texts in order, a line each."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias(out))


def json_field(text: Column, field: str, kind: str = "string", default=None) -> Column:
    """A field of a JSON object, as `kind`; the default where it is missing or no such value."""
    return F.coalesce(F.from_json(text, f"{field} {kind}")[field], F.lit(default).cast(kind))


def missing_names(elements: DataFrame, name_map: DataFrame, name: str) -> DataFrame:
    """Elements that no entry of the inverted name map (its values as `name`) leads to."""
    return elements.join(name_map.select(name).distinct(), name, "left_anti")


def package_components(classes: DataFrame, subtypes: DataFrame, uses: DataFrame) -> DataFrame:
    """(package, node): classes (package, node, kind) of user types that are no subtype of another, and the types they lead to; all where none are left.

    subtypes (sub, super) and uses (src, dst) are between nodes.
    """
    own = classes.filter(F.col("kind").isin("USERTYPE", "THISTYPE")).select("node").distinct()
    top = graph.subtypes_removed(own, subtypes)
    kept = classes.select("package", "node").join(graph.closure(uses, top), "node", "left_semi")
    rest = classes.select("package", "node").join(kept.select("package").distinct(), "package", "left_anti")
    return kept.unionByName(rest).select("package", "node")


def parameter_plan(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(op, pos, to_pos, to_name, to_type, action) of parameters (op, pos, name, type): what each becomes.

    Wanted parameters (op, pos, name, type) pair off with the own ones of equal type in order, then with
    what is left in order. Actions: keep, rename, move, retype, drop; a wanted one without its like is add.
    """
    keys = ["op", "type", "k"]
    kth = lambda df, by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    a, b = kth(own.select("op", "pos", "name", "type"), ["op", "type"]), kth(wanted.select("op", F.col("pos").alias("to_pos"), F.col("name").alias("to_name"), "type", "pos"), ["op", "type"]).drop("pos")
    same = a.join(b, keys).select("op", "pos", "to_pos", "name", "to_name", "type", F.col("type").alias("to_type"))
    ra = kth(a.drop("k").join(same.select("op", "pos"), ["op", "pos"], "left_anti"), ["op"])
    rb = b.drop("k").join(same.select("op", "to_pos"), ["op", "to_pos"], "left_anti").withColumnRenamed("type", "to_type")
    rb = rb.withColumn("k", F.row_number().over(Window.partitionBy("op").orderBy("to_pos")))
    rest = ra.join(rb, ["op", "k"], "full").select("op", "pos", "to_pos", "name", "to_name", "type", "to_type")
    action = F.when(F.col("pos").isNull(), "add").when(F.col("to_pos").isNull(), "drop").when(F.col("type") != F.col("to_type"), "retype").when(F.col("pos") != F.col("to_pos"), "move").when(F.col("name") != F.col("to_name"), "rename").otherwise("keep")
    return same.unionByName(rest).select("op", "pos", "to_pos", "to_name", "to_type", action.alias("action"))


def call_plan(calls: DataFrame, plan: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(call, pos, to_pos, cast) of call arguments (call, op, pos) by a parameter plan: where each goes, and the type it is cast to, if any.

    results (op, to_type): calls whose value gets another type are given as pos -1.
    """
    moved = plan.filter("pos IS NOT NULL AND to_pos IS NOT NULL").select("op", "pos", "to_pos", F.when(F.col("action") == "retype", F.col("to_type")).alias("cast"))
    out = calls.join(moved, ["op", "pos"]).select("call", "pos", "to_pos", "cast")
    if results is not None:
        whole = calls.select("call", "op").distinct().join(results, "op")
        out = out.unionByName(whole.select("call", F.lit(-1).alias("pos"), F.lit(-1).alias("to_pos"), F.col("to_type").alias("cast")))
    return out
