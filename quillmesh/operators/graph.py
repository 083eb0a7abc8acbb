"""Neighbours, closures, components, set cover and prefix relaxation over edge tables."""

from __future__ import annotations

import atexit
import functools
import heapq
import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T

_folders: dict[str, SparkSession] = {}


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The rows as a Parquet table in the folder that executors share (spark.checkpoint.dir), so that lineage stays short.

    Tables stay until the driver's Python ends: results are lazy and may still read them. tidy: the shuffle
    files of the write go when it has ended, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "quillmesh-ck"))
    path = f"{spark.sparkContext.getCheckpointDir()}/quillmesh-core-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    _folders[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _delete() -> None:
    for path, spark in _folders.items():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended before
            return


def out_neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, once each."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def closure(edges: DataFrame, seeds: DataFrame, limit: int = 1000) -> DataFrame:
    """(node): seeds and all that edges (src, dst) lead to from them; each round joins the newest nodes only."""
    e = edges.select("src", "dst").distinct()
    seen = written(seeds.select("node").distinct())
    new = seen
    for _ in range(limit):
        new = written(new.join(e, new.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen = written(seen.union(new))
    raise RuntimeError("closure did not end")


def references_closure(references: DataFrame, kept: DataFrame) -> DataFrame:
    """Symbols that lead to a kept symbol, and the kept ones; a start that is kept brings run."""
    back = references.select(F.col("to_symbol").alias("src"), F.col("from_symbol").alias("dst"))
    runs = kept.filter(F.col("node").rlike(r"(^|\.)start$")).select(F.regexp_replace("node", r"start$", "run").alias("node"))
    return closure(back, kept.union(runs))


def unused(items: DataFrame, references: DataFrame, seeds: DataFrame) -> DataFrame:
    """Items (node, owner) that no seed reaches; a used member keeps its owner."""
    e = references.select(F.col("from_symbol").alias("src"), F.col("to_symbol").alias("dst")).union(items.filter("owner IS NOT NULL").select(F.col("node").alias("src"), F.col("owner").alias("dst")))
    return items.join(closure(e, seeds), "node", "left_anti")


def reaches(references: DataFrame, bad: DataFrame) -> DataFrame:
    """Nodes that lead to a bad one."""
    return closure(references.select(F.col("to_symbol").alias("src"), F.col("from_symbol").alias("dst")), bad)


def connected(pairs: DataFrame, limit: int = 100) -> DataFrame:
    """(node, label): smallest node of each component of pairs (a, b); labels jump to their labels' labels."""
    e = written(pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct())
    lab = written(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(limit):
        near = e.join(lab.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = lab.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("low"), "label")
        jump = lab.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = written(step.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), F.col("label").alias("was")))
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        lab = new.select("node", "label")
    raise RuntimeError("components did not converge")


def subtypes_removed(kept: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Kept classes (node) that are no subtype (sub, super) of another kept class."""
    inner = subtypes.join(kept.withColumnRenamed("node", "super"), "super", "left_semi").filter("sub <> super").select(F.col("sub").alias("node"))
    return kept.join(inner, "node", "left_anti")


def inherited(classes: DataFrame) -> DataFrame:
    """(model_id, class_id, super_id): super types (array supers, by name or full name) that the model has."""
    s = classes.select("model_id", "class_id", F.explode("supers").alias("n"))
    named = classes.select("model_id", F.col("class_id").alias("super_id"), F.explode(F.array_distinct(F.array("name", "full_name"))).alias("n"))
    return s.join(named, ["model_id", "n"]).select("model_id", "class_id", "super_id").distinct()


def type_dependencies(uses: DataFrame, classes: DataFrame) -> DataFrame:
    """(model_id, src, dst): classes whose names occur in used types (type strings, generics inside), self left out."""
    u = uses.select("model_id", F.col("class_id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("type", F.lit(r"[\w.$]+"), F.lit(0)))).alias("name"))
    named = classes.select("model_id", F.col("class_id").alias("dst"), F.explode(F.array_distinct(F.array("name", "full_name"))).alias("name"))
    return u.join(named, ["model_id", "name"]).filter("src <> dst").select("model_id", "src", "dst").distinct()


def association_ratio(mapped: DataFrame, pattern: DataFrame, base: DataFrame, cutoff: float = 0.33) -> DataFrame:
    """(pair, ratio): of pattern edges with both ends mapped (pair, src, dst -> base classes), the share that base edges have in either direction.

    1 where no edge has both ends mapped; 0 below the cutoff. mapped: (pair, cls, to_cls).
    """
    e = pattern.join(mapped.select("pair", F.col("cls").alias("src"), F.col("to_cls").alias("a")), ["pair", "src"])
    e = e.join(mapped.select("pair", F.col("cls").alias("dst"), F.col("to_cls").alias("b")), ["pair", "dst"])
    both = base.select("pair", F.col("src").alias("a"), F.col("dst").alias("b")).union(base.select("pair", "dst", "src")).distinct().withColumn("hit", F.lit(1))
    r = e.join(both, ["pair", "a", "b"], "left").groupBy("pair").agg((F.count("hit") / F.count("*")).alias("r"))
    r = mapped.select("pair").distinct().join(r, "pair", "left")
    return r.select("pair", F.when(F.col("r").isNull(), 1.0).when(F.col("r") < cutoff, 0.0).otherwise(F.col("r")).alias("ratio"))


def relaxed(names: DataFrame, known: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """(name, key): the longest of a name's prefixes (segments) that `known` has."""
    p = names.select(name, F.explode(T.import_prefixes(F.col(name))).alias(key)).join(known.select(key).distinct(), key)
    return p.groupBy(name).agg(F.max_by(key, F.length(key)).alias(key))


#: Rows of a cover that one task takes at a time, and libraries; what is more goes in rounds. The choices are the same.
COVER_ROWS = 4_000_000
COVER_LIBS = 50_000


def _greedy(rows: pd.DataFrame, bound: tuple[int, int] | None = None) -> pd.DataFrame:
    """Greedy choices of rows (lib, item), numbers, libraries in order of preference: counts are brought up to date only for the library that comes first.

    With bound (n, lib), the first library of those that are not here: only choices that go before it.
    """
    lib, libs = pd.factorize(rows["lib"], sort=True)
    item, items = pd.factorize(rows["item"])
    sizes = np.bincount(lib, minlength=len(libs))
    parts = np.split(item[np.argsort(lib, kind="stable")], np.cumsum(sizes)[:-1]) if len(libs) else []
    least = (0, 0) if bound is None else (-bound[0], bound[1])
    heap = [(-int(n), k) for k, n in enumerate(sizes)]
    heapq.heapify(heap)
    open_, out = np.ones(len(items), bool), []
    while heap:
        was, k = heapq.heappop(heap)
        if (was, libs[k]) >= least:
            break
        n = int(open_[parts[k]].sum())
        if n == -was:
            out.append((n, libs[k]))
            open_[parts[k]] = False
        elif n:
            heapq.heappush(heap, (-n, k))
    return pd.DataFrame(out, columns=["n", "lib"])


def _first_choices(left: DataFrame, sizes: DataFrame, rows: int) -> DataFrame:
    """(n, lib): the greedy choices up to the first that may need a library outside of the largest, which fit one task; one at least."""
    if rows <= COVER_ROWS:
        return left.groupBy().applyInPandas(lambda pdf: _greedy(pdf), "n long, lib long")
    top = [tuple(r) for r in sizes.orderBy(F.desc("n"), "lib").limit(COVER_LIBS + 1).collect()]
    take = max(1, min(int((np.cumsum([n for _, n in top]) <= COVER_ROWS).sum()), COVER_LIBS))
    if take == 1:
        return left.sparkSession.createDataFrame([(top[0][1], top[0][0])], "n long, lib long")
    bound = (top[take][1], top[take][0]) if take < len(top) else None
    these = left.sparkSession.createDataFrame([(k,) for k, _ in top[:take]], "lib long")
    return left.join(F.broadcast(these), "lib").groupBy().applyInPandas(lambda pdf: _greedy(pdf, bound), "n long, lib long")


def set_cover(coverage: DataFrame, lib: str = "lib_id", name: str = "lib_name", item: str = "import") -> DataFrame:
    """(step, lib, covered): greedily, the library with most items still uncovered, until none is left; ties go to the greatest name, then id.

    A library of several names counts under its greatest. Rows without library or item are ignored. What fits one task (COVER_ROWS)
    is chosen there. Else a round takes two kinds of choices, which are the greedy ones, in order of their counts, as counts only fall:
    every library that goes before all others of its own items, since what they share is all that one choice changes; and
    of the largest libraries, as many as fit a task, the choices that go before the first one left out.
    """
    spark = coverage.sparkSession
    kinds = dict(coverage.dtypes)
    rows = written(coverage.select(F.col(lib).alias("of"), F.col(name).cast("string").alias("name"), F.col(item).alias("what")).dropna(subset=["of", "what"]).distinct())
    # numbers instead of names: libraries in order of preference
    libs = written(rows.groupBy("of").agg(F.max("name").alias("name")).orderBy(F.desc("name"), F.desc("of")).withColumn("lib", F.monotonically_increasing_id()))
    items = written(rows.select("what").distinct().withColumn("item", F.monotonically_increasing_id()))
    left = written(rows.select("of", "what").distinct().join(libs, "of").join(items, "what").select("lib", "item"))
    chosen = []
    while True:
        n = left.count()
        sizes = None if n <= COVER_ROWS else written(left.groupBy("lib").agg(F.count("*").alias("n")))
        picks = written(_first_choices(left, sizes, n))
        if sizes is not None:
            tops = left.join(sizes, "lib").groupBy("item").agg(F.min(F.struct((-F.col("n")).alias("n"), "lib")).alias("top"))
            alone = tops.groupBy("top").agg(F.count("*").alias("won")).filter("won = -top.n").select((-F.col("top.n")).alias("n"), "top.lib")
            picks = written(picks.unionByName(alone).distinct())
        chosen.append(picks)
        if sizes is None:
            break
        left = written(left.join(left.join(picks, "lib", "left_semi").select("item").distinct(), "item", "left_anti"))
    ordered = functools.reduce(DataFrame.unionByName, chosen).join(libs, "lib").orderBy(F.desc("n"), "lib").select("of", "n")
    return spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1])), f"step int, {lib} {kinds[lib]}, covered long")


def prefix_cover(coverage: DataFrame, lib: str = "lib_id", item: str = "import") -> tuple[list, DataFrame]:
    """Libraries preferred by name: for each import the library whose id has the longest prefix in common with it, beyond its second dot (else 10).

    Returns the libraries in order and the coverage that is left. Imports go in order, and those a library covers are done; a
    round takes every library whose first import no library of an earlier one covers.
    """
    rows = written(coverage.select(lib, item).dropna().distinct())
    ident = F.when(F.col(lib).startswith("com.google.android") & F.col(item).startswith("android"), F.substring(F.col(lib), F.lit(12), F.length(lib))).otherwise(F.col(lib))
    second = F.length(F.substring_index(item, ".", 2))
    least = F.when(F.size(F.split(item, r"\.")) > 2, second).otherwise(F.lit(10))
    fit = rows.withColumn("_front", T.common_prefix(ident, F.col(item))).filter(F.col("_front") > least)
    # the library each import would choose; a choice ends those of later imports only, so earlier ones stay open
    open_ = written(fit.groupBy(item).agg(F.min(F.struct((-F.col("_front")).alias("f"), F.col(lib).alias("lib")))["lib"].alias(lib)))
    chosen = open_.limit(0).select(lib, F.col(item).alias("_first"))
    while True:
        first = written(open_.groupBy(lib).agg(F.min(item).alias("_first")))
        if first.isEmpty():
            break
        covered = rows.join(first, lib).groupBy(item).agg(F.min("_first").alias("_first")).filter(F.col(item) == F.col("_first"))
        picks = written(first.join(covered.select("_first"), "_first", "left_semi").select(lib, "_first"))
        chosen = chosen.unionByName(picks)
        done = rows.join(picks, lib).filter(F.col(item) >= F.col("_first")).select(item)
        open_ = written(open_.join(done, item, "left_anti"))
    left = rows.join(rows.join(chosen, lib, "left_semi").select(item), item, "left_anti")
    return [r[lib] for r in chosen.orderBy("_first").collect()], left
