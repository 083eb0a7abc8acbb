"""Mixing sources to target weights by weighted fair queueing (operator 3), DataFrame functions only.

Every source's documents stand in a shuffled queue (md5 of seed and id), once a pass. An entry's virtual
finish time is its source's cumulative words through it, divided by the source's target, so all sources
reach time 1 at the total budget. As in fair queueing of packets, an entry that would straddle time 1 is
sent in two fragments, the first of which finishes at 1; so no source falls behind by a long document.
The mix is the fragments in order of finish time, cut once where their words reach the total budget;
what the floors of the targets leave over goes to the first fragments after time 1.

The cut is found without sorting everything: words are summed by ranges of finish time, and only the
range that the budget ends in is sorted, for the one fragment that is taken in part. Queues are cut into
slices of the md5 range, more of them for more rows, so a source that holds most rows is spread over all
tasks. The table of sources (a row each) is handled in one task.

Null texts have size 0; a null source is a source of its own, the last. Texts are counted whole. Equal
finish times go by source, then queue. Repeated rows are separate entries; equal turns go by size, then
id. Columns of any name are kept. An empty table, or one without words, gives targets and takes of 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.util import WORD, cut, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
SEED = "mix-1"
RANGES = 1 << 14  # ranges of finish time, a unit of virtual time


def targets(sizes: DataFrame, share: float = SHARE, passes: int = PASSES, weights=WEIGHTS) -> DataFrame:
    """(src, source_size) to (src, source_size, target): shares by weight, at most `passes` sizes each.

    Sources are few; their table is handled in one task. Filling works in order of cap per weight: a
    source is capped while the share left per weight reaches its cap.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(passes)).withColumn("total", F.sum("source_size").over(everything) * share)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - before) / left).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    t = t.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("src").isNull(), "src", "level"))).over(everything)["level"])
    return t.select("src", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def queue(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, passes: int = PASSES, share: float = SHARE, weights=WEIGHTS, keep: tuple = ()) -> DataFrame:
    """One row per document: doc_id, src, size, turn, source_size, target, before (words ahead of it in its queue); _keep_<i> of `keep`."""
    digits = 2
    while docs.count() > 4096 * 16**digits and digits < 6:
        digits += 1
    d = docs.select(
        F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{source}`").alias("src"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("")))).alias("turn"), *[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)],
    ).withColumn("slice", F.substring("turn", 1, digits))
    slices = d.groupBy("src", "slice").agg(F.sum("size").alias("words"))
    sizes = targets(slices.groupBy("src").agg(F.sum("words").alias("source_size")), share, passes, weights)
    # src may be null: null-safe keys, as strings that cannot clash
    key = lambda: F.when(F.col("src").isNull(), "n").otherwise(F.concat(F.lit("s"), "src")).alias("src_key")
    ahead = slices.select(key(), "slice", (F.sum("words").over(Window.partitionBy("src").orderBy("slice")) - F.col("words")).alias("ahead"))
    ahead = ahead.join(sizes.select(key(), "source_size", "target"), "src_key")
    w = Window.partitionBy("src_key", "slice").orderBy("turn", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", key()).withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return d.join(ahead, ["src_key", "slice"]).withColumn("before", (F.col("inside") + F.col("ahead")).cast("long"))


def fragments(passes: int):
    """A row's fragments with words: pass, words, the queue's words through it, finish time (1 for the part before its source's target)."""
    out = []
    for k in range(passes):
        start = (F.col("before") + F.col("source_size") * k).cast("long")
        early = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
        for words, through in ((early, start + early), (F.col("size") - early, start + F.col("size"))):
            finish = (through / F.col("target")).cast("double")
            straddles = (early > 0) & (early < F.col("size"))
            at = F.when(straddles, F.lit(1.0)).otherwise(finish) if words is early else finish
            out.append(F.struct(F.lit(k).alias("pass"), words.cast("long").alias("words"), through.alias("through"), F.when(F.col("target") > 0, at).otherwise(0.0).alias("finish")))
    return F.filter(F.array(*out), lambda f: f["words"] > 0)


def budget_cut(q: DataFrame, passes: int = PASSES, ranges: int = RANGES) -> Callable[[Column], Column]:
    """What is taken of a fragment `f` of the queue's row: all before the cut, a part of the fragment at it, nothing after."""
    budget = q.groupBy("src_key").agg(F.max("target").alias("target")).agg(F.floor(F.coalesce(F.sum("target"), F.lit(0.0)) + 1e-6)).first()[0]
    f = q.select("src_key", F.explode(fragments(passes)).alias("f")).select("src_key", "f.*").withColumn("range", F.floor(F.col("finish") * ranges))
    done = 0
    at = None
    for r in sorted(f.groupBy("range").agg(F.sum("words").alias("words")).collect()):  # a row a range
        if done + r.words > budget:
            at = r.range
            break
        done += r.words
    if at is None:  # the budget takes all there is
        return lambda f: f["words"]
    order = Window.orderBy("finish", "src_key", "through")
    last = f.filter(F.col("range") == at).withColumn("done", F.sum("words").over(order) + done).filter(F.col("done") > budget).orderBy("finish", "src_key", "through").first()
    here = lambda f: F.struct(f["finish"], F.col("src_key"), f["through"])
    end = F.struct(F.lit(last.finish).alias("finish"), F.lit(last.src_key).alias("src_key"), F.lit(last.through).cast("long").alias("through"))
    return lambda f: F.when(here(f) < end, f["words"]).when(here(f) == end, F.lit(last.words - (last.done - budget)).cast("long")).otherwise(F.lit(0).cast("long"))


def taken(docs: DataFrame, passes: int = PASSES, **args) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, and `finish`, the virtual time of its last fragment in the mix."""
    q = cut(queue(docs, passes=passes, **args).select("doc_id", "src_key", "size", "source_size", "target", "before"))
    words = budget_cut(q, passes)
    got = F.filter(F.transform(fragments(passes), lambda f: F.struct(words(f).alias("words"), f["finish"].alias("finish"))), lambda f: f["words"] > 0)
    q = q.withColumn("got", got)
    return q.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        F.aggregate("got", F.lit(0).cast("long"), lambda a, f: a + f["words"]).alias("taken"), F.array_max(F.transform("got", lambda f: f["finish"])).alias("finish"),
    )


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, passes: int = PASSES) -> DataFrame:
    """The mix itself: an entry a row (columns of docs, mix_pass, mix_words, mix_finish), range-sorted by finish time; an entry's fragments are one row."""
    q = queue(docs, ident, text, source, seed, passes)
    words = budget_cut(cut(q.select("src_key", "size", "source_size", "target", "before")), passes)
    q = queue(docs, ident, text, source, seed, passes, keep=tuple(docs.columns))
    # the two fragments of a straddling entry are neighbours in its row: one entry of the mix
    whole = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda k: F.aggregate(F.filter("fs", lambda f: f["pass"] == k), F.struct(k.alias("pass"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("finish")), lambda a, f: F.struct(a["pass"].alias("pass"), (a["words"] + f["words"]).alias("words"), F.greatest(a["finish"], f["finish"]).alias("finish"))))
    fs = F.filter(F.transform(fragments(passes), lambda f: F.struct(f["pass"].alias("pass"), words(f).alias("words"), f["finish"].alias("finish"))), lambda f: f["words"] > 0)
    got = q.withColumn("fs", fs).withColumn("e", F.explode(whole)).filter("e.words > 0")
    out = got.select(*[F.col(f"_keep_{i}").alias(f"_keep_{i}") for i in range(len(docs.columns))], F.col("e.pass").alias("_pass"), F.col("e.words").alias("_words"), F.col("e.finish").alias("_finish"), "src_key", "doc_id")
    out = out.orderBy("_finish", "src_key", "doc_id", "_pass")
    names = ("mix_pass", "mix_words", "mix_finish")
    kept = [(i, c) for i, c in enumerate(docs.columns) if c not in names]
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in kept], *[F.col("_" + n[4:]).alias(n) for n in names])


def op3(spark, sf_dir):
    return taken(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, source AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3] AS w, source_size * 2.0 AS cap, (SELECT sum(source_size) FROM s) * 1.5 AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT *, level * w >= cap AS filled FROM f),
t AS (SELECT src, source_size, CASE WHEN filled THEN cap ELSE w * (SELECT level FROM g WHERE NOT filled ORDER BY cap / w, src NULLS LAST LIMIT 1) END AS target FROM g),
q AS (SELECT d.*, row_number() OVER () AS r, CAST(coalesce(sum(size) OVER (PARTITION BY src ORDER BY turn, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
e AS (SELECT r, doc_id, q.src, size, source_size, CAST(target AS DOUBLE) AS target, before + source_size * p AS start FROM q JOIN t ON q.src IS NOT DISTINCT FROM t.src CROSS JOIN (VALUES (0), (1)) AS v(p)),
early AS (SELECT *, CAST(greatest(0, least(size, floor(target) - start)) AS BIGINT) AS first FROM e),
parts AS (SELECT r, src, first AS words, start + first AS through, CASE WHEN first < size THEN 1.0::DOUBLE ELSE (start + size) / target END AS finish FROM early WHERE first > 0
          UNION ALL SELECT r, src, size - first, start + size, (start + size) / target FROM early WHERE first < size),
sums AS (SELECT *, sum(words) OVER (ORDER BY finish, src IS NOT NULL, src, through ROWS UNBOUNDED PRECEDING) AS done FROM parts),
mixed AS (SELECT r, sum(greatest(0, least(words, (SELECT floor(sum(target) + 1e-6) FROM t) - (done - words)))) AS taken, max(finish) FILTER (done - words < (SELECT floor(sum(target) + 1e-6) FROM t)) AS finish FROM sums GROUP BY r)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, finish
FROM q JOIN t ON q.src IS NOT DISTINCT FROM t.src LEFT JOIN mixed USING (r)
"""
