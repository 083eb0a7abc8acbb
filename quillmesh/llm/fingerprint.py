"""Document fingerprints: threshold-scaled sketches (operator 10), DataFrame functions only.

A text's shingles are its runs of five words (the whole sequence where it has fewer). A sketch keeps
every shingle hash that falls below a fixed fraction of the hash range (`1 / 2**FRACTION_BITS`), at every
size; where none does, it keeps the smallest one. So sketches can be merged (the sketch of a union comes
from the sketches alone), and likeness and containment be estimated however unequal the texts are.

Nulls and empty texts have an empty sketch; two empty sketches are alike (1.0), an empty and a filled
one are not (0.0). Texts are read whole. Equal texts have equal fingerprints. Repeated rows and ids stay
as they are; rows of equal id follow each other by the hash of their text. A null id sorts before
all others. An empty table gives no rows. Columns of df are kept, but for one named like the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.util import WORD, ascii_lower, table

K = 5
FRACTION_BITS = 1
#: Signed hashes below this are the lowest 1 / 2**FRACTION_BITS of the 64-bit range.
LIMIT = -(2**63) + 2 ** (64 - FRACTION_BITS)


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_hashes(h: Column) -> Column:
    """Distinct hashes of the K-word shingles of an array of word hashes."""
    base = F.slice(h, 1, F.greatest(F.size(h) - (K - 1), F.least(F.size(h), F.lit(1))))
    return F.array_distinct(F.transform(base, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)])))


def below(hashes: Column) -> Column:
    return F.filter(hashes, lambda v: v < LIMIT)


def sketch(hashes: Column, low: Column) -> Column:
    """The sketch of hashes, of which `low` are below the limit."""
    return F.sort_array(F.when((F.size(low) > 0) | (F.size(hashes) == 0), low).otherwise(F.array(F.array_min(hashes))))


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of two texts' shingles, from their sketches."""
    return sketch(F.array_union(a, b), below(F.array_union(a, b)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two texts by their sketches."""
    both = F.size(F.array_intersect(a, b))
    alone = lambda s: F.coalesce(F.get(s, F.lit(0)) >= LIMIT, F.lit(False))  # noqa: E731  nothing below the limit
    either = F.when(alone(a) & alone(b), 1).otherwise(F.size(a) + F.size(b) - both - alone(a).cast("int") - alone(b).cast("int"))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when(either > 0, both / either).otherwise(0.0).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null where a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def as_string(sk: Column, n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(":"), F.array_join(F.transform(sk, lambda v: F.hex(v)), ","))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with `out`: struct of n (distinct shingles) and hashes (the sketch)."""
    h = df.withColumn("_qh", word_hashes(F.coalesce(F.col(text), F.lit(""))))
    s = h.withColumn("_qs", shingle_hashes(F.col("_qh"))).withColumn("_ql", below(F.col("_qs")))
    return s.withColumn(out, F.struct(F.size("_qs").cast("long").alias("n"), sketch(F.col("_qs"), F.col("_ql")).alias("hashes"))).drop("_qh", "_qs", "_ql")


def with_next(df: DataFrame, key: str, payload: str, out: str, tie: str, rows_per_bucket: int = 2000, percentiles: int = 512, most: int = 1 << 16) -> DataFrame:
    """df with `out`: the payload of the next row in ascending order of `key`, then hash of `tie`; after the last comes the first.

    The order is cut into buckets by percentiles of the key; between two percentiles by equal widths, and
    a key of many rows by ranges of the hash. Each bucket's first row is also dealt to the bucket before,
    so one shuffle is enough. There are at most `most` buckets, and a small row of each goes to all tasks
    (1.5 MB). Only rows equal in key and tie, whose next is their like, can't be parted.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    n, least, most_k, bounds = df.select(k.alias("k")).agg(F.count("*"), F.min("k"), F.max("k"), F.percentile_approx("k", [i / percentiles for i in range(1, percentiles)], 10000)).first()
    step = max(1, -(-percentiles * rows_per_bucket // max(n, 1)))
    # a key that fills several percentiles is a bucket of its own, and gets as many times the sub-buckets
    share: dict[int, int] = {}
    for b in (bounds or [])[step - 1 :: step]:
        share[b] = share.get(b, 0) + 1
    cuts = sorted({x for b, c in share.items() for x in ((b, b + 1) if c > 1 and b < 2**63 - 1 else (b,))})
    split = min(max(1, n // (percentiles * 10 * rows_per_bucket)), most // (4 * percentiles))
    lows = [least or 0, *cuts]
    parts_of = [min(most // (2 * percentiles), split * share.get(b, 1)) if share.get(b, 1) > 1 else split for b in lows]
    first_of = [sum(parts_of[:i]) for i in range(len(lows))]
    longs = lambda v: F.array(*[F.lit(int(x)).cast("long") for x in v])
    at = F.size(F.filter(longs(cuts), lambda b: b <= F.col("_qk"))) if cuts else F.lit(0)
    d = df.withColumn("_qk", k).withColumn("_qh", F.xxhash64(tie)).withColumn("_qi", at)
    lo, hi = F.get(longs(lows), F.col("_qi")), F.get(longs([*cuts, most_k or 0]), F.col("_qi"))
    hot = F.get(F.array(*[F.lit(share.get(b, 1) > 1) for b in lows]), F.col("_qi"))
    wide = lambda v, a, b: (v.cast("double") - a.cast("double")) / F.greatest(b.cast("double") - a.cast("double"), F.lit(1.0))
    place = F.when(hot, wide(F.col("_qh"), F.lit(-(2**63)), F.lit(2**63 - 1))).otherwise(wide(F.col("_qk"), lo, hi))
    m = F.get(longs(parts_of), F.col("_qi"))
    d = d.withColumn("_qb", F.get(longs(first_of), F.col("_qi")) + F.greatest(F.lit(0), F.least(F.floor(place * m), m - 1)))
    order = F.struct(F.col("_qk").alias("k"), F.col("_qh").alias("h"), F.col(tie).alias("t"))
    firsts = d.groupBy("_qb").agg(F.min(F.struct(F.col("_qk").alias("k"), F.col("_qh").alias("h"))).alias("f"))
    everything = Window.orderBy("_qb")
    firsts = firsts.select(F.col("f.k").alias("_qk"), F.col("f.h").alias("_qh"), F.coalesce(F.lag("_qb").over(everything), F.max("_qb").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_qp"), F.lag("_qb").over(everything).isNull().alias("_qwrap"))
    d = d.join(F.broadcast(firsts), ["_qk", "_qh"], "left")
    here = F.struct(F.lit(0).alias("late"), F.col("_qb").alias("b"))
    ahead = F.struct(F.when(F.col("_qwrap"), 2).otherwise(1).alias("late"), F.col("_qp").alias("b"))
    d = d.withColumn("_qd", F.explode(F.when(F.col("_qp").isNull(), F.array(here)).otherwise(F.array(here, ahead))))
    w = Window.partitionBy("_qd.b").orderBy(F.col("_qd.late"), *[order[c] for c in "kht"])
    d = d.withColumn(out, F.lead(F.col(payload)).over(w)).filter(F.col("_qd.late") == 0)
    return d.drop("_qk", "_qh", "_qi", "_qb", "_qp", "_qwrap", "_qd")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document's (or all of them).
    """
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = fingerprint(d, "text", "fp").withColumn("payload", F.struct("text", "fp")).select("doc_id", "payload", F.xxhash64("text").alias("tie"))
    d = with_next(d, "doc_id", "payload", "next", "tie").select("doc_id", "payload.*", "next")
    half = F.floor(F.length("text") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half)))
    d = fingerprint(d, "edited", "efp")
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_string(F.col("fp.hashes"), F.col("fp.n")).alias("fingerprint"),
        as_string(F.col("efp.hashes"), F.col("efp.n")).alias("edited_fingerprint"),
        likeness(F.col("fp.hashes"), F.col("efp.hashes")).alias("near_edited"),
        likeness(F.col("fp.hashes"), F.col("next.fp.hashes")).alias("near_next"),
    )


def op10(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
