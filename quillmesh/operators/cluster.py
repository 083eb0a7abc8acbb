"""Merging, clustering, pruning and ordering of components and clusters."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.graph import connected
from quillmesh.operators.matching import assign_matrix, by_value, likeness

CUTS = {"CLASS": 0.2, "METHOD": 0.5, "PACKAGE": 0.0}


def merge_names(rows: DataFrame, key: str = "comp_id") -> DataFrame:
    """(key, name, ct, mods) to (key, name, ct): counts of equal names add up."""
    return rows.groupBy(key, "name").agg(F.sum("ct").alias("ct"))


def merge_modifiers(rows: DataFrame, key: str = "comp_id") -> DataFrame:
    return rows.groupBy(key).agg(F.bit_or("mods").alias("mods"))


def main_name(names: DataFrame, key: str = "comp_id") -> DataFrame:
    """The most frequent name of each; of equally frequent ones the first by name."""
    best = F.min(F.struct((-F.col("ct")).alias("n"), F.col("name")))
    return names.groupBy(key).agg(best["name"].alias("name"))


def cluster_score(members: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """CLASS, FIELD and METHOD clusters add their members' term matches; PACKAGE clusters take the largest density, 0 at least."""
    total, top = F.sum("term_match"), F.greatest(F.lit(0.0), F.coalesce(F.max("term_density"), F.lit(0.0)))
    return members.groupBy(*keys, kind).agg(F.when(F.col(kind) == "PACKAGE", top).otherwise(total).alias("score"), F.count("*").alias("use_count"))


def prune(clusters: DataFrame, num_inputs: Column, cut: Column, kind: str = "kind") -> DataFrame:
    """Clusters used at least min(largest use * cut, num_inputs div 4) times, per kind."""
    top = clusters.groupBy(kind).agg(F.max("use_count").alias("_top"))
    return clusters.join(top, kind).filter(F.col("use_count") >= F.least(F.col("_top") * cut, F.floor(num_inputs / 4))).drop("_top")


def in_order(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("score"), F.desc("use_count"), "text")


def equivalence(items: DataFrame, keys: list, ident: str, names: str) -> DataFrame:
    """Clusters of equal keys: number of uses, members, distinct names."""
    return items.groupBy(*keys).agg(F.count("*").alias("use_count"), F.array_sort(F.collect_set(ident)).alias("members"), F.array_sort(F.collect_set(names)).alias("names"))


def match_fractions(used: DataFrame, pair: str, a: float, b: float, m: float) -> DataFrame:
    """(pair, side a or b, used, mapped) to pairs with passes: used shares (1 for an empty side) of at least a (smaller) and b (larger), mapped share of the smaller side at least m."""
    share = lambda s: F.when(F.count(F.when(F.col("side") == s, 1)) == 0, F.lit(1.0)).otherwise(F.count(F.when((F.col("side") == s) & F.col("used"), 1)) / F.count(F.when(F.col("side") == s, 1)))
    n = lambda s: F.count(F.when(F.col("side") == s, 1))
    g = used.groupBy(pair).agg(share("a").alias("fa"), share("b").alias("fb"), n("a").alias("na"), n("b").alias("nb"), F.count(F.when((F.col("side") == "a") & F.col("mapped"), 1)).alias("mapped"))
    small = F.least("na", "nb")
    both = F.when(small == 0, F.lit(1.0)).otherwise(F.col("mapped") / small)
    return g.withColumn("passes", (F.least("fa", "fb") >= a) & (F.greatest("fa", "fb") >= b) & (both >= m))


def enum_overlap(a: Column, b: Column) -> Column:
    """Whether two constant sets fit: both or none there, sizes at most 2 apart, three quarters of the smaller in common."""
    common = F.size(F.array_intersect(a, b))
    fit = (F.abs(F.size(a) - F.size(b)) <= 2) & (common >= F.least(F.size(a), F.size(b)) * 0.75)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(fit)


def enum_score(score: Column, a: Column, b: Column, fraction: float = 0.75) -> Column:
    """A score blended with the share of constants in common; 0 where one side has none."""
    most = F.greatest(F.size(a), F.size(b))
    e = F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(1.0))
    return F.when(a.isNull() & b.isNull(), score).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(e * fraction + score * (1 - fraction))


def equivalent_types(a_cat: Column, b_cat: Column, a_names: Column, b_names: Column) -> Column:
    """Categories are equal, or one is OBJECT; JAVA types share a name too."""
    return (a_cat == "OBJECT") | (b_cat == "OBJECT") | ((a_cat == b_cat) & ((a_cat != "JAVA") | F.arrays_overlap(a_names, b_names)))


def method_signature(ret: Column, static: Column, params: Column) -> Column:
    return F.struct(ret.alias("ret"), static.alias("is_static"), F.array_sort(params).alias("params"))


def accessor_words(method_words: Column, field_words: Column, prefixed: Column) -> Column:
    """A method's name has all of a field's words, or, with get, is or set before, over half of them."""
    common = F.size(F.array_intersect(method_words, field_words))
    return (F.size(field_words) > 0) & ((common == F.size(field_words)) | (prefixed & (common * 2 > F.size(field_words))))


def leader_clusters(items: DataFrame, group: str, ident: str, features: str, cutoff: float, grow: bool = False) -> DataFrame:
    """(group, ident, leader): items in order of ident join the first leader whose Jaccard likeness reaches the cutoff, else lead.

    With `grow`, a merge changes the leader: it gains the features of the items that join it. Order decides,
    so a group is one task's work; give groups of items that can be alike at all.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        leaders: list[tuple] = []
        out = []
        for i, f in zip(pdf[ident], pdf[features]):
            s = set(f)
            lead, has = next(((k, t) for k, t in leaders if len(s & t) >= cutoff * max(1, len(s | t))), (None, None))
            if lead is None:
                leaders.append((i, s))
                lead = i
            elif grow:
                has |= s
            out.append(lead)
        return pd.DataFrame({group: pdf[group].to_numpy(), ident: pdf[ident].to_numpy(), "leader": out})

    kind = dict(items.dtypes)
    return items.select(group, ident, features).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {ident} {kind[ident]}, leader {kind[ident]}")


def merge_pairs(clusters: DataFrame, pairs: DataFrame, ident: str = "cluster_id") -> DataFrame:
    """(ident, merged): clusters that merging pairs (a, b) hold together, by the smallest of each."""
    c = connected(pairs)
    return clusters.select(ident).join(c.withColumnRenamed("node", ident), ident, "left").select(ident, F.coalesce("label", ident).alias("merged"))


def greedy_items(scores: DataFrame, group: str, left: str, right: str, score: str = "score") -> DataFrame:
    """Pairs by falling score, each side once; ties by left, then right."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[score] > 0].sort_values([score, left, right], ascending=[False, True, True])
        a, b, keep = set(), set(), []
        for x, y in zip(pdf[left], pdf[right]):
            keep.append(x not in a and y not in b)
            if keep[-1]:
                a.add(x)
                b.add(y)
        return pdf[np.array(keep, bool)]

    s = scores.select(group, left, right, score)
    return s.groupBy(group).applyInPandas(run, s.schema)


def greedy_values(p: list, p_keys: list, q: list, q_keys: list, flip: bool = False):
    """(i, j, score) of p and q by falling likeness, each key once; ties by p's key, then q's (the other way round with `flip`).

    Each p holds its best q that is left. q is in order of value, and what lies nearest on either side is best; of equally
    alike ones the smallest key, which comes first in its run of equal values.
    """
    order = sorted(range(len(q)), key=lambda j: (q[j], q_keys[j]))
    val, key = [q[j] for j in order], [q_keys[j] for j in order]
    n, at, first = len(val), {}, [0] * len(val)
    for j in range(n):
        at.setdefault(key[j], []).append(j)
        first[j] = first[j - 1] if j and val[j] == val[j - 1] else j
    up, down = list(range(n + 1)), list(range(n + 1))  # the next place that is left, upwards; downwards one is added

    def find(to, j):
        while to[j] != j:
            to[j] = to[to[j]]
            j = to[j]
        return j

    def push(i, start):
        lo, hi = find(down, start) - 1, find(up, start)
        s = max(likeness(p[i], val[lo]) if lo >= 0 else 0.0, likeness(p[i], val[hi]) if hi < n else 0.0)
        if s <= 0:
            return
        best = n
        while hi < n and likeness(p[i], val[hi]) == s:
            best = hi if best == n or key[hi] < key[best] else best
            hi = find(up, end[first[hi]])
        while lo >= 0 and likeness(p[i], val[lo]) == s:
            j = find(up, first[lo])
            best = j if best == n or key[j] < key[best] else best
            lo = find(down, first[lo]) - 1
        a, b = (key[best], p_keys[i]) if flip else (p_keys[i], key[best])
        heapq.heappush(heap, (-s, a, b, i, best, start))

    heap: list[tuple] = []
    end = {first[j]: j + 1 for j in range(n)}
    taken = set()
    for i, start in enumerate(np.searchsorted(np.array(val, float), np.array(p, float)).tolist()):
        push(i, start)
    while heap:
        s, _, _, i, j, start = heapq.heappop(heap)
        if p_keys[i] in taken:
            continue
        if up[j] != j:
            push(i, start)
            continue
        taken.add(p_keys[i])
        for k in at[key[j]]:
            up[k], down[k + 1] = k + 1, k
        yield i, order[j], -s


def greedy_near(a: DataFrame, b: DataFrame, group: str, left: str, right: str, value: str) -> DataFrame:
    """(group, left, right, score) of a (group, left, value) and b (group, right, value): pairs by falling likeness of values, each side once; ties by left, then right.

    What greedy_items gives for all pairs, which are never written out. Rows without group, key or finite value are left out.
    """

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        x, y = ((t[value].tolist(), t[k].tolist()) for t, k in ((l, left), (r, right)))
        got = [(i, j, s) for j, i, s in greedy_values(*y, *x, flip=True)] if len(r) < len(l) else list(greedy_values(*x, *y))
        g = l[group].iloc[:1].tolist() * len(got)
        return pd.DataFrame({group: g, left: [x[1][i] for i, _, _ in got], right: [y[1][j] for _, j, _ in got], "score": [s for _, _, s in got]})

    return by_value(a, b, group, left, right, value, run)


def merge_members(pairs: DataFrame, pair: str, score: str = "score", tha: float = 0.5, thb: float = 0.75, thm: float = 0.0) -> DataFrame:
    """(pair, left, n_left, right, n_right, score): each pair's members assigned one to one; whether enough are used to merge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        l, r = sorted(pdf["left"].unique()), sorted(pdf["right"].unique())
        m = np.zeros((len(l), len(r)))
        m[[l.index(x) for x in pdf["left"]], [r.index(x) for x in pdf["right"]]] = pdf[score]
        n = len(assign_matrix(m))
        fa, fb = (n / k if k else 1.0 for k in (int(pdf["n_left"].iloc[0]), int(pdf["n_right"].iloc[0])))
        small = min(int(pdf["n_left"].iloc[0]), int(pdf["n_right"].iloc[0]))
        return pd.DataFrame({pair: [pdf[pair].iloc[0]], "mapped": [n], "merges": [min(fa, fb) >= tha and max(fa, fb) >= thb and (not small or n / small >= thm)]})

    return pairs.groupBy(pair).applyInPandas(run, f"{pair} {dict(pairs.dtypes)[pair]}, mapped long, merges boolean")


def merge_packages(pairs: DataFrame, texts: DataFrame | None = None, low: float = 0.60, high: float = 0.75, same: float = 0.99) -> DataFrame:
    """(pair, mapped, outcome) of package pairs: merge, duplicate or apart.

    pairs (pair, left, right, left_used, right_used, exact, approx, n_left, n_right): scores of class pairs,
    and each package's number of used classes. Used classes are assigned one to one by exact scores, then
    what is left of all classes, then what is left of the used ones by approximate scores. Of the used
    classes of one side the share `low`, of the other `high` must be mapped. texts (pair, same_project,
    cosine): packages of one project with texts that are alike beyond `same` are duplicates.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        l, r = sorted(pdf["left"].unique()), sorted(pdf["right"].unique())
        li, ri = pdf["left"].map({x: i for i, x in enumerate(l)}).to_numpy(), pdf["right"].map({x: i for i, x in enumerate(r)}).to_numpy()
        used = {"left": set(pdf.loc[pdf["left_used"], "left"]), "right": set(pdf.loc[pdf["right_used"], "right"])}
        both = (pdf["left_used"] & pdf["right_used"]).to_numpy(bool)
        a, b = set(), set()
        for column, rows in (("exact", both), ("exact", np.ones(len(pdf), bool)), ("approx", both)):
            m = np.zeros((len(l), len(r)))
            m[li[rows], ri[rows]] = pdf[column].to_numpy()[rows]
            m[list(a), :] = 0
            m[:, list(b)] = 0
            for i, j in assign_matrix(m):
                a.add(i)
                b.add(j)
        n = [sum(l[i] in used["left"] for i in a), sum(r[j] in used["right"] for j in b)]
        f = [k / t if t else 1.0 for k, t in zip(n, (int(pdf["n_left"].iloc[0]), int(pdf["n_right"].iloc[0])))]
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "mapped": [len(a)], "fits": [min(f) >= low and max(f) >= high]})

    kind = dict(pairs.dtypes)["pair"]
    x = pairs.groupBy("pair").applyInPandas(run, f"pair {kind}, mapped long, fits boolean")
    dup = F.lit(False)
    if texts is not None:
        x = x.join(texts.select("pair", (F.col("same_project") & (F.col("cosine") > same)).alias("dup")), "pair", "left")
        dup = F.coalesce("dup", F.lit(False))
    return x.select("pair", "mapped", F.when(~F.col("fits"), "apart").when(dup, "duplicate").otherwise("merge").alias("outcome"))


def one_to_one(mappings: DataFrame, left: str, right: str, order: str) -> DataFrame:
    """Mappings of which neither side was mapped before, in order: the first of each left, then the first of each right."""
    a = Window.partitionBy(left).orderBy(order)
    b = Window.partitionBy(right).orderBy(order)
    m = mappings.withColumn("_a", F.row_number().over(a)).filter("_a = 1").drop("_a")
    return m.withColumn("_b", F.row_number().over(b)).filter("_b = 1").drop("_b")
