"""Optimal assignment and the scores that match attributes, operations, classes and whole models."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.plans.params import DEFAULTS, Parameters


def assign_matrix(score: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight one-to-one pairs (row, column) of a score matrix; pairs of score 0 are left out.

    Shortest augmenting paths with potentials, a row at a time, over the rectangular matrix.
    """
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score).astype(float)
    n, m = cost.shape
    if n == 0:
        return []
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j0 = row, -1
        base = 0.0
        while True:
            free = ~done
            reach = base + cost[i] - u[i] - v
            better = free & (reach < best)
            best[better], back[better] = reach[better], j0
            j0 = int(np.where(free, best, np.inf).argmin())
            base = best[j0]
            done[j0] = True
            if owner[j0] < 0:
                break
            i = owner[j0]
        end = base
        u[row] += end
        for j in np.flatnonzero(done):
            if j != j0 and owner[j] >= 0:
                u[owner[j]] += end - best[j]
                v[j] -= end - best[j]
        while j0 >= 0:
            prev = back[j0]
            owner[j0] = row if prev < 0 else owner[prev]
            j0 = prev
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    pairs = [(b, a) if flip else (a, b) for a, b in pairs]
    return sorted((a, b) for a, b in pairs if score[a, b] != 0)


def assign(scores: DataFrame, group: str, left: str, right: str, score: str = "score") -> DataFrame:
    """Best one-to-one pairs within each group of (group, left, right, score); missing pairs score 0."""
    s = scores.select(group, left, right, score)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, ai = np.unique(pdf[left].to_numpy(), return_inverse=True)
        b, bi = np.unique(pdf[right].to_numpy(), return_inverse=True)
        m = np.zeros((len(a), len(b)))
        m[ai, bi] = pdf[score]
        pairs = assign_matrix(m)
        g = pdf[group].iloc[0]
        return pd.DataFrame({group: [g] * len(pairs), left: [a[i] for i, _ in pairs], right: [b[j] for _, j in pairs], score: [m[i, j] for i, j in pairs]})

    return s.groupBy(group).applyInPandas(run, s.schema)


#: Cells of a matrix that a task may hold.
DENSE = 1 << 23


def likeness(a, b):
    """How alike two numbers are: 1 / (1 + their distance)."""
    return 1 / (1 + abs(a - b))


def assign_values(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight one-to-one pairs (i, j) by the likeness of x[i] and y[j], as assign_matrix gives for all pairs.

    Augmenting paths again, but a row's columns come nearest first and only while they can be on the shortest path: potentials
    of columns are never above 0, so that the nearest that is left bounds all others of its row. A path ends at the first free column.
    """
    if len(x) > len(y):
        return sorted((i, j) for j, i in assign_values(y, x))
    order = np.argsort(y, kind="stable")
    col, row = y[order].tolist(), x.tolist()
    start, m = np.searchsorted(y[order], x).tolist(), len(y)
    u, v, owner, held = [0.0] * len(row), [0.0] * m, [-1] * m, [-1] * len(row)
    for r in range(len(row)):
        best: dict[int, float] = {}
        back: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple] = []

        def look(i, base, lo, hi):
            """The next nearest column of row i, as a bound, with those that come after it."""
            below = row[i] - col[lo] if lo >= 0 else np.inf
            above = col[hi] - row[i] if hi < m else np.inf
            if below <= above and lo >= 0:
                heapq.heappush(heap, (base - 1 / (1 + below) - u[i], 0, lo, i, base, lo - 1, hi))
            elif hi < m:
                heapq.heappush(heap, (base - 1 / (1 + above) - u[i], 0, hi, i, base, lo, hi + 1))

        look(r, 0.0, start[r] - 1, start[r])
        while True:
            reach, known, j, i, base, lo, hi = heapq.heappop(heap)
            if j in done and known:
                continue
            if not known:
                if j not in done and reach - v[j] < best.get(j, np.inf):
                    best[j], back[j] = reach - v[j], i
                    heapq.heappush(heap, (best[j], 1, j, i, 0.0, 0, 0))
                look(i, base, lo, hi)
                continue
            done.add(j)
            if owner[j] < 0:
                break
            look(owner[j], reach, start[owner[j]] - 1, start[owner[j]])
        u[r] += reach
        for k in done:
            if k != j:
                u[owner[k]] += reach - best[k]
                v[k] -= reach - best[k]
        while True:  # each row of the path takes the column it was reached from
            i = owner[j] = back[j]
            held[i], j = j, held[i]
            if i == r:
                break
    return sorted((i, int(order[j])) for j, i in enumerate(owner) if i >= 0)


def assign_near(a: DataFrame, b: DataFrame, group: str, left: str, right: str, value: str) -> DataFrame:
    """(group, left, right, score): best one-to-one pairs within each group of a (group, left, value) and b (group, right, value) by likeness of values.

    Pairs are never written out: a group is as many rows as it has members. Small groups of sides of about one size, where paths
    are long, are assigned as a matrix. Rows without group, key or finite value are left out;
    of a key's values the least counts.
    """

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        l, r = (t.sort_values([k, value]).drop_duplicates(k) for t, k in ((l, left), (r, right)))
        x, y = l[value].to_numpy(float), r[value].to_numpy(float)
        dense = len(x) * len(y) <= DENSE and max(len(x), len(y)) < 2 * min(len(x), len(y))
        pairs = np.array(assign_matrix(likeness(x[:, None], y)) if dense else assign_values(x, y), int).reshape(-1, 2)
        i, j = pairs[:, 0], pairs[:, 1]
        g = l[group].iloc[:1] if len(i) else l[group].iloc[:0]
        return pd.DataFrame({group: np.repeat(g.to_numpy(), len(i)), left: l[left].to_numpy()[i], right: r[right].to_numpy()[j], "score": likeness(x[i], y[j])})

    return by_value(a, b, group, left, right, value, run)


def by_value(a: DataFrame, b: DataFrame, group: str, left: str, right: str, value: str, run) -> DataFrame:
    """run(members of a, members of b) of each group that both have, to (group, left, right, score)."""
    clean = lambda t, k: t.select(group, k, F.col(value).cast("double").alias(value)).dropna().filter(F.abs(value) < float("inf"))
    kinds = {**dict(b.dtypes), **dict(a.dtypes)}
    return clean(a, left).groupBy(group).cogroup(clean(b, right).groupBy(group)).applyInPandas(run, f"{group} {kinds[group]}, {left} {kinds[left]}, {right} {kinds[right]}, score double")


def attribute_scores(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of equal category (arg_type) and `on`: 1 + likeness of names. a: (.., a_id, a_name, arg_type), b likewise."""
    return a.join(b, [*on, "arg_type"]).withColumn("score", 1.0 + T.similarity(F.col("a_name"), F.col("b_name")))


def signature(ret: Column, ctor: Column, static: Column, params: Column) -> Column:
    """What operations must share to match: flags, return category, categories of parameters in any order."""
    return F.concat_ws("|", ret, ctor.cast("string"), static.cast("string"), F.array_join(F.array_sort(params), ","))


def operation_scores(a: DataFrame, b: DataFrame, on: list[str], words: Column | None = None) -> DataFrame:
    """Pairs of equal signature and `on`: 1 + min(1, (3 * likeness of names + likeness of words) / 4)."""
    name = T.similarity(F.col("a_name"), F.col("b_name"))
    return a.join(b, [*on, "sig"]).withColumn("score", 1.0 + F.least(F.lit(1.0), (3.0 * name + (F.lit(1.0) if words is None else words)) / 4.0))


def gate(total: Column, found: Column, cutoff: float, strict_one: bool) -> Column:
    """Whether too few of a side's members were found."""
    g = ((total == 2) & (found == 0)) | ((total == 3) & (found <= 1)) | ((total == 4) & (found <= 2)) | ((total > 4) & (found / total < cutoff))
    return g | ((total == 1) & (found == 0)) if strict_one else g


def class_score(attrs: Column, attrs_found: Column, ops: Column, ops_found: Column, p: Parameters = DEFAULTS) -> Column:
    score = F.when((attrs > 0) | (ops > 0), (attrs_found + ops_found) / (attrs + ops)).otherwise(F.lit(1.0))
    return F.when(gate(attrs, attrs_found, p.attr_cutoff, False) | gate(ops, ops_found, p.method_cutoff, True), F.lit(0.0)).otherwise(score)


def blended_class_score(score: Column, name: Column, words: Column, size: Column, p: Parameters = DEFAULTS) -> Column:
    """Structure and names: a class of no members counts structure for 0.2, of one for 0.5, else for 1 - word fraction."""
    f = F.when(size == 0, 0.2).when(size == 1, 0.5).otherwise(1 - p.word_fraction)
    return score * f + F.least(F.lit(1.0), name * 0.75 + words * 0.75) * (1 - f)


def assignment_class_score(score: Column, name: Column, p: Parameters = DEFAULTS) -> Column:
    return F.when(score < p.class_cutoff, 0.0).otherwise(0.8 * score + 0.2 * name)


def component_score(compatible: Column, a_names: Column, b_names: Column) -> Column:
    """1 + the best likeness of two components' names, methods of every object left out; 0 if their types don't fit."""
    plain = lambda a: F.filter(F.transform(a, lambda n: F.lower(n)), lambda n: ~n.isin("hashcode", "equals", "tostring", "clone"))
    best = F.array_max(F.flatten(F.transform(plain(a_names), lambda x: F.transform(plain(b_names), lambda y: T.similarity(x, y)))))
    return F.when(compatible, 1.0 + F.coalesce(best, F.lit(0.0))).otherwise(0.0)


def compatible_methods(a: dict, b: dict, exact: bool, equal) -> bool:
    """Return, static and parameters pair off; approximately, a VOID return and left-over VOID and BOOLEAN parameters pass."""
    if a["static"] != b["static"] or not (equal(a["ret"], b["ret"]) or not exact and "VOID" in (a["ret"], b["ret"])):
        return False
    rest = list(b["params"])
    over = []
    for x in a["params"]:
        at = next((i for i, y in enumerate(rest) if equal(x, y)), None)
        if at is None:
            over.append(x)
        else:
            rest.pop(at)
    over += rest
    return not over if exact else all(x in ("VOID", "BOOLEAN") for x in over)


def compatible_signatures(a: DataFrame, b: DataFrame, on: list[str], exact: bool = True) -> DataFrame:
    """a (.., static, ret, params array) and b (.., b_static, b_ret, b_params) joined on `on` where their methods go together, as in compatible_methods."""

    def without(x: Column, y: Column) -> Column:
        """x less what pairs off with y, category by category."""
        size = lambda v: F.size(v)
        drop = lambda acc, v: F.when(F.array_position(acc, v) > 0, F.concat(F.slice(acc, F.lit(1), F.array_position(acc, v).cast("int") - 1), F.slice(acc, F.array_position(acc, v).cast("int") + 1, size(acc)))).otherwise(acc)
        return F.aggregate(y, x, drop)

    p, q = F.coalesce("params", F.array().cast("array<string>")), F.coalesce("b_params", F.array().cast("array<string>"))
    over = F.concat(without(p, q), without(q, p))
    ret = F.col("ret") == F.col("b_ret")
    if exact:
        fits = ret & (F.size(over) == 0)
    else:
        fits = (ret | (F.col("ret") == "VOID") | (F.col("b_ret") == "VOID")) & F.forall(over, lambda x: x.isin("VOID", "BOOLEAN"))
    return a.join(b, on).filter((F.col("static") == F.col("b_static")) & fits)


class _Model:
    def __init__(self, rows: dict):
        c, e = rows["classes"], rows["edges"]
        self.classes = {x["class_id"]: x for x in c}
        self.names = {n: x["class_id"] for x in c for n in (x["name"], x["full_name"])}
        self.edges = {(x["src"], x["dst"]) for x in e}
        self.up = {k: {self.names[s] for s in x["supers"] if s in self.names} - {k} for k, x in self.classes.items()}
        self.down = {k: {j for j, s in self.up.items() if k in s} for k in self.classes}
        self.near = {k: {b for a, b in self.edges if a == k} | {a for a, b in self.edges if b == k} for k in self.classes}


def _similar(a: str, b: str) -> float:
    n = max(len(a), len(b))
    if not n:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / n


def _members(base: dict, pat: dict, p: Parameters):
    """Structure score of a class pair and its names."""
    names: dict = {}

    def pairs(kind, rate):
        a, b = pat[kind], base[kind]
        m = np.array([[rate(x, y) for y in b] for x in a]).reshape(len(a), len(b))
        got = assign_matrix(m)
        names.update({b[j]["full_name"]: a[i]["full_name"] for i, j in got})
        return len(a), len(got)

    def op(x, y):
        same = (x["ret"], x["is_ctor"], x["is_static"], sorted(x["params"])) == (y["ret"], y["is_ctor"], y["is_static"], sorted(y["params"]))
        return 1 + min(1, (3 * _similar(x["name"], y["name"]) + 1) / 4) if same else 0

    if not pat["is_matchable"]:
        return 0.0, {}
    at, af = pairs("attrs", lambda x, y: 1 + _similar(x["name"], y["name"]) if x["arg_type"] == y["arg_type"] else 0)
    mt, mf = pairs("ops", op)

    def few(total, found, cutoff, one):
        return found == 0 and (total == 2 or one and total == 1) or total == 3 and found <= 1 or total == 4 and found <= 2 or total > 4 and found / total < cutoff

    if few(at, af, p.attr_cutoff, False) or few(mt, mf, p.method_cutoff, True):
        return 0.0, {}
    score = (af + mf) / (at + mt) if at + mt else 1.0
    pe, be = pat["enum_consts"], base["enum_consts"]
    if pe is not None or be is not None:
        if pe is None or be is None:
            return 0.0, {}
        most = max(len(set(pe)), len(set(be)))
        score = (len(set(pe) & set(be)) / most if most else 1.0) * p.enum_fraction + score * (1 - p.enum_fraction)
    return score, names


def match(base_rows: dict, pat_rows: dict, p: Parameters = DEFAULTS) -> tuple[float, dict]:
    """Score of a base model against a pattern, and the names that match.

    Depth first over the pattern's classes, the one with fewest candidates next, few candidates each,
    cut off when what is still to gain can't reach the score cutoff.
    """
    base, pat = _Model(base_rows), _Model(pat_rows)
    cands = {}
    for k, c in pat.classes.items():
        found = []
        for j, b in base.classes.items():
            s, names = _members(b, c, p)
            n = _similar(c["name"], b["name"])
            size = len(c["attrs"]) + len(c["ops"])
            f = 0.2 if size == 0 else 0.5 if size == 1 else 1 - p.word_fraction
            t = s * f + min(1.0, 0.75 * n + 0.75) * (1 - f)
            if s > 0 and t >= p.class_cutoff:
                found.append((t, n, j, names))
        cands[k] = found
    most = len(pat.classes) + 1
    beam = 1 if most > 8 else 2 if most > 6 else 3 if most > 4 else 4

    def ends(cmap):
        e = [(cmap[a], cmap[b]) for a, b in pat.edges if a in cmap and b in cmap]
        hit = sum(x in base.edges or x[::-1] in base.edges for x in e)
        return not e or hit / len(e) >= p.depend_cutoff

    def search(left, cmap, score, togo):
        if (score + togo) / most < p.score_cutoff:
            return 0.0, {}
        if not left:
            return (score + (0 if pat.edges else 1), {}) if ends(cmap) else (0.0, {})
        k = min(left, key=lambda x: (len(left[x]), pat.classes[x]["name"]))
        rest = {x: v for x, v in left.items() if x != k}
        if not left[k]:
            return search(rest, cmap, score, togo - 1)
        best, best_names = 0.0, {}
        for t, _, j, names in sorted(left[k], key=lambda x: (-x[0], -x[1], base.classes[x[2]]["name"]))[:beam]:
            new = {**cmap, k: j}
            ups, downs = pat.up[k], pat.down[k]
            bad = any(u in new and new[u] not in base.up[j] for u in ups) or not ups and bool(base.up[j]) or any(d in new and new[d] not in base.down[j] for d in downs)
            t = 0.0 if bad else t
            if bad:
                new = dict(cmap)
            near = lambda x: not bad and x in pat.near[k]
            nxt = {x: [(s + 1 / len(pat.edges) if near(x) and c in base.near[j] else s, n, c, m) for s, n, c, m in v if c != j] for x, v in rest.items()}
            got, more = search(nxt, new, score + t, togo - 1)
            if got > best:
                best = got
                best_names = {**more, **({} if bad else names), base.classes[j]["full_name"]: pat.classes[k]["full_name"]}
        return best, best_names

    total, names = search(cands, {}, 0.0, float(most))
    total /= most
    return (total, names) if total >= p.class_cutoff else (0.0, {})


def nested_models(classes: DataFrame, attributes: DataFrame, operations: DataFrame, parameters: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per model of the flat model tables, as `match` takes it."""
    ps = parameters.groupBy("model_id", "op_id").agg(F.array_sort(F.collect_list("arg_type")).alias("params"))
    ops = operations.join(ps, ["model_id", "op_id"], "left")
    ops = ops.groupBy("model_id", "class_id").agg(F.sort_array(F.collect_list(F.struct("name", "full_name", F.col("ret_arg_type").alias("ret"), "is_ctor", "is_static", F.coalesce("params", F.array().cast("array<string>")).alias("params")))).alias("ops"))
    attrs = attributes.groupBy("model_id", "class_id").agg(F.sort_array(F.collect_list(F.struct("name", "full_name", "arg_type"))).alias("attrs"))
    c = classes.join(attrs, ["model_id", "class_id"], "left").join(ops, ["model_id", "class_id"], "left")
    supers = F.array_compact(F.concat(F.array("super_name"), F.coalesce("ifaces", F.array().cast("array<string>"))))
    c = c.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("class_id", "name", "full_name", "is_matchable", supers.alias("supers"), "enum_consts", F.coalesce("attrs", F.array().cast("array<struct<name:string,full_name:string,arg_type:string>>")).alias("attrs"), F.coalesce("ops", F.array().cast("array<struct<name:string,full_name:string,ret:string,is_ctor:boolean,is_static:boolean,params:array<string>>>")).alias("ops")))).alias("classes"))
    e = edges.groupBy("model_id").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    return c.join(e, "model_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<src:string,dst:string>>")))


def match_models(models: DataFrame, pattern: dict, p: Parameters = DEFAULTS) -> DataFrame:
    """(model_id, score, name_map) of the models that match a pattern model (a dict of classes and edges); a model is one row."""
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rows = {"classes": [_plain(x) for x in r.classes], "edges": [_plain(x) for x in r.edges]}
                s, names = match(rows, pattern, p)
                if s > 0:
                    out.append((r.model_id, s, names))
            yield pd.DataFrame(out, columns=["model_id", "score", "name_map"])

    return models.select("model_id", "classes", "edges").mapInPandas(run, "model_id string, score double, name_map map<string,string>")


def match_pairs(pairs: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """pairs (.., classes, edges, p_classes, p_edges of a pattern model) that match: (.., score, name_map). A pair is one row."""
    keys = [c for c in pairs.columns if c not in ("classes", "edges", "p_classes", "p_edges")]
    schema = ", ".join(f"`{k}` {t}" for k, t in pairs.select(*keys).dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                model, pattern = ({"classes": [_plain(x) for x in r[f"{f}classes"]], "edges": [_plain(x) for x in r[f"{f}edges"]]} for f in ("", "p_"))
                s, names = match(model, pattern, p)
                if s > 0:
                    out.append((*(r[k] for k in keys), s, names))
            yield pd.DataFrame(out, columns=[*keys, "score", "name_map"])

    return pairs.mapInPandas(run, f"{schema}, score double, name_map map<string,string>")


def containment_report(members: DataFrame, models: DataFrame, candidates: DataFrame, p: Parameters = DEFAULTS) -> DataFrame:
    """(cluster_id, model_id), once: models that contain any model of a cluster.

    members (cluster_id, model_id), models as of nested_models, candidates (cluster_id, model_id): which models
    a cluster is held against, as from a search or a join of terms. A cluster's own members aren't reported.
    """
    pattern = members.join(models, "model_id").select("cluster_id", F.col("classes").alias("p_classes"), F.col("edges").alias("p_edges"))
    held = candidates.select("cluster_id", "model_id").distinct().join(members.select("cluster_id", "model_id"), ["cluster_id", "model_id"], "left_anti")
    found = match_pairs(held.join(pattern, "cluster_id").join(models.select("model_id", "classes", "edges"), "model_id"), p)
    return found.select("cluster_id", "model_id").distinct()


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, np.ndarray | list):
        return [_plain(v) for v in x]
    return x.asDict(recursive=True) if hasattr(x, "asDict") else x
