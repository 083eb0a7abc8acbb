"""Queries without SQL and the planning operators against expected values and brute force."""

import itertools
import random
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from io import BytesIO
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import cluster, lexical, matching, relations
from quillmesh.plans import catalogue, graph_queries
from quillmesh.sources import parse

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def run(spark, name):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, str(DATA)).collect()]


def test_model_match(spark):
    got = {m: (s, dict(x.split("=") for x in n.split(";"))) for m, s, n in run(spark, "model_match")}
    assert set(got) == {"near", "far"}  # the unrelated model has no classes with members
    assert run(spark, "contains_model") == [(m,) for m, _, _ in run(spark, "model_match")]
    names = got["near"][1]
    assert names["near.Contact"] == "pat.Contact" and names["near.Address"] == "pat.Address" and names["near.ContactDAO"] == "pat.ContactDAO"
    assert {v for k, v in got["far"][1].items() if v.count(".") == 1} == {"pat.Contact", "pat.Address", "pat.Phone", "pat.ContactDAO"}
    assert got["far"][1]["far.tcatnoC"] == "pat.Contact" and got["near"][0] > 0.5 and got["far"][0] > 0.5


def test_class_merge(spark):
    # the candidate keeps 9 of 10 members: 5 of 6, 2 of 2 and 6 of 7 fields
    got = {p: (n, m) for p, n, m in run(spark, "class_merge")}
    assert got == {"Address": (5, True), "Phone": (2, True), "Contact": (6, True)}


def test_model_xml(spark):
    c, a, o, p, e = graph_queries.contacts(spark)
    count = lambda t: Counter(r.model_id for r in t.collect())
    n = {k: count(t) for k, t in (("cls", c), ("ATTRIBUTE", a), ("OPERATION", o), ("PARAMETER", p), ("ASSOCIATION", e))}
    for model, xml, source in run(spark, "model_xml"):
        tree = ET.fromstring(xml)
        tags = Counter(x.tag for x in tree.iter())
        assert tags["CLASS"] + tags["INTERFACE"] == n["cls"][model] and tags["INTERFACE"] == 1
        assert all(tags[t] == n[t][model] for t in ("ATTRIBUTE", "OPERATION", "PARAMETER", "ASSOCIATION"))
        assert source.startswith("@PatternPackage\ninterface " + model) and source.count("@PatternClass") == n["cls"][model]
        back = spark.createDataFrame([(model, source)], "file string, text string")
        rename = {"near": str, "pat": str, "far": lambda x: x[::-1], "none": lambda x: "Z" + x}[model]
        assert {(r.src, r.dst) for r in parse.pattern_edges(back).collect()} == {(rename(x), rename(y)) for x, y in (("ContactDAO", "Contact"), ("Contact", "Address"), ("Contact", "Phone"))}


def test_gradle_and_headers(spark):
    assert Counter(run(spark, "gradle_and_headers")) == Counter([("gradle", "a:b:1"), ("gradle", "c:d:2"), ("library", "a:b:1"), ("suggestedTerms", "x"), ("suggestedTerms", "y"), ("edge", "A>B")])


def test_headers_come_back(spark):
    from quillmesh.sources import sinks

    c, a, o, p, e = graph_queries.contacts(spark)
    m = c.select("model_id").distinct().select("model_id", F.col("model_id").alias("name"))
    h = spark.createDataFrame([("pat", "library", "a:b:1"), ("pat", "suggestedTerms", "y"), ("pat", "suggestedTerms", "x")], "model_id string, key string, value string")
    text = sinks.pattern_source(m, c, a, o, p, e, h, notes=("N", "NPack", "NCls")).select(F.col("model_id").alias("file"), F.col("source").alias("text"))
    got = {tuple(r) for r in parse.pattern_headers(text, note="N", package="NPack").collect()}
    assert got == {("pat", "library", 0, "a:b:1"), ("pat", "suggestedTerms", 0, "x"), ("pat", "suggestedTerms", 1, "y")}


@tables
def test_greedy_and_leaders(spark):
    nation = {}
    for t, k, n, b in (("customer", "c_custkey", "c_nationkey", "c_acctbal"), ("supplier", "s_suppkey", "s_nationkey", "s_acctbal")):
        for r in spark.read.parquet(f"{DATA}/{t}.parquet").select(n, k, b).collect():
            nation.setdefault(r[0], {}).setdefault(t, []).append((r[1], r[2]))
    want, best = Counter(), {}
    for g, t in nation.items():
        pairs = sorted((-1 / (1 + abs(x - y)), a, b) for a, x in t.get("customer", []) for b, y in t.get("supplier", []))
        l, r = set(), set()
        for s, a, b in pairs:
            if a not in l and b not in r:
                want[g, a, b] += 1
                l.add(a)
                r.add(b)
        few, many = sorted((t.get("customer", []), t.get("supplier", [])), key=len)
        if few and len(few) <= 2:
            best[g] = max(sum(1 / (1 + abs(x - y)) for (_, x), (_, y) in zip(few, p)) for p in itertools.permutations(many, len(few)))
    assert Counter((g, a, b) for g, a, b, _ in run(spark, "greedy_matches")) == want
    total = Counter()
    for g, _, _, s in run(spark, "assignment"):
        total[g] += s
    assert best and all(total[g] == pytest.approx(v) for g, v in best.items())
    leaders, want = {}, {}
    for r in sorted(spark.read.parquet(f"{DATA}/part.parquet").select("p_brand", "p_partkey", "p_type").collect(), key=lambda r: r[1]):
        s = set(r[2].split(" "))
        lead = next((k for k, t in leaders.setdefault(r[0], []) if len(s & t) >= 0.5 * len(s | t)), r[1])
        if lead == r[1]:
            leaders[r[0]].append((r[1], s))
        want[r[1]] = lead
    assert {p: x for _, p, x in run(spark, "leader_clusters")} == want


def test_prefix_cover_prefers_names(spark):
    c = spark.createDataFrame([("org.apache.foo", "org.apache.foo.A"), ("org.apache", "org.apache.foo.A"), ("com.x", "org.apache.bar.B")], "lib_id string, import string")
    from quillmesh.operators import graph

    chosen, left = graph.prefix_cover(c)
    assert chosen == ["org.apache.foo"] and [(r.lib_id, r[0]) for r in left.collect()] == [("com.x", "org.apache.bar.B")]


@tables
def test_find_libraries(spark):
    got = run(spark, "find_libraries")
    parts = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        parts.setdefault(f"s{r[0]}", set()).add(r[1])
    libs = [n for w, n in got if w == "library"]
    assert [n for w, n in got if w == "missing"] == ["nowhere.to.Find"] and "s1" in libs and len(set(libs)) == len(libs)
    assert set().union(*(parts[x] for x in libs)) == set().union(*parts.values())


def test_poms(spark):
    dep = "<dependency><groupId>{}</groupId><artifactId>{}</artifactId>{}</dependency>"
    xml = "<project><dependencies><!-- " + dep.format("x", "y", "") + " -->" + dep.format("g", "a", "<exclusions><exclusion><groupId>e</groupId><artifactId>f</artifactId></exclusion></exclusions><version> 1 </version>")
    xml += "<dependency><artifactId>lone</artifactId><version>${v}</version></dependency>" + dep.format("h", "b", "") + "</dependencies></project>"
    got = [r.coordinate for r in parse.pom_dependencies(spark.createDataFrame([(1, xml)], "file int, xml string")).collect()]
    assert got == ["g:a:1", ":lone:LATEST", "h:b:LATEST"]


def test_archives_beyond_the_depth_are_an_error(spark, monkeypatch):
    def packed(depth):
        data, name = b"class A {}", "A.java"
        for _ in range(depth):
            out = BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr(name, data)
            data, name = out.getvalue(), "in.zip"
        return spark.createDataFrame([("x.zip", bytearray(data))], "path string, content binary")

    assert parse.archive_members(packed(12)).first().text == "class A {}"
    with pytest.raises(Exception, match="nested deeper"):
        parse.archive_members(packed(parse.MAX_DEPTH + 2)).collect()


def test_parameter_and_call_plans(spark):
    own = spark.createDataFrame([("f", 0, "a", "int"), ("f", 1, "b", "String"), ("f", 2, "c", "int"), ("g", 0, "x", "int"), ("h", 0, "k", "int")], "op string, pos int, name string, type string")
    wanted = spark.createDataFrame([("f", 0, "b", "String"), ("f", 1, "a", "int"), ("f", 2, "z", "double"), ("g", 0, "y", "int"), ("g", 1, "n", "int")], "op string, pos int, name string, type string")
    plan = relations.parameter_plan(own, wanted)
    assert {tuple(r) for r in plan.collect()} == {
        ("f", 0, 1, "a", "int", "move"), ("f", 1, 0, "b", "String", "move"), ("f", 2, 2, "z", "double", "retype"), ("g", 0, 0, "y", "int", "rename"), ("g", None, 1, "n", "int", "add"), ("h", 0, None, None, None, "drop"),
    }
    calls = spark.createDataFrame([(9, "f", 0), (9, "f", 1), (9, "f", 2), (8, "h", 0)], "call int, op string, pos int")
    got = relations.call_plan(calls, plan, spark.createDataFrame([("h", "long")], "op string, to_type string"))
    assert {tuple(r) for r in got.collect()} == {(9, 0, 1, None), (9, 1, 0, None), (9, 2, 2, "double"), (8, -1, -1, "long")}


def test_compatible_signatures_as_the_method_rule(spark):
    kinds = ["VOID", "BOOLEAN", "STRING"]
    rows = [(s, r, list(p)) for s in (True, False) for r in kinds[:2] for n in range(3) for p in itertools.product(kinds, repeat=n)]
    a = spark.createDataFrame([(1, i, *x) for i, x in enumerate(rows)], "k int, i int, static boolean, ret string, params array<string>")
    b = a.select("k", F.col("i").alias("j"), F.col("static").alias("b_static"), F.col("ret").alias("b_ret"), F.col("params").alias("b_params"))
    for exact in (True, False):
        got = {(r.i, r.j) for r in matching.compatible_signatures(a, b, ["k"], exact).collect()}
        d = [{"static": s, "ret": r, "params": p} for s, r, p in rows]
        assert got == {(i, j) for i, x in enumerate(d) for j, y in enumerate(d) if matching.compatible_methods(x, y, exact, lambda p, q: p == q)}


def test_package_merge(spark):
    kind = "pair int, left string, right string, left_used boolean, right_used boolean, exact double, approx double, n_left int, n_right int"
    cells = lambda p, n, m, score, used=True: [(p, f"l{i}", f"r{j}", used, used, *score(i, j), n, m) for i in range(n) for j in range(m)]
    rows = cells(1, 4, 4, lambda i, j: (1.0 * (i == j and i < 2), 1.0 * (i == j))) + cells(2, 4, 4, lambda i, j: (1.0 * (i == j and i < 2), 0.0)) + cells(3, 2, 2, lambda i, j: (1.0 * (i == j), 0.0)) + cells(4, 3, 5, lambda i, j: (1.0 * (i == j), 0.0))
    t = spark.createDataFrame([(3, True, 0.995), (1, False, 0.999)], "pair int, same_project boolean, cosine double")
    got = {r.pair: (r.mapped, r.outcome) for r in cluster.merge_packages(spark.createDataFrame(rows, kind), t).collect()}
    assert got == {1: (4, "merge"), 2: (2, "apart"), 3: (2, "duplicate"), 4: (3, "merge")}


def test_package_components(spark):
    c = spark.createDataFrame([("p", "A", "USERTYPE"), ("p", "B", "USERTYPE"), ("p", "E", "EXCEPTION"), ("p", "U", "ENUM"), ("q", "N", "NUMBER"), ("q", "M", "STRING")], "package string, node string, kind string")
    got = relations.package_components(c, spark.createDataFrame([("B", "A")], "sub string, super string"), spark.createDataFrame([("A", "U")], "src string, dst string"))
    assert {tuple(r) for r in got.collect()} == {("p", "A"), ("p", "U"), ("q", "N"), ("q", "M")}


def test_limits_and_sets(spark):
    r = spark.createDataFrame([(1, i) for i in range(200)] + [(2, i) for i in range(10)], "req int, score int")
    q = spark.createDataFrame([(1, ["a", "b"], 500), (2, ["a"], 3)], "req int, packages array<string>, limit int")
    got = relations.limited_results(r, q, "req", [F.desc("score")]).collect()
    assert Counter(x.req for x in got) == {1: 100, 2: 3} and {x.score for x in got if x.req == 2} == {9, 8, 7}
    s = relations.sorted_sets(spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "k int, v string"), "k", "v", "vs").first()
    assert s.vs == ["a", "b"]
    libs = spark.createDataFrame([("g", "n", "2", 1), ("g", "n", "1", 0), ("g", "m", "1", 2)], "grp string, name string, version string, ord int")
    assert {(x.name, x.version) for x in relations.unique_libraries(libs, "ord").collect()} == {("n", "1"), ("m", "1")}


def test_word_score_without_vectors(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 9)], "a int, b int")
    v = lambda rows, k: spark.createDataFrame(rows, f"{k} int, term string, score double")
    words = (v([(1, "x", 0.6), (1, "y", 0.8), (3, "x", 1.0)], "a"), v([(2, "x", 1.0), (3, "x", 0.05), (3, "z", 0.99)], "b"))
    grams = (v([(1, "g", 1.0)], "a"), v([(3, "g", 0.05)], "b"))
    got = {(r.a, r.b): round(r.score, 9) for r in lexical.word_score(pairs, words, grams, "a", "b").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 0.25, (3, 9): 1.0}  # 0.6 * 0.05 / 0.6 + 0.05 / 0.25; no vector: 1


def test_element_vectors(spark):
    w = spark.createDataFrame([("a", f"t{i}") for i in range(12)] + [("b", "t0"), ("c", "t1")], "el string, term string")
    got = lexical.element_vectors(w, w, "el").collect()
    assert Counter((r.el, r.kind) for r in got) == {("a", "word"): 10, ("a", "kgram"): 10, ("b", "word"): 1, ("b", "kgram"): 1, ("c", "word"): 1, ("c", "kgram"): 1}
    assert sum(r.score**2 for r in got if r.el == "a" and r.kind == "word") == pytest.approx(1.0)


def plan(spark, name):
    return catalogue.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(40))
def test_assignment_by_value_is_best(seed):
    r = random.Random(seed)
    step = r.choice([0.01, 1.0, 1e-17])
    x, y = (np.array([r.randrange(20) * step for _ in range(r.randrange(9))]) for _ in range(2))
    score = 1 / (1 + np.abs(x[:, None] - y[None, :]))
    got, want = matching.assign_values(x, y), matching.assign_matrix(score)
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) == min(len(x), len(y))
    assert sum(score[i, j] for i, j in got) == pytest.approx(sum(score[i, j] for i, j in want))


@tables
def test_assignment_without_pairs(spark):
    assert "Join" not in plan(spark, "assignment")


@pytest.mark.parametrize("seed", range(40))
def test_greedy_by_value_as_over_all_pairs(seed):
    r = random.Random(seed)
    step = r.choice([0.01, 1.0, 1e-17])
    (x, a), (y, b) = (([r.randrange(12) * step for _ in range(n)], [r.randrange(10) for _ in range(n)]) for n in (r.randrange(9), r.randrange(9)))
    want, l, k = [], set(), set()
    for s, i, j in sorted((-1 / (1 + abs(x[i] - y[j])), a[i], b[j]) for i in range(len(x)) for j in range(len(y))):
        if i not in l and j not in k:
            want.append((i, j, -s))
            l.add(i)
            k.add(j)
    assert [(a[i], b[j], s) for i, j, s in cluster.greedy_values(x, a, y, b)] == want
    assert [(a[i], b[j], s) for j, i, s in cluster.greedy_values(y, b, x, a, flip=True)] == want


@tables
def test_greedy_matches_without_pairs(spark):
    assert "Join" not in plan(spark, "greedy_matches")
