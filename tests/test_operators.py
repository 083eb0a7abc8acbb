"""Hand-computed cases and properties."""

import io
import itertools
import pathlib
import random
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import cluster, filters, graph, lexical, libraries, matching, shingle
from quillmesh.plans import catalogue
from quillmesh.plans.params import Parameters
from quillmesh.sources import parse, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_tf_idf_by_hand(spark):
    d = spark.createDataFrame([(1, "cat cat dog"), (2, "dog"), (3, "fox"), (4, "123"), (5, None)], "doc_id long, text string")
    c = lexical.counts(lexical.terms(d))
    raw = {(r.doc_id, r.term): r.score for r in lexical.tf_idf(c).collect()}
    assert raw[1, "cat"] == pytest.approx(0.202733, abs=1e-6) and raw[1, "dog"] == 0 and raw[3, "fox"] == pytest.approx(0.202733, abs=1e-6)
    unit = {(r.doc_id, r.term): r.score for r in lexical.unit(lexical.tf_idf(c)).collect()}
    assert unit[1, "cat"] == 1 and unit[2, "dog"] == 0
    c = c.filter("doc_id < 3")
    neg = lexical.unit(lexical.tf_idf(c))
    assert {(r.doc_id, r.term): round(r.score, 6) for r in neg.collect()} == {(1, "cat"): 0.0, (1, "dog"): -1.0, (2, "dog"): -1.0}
    assert [round(r.score, 6) for r in lexical.cosine(neg, neg, 0.4, "doc_id", "other_id").collect()] == [1.0]


def test_unit_norms(spark):
    d = spark.createDataFrame([(i, " ".join(w for j, w in enumerate("a b c d e f g h i j k l m".split()) if (i * 7 + j) % 3)) for i in range(20)], "doc_id long, text string")
    v = lexical.limited(lexical.unit(lexical.tf_idf(lexical.counts(lexical.terms(d)))), 4)
    for r in v.groupBy("doc_id").agg(F.sum(F.col("score") ** 2).alias("n")).collect():
        assert r.n == pytest.approx(1) or r.n == 0


def test_words_and_names(spark):
    assert one(spark, T.words(F.lit("cat dog"), legacy_tail=True)) == ["cat"]
    assert one(spark, T.words(F.lit("cat dog."), legacy_tail=True)) == ["cat", "dog"]
    assert one(spark, T.words(F.lit("x\npackage a.b;\ncode"), from_package=True)) == ["package", "a", "b", "code"]
    assert one(spark, T.mapped_type(F.lit("Map<String,int[]>"))) == "Map_lt_String_cm_int_ARR__gt_"
    assert one(spark, T.name_words(F.lit("getHTTP2_names"))) == sorted({"gethttp2_names", "get", "http", "_names", "_name", "gethttp2_name"})
    assert one(spark, T.name_words(F.lit("ab"))) is None
    assert one(spark, T.convert_name(F.lit("getHttpServer"), "USI1")) == "GET_HTTP_SERVER"
    assert one(spark, T.convert_name(F.lit("value"), "MFP", prefix="my")) == "myValue"
    assert one(spark, T.common_prefix(F.lit("abcd"), F.lit("abx"))) == 2 and one(spark, T.common_prefix(F.lit(""), F.lit("a"))) == 0
    assert one(spark, T.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, T.output_name(F.lit("a.b.C<a.b.D>"), F.lit("a.b"))) == "C<D>"


def test_dictionary_splits(spark):
    dic = spark.createDataFrame([("get",), ("http",), ("server",)], "word string")
    d = spark.createDataFrame([(1, "getHttpServer"), (2, "HTTPServer"), (3, "getHTTPServer")], "doc_id long, text string")
    got = lexical.dictionary_terms(d, dic).groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("t")).collect()
    assert {r.doc_id: r.t for r in got} == {1: ["get", "http", "server"], 3: ["get"]}


def test_grams(spark):
    d = spark.createDataFrame([(1, "a b c d e f ; g h".split()), (2, []), (3, ["x"])], "doc_id long, t array<string>")
    got = {(r.doc_id, r.pos): r.gram for r in shingle.segmented_grams(d, F.col("t")).collect()}
    assert got == {(1, 0): "abcde", (1, 1): "bcdef", (1, 2): "gh", (3, 0): "x"}


def test_top_k_is_one_more(spark):
    d = spark.createDataFrame([(1, chr(97 + i) * 2, float(i)) for i in range(10)], "doc_id long, term string, score double")
    assert lexical.top_terms(d, 5).count() == 6


def test_containment(spark):
    r = spark.createDataFrame([("p", "r1", ["A", "B"]), ("p", "r2", ["A"]), ("p", "r3", ["A", "B"]), ("p", "r4", ["C"]), ("p", "r5", []), ("q", "r6", [])], "project string, result string, items array<string>")
    assert {x.result for x in filters.drop_contained(r, "project", "result", "items").collect()} == {"r1", "r4", "r6"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sets(st.sampled_from("ABCDE"), min_size=1), min_size=1, max_size=8))
def test_containment_leaves_an_antichain(spark, sets):
    r = spark.createDataFrame([("p", i, sorted(s)) for i, s in enumerate(sets)], "project string, result long, items array<string>")
    kept = [sets[x.result] for x in filters.drop_contained(r, "project", "result", "items").collect()]
    assert all(not a <= b for a, b in itertools.permutations(kept, 2)) and all(any(s <= k for k in kept) for s in sets)


def test_tight_fallback(spark):
    df = spark.range(9)
    assert filters.tight_or_loose(df, F.col("id") < 4, F.lit(True)).count() == 9
    assert filters.tight_or_loose(df, F.col("id") < 5, F.lit(True)).count() == 5


def test_fractions(spark):
    rows = [("x", "a", i < 3, False) for i in range(4)] + [("x", "b", i < 2, False) for i in range(5)]
    u = spark.createDataFrame(rows, "pair string, side string, used boolean, mapped boolean")
    assert not cluster.match_fractions(u, "pair", 0.5, 0.75, 0.0).first().passes


def test_assignment_by_hand():
    assert matching.assign_matrix(np.array([[1, 0.9], [0.9, 0]])) == [(0, 1), (1, 0)]
    assert matching.assign_matrix(np.array([[0.0]])) == []
    assert matching.assign_matrix(np.zeros((0, 3))) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_best(n, m, seed):
    s = np.random.default_rng(seed).integers(0, 6, (n, m)) / 5
    got = matching.assign_matrix(s)
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    t = s if n <= m else s.T
    best = max(sum(t[i, p[i]] for i in range(len(t))) for p in itertools.permutations(range(t.shape[1]), len(t)))
    assert sum(s[a, b] for a, b in got) == pytest.approx(best)


def test_set_cover(spark):
    c = spark.createDataFrame([("x", "x", 1), ("x", "x", 2), ("y", "y", 2), ("y", "y", 3), ("z", "z", 3)], "lib_id string, lib_name string, import int")
    assert [r.lib_id for r in graph.set_cover(c).orderBy("step").collect()] == ["y", "x"]


def test_class_gate(spark):
    s = lambda a, af, o, of: one(spark, matching.class_score(*[F.lit(x) for x in (a, af, o, of)]))
    assert s(3, 1, 0, 0) == 0 and s(3, 2, 0, 0) == pytest.approx(2 / 3) and s(0, 0, 1, 0) == 0 and s(0, 0, 0, 0) == 1


def test_prune(spark):
    c = spark.createDataFrame([("CLASS", "a", 10), ("CLASS", "b", 2), ("CLASS", "c", 1)], "kind string, text string, use_count long")
    assert {r.text for r in cluster.prune(c, F.lit(30), F.lit(0.2)).collect()} == {"a", "b"}


def test_methods_compatible():
    eq = lambda a, b: a == b or "OBJECT" in (a, b)
    a = {"ret": "VOID", "static": False, "params": ["STRING"]}
    b = {"ret": "NUMBER", "static": False, "params": ["STRING", "BOOLEAN"]}
    assert not matching.compatible_methods(a, b, True, eq) and matching.compatible_methods(a, b, False, eq)


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("A.java", "class A {}")
        z.writestr("skip.txt", "no")
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        info = tarfile.TarInfo("in.jar")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    (tmp_path / "B.java").write_text("class B {}")
    (tmp_path / "note.md").write_text("no")
    got = {r.name.rsplit("/", 1)[-1]: r.text for r in parse.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"B.java": "class B {}", "t.tar!in.jar!A.java": "class A {}"}


def test_saved_counts(spark, tmp_path):
    w = spark.createDataFrame([("cat", 2), ("dog", 1)], "term string, df long")
    g = spark.createDataFrame([("a b", 3)], "term string, df long")
    lines = [r.line for r in sinks.count_lines(w, 5, g, 7).collect()]
    assert lines == ["5", "2 cat", "1 dog", parse.KGRAM_MARK, "7", "3 a b"]
    (tmp_path / "t").write_text("\n".join(lines) + "\n")
    back = {(r.kind, r.term): r.df for r in parse.read_saved_counts(spark, str(tmp_path / "t")).collect()}
    assert back == {("word", None): 5, ("word", "cat"): 2, ("word", "dog"): 1, ("kgram", None): 7, ("kgram", "a b"): 3}
    sinks.write_counts(w, 5, g, 7, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/df_words")).count() == 2


def test_paged_docs(spark):
    body = '{"response":{"numFound":1,"docs":[{"g":"a","a":"b","v":"1","p":"jar","timestamp":5}]}}'
    got = parse.paged_docs(spark.createDataFrame([(body,), ("",), (None,)], "body string")).collect()
    assert [(r.grp, r.artifact, r.version, r.packaging, r.stamp) for r in got] == [("a", "b", "1", "jar", 5)]


def test_libraries(spark):
    c = spark.createDataFrame([("l", "a.B")], "lib_id string, cls string")
    i = spark.createDataFrame([("a.B.Inner",), ("x.Y",)], "import string")
    assert [(r.lib_id, r["import"]) for r in libraries.works_for(c, i).collect()] == [("l", "a.B.Inner")]
    tests = spark.createDataFrame([("t1", "import a.b; x", ["a.b"]), ("t2", "nothing", ["a.b"])], "id string, text string, packages array<string>")
    assert [r.id for r in filters.relevant_tests(tests).collect()] == ["t1"]


def test_parameters():
    assert Parameters().non_defaults() == {} and Parameters(tight_filter=False).non_defaults() == {"tight_filter": False}


def test_closure_of_start(spark):
    refs = spark.createDataFrame([("m", "C.start"), ("n", "C.run")], "from_symbol string, to_symbol string")
    kept = spark.createDataFrame([("C.start",)], "node string")
    assert {r.node for r in graph.references_closure(refs, kept).collect()} == {"C.start", "C.run", "m", "n"}


@pytest.mark.parametrize("tile", [1, 3, 1024])
def test_cosine_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(lexical, "TILE", tile)
    r = random.Random(5)
    vecs = {}
    for k in range(40):
        v = {f"t{r.randrange(12)}": r.random() for _ in range(r.randrange(1, 6))}
        n = sum(x * x for x in v.values()) ** 0.5
        vecs[k] = {t: x / n for t, x in v.items()}
    rows = [(k, t, x) for k, v in vecs.items() for t, x in v.items()] + [(None, "t1", 1.0)]
    df = spark.createDataFrame(rows, "a int, term string, score double")
    dot = {(i, j): sum(x * vecs[j].get(t, 0) for t, x in vecs[i].items()) for i in vecs for j in vecs}
    for cutoff in (0.4, 0.9):
        got = {(x.a, x.b): x.score for x in lexical.cosine(df, df, cutoff, "a", "b").collect()}
        assert got == {p: pytest.approx(s) for p, s in dot.items() if p[0] < p[1] and s >= cutoff}
        left, right = df.filter("a % 2 = 0"), df.filter("a % 3 = 0").withColumnRenamed("a", "b")
        got = {(x.a, x.b): x.score for x in lexical.cosine(left, right, cutoff, "a", "b").collect()}
        assert got == {p: pytest.approx(s) for p, s in dot.items() if p[0] % 2 == 0 and p[1] % 3 == 0 and s >= cutoff}


def test_symbol_threshold_at_the_border(spark):
    # ten scores whose average is 0.31: those of 0.3 are at the border, whatever the last bits say; rows without class are a class
    tenths = [6, 1, 0, 3, 3, 6, 2, 1, 7, 2]
    for cls in ("7", "NULL"):
        rows = ", ".join(f"({k}, {t / 100!r}D * 10)" for k, t in enumerate(tenths))
        m = spark.sql(f"SELECT CAST({cls} AS INT) AS class_id, k, s AS term_match, 0 AS title_match FROM VALUES {rows} AS t(k, s)")
        assert sorted(r.k for r in filters.symbol_threshold(m).collect()) == [0, 3, 4, 5, 8]


def test_candidate_tests_of_several_packages(spark, monkeypatch):
    from quillmesh.operators import members

    monkeypatch.setattr(members, "TILE", 2)  # pieces of a package
    r = random.Random(2)
    cand = [(r.randrange(12), f"p{r.randrange(3)}") for _ in range(20)] + [(k, "p1") for k in range(20, 30)] + [(20, "p1"), (31, None), (32, "none")]
    tests = [(k, "s", f"import p{r.randrange(3)} import p{r.randrange(3)} {r.randrange(4)}", f"p{r.randrange(3)}") for k in range(40)]
    want = {}
    for c, p in cand:
        for t, _, text, q in tests:
            if p == q and f"import {q}" in text:
                want[c, text] = min(t, want.get((c, text), t))
    c, t = spark.createDataFrame(cand, "candidate int, package string"), spark.createDataFrame(tests, "test_id int, parent string, text string, package string")
    assert sorted(map(tuple, members.candidate_tests(c, t).collect())) == sorted((c, t) for (c, _), t in want.items())
    # candidates of one package: pairs go out as they are met, nothing is done to them after the join
    single = members.candidate_tests(c.filter("candidate >= 20"), t)
    assert "Aggregate" not in single._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_two_kinds_meet_once_and_are_not_shuffled(spark):
    r = random.Random(6)

    def unit(k):
        v = {f"t{r.randrange(9)}": r.random() for _ in range(r.randrange(1, 5))}
        n = sum(x * x for x in v.values()) ** 0.5
        return {t: x / n for t, x in v.items()}

    words, grams = {k: unit(k) for k in range(30) if k % 7}, {k: unit(k) for k in range(30) if k % 5}
    table = lambda vecs: spark.createDataFrame([(k, t, x) for k, v in vecs.items() for t, x in v.items()], "a long, term string, score double")
    dot = lambda vecs, i, j: sum(x * vecs[j].get(t, 0) for t, x in vecs[i].items()) if i in vecs and j in vecs else None
    want = {}
    for i in range(30):
        for j in range(i + 1, 30):
            w, g = dot(words, i, j), dot(grams, i, j)
            if (w or 0) >= 0.5 or (g or 0) >= 0.2:
                want[i, j] = pytest.approx(1.0 if w is None else min(1.0, w / 0.6 + (g or 0) / 0.25))
    out = lexical.word_pairs(table(words), table(grams), 0.5, 0.2, "a", "b")
    got = out.collect()
    assert len(got) == len(want) and {(x.a, x.b): x.score for x in got} == want and any(w is None for w in (dot(words, i, j) for i, j in want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange")


def odd_documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")


def by_sql(name, path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    return sorted(c.execute(catalogue.ORACLES[name]).fetchall())


def words_of(r, n):
    """A text of words that hardly any other text has."""
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n))


def disk_of(spark, name, path):
    """Bytes that a query leaves in the shared folder."""
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if spark.sparkContext.getCheckpointDir() else None
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet")) if folder else 0
    before = size()
    out = catalogue.QUERIES[name](spark, path)
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return size() - before, sorted(tuple(x) for x in out.collect())


def test_pieces_keep_keys_whole(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    r = random.Random(3)
    keys = sorted((r.randrange(12) for _ in range(60))) + [None, None, 3, None]
    rows = [(k, ["x"] * r.randrange(5)) for k in keys]
    x = pa.table({"k": pa.array(keys, pa.int64()), "t": [t for _, t in rows]})
    for step in (1, 3, 64):
        pieces = list(lexical._pieces(iter(x.to_batches(max_chunksize=step)), ["k"], ["t"]))
        assert [(k, t) for p in pieces for k, t in zip(p["k"].to_pylist(), p["t"].to_pylist())] == rows and len(pieces) > 8
        assert all(a["k"].to_pylist()[-1] != b["k"].to_pylist()[0] for a, b in itertools.pairwise(pieces))
    assert list(lexical._pieces(iter([]), ["k"], ["t"])) == []


def test_cosine_pairs_of_odd_rows(spark, tmp_path):
    r = random.Random(4)
    word = lambda: r.choice("alpha Beta gamma delta Épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split())
    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 40)))) for i in range(60)]
    rows += [(7, "Beta gamma again"), (7, None), (8, "alpha"), (None, "alpha beta"), (None, "xi"), (100, None), (101, ""), (102, "1 2 ."), (103, "alpha"), (-5, "eta eta eta"), (104, words_of(r, 300)), (105, rows[3][1]), (106, rows[3][1])]
    odd_documents(spark, tmp_path, rows)
    assert sorted(tuple(x) for x in catalogue.QUERIES["cosine_pairs"](spark, str(tmp_path)).collect()) == by_sql("cosine_pairs", tmp_path)


def test_cosine_pairs_keep_terms_off_the_disk(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, words_of(r, 200)) for i in range(400)]
    odd_documents(spark, tmp_path, [*rows, (400, rows[0][1]), (401, "same again"), (402, "same again")])
    left, got = disk_of(spark, "cosine_pairs", str(tmp_path))
    assert got == [(0, 400, 1.0), (401, 402, 1.0)]
    assert left < 0.2 * sum(len(t) for _, t in rows)  # as (document, term, count) it was more than half of the text


def test_blended_score_of_odd_rows(spark, tmp_path):
    r = random.Random(6)
    word = lambda: r.choice("alpha Beta gamma delta Épsilon zeta . eta theta. iota kappa lambda 12 mu .. nu xi omicron pi rho sigma tau".split())
    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(80)]
    rows += [(None, "alpha beta"), (100, None), (101, ""), (102, "1 2 ."), (103, "alpha"), (104, "alpha."), (105, rows[3][1]), (106, rows[3][1] + " alpha."), (107, words_of(r, 300)), (108, "ab c"), (109, "a bc")]
    odd_documents(spark, tmp_path, rows)
    assert sorted(tuple(x) for x in catalogue.QUERIES["blended_score"](spark, str(tmp_path)).collect()) == by_sql("blended_score", tmp_path)


def test_blended_score_keeps_terms_off_the_disk(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, words_of(r, 200)) for i in range(400)]
    odd_documents(spark, tmp_path, [*rows, (400, rows[0][1])])
    left, got = disk_of(spark, "blended_score", str(tmp_path))
    assert got == [(0, 400, 1.0)]
    assert left < 0.3 * sum(len(t) for _, t in rows)
