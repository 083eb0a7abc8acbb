"""The covers and the import report against brute force."""

import random
from pathlib import Path

import pytest

from quillmesh.operators import graph, libraries
from quillmesh.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_set_cover_of_all_parts(spark):
    left = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        left.setdefault(f"s{r[0]}", set()).add(r[1])
    want = []
    while any(left.values()):
        top = max(left, key=lambda k: (len(left[k]), k))
        want.append((len(want), top, len(left[top])))
        done = set(left[top])
        left = {k: v - done for k, v in left.items()}
    assert sorted(map(tuple, catalogue.QUERIES["set_cover"](spark, str(DATA)).collect())) == want
    libs = {r.name for r in catalogue.QUERIES["find_libraries"](spark, str(DATA)).collect() if r.what == "library"}
    assert "s1" in libs and len(libs) > 1
    assert catalogue.QUERIES["prefix_cover"](spark, str(DATA)).count() > 2


def test_covers_end_with_nulls(spark):
    c = spark.createDataFrame([("x", "x", "a.b.c"), ("x", "x", None), (None, "y", "a.b.d")], "lib_id string, lib_name string, import string")
    assert [tuple(r) for r in graph.set_cover(c).collect()] == [(0, "x", 1)]


def test_import_report_at_every_size(spark):
    used = spark.createDataFrame([(1, "a.b.C"), (1, "a.b.C"), (2, "a.C"), (2, "ab.C"), (3, "c.D"), (3, "plain")], "cluster_id int, import string")
    for more in (0, 1200):
        related = spark.createDataFrame([("a",)] + [(f"z{i}",) for i in range(more)], "pkg string")
        assert sorted(map(tuple, libraries.import_report(used, related).collect())) == [(2, "ab.C"), (3, "c.D"), (3, "plain")]


@pytest.mark.parametrize("rows", [10, 10**6])
def test_set_cover_in_rounds_and_in_one_task(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "COVER_ROWS", rows)
    r = random.Random(3)
    pairs = sorted({(f"l{r.randrange(20)}", f"i{r.randrange(50)}") for _ in range(110)})
    lib, name = {}, lambda x: "n" + str(int(x[1:]) % 7)
    for x, i in pairs:
        lib.setdefault(x, set()).add(i)
    left, want = set().union(*lib.values()), []
    while left:
        top = max(lib, key=lambda x: (len(lib[x] & left), name(x), x))
        want.append((len(want), top, len(lib[top] & left)))
        left -= lib[top]
    got = graph.set_cover(spark.createDataFrame([(x, name(x), i) for x, i in pairs], "lib_id string, lib_name string, import string"))
    assert sorted(tuple(x) for x in got.collect()) == want


def test_prefix_cover_as_one_by_one(spark):
    r = random.Random(1)
    pairs = sorted({(f"org.p{r.randrange(4)}" + r.choice(["", f".c{r.randrange(6)}", f".c{r.randrange(6)}.K"]), f"org.p{r.randrange(4)}.c{r.randrange(6)}.K{r.randrange(4)}") for _ in range(150)})
    front = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    left, want = {i for _, i in pairs}, []
    while fit := [(i, -front(x, i), x) for x, i in pairs if i in left and front(x, i) > len(".".join(i.split(".")[:2]))]:
        want.append(min(fit)[2])
        left -= {i for x, i in pairs if x == want[-1]}
    chosen, rest = graph.prefix_cover(spark.createDataFrame(pairs, "lib_id string, import string"))
    assert chosen == want and {x["import"] for x in rest.collect()} == left


@pytest.mark.parametrize("rows, libs", [(1, 50_000), (25, 50_000), (60, 50_000), (60, 3), (10**6, 50_000)])
def test_set_cover_of_the_largest_first(spark, monkeypatch, rows, libs):
    # libraries that all share items: each is alone in no round, so that rounds must take many of the largest together
    monkeypatch.setattr(graph, "COVER_ROWS", rows)
    monkeypatch.setattr(graph, "COVER_LIBS", libs)
    r = random.Random(rows)
    lib = {x: {0, *(r.randrange(40) for _ in range(r.choice([3, 9, 25])))} for x in range(16)}
    name = lambda x: None if x == 3 else f"n{x % 5}"
    left, want = set().union(*lib.values()), []
    while left:
        top = max(lib, key=lambda x: (len(lib[x] & left), name(x) or "", x))
        want.append((len(want), top, len(lib[top] & left)))
        left -= lib[top]
    written, rounds = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or written(df))
    c = spark.createDataFrame([(x, name(x), i) for x, s in lib.items() for i in s], "lib_id int, lib_name string, import int")
    assert sorted(tuple(x) for x in graph.set_cover(c).collect()) == want
    if rows == 60 and libs > 3:
        assert len(rounds) < 3 + 4 * len(want)  # fewer rounds than choices
