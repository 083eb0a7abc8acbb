"""The rewriting plans on cases by hand: nulls, quirks of names, spreading of what is undefined."""

from quillmesh.operators import planning


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_package_fixes_take_the_longest_package(spark):
    n = frame(spark, [(1, "a.b.C.d"), (2, "a.b"), (3, "x.Y"), (4, None), (5, "a.bc.D")], "use int, name string")
    got = planning.package_fixes(n, frame(spark, [("a",), ("a.b",), (None,)], "package string")).collect()
    assert {(r.use, r.to_name) for r in got} == {(1, "C.d"), (2, "b"), (5, "bc.D")}


def test_inner_classes_and_their_names(spark):
    c = frame(spark, [("p.O.I", "p.O", False, False), ("p.O.S", "p.O", False, True), ("p.O.F", "p.O", True, False), ("p.O.K", "p.O", False, False), ("p.T", None, False, False)], "name string, outer string, is_interface boolean, is_static boolean")
    m = frame(spark, [("p.O.I", "q.I"), ("p.O.S", "q.S"), ("p.O.F", "q.F"), ("p.O.K", "q.O.K"), ("p.O.I.m(p.O.S)", "q.I.n"), ("p.O.Ix", "q.Z"), ("p.T", "q.T")], "from_name string, to_name string")
    i = planning.inner_classes(c, m)
    assert {(r.name, r.lifted, r.make_static) for r in i.collect()} == {("p.O.I", "p.O_I", True), ("p.O.S", "p.O_S", False)}
    assert {tuple(r) for r in planning.lifted_names(m, i).collect()} == {("p.O_I", "q.I"), ("p.O_S", "q.S"), ("p.O_I.m(p.O.S)", "q.I.n")}
    refs = frame(spark, [("p.O.I", "f"), ("p.O.I", "f"), ("p.O.I", "other"), ("p.O.S", "f")], "in_class string, symbol string")
    assert {tuple(r) for r in planning.outer_uses(refs, i, frame(spark, [("f", "p.O"), ("other", "p.X")], "symbol string, owner string")).collect()} == {("p.O.I", "f")}


def test_imports_of_moved_tests(spark):
    rows = [(1, "b.X", "t", False, False), (2, "b.c.X", "t", False, False), (3, "b.X.f", "t", True, False), (4, "b", "t", False, True), (5, "t.Y", "t", False, False), (6, "tt.Y", "t", False, False)]
    got = planning.test_imports(frame(spark, rows, "use int, name string, own string, is_static boolean, on_demand boolean"), frame(spark, [("b",)], "package string"), "z").collect()
    assert {(r.use, r.to_name, r.action) for r in got} == {(1, None, "remove"), (2, "z.c.X", "rename"), (3, "z.X.f", "rename"), (4, None, "remove"), (5, "z.Y", "rename"), (6, "tt.Y", "keep")}


def test_undefined_spreads(spark):
    # expression in a statement in a method; a returning statement takes its block with it; a spoilt field spoils its uses
    n = [("e", "s", None, False, False, False, True), ("s", "m", None, True, False, False, False), ("m", "t", "m()", True, False, True, False), ("t", None, None, False, False, False, False)]
    n += [("x", "r", None, False, False, False, True), ("r", "blk", None, True, True, False, False), ("blk", "m2", None, True, True, True, False), ("m2", "t", "m2()", True, True, True, False)]
    n += [("bad", "fld", None, False, False, False, True), ("fld", "t", "fld", True, False, True, False), ("use", "us", None, False, False, False, False), ("us", "m3", None, True, False, False, False), ("m3", "t", "m3()", True, False, True, False)]
    nodes = frame(spark, n, "node string, parent string, defines string, deletable boolean, returns boolean, in_decl boolean, is_error boolean")
    got = planning.undefined(nodes, frame(spark, [("use", "fld")], "node string, symbol string")).collect()
    assert {r.node for r in got} == {"s", "r", "blk", "fld", "us"}


def test_tests_keep_what_they_need(spark):
    methods = frame(spark, [("A.t", "A", ["org.junit.jupiter.api.Test"]), ("B.u", "B", ["Test"]), ("C.x", "C", ["MyTest"]), ("D.n", "D", [])], "node string, owner string, annotations array<string>")
    owners = frame(spark, [("A", "Base"), ("Base", "Top"), ("D", "Base")], "sub string, super string")
    assert {r.node for r in planning.test_seeds(methods, owners).collect()} == {"A.t", "A", "Base", "Top", "B.u", "B"}
    items = frame(spark, [("A", None), ("h", "H"), ("H", None), ("D", None), ("D.n", "D"), ("kept", None)], "node string, owner string")
    refs = frame(spark, [("A.t", "h")], "from_symbol string, to_symbol string")
    assert {r.node for r in planning.untested(items, refs, methods, owners, frame(spark, [("kept",)], "node string")).collect()} == {"D", "D.n"}


def test_calls_are_renamed_where_they_no_longer_resolve(spark):
    u = frame(spark, [(1, "TYPE", "a", True), (2, "CALL", "a", True), (3, "CALL", "a", False), (4, "FIELD", "gone", True), (5, "FIELD", "b", True)], "use int, kind string, name string, resolved boolean")
    got = planning.test_renames(u, frame(spark, [("a", "x"), ("gone", "y")], "from_name string, to_name string"), frame(spark, [("a",), ("b",)], "name string"))
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (3, "x")}
