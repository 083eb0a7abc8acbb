"""Models that are read from declarations: by hand, malformed files, and back from the writer."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import matching
from quillmesh.plans import catalogue, graph_queries
from quillmesh.sources import models, sinks

TEXT = """package a.b; import java.util.*; import x.y.Far; /* class No {} */
@PatternPackage interface Shop {
@PatternClass(uses={Item.class, a.b.Shop.Cart.class, Gone.class})
abstract class Cart<T extends Comparable<T>> extends Far implements Runnable {
  private Map<String, List<Item>> items = new HashMap<String,List<Item>>(), more[];
  static { int x = 1; }
  T any; char c = '}'; String s = "class Q { ; }";
  protected Cart(Item... all) throws Exception { if (a < b) { return; } }
  public static <K> K[] find(final K key, @Note(x = 1) int n[]) { return null; }
  class Row { Item item; Cart<String> of() { return null; } }
}
@PatternClass enum Kind { A(1), B { int z; }, @Old C; int code; }
record Item(String name, Date day) { Item { } int total() { return 1; } }
interface Sub extends Runnable, Far { void run() default 1; }
class Broken { int 3x; ) ; Oops oops; void ok() {} }
"""


def load(spark, *rows):
    return models.load_models(spark.createDataFrame(list(rows), "file string, text string"))


def test_declarations(spark):
    m = load(spark, ("f", TEXT), ("empty", ""), ("null", None), ("junk", "}} class"))
    assert {(r.model_id, r.name, r.package) for r in m.models.collect()} == {("f", "Shop", "a.b.Shop"), ("empty", None, "*DEFAULT*"), ("junk", None, "*DEFAULT*")}
    c = {r.class_id: r for r in m.classes.collect()}
    assert set(c) == {"Cart", "Cart.Row", "Kind", "Item", "Sub", "Broken"} and c["Cart.Row"].full_name == "a.b.Shop.Cart.Row"
    assert c["Kind"].enum_consts == ["A", "B", "C"] and c["Kind"].is_enum and c["Sub"].is_interface
    assert not c["Cart"].is_matchable and c["Cart"].super_name is None and c["Cart"].ifaces == ["java.lang.Runnable"] and not c["Sub"].is_matchable and c["Item"].is_matchable
    a = {r.attr_id: (r.arg_type, r.type_name, r.access) for r in m.attributes.collect()}
    assert a == {
        "Cart.items": ("MAP", "Map<String,List<Item>>", "private"), "Cart.more": ("ARRAY", "Map<String,List<Item>>[]", "private"), "Cart.any": ("OBJECT", "T", None), "Cart.c": ("NUMBER", "char", None),
        "Cart.s": ("STRING", "String", None), "Cart.Row.item": ("USERTYPE", "Item", None), "Kind.code": ("NUMBER", "int", None), "Item.name": ("STRING", "String", "private"),
        "Item.day": ("DATE", "Date", "private"), "Broken.oops": ("OTHER", "Oops", None),
    }
    o = {r.map_name: (r.ret_arg_type, r.is_ctor, r.is_static, r.access) for r in m.operations.collect()}
    assert o == {
        "a.b.Shop.Cart.Cart(Item_ARR_)": ("VOID", True, False, "protected"), "a.b.Shop.Cart.find(K,int_ARR_)": ("ARRAY", False, True, "public"), "a.b.Shop.Cart.Row.of()": ("USERTYPE", False, False, None),
        "a.b.Shop.Item.total()": ("NUMBER", False, False, None), "a.b.Shop.Sub.run()": ("VOID", False, False, None), "a.b.Shop.Broken.ok()": ("VOID", False, False, None),
    }
    assert {(r.op_id, r.pos, r.name, r.arg_type) for r in m.parameters.collect()} == {("Cart.Cart#0", 0, "all", "ARRAY"), ("Cart.find#1", 0, "key", "OBJECT"), ("Cart.find#1", 1, "n", "ARRAY")}
    assert {(r.src, r.dst) for r in m.edges.collect()} == {("Cart", "Item"), ("Cart.Row", "Item"), ("Cart.Row", "Cart")}


def test_written_models_come_back(spark):
    c, a, o, p, e = graph_queries.contacts(spark)
    text = sinks.pattern_source(c.select("model_id").distinct().select("model_id", F.col("model_id").alias("name")), c, a, o, p, e)
    m = models.load_models(text.select(F.col("model_id").alias("file"), F.col("source").alias("text")))
    rows = lambda t, *k: Counter(tuple(r) for r in t.select("model_id", *k).collect())
    assert rows(m.classes, "name", "is_interface") == rows(c, "name", "is_interface")
    assert rows(m.attributes, "class_id", "name", "type_name") == rows(a, "class_id", "name", "type_name")
    assert rows(m.operations, "class_id", "name", "ret_type", "is_ctor") == rows(o, "class_id", "name", "ret_type", "is_ctor")
    assert rows(m.parameters, "pos", "name", "type_name") == rows(p, "pos", "name", "type_name")
    assert {k for k in rows(m.edges, "src", "dst") if k[0] in ("pat", "near")} == {k for k in rows(e, "src", "dst") if k[0] in ("pat", "near")}
    found = matching.match_models(matching.nested_models(*m[1:]).filter("model_id <> 'pat'"), matching.nested_models(*m[1:]).filter("model_id = 'pat'").first().asDict(recursive=True))
    assert "near" in {r.model_id for r in found.collect()}


def test_files_by_ending(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "A.java").write_text("package p; class A { B b; } class B {}")
    (tmp_path / "in" / "C.pat").write_text("class C {}")
    (tmp_path / "D.txt").write_text("class D {}")
    m = models.read_models(spark, str(tmp_path), (".java", ".pat"))
    assert {r.full_name for r in m.classes.collect()} == {"p.A", "p.B", "*DEFAULT*.C"}
    assert [(r.src, r.dst) for r in m.edges.collect()] == [("A", "B")]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_growing_clusters(spark):
    leaders, want = {}, {}
    for r in sorted(spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_brand", "p_partkey", "p_type").collect(), key=lambda r: r[1]):
        s, mine = set(r[2].split(" ")), leaders.setdefault(r[0], [])
        hit = next((x for x in mine if len(s & x[1]) >= 0.5 * len(s | x[1])), None)
        if hit is None:
            mine.append((r[1], s))
        else:
            hit[1].update(s)
        want[r[1]] = hit[0] if hit else r[1]
    got = {r.p_partkey: r.leader for r in catalogue.QUERIES["growing_clusters"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want
