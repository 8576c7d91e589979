"""Renderers: what diagram servers decode, and cases that the tables don't hold."""

import zlib

from pyspark.sql import functions as F

from factloom.operators import architecture, render


def test_encoded_text_decodes(spark):
    texts = ["classDiagram", "a\nb" * 300, "", None, "é"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", render.encoded(F.col("t")).alias("e")).collect():
        if r["t"] is None:
            assert r["e"] is None
            continue
        bits = [render.DIGITS.index(c) for c in r["e"]]
        data = b"".join((bits[i] << 18 | bits[i + 1] << 12 | bits[i + 2] << 6 | bits[i + 3]).to_bytes(3) for i in range(0, len(bits), 4))
        assert zlib.decompressobj(-15).decompress(data).decode() == r["t"]


def test_a_lone_class_stays(spark):
    classes = spark.createDataFrame([("A", ["+x"], 1), ("A", ["+y"], 2)], "name string, members array<string>, ord int")
    none = spark.createDataFrame([], "src string, dst string, type string")
    assert [r["line"] for r in render.class_diagram(classes, none).orderBy("ord").collect()] == ["classDiagram", "    class a {\n        +x\n    }"]


def test_bypass_and_cycles(spark):
    e = spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "b"), ("x", "a"), ("b", "c")], "src string, dst string")
    gone = spark.createDataFrame([("x",), ("y",)], "node string")
    assert {tuple(r) for r in architecture.bypass(e, gone).collect()} == {("a", "b"), ("b", "c")}
    assert architecture.has_cycle(e) and not architecture.has_cycle(e.where("NOT (src = 'x' AND dst = 'a')")) and not architecture.has_cycle(e.limit(0))


def test_exact_partition(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    one = lambda rows: architecture.exact_partition(spark.createDataFrame(rows, "group string, id int"), ids).first()["exact"]
    assert one([("a", 1), ("b", 2)]) and not one([("a", 1)]) and not one([("a", 1), ("b", 2), ("b", 1)]) and not one([("a", 1), ("b", 2), ("b", 3)])
