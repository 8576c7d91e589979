"""Diagram text, one row per line: (keys, ord, line). Joining the lines of a diagram in order gives its text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_id, safe_label, slug_word
from . import graph
from .rank import first_seen

#: Arrows of class relations; inheritance points from the base.
ARROWS = {"inheritance": "<|--", "composition": "*--", "aggregation": "o--", "dependency": "..>"}
#: The digits of the text encoding of diagrams.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"


def _numbered(lines: DataFrame, key: list[str]) -> DataFrame:
    return lines.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("o")).alias("ord"), "line")


def _line(part: int, *order: Column | str, line: Column) -> list[Column]:
    a, b = [F.col(x) if isinstance(x, str) else x for x in order] + [F.lit("")] * (2 - len(order))
    return [F.struct(F.lit(part).alias("p"), a.cast("string").alias("a"), b.cast("string").alias("b")).alias("o"), line.alias("line")]


def class_diagram(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """Lines of a class diagram. classes: name, members (array of text), ord; relations: src, dst, type. Of equal names the first; classes without a relation are left out unless there is one class alone."""
    known = first_seen(classes, ["name"], [F.col("ord")])
    valid = graph.without_dangling(relations.where("src <> dst").dropDuplicates(["src", "dst", "type"]), known.select(F.col("name").alias("node")))
    if known.limit(2).count() > 1:
        known = known.join(graph.nodes(valid), F.col("name") == F.col("node"), "left_semi")
    identity = lambda c: safe_id(F.col(c))
    body = F.concat(F.lit("    class "), identity("name"), F.lit(" {\n"), F.array_join(F.transform("members", lambda m: F.concat(F.lit("        "), safe_label(m), F.lit("\n"))), ""), F.lit("    }"))
    boxes = known.select(*_line(1, "name", line=body))
    arrow = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in ARROWS.items()], F.lit("-->"))
    turned = F.col("type") == "inheritance"
    tied = valid.select(*_line(2, "src", F.concat_ws("\t", "dst", "type"), line=F.concat(F.lit("    "), F.when(turned, identity("dst")).otherwise(identity("src")), F.lit(" "), arrow, F.lit(" "), F.when(turned, identity("src")).otherwise(identity("dst")))))
    head = classes.sparkSession.range(1).select(*_line(0, F.lit(""), line=F.lit("classDiagram")))
    return _numbered(head.unionByName(boxes).unionByName(tied), [])


def sequence_diagram(messages: DataFrame, key: str) -> DataFrame:
    """Lines of one sequence diagram per key. messages: key, seq, src, dst, label, type (return is dashed). Participants come in order of first appearance, by the last part of their dotted name."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    alias = lambda c: slug_word(last(c))
    sides = messages.select(key, F.explode(F.array(F.struct(F.col("seq").alias("seq"), F.lit(0).alias("side"), F.col("src").alias("name")), F.struct(F.col("seq").alias("seq"), F.lit(1).alias("side"), F.col("dst").alias("name")))).alias("x"))
    people = sides.groupBy(key, alias(F.col("x.name")).alias("id")).agg(F.min("x").alias("x"))
    number = lambda c: F.lpad(c.cast("string"), 12, "0")
    boxes = people.select(key, *_line(1, number(F.col("x.seq")), F.col("x.side"), line=F.concat(F.lit("    participant "), F.col("id"), F.lit(" as "), safe_label(last(F.col("x.name"))))))
    arrow = F.when(F.col("type") == "return", "-->>").otherwise("->>")
    said = messages.select(key, *_line(2, number(F.col("seq")), line=F.concat(F.lit("    "), alias(F.col("src")), arrow, alias(F.col("dst")), F.lit(": "), safe_label(F.col("label")))))
    head = messages.select(key).distinct().select(key, *_line(0, F.lit(""), line=F.lit("sequenceDiagram")))
    return _numbered(head.unionByName(boxes).unionByName(said), [key])


def component_diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a flowchart with one box per module: nodes: id, label, module; edges: src, dst, label. Equal ids after slugging count once; no loops, no undeclared ends."""
    known = first_seen(nodes.withColumn("slug", slug_word(F.col("id"))), ["slug"], [F.col("id")])
    opened = known.select("module").distinct().select(*_line(1, "module", F.lit(""), line=F.concat(F.lit('    subgraph "'), safe_label(F.col("module")), F.lit('"'))))
    boxes = known.select(*_line(1, "module", F.concat(F.lit("\t"), "slug"), line=F.concat(F.lit("        "), "slug", F.lit('["'), safe_label(F.col("label")), F.lit('"]'))))
    closed = known.select("module").distinct().select(*_line(1, "module", F.lit("￿"), line=F.lit("    end")))
    slugged = edges.select(slug_word(F.col("src")).alias("src"), slug_word(F.col("dst")).alias("dst"), "label").where("src <> dst")
    tied = first_seen(graph.without_dangling(slugged, known.select(F.col("slug").alias("node"))), ["src", "dst"], [F.col("label")])
    arrows = tied.select(*_line(2, "src", "dst", line=F.concat(F.lit("    "), "src", F.lit(" -->|"), safe_label(F.col("label")), F.lit("| "), "dst")))
    head = nodes.sparkSession.range(1).select(*_line(0, F.lit(""), line=F.lit("flowchart LR")))
    return _numbered(head.unionByName(opened).unionByName(boxes).unionByName(closed).unionByName(arrows), [])


def encoded(text: Column) -> Column:
    """A diagram's text as raw DEFLATE in the digits that diagram servers take: three bytes as four digits."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            press = zlib.compressobj(9, zlib.DEFLATED, -15)
            data = press.compress(x.encode()) + press.flush()
            number = [int.from_bytes(data[i : i + 3].ljust(3, b"\0")) for i in range(0, len(data), 3)]
            return "".join(DIGITS[n >> s & 63] for n in number for s in (18, 12, 6, 0))

        for batch in batches:
            yield batch.map(one)

    return run(text)


def pretty_json(x: Column) -> Column:
    """JSON with its nulls, indented."""
    return F.to_json(x, {"ignoreNullFields": "false", "pretty": "true"})


def compact_json(x: Column) -> Column:
    """JSON with its nulls and no spaces."""
    return F.to_json(x, {"ignoreNullFields": "false"})
