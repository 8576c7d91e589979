"""Base tables of facts, import resolution, class and call graphs.

Facts are exploded once into flat tables with ordinals, since order decides ties: files by their path's parts,
members by position. Every operator tolerates nulls in arrays and skips rows with an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifiers, last_segment, module_id, normalise_path
from ..sources.catalogs import DATA_CARRIER, ENTRY_FILES, NON_RUNTIME, RELATION_WEIGHTS, TEST_FILE
from .rank import first_seen


def files(facts: DataFrame) -> DataFrame:
    """Facts without errors, with module (path without suffix) and ord (the path's parts, which sort as paths do)."""
    return facts.where("error IS NULL").withColumn("module", module_id(F.col("file"))).withColumn("ord", F.split("file", "/"))


def runtime(facts: DataFrame) -> DataFrame:
    """Files of the running program; of files with the same module the last."""
    return first_seen(files(facts).where(~F.col("file").rlike(NON_RUNTIME)), ["module"], [F.desc("ord")])


def is_entry(facts_file: Column, functions: Column) -> Column:
    """Whether a file starts a program: by its name, or by a function called main."""
    stem = F.lower(F.regexp_extract(facts_file, r"([^/]+?)(?:\.[^./]+)?$", 1))
    return stem.isin(*ENTRY_FILES) | F.exists(F.coalesce(functions, F.array()), lambda f: F.lower(f["name"]) == "main")


def chunks(facts: DataFrame) -> DataFrame:
    """(id, text): one row per function and class, functions of a file before its classes."""
    rows = files(facts)
    fn = rows.select("file", "ord", F.lit(0).alias("kind"), F.posexplode("functions").alias("pos", "x")).select("file", "ord", "kind", "pos", F.col("x.name").alias("name"), F.concat_ws("\n", F.concat(F.lit("function "), F.col("x.signature")), F.col("x.docstring")).alias("text"))
    cls = rows.select("file", "ord", F.lit(1).alias("kind"), F.posexplode("classes").alias("pos", "x")).select("file", "ord", "kind", "pos", F.col("x.name").alias("name"), F.concat_ws("\n", F.concat(F.lit("class "), F.col("x.name")), F.col("x.docstring"), F.concat(F.lit("methods: "), F.array_join(F.col("x.methods.name"), ", "))).alias("text"))
    return fn.unionByName(cls).select(F.concat_ws("::", "file", "name").alias("id"), "text", "ord", "kind", "pos")


def import_graph(facts: DataFrame) -> DataFrame:
    """Distinct (src, dst) between modules: each import resolved by its language's rules, none to itself."""
    rows = files(facts)
    modules = rows.select(F.col("module").alias("dst"), "language", "namespace", F.col("classes.name").alias("names"), "ord")
    wanted = rows.select(F.col("module").alias("src"), "language", F.explode("imports").alias("imp"))

    sharp = wanted.where("language = 'csharp'").join(modules.where("language = 'csharp'").select(F.col("namespace").alias("imp"), "dst"), "imp").select("src", "dst")

    java = wanted.where("language = 'java'").select("src", "imp").distinct()
    declared = modules.where("language = 'java'")
    package = declared.select(F.col("namespace").alias("pkg"), "dst")
    named = first_seen(declared.select(F.explode("names").alias("name"), "namespace", "dst", "ord").select(F.concat_ws(".", "namespace", "name").alias("imp"), "dst", "ord"), ["imp"], [F.desc("ord")]).select("imp", "dst")
    star = java.where("imp LIKE '%.*'").select("src", F.regexp_replace("imp", r"\.\*$", "").alias("pkg")).join(package, "pkg").select("src", "dst")
    plain = java.where("imp NOT LIKE '%.*'")
    exact = plain.join(named, "imp").select("src", "dst")
    parent = plain.join(named, "imp", "left_anti").select("src", F.regexp_replace("imp", r"\.[^.]*$", "").alias("pkg")).join(package, "pkg").select("src", "dst")

    scripts = modules.where("language IN ('typescript', 'javascript')").select("dst").distinct()
    ts = wanted.where("language IN ('typescript', 'javascript')").where("imp LIKE '.%' OR imp LIKE '@/%'")
    target = F.when(F.startswith("imp", F.lit("@/")), F.concat(F.lit("src/"), F.substring("imp", 3, 10_000))).otherwise(F.concat_ws("/", F.regexp_replace("src", "/?[^/]*$", ""), "imp"))
    ts = ts.select("src", module_id(normalise_path(target)).alias("target"))
    options = ts.select("src", "target", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("target").alias("dst")), F.struct(F.lit(1).alias("k"), F.concat(F.col("target"), F.lit("/index")).alias("dst")))).alias("o")).select("src", "target", "o.k", "o.dst")
    scripted = first_seen(options.join(scripts, "dst"), ["src", "target"], [F.col("k")]).select("src", "dst")

    python = modules.where("language = 'python'").select("dst").distinct()
    names = F.regexp_replace(F.regexp_replace("dst", "/__init__$", ""), "/", ".")
    # A module is known under its dotted path and under it without the first directory (the root of a package folder).
    index = first_seen(python.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), names.alias("name")), F.struct(F.lit(1).alias("k"), F.regexp_replace(names, r"^[^.]*\.", "").alias("name")))).alias("x"), "dst").select("x.k", "x.name", "dst"), ["name"], [F.col("k"), F.col("dst")]).select("name", "dst")
    py = wanted.where("language = 'python'").select("src", "imp").distinct()
    level = F.length(F.regexp_extract("imp", r"^(\.*)", 1))
    base = F.split(F.col("src"), "/")
    base = F.slice(base, F.lit(1), F.greatest(F.size(base) - level, F.lit(0)))
    dotted = F.when(level == 0, F.col("imp")).otherwise(F.array_join(F.filter(F.concat(base, F.split(F.regexp_replace("imp", r"^\.+", ""), r"\.")), lambda s: s != ""), "."))
    asked = py.select("src", "imp", F.split(dotted, r"\.").alias("s"))
    prefixes = asked.select("src", "imp", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k"), "s").select("src", "imp", "k", F.array_join(F.slice("s", F.lit(1), F.col("k")), ".").alias("name"))
    pythonic = first_seen(prefixes.join(index, "name"), ["src", "imp"], [F.desc("k")]).select("src", "dst")

    out = sharp
    for x in (star, exact, parent, scripted, pythonic):
        out = out.unionByName(x)
    return out.where("src <> dst").distinct()


def class_graph(facts: DataFrame) -> DataFrame:
    """(src, dst, type, weight) between declared classes that are no data carriers: inheritance, composition by field types, dependency by calls; one more within a package. Of several relations the heaviest, then the first in this order."""
    rows = files(facts).where(~F.col("file").rlike(TEST_FILE))
    classes = rows.select("ord", F.regexp_replace("file", "/?[^/]*$", "").alias("package"), F.posexplode("classes").alias("pos", "c"))
    carrier = F.col("c.name").rlike(DATA_CARRIER) & (F.size(F.filter("c.methods", lambda m: m["name"] != "__init__")) == 0)
    declared = first_seen(classes.where(~carrier).withColumn("name", F.col("c.name")), ["name"], [F.col("ord"), F.col("pos")])
    tokens = lambda x: F.flatten(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda t: identifiers(F.coalesce(t, F.lit("")))))
    kinds = [("inheritance", F.col("c.bases")), ("composition", F.col("c.fields.type")), ("dependency", F.flatten(F.col("c.methods.calls")))]
    found = None
    for i, (kind, col) in enumerate(kinds):
        part = declared.select(F.col("name").alias("src"), F.col("package").alias("p1"), F.lit(kind).alias("type"), F.lit(RELATION_WEIGHTS[kind]).alias("w"), F.lit(i).alias("o"), F.explode(F.array_distinct(tokens(col))).alias("dst"))
        found = part if found is None else found.unionByName(part)
    target = declared.select(F.col("name").alias("dst"), F.col("package").alias("p2"))
    edges = found.where("src <> dst").join(target, "dst").withColumn("w", F.col("w") + (F.col("p1") == F.col("p2")).cast("int"))
    return edges.groupBy("src", "dst").agg(F.max_by("type", F.struct("w", -F.col("o"))).alias("type"), F.max("w").alias("weight"))


def callables(facts: DataFrame) -> DataFrame:
    """(key, name, owner, calls, is_entry, route, ord): functions (owned by their file's stem) and methods (by their class); of a repeated key the last."""
    rows = files(facts)
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]+)?$", 1)
    fn = rows.select("ord", F.lit(0).alias("kind"), stem.alias("owner"), F.posexplode("functions").alias("pos", "f")).select("ord", "kind", "owner", "pos", F.lit(0).alias("pos2"), "f")
    m = rows.select("ord", F.lit(1).alias("kind"), F.posexplode("classes").alias("pos", "c")).select("ord", "kind", F.col("c.name").alias("owner"), "pos", F.posexplode("c.methods").alias("pos2", "f"))
    both = fn.unionByName(m).select(F.concat_ws(".", "owner", "f.name").alias("key"), F.col("f.name").alias("name"), "owner", F.col("f.calls").alias("calls"), (F.size("f.routes") > 0).alias("routed"), F.get(F.col("f.routes"), 0)["path"].alias("route"), F.struct("ord", "kind", "pos", "pos2").alias("ord"))
    return first_seen(both, ["key"], [F.desc("ord")]).withColumn("is_entry", F.col("routed") | F.col("name").isin("main", "run", "handle", "handler", "execute"))


def resolved_calls(calls: DataFrame) -> DataFrame:
    """(src, dst, seq): calls resolved by simple name, to the first callable with another owner, else to the first."""
    made = calls.select(F.col("key").alias("src"), F.col("owner").alias("caller"), F.posexplode("calls").alias("seq", "call")).withColumn("name", last_segment(F.col("call")))
    options = made.join(calls.select("name", F.col("key").alias("dst"), "owner", "ord"), "name")
    best = first_seen(options, ["src", "seq"], [(F.col("owner") == F.col("caller")).cast("int"), F.col("ord")])
    return best.select("src", "dst", "seq")


def trace_sequences(calls: DataFrame, edges: DataFrame, participants: int = 8, messages: int = 16, depth: int = 6) -> DataFrame:
    """(entry, seq, src, dst, label, type): for each entry the messages of a depth-first walk in call order within the budgets, each pair of callables once, closed by a return message. The part of the graph within depth calls of an entry is gathered per entry."""
    entries = calls.where("is_entry").select(F.col("key").alias("entry"))
    reach = entries.withColumn("node", F.col("entry"))
    seen = reach
    for _ in range(depth):
        reach = reach.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("entry", F.col("dst").alias("node")).distinct()
        seen = seen.unionByName(reach).distinct()
    owner = calls.select(F.col("key").alias("dst"), F.col("owner").alias("dst_owner"), "name")
    local = seen.join(edges.withColumnRenamed("src", "node"), "node").join(owner, "dst").join(calls.select(F.col("key").alias("node"), F.col("owner").alias("src_owner")), "node")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["entry"].iloc[0]
        after: dict[str, list] = {}
        for r in pdf.sort_values(["node", "seq", "dst"]).itertuples():
            after.setdefault(r.node, []).append(r)
        out, people, pairs = [], [], set()

        def visit(node: str, level: int) -> None:
            for r in after.get(node, []) if level < depth else []:
                new = [p for p in dict.fromkeys((r.src_owner, r.dst_owner)) if p not in people]
                if (node, r.dst) in pairs or len(out) >= messages or len(people) + len(new) > participants:
                    continue
                pairs.add((node, r.dst))
                people.extend(new)
                if r.src_owner != r.dst_owner:
                    out.append((start, len(out), r.src_owner, r.dst_owner, r.name, "sync"))
                visit(r.dst, level + 1)

        visit(start, 0)
        if out:
            out.append((start, len(out), out[0][3], out[0][2], "result", "return"))
        return pd.DataFrame(out, columns=["entry", "seq", "src", "dst", "label", "type"])

    return local.groupBy("entry").applyInPandas(walk, "entry string, seq int, src string, dst string, label string, type string")


def detect_frameworks(facts: DataFrame, signs: DataFrame) -> DataFrame:
    """Names of the frameworks whose sign some import equals or extends by a slash or dot, by rank. signs: (rank, name, sign)."""
    imports = files(facts).select(F.explode("imports").alias("imp")).distinct()
    parts = imports.select("imp", F.explode(F.array_distinct(F.array(F.col("imp"), F.regexp_extract("imp", r"^(@[^/]+/[^/.]+|[^/.]+)", 1), F.regexp_extract("imp", r"^([^/]+)", 1)))).alias("sign"))
    return parts.join(F.broadcast(signs), "sign").select("rank", "name").distinct()
