"""Operators between files and diagrams: components and their flags, seeds and folds, projections, bypasses, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .joins import fragment_match, token_match
from .rank import best_by, top_k, top_n_per_group


def component_flags(members: DataFrame, component: str, flags: dict[str, Column], language: str, entity: Column, most: int = 8) -> DataFrame:
    """Per component: its flags by or, distinct languages in order, and the first entities in order."""
    flagged = members.groupBy(component).agg(F.count(F.lit(1)).alias("files"), *[F.bool_or(c).alias(k) for k, c in flags.items()], F.array_sort(F.collect_set(language)).alias("languages"))
    owned = top_n_per_group(members.select(component, entity.alias("entity")).where("entity IS NOT NULL").distinct(), [component], [F.col("entity")], most, "__r")
    listed = owned.groupBy(F.col(component).alias("__c")).agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    return flagged.join(listed, F.col(component).eqNullSafe(F.col("__c")), "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))).drop("__c")


def slim(members: DataFrame, component: str, file: str, order: list[Column], most: int = 12) -> DataFrame:
    """Per component the first files in order, and how many there are."""
    counted = members.groupBy(component).agg(F.count(F.lit(1)).alias("file_count"))
    first = top_n_per_group(members, [component], order, most, "__r").groupBy(F.col(component).alias("__c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", file))), lambda x: x[file]).alias("files"))
    return counted.join(first, F.col(component) == F.col("__c")).drop("__c")


def module_key(path: Column, depth: int) -> Column:
    """The first depth + 1 segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth + 1), "/")


def folder_seed(df: DataFrame, path: str) -> DataFrame:
    """df with seed: below the top segment, the segment after the folders that all paths of the top share; the path itself if it has none."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    w = Window.partitionBy(F.get(parts, 0))
    # The longest common prefix of a set of arrays is that of its least and greatest.
    ranged = df.withColumn("__lo", F.min(dirs).over(w)).withColumn("__hi", F.max(dirs).over(w))
    shared = F.aggregate(F.arrays_zip("__lo", "__hi"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + (a["on"] & F.coalesce(x["__lo"] == x["__hi"], F.lit(False))).cast("int")).alias("n"), (a["on"] & F.coalesce(x["__lo"] == x["__hi"], F.lit(False))).alias("on")), lambda a: a["n"])
    at = F.coalesce(shared, F.lit(0))
    return ranged.withColumn("seed", F.when(at < F.size(parts) - 1, F.get(parts, at)).otherwise(F.col(path))).drop("__lo", "__hi")


def consolidate_clusters(ties: DataFrame, qualified: DataFrame, share: float = 0.6) -> DataFrame:
    """(node, target) of nodes that aren't qualified: the qualified node that holds at least the share of the node's tie weight (the smaller of equal ones), or null. ties: a, b, weight, in both directions alike; qualified: node."""
    both = ties.select("a", "b", "weight").unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("w"))
    q = qualified.select(F.col("node").alias("b"), F.lit(True).alias("q"))
    outside = both.join(q.select(F.col("b").alias("a")), "a", "left_anti")
    total = outside.groupBy("a").agg(F.sum("w").alias("total"))
    best = outside.join(q, "b").groupBy("a").agg(F.min_by(F.struct("b", "w"), F.struct(-F.col("w"), F.col("b"))).alias("x"))
    return total.join(best, "a", "left").select(F.col("a").alias("node"), F.when(F.col("x.w") / F.col("total") >= share, F.col("x.b")).alias("target"))


def fold_to_owners(groups: DataFrame, owners: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(node, target): owners keep themselves, others go to the owner with most distinct neighbours in common edges (the smaller of equal ones), or nowhere (null). Without owners the largest groups own. groups: node, size; owners: node; edges: src, dst."""
    if not owners.head(1):
        owners = top_k(groups, [F.desc("size"), F.col("node")], least).select("node")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    o = owners.select(F.col("node").alias("b"))
    best = best_by(both.join(o, "b").join(o.select(F.col("b").alias("a")), "a", "left_anti").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a"], "b", F.col("n"), -F.col("b"))
    rest = groups.join(owners, "node", "left_anti").join(best, F.col("node") == F.col("a"), "left").select("node", F.col("b").alias("target"))
    return owners.select("node", F.col("node").alias("target")).unionByName(rest)


def project_view(nodes: DataFrame, edges: DataFrame, most_nodes: int = 20, most_edges: int = 30) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, score) of greatest score and the heaviest edges between them; nodes on none of these edges go unless one alone is left."""
    kept = top_k(nodes, [F.desc("score"), F.col("node")], most_nodes)
    heavy = top_k(graph.without_dangling(edges, kept), [F.desc("weight"), F.col("src"), F.col("dst")], most_edges)
    if kept.limit(2).count() > 1:
        kept = kept.join(graph.nodes(heavy), "node", "left_semi")
    return kept, heavy


def bypass(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Distinct (src, dst) between the nodes that stay: their edges, and an edge wherever a path leads through removed nodes only. No loops."""
    gone = removed.select("node")
    hops = edges.select("src", "dst").distinct()
    start = hops.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    inner = hops.join(gone.select(F.col("node").alias("src")), "src", "left_semi")
    reached = graph._closed(start, inner, ["src"])
    return reached.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").where("src <> dst").select("src", "dst").distinct()


def has_cycle(edges: DataFrame) -> bool:
    """Whether an edge lies on a cycle: what has no edge in or no edge out is peeled off until nothing goes."""
    left = graph.materialize(edges.select("src", "dst").distinct(), "left")
    n = left.count()
    while n:
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = graph.materialize(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi"), "left")
        now = left.count()
        if now == n:
            return True
        n = now
    return False


def exact_partition(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: whether the groups (group, id) hold every id of ids once and no other."""
    per = groups.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(ids.select("id").distinct().withColumn("known", F.lit(True)), "id", "full")
    return per.agg(F.coalesce(F.bool_and(F.coalesce((F.col("n") == 1) & F.col("known"), F.lit(False))), F.lit(True)).alias("exact"))


def submodel(edges: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, role): the chosen nodes and their neighbours; and the edges with a chosen end."""
    a, b = chosen.select(F.col("node").alias("src")), chosen.select(F.col("node").alias("dst"))
    touched = edges.join(a, "src", "left_semi").unionByName(edges.join(a, "src", "left_anti").join(b, "dst", "left_semi").select(edges.columns))
    around = graph.nodes(touched).join(chosen, "node", "left_anti")
    return chosen.select("node", F.lit("chosen").alias("role")).unionByName(around.select("node", F.lit("neighbour").alias("role"))), touched


def drop_shadowed(df: DataFrame, group: str, label: str, rules: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Distinct (group, label) without labels that a more concrete one of the group stands for. rules: a label, and those that replace it."""
    rows = df.select(group, label).distinct()
    has = rows.groupBy(F.col(group).alias("__g")).agg(F.collect_set(label).alias("__all"))
    shadow = F.lit(False)
    for weak, strong in rules:
        shadow = shadow | ((F.col(label) == weak) & F.arrays_overlap("__all", F.array(*[F.lit(x) for x in strong])))
    return rows.join(has, F.col(group) == F.col("__g")).where(~shadow).select(group, label)


def external_counts(imports: DataFrame, internal: DataFrame) -> DataFrame:
    """(module, internal, external): distinct imports that are modules themselves, and the others. imports: module, dep; internal: dep."""
    marked = imports.select("module", "dep").distinct().join(internal.select("dep").distinct().withColumn("__in", F.lit(1)), "dep", "left")
    return marked.groupBy("module").agg(F.count("__in").alias("internal"), F.greatest(F.lit(0), F.count(F.lit(1)) - F.count("__in")).alias("external"))


def capped_edges(edges: DataFrame, per_node: int = 3) -> DataFrame:
    """The heaviest edges, per_node times as many as there are nodes."""
    return top_k(edges, [F.desc("weight"), F.col("src"), F.col("dst")], per_node * graph.nodes(edges).count())


def packages(members: DataFrame, edges: DataFrame, libraries: DataFrame, most: int = 12, most_libraries: int = 6, most_edges: int = 20) -> DataFrame:
    """(kind, src, dst, weight): edges between the largest packages, heaviest first, then of these to the libraries that most packages use, most_edges in all. members: node, size; edges: src, dst, weight; libraries: src, dst (the library), weight."""
    kept = top_k(members, [F.desc("size"), F.col("node")], most).select("node")
    inner = graph.without_dangling(edges, kept).select(F.lit("internal").alias("kind"), "src", F.col("dst").cast("string").alias("dst"), "weight")
    mine = libraries.join(kept.select(F.col("node").alias("src")), "src", "left_semi")
    used = top_k(mine.groupBy("dst").agg(F.countDistinct("src").alias("n")), [F.desc("n"), F.col("dst")], most_libraries).select("dst")
    outer = mine.join(used, "dst", "left_semi").select(F.lit("external").alias("kind"), "src", F.col("dst").cast("string").alias("dst"), "weight")
    return top_k(inner.unionByName(outer), [(F.col("kind") == "external").cast("int"), F.desc("weight"), F.col("src"), F.col("dst")], most_edges)


def scan_catalog(imports: DataFrame, dependencies: DataFrame, catalog: DataFrame) -> DataFrame:
    """(label, rank): labels of the catalog whose token an import equals or extends, by the first such token; then those that a dependency's fragment tells and no import did. imports, dependencies: name; catalog (broadcast: a fixed list): rank, token, fragment, label."""
    c = F.broadcast(catalog)
    by_import = imports.select(F.lower("name").alias("name")).distinct().join(c, token_match(F.col("name"), F.col("token"))).groupBy("label").agg(F.min("rank").alias("rank"))
    by_fragment = dependencies.select(F.lower("name").alias("name")).distinct().join(c, fragment_match(F.col("name"), F.col("fragment"))).groupBy("label").agg(F.min("rank").alias("rank"))
    return by_import.unionByName(by_fragment.join(by_import, "label", "left_anti"))


def role_rollup(nodes: DataFrame, edges: DataFrame, shared: str) -> DataFrame:
    """(src, dst, weight) between roles, without the shared one: edges between nodes of different roles. nodes: node, role."""
    return graph.roll_up(edges, nodes.where(F.col("role") != shared).select("node", F.col("role").alias("group")))
