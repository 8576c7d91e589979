"""Graph operators over edge lists (src, dst[, weight]).

Loops are semi-naive: a round joins only what the last one added, its result is written to the shared folder, and the
loop ends when nothing is new. The closure of a graph is as large as its answer; use reach for given roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialize


def roll_up(edges: DataFrame, member: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between members -> weighted edges (src, dst, weight) between their groups, none inside a group. member: (node, group)."""
    a = member.select(F.col("node").alias(src), F.col("group").alias("__s"))
    b = member.select(F.col("node").alias(dst), F.col("group").alias("__d"))
    w = F.sum("weight") if "weight" in edges.columns else F.count(F.lit(1))
    return edges.join(a, src).join(b, dst).where("__s <> __d").groupBy(F.col("__s").alias("src"), F.col("__d").alias("dst")).agg(w.alias("weight"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def fan(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): sums of weights, 0 for none."""
    sides = edges.select(F.col("dst").alias("node"), F.col("weight").alias("i"), F.lit(0).cast("long").alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("i"), F.col("weight").alias("o")))
    summed = sides.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return all_nodes.select("node").join(summed, "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def _closed(start: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """All (key..., dst) reachable from start by appending edges."""
    hop = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    known = new = materialize(start.distinct(), "reached")
    while new.head(1):
        step = new.join(hop, F.col("dst") == F.col("__s")).select(*key, F.col("__d").alias("dst")).distinct()
        new = materialize(step.join(known, [*key, "dst"], "left_anti"), "reached")
        known = known.unionByName(new)
    return known


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of at least one edge."""
    return _closed(edges.select("src", "dst"), edges, ["src"])


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the roots and all that they reach."""
    found = _closed(roots.select(F.col("node").alias("dst")), edges, [])
    return found.select(F.col("dst").alias("node")).distinct()


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges that no longer path replaces, judged on all edges; on cycles this may leave nothing."""
    pairs = edges.select("src", "dst").distinct()
    hop = pairs.select(F.col("src").alias("__s"), F.col("dst").alias("__w"))
    # Paths that start with another edge than the direct one, and never return to their first node to use it.
    start = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).join(hop, F.col("u") == F.col("__s")).where("__w <> v").select("u", "v", F.col("__w").alias("dst"))
    steps = pairs.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    known = new = materialize(start.distinct(), "detours")
    while new.head(1):
        step = new.where("dst <> v").join(steps, F.col("dst") == F.col("__s")).where("NOT (__s = u AND __d = v)").select("u", "v", F.col("__d").alias("dst")).distinct()
        new = materialize(step.join(known, ["u", "v", "dst"], "left_anti"), "detours")
        known = known.unionByName(new)
    gone = known.where("dst = v").select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    return edges.join(gone, ["src", "dst"], "left_anti")


def reduced_or_all(edges: DataFrame) -> DataFrame:
    """The transitive reduction, or all edges where it leaves none."""
    found = materialize(transitive_reduction(edges), "reduced")
    return found if found.head(1) else edges


def strong_components(edges: DataFrame) -> DataFrame:
    """(root, member) of strongly connected components of more than one node; the root is the least member."""
    pairs = closure(edges)
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    mutual = pairs.join(back, ["src", "dst"]).where("src <> dst")
    return mutual.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("root")).select("root", F.col("src").alias("member"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by propagating labels until none changes."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = materialize(both, "both")
    labels = materialize(nodes(edges).withColumn("label", F.col("node")), "labels")
    while True:
        heard = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("heard"))
        mine = labels.join(heard, F.col("node") == F.col("src"), "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("near"))
        # Jump to the label's own label, which halves the distance to the least node.
        up = mine.select(F.col("node").alias("__n"), F.col("near").alias("__up"))
        new = materialize(mine.join(up, F.col("near") == F.col("__n"), "left").select("node", F.least("near", F.coalesce("__up", "near")).alias("label")), "labels")
        if not new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").head(1):
            return new
        labels = new


def collapse_directions(edges: DataFrame, order: list[Column]) -> DataFrame:
    """Of the two directions between a pair of nodes, the first by order."""
    pair = edges.withColumn("__a", F.least("src", "dst")).withColumn("__b", F.greatest("src", "dst"))
    from .rank import first_seen

    return first_seen(pair, ["__a", "__b"], order).drop("__a", "__b")


def page_rank(edges: DataFrame, iterations: int | None = None, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, rank): weighted PageRank with uniform treatment of nodes without outgoing edges; a fixed number of iterations, or until the change is below nodes * tolerance."""
    all_nodes = materialize(nodes(edges), "nodes")
    n = all_nodes.count()
    if not n:
        return all_nodes.withColumn("rank", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("__out"))
    share = materialize(edges.join(out, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("__out")).alias("share")), "shares")
    ranks = materialize(all_nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("has_out")), "node", "left").select("node", F.coalesce("has_out", F.lit(False)).alias("has_out"), F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(iterations or most):
        loose = ranks.where("NOT has_out").agg(F.sum("rank")).first()[0] or 0.0
        got = share.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = materialize(ranks.select("node", "has_out", F.col("rank").alias("old")).join(got, F.col("node") == F.col("to"), "left").select("node", "has_out", (F.lit((1 - alpha + alpha * loose) / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), "old"), "ranks")
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if iterations is None and change < n * tolerance:
            break
    return ranks.select("node", "rank")


def orphans(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on no edge."""
    return all_nodes.join(nodes(edges), "node", "left_anti")


def without_dangling(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges whose ends are both declared."""
    a, b = declared.select(F.col("node").alias("src")), declared.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
