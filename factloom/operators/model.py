"""Container models as two tables, nodes and edges, and the passes that rewrite them.

nodes: id, label, kind, tech, description, grp, path, layer, role, ord. edges: src, dst, label, ord, spine. ord is the
order of declaration, which decides ties; spine marks edges of the request path that no pass thins out. A model is as
small as the architecture that it shows: passes are set-based, the few single nodes that they hinge on (entry, gateway,
primary service) are fetched as values, and hld writes the tables between passes so that plans stay short.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, path_domain, safe_label, slug_ascii, slug_word
from ..plans.store import materialize
from . import graph
from .joins import patch
from .rank import first_seen, top_k

#: Kinds of nodes; the kinds that are containers; stores.
KINDS = ("person", "web_app", "service", "worker", "datastore", "cache", "queue", "external")
CONTAINERS = ("web_app", "service", "worker")
STORES = ("datastore", "cache", "queue")
#: Patterns of names of gateways, user interfaces and entry points; words that mark an entry, best first.
GATEWAY = r"(api[-_]?gateway|gateway|bff|edge[-_]?proxy|ingress)"
PRESENTATION = r"(frontend|web[-_]?app|web[-_]?ui|webui|\bui\b|spa|portal|dashboard)"
ENTRYPOINT = r"(frontend|api[-_]?gateway|gateway|bff|web[-_]?app|web[-_]?ui|spa|edge[-_]?proxy)"
WORKER = r"(load[-_]?gen|benchmark|stress[-_]?test|[-_]worker|worker[-_]|consumer|scheduler|cron|batch|sidekiq|celery)"
ENTRY_WORDS = ("frontend", "api-gateway", "apigateway", "gateway", "bff", "web-app", "webapp", "web-ui", "webui", "spa", "edge")
#: Names of load generators, observability and registry containers.
OPERATIONAL = (
    r"load[-_ ]?gen|loadtest|benchmark|stress|locust\b|^k6$|gatling|jmeter"
    r"|prometheus|grafana|jaeger|zipkin|opentelemetry|otel[-_ ]?collector"
    r"|fluentd|fluent[-_ ]?bit|kibana|metrics?[-_ ]?(collector|exporter)|telemetry"
    r"|eureka|consul|zookeeper|config[-_ ]?server"
)
LAYER_ORDER = ("presentation", "gateway", "application", "worker", "data", "messaging", "external")
#: Containers beyond which groups are folded, and that must stay at least.
MOST_SHOWN, LEAST_SHOWN = 12, 3
NODE_SCHEMA = "id string, label string, kind string, tech string, description string, grp string, path string, layer string, role string, ord long"
EDGE_SCHEMA = "src string, dst string, label string, ord long, spine boolean"


@dataclass(frozen=True)
class Model:
    nodes: DataFrame
    edges: DataFrame

    def containers(self) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*CONTAINERS))

    def stores(self) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(*STORES))

    def written(self) -> Model:
        """The model from written tables: cuts the plan."""
        return Model(materialize(self.nodes, "nodes"), materialize(self.edges, "edges"))

    def adding(self, new: list[tuple[str, str, str]] | DataFrame, spine: bool = False) -> Model:
        """The model with edges (src, dst, label) after the others."""
        spark = self.nodes.sparkSession
        if isinstance(new, list):
            new = spark.createDataFrame([(*e, i) for i, e in enumerate(new)], "src string, dst string, label string, ord long")
        last = self.edges.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
        numbered = new.select("src", "dst", "label", (F.col("ord") + last + 1).alias("ord"), F.lit(spine).alias("spine"))
        return replace(self, edges=self.edges.unionByName(numbered))


def _kept(model: Model, nodes: DataFrame) -> Model:
    """The model with these nodes only, and the edges between them."""
    return Model(nodes, graph.without_dangling(model.edges, nodes.select(F.col("id").alias("node"))))


def _name() -> Column:
    return F.lower(F.concat_ws(" ", "id", "label"))


def layer_of() -> Column:
    """The layer of a node by its kind, and of services by their name; null for people and externals."""
    service = F.when(_name().rlike(GATEWAY), "gateway").when(_name().rlike(PRESENTATION), "presentation").otherwise("application")
    return F.when(F.col("kind").isin("datastore", "cache"), "data").when(F.col("kind") == "queue", "messaging").when(F.col("kind") == "worker", "worker").when(F.col("kind") == "web_app", "presentation").when(F.col("kind") == "service", service)


def entry_score() -> Column:
    """How well a container serves as the entry, 0 best; null for those that can't."""
    text = F.lower(F.concat_ws(" ", "label", "id"))
    by_word = F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(i)) for i, w in enumerate(ENTRY_WORDS)])
    can = text.rlike(ENTRYPOINT) | (F.col("kind") == "web_app")
    return F.when(can, F.coalesce(by_word, F.when(F.col("kind") == "web_app", 20), F.lit(15)))


def _one(df: DataFrame, *order: Column) -> str | None:
    found = df.orderBy(*order).select("id").first()
    return found[0] if found else None


def entry(model: Model) -> str | None:
    """The id of the container that users meet, if one serves."""
    return _one(model.containers().withColumn("s", entry_score()).where("s IS NOT NULL"), F.col("s"), F.col("ord"))


def gateway(model: Model) -> str | None:
    return _one(model.containers().where(layer_of() == "gateway"), F.col("ord"))


def primary(model: Model) -> str | None:
    """The service that the data hangs off: an application that uses a store, else an application, else another container than the entry; of several the one of most outgoing edges, then of the largest id."""
    actors = model.nodes.where("kind = 'person'").select(F.col("id").alias("src"))
    inner = model.edges.join(actors, "src", "left_anti")
    out = inner.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    users = inner.join(model.stores().select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(True).alias("owns")).distinct()
    app = layer_of() == "application"
    ranked = model.containers().join(out, "id", "left").join(users, "id", "left")
    choice = F.when(app & F.col("owns"), 0).when(app, 1).when(F.col("id") != F.lit(entry(model) or ""), 2).otherwise(3)
    return _one(ranked, choice, F.desc(F.coalesce("out", F.lit(0))), F.desc("id"))


def enforce_kinds(model: Model) -> Model:
    """Drop nodes of other kinds and the edges that touch them; edges to undeclared ids stay."""
    gone = model.nodes.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).select(F.col("id").alias("gone"))
    e = model.edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    return Model(model.nodes.where(F.col("kind").isin(*KINDS)), e)


def ground(candidate: Model, other: Model) -> Model:
    """Nodes of other that the candidate has too, edges between them; other as it is if the candidate is empty."""
    ids = candidate.nodes.select("id")
    if not ids.head(1):
        return other
    return _kept(other, other.nodes.join(ids, "id", "left_semi"))


def enrich(model: Model, nodes: DataFrame, edges: DataFrame) -> Model:
    """Patch labels, descriptions and groups by id, and edge labels by src__dst. Blank labels and groups are ignored."""
    keyed = model.edges.withColumn("key", F.concat_ws("__", "src", "dst"))
    return Model(patch(model.nodes, "id", nodes, ["label", "grp"], ["description"]), patch(keyed, "key", edges, [], ["label"]).drop("key"))


def strip_technologies(model: Model, deny: list[str]) -> Model:
    """Externals whose normalised label, or a word of it, is denied become part of the tech of the containers they touch."""
    words = F.split(F.lower("label"), "[^a-z0-9]+")
    denied = F.array(*[F.lit(x) for x in deny])
    is_tech = (F.col("kind") == "external") & (F.array_contains(denied, F.regexp_replace(F.lower("label"), "[^a-z0-9]", "")) | F.arrays_overlap(words, denied))
    gone = model.nodes.where(is_tech).select(F.col("id").alias("gone"), F.col("label").alias("name"))
    ends = model.edges.select(F.col("src").alias("id"), F.col("dst").alias("gone")).unionByName(model.edges.select(F.col("dst").alias("id"), F.col("src").alias("gone")))
    tech = ends.join(gone, "gone").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rest = model.nodes.where(~is_tech).join(tech, "id", "left")
    known = F.filter(F.split(F.coalesce("tech", F.lit("")), r",\s*"), lambda x: x != "")
    merged = F.when(F.col("names").isNull() | ~F.col("kind").isin(*CONTAINERS), F.col("tech")).otherwise(F.array_join(F.array_distinct(F.concat(known, "names")), ", "))
    return _kept(model, rest.withColumn("tech", merged).select(model.nodes.columns))


def assign_layers(model: Model) -> Model:
    """The layer of every container and store."""
    return replace(model, nodes=model.nodes.withColumn("layer", layer_of()))


def assign_roles(model: Model) -> Model:
    """role: entrypoint for the entry, else the layer."""
    role = F.when(F.col("id") == F.lit(entry(model) or ""), "entrypoint").otherwise(F.coalesce("layer", layer_of()))
    return replace(model, nodes=model.nodes.withColumn("role", F.when(F.col("kind").isin(*CONTAINERS), role)))


def drop_noise(model: Model) -> Model:
    """Of more than three containers, drop operational ones by label or id, unless fewer than two would stay."""
    noise = F.col("label").rlike(f"(?i){OPERATIONAL}") | F.col("id").rlike(f"(?i){OPERATIONAL}")
    n = model.containers().agg(F.count(F.lit(1)).alias("n"), F.count_if(~noise).alias("kept")).first()
    if n["n"] <= 3 or n["kept"] < 2:
        return model
    gone = model.containers().where(noise).select(F.col("id").alias("gone"))
    e = model.edges.join(gone, F.col("src") == F.col("gone"), "left_anti").join(gone, F.col("dst") == F.col("gone"), "left_anti")
    return Model(model.nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), e)


def infer_entry(model: Model) -> Model:
    """A user, if nobody is declared and a container serves as entry, or in the place of a lone operator; wired to the entry, else to the first container, if no edge leaves them."""
    if not model.containers().head(1):
        return model
    target = entry(model)
    people = [r[0] for r in model.nodes.where("kind = 'person'").orderBy("ord").select("id").limit(2).collect()]
    if target and not people:
        last = model.nodes.agg(F.max("ord")).first()[0]
        user = model.nodes.sparkSession.createDataFrame([("user", "User", "person", None, "Client caller", None, None, None, None, last + 1)], NODE_SCHEMA)
        model, people = replace(model, nodes=model.nodes.unionByName(user)), ["user"]
    elif target and people == ["operator"]:
        named = lambda c: F.when(F.col(c) == "operator", "user").otherwise(F.col(c)).alias(c)
        label = F.when(F.col("id") == "operator", "User").otherwise(F.col("label"))
        nodes = model.nodes.withColumn("label", label).withColumn("id", named("id"))
        model, people = Model(nodes, model.edges.withColumn("src", named("src"))), ["user"]
    if people and not model.edges.where(F.col("src") == people[0]).head(1):
        return model.adding([(people[0], target or _one(model.containers(), F.col("ord")), "uses")])
    return model


def backbone(model: Model) -> Model:
    """The front door routes to the gateway, and containers on no edge hang on the front door, gateway or actor by their layer; then the budget."""
    layered = model.containers().withColumn("layer", layer_of())
    if layered.count() < 2:
        return model
    first = lambda layer: _one(layered.where(F.col("layer") == layer), F.col("ord"))
    door, way, app = entry(model), first("gateway"), first("application")
    if not (door and layered.where((F.col("id") == door) & F.col("layer").isin("presentation", "gateway")).head(1)):
        door = first("presentation")
    hub = way or door
    if hub is None:
        out = model.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        pool = layered.where("layer = 'application'") if app else layered
        hub = _one(pool.join(out, "id", "left"), F.desc(F.coalesce("n", F.lit(0))), F.col("id"))
    actor = _one(model.nodes.where("kind = 'person'"), F.col("id"))
    if door and way and door != way and not model.edges.where((F.col("src") == door) & (F.col("dst") == way)).head(1):
        model = model.adding([(door, way, "routes to")])
    lone = graph.orphans(layered.select(F.col("id").alias("node"), "layer", "ord"), model.edges).where(~F.col("node").isin(*[x for x in (door, way) if x] or [""]))
    choice = {"application": (hub, "calls"), "gateway": (door, "routes to"), "presentation": (actor, "uses") if actor else (hub, "serves"), "worker": (hub or app, "triggers")}
    at = lambda i: F.coalesce(*[F.when(F.col("layer") == k, F.lit(v[i])) for k, v in choice.items()])
    new = lone.select(at(0).alias("src"), F.col("node").alias("dst"), at(1).alias("label"), "ord").where("src IS NOT NULL AND src <> dst")
    return hard_budget(model.adding(new))


def spine(model: Model) -> Model:
    """The path actor, entry, gateway, primary service is completed by the links it lacks in both directions; it and the primary's edges to stores (or all edges to stores from the primary's place) are marked."""
    door, way, main = entry(model), gateway(model), primary(model)
    if main is None:
        return model
    actor = _one(model.nodes.where("kind = 'person'"), F.col("ord"))
    chain = [x for x in dict.fromkeys((door, way if way != door else None, main)) if x]
    links = [(a, b, "routes to" if b == way else "calls") for a, b in zip(chain, chain[1:]) if a != b]
    marked = [x[:2] for x in links]
    if actor and door:
        marked.append((actor, door))
        if not model.edges.join(model.nodes.where("kind = 'person'").select(F.col("id").alias("src")), "src", "left_semi").where(F.col("dst") == door).head(1):
            links.insert(0, (actor, door, "uses"))
    have = {(r[0], r[1]) for a, b, _ in links for r in model.edges.where(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))).select("src", "dst").limit(2).collect()}
    model = model.adding([x for x in links if x[:2] not in have and (x[1], x[0]) not in have])
    pairs = F.array(*[F.concat_ws("\t", F.lit(a), F.lit(b)) for a, b in marked] or [F.lit("")])
    stores = model.stores().select(F.col("id").alias("s_id"), F.lit(True).alias("s"))
    flagged = model.edges.join(stores, F.col("dst") == F.col("s_id"), "left")
    on = F.col("spine") | F.array_contains(pairs, F.concat_ws("\t", "src", "dst")) | ((F.col("src") == main) & F.coalesce("s", F.lit(False)))
    return replace(model, edges=flagged.withColumn("spine", on).select(model.edges.columns))


def _pairs_between(model: Model) -> tuple[DataFrame, DataFrame]:
    """(edges between containers, other edges)."""
    inner = model.containers().select(F.col("id").alias("node"))
    between = graph.without_dangling(model.edges, inner)
    return between, model.edges.join(between.select("ord"), "ord", "left_anti")


def reduce_edges(model: Model) -> Model:
    """Between containers: one edge per pair, the first declared of both directions, and none that a longer path replaces unless it is of the spine or the only edge of an end."""
    between, other = _pairs_between(model)
    one = graph.collapse_directions(between, [F.col("ord")])
    kept = graph.transitive_reduction(one).select("ord")
    ends = one.select(F.col("src").alias("node")).unionByName(one.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    degree = lambda c: ends.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    spared = one.join(degree("src"), "src").join(degree("dst"), "dst").where("spine OR n_src < 2 OR n_dst < 2").select("ord")
    stays = kept.unionByName(spared).distinct()
    return replace(model, edges=one.join(stays, "ord", "left_semi").select(model.edges.columns).unionByName(other))


def curate_edges(model: Model, cap: int = 4) -> Model:
    """Sources of more than cap edges to containers lose the edges that aren't needed to reach their target from the entry and the containers that people use: those to targets of most edges first, across groups before inside one, then by target. Each choice depends on those before it, so the edges of the model are handled together in one task."""
    between, other = _pairs_between(model)
    group = model.containers().select("id", F.coalesce("grp", F.lit("")).alias("g"))
    people = model.nodes.where("kind = 'person'").select(F.col("id").alias("src"))
    roots = model.edges.join(people, "src", "left_semi").select(F.col("dst").alias("id")).join(group.select("id"), "id", "left_semi")
    first = entry(model)
    if first:
        roots = roots.unionByName(model.nodes.where(F.col("id") == first).select("id"))
    sources = [r[0] for r in roots.distinct().limit(1000).collect()]
    rows = between.join(group.select(F.col("id").alias("src"), F.col("g").alias("gs")), "src").join(group.select(F.col("id").alias("dst"), F.col("g").alias("gd")), "dst")

    def curated(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        degree = pd.concat([pdf["src"], pdf["dst"]]).value_counts()
        alive = {r.ord: r for r in pdf.itertuples()}
        begin = set(sources) or set(pdf["src"])

        def needed(edge) -> bool:
            near: dict[str, set] = {}
            for r in alive.values():
                if r.ord != edge.ord:
                    near.setdefault(r.src, set()).add(r.dst)
            known = set(begin)
            fresh = known
            while fresh:
                fresh = set().union(*(near.get(x, ()) for x in fresh)) - known
                known = known | fresh
            return edge.dst not in known

        for src in sorted(set(pdf["src"])):
            fan = [r for r in alive.values() if r.src == src]
            spare = len(fan) - cap
            for r in sorted(fan, key=lambda r: (-degree[r.dst], r.gs == r.gd, r.dst)):
                if spare > 0 and not r.spine and not needed(r):
                    del alive[r.ord]
                    spare -= 1
        return pd.DataFrame({"ord": sorted(alive)}, dtype="int64")

    stays = rows.groupBy().applyInPandas(curated, "ord long")
    return replace(model, edges=between.join(stays, "ord", "left_semi").select(model.edges.columns).unionByName(other))


def connect(model: Model) -> Model:
    """No part floats: containers on no edge are called by the primary service (the primary by the entry), lone stores are used by it, what the entry doesn't reach is called too, and people reach a store."""
    first = _one(model.containers(), F.col("ord"))
    if first is None:
        return model
    door = entry(model) or first
    main = primary(model) or door

    def link(m: Model, targets: DataFrame, src: str, label: Column | str) -> Model:
        """Edges from src to targets (id, ord) that have none in either direction."""
        have = m.edges.where(F.col("src") == src).select(F.col("dst").alias("id")).unionByName(m.edges.where(F.col("dst") == src).select(F.col("src").alias("id")))
        new = targets.where(F.col("id") != src).join(have, "id", "left_anti").select(F.lit(src).alias("src"), F.col("id").alias("dst"), (F.lit(label) if isinstance(label, str) else label).alias("label"), "ord")
        return m.adding(new).written()

    def lone(df: DataFrame) -> DataFrame:
        return graph.orphans(df.withColumn("node", F.col("id")), model.edges)

    free = lone(model.containers()).orderBy("ord").select("id", "ord")
    head = free.first()
    if head is not None:
        free = materialize(free, "free")
        if head["id"] == main:
            model = link(model, free.where(F.col("id") == main), door, "calls")
        model = link(model, free.where(F.col("id") != main), main, "calls")
    verb = F.when(F.col("kind") == "queue", "publishes/consumes").otherwise("reads/writes")
    model = link(model, lone(model.stores()), main, verb)
    start = lambda ids: model.nodes.sparkSession.createDataFrame([(x,) for x in ids], "node string")
    reached = materialize(graph.reach(model.edges, start([door])), "reached")
    far = model.containers().join(reached, F.col("id") == F.col("node"), "left_anti")
    model = link(model, far, main if reached.where(F.col("node") == main).head(1) else door, "calls")
    people = [r[0] for r in model.nodes.where("kind = 'person'").select("id").limit(1000).collect()]
    store = _one(model.stores(), F.col("id"))
    if people and store and not graph.reach(model.edges, start(people)).join(model.stores(), F.col("node") == F.col("id"), "left_semi").head(1):
        model = link(model, model.stores().where(F.col("id") == store), main, "reads/writes")
    return model


def _title(c: Column | str) -> Column:
    return F.initcap(F.regexp_replace(c, "[-_]", " "))


def assign_domains(model: Model) -> Model:
    """Containers keep given groups; the others are grouped by the folder above them if that makes two groups and one of several members, else by the first part of their id if that makes two to six, else by layer. With fewer than two groups all are cleared. Stores take the one group of the containers on their edges, or Shared Data."""
    blank = F.coalesce(F.trim("grp"), F.lit("")) == ""
    folder = _title(F.coalesce(path_domain(F.col("path")), F.col("id")))
    prefix = F.regexp_extract(F.regexp_replace("id", "-", "_"), "^([^_]*)", 1)
    c = model.containers().withColumn("__blank", blank).withColumn("__folder", F.when(F.col("__blank"), folder)).withColumn("__prefix", prefix)
    n = c.agg(F.countDistinct("__folder").alias("folders"), F.count("__folder").alias("open"), F.countDistinct("__prefix").alias("prefixes")).first()
    if n["open"]:
        by = F.col("__folder") if n["folders"] >= 2 and n["open"] > n["folders"] else _title("__prefix") if 2 <= n["prefixes"] <= 6 else _title(layer_of())
        c = c.withColumn("grp", F.when(F.col("__blank"), by).otherwise(F.col("grp")))
        if c.select("grp").distinct().limit(2).count() < 2:
            c = c.withColumn("grp", F.lit(None).cast("string"))
    c = c.select(model.nodes.columns)
    ends = model.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(model.edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    peers = ends.join(c.select(F.col("id").alias("b"), F.col("grp").alias("g")), "b").where("g <> ''").groupBy("a").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    rest = model.nodes.where(~F.col("kind").isin(*CONTAINERS)).join(peers, F.col("id") == F.col("a"), "left")
    theirs = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), F.lit("Shared Data"))
    rest = rest.withColumn("grp", F.when(F.col("kind").isin(*STORES) & blank, theirs).otherwise(F.col("grp"))).select(model.nodes.columns)
    return replace(model, nodes=c.unionByName(rest))


def consolidate(model: Model) -> Model:
    """Of more than MOST_SHOWN containers, the members of each group of several (but the entry and gateways) become one node, if that leaves LEAST_SHOWN containers and two groups at least; edges move along."""
    c = model.containers()
    if c.count() <= MOST_SHOWN:
        return model
    shielded = (F.col("id") == F.lit(entry(model) or "")) | (F.coalesce("layer", layer_of()) == "gateway")
    open_group = F.when(~shielded & (F.coalesce(F.trim("grp"), F.lit("")) != ""), F.trim("grp"))
    w = Window.partitionBy("__g")
    c = c.withColumn("__g", open_group).withColumn("__n", F.when(F.col("__g").isNotNull(), F.count(F.lit(1)).over(w)))
    folds = F.coalesce(F.col("__n") >= 2, F.lit(False))
    n = c.agg(F.count(F.lit(1)).alias("all"), F.count_if(~folds).alias("alone"), F.countDistinct(F.when(folds, F.col("__g"))).alias("groups"), F.countDistinct(F.when(~folds, F.coalesce("grp", "id"))).alias("others")).first()
    shown = n["alone"] + n["groups"]
    if not n["groups"] or shown >= n["all"] or shown < LEAST_SHOWN or n["groups"] + n["others"] < 2:
        return model
    members, alone = c.where(folds), c.where(~folds).select(model.nodes.columns)
    kind = F.coalesce(*[F.max(F.when(F.col("kind") == k, k)) for k in ("service", "web_app", "worker")])
    by = F.struct("ord", "id")
    listed = lambda col: F.transform(F.array_sort(F.collect_list(F.struct("ord", col))), lambda x: x[col])
    techs = F.array_distinct(F.filter(F.transform(F.split(F.array_join(listed("tech"), ","), ","), lambda x: F.trim(x)), lambda x: x != ""))
    label = F.coalesce("label", "id").alias("label")
    made = members.select("__g", "kind", "tech", "ord", "id", label).groupBy("__g").agg(kind.alias("kind"), techs.alias("techs"), listed("label").alias("labels"), F.count(F.lit(1)).alias("n"), F.max(by)["ord"].alias("ord"))
    numbers = made.select("__g", slug_ascii(F.col("__g")).alias("base"), F.explode(F.sequence(F.lit(1), F.lit(n["alone"] + 1))).alias("k")).withColumn("rep", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "k")))
    free = numbers.join(alone.select(F.col("id").alias("rep")), "rep", "left_anti").groupBy("__g").agg(F.min_by("rep", "k").alias("rep"))
    text = F.concat(F.col("n").cast("string"), F.lit(" modules: "), F.array_join(F.slice("labels", 1, 5), ", "), F.when(F.col("n") > 5, "…").otherwise(""))
    none = F.lit(None).cast("string")
    reps = made.join(free, "__g").select(F.col("rep").alias("id"), F.col("__g").alias("label"), "kind", F.array_join(F.slice("techs", 1, 4), ", ").alias("tech"), text.alias("description"), F.col("__g").alias("grp"), none.alias("path"), none.alias("layer"), none.alias("role"), "ord").withColumn("layer", layer_of())
    moved = members.select("id", "__g").join(free, "__g").select(F.col("id").alias("old"), "rep")
    edges = model.edges
    for end in ("src", "dst"):
        edges = edges.join(moved, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("rep", end)).drop("old", "rep")
    edges = edges.where("src <> dst").withColumn("spine", F.max("spine").over(Window.partitionBy("src", "dst")))
    others = model.nodes.where(~F.col("kind").isin(*CONTAINERS))
    return Model(alone.unionByName(reps).unionByName(others), first_seen(edges, ["src", "dst"], [F.col("ord")]).select(model.edges.columns))


def merge(model: Model, nodes: DataFrame) -> Model:
    """Add nodes whose slug is not taken yet."""
    taken = model.nodes.select(slug_word(F.col("id")).alias("slug"))
    return replace(model, nodes=model.nodes.unionByName(nodes.withColumn("slug", slug_word(F.col("id"))).join(taken, "slug", "left_anti").drop("slug")))


def merge_orchestration(model: Model, services: DataFrame) -> Model:
    """Add a node for each service and workload (see sources.orchestration) whose slug isn't taken: a store by its image, a worker by its kind or name, else a service. Auxiliary services are left out; of equal names the first."""
    from ..sources.orchestration import image_store, service_id

    last = model.nodes.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    asked = services.where("source IN ('compose', 'workload') AND NOT coalesce(auxiliary, false)").withColumn("id", service_id(F.col("name")))
    first = first_seen(asked, ["id"], [F.col("source"), F.col("file"), F.col("doc"), F.col("name")])
    taken = model.nodes.select(service_id(F.col("id")).alias("id"))
    new = first.join(taken, "id", "left_anti").withColumn("store", image_store(F.col("image")))
    kind = F.coalesce(F.col("store.kind"), F.when(F.col("kind").isin("Job", "CronJob") | F.col("name").rlike(f"(?i){WORKER}"), "worker").otherwise("service"))
    none = F.lit(None).cast("string")
    number = F.row_number().over(Window.orderBy("source", "file", "doc", "name")) + last
    rows = new.select("id", F.coalesce("store.label", "name").alias("label"), kind.alias("kind"), none.alias("tech"), none.alias("description"), none.alias("grp"), F.col("build_dir").alias("path"), none.alias("layer"), none.alias("role"), number.cast("long").alias("ord"))
    return replace(model, nodes=model.nodes.unionByName(rows))


def communicate(model: Model, services: DataFrame, owned: DataFrame | None = None) -> Model:
    """Edges from what services ask of each other, between known nodes: hosts in the environment of workloads (containers and stores), then dependencies of compose services, then owned (src, dst, label) ties to infrastructure, then from each web application to the gateway, else to the primary service. Of equal pairs the first; then the budget."""
    from ..sources.orchestration import service_id

    known = model.nodes.select(F.col("id").alias("dst"), "kind")
    asked = services.where("NOT coalesce(auxiliary, false)").select("source", service_id(F.col("name")).alias("src"), F.posexplode("refs").alias("at", "ref")).withColumn("dst", service_id(F.col("ref"))).join(known, "dst")
    store, inner = F.col("kind").isin(*STORES), F.col("kind").isin(*CONTAINERS)
    label = F.when(store, "reads/writes").otherwise("calls")
    by_host = asked.where((F.col("source") == "workload") & (store | inner)).select(F.lit(1).alias("way"), "src", "dst", label.alias("label"), "at")
    by_need = asked.where("source = 'compose'").select(F.lit(2).alias("way"), "src", "dst", label.alias("label"), "at")
    new = by_host.unionByName(by_need)
    if owned is not None:
        new = new.unionByName(owned.select(F.lit(3).alias("way"), "src", "dst", "label", F.lit(0).alias("at")))
    front = gateway(model) or primary(model)
    if front:
        new = new.unionByName(model.nodes.where("kind = 'web_app'").select(F.lit(4).alias("way"), F.col("id").alias("src"), F.lit(front).alias("dst"), F.lit("calls API").alias("label"), F.lit(0).alias("at")))
    valid = graph.without_dangling(new.where("src <> dst"), model.nodes.select(F.col("id").alias("node")))
    fresh = first_seen(valid, ["src", "dst"], [F.col("way"), F.col("at"), F.col("label")]).join(model.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return hard_budget(model.adding(fresh.withColumn("ord", F.row_number().over(Window.orderBy("way", "src", "at", "dst")).cast("long"))).written())


def hard_budget(model: Model, containers: int = 64, total: int = 96) -> Model:
    """The containers of most edges, all stores and people, then externals by edges, up to the caps; distinct edges between them without loops, the first declared of equal ones."""
    ends = model.edges.select(F.col("src").alias("id")).unionByName(model.edges.select(F.col("dst").alias("id")))
    ranked = model.nodes.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inner = F.col("kind").isin(*CONTAINERS)
    by_edges = [F.desc("n"), F.col("ord")]
    shown = top_k(ranked.where(inner), by_edges, containers)
    kept = ranked.where(F.col("kind").isin(*STORES, "person"))
    room = max(0, total - shown.count() - model.stores().count())
    nodes = shown.unionByName(kept).unionByName(top_k(ranked.where(F.col("kind") == "external"), by_edges, room)).select(model.nodes.columns)
    return Model(nodes, first_seen(_kept(model, nodes).edges.where("src <> dst"), ["src", "dst"], [F.col("ord")]))


def validate(model: Model, discovered: int = 0, represented: int = 0) -> DataFrame:
    """One row: counts, the findings as level: message in order, and whether none fails. orphan_count counts externals on no edge only; represented counts the units that folded nodes stand for."""
    touched = graph.nodes(model.edges).select(slug_ascii(F.col("node")).alias("slug")).distinct()
    seen = model.nodes.withColumn("slug", slug_ascii(F.col("id"))).join(touched.withColumn("on_edge", F.lit(True)), "slug", "left")
    store, ext = F.col("kind").isin(*STORES), F.col("kind") == "external"
    counts = seen.agg(
        F.count_if(F.col("kind") == "person").alias("actors"), F.count_if(F.col("kind").isin(*CONTAINERS)).alias("containers"), F.count_if(store).alias("stores"), F.count_if(ext).alias("externals"),
        F.count_if(ext & F.col("on_edge")).alias("connected_externals"), F.count_if(ext & F.col("on_edge").isNull()).alias("orphan_count"), F.count_if(store & F.col("on_edge").isNull()).alias("orphan_stores"),
    )
    one = counts.withColumn("k", F.lit(1)).join(model.edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("k", F.lit(1)), "k").drop("k")
    c, s, e, x, found = F.col("containers"), F.col("stores"), F.col("edges"), F.col("externals"), F.lit(discovered)
    shown = F.lit(represented) if represented else c
    tied = s - F.col("orphan_stores")
    density = F.coalesce(e / F.nullif(c + s, F.lit(0)), F.lit(0.0))
    per = F.coalesce(e / F.nullif(c, F.lit(0)), F.lit(0.0))
    rules = [
        F.when((c > 1) & (e == 0), "fail: no relationships"),
        F.when((found >= 5) & (shown <= 2), "fail: under-discovery").when((found >= 5) & (shown < 0.5 * found), "fail: dropped units"),
        F.when((s > 2) & (tied / F.nullif(s, F.lit(0)) < 0.5), "fail: stores not connected").when((s > 0) & (tied == 0), "warn: no store connected"),
        F.when((x > 0) & (F.col("connected_externals") == 0), "warn: no external connected"),
        F.when((c > 3) & (F.col("actors") == 0), "warn: no actor"),
        F.when((density < 0.5) & (c + s > 1), "warn: few edges"),
        F.when((c >= 8) & (per < 0.75), "fail: sparse service graph"),
    ]
    findings = F.array_compact(F.array(*rules))
    return one.select("*", F.bround(density, 2).alias("avg_edges"), F.bround(per, 2).alias("avg_edges_container"), F.array_join(findings, "; ").alias("findings"), (~F.exists(findings, lambda m: F.startswith(m, F.lit("fail")))).alias("passed"))


def hld(model: Model, deny: list[str], enrichment: tuple[DataFrame, DataFrame] | None = None) -> Model:
    """All passes in order: entry, backbone, spine, enrichment, technologies, kinds, layers, noise, domains, folding, thinning, connections, roles. The tables are written after each, which keeps every plan short."""
    passes = [infer_entry, backbone, spine, (lambda m: enrich(m, *enrichment)) if enrichment else None, lambda m: strip_technologies(m, deny), enforce_kinds, assign_layers, drop_noise, assign_domains, consolidate, reduce_edges, curate_edges, connect, assign_roles]
    for step in passes:
        if step:
            model = step(model).written()
    return model


def layered_view(components: DataFrame, edges: DataFrame, layers: list[str], most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The best components by score (the rest is redirected to the component they are most tied to, ties to the larger id) and at most ceil(1.5 n) edges between them that don't point to a higher layer, by weight. components: id, layer, score; edges: src, dst, weight."""
    ranked = components.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # one row per component
    kept, tail = ranked.where(F.col("rank") <= most).drop("rank"), ranked.where(F.col("rank") > most)
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    pulled = both.join(tail.select(F.col("id").alias("src")), "src").join(kept.select(F.col("id").alias("dst")), "dst").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    to = pulled.groupBy("src").agg(F.max_by("dst", F.struct("w", "dst")).alias("to"))
    target = kept.select(F.col("id").alias("node"), F.col("id").alias("group")).unionByName(to.select(F.col("src").alias("node"), F.col("to").alias("group")))
    rolled = graph.roll_up(edges, target)
    tier = F.coalesce(*[F.when(F.col("layer") == x, F.lit(i)) for i, x in enumerate(layers)], F.lit(1))
    tiers = kept.select("id", tier.alias("tier"))
    a, b = tiers.select(F.col("id").alias("src"), F.col("tier").alias("ta")), tiers.select(F.col("id").alias("dst"), F.col("tier").alias("tb"))
    forward = rolled.join(a, "src").join(b, "dst").where("tb >= ta").drop("ta", "tb")
    n = kept.count()
    return kept, top_k(forward, [F.desc("weight"), F.col("src"), F.col("dst")], -(-3 * n // 2))


def render_flowchart(model: Model) -> DataFrame:
    """(ord, line): flowchart text, nodes by layer then id, edges by ends."""
    order = F.coalesce(*[F.when(F.col("layer") == x, F.lit(i)) for i, x in enumerate(LAYER_ORDER)], F.lit(len(LAYER_ORDER)))
    shape = F.when(F.col("kind").isin("datastore", "cache"), F.concat(F.lit("[("), F.col("text"), F.lit(")]"))).when(F.col("kind") == "queue", F.concat(F.lit("[["), F.col("text"), F.lit("]]"))).when(F.col("kind") == "person", F.concat(F.lit("(("), F.col("text"), F.lit("))"))).otherwise(F.concat(F.lit("["), F.col("text"), F.lit("]")))
    named = model.nodes.withColumn("text", F.concat(F.lit('"'), safe_label(F.coalesce("label", "id")), F.coalesce(F.concat(F.lit("<br/>"), safe_label(F.nullif("tech", F.lit("")))), F.lit("")), F.lit('"')))
    lines = named.select(F.struct(F.lit(1).alias("part"), order.alias("tier"), F.col("id").alias("a"), F.lit("").alias("b")).alias("o"), F.concat(F.lit("    "), slug_word(F.col("id")), shape).alias("line"))
    arrows = first_seen(model.edges, ["src", "dst"], [F.col("ord")]).select(F.struct(F.lit(2).alias("part"), F.lit(0).alias("tier"), F.col("src").alias("a"), F.col("dst").alias("b")).alias("o"), F.concat(F.lit("    "), slug_word(F.col("src")), F.lit(" -->|"), safe_label(F.coalesce("label", F.lit(""))), F.lit("| "), slug_word(F.col("dst"))).alias("line"))
    head = model.nodes.sparkSession.createDataFrame([((0, 0, "", ""), "flowchart TD")], "o struct<part:int,tier:int,a:string,b:string>, line string")
    return head.unionByName(lines).unionByName(arrows).select(F.row_number().over(Window.orderBy("o")).alias("ord"), "line")


def share(a: Column, b: Column) -> Column:
    """a / b between 0 and 1; 0 where b is 0."""
    return clamp(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)))
