"""Operators on small fixtures where a query over the driver's tables shows too little."""

import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import facts, graph, joins, model, rank, vectors, windows
from factloom.plans.fact_queries import SOURCES
from factloom.sources import extract, manifests


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight int")


def test_transitive_reduction(spark, rows):
    drop = graph.transitive_reduction(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")])).select("src", "dst")
    assert rows(drop) == [("a", "b"), ("b", "c")]
    cycle = edges(spark, [("a", "b"), ("b", "a"), ("a", "c"), ("b", "c")])
    assert rows(graph.transitive_reduction(cycle).select("src", "dst")) == [("a", "b"), ("b", "a")]
    full = edges(spark, [(x, y) for x in "abc" for y in "abc" if x != y])
    assert graph.transitive_reduction(full).count() == 0 and graph.reduced_or_all(full).count() == 6


def test_page_rank(spark):
    star = spark.createDataFrame([(x, "hub", 2.0) for x in "abc"] + [("hub", "out", 1.0)], "src string, dst string, weight double")
    ranks = {r["node"]: r["rank"] for r in graph.page_rank(star).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-4) and ranks["out"] > ranks["a"] < ranks["hub"]
    assert graph.page_rank(star.limit(0)).count() == 0


def test_components(spark, rows):
    e = edges(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("z", "y")])
    assert {r["label"] for r in graph.weak_components(e).collect()} == {"n00", "y"}
    s = graph.strong_components(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]))
    assert rows(s) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_rolling_sum_leaves_out_the_bound(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t + timedelta(seconds=s), 1) for s in (0, 30, 60, 60.000001)], "k int, ts timestamp, v int")
    assert [r["calls"] for r in windows.rolling_sum(df, ["k"], "ts", "v", 60).orderBy("ts").collect()] == [1, 2, 2, 3]


def test_rate_limiter(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, t + timedelta(seconds=i), 10) for i in range(14)] + [(2, 0, t, 500_000), (2, 1, t, 5)], "k int, id int, ts timestamp, tokens long")
    got = {(r["k"], r["id"]): r["waited"] for r in windows.rate_limiter(df, "k", "ts", "tokens", "id").collect()}
    assert [got[1, i] for i in range(14)] == [0.0] * 12 + [48.0, 48.0]
    assert got[2, 0] == 0 and got[2, 1] == 60


def test_prefix_coverage_keeps_the_crossing_row(spark):
    df = lambda w: spark.createDataFrame([(i, x) for i, x in enumerate(w)], "id int, w int")
    assert rank.prefix_coverage(df([8, 1, 1]), "w", [F.col("id")]).count() == 1
    assert rank.prefix_coverage(df([5, 3, 2]), "w", [F.col("id")]).count() == 2
    assert rank.prefix_coverage(df([5, 2, 2, 1]), "w", [F.col("id")]).count() == 3
    assert rank.prefix_coverage(df([0, 0]), "w", [F.col("id")]).count() == 0


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.slug_ascii(F.lit("Ünder @scope/pkg!"))) == "nder_scope_pkg" and one(T.slug_word(F.lit("Ünder @s"))) == "ünder__s"
    assert one(T.slug_ascii(F.lit("--"))) == "node" and one(T.safe_id(F.lit("End"))) == "end_"
    assert one(T.normalise_path(F.lit("a/./b/../../../c"))) == "c" and one(T.module_id(F.lit("a/b.test.tsx"))) == "a/b.test"
    assert one(T.join_route(F.lit("/api/"), F.lit("x/"))) == "/api/x" and one(T.round_even(F.lit(2.5))) == 2
    assert one(T.window_score(F.lit(24), 5, 12)) == 0.0 and one(T.last_segment(F.lit("a.b.c"))) == "c" and one(T.last_segment(F.lit("1"))) is None
    assert one(T.retry_delay(F.lit("quota; retry in 2.5s"))) == 2.5 and one(T.json_slice(F.lit('x {"a":1} y'))) == '{"a":1}'


def test_patch_and_contains(spark, rows):
    with pytest.raises(ValueError):
        joins.contains_match(spark.range(1).select(F.lit("a").alias("n")), "n", spark.range(joins.BROADCAST_TERMS + 1).select(F.col("id").cast("string").alias("t")), "t")


def test_cosine(spark, rows):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.1])], "vec_id int, embedding array<double>")
    got = vectors.cosine_top_k(v, v.where("vec_id = 0"), 3).collect()
    assert [(r["vec_id"], r["rank"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.0)]
    assert vectors.cosine_top_k(v, v.limit(0)).count() == 0


def test_cosine_of_odd_vectors(spark):
    some = [[1.0, 0.0], [2.0, 0.0], [0.6, 0.8], [-3.0, 4.0], [0.0, 0.0], [1e-200, 1e-180], [1e200, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, None], None, [], [1.0, 0.0, 0.0], [0.3, 0.1, 0.2], [0.1, 0.2, 0.3]]
    rows = [(i, some[i * 7 % len(some)]) for i in range(90)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        dot = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
        length = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return dot(a, b) / length if length else 0.0

    for k in (1, 5, 100):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], repr(r["score"] + 0.0)) for r in vectors.cosine_top_k(v, v.where("vec_id % 2 = 0"), k).collect()}
        for q, a in rows[::2]:
            best = sorted((not math.isnan(s), 0 if math.isnan(s) else -s, i, repr(s + 0.0)) for i, s in ((i, score(a, b)) for i, b in rows))[:k]
            assert [got.pop((q, r)) for r in range(1, len(best) + 1)] == [(i, s) for _, _, i, s in best]
        assert not got


def test_cosine_leaves_few_rows_of_a_task(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)] if i % 3 else [1.0] * 16) for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows]), "v": pa.array([x for _, x in rows], pa.list_(pa.float64()))})
    asked = batch.slice(0, 1200)
    out = pa.Table.from_batches(vectors._nearest(asked.column(0), asked.column(1), 4)(iter([batch])))
    assert len(out) == 4 * 1200  # not a row for every pair
    copies = sorted(zip(out.filter(pc.equal(out["query_id"], 0))["id"].to_pylist()))
    assert copies == [(0,), (3,), (6,), (9,)]


def test_extract_reads_files(spark, tmp_path, rows):
    for name, source in [*SOURCES, ("node_modules/x.js", "a"), ("a.min.js", "b"), ("note.txt", "c")]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(source)
    got = extract.extract(extract.read_sources(spark, str(tmp_path)))
    assert {r["file"] for r in got.collect()} == {n for n, _ in SOURCES}
    assert [r["file"] for r in got.where("error IS NOT NULL").collect()] == ["app/broken.py"]
    assert facts.runtime(got).where("file LIKE 'tests/%'").count() == 0


def test_manifests(spark, tmp_path):
    files = {
        "a/package.json": '{"name": "shop", "dependencies": {"express": "1", "pg": "2"}, "devDependencies": {"jest": "3"}, "scripts": {"start": "x"}}',
        "b/pyproject.toml": '[project]\nname = "api"\ndependencies = [\n  "fastapi>=0.1",\n  "redis",\n]\n',
        "c/requirements.txt": "flask==1.0\n# no\nkafka-python >= 2 ; x\n",
        "d/pom.xml": "<project><artifactId>core</artifactId><packaging>war</packaging><dependencies><dependency><groupId>g</groupId><artifactId>d</artifactId></dependency></dependencies></project>",
        "e/go.mod": "module github.com/x/tool\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n",
        "f/web.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web"><ItemGroup><PackageReference Include="Dapper" /></ItemGroup></Project>',
        "g/build.gradle": "plugins { id 'org.springframework.boot' }\ndependencies { implementation 'org.a:b:1' }\n",
        "h/pom.xml": "<broken",
    }
    rows = spark.createDataFrame(list(files.items()), "file string, text string")
    got = {r["dir"]: r for r in manifests.parse_manifests(rows).collect()}
    assert (got["a"]["name"], got["a"]["dependencies"], got["a"]["deployable"]) == ("shop", ["express", "pg", "jest"], True)
    assert (got["b"]["name"], got["b"]["dependencies"], got["b"]["deployable"]) == ("api", ["fastapi", "redis"], True)
    assert (got["c"]["dependencies"], got["c"]["language"]) == (["flask", "kafka-python"], "python")
    assert (got["d"]["name"], got["d"]["dependencies"], got["d"]["deployable"]) == ("core", ["g:d"], True)
    assert (got["e"]["name"], got["e"]["dependencies"]) == ("tool", ["github.com/a/b"])
    assert (got["f"]["name"], got["f"]["dependencies"], got["f"]["deployable"]) == ("web", ["Dapper"], True)
    assert (got["g"]["dependencies"], got["g"]["deployable"]) == (["org.a:b"], True) and got["h"]["dependencies"] == []


def test_empty_model(spark):
    m = model.Model(spark.createDataFrame([], model.NODE_SCHEMA), spark.createDataFrame([], model.EDGE_SCHEMA))
    assert model.validate(m).first()["passed"] is True
    assert model.render_flowchart(m).count() == 1


def test_communities(spark):
    from factloom.operators.communities import communities, modularity

    pairs = [(a, b) for group in ("abcd", "wxyz") for a in group for b in group if a < b] + [("d", "w")]
    got = {r["node"]: r["community"] for r in communities(edges(spark, pairs + [("b", "a"), ("a", "a")])).collect()}
    assert got == {x: "a" for x in "abcd"} | {x: "w" for x in "wxyz"}
    assert modularity({p: 1.0 for p in pairs}, got) > 0.4
    assert communities(edges(spark, []).limit(0)).count() == 0


def test_curate_edges(spark):
    """Against the same rule one edge at a time: no edge goes that is needed to reach its target, and none of the spine."""
    nodes = spark.createDataFrame([(x, x, "web_app" if x == "a" else "service", *[None] * 6, i) for i, x in enumerate("abcdefgh")], model.NODE_SCHEMA)
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("a", "f"), ("a", "g"), ("b", "f"), ("c", "g"), ("d", "e"), ("g", "h"), ("f", "h")]
    e = spark.createDataFrame([(a, b, "x", i, (a, b) == ("a", "f")) for i, (a, b) in enumerate(pairs)], model.EDGE_SCHEMA)
    got = {(r["src"], r["dst"]) for r in model.curate_edges(model.Model(nodes, e), cap=4).edges.collect()}
    # a has six edges: f is of the spine, g (3 edges) is reached by c, e (2) by d; b, c, d are needed.
    assert set(pairs) - got == {("a", "g"), ("a", "e")}


def test_path_domain(spark):
    for path, want in (("src/modules/a/b", "modules"), ("services/cart", None), ("runner", None), ("src\\common\\ui", "common"), ("", None), (None, None), ("./src/lib/x", None)):
        assert spark.range(1).select(T.path_domain(F.lit(path).cast("string")).alias("x")).first()["x"] == want, path


def test_orchestration(spark):
    from factloom.sources import orchestration as O

    files = {
        "docker-compose.yml": "services:\n  web:\n    build: {context: ./web}\n    depends_on: [api, db]\n  api:\n    image: shop/api:1\n    links: ['db:database']\n  db: {image: 'registry/postgres:16'}\n  tool: {image: x, profiles: [dev]}\n",
        "k8s/api.yaml": "kind: Deployment\nmetadata: {name: cart-api}\nspec:\n  template:\n    spec:\n      containers:\n      - image: a\n        env:\n        - {name: A, value: 'http://api.ns.svc:80/x'}\n        - {name: B, value: 'db:5432'}\n        - {name: C, valueFrom: {}}\n        - {name: D, value: '1'}\n---\nkind: Service\nmetadata: {name: api}\n---\nkind: CronJob\nmetadata: {name: sweep}\n",
        "Procfile": "web: run\n# no: x\n",
        "bad.yml": "a: [",
        "node_modules/x.yaml": "kind: Job\nmetadata: {name: j}\n",
        "svc/Dockerfile": "FROM x",
        "svc/requirements.txt": "flask",
        "svc/pom.xml": "<project/>",
    }
    df = spark.createDataFrame(list(files.items()), "file string, text string")
    rows = {(r["source"], r["name"]): r for r in O.orchestration(df).collect()}
    assert set(rows) == {("compose", x) for x in ("web", "api", "db", "tool")} | {("workload", "cart-api"), ("workload", "sweep"), ("service", "api"), ("process", "web")}
    assert rows["compose", "web"]["refs"] == ["api", "db"] and rows["compose", "api"]["refs"] == ["db"] and rows["compose", "tool"]["auxiliary"] and rows["compose", "web"]["build_dir"] == "./web"
    assert rows["workload", "cart-api"]["refs"] == ["api", "db"]
    assert [r["dir"] for r in O.dockerfile_dirs(df).collect()] == ["svc"] and [r["file"] for r in O.manifest_files(df).collect()] == ["svc/pom.xml"]
    empty = model.Model(spark.createDataFrame([], model.NODE_SCHEMA), spark.createDataFrame([], model.EDGE_SCHEMA))
    merged = model.merge_orchestration(empty, O.orchestration(df))
    assert {(r["id"], r["kind"]) for r in merged.nodes.collect()} == {("web", "service"), ("api", "service"), ("db", "datastore"), ("cart_api", "service"), ("sweep", "worker")}
    tied = {(r["src"], r["dst"], r["label"]) for r in model.communicate(merged, O.orchestration(df)).edges.collect()}
    assert tied == {("web", "api", "calls"), ("web", "db", "reads/writes"), ("api", "db", "reads/writes"), ("cart_api", "api", "calls"), ("cart_api", "db", "reads/writes")}
