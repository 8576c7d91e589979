"""What runs beside what: compose files, workload manifests, process files and Dockerfiles -> rows of services."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import image_name, slug_ascii
from .catalogs import SKIPPED_DIRS
from .manifests import PARSERS

SCHEMA = "source string, file string, doc int, name string, kind string, image string, build_dir string, auxiliary boolean, refs array<string>"
#: Pattern in an image's name -> (label, kind); the first contained wins.
IMAGES = (
    ("postgres", "PostgreSQL", "datastore"),
    ("mysql", "MySQL", "datastore"),
    ("mariadb", "MariaDB", "datastore"),
    ("mongo", "MongoDB", "datastore"),
    ("redis", "Redis", "cache"),
    ("cassandra", "Cassandra", "datastore"),
    ("elastic", "Elasticsearch", "datastore"),
    ("opensearch", "OpenSearch", "datastore"),
    ("kafka", "Kafka", "queue"),
    ("rabbitmq", "RabbitMQ", "queue"),
    ("zookeeper", "Zookeeper", "datastore"),
    ("mssql", "SQL Server", "datastore"),
    ("sqlserver", "SQL Server", "datastore"),
    ("sqlite", "SQLite", "datastore"),
    ("memcached", "Memcached", "cache"),
    ("nats", "NATS", "queue"),
    ("pulsar", "Pulsar", "queue"),
    ("dynamodb", "DynamoDB", "datastore"),
    ("neo4j", "Neo4j", "datastore"),
    ("clickhouse", "ClickHouse", "datastore"),
    ("couchbase", "Couchbase", "datastore"),
    ("hazelcast", "Hazelcast", "cache"),
)
#: Kinds of manifests that run something.
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob")


def _host(value: str) -> str:
    """The first label of the host that an address names, as a slug; empty if it names none."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", value.strip(), flags=re.IGNORECASE)
    host = re.split("[:/]", host, maxsplit=1)[0]
    return re.sub("[^a-z0-9]+", "_", host.split(".")[0].lower()).strip("_") if len(host) > 1 else ""


def _services(doc: dict) -> Iterator[dict]:
    """Services of a compose document: those of a profile only are auxiliary."""
    for name, body in (doc.get("services") or {}).items():
        body = body if isinstance(body, dict) else {}
        build = body.get("build")
        asked = [*(body.get("depends_on") or []), *(str(x).partition(":")[0] for x in body.get("links") or [])]
        yield {"source": "compose", "name": str(name), "image": body.get("image"), "build_dir": build.get("context") if isinstance(build, dict) else build, "auxiliary": bool(body.get("profiles")), "refs": list(dict.fromkeys(map(str, asked)))}


def _workload(doc: dict) -> Iterator[dict]:
    """A workload with the hosts that its containers' environment names, or a service name."""
    kind, name = doc.get("kind"), (doc.get("metadata") or {}).get("name")
    if not name or kind not in (*WORKLOADS, "Service"):
        return
    spec = doc.get("spec") or {}
    if kind == "CronJob":
        spec = ((spec.get("jobTemplate") or {}).get("spec")) or {}
    boxes = ((spec.get("template") or {}).get("spec") or {}).get("containers") or []
    named = [_host(str(e.get("value") or "")) for b in boxes for e in b.get("env") or [] if isinstance(e, dict) and "valueFrom" not in e]
    yield {"source": "service" if kind == "Service" else "workload", "name": str(name), "kind": kind, "image": next((b.get("image") for b in boxes), None), "auxiliary": False, "refs": list(dict.fromkeys(x for x in named if x))}


def parse_orchestration(file: str, text: str | None) -> list[dict]:
    """The rows of one file; none if it says nothing or can't be parsed."""
    directory, _, name = file.rpartition("/")
    if any(p in SKIPPED_DIRS for p in directory.split("/")):
        return []
    if name == "Procfile":
        lines = [x.partition(":") for x in (text or "").splitlines() if ":" in x and not x.lstrip().startswith("#")]
        return [{"source": "process", "file": file, "doc": i, "name": a.strip(), "auxiliary": False, "refs": []} for i, (a, _, _) in enumerate(lines)]
    if not name.endswith((".yml", ".yaml")):
        return []
    compose = re.fullmatch(r"(docker-)?compose[^/]*\.ya?ml", name) and directory.count("/") < 1
    try:
        docs = [x for x in yaml.safe_load_all(text or "") if isinstance(x, dict)]
        return [{"file": file, "doc": i} | row for i, doc in enumerate(docs) for row in (_services(doc) if compose else _workload(doc))]
    except (yaml.YAMLError, AttributeError, TypeError):
        return []


def orchestration(files: DataFrame) -> DataFrame:
    """Services, workloads and processes among (file, text)."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for r in batch.to_pylist() for x in parse_orchestration(r["file"], r["text"])]
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)

    return files.select("file", "text").mapInArrow(run, SCHEMA)


def dockerfile_dirs(files: DataFrame) -> DataFrame:
    """(dir): the folders that hold a Dockerfile of this very name."""
    return files.where(F.col("file").rlike("(^|/)Dockerfile$")).select(F.regexp_replace("file", "/?Dockerfile$", "").alias("dir")).distinct()


def manifest_files(files: DataFrame) -> DataFrame:
    """The manifests of units among files: requirements.txt alone makes none."""
    name = F.lower(F.regexp_extract("file", "([^/]+)$", 1))
    known = [x for x in PARSERS if not x.startswith(".") and x != "requirements.txt"]
    return files.where((name.isin(*known) | name.rlike(r"\.(csproj|fsproj)$")) & ~F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(x) for x in SKIPPED_DIRS])))


def image_store(image: Column) -> Column:
    """(label, kind) of the store that an image runs, or null."""
    name = F.lower(image_name(image))
    return F.coalesce(*[F.when(F.contains(name, F.lit(p)), F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"))) for p, label, kind in IMAGES])


def service_id(name: Column) -> Column:
    return slug_ascii(name)
