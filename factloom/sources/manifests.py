"""Build manifests -> one row per directory: project name, dependencies, language, whether it is deployed by itself."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import first_seen

SCHEMA = "file string, dir string, name string, dependencies array<string>, language string, deployable boolean"
#: Packages that run a server, by ecosystem; package.json scripts that start one; SDKs of servers; marks of test projects.
NODE_SERVERS = ("express", "fastify", "nestjs", "@nestjs/core", "koa", "hapi", "@hapi/hapi", "next", "remix", "@remix-run/node", "sveltekit", "@sveltejs/kit", "nuxt", "@nuxt/kit")
PYTHON_SERVERS = ("fastapi", "flask", "django", "uvicorn", "gunicorn", "starlette", "tornado", "aiohttp", "quart", "sanic")
START_SCRIPTS = ("start", "serve", "dev")
WEB_SDKS = ("Microsoft.NET.Sdk.Web", "Microsoft.NET.Sdk.Worker")
TEST_MARKS = ("<istestproject>true", "microsoft.net.test.sdk", 'include="mstest"', "mstest.testframework", "xunit", "nunit", "microsoft.testplatform")
#: A project name by the packaging grammar, at the start of a requirement.
_PROJECT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?")


def _unique(items: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))


def _tags(text: str) -> ElementTree.Element:
    root = ElementTree.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def _pom(text: str, directory: str) -> tuple:
    root = _tags(text)
    name = root.findtext("name") or root.findtext("artifactId")
    deps = [f"{d.findtext('groupId')}:{d.findtext('artifactId')}" for d in root.iter("dependency")]
    return name, deps, "java", "spring-boot-maven-plugin" in text or root.findtext("packaging") == "war"


def _package_json(text: str, directory: str) -> tuple:
    data = json.loads(text)
    deps = _unique([*data.get("dependencies", {}), *data.get("devDependencies", {})])
    starts = any(s in data.get("scripts", {}) for s in START_SCRIPTS)
    return data.get("name"), deps, "javascript", bool(starts or data.get("bin") or set(deps) & set(NODE_SERVERS))


def _requirement(line: str) -> str:
    """The project that a requirement names; empty for options, comments and paths."""
    found = _PROJECT.match(line.strip())
    return found[0] if found else ""


def _pyproject(text: str, directory: str) -> tuple:
    data = tomllib.loads(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    deps = [_requirement(x) for x in project.get("dependencies", [])] + [x for x in poetry.get("dependencies", {}) if x != "python"]
    runs = "scripts" in project or "scripts" in poetry or "console_scripts" in text or {d.lower() for d in deps} & set(PYTHON_SERVERS)
    return project.get("name") or poetry.get("name"), _unique(deps), "python", bool(runs)


def _requirements(text: str, directory: str) -> tuple:
    deps = [_requirement(x) for x in text.splitlines()]
    return None, _unique(deps), "python", any(d.lower() in PYTHON_SERVERS for d in deps)


def _csproj(text: str, directory: str) -> tuple:
    root, lower = _tags(text), text.lower()
    runs = root.get("Sdk") in WEB_SDKS or (root.findtext(".//OutputType") or "").lower() in ("exe", "winexe")
    return None, _unique(e.get("Include", "").strip() for e in root.iter("PackageReference")), "csharp", runs and not any(m in lower for m in TEST_MARKS)


def _go_mod(text: str, directory: str) -> tuple:
    """Line by line: the module's last segment, and what is required, in a block or by itself. Whether a module has a main package isn't written here, so it counts as deployable."""
    name, deps, inside = None, [], False
    for line in text.splitlines():
        words = line.split("//")[0].split()
        if words[:1] == ["module"] and len(words) > 1:
            name = words[1].rpartition("/")[2]
        elif words == ["require", "("] or words == [")"]:
            inside = words[0] == "require"
        elif words[:1] == ["require"] and len(words) == 3:
            deps.append(words[1])
        elif inside and len(words) == 2 and words[1][:1] == "v":
            deps.append(words[0])
    return name, _unique(deps), "go", True


def _gradle(text: str, directory: str) -> tuple:
    """Quoted group:artifact coordinates; bootable by the boot tasks or an applied boot or application plugin."""
    quoted = [part for line in text.splitlines() for part in re.split("[\"']", line)[1::2]]
    deps = [":".join(x.split(":")[:2]) for x in quoted if x.count(":") in (1, 2) and not re.search(r"[\s/]", x)]
    applied = [re.split("[\"']", line)[1::2] for line in text.splitlines() if "apply false" not in line]
    plugins = {x for names in applied for x in names}
    boots = "bootJar" in text or "bootRun" in text or "application" in plugins or any("org.springframework.boot" in x for x in plugins)
    return directory.rpartition("/")[2], _unique(deps), "java", boots


#: File name or suffix -> parser of (text, directory).
PARSERS = {"pom.xml": _pom, "package.json": _package_json, "pyproject.toml": _pyproject, "requirements.txt": _requirements, "go.mod": _go_mod, "build.gradle": _gradle, "build.gradle.kts": _gradle, ".csproj": _csproj, ".fsproj": _csproj}
#: Manifests that are found but not read.
UNREAD = ("setup.py", "gemfile")


def parse_manifest(file: str, text: str | None) -> dict | None:
    """The row of one manifest; an empty one if it can't be parsed; None if the file is no manifest."""
    directory, _, name = file.rpartition("/")
    parser = PARSERS.get(name.lower()) or PARSERS.get("." + name.lower().rpartition(".")[2])
    if parser is None:
        return {"file": file, "dir": directory, "name": None, "dependencies": [], "language": None, "deployable": False} if name.lower() in UNREAD else None
    try:
        found, deps, language, deployable = parser(text or "", directory)
    except (ValueError, AttributeError, ElementTree.ParseError):
        found, deps, language, deployable = None, [], None, False
    if name.lower().endswith((".csproj", ".fsproj")):
        found = name.rpartition(".")[0]
    return {"file": file, "dir": directory, "name": found, "dependencies": deps, "language": language, "deployable": deployable}


def parse_manifests(files: DataFrame) -> DataFrame:
    """Manifests among (file, text), merged per directory: deployed if one is; dependencies and language of the one with most; the first name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for r in batch.to_pylist() if (x := parse_manifest(r["file"], r["text"]))]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    rows = files.select("file", "text").mapInArrow(run, SCHEMA)
    most = first_seen(rows, ["dir"], [F.desc(F.size("dependencies")), F.col("file")]).select("dir", "dependencies", "language")
    flags = rows.groupBy("dir").agg(F.bool_or("deployable").alias("deployable"), F.min_by("name", F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.col("file"))).alias("name"))
    return most.join(flags, "dir")
