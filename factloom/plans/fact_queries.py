"""Queries over facts of source files. The files are literals: the driver's tables hold no source code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, graph
from ..sources.extract import extract
from .registry import register

SOURCES = [
    ("app/main.py", "import flask\nfrom .users import service\nfrom app.users.models import User\n\n@app.route('/users', methods=['GET', 'POST'])\ndef users():\n    return service.find_users()\n\ndef main():\n    server.start()\n"),
    ("app/users/__init__.py", ""),
    ("app/users/service.py", "from . import models\nfrom ..db import session\n\ndef find_users():\n    return session.query_all()\n"),
    ("app/users/models.py", "import sqlalchemy\n\nclass Base:\n    pass\n\nclass User(Base):\n    __tablename__ = 'users'\n    id: int\n    home: Address\n\nclass Address(Base):\n    street: str\n    def show(self):\n        self.printer.render()\n"),
    ("app/db/session.py", "import psycopg2\n\ndef query_all():\n    pool.connect()\n\ndef connect():\n    pass\n"),
    ("app/broken.py", "def f(:\n"),
    ("tests/test_app.py", "from app import main\n"),
    ("web/src/index.ts", "import { api } from './lib/api';\nimport React from 'react';\nimport { util } from '@/util';\n\nexport function start() {\n  api.fetchAll();\n}\n"),
    ("web/src/lib/api.ts", "import '../index';\nexport class Api {\n  base: string;\n  fetchAll() {\n    return this.client.get('/users');\n  }\n}\n"),
    ("src/util/index.ts", "export const util = (x) => {\n  return x;\n};\n"),
    ("svc/A.java", "package com.acme.core;\nimport com.acme.data.*;\nimport com.acme.core.B;\n@RestController\n@RequestMapping(\"/a\")\npublic class A extends B {\n  private Repo repo;\n  @GetMapping(\"/{id}\")\n  public String one(int id) {\n    return repo.load(id);\n  }\n}\n"),
    ("svc/B.java", "package com.acme.core;\npublic class B {\n  public void stop() {\n  }\n}\n"),
    ("svc/Repo.java", "package com.acme.data;\n@Repository\npublic class Repo {\n  public String load(int id) {\n    return null;\n  }\n}\n"),
    ("net/Users.cs", "using Acme.Data;\nnamespace Acme.Web {\n  [Route(\"api/[controller]\")]\n  public class UsersController : ControllerBase {\n    [HttpGet(\"{id}\")]\n    public User Get(int id) {\n      return store.Load(id);\n    }\n  }\n}\n"),
    ("net/Store.cs", "namespace Acme.Data {\n  public class Store : DbContext {\n    public User Load(int id) {\n      return null;\n    }\n  }\n}\n"),
]
SIGNS = [(1, "Flask", "flask"), (2, "React", "react"), (3, "SQLAlchemy", "sqlalchemy"), (4, "Django", "django")]


def sample(spark):
    return extract(spark.createDataFrame(SOURCES, "file string, text string"))


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(tuple(r)) for r in rows)}) t({names})"


@register(_values([("app/main.py", "GET", "/users"), ("app/main.py", "POST", "/users"), ("svc/A.java", "GET", "/a/{id}"), ("net/Users.cs", "GET", "/api/users/{id}")], "file, method, path"))
def extract_routes(spark, sf_dir):
    return sample(spark).select("file", F.explode("routes").alias("r")).select("file", "r.method", "r.path")


@register(_values([("app/users/models.py", "User"), ("app/users/models.py", "Address"), ("svc/Repo.java", "Repo"), ("net/Store.cs", "Store")], "file, name"))
def extract_db_models(spark, sf_dir):
    return sample(spark).select("file", F.explode("classes").alias("c")).where("c.is_db_model").select("file", "c.name")


@register(_values([("app/main", "app/users/__init__"), ("app/main", "app/users/models"), ("app/users/service", "app/users/__init__"), ("web/src/index", "web/src/lib/api"), ("web/src/index", "src/util/index"), ("web/src/lib/api", "web/src/index"), ("svc/A", "svc/Repo"), ("svc/A", "svc/B"), ("net/Users", "net/Store")], "src, dst"))
def import_graph(spark, sf_dir):
    return facts.import_graph(sample(spark))


@register(_values([("User", "Base", "inheritance", 5), ("Address", "Base", "inheritance", 5), ("User", "Address", "composition", 4), ("A", "B", "inheritance", 5), ("A", "Repo", "composition", 4)], "src, dst, type, weight"))
def class_graph(spark, sf_dir):
    return facts.class_graph(sample(spark))


@register()
def call_graph(spark, sf_dir):
    return facts.resolved_calls(facts.callables(sample(spark)))


@register()
def sequence_trace(spark, sf_dir):
    calls = facts.callables(sample(spark))
    return facts.trace_sequences(calls, facts.resolved_calls(calls))


@register(_values([(1, "Flask"), (2, "React"), (3, "SQLAlchemy")], "rank, name"))
def detect_frameworks(spark, sf_dir):
    return facts.detect_frameworks(sample(spark), spark.createDataFrame(SIGNS, "rank int, name string, sign string"))


@register()
def fact_chunks(spark, sf_dir):
    return facts.chunks(sample(spark)).select("id", "text")


@register()
def module_rank(spark, sf_dir):
    return graph.page_rank(facts.import_graph(sample(spark)).withColumn("weight", F.lit(1))).select("node", F.round("rank", 6).alias("rank"))
