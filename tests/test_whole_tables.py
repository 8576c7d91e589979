"""Queries whose SQL reads less than their tables, against brute force over all rows."""

from collections import defaultdict

from factloom.plans import registry


def test_domain_assignment_reads_all_line_items(spark, tmp_path):
    tables = {
        "lineitem": ([(1, 1), (1, 2), (7, 3), (7, 1), (8, 2), (8, 2), (14, 4)], "l_partkey long, l_suppkey long"),
        "supplier": ([(1, 10), (2, 11), (3, 10), (4, 12)], "s_suppkey long, s_nationkey int"),
        "nation": ([(10, 0), (11, 0), (12, 1)], "n_nationkey int, n_regionkey int"),
    }
    tables["lineitem"][0].append((1, 4))
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    nation, region, found = dict(tables["supplier"][0]), dict(tables["nation"][0]), defaultdict(set)
    for part, supplier in tables["lineitem"][0]:
        found[part].add(region[nation[supplier]])
    want = {p: (str(min(r)) if len(r) == 1 else "Shared Data", len(r)) for p, r in found.items()}
    got = {r["l_partkey"]: (r["domain"], r["peers"]) for r in registry.QUERIES["domain_assignment"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 4
