"""The graph queries over every line."""

import pytest

from sparkgate.plans import catalogue
from sparkgate.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_every_line_has_its_edge(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    want = set()
    for p, s in lines:
        dst = p + 5 * (s % 2) if p % 5 == 0 else 5 * ((p * 13 + s) % 300) + p % 5
        want.add((p, dst, dst // 5 % 3 == 0 or (dst // 5 % 3 == 1 and s % 2 == 0)))
    assert {tuple(r) for r in catalogue.all_edges(spark, SF).collect()} == want


def test_grounded_by_brute_force(spark):
    edges = {(r.src, r.dst) for r in catalogue.all_edges(spark, SF).collect()}
    found = {s for s, _ in edges} - {d for _, d in edges}
    while more := {d for s, d in edges if s in found} - found:
        found |= more
    assert {r.node for r in QUERIES["g01_grounded"](spark, SF).collect()} == found
    assert found and {s for s, _ in edges} - found


@pytest.mark.parametrize("name, column, least", [("g02_represented_live", "live", 2), ("g07_dispositions", "disposition", 5)])
def test_results_differ_by_node(spark, name, column, least):
    assert QUERIES[name](spark, SF).select(column).distinct().count() >= least
