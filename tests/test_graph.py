"""The four-node graph with a cycle: a -> b -> c -> a, c -> d."""

from __future__ import annotations

import pytest

from codeloom.operators import dataflow as X
from codeloom.operators import graph as G
from codeloom.operators import impact as I


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(x, "Function", x, f"{x}.py", i) for i, x in enumerate("abcd", 1)], "id string, label string, name string, file_path string, start_line int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string").selectExpr("*", "'CALLS' as type")
    return nodes, edges


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_direct(spark, small):
    nodes, edges = small
    assert [r.id for r in G.callers(nodes, edges, _ids(spark, "c")).collect()] == ["b"]
    assert sorted(r.id for r in G.callees(nodes, edges, _ids(spark, "c")).collect()) == ["a", "d"]


def test_reach_and_trails(spark, small):
    _, edges = small
    assert {(r.id, r.distance) for r in G.reach(edges, _ids(spark, "d"), "CALLS", 5, True).collect()} == {("c", 1), ("b", 2), ("a", 3)}
    assert {(r.id, r.distance) for r in G.reach(edges, _ids(spark, "a"), "CALLS", 5, True).collect()} == {("c", 1), ("b", 2), ("a", 3)}
    assert {(r.id, r.depth) for r in G.trails(edges, _ids(spark, "d"), "CALLS", 5, True).collect()} == {("c", 1), ("b", 2), ("a", 3), ("c", 4)}


def test_paths(spark, small):
    _, edges = small
    pair = spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a")], "src string, dst string")
    assert [(r.path, r.length) for r in G.shortest_path(edges, pair).collect()] == [(["a", "b", "c", "d"], 3)]
    assert [r.path for r in G.all_paths(edges, _ids(spark, "a"), _ids(spark, "d")).collect()] == [["a", "b", "c", "d"]]


def test_edges_need_their_ends(spark, small):
    nodes, edges = small
    batch = spark.createDataFrame([("a", "d", "CALLS"), ("a", "x", "CALLS"), ("a", "b", "CALLS"), ("a", "b", "INHERITS"), ("a", "b", "LIKES")], "src string, dst string, type string")
    added = G.upsert_edges(nodes, edges, batch).collect()
    assert len(added) == 5 and ("a", "d", "CALLS") in {tuple(r) for r in added}


def test_impact_case(spark):
    changes = spark.createDataFrame([(1, "e", "DELETE")], "change_id int, entity_id string, change string")
    affected = spark.createDataFrame([(1, "x", "f.py", 1, "high")], "change_id int, id string, file_path string, distance int, level string")
    row = I.rate(affected, changes).first()
    assert row.risk == 52 and row.overall == "high" and row.requires_review
    empty = I.rate(affected.limit(0), changes).first()
    assert (empty.risk, empty.overall) == (0, "none")


def test_levels(spark):
    rows = spark.createDataFrame([("DELETE", 1), ("MODIFY", 1), ("DELETE", 3), ("ADD", 2)], "c string, d int")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(I.level(F.col("c"), F.col("d"))).collect()] == ["critical", "medium", "medium", "none"]


def test_traversals_broadcast_nothing(spark, small, monkeypatch):
    """Small tables are where Spark would broadcast: each level's plan, and the last one's."""
    nodes, edges = small
    plans, cut = [], G.cut
    for module in (G, X):
        monkeypatch.setattr(module, "cut", lambda df, name="step": plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name))
    found = [X.trace(edges, _ids(spark, "a", "d"), origin) for origin in (True, False)]
    found += [G.trails(edges, _ids(spark, "a"), "CALLS", 3), G.shortest_path(edges, spark.createDataFrame([("a", "d")], "src string, dst string"))]
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]
    assert "Broadcast" not in found[0]._jdf.queryExecution().executedPlan().toString()
    assert [(r.start, r.id) for r in found[1].orderBy("start").collect()] == [("a", "d"), ("d", "d")]
