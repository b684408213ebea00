"""Edges around a selection against plain sets; an edge with one end that can be selected is shuffled once."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import filters, graph, stats
from corpusgraph.rules.area_rules import EDGE_KINDS
from corpusgraph.sources.derived import Data

FOLDER = "/root/testdata/sf0.001"
EDGES = "src string, dst string, rel string, weight double"


def _shuffled(node) -> int:
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    kids = node.children()
    return own + sum(_shuffled(kids.apply(i)) for i in range(kids.size()))


@pytest.mark.parametrize("most", [0, 64])
def test_each_edge_once_for_each_query(spark, monkeypatch, most):
    monkeypatch.setattr(filters, "MOST_INITIALS", most)
    pick = random.Random(5)
    ids = [f"{kind}{i}" for kind in "abx" for i in range(12)] + [None, ""]
    edges = [(pick.choice(ids), pick.choice(ids), pick.choice(["CALLS", "IMPORTS"]), pick.choice([0.5, 1.0])) for _ in range(900)]
    edges += edges[:200] + [("a1", "a1", "CALLS", 0.5)] * 2
    selection = [(q, pick.choice([i for i in ids if i is None or i[:1] != "x"])) for q in range(6) for _ in range(8)] + [(None, "a1")]
    want = {(q, *e) for q, i in set(selection) if i is not None for e in edges if i in e[:2]}
    found = graph.touching(spark.createDataFrame(edges, EDGES), spark.createDataFrame(selection, "query_id bigint, id string"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_edges_with_one_end_left_are_shuffled_once(spark):
    edges = [(f"o{i // 5}", f"l{i}", "PARENT_OF", 1.0) for i in range(5000)]
    selection = [(i % 3, f"o{i}") for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.touching(spark.createDataFrame(edges, EDGES), spark.createDataFrame(selection, "query_id bigint, id string"))
        assert len(found.collect()) == len(edges)
        # the edges once; the selection for each of four joins
        assert _shuffled(found._jdf.queryExecution().executedPlan()) <= len(edges) + 4 * len(selection)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links_are_one_direction_of_edges(spark):
    d = Data(spark, FOLDER)
    back = spark.createDataFrame([(a, b) for a, b, _ in EDGE_KINDS], "rel string, back string")
    both = d.links.unionByName(d.links.join(back, "rel").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("back").alias("rel"), "weight"))
    assert both.count() == d.edges.count() and both.exceptAll(d.edges).isEmpty()
    close = lambda df: sorted((r["query_id"], r["id"], round(r["graph_score"], 9)) for r in df.collect())
    assert close(graph.graph_score(graph.touching(d.links, d.selection), ways=2)) == close(graph.graph_score(graph.touching(d.edges, d.selection)))
    counts = lambda df: sorted(map(tuple, df.collect()))
    assert counts(stats.relationship_histogram(graph.touching(d.links, d.selection), both_ways=True)) == counts(
        stats.relationship_histogram(graph.touching(d.edges, d.selection)))
