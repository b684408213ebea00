"""Keys and groups that hold a third of all rows."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusgraph.operators import rank, relate, salting, stats, windows


def _sides():
    rng = random.Random(3)
    names = ["hot"] * 500 + [f"n{rng.randint(0, 300)}" for _ in range(1000)]
    left = [(i, names[i]) for i in range(1500)] + [(9000, None)]
    right = [(i, rng.choice(["hot", f"n{rng.randint(0, 300)}", f"n{rng.randint(0, 300)}"])) for i in range(1200)] + [(9000, None)]
    return left, right


def test_hot_key_is_dealt_and_no_pair_is_lost(spark):
    left, right = _sides()
    a = spark.createDataFrame(left, "lid long, k string").repartition(5)
    b = spark.createDataFrame(right, "rid long, k string").repartition(3)
    by_name = defaultdict(list)
    for r, k in right:
        by_name[k].append(r)
    want = Counter((l, r) for l, k in left if k is not None for r in by_name[k])
    got = salting.salted_join(a, b, "k", "lid", "rid")
    assert sorted(got.columns) == ["k", "lid", "rid"]
    assert Counter((r.lid, r.rid) for r in got.collect()) == want
    x, y = salting.deal(a, b, "k", "lid", "rid")
    cells = [r["count"] for r in x.join(y, ["k", "_row", "_col"]).groupBy("k", "_row", "_col").count().collect()]
    parts = salting.PARTS * max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert max(cells) <= 3 * len(want) / parts
    assert salting.salted_join(a.limit(0), b, "k", "lid", "rid").count() == 0


def test_calls_across_files_of_a_frequent_name(spark):
    chunks = [(f"c{i}", f"f{i}", "run" if i % 3 == 0 else f"g{i}", 0) for i in range(300)]
    sites = [(f"f{i}", f"g{i}", "run") for i in range(300) if i % 3] + [("f3", "run", "g4"), ("f1", "g1", "g1"), ("f1", "g1", None)]
    c = spark.createDataFrame(chunks, "id string, file_path string, name string, list_no int")
    s = spark.createDataFrame(sites, "file_path string, caller_name string, callee_name string")
    want = {(f"c{i}", f"c{j}") for i in range(300) if i % 3 for j in range(0, 300, 3)} | {("c3", "c4")}
    got = relate.calls_across_files(s, c).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pages_of_a_large_group(spark):
    rows = [("hub", i) for i in range(3000)] + [(f"x{i % 40}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    place = {(r.g, r.v): r.position for r in windows.numbered(df, ["g"], ["v"]).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    assert place == {(g, v): n for g, vs in groups.items() for n, v in enumerate(sorted(vs), 1)}
    got = {(r.g, r.page): [x.v for x in r.vs] for r in windows.pages(df, ["g"], ["v"], 100, "vs").collect()}
    assert got == {(g, p): sorted(vs)[p * 100:p * 100 + 100] for g, vs in groups.items() for p in range(-(-len(vs) // 100))}
    assert windows.pages(df.limit(0), ["g"], ["v"], 100, "vs").count() == 0


def test_relation_and_context_pages(spark):
    edges = spark.createDataFrame([("hub", f"d{i:04}", "CALLED_BY") for i in range(250)] * 2 + [("d1", "hub", "CALLS"), ("d1", "z", "IMPORTS")],
                                  "src string, dst string, rel string")
    got = {(r.id, r.rel, r.page): r.others for r in stats.relation_pages(edges, 100).collect()}
    assert [len(got["hub", "CALLED_BY", p]) for p in range(3)] == [100, 100, 50] and got["d1", "CALLS", 0] == ["hub"] and len(got) == 4
    assert sum((got["hub", "CALLED_BY", p] for p in range(3)), []) == [f"d{i:04}" for i in range(250)]
    context = edges.filter("rel <> 'IMPORTS'").select(F.lit(1).alias("query_id"), F.col("src").alias("id"), F.lit(1).alias("depth"),
                                                     F.col("rel").alias("context_type"), F.col("dst").alias("other_id"))
    seeds = spark.createDataFrame([(1, "hub"), (1, "alone")], "query_id int, id string")
    out = {(r.id, r.page): len(r.context) for r in rank.context_pages(seeds, context, 200).collect()}
    assert out == {("hub", 0): 200, ("hub", 1): 50, ("alone", 0): 0}
