"""All pairs of a file against sets; nodes of files that no seed can share are not shuffled for them."""

from corpusgraph.operators import graph


def test_pairs_and_nodes_of_other_files(spark, monkeypatch):
    chunks = [(f"a{i}", f"f{i % 3}.py") for i in range(12)] + [("a1", "g.py"), ("a2", "g.py"), ("b1", "f1.py"), ("b1", "g.py"), ("a3", "z.py"), ("a4", None)]
    chunks += [(f"x{i}", f"lines/{i % 2}.py") for i in range(400)] + [("a2", "f1.py")]
    seeds = [(q, f"a{i}") for q in range(3) for i in range(q, 9)]
    stored = {}
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="step": stored.setdefault(label, (df, real(df, label)))[1])
    frame = spark.createDataFrame(chunks, "id string, file_path string")
    found = sorted(map(tuple, graph.same_file(frame, spark.createDataFrame(seeds, "query_id bigint, id string")).collect()))
    assert found == sorted({(q, i, b) for q, i in seeds for a, f in chunks for b, g in chunks if a == i and f == g and f and b != i})
    # the nodes are grouped by id before they meet the seeds: those of kind x only if they are not left out
    plan = stored["same-file-pool"][0]._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in plan
