"""Queries with the same entities share one graph side."""

import random

from pyspark.sql import functions as F

from corpusgraph.operators import rank
from corpusgraph.plans import search


def test_same_entities_are_found(spark):
    one, two = [("Reader", "class", 0.8), ("Reader", "class", 0.8)], [("Reader", "class", 0.8)]
    said = {1: one, 2: two, 3: one[::-1], 5: two, 8: [("Reader", "class", 0.9)]}
    entities = spark.createDataFrame([(q, *e) for q, es in said.items() for e in es],
                                     "query_id long, text string, type string, confidence double")
    got = {r["query_id"]: r["same_as"] for r in search.first_of_same(entities).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 5: 2, 8: 8}


def test_shared_side_ranks_as_each_query_alone(spark):
    rng = random.Random(3)
    k, limit = 4, 3
    same = [(q, q % 3) for q in range(24)]
    side = [(s, f"d{i}", rng.choice([None, 0.1, 0.5]), rng.random(), None, rng.choice([0.0, 0.3])) for s in range(3) for i in range(30)]
    hits = [(q, r + 1, f"d{i}", rng.choice([0.1, 0.4, 0.9])) for q in range(26) for r, i in enumerate(rng.sample(range(40), k))]
    cols = "query_id long, id string, graph_score double, centrality double, path_score double, entity_relevance double"
    same_df = spark.createDataFrame(same, "query_id long, same_as long")
    side_df, hits_df = spark.createDataFrame(side, cols), spark.createDataFrame(hits, "query_id long, rank int, id string, score double")
    each = same_df.join(side_df.withColumnRenamed("query_id", "same_as"), "same_as")
    want = rank.hybrid_rank(hits_df, each, each, each, each, each, limit)
    got = rank.hybrid_rank_of_same(hits_df, same_df, side_df, k, limit)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a side of any size brings limit + k rows to a query
    big = side_df.unionByName(side_df.withColumn("id", F.concat("id", F.lit("x"))))
    assert rank.hybrid_rank_of_same(hits_df, same_df, big, k, limit).count() == 26 * limit


def test_equal_vectors_are_asked_once(spark):
    vectors = spark.createDataFrame([(f"d{i}", [float(i % 3), 1.0, float(i)]) for i in range(9)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(q, [float(q % 2), 1.0, 2.0]) for q in range(10)], "query_id long, embedding array<float>")
    got = search.hits_of_same(asked, vectors, 2)
    from corpusgraph.operators import knn

    want = knn.cosine_topk(asked, vectors, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_answered_queries_meet_no_later_chunk(spark, monkeypatch):
    """Queries with enough chunks of the highest score among the first ones do not go on; the others do, in several groups."""
    rng = random.Random(5)
    vocab = ["load", "a", "parse", "on", "parser", "x.py", "the", "main"]
    chunks = [(f"c{i:02d}", " ".join(rng.choices(vocab, k=6)), f"src/{rng.choice(vocab)}", rng.choice(vocab)) for i in range(40)]
    asked = [(q, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 30])))) for q in range(30)] + [(90, ""), (91, None), (92, "zzz")]
    want = []
    for q, text in asked:
        scored = []
        for cid, content, path, name in chunks:
            s = sum((w in content) + 2 * (w in path) + 3 * (w in name) for w in (text or "").split())
            if s:
                scored.append((-min(s, 10), cid))
        want += [(q, n + 1, cid, -s / 10) for n, (s, cid) in enumerate(sorted(scored)[:4])]
    c = spark.createDataFrame(chunks, "id string, content string, file_path string, name string")
    q = spark.createDataFrame(asked, "query_id int, query string")
    scanned, scan = [], rank._scan_keywords

    def watched(small, *args):
        scanned.extend(set(small["query_id"]))
        return scan(small, *args)

    monkeypatch.setattr(rank, "_scan_keywords", watched)
    for words in (400_000, 20):
        scanned.clear()
        got = rank.keyword_search(q, c, 4, max_words=words, first=(8, 16))
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert 0 < len(scanned) < 25 and len(scanned) == len(set(scanned))
