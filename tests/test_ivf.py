"""Vector lists: exact search by bounds, recall and cost of the approximate one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import ivf, knn


@pytest.fixture(scope="module")
def grouped(spark):
    """3,000 vectors in 60 groups, a third of them copies of one; some without direction."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    rows = centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)) * 0.25
    rows[500:1500] = rows[500]
    data = [(f"v{i:04d}", [float(x) for x in r], i % 4) for i, r in enumerate(rows.round(3))]
    data += [("z1", [0.0] * 24, 1), ("z2", None, 2), ("z3", [], 3)]
    df = spark.createDataFrame(data, "id string, embedding array<double>, grp int").repartition(4)
    return df, data


def brute(data, asked, k, allowed=lambda q, v: True):
    unit = np.array([np.zeros(24) if not v else np.array(v) / (np.linalg.norm(v) or 1) for _, v, _ in data])
    out = []
    for i in asked:
        score = np.round(unit @ unit[i], 6) + 0.0
        best = sorted((j for j in range(len(data)) if allowed(data[i], data[j])), key=lambda j: (-score[j], data[j][0]))[:k]
        out += [(data[i][0], n + 1, data[j][0], float(score[j])) for n, j in enumerate(best)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def test_exact_by_bounds_equals_brute_force(spark, grouped, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_VECTORS", 500)
    df, data = grouped
    asked = [*range(0, 3000, 150), 3000, 3001]
    q = df.filter(F.col("id").isin([data[i][0] for i in asked])).select(
        F.col("id").alias("query_id"), "embedding", F.when(F.col("grp") == 2, F.col("grp")).alias("want"))
    assert got(knn.cosine_topk(q, df, 7, force_blocks=True)) == brute(data, asked, 7)
    filtered = knn.cosine_topk(q, df, 7, equal=[("want", "grp")], exclude_self="query_id", force_blocks=True)
    assert got(filtered) == brute(data, asked, 7, lambda a, b: a[0] != b[0] and (a[2] != 2 or b[2] == 2))


def test_bounds_leave_most_lists_out(spark, grouped):
    df, data = grouped
    index = ivf.build(df)
    assert index.rows.count() == len(data) and index.nowhere
    q = df.filter("id < 'v0400'").select(F.col("id").alias("query_id"), "embedding", F.lit(0.9).alias("bound"))
    looked = ivf.probe(q, index, 0, skip=0, bound="bound").count() / q.count()
    assert looked < 0.25 * len(index.centroids)


def test_recall_and_candidates(spark, grouped):
    df, data = grouped
    q = df.filter("embedding is not null and size(embedding) > 0").select(F.col("id").alias("query_id"), "embedding")
    exact = knn.cosine_topk(q, df, 10)
    assert knn.recall(knn.approx_topk(q, df, 10), exact).first()["recall"] >= 0.9
    # four times the rows in the same groups: the lists looked into hold a smaller share of them
    shares = []
    for copies in (1, 4):
        more = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).select(
            F.concat_ws("-", "id", "copy").alias("id"), "embedding")
        index = ivf.build(more)
        sizes = index.rows.groupBy("bucket").agg(F.count("*").alias("n"))
        seen = ivf.probe(q, index, 3).groupBy("query_id", "bucket").count().join(sizes, "bucket")
        shares.append(seen.agg(F.sum("n")).first()[0] / q.count() / (len(data) * copies))
    assert shares[1] <= shares[0]


@pytest.mark.parametrize("block", [0, 8192])
def test_few_and_no_rows(spark, monkeypatch, block):
    if not block:
        monkeypatch.setattr(knn, "_one_block", knn._pruned)
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "id string, embedding array<double>")
    q = df.select(F.col("id").alias("query_id"), "embedding")
    want = [("a", 1, "a", 1.0), ("a", 2, "b", 0.0), ("b", 1, "a", 0.0), ("b", 2, "b", 0.0)]
    assert got(knn.cosine_topk(q, df, 5, force_blocks=True)) == want == got(knn.approx_topk(q, df, 5))
    assert got(knn.cosine_topk(q, df.limit(0), 5, force_blocks=True)) == [] == got(knn.approx_topk(q, df.limit(0), 5))


def test_query_is_sent_once_to_a_group_of_lists(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(900, 12))  # no groups: bounds leave most lists in
    df = spark.createDataFrame([(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(rows)], "id string, embedding array<double>")
    q = df.select(F.col("id").alias("query_id"), "embedding")
    index = ivf.build(df, group_rows=300)
    sent = ivf.probe(q, index, 1 << 30, groups=True)
    assert sent.count() <= 5 * q.count() < 10 * q.count() <= ivf.probe(q, index, 1 << 30).count()
    assert ivf.grouped(index).select("bucket").distinct().count() <= 5
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6) + 0.0
    want = sorted((f"v{i:04d}", n + 1, f"v{j:04d}", float(score[i, j])) for i in range(900)
                  for n, j in enumerate(sorted(range(900), key=lambda j: (-score[i, j], j))[:4]))
    close = lambda found: [(a, b, c, round(s, 5)) for a, b, c, s in found]
    assert close(got(knn.approx_topk(q, df, 4, probes=1 << 30))) == close(want)
    for dense in (0.0, 2.0):  # all pairs, and bounds
        before, knn.DENSE, block, knn.BLOCK_VECTORS = knn.DENSE, dense, knn.BLOCK_VECTORS, 100
        try:
            assert close(got(knn.cosine_topk(q, df, 4, force_blocks=True))) == close(want)
        finally:
            knn.DENSE, knn.BLOCK_VECTORS = before, block


@pytest.mark.parametrize("k", [0, 1, 7, 2500])
def test_top_equals_brute_force_with_ties_and_endless_vectors(k):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(6000, 16))
    rows[3000:4500] = rows[10] + rng.normal(size=(1500, 16)) * 1e-7  # differ beyond single precision
    rows[4500:5000] = rows[11]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[[5, 2100, 5999]] = np.nan
    ids = np.array([f"v{i:04d}" for i in rng.permutation(6000)], dtype=object)
    keys = knn.pd.DataFrame({"query_id": range(20), "_k": [k, 3] * 10})
    found = knn._top(keys, keys["_k"].to_numpy(), rows[:20], ids, rows, lambda lo, hi, tile: None)
    want = []
    for i in range(20):
        score = np.round(rows @ rows[i], 6) + 0.0
        finite = np.flatnonzero(np.isfinite(score))
        want += [(i, ids[j]) for j in sorted(finite, key=lambda j: (-score[j], ids[j]))[:[k, 3][i % 2]]]
    assert list(zip(found["query_id"], found["id"])) == want
