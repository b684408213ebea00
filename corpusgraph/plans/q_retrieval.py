"""Registered queries: vector retrieval, fusion and per-key windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import knn
from corpusgraph.plans.catalog import query

_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def _as_queries(d, k=None):
    return d.vectors.select(F.col("vec_id").alias("query_id"), F.col("id").alias("self_id"),
                            "project_id", "embedding")


@query("ret1_cosine_topk", "vectors", sql=f"""
SELECT query_id, rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.id, {_COS} AS score
    FROM vectors a JOIN vectors b ON a.id <> b.id)) WHERE rank <= 10""")
def ret1(d):
    return knn.cosine_topk(_as_queries(d), d.vectors, 10, exclude_self="self_id")


@query("jn5_knn_join", "vectors", sql=f"""
SELECT query_id, rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.id, {_COS} AS score FROM vectors a, vectors b)) WHERE rank <= 5""")
def jn5(d):
    return knn.cosine_topk(_as_queries(d), d.vectors, 5, force_blocks=True)


@query("flt1_payload_filter", "vectors", "chunks", sql=f"""
, c AS (SELECT v.id, v.vec_id, v.embedding, c.project_id, c.file_path, regexp_replace(node_type, '_(definition|statement)$', '') AS kind
        FROM vectors v JOIN chunks c USING (id))
SELECT query_id, rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.id, {_COS} AS score
    FROM c a JOIN c b ON (a.vec_id % 3 = 0 OR list_contains([a.project_id, 'src1'], b.project_id))
     AND (a.vec_id % 2 = 0 OR a.kind = b.kind))) WHERE rank <= 10""")
def flt1(d):
    payload = d.vectors.select("id", "vec_id", "embedding").join(
        d.chunks.select("id", "project_id",
                        F.regexp_replace("node_type", "_(definition|statement)$", "").alias("kind")), "id")
    none = F.array().cast("array<string>")
    queries = payload.select(
        F.col("vec_id").alias("query_id"), "embedding",
        F.when(F.col("vec_id") % 3 == 0, none)
        .otherwise(F.array("project_id", F.lit("src1"))).alias("project_ids"),
        F.when(F.col("vec_id") % 2 != 0, F.col("kind")).alias("want_kind"))
    return knn.cosine_topk(queries, payload, 10, equal=[("want_kind", "kind")],
                           member=[("project_ids", "project_id")])


@query("ret2_approx_topk")
def ret2(d):
    return knn.approx_topk(_as_queries(d), d.vectors, 10)


def _recall(d):
    exact = knn.cosine_topk(_as_queries(d), d.vectors, 10)
    return knn.recall(knn.approx_topk(_as_queries(d), d.vectors, 10), exact)


@query("ret2_recall")
def ret2_recall(d):
    return _recall(d)


@query("ret2_recall_reached", "vectors", sql="""
SELECT count(*) * least(10, count(*)) AS expected, true AS reached FROM vectors WHERE embedding IS NOT NULL""")
def ret2_recall_reached(d):
    return _recall(d).select("expected", (F.col("recall") >= 0.9).alias("reached"))


@query("ret2_all_lists", "vectors", sql=f"""
SELECT query_id, rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.id, {_COS} AS score FROM vectors a, vectors b)) WHERE rank <= 10""")
def ret2_all_lists(d):
    """The index holds every row: looking into all lists gives the exact neighbours."""
    return knn.approx_topk(_as_queries(d), d.vectors, 10, probes=1 << 30)
