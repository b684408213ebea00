"""op9: exact nearest codes."""

from pyspark.sql import functions as F

from corpusgraph.llm import hamming
from corpusgraph.llm.queries import query, table

SQL = """
WITH codes AS (
    SELECT vec_id, list_reduce([0::BIGINT] || list_transform(range(0, 32), lambda i:
        (list_sum(list_transform(embedding[i * greatest(1, len(embedding) // 32) + 1
                                           : (i + 1) * greatest(1, len(embedding) // 32)], lambda x: x::DOUBLE)) >= 0)::BIGINT),
        lambda a, b: a * 2 + b) AS code
    FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id, bit_count(xor(a.code, b.code))::BIGINT AS distance
    FROM codes a JOIN codes b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


@query("op9_hamming_topk", SQL)
def op9(spark, folder):
    return hamming.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
