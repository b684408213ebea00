import random

import duckdb
from pyspark.sql import functions as F

from corpusgraph.llm import hamming
from corpusgraph.llm.all_queries import QUERIES, SQL


def code(vector, bits=32):
    width = max(1, len(vector) // bits)
    out = 0
    for i in range(bits):
        part = sum((x or 0.0) for x in vector[i * width:(i + 1) * width])
        out = out * 2 + (part >= 0)
    return out


def test_top_k_equals_brute_force(spark):
    rng = random.Random(7)
    centre = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(300)]
    rows += [(300 + i, centre) for i in range(150)]  # a third are one vector
    rows += [(450 + i, [x + rng.uniform(-0.4, 0.4) for x in centre]) for i in range(60)]
    rows += [(600, None), (620, []), (640, [None] * 64), (660, [0.5] * 5)]
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>").withColumn("n", F.lit(1))
    got: dict = {}
    for r in hamming.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.distance, r.vec_id)
    codes = {i: code(v) for i, v in rows if v}
    for q in (i for i in codes if i % 20 == 0):
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:7]
        assert [got[q][k + 1] for k in range(7)] == want


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0] * 32), (1, [-1.0] * 32)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.distance) for r in hamming.top_k(df, F.lit(True)).collect()] in (
        [(0, 1, 32), (1, 0, 32)], [(1, 0, 32), (0, 1, 32)])
    assert hamming.top_k(df.limit(0), F.lit(True)).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    df = QUERIES["op9_hamming_topk"](spark, folder)
    rel = con.execute(SQL["op9_hamming_topk"])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
