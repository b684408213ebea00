"""Payload filters: only pairs that pass are scored, and missing payloads pass as in SQL."""

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry
from corpusgraph.operators import knn


def test_only_pairs_that_pass_are_scored(monkeypatch):
    rng = np.random.default_rng(3)
    n = 300
    vectors = pd.DataFrame({"id": [f"v{i * 7 % n}" for i in range(n)], "embedding": list(rng.standard_normal((n, 8))),
                            "kind": [None if i % 11 == 0 else f"k{i % 4}" for i in range(n)],
                            "project": [None if i % 13 == 0 else i % 5 for i in range(n)]})
    queries = pd.DataFrame({"query_id": range(40), "_k": 1 + np.arange(40) % 5, "embedding": list(rng.standard_normal((40, 8))),
                            "want": [None if i % 3 == 0 else f"k{i % 6}" for i in range(40)],
                            "of": [[] if i % 4 == 0 else None if i % 4 == 1 else [i % 7, None, 4] for i in range(40)],
                            "own": [f"v{i}" for i in range(40)]})
    equal, member = [("want", "kind")], [("of", "project")]
    passes = lambda q, v: (q.want is None or v.kind == q.want) and (
        q.of is None or not len(q.of) or (not pd.isna(v.project) and v.project in q.of))
    cells = []
    real = knn._top
    monkeypatch.setattr(knn, "_top", lambda labels, ks, asked, ids, *rest: cells.append(len(asked) * len(ids)) or real(labels, ks, asked, ids, *rest))
    asked, rows = knn.matrix(queries["embedding"]), knn.matrix(vectors["embedding"])
    found = knn._top_filtered(queries, asked, vectors, ["query_id"], equal, member, "own")
    assert sum(cells) == sum(passes(q, v) for q in queries.itertuples() for v in vectors.itertuples())
    want = set()
    for i, q in enumerate(queries.itertuples()):
        best = sorted((-round(float(asked[i] @ rows[j]), 6), v.id) for j, v in enumerate(vectors.itertuples()) if passes(q, v) and v.id != q.own)
        want |= {(q.query_id, v, round(-s, 6)) for s, v in best[:queries["_k"][i]]}
    assert {(q, v, round(s, 6)) for q, v, s in zip(found["query_id"], found["id"], found["score"])} == want and len(found) == len(want)


def test_documents_without_source_equal_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS doc_id, 'text ' || i AS text, 'en' AS lang, CASE WHEN i % 4 = 0 THEN NULL ELSE 'src' || i % 3 END AS source,
      5 AS n_chars FROM range(90) t(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)""")
    con.execute("SELECT setseed(0.5)")
    con.execute(f"""COPY (SELECT i AS vec_id, [random()::FLOAT - 0.5::FLOAT, random()::FLOAT - 0.5::FLOAT, random()::FLOAT, random()::FLOAT] AS embedding, (i % 3)::INT AS label
      FROM range(90) t(i)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = con.execute(f"SELECT query_id, rank, id, score FROM ({entry.oracle_sql()['flt1_payload_filter']})").fetchall()
    got = entry.queries()["flt1_payload_filter"](spark, str(tmp_path)).select("query_id", "rank", "id", "score").collect()
    assert sorted((q, r, i, round(s, 5)) for q, r, i, s in got) == sorted((q, r, i, round(s, 5)) for q, r, i, s in want)
