"""The registered queries: contract, and a sample of them against DuckDB on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpusgraph.plans import catalog
from corpusgraph.sources.derived import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["ret1_cosine_topk", "ret4_fuse_rerank", "gr5_chunk_context", "ag8_usage_hotspots", "tx1_classify_intent",
          "prj2_outline_python", "jn3_calls_cross_file", "cl13_role_rules", "ss4_stream_termination", "snk2_replace_by_file"]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.spark_queries()) <= set(entry.queries())
    without = set(catalog.spark_queries()) - set(catalog.check_sql())
    assert without == {"ret2_approx_topk", "ret2_recall", "ud1_embed", "ud2_hash_embed",
                       "tx17_parse_sections", "ret15_role_document"}


def _norm(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(_norm(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall()), key=str)
    assert cols == sorted(names) and got == want


def test_approximate_recall(spark):
    row = entry.queries()["ret2_recall"](spark, FOLDER).first()
    assert row["recall"] >= 0.9
