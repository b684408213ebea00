import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import contentsort
from corpusgraph.llm.all_queries import QUERIES, SQL


def brute(rows):
    """Rows (doc_id, keep_id, group_size, kept, sha) of (doc_id, text), sorted."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        members.sort()
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, digest) for k, m in enumerate(members)]
    return sorted(out, key=str)


def test_equal_to_brute_force(spark, documents, messy):
    extra = [(700, " t i e\n"), (701, "tie\v"), (None, "tie"), (None, None), (700, " t i e\n"), (703, " "), (704, " ")]
    copies = [(1000 + i, "hot text " + " " * (i % 3)) for i in range(400)]
    rows = [(i, t) for i, t, _ in messy] + extra + copies
    df = documents.select("doc_id", "text", "word").unionByName(
        spark.createDataFrame(extra + copies, "doc_id long, text string").withColumn("word", F.lit(1)).repartition(3))
    assert sorted(map(tuple, contentsort.content_groups(df).collect()), key=str) == brute(rows)
    kept = contentsort.deduplicate(df.withColumn("norm", F.lit("x")).withColumn("rest", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "word", "norm", "rest"]
    want = sorted(((r[0], r[1]) for r in {str(x): x for x in rows}.values()), key=str)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    keepers = sorted((r[0] for r in brute(rows) if r[3]), key=str)
    assert sorted((i for i, _ in got), key=str) == keepers and set(got) <= set(want)


def test_one_text_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [(i, "same text" + " " * (i == 321)) for i in range(600)] + [(1000 + i, f"text {i // 2}") for i in range(300)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = contentsort.content_groups(df).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
        assert {r.keep_id for r in got if r.group_size == 600} == {321}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for k in list(conf)[1:]:
            spark.conf.unset(k)


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    """Texts that a splitter cannot tell apart are still told apart by their full comparison."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, "x" * 40 + f"{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, contentsort.content_groups(df).collect()), key=str) == brute(rows)


def test_empty_table(spark, documents):
    assert contentsort.content_groups(documents.limit(0)).count() == 0
    assert contentsort.deduplicate(documents.limit(0)).columns == documents.columns


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES["op11_content_sort"](spark, folder)
    rel = con.execute(SQL["op11_content_sort"])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
