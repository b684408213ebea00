import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import merkle
from corpusgraph.llm.all_queries import QUERIES, SQL

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_LOWER = {i: i + 32 for i in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def f(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*map(f, row))


def tree(hashes):
    """(root, the way of each leaf): a plain recursion."""
    way, level = [[] for _ in hashes], hashes
    of = list(range(len(hashes)))
    while len(level) > 1:
        for i, at in enumerate(of):
            run = level[at // 8 * 8:at // 8 * 8 + 8]
            way[i].append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
            of[i] = at // 8
        level = [h(*level[k:k + 8]) for k in range(0, len(level), 8)]
    return level[0], way


def brute(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        members = sorted(parts[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (members, *tree([leaf(r) for r in members]))
    root, upper = tree([trees[n][1] for n in names])
    out = []
    for name, above in zip(names, upper):
        members, sub, below = trees[name]
        for r, way in zip(members, below):
            start = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                start = leaf((*r[:4], r[4].translate(_LOWER)))
            for left, right in way + above:
                start = h(left, start, right)
            out.append((r[0], leaf(r), sub, root, h(*[x for w in way + above for x in w]), start, start == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = (spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
          .withColumn("tree", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("pos", F.lit(2)))
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_equal_to_brute_force(spark, messy):
    rows = [(i, f"s{i % 3}" if i % 5 else None, lang, len(text or ""), text) for i, text, lang in messy]
    rows += [(2000 + i, "S", "en", None, f"Text {i}") for i in range(520)]  # four levels
    rows += [(None, None, None, None, None), (None, "a", "en", 1, "A"), (2000, "S", "en", None, "Text 0"),
             (2000, "S", "en", 5, "Other"), (9, "x", "", 3, "Aé"), (7, "x", "z", 3, "LONE")]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_of_one_part(spark, n):
    check(spark, [(i, "s", "en", 1, f"T{i}") for i in range(n)])


def test_many_parts(spark):
    check(spark, [(i, "s", f"l{i % 70}", 1, f"T{i}") for i in range(140)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES["op13_merkle_manifest"](spark, folder)
    rel = con.execute(SQL["op13_merkle_manifest"])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
