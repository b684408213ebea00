import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import sharedrank
from corpusgraph.llm.all_queries import QUERIES, SQL

_TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for i, t in dict.fromkeys(items):
        asked[i].update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for (doc, c), size in zip(counts, sizes):
            m = 25 + 75 * size * n // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, q in own.items() if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def asked(messy):
    rng = random.Random(8)
    texts = [t for _, t, _ in messy if t]
    items = [(i, " ".join(rng.choice(texts).split()[:40])) for i in range(30)]
    items += [(40, items[0][1]), (41, items[0][1] + " light light LIGHT"), (42, None), (43, ""), (44, "nowhere at all zzz"),
              (45, "tie"), (1, "another text"), (None, "stone paper")]
    return [*items, items[0]]


def test_equal_to_brute_force(spark, documents, messy, asked):
    more = [(None, "stone paper light"), (7, "the of and"), (321, "tie"), (900, "tie")]
    docs = documents.select("doc_id", "text", "word", "score").unionByName(
        spark.createDataFrame(more, "doc_id long, text string").withColumns({"word": F.lit(1), "score": F.lit(2)}))
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({"node": F.lit(1), "doc_id": F.lit(3)})
    got = sharedrank.search(docs, items.repartition(3), k=6)
    want = brute([(i, t) for i, t, _ in messy] + more, asked, 6)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_blocks_of_items_and_of_documents(spark, documents, messy, asked, monkeypatch):
    monkeypatch.setattr(sharedrank, "BLOCK_TERMS", 100)
    monkeypatch.setattr(sharedrank, "CELLS", 500)
    got = sharedrank.search(documents, spark.createDataFrame(asked, "item_id long, text string"), 3)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, t) for i, t, _ in messy], asked, 3)


def test_shared_sums_are_made_once(spark):
    items = [(i, p, n) for i in range(6) for p, n in enumerate([1, 2, 3, 4, 5, 10 + i])]
    df = spark.createDataFrame(items, "item_id long, place int, node long")
    rest, rounds = sharedrank.share(df)
    left = defaultdict(set)
    for r in rest.collect():
        left[r.item_id].add(r.node)
    parts = {r.node: (r.low, r.high) for x in rounds for r in x.collect()}

    def spelled(node):
        return [node] if node not in parts else [x for side in parts[node] for x in spelled(side)]

    for i in range(6):
        assert sorted(x for n in left[i] for x in spelled(n)) == sorted([1, 2, 3, 4, 5, 10 + i])
    # five shared terms are one node for all six items: four sums instead of 24
    assert len(parts) == 4 and len(set.intersection(*left.values())) == 1


def test_pairs_that_win_again_in_a_later_round(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(24)]
    drawn = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 2) for i in range(24)], k=n))
    docs = [(i, drawn(rng.randint(1, 60))) for i in range(150)]
    items = [(i, drawn(rng.randint(4, 30))) for i in range(120)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    placed = sharedrank.item_terms(asked).select("item_id", F.col("word").alias("place"), F.col("word").alias("node"))
    made = [r.node for x in sharedrank.share(placed)[1] for r in x.collect()]
    assert len(made) > len(set(made))  # the case at hand
    got = sharedrank.search(spark.createDataFrame(docs, "doc_id long, text string"), asked, 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


def test_no_rows(spark, documents):
    items = spark.createDataFrame([(1, "tie")], "item_id long, text string")
    assert sharedrank.search(documents.limit(0), items).count() == 0
    assert sharedrank.search(documents, items.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES["op12_shared_rank"](spark, folder)
    rel = con.execute(SQL["op12_shared_rank"])
    at = [[d[0] for d in rel.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
