"""Operators against plain Python loops on small random inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.operators import filters, graph, knn, ner, rank, relate, roles, windows
from corpusgraph.rules import area_rules as A
from corpusgraph.rules import ner_rules as N
from corpusgraph.rules import role_rules as R


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_round_robin_equals_loop(spark):
    rng = random.Random(1)
    data, want = [], []
    for q in range(6):
        paths = [f"{rng.choice('abc')}/{rng.choice('xy')}/f.{rng.choice(['py', 'js'])}" for _ in range(rng.randint(3, 14))]
        data += [(q, i + 1, f"{q}-{i}", p) for i, p in enumerate(paths)]
        items = list(enumerate(paths))
        if len(items) > 8:
            groups = {}
            for i, p in items:
                groups.setdefault((p.split(".")[-1], p.rsplit("/", 1)[0]), []).append(i)
            picked, queues = [], list(groups.values())
            while len(picked) < 8 and any(queues):
                for g in queues:
                    if g and len(picked) < 8:
                        picked.append(g.pop(0))
        else:
            picked = [i for i, _ in items]
        want += [(q, n + 1, f"{q}-{i}") for n, i in enumerate(picked)]
    df = spark.createDataFrame(data, "query_id int, rank int, id string, file_path string")
    assert rows(windows.round_robin(df, 8), "query_id", "position", "id") == sorted(want)


def test_knn_both_forms_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 8)).round(1)
    vecs[20:40] = vecs[20]  # a third of the vectors are copies of one
    vecs[5] = 0
    v = spark.createDataFrame([(f"v{i:02d}", [float(x) for x in r], i % 3) for i, r in enumerate(vecs)],
                              "id string, embedding array<double>, grp int")
    q = v.select(F.col("id").alias("query_id"), "embedding", F.when(F.col("grp") == 1, F.col("grp")).alias("want"))
    unit = vecs / np.where(np.linalg.norm(vecs, axis=1, keepdims=True) > 0, np.linalg.norm(vecs, axis=1, keepdims=True), 1)
    want = []
    for i in range(60):
        ok = [j for j in range(60) if i % 3 != 1 or j % 3 == 1]
        best = sorted(ok, key=lambda j: (-round(float(unit[i] @ unit[j]), 6), f"v{j:02d}"))[:7]
        want += [(f"v{i:02d}", n + 1, f"v{j:02d}") for n, j in enumerate(best)]
    for blocks in (False, True):
        got = knn.cosine_topk(q, v, 7, equal=[("want", "grp")], force_blocks=blocks)
        assert rows(got, "query_id", "rank", "id") == sorted(want)


def _merge_loop(found):
    spec = N.SPECIFICITY
    found = sorted(found, key=lambda e: (e[0], e[1]))
    out, cur = [], found[0]
    for e in found[1:]:
        if not (cur[2] <= e[0] or e[2] <= cur[0]):
            if (e[5] > cur[5]) if e[5] != cur[5] else spec.get(e[4], 0) > spec.get(cur[4], 0):
                cur = e
        else:
            out.append(cur)
            cur = e
    return out + [cur]


def test_entity_merge_equals_loop(spark):
    rng = random.Random(5)
    cases, want = [], []
    for q in range(12):
        found = []
        for s in range(rng.randint(1, 15)):
            start = rng.randint(0, 30)
            found.append((start, s, start + rng.randint(1, 8), f"t{s}", rng.choice(["function", "class", "api", "file"]),
                          rng.choice([0.7, 0.8, 0.9]), []))
        cases.append((q, found))
        want += [(q, e[3]) for e in _merge_loop(found)]
    df = spark.createDataFrame(cases, f"query_id int, f array<{ner.ENTITY}>")
    got = df.select("query_id", F.inline(ner.merge(F.col("f"))))
    assert rows(got, "query_id", "text") == sorted(want)


def test_pattern_offsets(spark):
    text = "def load( then Python and load( again in main.py"
    df = spark.createDataFrame([(1, text)], "query_id int, query string")
    got = df.select(F.inline(ner.pattern_entities(F.col("query")))).collect()
    for r in got:
        assert r["text"].lower() in text[r["start_pos"]: r["end_pos"]].lower()
    assert [(r["start_pos"], r["end_pos"]) for r in got if r["type"] == "technology"] == [(15, 21)]
    assert [r["start_pos"] for r in got if r["text"] == "load"] == [4, 26, 0]


def test_containment_parent_equals_loop(spark):
    rng = random.Random(7)
    data = []
    for f in range(5):
        for n in range(12):
            start = rng.randint(1, 30)
            data.append((f"f{f}", start, n, start + rng.randint(0, 20), f"{f}.{n}"))
    df = spark.createDataFrame(data, "file_path string, start_line int, list_no int, end_line int, id string")
    want = []
    for f in range(5):
        chunks = sorted((r for r in data if r[0] == f"f{f}"), key=lambda r: (r[1], r[2]))
        for i, c in enumerate(chunks):
            best = None
            for p in chunks[:i]:
                if p[3] >= c[3] and (best is None or p[3] - p[1] < best[3] - best[1]):
                    best = p
            if best:
                want.append((c[4], best[4]))
    assert rows(relate.containment_parent(df), "id", "parent_id") == sorted(want)


def test_assign_unique_equals_loop(spark):
    rng = random.Random(9)
    folders = ["app/models", "auth", "docs", "tests", "config", "lib/utils", "api/rest"]
    data, picked, want = [], [], []
    for q in range(3):
        chunks = [(f"{q}-{i}", rng.choice(folders) + "/x.md") for i in range(20 + 30 * q)]
        data += [(q, i + 1, cid, p, "text") for i, (cid, p) in enumerate(chunks)]
        order = rng.sample(R.ROLES, 4)
        picked += [(q, n + 1, r) for n, r in enumerate(order)]
        share = max(15, len(chunks) // 4) if len(chunks) >= 60 else max(3, len(chunks) // 4)
        area = {cid: next((a for a, w in A.AREA_PATH if any(x in p for x in w)), "other") for cid, p in chunks}
        used = set()
        for role in order:
            liked = R.ROLE_AREAS[role]
            ranked = [c for a in liked for c, _ in chunks if area[c] == a]
            ranked += [c for a in A.AREA_ORDER if a not in liked for c, _ in chunks if area[c] == a]
            mine = [c for c in ranked if c not in used][:share]
            used |= set(mine)
            want += [(q, role, n + 1, c) for n, c in enumerate(mine)]
    results = spark.createDataFrame(data, "query_id int, rank int, id string, file_path string, content string")
    selected = spark.createDataFrame(picked, "query_id int, position int, role string")
    got = roles.assign_unique(selected, results, turns=4)
    assert rows(got, "query_id", "role", "place", "id") == sorted(want)


def test_role_retrieval_equals_loop(spark):
    rng = random.Random(11)
    names = R.ROLES[:4]
    first, plain, want = [], [], []
    for q in range(4):
        used = set()
        for n, role in enumerate(names):
            a = rng.sample(range(20), rng.randint(2, 9))
            b = rng.sample(range(20), 12)
            first += [(q, role, i + 1, f"c{x}") for i, x in enumerate(a)]
            plain += [(q, role, i + 1, f"c{x}") for i, x in enumerate(b)]
            size = 4
            got = [x for x in a[: 2 * size] if x not in used][:size]
            if len(got) < max(5, size // 2):
                extra = [x for x in b[: 3 * size] if x not in used][:size]
                got += [x for x in extra if x not in got]
            got = got[:size]
            used |= set(got)
            want += [(q, n + 1, role, f"c{x}") for x in got]
    schema = "query_id int, role string, rank int, id string"
    tasks = spark.createDataFrame([(q, n + 1, r, 4) for q in range(4) for n, r in enumerate(names)],
                                  "query_id int, position int, role string, chunks_needed int")
    got = roles.role_retrieval(tasks, spark.createDataFrame(first, schema), spark.createDataFrame(plain, schema), 4, minimum=4)
    assert rows(got, "query_id", "position", "role", "id") == sorted(want)


def test_paths_equal_full_enumeration(spark):
    rng = random.Random(13)
    edges = {(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}", rng.choice(["CALLS", "IMPORTS"])) for _ in range(30)}
    edges |= {("n0", f"h{i:02d}", "CALLS") for i in range(40)} | {("n1", "n0", "CALLS"), ("z", "n1", "CALLS")}
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, rel string, weight double")
    starts = sorted({e[0] for e in edges})
    want = []
    for s in starts:
        level, found = [((s,), ())], []
        for _ in range(3):
            level = [(p + (d,), u + ((a, d, r),)) for p, u in level for a, d, r in edges if a == p[-1] and (a, d, r) not in u]
            found += sorted((len(p), p, u) for p, u in level if p[-1] != s)
        want += [(s, n + 1, ">".join(p)) for n, (_, p, _) in enumerate(sorted(found, key=lambda x: (x[0], x[1]))[:5])]
    seeds = spark.createDataFrame([(s, s) for s in starts], "query_id string, id string")
    got = graph.paths(df, seeds).withColumn("path", F.array_join("path", ">"))
    assert rows(got, "id", "path_no", "path") == sorted(want)


def test_keyword_search_equals_loop(spark):
    rng = random.Random(17)
    vocab = ["load", "a", "parse", "on", "parser", "x.py", "the", "main"]
    chunks = [(f"c{i:02d}", " ".join(rng.choices(vocab, k=6)), f"src/{rng.choice(vocab)}", rng.choice(vocab)) for i in range(25)]
    qs = [(i, " ".join(rng.choices(vocab, k=4))) for i in range(9)]
    want = []
    for q, text in qs:
        scored = []
        for cid, content, path, name in chunks:
            s = sum((w in content) + 2 * (w in path) + 3 * (w in name) for w in text.split())
            if s:
                scored.append((-min(s, 10), cid))
        want += [(q, n + 1, cid) for n, (_, cid) in enumerate(sorted(scored)[:4])]
    c = spark.createDataFrame(chunks, "id string, content string, file_path string, name string")
    q = spark.createDataFrame(qs, "query_id int, query string")
    assert rows(rank.keyword_search(q, c, 4), "query_id", "rank", "id") == sorted(want)
    assert rows(rank.keyword_search(q, c, 4, max_words=0), "query_id", "rank", "id") == sorted(want)


def test_substring_join_equals_loop(spark):
    texts = [(1, "abcabd"), (2, "xx yé z"), (3, ""), (4, "b"), (5, "a  b\tc"), (5, "ab"), (6, None)]
    words = ["ab", "b", "yé", "abd", "q", "xx yé z", " ", "  ", "b\tc", "", "a b"]
    want = sorted({(k, w) for k, t in texts for w in words if w and w in (t or "")})
    for shared in (0, filters.SHARED_PATTERNS):
        got = rows(filters.substring_join(spark.createDataFrame(texts, "k int, t string"), "k", "t",
                                          spark.createDataFrame([(w,) for w in words + ["ab"]], "w string"), "w", shared), "k", "w")
        assert got == want


def test_paths_with_many_relationship_kinds(spark):
    """Twenty kinds of edges back to the start do not push out the paths that count."""
    edges = [("a", "b", "CALLS")] + [("b", "a", f"R{i:02}") for i in range(20)] + [("b", f"z{i}", "CALLS") for i in range(5)]
    df = spark.createDataFrame(edges, "src string, dst string, rel string")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, id string")
    got = [tuple(r["path"]) for r in graph.paths(df, seeds).orderBy("path_no").collect()]
    assert got == [("a", "b")] + [("a", "b", f"z{i}") for i in range(4)]


def test_round_robin_with_a_limit_per_list(spark):
    data = [(q, i + 1, f"{q}-{i}", f"d{i % 3}/f.py") for q in range(3) for i in range(9)]
    df = spark.createDataFrame(data, "query_id int, rank int, id string, file_path string").withColumn(
        "most", F.col("query_id") + 2)
    got = rows(windows.round_robin(df, F.col("most")), "query_id", "position", "id")
    assert got == [(q, p, i) for q in range(3)
                   for _, p, i in rows(windows.round_robin(df.filter(F.col("query_id") == q), q + 2), "query_id", "position", "id")]


def test_running_mean_and_sum(spark):
    rng = random.Random(19)
    stamps = sorted(rng.randint(0, 50_000) for _ in range(60))
    data = [(i, t, float(rng.randint(0, 9))) for i, t in enumerate(stamps)]
    df = spark.createDataFrame(data, "id int, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r for r in windows.running_sum(windows.running_mean(df, "ts", "id", "v"), "ts", ["id"], "v", "total").collect()}
    total = 0.0
    for n, (i, _, v) in enumerate(data, 1):
        total += v
        assert abs(got[i]["total"] - total) < 1e-9 and abs(got[i]["running_mean"] - total / n) < 1e-9
