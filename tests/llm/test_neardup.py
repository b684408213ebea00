import collections

import numpy as np

from corpusgraph.llm import neardup
from corpusgraph.llm.components import components
from corpusgraph.llm.shingles import shingles


def run_of(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    _, value, times = shingles(data, np.array([0, len(data)]))
    return value, times


def brute_classes(rows, idf, threshold=0.8):
    runs = {i: run_of(t) for i, t in rows}
    where = collections.defaultdict(list)
    for i, (value, _) in runs.items():
        for v in value.tolist():
            where[v].append(i)
    parent = {i: i for i in runs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(a, b) for docs in where.values() for a in docs for b in docs if a < b}
    for a, b in pairs:
        if neardup.similarity(runs[a], runs[b], idf) >= threshold:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return {i: top(i) for i in runs}


def test_classes_equal_brute_force(documents, messy):
    got = {r.doc_id: r.class_id for r in neardup.classes(documents).collect()}
    assert got == brute_classes([(i, t) for i, t, _ in messy], neardup.idf_table(documents))


def test_salted_buckets_still_join(documents, messy):
    got = {r.doc_id: r.class_id for r in neardup.classes(documents, bucket=2).collect()}
    assert {got[i] for i in (*range(200, 204), *range(210, 214))} == {200}
    assert len({got[i] for i in range(60)}) == 60


def test_words_and_shingles_equal_plain_python(messy):
    for _, text, _ in messy:
        text = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or ""))
        words = "".join(c.lower() if c.isascii() else c for c in text).split(" ")
        words = [w for w in words if w]
        grams = [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        _, times = run_of(text)
        assert sorted(times.tolist()) == sorted(collections.Counter(grams).values())


def test_proposals_never_list_all_pairs():
    sample = np.tile(np.arange(neardup.SAMPLES, dtype=np.uint32), (200, 1))
    pairs, cluster = neardup.propose(np.arange(200), sample)
    assert len(pairs) == 199 and set(cluster) == {0}


def test_consistent_samples_agree_like_weighted_jaccard():
    rng = np.random.default_rng(1)
    value = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    weight_a, weight_b = rng.uniform(1, 5, 400), rng.uniform(1, 5, 400)
    hits = []
    for turn in range(30):
        shifted = value ^ np.uint64(turn << 40)
        order = np.argsort(shifted)
        a = neardup._samples(np.zeros(400, int), shifted[order], weight_a[order])[1]
        b = neardup._samples(np.zeros(400, int), shifted[order], weight_b[order])[1]
        hits.append((a == b).mean())
    truth = np.minimum(weight_a, weight_b).sum() / np.maximum(weight_a, weight_b).sum()
    assert abs(np.mean(hits) - truth) < 0.06


def test_keep_one_and_edge_rows(spark, documents):
    kept = neardup.keep_one(documents)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {200, 300, 301, 302, 303, 321} <= ids and not ids & {201, 202, 203, 210, 211, 212, 213, 322}
    df = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "one two three")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in neardup.keep_one(df).collect()) == ["1", "None"]
    assert neardup.classes(df.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def star(copies, edits, seed=3):
    """A base text and copies with edits of their own: each close to the base, less close to each other."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(300)]
    rows = [(copies // 2, " ".join(base))]
    for i in range(copies + 1):
        if i != copies // 2:
            words = list(base)
            for at in rng.choice(np.arange(5, 295), edits, replace=False):
                words[at] = f"n{i}x{at}"
            rows.append((i, " ".join(words)))
    return rows


def truth(rows, idf, threshold=0.8):
    """(class, number of links) of each row by all pairs."""
    runs = [run_of(t) for _, t in rows]
    near = np.triu(np.ones((len(rows), len(rows)), bool), 1)
    found = np.zeros_like(near)
    for i, j in zip(*np.nonzero(near)):
        found[i, j] = neardup.similarity(runs[i], runs[j], idf) >= threshold
    ids, number = [i for i, _ in rows], found.sum(0) + found.sum(1)
    classes = brute_classes(rows, idf, threshold)
    return {i: (classes[i], int(k)) for i, k in zip(ids, number)}


def test_every_copy_of_a_star_finds_its_base(spark):
    rows = star(240, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = truth(rows, neardup.idf_table(df))
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(df).collect()}
    linked = [i for i, (_, k) in want.items() if k]
    # banding: a pair of similarity 0.8 meets with probability 0.998
    assert len(linked) > 200 and sum(got[i] != want[i] for i in linked) <= 2


def test_all_parts_of_a_hot_bucket_meet(spark):
    rows = star(240, 1, seed=8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(df).collect()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(df, bucket=20).collect()} == whole


def test_chunks_of_a_cluster_meet(spark, monkeypatch):
    rows = star(60, 1, seed=9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    nodes = [(i, None) for i, _ in rows]
    runs = [run_of(t) for _, t in rows]
    sample = np.stack([neardup._samples(np.zeros(len(v), int), v, c * 1.0)[1][0] & np.uint64(0xFFFFFFFF) for v, c in runs])
    import pyarrow as pa

    ids = sorted(i for i, _ in nodes)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 61), pa.array([0] * 61), pa.array([0] * 61), pa.array(ids), pa.array([0] * 61),
         pa.array([False] * 61), pa.array([296] * 61), pa.array([s.astype("<u4").tobytes() for s in sample])],
        names=list("abcdefgh"))
    pairs = []
    for limit in (1 << 18, 3000):
        monkeypatch.setattr(neardup, "CHUNK", limit)
        met = []
        for out in neardup._bucket_pass([batch]):
            groups = {}
            for g, d, s, c, x in zip(*(k.to_pylist() for k in out.columns)):
                groups.setdefault(g, []).append((d, c, x))
            for g, members in groups.items():
                across = [np.array([m[1] for m in members])] if g.split(",")[2] == "1" else []
                near = neardup.candidates(np.array([m[0] for m in members]), neardup._matrix([m[2] for m in members]), 0, *across)
                met += [tuple(sorted((members[i][0], members[j][0]))) for i, j in zip(*np.nonzero(near))]
        assert len(met) == len(set(met))
        pairs.append(set(met))
    assert pairs[0] == pairs[1] and len(pairs[0]) > 1000
