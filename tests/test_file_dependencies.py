"""Links between files against plain counts; ids and files that nothing can meet are not shuffled, reports share their steps."""

import random
from collections import Counter

import pytest

from corpusgraph.operators import filters, stats

CHUNKS = "id string, name string, file_path string, node_type string"
EDGES = "src string, dst string, rel string, weight double"
SELECTION = "query_id bigint, id string"


def _shuffled(node) -> int:
    own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
    kids = node.children()
    return own + sum(_shuffled(kids.apply(i)) for i in range(kids.size()))


@pytest.mark.parametrize("most", [0, 64])
def test_pairs_equal_counts(spark, monkeypatch, most):
    monkeypatch.setattr(filters, "MOST_INITIALS", most)
    pick = random.Random(9)
    chunks = [(f"{k}{i}", f"n{i}", f"{k}/f{i % 4}.py", "function") for k in "abx" for i in range(10)]
    chunks += [("a1", "again", "b/f1.py", "class")]
    edges = [(pick.choice(chunks)[0], pick.choice(chunks)[0], pick.choice(["CALLS", "IMPORTS", "CHILD_OF"]), 0.5) for _ in range(400)]
    selection = [(q, pick.choice([c[0] for c in chunks if c[0][0] != "x"])) for q in range(5) for _ in range(4)]
    files = {(q, c[2]) for q, i in selection for c in chunks if c[0] == i}
    count = Counter()
    for s, d, rel, _ in edges:
        for a in (c[2] for c in chunks if c[0] == s and rel != "CHILD_OF"):
            for b in (c[2] for c in chunks if c[0] == d):
                for q in range(5):
                    count[q, a, b] += ((q, a) in files) + (a != b and (q, b) in files)
    want = []
    for q in range(5):
        best = sorted((-n, a, b) for (p, a, b), n in count.items() if p == q and n)[:15]
        want += [(q, r, a, b, -n) for r, (n, a, b) in enumerate(best, 1)]
    got = stats.file_dependencies(*[spark.createDataFrame(*x) for x in ((edges, EDGES), (chunks, CHUNKS), (selection, SELECTION))])
    cols = ["query_id", "rank", "source_file", "target_file", "strength"]
    assert sorted(map(tuple, got.select(*cols).collect())) == want


def test_what_nothing_can_meet_is_not_shuffled(spark):
    chunks = [(f"a{i}", f"n{i}", f"f{i % 5}.py", "function") for i in range(50)] + [(f"x{i}", "x", f"lines/{i}.py", "method") for i in range(5000)]
    edges = [(f"a{i}", f"a{i * 7 % 50}", "CALLS", 0.5) for i in range(50)]
    frames = [spark.createDataFrame(*x) for x in ((edges, EDGES), (chunks, CHUNKS), ([(1, f"a{i}") for i in range(9)], SELECTION))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stats.file_dependencies(*frames)
        found.collect()
        assert _shuffled(found._jdf.queryExecution().executedPlan()) < 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_share_their_steps(spark, monkeypatch):
    chunks = [(f"a{i}", f"n{i}", f"f{i % 5}.py", "function" if i % 2 else "class") for i in range(50)]
    edges = [(f"a{i}", f"a{i * 7 % 50}", "CALLS", 0.5) for i in range(50)]
    frames = [spark.createDataFrame(*x) for x in ((edges, EDGES), (chunks, CHUNKS), ([(1, f"a{i}") for i in range(9)], SELECTION))]
    made = Counter()
    real = stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df, label="step": made.update([label]) or real(df, label))
    reports = {k: sorted(map(str, v.collect())) for k, v in stats.comprehensive_context(*frames).items()}
    assert made["files"] == made["file-types"] == made["dependencies"] == made["overview"] == 1
    assert reports["system_overview"] == sorted(map(str, stats.system_overview(*frames[1:]).collect()))
    assert reports["system_complexity"] == sorted(map(str, stats.complexity(*frames[1:]).collect()))
    assert reports["file_dependencies"] == sorted(map(str, stats.file_dependencies(*frames).collect()))
