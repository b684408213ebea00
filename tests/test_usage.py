"""Usage counts against plain sets; edges are counted once, however many queries select their ends."""

from pyspark.sql import functions as F

from corpusgraph.operators import stats
from corpusgraph.sources.derived import Data

FOLDER = "/root/testdata/sf0.001"


def _expected(edges, chunks, selection):
    groups = {}
    for q, i in set(selection):
        for j, *key in chunks:
            if i == j:
                groups.setdefault((q, *key), set()).add(i)
    out = {}
    for at, ids in groups.items():
        calls, imports = ({s for s, d, r in edges if r == rel and d in ids and s is not None} for rel in ("CALLS", "IMPORTS"))
        out[at] = (len(calls), len(imports), len(calls) + len(imports))
    return out


def test_groups_callers_and_queries_equal_sets(spark, monkeypatch):
    # b and c are one group, d is in two groups, e has no name, f has no callers, ghost no chunk
    chunks = [("a", "n1", "f1", "function"), ("b", "n2", "f2", "function"), ("c", "n2", "f2", "function"), ("d", "n2", "f2", "function"),
              ("d", "n3", "f3", "class"), ("d", "n3", "f3", "class"), ("e", None, "f2", "function"), ("f", "n4", "f4", "module"),
              ("g", "n1", "f1", "function")]
    edges = [(f"s{i}", d, rel) for i in range(20) for j, d in enumerate("abcdeg") for rel in ("CALLS", "IMPORTS", "CHILD_OF")
             if (i * (j + 2) + len(rel)) % 3 == 0]
    edges += [("s1", "b", "CALLS"), ("s1", "c", "CALLS"), ("s1", "c", "CALLS"), (None, "b", "CALLS"), ("s1", "ghost", "CALLS")]
    selection = [(q, i) for q in range(12) for k, i in enumerate([*"abcdefg", "ghost"]) if (q + k) % 3 or q == 0]
    selection += selection[:5]
    kept = {}
    real = stats.materialize
    monkeypatch.setattr(stats, "materialize", lambda df, label="step": kept.setdefault(label, real(df, label)))
    got = stats.usage_counts(spark.createDataFrame(edges, "src string, dst string, rel string"),
                             spark.createDataFrame(chunks, "id string, name string, file_path string, node_type string"),
                             spark.createDataFrame(selection, "query_id bigint, id string")).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got} == _expected(edges, chunks, selection)
    assert len(got) == len(_expected(edges, chunks, selection))
    # callers are counted by group, not by query: twelve queries ask
    pairs = {(key[1:], s, r) for key in {(0, *c) for c in chunks} for s, d, r in edges if s is not None and r in ("CALLS", "IMPORTS")
             for c in chunks if (0, *c)[2:] == key[2:] and c[0] == d}
    assert kept["callers"].count() <= len(pairs)


def test_uses_are_the_calls_and_imports_of_edges(spark):
    d = Data(spark, FOLDER)
    cols = ["src", "dst", "rel"]
    want = d.edges.filter(F.col("rel").isin("CALLS", "IMPORTS")).select(*cols)
    assert want.count() == d.uses.distinct().count()
    assert want.exceptAll(d.uses.distinct()).isEmpty()
    nodes = d.nodes.filter(F.substring("id", 1, 1).isin("p", "s")).select(*d.used_nodes.columns)
    assert nodes.count() == d.used_nodes.count() and nodes.exceptAll(d.used_nodes).isEmpty()
