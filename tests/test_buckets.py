"""Stored tables: changes against plain dictionaries, replays, broken-off writes, untouched files, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import outline
from corpusgraph.session import run_dir
from corpusgraph.sources import buckets, store
from corpusgraph.streaming import progress as P

SCHEMA = "id string, file_path string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(table):
    found = {}
    for base, _, names in os.walk(table.path + "/data"):
        found |= {os.path.join(base, n): os.path.getmtime(os.path.join(base, n)) for n in names if n.endswith(".parquet")}
    return found


@pytest.fixture
def table(spark):
    data = [(f"i{k}", f"f{k // 3}", k) for k in range(60)] + [("i100", "hot", k) for k in range(3)] + [(None, "f1", 0), ("x", None, 1)]
    made = buckets.create(spark.createDataFrame(data, SCHEMA), run_dir(spark, "table"), "file_path", 16)
    return made, data


def merged(data, new):
    paths, ids = {r[1] for r in new} - {None}, {r[0] for r in new} - {None}
    return [r for r in data if r[1] not in paths and r[0] not in ids] + new


def test_two_batches_a_replay_and_an_older_version(spark, table):
    t, data = table
    assert rows(t.read()) == sorted(data, key=str)
    one = [("i7", "f9", 1000), ("new", "f2", 1001), ("y", None, 5)]
    two = [("i50", "f2", 1), ("i51", "f3", 2)]
    before = files(t)
    t.merge(spark.createDataFrame(one, SCHEMA), ["file_path", "id"], writer="w", batch=0)
    want = merged(data, one)
    assert rows(t.read()) == sorted(want, key=str)
    # old files stay; new ones hold touched buckets only: of f2, f9, of the null, and of f2 (where i7 was)
    added = set(files(t)) - set(before)
    assert set(before) <= set(files(t)) and len({os.path.dirname(p) for p in added}) <= 4
    store.store_by_file(t, spark.createDataFrame(two, SCHEMA), batch=0)
    want2 = merged(want, two)
    again = t.merge(spark.createDataFrame([("z", "f3", 9)], SCHEMA), ["file_path"], writer="w", batch=0)  # a replay
    assert again.version == t.manifest().version and rows(t.read()) == sorted(want2, key=str)
    assert rows(t.read(0)) == sorted(data, key=str) and rows(t.read(1)) == sorted(want, key=str)
    fresh = buckets.BucketTable(spark, t.path, t.schema, "file_path", 16)  # another session
    assert rows(fresh.read()) == sorted(want2, key=str) and fresh.versions() == [0, 1, 2]


def test_a_change_that_is_broken_off_does_not_count(spark, table, monkeypatch):
    t, data = table
    new = spark.createDataFrame([("i1", "f0", -1)], SCHEMA)

    def fail(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(t, "_commit", fail)
        with pytest.raises(RuntimeError):
            t.merge(new, ["file_path"], batch=0)
    assert rows(t.read()) == sorted(data, key=str)
    t.merge(new, ["file_path"], batch=0)
    assert rows(t.read()) == sorted([r for r in data if r[1] != "f0"] + [("i1", "f0", -1)], key=str)


def test_detach_hides_edges_without_rewriting(spark):
    data = [(f"n{a}", f"n{b}", "CALLS") for a in range(12) for b in range(12) if (a * b) % 5 == 1] + [(None, "n3", "CALLS")]
    df = spark.createDataFrame(data, "src string, dst string, rel string")
    t = buckets.create(df, run_dir(spark, "edges"), "src", 32)
    before = files(t)
    gone = {"n3", "n7"}
    ids = spark.createDataFrame([(g,) for g in gone] + [(None,)], "id string")
    store.detach_nodes(t, ids, batch=0)
    store.detach_nodes(t, ids, batch=0)
    want = sorted((r for r in data if not gone & set(r)), key=str)
    assert rows(t.read()) == want == rows(store.detach_delete(df, ids)) and files(t) == before
    # an edge that comes later is not hidden
    back = [("n3", "n4", "CALLS")]
    t.merge(spark.createDataFrame(back, df.schema), [])
    assert rows(t.read()) == sorted(want + back, key=str)
    hit = {p for p in files(t) if any(gone & set(r) for r in map(tuple, spark.read.parquet(p).select("src", "dst").collect()))}
    kept = set(files(t)) - hit
    t.compact()
    assert rows(t.read()) == sorted(want + back, key=str) and t.manifest().deletes == ()
    live = {f"{t.path}/data/at_version={v}/in_bucket={b}" for b, v in t.manifest().buckets.items()}
    assert all(os.path.dirname(p) in live or any(q.endswith(os.path.dirname(p).split("/")[-1]) for q in live) for p in kept)
    assert sum(v == t.manifest().version for v in t.manifest().buckets.values()) < len(t.manifest().buckets)


def test_vectors_without_embedding_are_skipped(spark):
    old = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [2.0])], "id string, n int, embedding array<double>")
    t = buckets.create(old, run_dir(spark, "vectors"), "id", 4)
    chunks = spark.createDataFrame([("b", 2), ("c", 2), ("d", 2)], "id string, n int")
    vectors = spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "id string, embedding array<double>")
    store.store_vectors(t, chunks, vectors, batch=5)
    assert rows(t.read()) == [("a", 1, [1.0]), ("b", 2, [3.0]), ("c", 2, [4.0])]
    assert rows(t.read()) == rows(store.upsert_vectors(old, chunks, vectors).select("id", "n", "embedding"))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    t = buckets.create(none, run_dir(spark, "table"), "id")
    assert t.read().count() == 0
    t.merge(none, ["id"], batch=0)
    t.delete(none.select("id"), ["id"])
    t.compact()
    t.merge(spark.createDataFrame([("a", "f", 1)], SCHEMA), ["id"])
    assert rows(t.read()) == [("a", "f", 1)] and rows(buckets.create(none, t.path, "id").read()) == []


def test_index_follows_files_over_restarts(spark):
    feed, folder = run_dir(spark, "feed"), run_dir(spark, "indexer")
    schema = "path string, project_id string, language string, content string"

    def add(*found):
        spark.createDataFrame(list(found), schema).coalesce(1).write.mode("append").parquet(feed)

    def py(path, *names):
        return path, "p", "python", "\n".join(f"def {n}():\n    pass\n" for n in names)

    add(py("a.py", "one", "two"), py("b.py", "three"))
    shape = outline.outline(spark.read.schema(schema).parquet(feed)).schema
    t = buckets.BucketTable(spark, run_dir(spark, "index"), shape, "file_path", 8)
    arriving = spark.readStream.schema(schema).parquet(feed)

    def names(df):
        return sorted((r.file_path, r.name) for r in df.select("file_path", "name").collect())

    assert names(P.incremental_index(arriving, outline.outline, t, folder)) == [("a.py", "one"), ("a.py", "two"), ("b.py", "three")]
    add(py("a.py", "two", "four"), py("b.py"))  # b.py has no chunks any more
    for _ in range(2):  # the second time nothing is new
        got = names(P.incremental_index(arriving, outline.outline, t, folder))
        assert got == [("a.py", "four"), ("a.py", "two")]
    assert t.versions() == [0, 1]
