"""Steps whose work or stored rows grew faster than their input, and results on tables that do not divide evenly."""

import random

import duckdb
import pytest

import corpusgraph.plans.all_queries  # noqa: F401  (fills the catalog)
from corpusgraph.operators import graph
from corpusgraph.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("route", ["search", "flow", "enhanced", "stream"])
def test_last_query_with_fewer_terms_equals_sql(spark, tmp_path, route):
    rng = random.Random(3)
    (tmp_path / "embeddings.parquet").mkdir()
    spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], i % 3) for i in range(31)],
                          "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("overwrite").parquet(
        f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = f"ret3_multi_query_{route}"
    df = catalog.spark_queries()[name](spark, str(tmp_path))
    rel = con.execute(catalog.check_sql()[name])
    at = [[c[0] for c in rel.description].index(c) for c in df.columns]
    key = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(map(key, map(tuple, df.collect()))) == sorted(key([r[i] for i in at]) for r in rel.fetchall())


def _files(spark):
    # a large file, an id in two files together with another one, an id twice in one file, a null path
    places = [(f"a{i}", "big") for i in range(40)] + [("x", "f"), ("y", "f"), ("x", "g"), ("y", "g"), ("z", "g"), ("z", "g"),
                                                     ("n", None), ("m", None)]
    seeds = [(1, f"a{i}") for i in range(0, 40, 3)] + [(1, "x"), (2, "x"), (2, "x"), (2, "z"), (2, "n"), (3, "lost")]
    return (places, seeds, spark.createDataFrame(places, "id string, file_path string"),
            spark.createDataFrame(seeds, "query_id int, id string"))


def test_same_file_pairs_are_not_shuffled_again(spark):
    places, seeds, chunks, asked = _files(spark)
    want = {(q, s, b) for q, s in seeds for a, f in places for b, g in places if a == s and f and f == g and b != s}
    assert rows(graph.same_file(chunks, asked)) == sorted(want, key=str)
    single = graph.same_file(chunks.filter("id not in ('x', 'y')"), asked)
    assert "Aggregate" not in plan(single)
    assert rows(single) == sorted((r for r in want if not {"x", "y"} & {r[1], r[2]}), key=str)


def test_union_related_equals_loop(spark):
    places, seeds, chunks, asked = _files(spark)
    links = [("a0", "x", "CALLS"), ("x", "y", "CALLS"), ("y", "a3", "IMPORTS"), ("a3", "a6", "SIMILAR_TO"), ("x", "out", "CALLS"),
             ("a0", "a3", "CALLS"), ("z", "a0", "PARENT_OF"), ("n", "m", "CALLS")]
    edges = spark.createDataFrame([(*e, 1.0) for e in links], "src string, dst string, rel string, weight double")
    both = {(a, b, r) for s, t, r in links for a, b, r in ((s, t, r), (t, s, r))}
    walk = {(a, b) for a, b, r in both if r != "SIMILAR_TO"}
    like = {(a, b) for a, b, r in both if r == "SIMILAR_TO"}
    want = {(q, s, b) for q, s in seeds for a, b in walk | like if a == s}
    want |= {(q, s, c) for q, s in seeds for a, b in walk if a == s for x, c in walk if x == b}
    want |= {(q, s, b) for q, s in seeds for a, f in places for b, g in places if a == s and f and f == g}
    got = graph.union_related(edges, chunks, asked)
    assert rows(got) == sorted((r for r in want if r[1] != r[2]), key=str)
    assert plan(got).split("\n")[0].strip().startswith("Union") or "Union" in plan(got).split("HashAggregate")[0]


def test_list_texts_are_scored_once_for_all_questions(spark):
    from corpusgraph.operators import roles

    chunks = [(n, r, f"import security_{n} test class {r} database performance", f"src/{n}/app_test_{r}.py") for n in (0, 1) for r in range(1, 13)]
    asked = [(i, f"explain security of module {i}" if i % 2 else "database", i % 3) for i in range(30)]  # list 2 does not exist
    lists = spark.createDataFrame(chunks, "list_no int, rank int, content string, file_path string")
    queries = spark.createDataFrame(asked, "query_id long, query string, list_no int")
    got = roles.role_scores(queries, lists, key="list_no")
    copied = queries.select("query_id", "list_no").join(lists, "list_no").drop("list_no")
    assert rows(got) == rows(roles.role_scores(queries.select("query_id", "query"), copied))
    assert "content" not in plan(got) and got.count() == 30 * 12


def test_queries_with_the_same_names_share_their_seeds(spark, monkeypatch):
    chunks = spark.createDataFrame([(f"d{i}", f"call f{i % 4}()", f"f{i % 4}", f"p/{i % 3}.py") for i in range(24)],
                                   "id string, content string, name string, file_path string")
    edges = spark.createDataFrame([(f"d{i}", f"d{(i * 5 + 1) % 24}", "CALLS", 1.0) for i in range(24)],
                                  "src string, dst string, rel string, weight double")
    names = spark.createDataFrame([(q, f"f{(q + j) % 4}") for q in range(40) for j in range(2)] + [(50, "none"), (51, None)],
                                  "query_id long, name string")
    seen = []
    apart = graph.related_entities
    monkeypatch.setattr(graph, "related_entities", lambda e, c, s, limit=50: seen.append(s.count()) or apart(e, c, s, limit))
    got = rows(graph.related_to_names(edges, chunks, names, 8))
    seeds = graph.related_seeds(names, chunks)
    assert got == rows(apart(edges, chunks, seeds, 8).select("query_id", "rank", "id", "relevance"))
    assert seen[0] * 10 == seeds.count()


@pytest.mark.parametrize("double", [False, True])
def test_walk_up_a_tree_is_made_distinct_once(spark, monkeypatch, double):
    links = [(f"n{i}", f"n{i // 3}") for i in range(1, 40)] + [("n7", "n1"), ("n7", "n1"), ("n30", "x"), ("x", "n1")] * double
    edges = spark.createDataFrame([(*e, "CHILD_OF", 1.0) for e in links], "src string, dst string, rel string, weight double")
    seeds = [(q, f"n{i}") for q in (1, 2) for i in range(q, 40)] + [(1, "n8")] * 2
    plans = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="step": plans.append(plan(df)) or write(df, label))
    got = graph.ancestors(edges, spark.createDataFrame(seeds, "query_id int, id string"))
    want, front = set(), {(q, i, i) for q, i in seeds}
    for depth in range(1, 6):
        front = {(q, i, b) for q, i, at in front for a, b in links if a == at}
        want |= {(q, i, b, depth) for q, i, b in front}
    assert rows(got) == sorted(want, key=str)
    assert ["Aggregate" in p for p in plans] == [True] + [double] * 4
