"""Hand-computed results for small literal inputs."""

from pyspark.sql import functions as F

from corpusgraph.functions import chunks as C
from corpusgraph.operators import embed, graph, outline, questions, rank, relate, stats
from corpusgraph.sources import scan

SAMPLE = '''
def hello_world():
    """Say hello."""
    print("Hello")
    return True

class TestClass:
    """A class."""

    def __init__(self):
        self.value = 42

    def get_value(self):
        """Get it."""
        return self.value

    def call_hello(self):
        hello_world()
        return None
'''


def test_python_outline(spark):
    files = spark.createDataFrame([("sample.py", "p", "python", SAMPLE)], "path string, project_id string, language string, content string")
    got = outline.outline(files)
    rows = {r["name"]: (r["node_type"].split("_")[0], r["start_line"], r["end_line"]) for r in got.collect()}
    assert rows == {
        "hello_world": ("function", 2, 6), "TestClass": ("class", 7, 20), "__init__": ("function", 10, 12),
        "get_value": ("function", 13, 16), "call_hello": ("function", 17, 20)}
    names = {r["id"]: r["name"] for r in got.collect()}
    parents = {names[r["id"]]: names[r["parent_id"]] for r in relate.containment_parent(got).collect()}
    assert parents == {n: "TestClass" for n in ("__init__", "get_value", "call_hello")}
    calls = relate.calls_in_file(outline.call_sites(got), got).collect()
    assert [(names[r["caller_id"]], names[r["callee_id"]]) for r in calls] == [("call_hello", "hello_world")]


def test_brace_outline(spark):
    ts = "import x from 'y';\nclass MainApp {\n  run(a: string) {\n    console.log(a);\n  }\n}\n"
    files = spark.createDataFrame([("main.ts", "p", "typescript", ts)], "path string, project_id string, language string, content string")
    rows = sorted((r["name"], r["start_line"], r["end_line"]) for r in outline.outline(files).collect())
    assert rows == [("MainApp", 2, 6), ("run", 3, 5)]


def test_scan_tree(spark, tmp_path):
    for name in ("main.js", "src/utils.ts", "node_modules/a.js", "build/b.py", "notes.txt", "src/.venv/c.py"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("function f() {}")
    got = scan.scan_tree(spark, f"file:{tmp_path}", "p")
    assert sorted((r["path"], r["language"]) for r in got.collect()) == [("main.js", "javascript"), ("src/utils.ts", "typescript")]


def test_intents(spark):
    df = spark.createDataFrame([(1, "find authentication functions"), (2, "What is this code?"), (3, "zzz")], "query_id int, query string")
    got = {r["query_id"]: (r["intent"], r["intent_confidence"]) for r in questions.classify_intent(df).collect()}
    assert got == {1: ("implementation", 0.2), 2: ("implementation", 0.2), 3: ("search", 0.5)}


def test_abstract_and_complexity(spark):
    texts = ["Analyze the architecture and security of this system", "Show me the main function",
             "How does the search functionality work?", "Explain the database connection logic",
             "Compare the frontend and backend architectures"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query string")
    got = df.select("query_id", questions.is_abstract(F.col("query")).alias("a"),
                    questions.complexity_by_words(F.col("query"), F.lit(0)).alias("c")).orderBy("query_id").collect()
    assert got[0]["a"] is True
    assert [r["c"] for r in got[1:]] == ["simple", "simple", "moderate", "complex"]


def test_fusion(spark):
    hits = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "A", 0.7), (1, 1, "B", 0.95)], "query_id int, term_idx int, id string, score double")
    plain = {r["id"]: round(r["score"], 6) for r in rank.fuse(hits, 10).collect()}
    assert plain == {"A": 1.3, "B": 0.95}
    abstract = spark.createDataFrame([(1, True)], "query_id int, is_abstract boolean")
    assert {r["id"]: round(r["score"], 6) for r in rank.fuse(hits, 10, abstract).collect()} == {"A": 1.45, "B": 0.95}


def test_graph_and_path_scores(spark):
    rels = spark.createDataFrame([(1, "a", "b", "CALLS", 1.0), (1, "a", "c", "CALLS", 0.5), (1, "d", "a", "CALLS", 0.5)],
                                 "query_id int, src string, dst string, rel string, weight double")
    got = {r["id"]: round(r["graph_score"], 6) for r in graph.graph_score(rels).collect()}
    assert got["a"] == 0.433333
    walks = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b", "c"])], "query_id int, path array<string>")
    got = {r["id"]: round(r["path_score"], 6) for r in graph.path_score(walks).collect()}
    assert got == {"a": 0.833333, "b": 0.833333, "c": 0.333333}


def test_bands_and_complexity_score(spark):
    labels = [r["x"].split()[0] for r in spark.createDataFrame([(10,), (5,), (2,), (1,)], "n int").select(
        stats.usage_category(F.col("n")).alias("x")).collect()]
    assert labels == ["High", "Medium", "Low", "Minimal"]
    conf = spark.createDataFrame([(v,) for v in (0.95, 0.85, 0.75, 0.65, 0.55, 0.2)], "v double")
    assert [r["x"] for r in conf.select(C.confidence_label(F.col("v")).alias("x")).collect()] == [
        "Very High", "High", "Good", "Moderate", "Fair", "Low"]
    chunks = spark.createDataFrame([("1", "f1", "t"), ("2", "f1", "t"), ("3", "f2", "t"), ("4", "f2", "u")], "id string, file_path string, node_type string")
    sel = spark.createDataFrame([(1, "1"), (1, "3")], "query_id int, id string")
    r = stats.complexity(chunks, sel).first()
    assert (r["complexity_score"], r["complexity_level"], r["organization_entropy"]) == (0.63, "Low", -0.77)


def test_query_log(spark):
    log = spark.createDataFrame([(2.3, False, 0.5), (0.001, True, 0.5), (2.1, False, 0.5), (0.001, True, 0.5)],
                                "response_time double, cache_hit boolean, confidence double")
    r = stats.query_log_metrics(log).first()
    assert (r["total_queries"], r["hit_rate"], round(r["mean_response_time"], 4)) == (4, 50.0, 1.1005)


def test_report_sections(spark):
    text = ("intro\n### EXECUTIVE SUMMARY: short\n### DETAILED ANALYSIS:\nline one\n\n line two\n### KEY INSIGHTS:\n- first:\n• second\n"
            "plain\n* third\n- fourth\n### RECOMMENDATIONS:\n1. do this\n4. not this\n2. do that:\n### CONFIDENCE: High\n### FOCUS AREAS:\n- tests\n- docs\n- more")
    df = spark.createDataFrame([(1, text), (2, "no sections")], "id int, text string")
    a, b = questions.parse_sections(df).orderBy("id").collect()
    assert a["analysis"] == "line one\nline two" and a["insights"] == ["first", "second", "third"]
    assert a["recs"] == ["do this", "do that"] and a["confidence"] == 0.8 and a["focus"] == ["tests", "docs"]
    assert b["analysis"] == "Analysis not provided" and b["insights"] == [] and b["confidence"] == 0.6


def test_embedding_hook(spark):
    def broken():
        def fn(texts):
            raise RuntimeError("down")

        return fn

    df = spark.createDataFrame([(1, "load the parser"), (2, "load the parser"), (3, "")], "id int, text string")
    assert all(r["embedding"] == [0.0] * 4 for r in embed.embed(df, "id", "text", broken, 4).collect())
    got = {r["id"]: r["embedding"] for r in embed.hash_embed(df, "id", "text", 32).collect()}
    assert got[1] == got[2] and len(got[1]) == 32 and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    assert sum(got[3]) == 0
