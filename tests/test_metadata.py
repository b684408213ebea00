"""Metadata maps: merging, JSON text and back."""

from pyspark.sql import functions as F

from corpusgraph.functions import metadata as M

ODD = {"quote": 'a "b" \\ c', "line": "x\ny\t", "none": None, "empty": "", "é": "😀"}


def test_last_value_wins_and_text_comes_back(spark):
    rows = [(1, {"a": "1", "b": "2"}, {"b": "3", "c": None}), (2, None, {"x": "y"}), (3, ODD, None), (4, None, None),
            (5, {"b": "1"}, {"b": None})]
    df = spark.createDataFrame(rows, "id int, old map<string,string>, new map<string,string>")
    both = df.withColumn("m", M.merged(F.col("old"), F.col("new")))
    text = both.withColumn("t", M.encoded(F.col("m")))
    got = {r.id: (r.m, r.t, r.back) for r in text.withColumn("back", M.decoded(F.col("t"))).collect()}
    assert got[1][0] == {"a": "1", "b": "3", "c": None} and got[1][1] == '{"a":"1","b":"3","c":null}'
    assert got[5][0] == {"b": None} and got[4][1] == "{}" and got[2][0] == {"x": "y"}
    assert all(m == back for m, _, back in got.values()) and got[3][2] == ODD


def test_equal_maps_give_equal_texts(spark):
    df = spark.sql("SELECT map('b', '1', 'a', '2') AS x, map('a', '2', 'b', '1') AS y")
    assert df.select(M.encoded(F.col("x")) == M.encoded(F.col("y"))).first()[0]


def test_given_json(spark):
    df = spark.createDataFrame([('{"k": 69, "s": "t"}',), ("broken {",), (None,), ("{}",)], "t string")
    assert [r[0] for r in df.select(M.decoded(F.col("t"))).collect()] == [{"k": "69", "s": "t"}, {}, {}, {}]
