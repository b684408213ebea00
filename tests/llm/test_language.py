from corpusgraph.llm import language


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language.fit(docs.filter(~language.held_out()))
    found = language.predict(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out())
    rows = found.collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 $$"), (4, "a"), (None, "the"), (5, "漢字"), (5, "漢字")],
                                "doc_id long, text string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.predict(odd, filters).collect())
    assert [x for x in got if x[1] == "und"] == [("1", "und"), ("2", "und"), ("3", "und")] and len(got) == 7
    assert language.predict(odd.limit(0), filters).count() == 0


def test_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    filters = language.fit(rows)
    assert [tuple(r) for r in language.predict(rows, filters).collect()] == [(1, "und", 0.0)]


def test_bitmask_equals_sets_of_ngrams(spark):
    """The filter returns at least the languages whose set holds the n-gram."""
    import numpy as np

    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abcd abcd", "x"), ("abcd efgh", "y"), ("zzzz", "z")] * 4)]
    filters = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    data = np.frombuffer(b"abcd", np.uint8)
    row, value, _ = language.grams(data, np.array([0, 4]))
    mask = np.full(len(value), 0xFFFFFFFF, np.uint32)
    for at in language._positions(value):
        mask &= filters.bits[at][:, 0]
    assert filters.languages == ["x", "y", "z"] and ((mask & 3) == 3).all() and not (mask & 4).any()


def test_rejection_keeps_columns_and_clean_documents(documents):
    kept = language.keep_identified(documents)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert set(range(60)) <= ids and not ids & {300, 301, 302, 303}
