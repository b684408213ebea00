import re

from corpusgraph.llm import licenses

_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = _WORD.findall((text or "").translate(_LOWER))
    places = []
    for label, phrase, _ in licenses.TEMPLATES[:3]:
        p = phrase.split(" ")
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
    places.sort()
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x for _, x in places})))


def test_base_places_equal_brute_force(spark, documents, messy):
    extra = [(900, "CC BY cc-by. All RIGHTS\nreserved general public license general public", None),
             (901, "cc cc by by all all rights reserved reserved ﬁ general", None),
             (902, "Released under the MIT License", None), (903, "cc by " * 5000, None), (904, "mit" + "é license", None)]
    df = documents.select("doc_id", "text", "word").unionByName(
        spark.createDataFrame([(i, t, 0) for i, t, _ in extra], "doc_id long, text string, word int"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, text, _ in [*messy, *extra]:
        assert tuple(got[i])[1:6] == brute(text), i
    assert got[900].labels == "cc-by,gpl,reserved" and got[902].labels == "mit" and got[904].labels == ""
    assert 0 < got[902].score <= 1 and got[0].score == 0
    assert licenses.scan(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by")], "doc_id long, text string")
    assert [r.n_base for r in licenses.scan(df).collect()] == [1, 1, 1]
