import random

import corpus_pipeline
from pyspark.sql import functions as F

from corpusgraph.llm.all_queries import QUERIES

from .conftest import prose
from .test_neardup import brute_classes
from .test_suffix import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_entry_registers_all_operators():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(QUERIES) | {"pipeline"} <= names


def test_stages_decide_like_brute_force(spark, tmp_path):
    from corpusgraph.llm import neardup

    rng = random.Random(11)
    bench = [(k, " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(25))) for k in range(3)]
    rows = [(i, prose(rng, ("en", "de", "fr")[i % 3], 90), ("en", "de", "fr")[i % 3]) for i in range(90)]
    rows += [(100, rows[0][1], "en"), (101, rows[3][1] + " new", "en"), (102, "$$ %% 77", "en"), (103, None, None), (104, "", "en")]
    passage = prose(rng, "en", 60)
    rows += [(110 + i, f"{prose(rng, 'en', 80)} {passage} {prose(rng, 'en', 80)}", "en") for i in range(3)]
    rows += [(120, prose(rng, "de", 60) + " " + bench[1][1], "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")

    held, want = docs, {i: t for i, t, _ in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        idf = neardup.idf_table(held) if name == "near_dedup" else None
        stage(spark, held, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        held = spark.read.parquet(f"{tmp_path}/out{k}")
        got = {r.doc_id: r.text for r in held.collect()}
        if name == "language_id":
            want = {i: t for i, t in want.items() if i not in (102, 103, 104)}
        if name == "near_dedup":
            classes = brute_classes(list(want.items()), idf)
            want = {i: t for i, t in want.items() if classes[i] == i}
            assert 100 not in want and 101 not in want
        if name == "suffix_dedup":
            removed = {i: r[1] for i, r in brute(list(want.items()), 100).items()}
            assert all(len(got[i].encode()) - len(want[i].encode()) in range(-removed[i], 9 - removed[i]) for i in want)
            assert removed[111] > 200
            want = got
        if name == "decontamination":
            want = {i: t for i, t in want.items() if i != 120}
        if name != "mixing":
            assert held.columns == COLUMNS and got == want
    assert held.columns == [*COLUMNS, "rate", "copies"] and set(got) <= set(want)
    assert held.filter(F.col("copies") < 1).count() == 0

    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: (r.text, r.copies) for r in whole.collect()} == {r.doc_id: (r.text, r.copies) for r in held.collect()}


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
