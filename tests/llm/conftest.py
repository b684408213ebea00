import random

import pytest

WORDS = {
    "en": "the of and house river small tree walking under green morning people never light stone paper".split(),
    "de": "der und nicht haus fluss kleine baum gehen unter grün morgen leute nie licht stein papier über".split(),
    "fr": "le de et maison rivière petite arbre marcher sous vert matin gens jamais lumière pierre été".split(),
}


def prose(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n)).strip()


@pytest.fixture(scope="session")
def messy():
    """(doc_id, text, lang): nulls, empty and very long texts, copies, near copies, shared passages, junk, ties."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(1, 150)), lang))
    shared = prose(rng, "en", 70)
    rows += [(100 + i, prose(rng, "en", 20) + " " + shared + " " + prose(rng, "en", 20), "en") for i in range(5)]
    base = prose(rng, "de", 120)
    rows += [(200 + i, base, "de") for i in range(4)]
    for i in range(4):
        parts = base.split(" ")
        parts[rng.randrange(len(parts))] = "anders"
        rows.append((210 + i, " ".join(parts), "de"))
    rows += [(300, None, "en"), (301, "", "en"), (302, "   \n", None), (303, "$$$ %%% 123 !!", "en"), (304, "é", "fr")]
    rows += [(310, "wort " * 6000, "de"), (311, "x" * 5000, None), (312, "ab" * 3000, "en"), (313, prose(rng, "fr", 4000), "fr")]
    rows += [(320, "á   İ ẞ😀 <|endoftext|> x", "en"), (321, "tie", None), (322, "tie", None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, messy):
    """``messy`` as a table with further columns whose names clash with inner ones."""
    df = spark.createDataFrame(messy, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    extra = {c: F.lit(i) for i, c in enumerate(["key", "word", "row", "n", "start", "ranges", "rest", "score", "item_id"])}
    return df.withColumns(extra).repartition(3)
