import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusgraph.llm import pst

_TOKEN = re.compile("[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*_TOKEN.findall((text or "").translate(_LOWER)), None]


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 10 == 0


def test_base_scores_equal_brute_force(documents, messy):
    got = {r.doc_id: r for r in pst.score(documents).collect()}
    split = {i: tokens(t) for i, t, _ in messy}
    count = collections.Counter(w for i, ws in split.items() if not held_out(i) for w in ws)
    n, types = sum(count.values()), len(count)
    for i, ws in split.items():
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (types + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9


def test_probabilities_of_every_state_sum_to_one(documents):
    tree, counts = pst.fit(documents.select("text"))
    known = counts.collect()  # words that the tasks hold, and rarer ones
    vocabulary = np.array([r.word for r in known], np.int64).view(np.uint64)
    root = (np.array([r.n for r in known]) + 0.1) / tree.spread
    unknown = 0.1 / tree.spread
    assert abs(root.sum() + unknown - 1) < 1e-9 and len(tree.levels) >= 2
    for state in tree.levels[0].state[:20]:
        p = pst.probability(tree, 1, [np.full(len(vocabulary), state)], vocabulary, root)
        back = tree.levels[0].back[pst.find(tree.levels[0].state, np.array([state]))][0]
        total = tree.levels[0].total[pst.find(tree.levels[0].state, np.array([state]))][0]
        assert abs(p.sum() + unknown * back / (total + pst.PSEUDO) - 1) < 1e-9


def test_contexts_help_on_held_out_texts(spark):
    rng = random.Random(2)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(400):
        w, out = rng.randrange(40), []
        for _ in range(50):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(out)))
    got = pst.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_states_match_longest_suffix_by_hand(spark):
    """Scores of one text from plain dictionaries of the tree's own states."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a b c", "a d", "b c a", "d d e"]) for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pst.score(df).collect()}
    tree, _ = pst.fit(df.filter(~pst.held_out()))
    for doc, text in rows[:5]:
        words = [*(pst.hash_words(w, pst.TOKEN_BYTES)[0] for w in text.split()), pst.END[0]]
        total = 0.0
        for i, w in enumerate(words):
            c = tree.count[pst.find(tree.word, np.array([w]))][0]
            p, context = (c + 0.1) / tree.spread, None
            for d, level in enumerate(tree.levels):
                if i - d - 1 < 0:
                    break
                context = pst.extend(context, np.array([words[i - d - 1]]))
                s = pst.find(level.state, context)[0]
                if s < 0:
                    break
                e = pst.find(level.key, pst.followed(context, np.array([w])))[0]
                p = ((level.count[e] if e >= 0 else 0) + level.back[s] * p) / (level.total[s] + pst.PSEUDO)
            total += math.log10(p)
        assert abs(total - got[doc]) < 1e-6


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    rows = pst.score(df).collect()
    assert len(rows) == 3 and all(r.n_tokens == 1 for r in rows)
    assert pst.score(df.limit(0)).count() == 0
    only_held_out = next(i for i in range(100) if held_out(i))
    r = pst.score(spark.createDataFrame([(only_held_out, "a b")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9


def test_gain_on_unseen_documents_grows_with_the_corpus(spark):
    """Contexts help on documents that nothing was learned from, the more so the more there is to learn from."""
    gains, states = [], []
    for size in ("sf0.001", "sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text").repartition(4)
        base, own = pst.score(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
        gains.append(1 - own / base)
        states.append(sum(len(x.state) for x in pst.fit(docs.filter(~pst.held_out()))[0].levels))
    assert 0 < gains[0] < gains[1] < gains[2] and states[0] < states[1] < states[2]
    assert gains[2] > 0.06


def test_what_occurs_often_enough_grows_slower_than_the_corpus():
    assert pst.enough(1000) == (pst.CONTEXT_MIN, pst.ENTRY_MIN)
    shares = [pst.enough(n)[0] / n for n in (10**6, 10**8, 10**10)]
    assert shares[0] > shares[1] > shares[2] and pst.enough(10**10)[1] > pst.enough(10**8)[1]
