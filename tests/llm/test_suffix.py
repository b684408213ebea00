import hashlib
import random

import numpy as np
import pytest

from corpusgraph.llm import suffix


def brute(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            part = data[p:p + length]
            if part in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(part)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for j in range(len(data)) if gone[j] and not (j and gone[j - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_report_equals_brute_force(documents, messy):
    got = {r.doc_id: tuple(r)[1:] for r in suffix.report(documents).collect()}
    assert got == brute([(i, t) for i, t, _ in messy], 100)


@pytest.mark.parametrize("split_above", [2, 1000])
def test_hot_anchors_are_split_without_loss(spark, split_above):
    rng = random.Random(1)
    base = "".join(rng.choice("abcé \n") for _ in range(400))
    rows = []
    for i in range(50):
        a = rng.randrange(400)
        rows.append((i, "".join(rng.choice("abcé") for _ in range(rng.randrange(80))) + base[a:a + rng.randrange(300)]
                     + rng.choice(["", "x" * rng.randrange(300), "ab" * 200])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got: dict = {}
    for r in suffix.repeated_ranges(df, split_above=split_above).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = brute(rows, 100)
    assert {i: len(got.get(i, ())) for i, _ in rows} == {i: w[1] for i, w in want.items()}


def test_deep_shallow_sort_flags_repeats():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (400, 40)).astype(np.uint8)
    rows[:, :34] = 97
    seen, want = set(), []
    for r in rows:
        want.append(r.tobytes() in seen)
        seen.add(r.tobytes())
    assert suffix.repeated(rows).tolist() == want


def test_blind_trie_keeps_order():
    rng = random.Random(2)
    keys = [rng.getrandbits(60) for _ in range(300)] + [5, 5, 0]
    trie = suffix.BlindTrie()
    assert sum(trie.add(k) for k in keys) == len(keys) - len(set(keys))
    assert trie.keys() == sorted(set(keys))


def test_removal_keeps_columns_nulls_and_whole_characters(spark, documents):
    kept = suffix.remove_repeats(documents)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert kept.filter("doc_id = 300").first().text is None
    df = spark.createDataFrame([(1, "ä" * 60), (2, "x" + "ä" * 60), (None, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in suffix.remove_repeats(df).collect()}
    assert out[2] == "x" and out[3] == "" and out[None] is None
    assert suffix.report(df.limit(0)).count() == 0
