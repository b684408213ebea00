import random

import numpy as np
import pytest

from corpusgraph.llm import decontaminate

from .conftest import prose


def test_passages_with_substitutions_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (14, 30, 59, 7, 3)]
    rows, want = [], set()
    for i in range(40):
        rows.append((i, " ".join(word() for _ in range(80))))
    for k, item in enumerate(items[:4]):
        rows.append((100 + k, " ".join([word() for _ in range(20)] + item + [word() for _ in range(20)])))
        want.add((100 + k, k))
    changed = list(items[2])
    for at in range(3, 59, 6):
        changed[at] = word()
    rows.append((110, "x " + ", ".join(changed).upper() + " y"))
    want.add((110, 2))
    rows += [(111, " ".join(items[4])), (112, None), (113, ""), (None, " ".join(items[0])), (100, rows[40][1])]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(7, None), (8, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contaminations(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and found.count() == len(want)
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.count() == len(rows) - len({d for d, _ in want}) - 1
    assert decontaminate.contaminations(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminations(docs, benchmark.limit(0)).count() == 0


def test_given_tables_hold_every_exact_passage(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    exact = {(r.doc_id, k) for r in docs.collect() for k, t in items.items() if t in (r.text or "")}
    assert exact <= {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, bench).collect()}


def test_overlap_finds_the_best_stretch():
    item = np.arange(20)
    text = np.r_[np.full(5, -1), item[:9], -7, item[10:], -1]
    assert decontaminate.overlap(text, item, 5) == (0, 20, 19)


def test_clashing_columns(documents, spark):
    rng = random.Random(9)
    bench = spark.createDataFrame([(1, prose(rng, "en", 30), 5)], "item_id long, text string, doc_id long")
    kept = decontaminate.keep_clean(documents, bench)
    assert kept.columns == documents.columns


def test_every_accepted_pattern_of_substitutions_holds_a_seed():
    """Best sums of agree - 3 x differ (0 is an identity of 75 %) over all strings without a seed, by their last bits."""
    masks = [(int(m, 2), len(m)) for m in decontaminate.MASKS]
    bits = max(n for _, n in masks) - 1
    state, low = np.arange(1 << bits), -10**6
    best = np.full((decontaminate.MIN_MATCH + 1, 1 << bits), low)
    best[0, 0] = 0
    # a string gains at most what one with nothing before it gains, so that the sums never come back from -100
    top = 0
    while best.max() > -100:
        new = np.full_like(best, low)
        for bit, gain in ((0, -3), (1, 1)):
            full = state << 1 | bit
            # the newest word is the lowest bit, as the last one of a mask
            free = ~np.logical_or.reduce([full & mask == mask for mask, _ in masks])
            to = full & ((1 << bits) - 1)
            for agree in range(len(best)):
                ok = free & (best[agree] > low // 2)
                np.maximum.at(new[min(agree + bit, len(best) - 1)], to[ok], best[agree][ok] + gain)
        best, top = new, max(top, new.max())
        assert best[-1].max() < 0
    assert top < 50


def test_substitutions_equal_brute_force_diagonals(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (5, 8, 11, 12, 16, 23, 40, 59)]
    rows = []
    for item in items:
        changes = [range(first, len(item), period) for period in (4, 5, 6, 7, 8) for first in range(period)]
        changes += [rng.sample(range(len(item)), rng.randint(0, len(item) // 3)) for _ in range(15)]
        for places in changes:
            changed = list(item)
            for at in places:
                changed[at] = word()
            rows.append([word() for _ in range(9)] + changed + [word() for _ in range(9)])
    number = {w: i for i, w in enumerate({w for x in rows + items for w in x})}
    coded = lambda x: np.array([number[w] for w in x])
    want = {}
    for d, row in enumerate(rows):
        for k, item in enumerate(items):
            for shift in range(-len(item) + 1, len(row)):
                low, high = max(0, -shift), min(len(item), len(row) - shift)
                same = [item[i] == row[i + shift] for i in range(low, high)]
                if sum(same) >= min(12, len(item)):
                    want[d, k] = max(accepted(same, min(12, len(item)))[0], want.get((d, k), 0))
    want = {pair: n for pair, n in want.items() if n}
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.contaminations(docs, bench).collect()
    assert {(r.doc_id, r.item_id): r.n_match for r in found} == want and len(want) > 150


def accepted(same, least):
    """(most agreeing words, fewest words) of all stretches by the definition: ``least`` words agree, and three of four."""
    best = (0, 0)
    for a in range(len(same)):
        n = 0
        for b in range(a, len(same)):
            n += same[b]
            if n >= least and 4 * n >= 3 * (b + 1 - a):
                best = max(best, (n, -(b + 1 - a)))
    return best[0], -best[1]


def test_stretches_by_definition():
    rng = random.Random(6)
    for _ in range(400):
        same = [rng.random() < rng.choice([0.3, 0.7, 0.9, 1.0]) for _ in range(rng.randint(1, 70))]
        item = np.arange(len(same))
        text = np.where(same, item, -1)
        at, size, agree = decontaminate.overlap(text, item, 0)
        assert (agree, size) == accepted(same, min(12, len(same)))
        assert sum(same[at:at + size]) == agree


@pytest.mark.parametrize("same", [[1] * 12 + [0, 1, 1] * 15 + [0, 0], [1] * 40 + ([1] * 7 + [0] * 3) * 40])
def test_a_weak_tail_hides_nothing(spark, same):
    item = [f"w{i}" for i in range(len(same))]
    text = " ".join(["before"] * 9 + [w if s else "other" for w, s in zip(item, same)])
    docs = spark.createDataFrame([(1, text), (2, "clean words only")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminations(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.n_match, r.n_words) for r in got] == [(1, 5, *accepted([bool(s) for s in same], 12))]
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [2]


def test_every_accepted_stretch_holds_a_seed():
    """The largest sum of +1 and -3 over sequences without a window of any mask, by their last nine words: with 12 agreeing
    words it is always negative, so that no accepted stretch goes without a seed."""
    masks = decontaminate.MASKS
    best = {((), 0): 0}
    for length in range(1, 200):
        longer: dict = {}
        for (past, agree), total in best.items():
            for same in (0, 1):
                here = (*past, same)
                if any(len(here) >= len(m) and all(x or c == "0" for x, c in zip(here[-len(m):], m)) for m in masks):
                    continue
                key = (here[-9:], min(12, agree + same))
                longer[key] = max(longer.get(key, -9999), total + (1 if same else -3))
        best = longer
        assert max((v for (_, agree), v in best.items() if agree == 12), default=-1) < 0
