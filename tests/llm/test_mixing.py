import random

import numpy as np

from corpusgraph.llm import mixing

from .conftest import prose


def test_rates_meet_targets_and_silence_toxic(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        kind = ("good", "good", "low", "toxic")[i % 4]
        extra = {"good": " garden kitchen table", "low": " spam!! offer!! click!!", "toxic": " scum idiot moron"}[kind]
        rows.append((i, prose(rng, "en", 40) + extra))
        if i % 3:
            labels.append((i, int(kind == "good"), int(kind == "toxic")))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.7, "low": 0.3, "toxic": 0.0}
    got = mixing.mix(docs, marks, targets).collect()
    total = sum(r.n_tokens for r in got)
    for domain, share in targets.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{domain}"] for r in got) / total - share) < 0.02
    assert all(r.rate >= 0 for r in got) and len(got) == 243
    toxic = [r.rate for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 4 == 3]
    assert max(toxic) < 0.1


def test_steps_equal_one_machine_least_squares(spark):
    """The distributed fit follows projected gradient descent on the whole matrix."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    t = rng.integers(1, 500, 300)
    df = spark.createDataFrame([(i, int(t[i]), *map(float, p[i])) for i in range(300)],
                               "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double").repartition(5)
    steps = mixing.fit_steps(df, {"good": 0.5, "low": 0.4, "toxic": 0.1})
    x = mixing.rates(p, steps)
    assert np.allclose((t * x) @ p / t.sum(), [0.5, 0.4, 0.1], atol=2e-4)


def test_targets_that_cannot_be_met(spark):
    """Equal to plain projected gradient on the whole matrix, run until it stands still; no rate grows without bound."""
    rng = np.random.default_rng(9)
    p = np.vstack([rng.dirichlet([4, 1, 0.5], 250), rng.dirichlet([0.2, 0.2, 3], 50)])
    t = rng.integers(0, 400, 300)
    wanted = np.array([0.7, 0.3, 0.0])
    df = spark.createDataFrame([(i, int(t[i]), *map(float, p[i])) for i in range(300)],
                               "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double").repartition(4)
    steps = mixing.fit_steps(df, dict(zip(mixing.DOMAINS, wanted)), strength=0.02)
    weight = t.sum() / np.diag((p * t[:, None]).T @ p)
    x = np.ones(300)
    for _ in range(20_000):
        miss = (t * x) @ p / t.sum() - wanted
        x = np.maximum(0, x - 0.05 * (p @ (weight * miss) + 0.02 * (x - 1)))
    assert np.abs(miss).max() > 0.005 and len(steps) == 1
    assert np.allclose(mixing.rates(p, steps), x, atol=1e-3)


def test_one_domain_and_no_tokens(spark):
    one = spark.createDataFrame([(i, 5, 1.0, 0.0, 0.0) for i in range(9)],
                                "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double")
    (step,) = mixing.fit_steps(one, {"good": 0.5, "low": 0.5})[:1]
    assert np.isfinite(step).all() and (mixing.rates(np.array([[1.0, 0, 0]]), [step]) >= 0).all()
    assert mixing.fit_steps(one.withColumn("n_tokens", one.n_tokens * 0), {"good": 1.0}) == []


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, none).collect()
    assert len(rows) == 2 and all(abs(r.p_good - 1 / 3) < 1e-9 for r in rows)
    assert mixing.mix(docs.limit(0), none).count() == 0


def test_apply_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "r"), (None, None, 7, "r")], "doc_id long, text string, rate int, key string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mixing.apply_rates(docs, none, {"good": 1 / 3, "low": 1 / 3, "toxic": 1 / 3})
    assert out.columns == ["doc_id", "text", "rate", "key", "mixing_rate", "copies"] and out.count() == 2
