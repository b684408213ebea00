"""Mixing documents to target weights of soft domains.

A classifier fitted on the labelled table predicts for every document how likely it belongs to each domain. Document rates
x >= 0 (how often a document is to be seen) are then fitted so that the expected tokens of each domain, the sum over all
documents of rate x tokens x posterior, match target totals. The fit is projected-gradient least squares in its implicit
form: a step takes every rate to max(0, rate - posteriors . multipliers), the gradient being that at the end of the step, and
its few multipliers, one a domain, are found by Newton steps. A Newton step is one pass over (tokens, posteriors) that returns
a few sums a task; the rates themselves are never gathered, since they follow from the posteriors and the list of steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import LOWER, TOKEN_BYTES, U64, RollingHash, text_blocks, words
from corpusgraph.llm.blocks import mix as mix64
from corpusgraph.session import materialize

SLOTS = 1 << 17
#: Bytes of text looked at at a time.
_BLOCK = 1 << 18
#: Bound of the labelled sample (documents) that the classifier is fitted on.
TRAIN_DOCS = 20_000
#: Documents' worth of prior that a word's domain shares are shrunk to.
PRIOR = 2.0
#: A word counts only if it is in MIN_DOCS sampled documents, one domain differs from its expectation by this chi-square, and
#: the odds of a minority domain are RATIO times as high with the word. Weaker words, such as those of one language, would add up.
SIGNIFICANT, MIN_DOCS, RATIO = 20.0, 4, 6.0
#: Besides whole words, their first bytes are features.
PREFIX = 4
DOMAINS = ["good", "low", "toxic"]
#: Shares of all tokens that each domain shall have.
TARGETS = {"good": 0.7, "low": 0.3, "toxic": 0.0}
#: A domain's total is met within this share of all tokens; the multipliers of a step are exact to PRECISION of all tokens.
TOLERANCE, PRECISION = 1e-4, 1e-6
#: Cost of moving rates in a step against that of missing targets; a Newton step tries HALVINGS lengths in its one pass.
STRENGTH, HALVINGS = 0.02, 8
INTERCEPT_STEPS = 200


def domain_column() -> Column:
    """Domain of a row of ``labels``; null if it is not labelled."""
    return (F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 1), "good")
            .when((F.col("toxic") == 0) & (F.col("quality") == 0), "low"))


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of a block (words and word beginnings), and the number of words of each row."""
    word, start, end, first = words(data, offsets, TOKEN_BYTES)
    row = np.repeat(np.arange(len(offsets) - 1), first[1:] - first[:-1])
    begin = mix64(~RollingHash(LOWER[data])(start, np.minimum(start + PREFIX, end)))
    code = np.concatenate([row * SLOTS + (x >> U64(47)).astype(np.int64) for x in (word, begin)])
    code = np.unique(code)
    return code // SLOTS, code % SLOTS, first[1:] - first[:-1]


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((len(DOMAINS), SLOTS + 1), np.int64)
    for batch in batches:
        domain = np.array([DOMAINS.index(x) for x in batch.column(1).to_pylist()], np.int64)
        for rows, data, offsets in text_blocks(batch, limit=_BLOCK):
            row, slot, _ = _slots(data, offsets)
            np.add.at(counts, (domain[rows][row], slot), 1)
            np.add.at(counts[:, SLOTS], domain[rows], 1)
    domain, slot = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(domain), pa.array(slot), pa.array(counts[domain, slot])],
                                     names=["domain", "slot", "n"])


def fit_classifier(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """(domains x slots + 1) log odds of words against the background; the last column holds the intercepts.

    Naive Bayes on word presence over at most about ``train_docs`` labelled documents, chosen by a hash of doc_id. The
    intercepts are fitted so that the sample's mean posteriors are its domain shares: so the absence of all telling words
    counts too. The driver receives at most domains x slots counts and the sample's scores.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_column().alias("domain"))
             .filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain")))
    share = min(1.0, train_docs / max(known.count(), 1))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # the sample is bounded by train_docs, so that it may be broadcast
    sample = docs.filter("text is not null").join(F.broadcast(picked), "doc_id").select("text", "domain")
    rows = (sample.mapInArrow(_count_slots, "domain long, slot long, n long")
            .groupBy("domain", "slot").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((len(DOMAINS), SLOTS + 1))
    counts[rows["domain"].to_numpy(), rows["slot"].to_numpy()] = rows["n"].to_numpy()
    size, words_ = counts[:, SLOTS:], counts[:, :SLOTS]
    prior = (size + 1) / (size.sum() + len(DOMAINS))
    seen = words_.sum(axis=0)
    expected = prior * seen
    apart = ((words_ - expected) ** 2 / np.maximum(expected, 1e-9)).max(axis=0)
    # P(word | domain) / P(word) = P(domain | word) / P(domain); a word without evidence says nothing
    odds = np.log((words_ + PRIOR * prior) / (seen + PRIOR)) - np.log(prior)
    share = np.exp(odds) * prior
    ratio = share / np.maximum(1 - share, 1e-9) / (prior / (1 - prior))
    telling = ((ratio >= RATIO) & (prior <= 0.5)).any(axis=0)
    odds[:, (seen < MIN_DOCS) | (apart < SIGNIFICANT) | ~telling] = 0.0
    model = np.hstack([odds, np.log(prior)])
    if not size.sum():
        return model
    shared = docs.sparkSession.sparkContext.broadcast(np.hstack([odds, np.zeros((len(DOMAINS), 1))]))
    scores = sample.mapInArrow(_sample_scores(shared), ", ".join(f"s{i} double" for i in range(len(DOMAINS)))).toPandas().to_numpy()
    for _ in range(INTERCEPT_STEPS):
        mean = _softmax(scores + model[:, SLOTS]).mean(axis=0)
        model[:, SLOTS] += np.log(prior[:, 0] / np.maximum(mean, 1e-12))
    return model


def _scores(data: np.ndarray, offsets: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x domains) scores of a block, and the number of words of each row."""
    row, slot, size = _slots(data, offsets)
    return np.stack([np.bincount(row, o[slot], minlength=len(size)) + o[SLOTS] for o in odds], axis=1), size


def _softmax(score: np.ndarray) -> np.ndarray:
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True)


def _sample_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch, limit=_BLOCK):
                score, _ = _scores(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(score[:, i]) for i in range(len(DOMAINS))],
                                                 names=[f"s{i}" for i in range(len(DOMAINS))])

    return run


def _posteriors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in batches:
            tokens, probabilities = [], []
            for _, data, offsets in text_blocks(batch, limit=_BLOCK):
                score, size = _scores(data, offsets, odds)
                tokens.append(size)
                probabilities.append(_softmax(score))
            flat = np.concatenate(probabilities) if probabilities else np.zeros((0, len(DOMAINS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(tokens) if tokens else [], pa.int64()),
                 *(pa.array(flat[:, i]) for i in range(len(DOMAINS)))],
                names=["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS)])

    return run


def posteriors(docs: DataFrame, odds: np.ndarray) -> DataFrame:
    """doc_id, n_tokens (words between white space), p_<domain> for every row of ``docs``; stored in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(
        _posteriors(shared), f"doc_id {kind}, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)), "posteriors")


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after all steps, from 1: x <- max(0, x - p . step)."""
    x = np.ones(len(p))
    for step in steps:
        x = np.maximum(0.0, x - p @ step)
    return x


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = len(DOMAINS)
    first = batch.schema.get_field_index(f"p_{DOMAINS[0]}")
    p = np.stack([batch.column(first + i).to_numpy() for i in range(n)], axis=1)
    return batch.column(batch.schema.get_field_index("n_tokens")).to_numpy().astype(float), p


def _sums(steps: list[np.ndarray], moves: list[np.ndarray]):
    """Per task and move: expected tokens of each domain after it, products of posteriors over rates above 0, squared rates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(DOMAINS)
        total = np.zeros((len(moves), n + n * n + 1))
        for batch in batches:
            t, p = _columns(batch)
            before = rates(p, steps)
            for at, move in enumerate(moves):
                x = np.maximum(0.0, before - p @ move)
                total[at, :n] += (t * x) @ p
                total[at, n:-1] += ((p * (t * (x > 0))[:, None]).T @ p).ravel()
                total[at, -1] += t @ (x * x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "value"])

    return run


def _gather(features: DataFrame, steps: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    rows = (features.mapInArrow(_sums(steps, moves), "i long, value double")
            .groupBy("i").agg(F.sum("value").alias("value")).collect())
    out = np.zeros(len(moves) * (len(DOMAINS) + len(DOMAINS) ** 2 + 1))
    for r in rows:
        out[r["i"]] = r["value"]
    return out.reshape(len(moves), -1)


def _step(features: DataFrame, steps: list[np.ndarray], wanted: np.ndarray, weight: np.ndarray, total: float,
          strength: float) -> tuple[np.ndarray, np.ndarray]:
    """The next step and each domain's share of all tokens after it.

    The step minimises the weighted squared miss of the targets plus ``strength`` times the squared change of the rates. Its
    multipliers minimise a convex function of one variable a domain, smooth and piecewise quadratic, so that Newton steps
    whose lengths are chosen by its value end at the minimum.
    """
    n = len(DOMAINS)

    def dual(moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums = _gather(features, steps, moves) / total
        return sums, np.array([s[-1] / 2 + strength * (m * m / weight).sum() / 2 + m @ wanted for s, m in zip(sums, moves)])

    move = np.zeros(n)
    (state,), (value,) = dual([move])
    while True:
        slope = wanted - state[:n] + strength * move / weight
        if np.abs(slope).max() <= PRECISION:
            break
        whole = np.linalg.solve(state[n:-1].reshape(n, n) + np.diag(strength / weight), slope)
        moves = [move - whole / 2 ** i for i in range(HALVINGS)]
        states, values = dual(moves)
        best = int(values.argmin())
        if not values[best] < value:  # as exact as doubles allow
            break
        move, state, value = moves[best], states[best], values[best]
    return move, state[:n]


def fit_steps(features: DataFrame, targets: dict[str, float], strength: float = STRENGTH,
              tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Steps of the projected gradient until every domain is within ``tolerance`` of all tokens of its target.

    The objective is the squared error of each domain's total relative to the domain's own weight in the corpus; changes of
    rates count by a document's tokens, so that rates depend on posteriors and not on lengths. The first step gives the rates
    of least squared error plus ``strength`` times their squared distance from 1. Further steps, each from the rates before
    it, are taken as long as they at least halve the largest miss: they meet targets that can be met. Targets that no rates
    >= 0 can meet stop there, at the optimum of the first problem (or of its last useful step). The plain least squares of
    such targets is not sought: its rates are 0 for all documents but the few with the most extreme posteriors.
    """
    wanted = np.array([targets.get(d, 0.0) for d in DOMAINS])
    n = len(DOMAINS)
    (start,) = _gather(features, [], [np.zeros(n)])
    total = start[-1]  # all rates are 1
    if total <= 0:
        return []
    weight = 1 / np.maximum(np.diag(start[n:-1].reshape(n, n)) / total, 1e-6)
    steps: list[np.ndarray] = []
    miss = np.abs(start[:n] / total - wanted).max()
    while miss > tolerance:
        step, shares = _step(features, steps, wanted, weight, total, strength)
        left = np.abs(shares - wanted).max()
        if steps and left > miss / 2:
            break
        steps.append(step)
        miss = left
    return steps


def _rate(steps: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _columns(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, steps))], names=[*batch.schema.names, "rate"])

    return run


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate for every row of ``docs`` (doc_id, text).

    ``rate`` is how often the document is to be seen. Null and empty texts have no tokens, the prior as posteriors and the
    rate of that posterior. Without labels every domain is equally likely. Labels with a null in doc_id or in both labels
    are not used; of repeated ones the most severe counts (toxic, low, good). Repeated rows each get a row; a null doc_id
    stays; further columns are ignored; no rows give no rows.
    """
    rows = docs.select("doc_id", "text")
    features = posteriors(rows, fit_classifier(rows, labels))
    steps = fit_steps(features, TARGETS if targets is None else targets)
    return features.mapInArrow(_rate(steps), features.select("*", F.lit(0.0).alias("rate")).schema)


def apply_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with ``rate`` and ``copies``, the whole number of times a document is to be seen.

    The fraction of a rate is rounded by a hash of doc_id, so that totals are kept on average, but a document with a rate of
    one half or more keeps a copy. Documents with no copy go.
    """
    found = (mix(docs, labels, targets).groupBy("doc_id").agg(F.max("rate").alias("rate"))
             .withColumn("copies", F.greatest(
                 F.floor(F.col("rate") + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)),
                 (F.col("rate") >= 0.5).cast("long"))))
    used = {c.lower() for c in docs.columns}
    rate, copies = (c if c not in used else f"mixing_{c}" for c in ("rate", "copies"))
    kept = found.filter("copies > 0").select(F.col("doc_id").alias("key"), F.col("rate").alias("r"), F.col("copies").alias("c"))
    joined = docs.alias("d").join(kept.alias("m"), F.expr("d.doc_id <=> m.key"))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("m.r").alias(rate), F.col("m.c").alias(copies))
