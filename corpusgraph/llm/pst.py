"""Language-model scores by a probabilistic suffix tree over words.

States are contexts of up to ``DEPTH`` previous words. A context is a candidate if it occurs often enough and its suffix is a
state; it is retained if what follows it diverges from what its suffix predicts: its occurrences times the divergence, the
log-likelihood that the context wins, have to pay for its entries (``PER_STATE`` and ``PER_ENTRY`` nats). A state keeps the next
words that occur often enough behind it; the rest of its mass and ``PSEUDO`` further counts are given to its suffix's
distribution, down to the smoothed word frequencies, so that the probabilities of every state sum to one. A token is scored by
the longest suffix of its past that is a state.

"Often enough" is a fixed number of occurrences, and in large corpora a multiple of the square root of the training tokens. So
the tree grows with the corpus and gets finer, while the tasks hold sqrt(tokens) / ``ENTRY_ROOT`` entries a level and as many
words at most; rarer words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import TOKEN_BYTES, U64, hash_words, mix, signed, text_blocks, words
from corpusgraph.session import materialize

#: Occurrences that a context and an entry need, and the multiples of sqrt(tokens) that they need in large corpora.
CONTEXT_MIN, ENTRY_MIN = 8, 3
CONTEXT_ROOT, ENTRY_ROOT = 0.02, 0.004
DEPTH = 4
PER_STATE, PER_ENTRY = 6.0, 2.0
PSEUDO = 5.0
#: Hash of the end token, which no text can contain.
END = hash_words("end\0of\0text", TOKEN_BYTES) ^ U64(0x5555555555555555)


def held_out(column: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 10 == 0


def enough(n: int) -> tuple[float, float]:
    """Occurrences that a context and an entry (or a word that the tasks hold) need among ``n`` training tokens."""
    root = float(np.sqrt(n))
    return max(CONTEXT_MIN, CONTEXT_ROOT * root), max(ENTRY_MIN, ENTRY_ROOT * root)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with one end token behind each text, index of the first token of each text + total)."""
    word, _, _, first = words(data, offsets, TOKEN_BYTES)
    return np.insert(word, first[1:], END), first + np.arange(len(first))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [tokens(data, offsets)[0] for _, data, offsets in text_blocks(batch)]
        if parts:
            word, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(times.astype(np.int64))], names=["word", "n"])


@dataclass
class Level:
    """States of one depth. ``state``: sorted hashes of contexts; ``key``: sorted hashes of (context, next word)."""

    state: np.ndarray
    total: np.ndarray
    back: np.ndarray  # share of a state's mass that its suffix distributes
    key: np.ndarray
    count: np.ndarray


@dataclass
class Tree:
    n: int
    types: int
    word: np.ndarray  # sorted hashes of common words
    count: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @property
    def spread(self) -> float:
        return self.n + 0.1 * (self.types + 1)


def find(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(value), -1)
    at = np.searchsorted(table, value)
    at[at == len(table)] = 0
    return np.where(table[at] == value, at, -1)


def extend(context: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """Hash of a context with one more, older word; ``None`` is the empty context."""
    with np.errstate(over="ignore"):
        return mix(word * U64(3) + U64(1)) if context is None else mix(context * U64(5) + word)


def followed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * U64(7) + word)


def contexts(word: np.ndarray, first: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth: (context hash of every token, whether so many words precede it in its text)."""
    place = np.arange(len(word)) - np.repeat(first[:-1], first[1:] - first[:-1])
    out, last = [], None
    for d in range(1, depth + 1):
        older = np.r_[np.zeros(min(d, len(word)), U64), word[:-d]][:len(word)]
        last = extend(last, older)
        out.append((last, place >= d))
    return out


def _count_next(shared, depth: int):
    """Counts of (context, next word) for candidate contexts of one depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates, nexts = shared.value
        for batch in batches:
            parts = []
            for _, data, offsets in text_blocks(batch):
                word, first = tokens(data, offsets)
                context, deep = contexts(word, first, depth)[-1]
                state, following = find(candidates, context), find(nexts, word)
                use = deep & (state >= 0) & (following >= 0)
                parts.append(state[use] * len(nexts) + following[use])
            if not parts:
                continue
            code, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code // max(len(nexts), 1)), pa.array(code % max(len(nexts), 1)), pa.array(times.astype(np.int64))],
                names=["state", "next", "n"])

    return run


def probability(tree: Tree, level: int, contexts_: list[np.ndarray], word: np.ndarray, root: np.ndarray) -> np.ndarray:
    """P(word | state of depth ``level``), given the hashes of the contexts of depth 1, 2, ... and P(word)."""
    p = root
    for d in range(level):
        own = tree.levels[d]
        state = find(own.state, contexts_[d])
        entry = find(own.key, followed(contexts_[d], word))
        n = np.where(entry >= 0, own.count[entry] if len(own.count) else 0, 0)
        p = (n + own.back[state] * p) / (own.total[state] + PSEUDO)
    return p


def fit(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """(suffix tree, counts of all words) of ``docs``. The driver sees words, contexts and entries only that occur ``enough``."""
    spark = docs.sparkSession
    rows = docs.select("text")
    counts = materialize(rows.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often, least = enough(n)
    common = counts.filter(F.col("n") >= least).toPandas()
    word, count = common["word"].to_numpy(np.int64).view(U64), common["n"].to_numpy(np.int64)
    order = np.argsort(word)
    tree = Tree(n, types, word[order], count[order])
    nexts = tree.word
    # a candidate: its hash, its count, and its words from the nearest to the oldest
    starts = tree.word[(tree.count >= often) & (tree.word != END)]
    candidates = [(extend(None, starts), tree.count[find(tree.word, starts)], [starts])] if len(starts) else []
    for depth in range(1, DEPTH + 1):
        if not candidates:
            break
        state, total, path = (candidates[0][0], candidates[0][1], candidates[0][2])
        order = np.argsort(state)
        state, total, path = state[order], total[order], [w[order] for w in path]
        shared = spark.sparkContext.broadcast((state, nexts))
        entries = (rows.mapInArrow(_count_next(shared, depth), "state long, next long, n long")
                   .groupBy("state", "next").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas())
        owner, following = entries["state"].to_numpy(np.int64), nexts[entries["next"].to_numpy(np.int64)]
        times = entries["n"].to_numpy(np.int64)
        # divergence from the suffix's distribution, the words without an entry taken as one
        root = (tree.count[find(tree.word, following)] + 0.1) / tree.spread
        suffix = [c for c in _suffixes(path)][:depth - 1]
        p = probability(tree, depth - 1, [c[owner] for c in suffix], following, root)
        own = times / total[owner]
        seen = np.bincount(owner, own, minlength=len(state))
        explained = np.bincount(owner, p, minlength=len(state))
        rest, rest_p = np.maximum(1 - seen, 1e-12), np.maximum(1 - explained, 1e-12)
        gain = np.bincount(owner, own * np.log(own / p), minlength=len(state)) + rest * np.log(rest / rest_p)
        keep = total * gain >= PER_STATE + PER_ENTRY * np.bincount(owner, minlength=len(state))
        key = followed(state[owner], following)
        use = keep[owner]
        order = np.argsort(key[use])
        kept_mass = np.bincount(owner[use], times[use], minlength=len(state))
        tree.levels.append(Level(state[keep], total[keep], (total - kept_mass)[keep] + PSEUDO,
                                 key[use][order], times[use][order]))
        candidates = []
        if depth < DEPTH:
            candidates = _longer(tree, depth, state, keep, path, owner, following, times, often)
    return tree, counts


def _suffixes(path: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Context hashes of depth 1, 2, ... of the words ``path`` (nearest first)."""
    last = None
    for word in path:
        last = extend(last, word)
        yield last


def _longer(tree, depth, state, keep, path, owner, following, times, least):
    """Candidates of the next depth: (older words + w) where w's own context is retained and the pair is common enough."""
    common = times >= least
    older = [p[owner[common]] for p in path]
    # the words of the new context, nearest first: the entry's next word, then the old context
    words_ = [following[common], *older]
    nearest = list(_suffixes(words_))
    is_state = find(tree.levels[depth - 1].state, nearest[depth - 1]) >= 0
    is_state &= words_[0] != END
    if not is_state.any():
        return []
    return [(nearest[depth][is_state], times[common][is_state], [w[is_state] for w in words_])]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        scale = np.log10(tree.spread) if tree.spread > 0 else 0.0
        for batch in batches:
            row_ids = batch.column(batch.schema.get_field_index("row")).to_numpy()
            for rows, data, offsets in text_blocks(batch):
                word, first = tokens(data, offsets)
                size = first[1:] - first[:-1]
                row = np.repeat(np.arange(len(size)), size)
                common = find(tree.word, word)
                known = common >= 0
                count = np.where(known, tree.count[common] if len(tree.count) else 0, 0)
                # a rare word adds log10(count + 0.1) later, when it has met its count
                base = np.where(known, np.log10(count + 0.1), 0.0) - scale
                score = base.copy()
                chain = contexts(word, first, len(tree.levels))
                alive = np.ones(len(word), bool)
                p, factor = (count + 0.1) / tree.spread, np.ones(len(word))
                for own, (context, deep) in zip(tree.levels, chain):
                    alive = alive & deep
                    at = np.flatnonzero(alive)
                    state = find(own.state, context[at])
                    alive[at[state < 0]] = False
                    at, state = at[state >= 0], state[state >= 0]
                    entry = find(own.key, followed(context[at], word[at]))
                    n = np.where(entry >= 0, own.count[entry] if len(own.count) else 0, 0)
                    p[at] = (n + own.back[state] * p[at]) / (own.total[state] + PSEUDO)
                    factor[at] *= own.back[state] / (own.total[state] + PSEUDO)
                score = np.where(known, np.log10(p), base + np.log10(factor))
                n = len(size)
                ids = row_ids[rows]
                code, times = np.unique(np.stack([row[~known].astype(U64), word[~known]]), axis=1, return_counts=True) \
                    if (~known).any() else (np.zeros((2, 0), U64), np.zeros(0, np.int64))
                own = [batch.column(batch.schema.get_field_index(c)).slice(rows.start, n) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[ids, ids[code[0].astype(np.int64)]]),
                     *(pa.concat_arrays([c, pa.nulls(len(times), c.type)]) for c in own),
                     pa.array(np.r_[signed(mix(ids.view(U64))), signed(code[1])]),
                     pa.array(np.r_[np.zeros(n, np.int64), times]),
                     pa.array(np.r_[size, np.zeros(len(times), np.int64)]),
                     pa.array(np.r_[np.bincount(row[known], minlength=n), np.zeros(len(times), np.int64)]),
                     pa.array(np.r_[np.bincount(row, base, minlength=n), np.zeros(len(times))]),
                     pa.array(np.r_[np.bincount(row, score, minlength=n), np.zeros(len(times))])],
                    names=["row", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Learned from rows that are not ``held_out``. A null or empty text is its end token. Without training rows nothing is
    known, and both scores are 0. Repeated rows each get a row; a null doc_id is learned from (its hash is null) and stays;
    further columns are ignored; no rows give no rows.
    """
    out = F.coalesce(held_out(), F.lit(False)) if learn_from is None else ~learn_from
    rows = docs.select("doc_id", "text", out.alias("held_out"))
    tree, counts = fit(rows.filter(~F.col("held_out")))
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one row for each text and one for each of its rare words, which meets its count before both are summed
    parts = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _score(shared), f"row long, doc_id {kind}, held_out boolean, word long, times long, n_tokens long, n_known long, "
                        "base_score double, score double")
    rare = counts.filter(F.col("n") < enough(tree.n)[1]).withColumnRenamed("n", "count")
    met = parts.join(rare, "word", "left")
    gain = F.when(F.col("times") > 0, F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.1))).otherwise(0.0)
    summed = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + gain).alias("base_score"), F.sum(F.col("score") + gain).alias("score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"),
                         "base_score", "score")
