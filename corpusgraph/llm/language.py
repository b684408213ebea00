"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter serves all languages: a slot holds one bit for each language, so that the AND of an n-gram's slots is the bitmask
of all languages that (may) contain it. An n-gram enters the filter of each language in which its share of the training
n-grams is at least ``SHARE`` of its largest share in any language. For a text, the hits of each language are counted
(popcount per language), corrected for the false positives that the filter's fill predicts, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import U64, mix, signed, text_blocks

GRAMS = (3, 4)
SLOTS, PROBES = 1 << 20, 3
#: Bound of the labelled sample (documents) that the filters are fitted on.
TRAIN_DOCS = 20_000
SHARE, MIN_COUNT = 0.25, 3
#: Languages in one word of a slot; more languages take more words.
SLICE = 32
UNDETERMINED = "und"
REJECT_BELOW = 0.25
_FACTORS = mix(np.arange(501, 501 + max(GRAMS), dtype=U64)) | U64(1)
_fold = np.full(0x110000, -1, np.int32)
_BLOCK = 1 << 19


def held_out():
    """Documents that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _folded(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters; 0 for everything else."""
    out = _fold[codes]
    if len(out) and out.min() < 0:
        for code in np.unique(codes[out < 0]).tolist():
            char = chr(code)
            _fold[code] = ord(char.lower()[0]) if char.isalpha() else 0
        out = _fold[codes]
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all letter n-grams of a block, and whether each row has a letter. 0 stands for a word's edge."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), chars[1:] - chars[:-1])
    letters = np.zeros(len(codes) + n + 1, np.int32)
    owner = np.zeros(len(letters), np.int64)
    at = np.arange(len(codes)) + row + 1
    letters[at], owner[at] = _folded(codes), row
    has = np.bincount(owner[letters > 0], minlength=n) > 0
    keep = np.r_[True, (letters[1:] > 0) | (letters[:-1] > 0)]
    letters, owner = letters[keep].astype(U64), owner[keep]
    rows, hashes = [], []
    for size in GRAMS:
        m = len(letters) - size + 1
        if m <= 0:
            continue
        inner = np.ones(m, bool)
        value = np.full(m, size, U64)
        with np.errstate(over="ignore"):
            for j in range(size):
                part = letters[j:m + j]
                if 0 < j < size - 1:
                    inner &= part > 0
                value += part * _FACTORS[j]
        rows.append(owner[1:m + 1][inner])
        hashes.append(mix(value[inner]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U64), has
    return np.concatenate(rows), np.concatenate(hashes), has


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        for rows, data, offsets in text_blocks(batch):
            row, value, _ = grams(data, offsets)
            owner = code[rows][row]
            for k in np.unique(owner):
                gram, times = np.unique(value[owner == k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k]] * len(gram), pa.string()), pa.array(signed(gram)), pa.array(times.astype(np.int64))],
                    names=["lang", "gram", "n"])


@dataclass
class Filters:
    """``bits``: slots x slices of language bits; ``fill``: share of set bits of each language."""

    languages: list[str]
    bits: np.ndarray
    fill: np.ndarray


def _positions(value: np.ndarray) -> list[np.ndarray]:
    return [((value >> U64(21 * p)) & U64(SLOTS - 1)).astype(np.int64) for p in range(PROBES)]


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Filters:
    """Filters from rows (doc_id, text, lang); at most about ``train_docs`` of them, chosen by a hash of doc_id.

    The driver receives at most SLOTS words per slice, whatever the size of the corpus.
    """
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    total = rows.count()
    share = min(1.0, train_docs / max(total, 1))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = (picked.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts = counts.persist()
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    languages = [r["lang"] for r in sums]
    if not languages:
        counts.unpersist()
        return Filters([], np.zeros((SLOTS, 1), np.uint32), np.zeros(0))
    known = labelled.sparkSession.createDataFrame(
        [(r["lang"], i // SLICE, 1 << (i % SLICE), float(r["total"])) for i, r in enumerate(sums)],
        "lang string, slice int, bit long, total double")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = shares.groupBy("gram").agg(
        F.max("share").alias("top"), F.collect_list(F.struct("share", "slice", "bit", "n")).alias("in"))
    entered = (top.select("gram", "top", F.explode("in").alias("x"))
               .filter((F.col("x.share") >= SHARE * F.col("top")) & (F.col("x.n") >= MIN_COUNT)))
    probes = F.array(*[F.shiftrightunsigned("gram", 21 * p).bitwiseAND(F.lit(SLOTS - 1)) for p in range(PROBES)])
    words = (entered.select(F.explode(probes).alias("slot"), F.col("x.slice").alias("slice"), F.col("x.bit").alias("bit"))
             .groupBy("slot", "slice").agg(F.bit_or("bit").alias("bits")).toPandas())
    counts.unpersist()
    bits = np.zeros((SLOTS, -(-len(languages) // SLICE)), np.uint32)
    bits[words["slot"].to_numpy().astype(np.int64), words["slice"].to_numpy().astype(np.int64)] = \
        words["bits"].to_numpy().astype(np.uint32)
    fill = np.array([((bits[:, i // SLICE] >> np.uint32(i % SLICE)) & 1).mean() for i in range(len(languages))])
    return Filters(languages, bits, fill)


def decide(filters: Filters, row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, corrected share of n-grams) for each of ``n`` rows."""
    if not filters.languages:
        return np.full(n, -1), np.zeros(n)
    mask = None
    for at in _positions(value):
        mask = filters.bits[at] if mask is None else mask & filters.bits[at]
    total = np.bincount(row, minlength=n)
    false = filters.fill ** PROBES
    corrected = np.empty((n, len(filters.languages)))
    for i in range(len(filters.languages)):
        hit = (mask[:, i // SLICE] >> np.uint32(i % SLICE)) & np.uint32(1)
        count = np.bincount(row, hit, minlength=n)
        corrected[:, i] = (count - total * false[i]) / max(1 - false[i], 1e-9)
    best = corrected.argmax(axis=1)
    score = np.clip(corrected[np.arange(n), best] / np.maximum(total, 1), 0, 1)
    return best, score


def _predict(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = filters.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            labels, scores = [], []
            for rows, data, offsets in text_blocks(batch, limit=_BLOCK):
                row, value, has = grams(data, offsets)
                best, score = decide(model, row, value, rows.stop - rows.start)
                labels.append(names[np.where(has, best, -1)])
                scores.append(np.where(has, score, 0.0))
            index = [batch.schema.get_field_index(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in index),
                 pa.array(np.concatenate(labels) if labels else [], pa.string()),
                 pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*(batch.schema.names[i] for i in index), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Ties go to the first language in
    alphabetical order. Repeated rows each get a row; a null doc_id stays; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """``docs`` without the documents that are rejected: undetermined ones and those whose best language explains less than
    ``reject_below`` of the n-grams. Learned from the labelled documents of ``docs`` that are not held out."""
    from corpusgraph.llm.tables import pack, unpack

    filters = fit(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    packed = pack(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _predict(shared)(iter([batch])):
                keep = np.array([x is not None and x != UNDETERMINED for x in found.column(2).to_pylist()], bool)
                keep &= found.column(3).to_numpy() >= reject_below
                yield batch.filter(pa.array(keep))

    return unpack(packed.mapInArrow(run, packed.schema), docs.columns)
