"""Benchmark decontamination by spaced-seed hashing.

Each mask picks some of the word positions of a window and ignores the others, so that substituted words fall into the gaps
of some window. Windows of benchmark items and of texts with equal hashes are joined, and around each hit the overlap along
its diagonal is verified: a stretch is contamination if ``MIN_MATCH`` words agree in it (all words of a shorter item) and at
least ``AGREE`` of every ``AGREE`` + 1.

A bitmap of the benchmark's hashes of bounded size goes to the tasks, so that only windows of texts that may hit are
shuffled. A benchmark beyond the bitmap's bound makes it less selective, never wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import U64, mix, signed, text_blocks, words
from corpusgraph.session import materialize

#: Fixed masks: 1 counts, 0 is ignored. Every stretch that the verification accepts in an item of ``MIN_MATCH`` words or more
#: holds a window of one of them without a substitution, whatever the pattern of the others (a test proves it); a shorter
#: item must agree in all words, so that the last mask finds it.
MASKS = ["111011", "1100001011", "111100001", "11111"]
MIN_MATCH, AGREE = 12, 3
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
_FACTORS = mix(np.arange(901, 901 + max(map(len, MASKS)), dtype=U64)) | U64(1)


def windows(word: np.ndarray, first: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all windows of a mask that lie within one text."""
    pattern = MASKS[mask]
    m = len(word) - len(pattern) + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    value = np.full(m, mask + 1, U64)
    with np.errstate(over="ignore"):
        for j, used in enumerate(pattern):
            if used == "1":
                value += word[j:m + j] * _FACTORS[j]
    end = np.repeat(first[1:], first[1:] - first[:-1])[:m]
    at = np.flatnonzero(np.arange(m) + len(pattern) <= end)
    return at, mix(value[at])


def _benchmark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for rows, data, offsets in text_blocks(batch):
            word, _, _, first = words(data, offsets)
            size = first[1:] - first[:-1]
            seeds: list[list[dict]] = [[] for _ in size]
            for mask in range(len(MASKS)):
                at, value = windows(word, first, mask)
                row = np.searchsorted(first, at, "right") - 1
                for r, a, v in zip(row, at - first[row], signed(value)):
                    seeds[r].append({"hash": int(v), "at": int(a)})
            for r in range(len(size)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[rows.start + r]], pa.int64()),
                     pa.array([signed(word[first[r]:first[r + 1]])], pa.list_(pa.int64())),
                     pa.array([seeds[r]], pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())])))],
                    names=["item_id", "item", "seeds"])


def _bit(value: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return ((value >> U64(32 * probe)) & U64(bits - 1)).astype(np.int64)


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Packed bits of two probes per hash; at most MAX_BITS / 64 words reach the driver."""
    n = seeds.count()
    bits = MIN_BITS
    while bits < min(16 * n, MAX_BITS):
        bits *= 2
    probes = F.array(*[F.shiftrightunsigned("hash", 32 * p).bitwiseAND(F.lit(bits - 1)) for p in range(2)])
    rows = (seeds.select(F.explode(probes).alias("bit"))
            .groupBy(F.shiftright("bit", 5).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("value")).toPandas())
    out = np.zeros(bits // 32, np.uint32)
    out[rows["word"].to_numpy().astype(np.int64)] = rows["value"].to_numpy().astype(np.uint32)
    return out


def _may_hit(bitmap: np.ndarray, value: np.ndarray) -> np.ndarray:
    ok = np.ones(len(value), bool)
    for probe in range(2):
        bit = _bit(value, 32 * len(bitmap), probe)
        ok &= (bitmap[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) > 0
    return ok


def _regions(shared, margin: int):
    """One row for each stretch of a text with possible hits: its words, ``margin`` more on both sides, and the hashes that may
    hit. With the longest item's words as margin, every diagonal through a hit lies in one region."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            ids, out = batch.column(0), []
            for rows, data, offsets in text_blocks(batch):
                word, _, _, first = words(data, offsets)
                found = []
                for mask in range(len(MASKS)):
                    at, value = windows(word, first, mask)
                    hit = _may_hit(bitmap, value)
                    found.append((at[hit], value[hit]))
                at, value = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(at, kind="stable")
                at, value = at[order], signed(value[order])
                row = np.searchsorted(first, at, "right") - 1
                cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] - at[:-1] > margin), True]) \
                    if len(at) else np.zeros(1, int)
                for i, j in zip(cuts[:-1], cuts[1:]):
                    r = row[i]
                    low, high = max(first[r], at[i] - margin), min(first[r + 1], at[j - 1] + max(map(len, MASKS)) + margin)
                    out.append((ids[rows.start + int(r)].as_py(), int(low - first[r]), signed(word[low:high]),
                                [{"hash": int(v), "at": int(a - low)} for a, v in zip(at[i:j], value[i:j])]))
            if out:
                doc, begin, part, seeds = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(begin, pa.int64()), pa.array(part, pa.list_(pa.int64())),
                     pa.array(seeds, kind)], names=["doc_id", "begin", "words", "seeds"])

    return run


def overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The accepted stretch with most agreeing words where item word i faces text word i + shift, the shortest and then the
    earliest of equal ones: (first item word, words, words that agree), all 0 if none is accepted."""
    low, high = max(0, -shift), min(len(item), len(text) - shift)
    agree = item[low:high] == text[low + shift:high + shift]
    # a stretch holds AGREE of AGREE + 1 words if its sum of +1 and -AGREE is not negative
    total = np.r_[0, np.cumsum(np.where(agree, 1, -AGREE))]
    count = np.r_[0, np.cumsum(agree)]
    # the longest such stretch to each end begins where the sum first falls as low
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    best = count - count[start]
    most = int(best.max())
    if most < min(MIN_MATCH, len(item)) or not most:
        return 0, 0, 0
    first = np.flatnonzero(agree)
    found = []
    for end in np.flatnonzero(best == most):
        # without the differing words at its ends
        a, b = first[count[start[end]]], first[count[end] - 1] + 1
        found.append((int(b - a), int(a)))
    size, at = min(found)
    return low + at, size, most


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        names = batch.schema.names
        col = {n: batch.column(i) for i, n in enumerate(names)}
        for i in range(batch.num_rows):
            text = col["words"][i].values.to_numpy(zero_copy_only=False)
            item = col["item"][i].values.to_numpy(zero_copy_only=False)
            shift = col["shift"][i].as_py()
            at, size, agree = overlap(text, item, shift)
            if size:
                out.append((col["doc_id"][i].as_py(), col["item_id"][i].as_py(), agree, size,
                            col["begin"][i].as_py() + at + shift, at, agree / len(item)))
        if out:
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.float64())],
                names=["doc_id", "item_id", "n_match", "n_words", "doc_word", "item_word", "share"])


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_match, n_words, doc_word, item_word, share: one row for each document and item that overlap.

    Of several overlaps of a pair the one with most agreeing words counts, the earliest of equal ones. ``share`` is
    n_match over the item's words. Null and empty texts and items overlap nothing; items below five words are not looked
    for. Rows without doc_id or item_id give none; repeated rows give one row; further columns are ignored.
    """
    items = materialize(
        benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        .mapInArrow(_benchmark, "item_id long, item array<long>, seeds array<struct<hash: long, at: long>>"), "items")
    seeds = items.select("item_id", F.explode("seeds").alias("s")).select(
        "item_id", F.col("s.hash").alias("hash"), F.col("s.at").alias("item_at"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    longest = items.agg(F.coalesce(F.max(F.size("item")), F.lit(0))).first()[0]
    regions = materialize(
        docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_regions(bitmap, longest), "doc_id long, begin long, words array<long>, seeds array<struct<hash: long, at: long>>")
        .withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = (regions.select("region", F.explode("seeds").alias("s"))
            .select("region", F.col("s.hash").alias("hash"), F.col("s.at").alias("at"))
            .join(seeds, "hash").select("region", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    faced = (hits.join(regions.drop("seeds"), "region").join(items.drop("seeds"), "item_id")
             .select("doc_id", "begin", "words", "item_id", "item", "shift"))
    found = faced.mapInArrow(_verify, "doc_id long, item_id long, n_match long, n_words long, doc_word long, "
                                      "item_word long, share double")
    best = F.max_by(F.struct("n_match", "n_words", "doc_word", "item_word", "share"),
                    F.struct("n_match", -F.col("doc_word"), -F.col("item_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; all columns; rows without doc_id stay."""
    hit = contaminations(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
