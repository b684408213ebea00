"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Document frequencies of all shingles of all documents, in a hashed table of ``IDF_SLOTS`` counters. A shingle's weight
   is count x log(1 + documents / frequency of its slot). The table's size does not depend on the corpus, and the share of
   foreign counts in a slot only on the length of the texts.
2. Each text gives ``SAMPLES`` consistent samples; two texts agree on a sample with a probability equal to their weighted
   Jaccard similarity. ``BANDS`` keys of ``ROWS`` samples each; texts with the same shingles share one node.
3. Texts with an equal key meet in a bucket. Pairs that agree on a share of ``PROPOSE`` of all samples are candidates, in
   the first band that they share only. A bucket returns the clusters of its candidates, never pairs.
4. The texts of a cluster meet in one task, which verifies every candidate pair of it on whole texts at once. Similarities
   of ``threshold`` or more are links; a task returns a spanning forest of them and their number for each text. Classes
   are the components of links, never of estimates.

Buckets above ``BUCKET`` texts are cut into parts, and every two parts meet in a block of their own; clusters above
``CHUNK`` shingles likewise. So a task's share is bounded and no candidate is lost; the work on a bucket of different near
copies grows with the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import U64, mix, signed, text_blocks
from corpusgraph.llm.components import components
from corpusgraph.llm.shingles import shingles
from corpusgraph.session import materialize

IDF_SLOTS = 1 << 16
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
THRESHOLD = 0.8
#: Estimated similarity from which a pair is verified.
PROPOSE = 0.6
BUCKET = 1000
#: Shingles of a cluster's texts that meet in one task, twice.
CHUNK = 1 << 18
_CELLS = 1 << 20
_TABLE_BITS = 12
_BLOCK = 1 << 19


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) law, by bisection of its distribution 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_quantiles(1 << _TABLE_BITS)
_LOG_GAMMA = np.log(_GAMMA)
_UNIFORM = (np.arange(1 << _TABLE_BITS) + 0.5) / (1 << _TABLE_BITS)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=U64)) | U64(1)


def _slots(value: np.ndarray) -> np.ndarray:
    return (value >> U64(48)).astype(np.int64)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, documents = np.zeros(IDF_SLOTS, np.int64), 0
    for batch in batches:
        for _, data, offsets in text_blocks(batch):
            row, value, _ = shingles(data, offsets)
            counts += np.bincount(_slots(value), minlength=IDF_SLOTS)
            documents += len(np.unique(row))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[counts[used], documents])],
                                     names=["slot", "n"])


def idf_table(docs: DataFrame) -> np.ndarray:
    """log(1 + documents / frequency) for each slot; the driver sees at most ``IDF_SLOTS`` + 1 numbers."""
    rows = (docs.select("text").mapInArrow(_count_slots, "slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).toPandas())
    total = int(rows.loc[rows.slot < 0, "n"].sum())
    frequency = np.ones(IDF_SLOTS)
    rows = rows[rows.slot >= 0]
    frequency[rows.slot.to_numpy()] = rows.n.to_numpy()
    return np.log1p(max(total, 1) / frequency)


def _samples(row: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their samples as 64-bit values)."""
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][:len(row)])
    size = np.diff(np.r_[begins, len(row)])
    owner = np.repeat(np.arange(len(begins)), size)
    log_weight, mask = np.log(weight), U64((1 << _TABLE_BITS) - 1)
    out = np.empty((len(begins), SAMPLES), U64)
    for j, seed in enumerate(_SEEDS):
        with np.errstate(over="ignore"):
            code = value * seed
        r = _GAMMA[code >> U64(64 - _TABLE_BITS)]
        log_c = _LOG_GAMMA[(code >> U64(64 - 2 * _TABLE_BITS)) & mask]
        beta = _UNIFORM[(code >> U64(64 - 3 * _TABLE_BITS)) & mask]
        step = np.floor(log_weight / r + beta)
        log_a = log_c - r * (step - beta + 1)
        least = np.minimum.reduceat(log_a, begins)
        hit = np.flatnonzero(log_a == least[owner])
        hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
        with np.errstate(over="ignore"):
            out[:, j] = mix(value[hit] + step[hit].astype(np.int64).view(U64) * _SEEDS[0])
    return row[begins], out


def _sketch(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for rows, data, offsets in text_blocks(batch, limit=_BLOCK):
                row, value, times = shingles(data, offsets)
                n = rows.stop - rows.start
                block_ids = ids.slice(rows.start, n)
                if not len(row):
                    has, sample, prints = np.zeros(0, np.int64), np.zeros((0, SAMPLES), U64), np.zeros((2, 0), U64)
                    size = np.zeros(0, np.int64)
                else:
                    has, sample = _samples(row, value, times * table[_slots(value)])
                    begins = np.searchsorted(row, has)
                    size = np.add.reduceat(times, begins)
                    with np.errstate(over="ignore"):
                        prints = [np.add.reduceat(mix(value * s + times.astype(U64)), begins)
                                  for s in (_SEEDS[1], _SEEDS[2])]
                sample &= U64(0xFFFFFFFF)
                keys = np.empty((len(has), BANDS), U64)
                with np.errstate(over="ignore"):
                    for b in range(BANDS):
                        key = np.full(len(has), b + 1, U64)
                        for j in range(ROWS):
                            key = mix(key * _SEEDS[3] + sample[:, b * ROWS + j])
                        keys[:, b] = key
                short = np.ascontiguousarray(sample.astype("<u4"))
                place = np.full(n, -1)
                place[has] = np.arange(len(has))
                take = pa.array(place, mask=place < 0)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(signed(keys.ravel())))
                packed = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * SAMPLES), len(has), [None, pa.py_buffer(short.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [block_ids, pa.array(signed(np.asarray(prints[0]))).take(take),
                     pa.array(signed(np.asarray(prints[1]))).take(take), listed.take(take), packed.take(take),
                     pa.array(size, pa.int64()).take(take)],
                    names=["doc_id", "print1", "print2", "keys", "sample", "size"])

    return run


def candidates(ids: np.ndarray, sample: np.ndarray, band: int = 0, *sides: np.ndarray) -> np.ndarray:
    """Which pairs (earlier row, later row) are verified in ``band``: different ids, enough equal samples, no equal band
    before, and different in each of ``sides``."""
    n = len(ids)
    near = np.triu(ids[:, None] != ids[None, :], 1)
    for side in sides:
        near &= side[:, None] != side[None, :]
    agree, whole = np.zeros((n, n), np.uint8), np.ones((n, n), bool)
    for j in range(SAMPLES):
        same = sample[:, j, None] == sample[None, :, j]
        agree += same
        if j < band * ROWS:
            whole = same if j % ROWS == 0 else whole & same
            if j % ROWS == ROWS - 1:
                near &= ~whole
    return near & (agree >= PROPOSE * SAMPLES)


def _clusters(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First row of each row's component under the links (a, b)."""
    first = np.arange(n)
    while True:
        low, new = np.minimum(first[a], first[b]), first.copy()
        np.minimum.at(new, first[a], low)
        np.minimum.at(new, first[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == first).all():
            return first
        first = new


def propose(ids: np.ndarray, sample: np.ndarray, near: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of one bucket's candidates and the cluster of each row, as the index of its first row."""
    cluster = _clusters(len(ids), *np.nonzero(candidates(ids, sample) if near is None else near))
    return [(int(ids[j]), int(ids[i])) for i, j in enumerate(cluster) if i != j], cluster


def _grouped(batches, width: int):
    """Lists of successive rows that agree in their first ``width`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][:width] != row[:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matrix(samples: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(samples), "<u4").reshape(len(samples), SAMPLES)


def _bucket_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, high, doc_id, band, side, size, sample) ordered by the first four -> the groups to verify.

    A group is named by band, whether its pairs lie across the sides and across the chunks, and where it comes from.
    """
    names = ["group", "doc_id", "side", "chunk", "sample"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]

    def record(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    found: list[tuple] = []
    for rows in _grouped(batches, 3):
        (key, low, high), band = rows[0][:3], rows[0][4]
        ids = np.array([r[3] for r in rows])
        sample, side, size = _matrix([r[7] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        pairs, cluster = propose(ids, sample, candidates(ids, sample, band, *([side] if low < high else [])))
        if not pairs:
            continue
        firsts, count = np.unique(cluster, return_counts=True)
        for first in firsts[count > 1]:
            member = np.flatnonzero(cluster == first)
            chunk = (np.cumsum(size[member]) - size[member]) // CHUNK
            parts = np.unique(chunk)
            for at, x in enumerate(parts):
                for y in parts[at:]:
                    name = f"{band},{int(low < high)},{int(x < y)},{key},{low},{high},{first},{x},{y}"
                    found += [(name, int(ids[i]), bool(side[i]), bool(c == y), rows[i][7])
                              for i, c in zip(member, chunk) if c in (x, y)]
        if len(found) > 20_000:
            yield record(found)
            found = []
    if found:
        yield record(found)


def _groups(nodes: DataFrame, bucket: int) -> DataFrame:
    """(group, doc_id, side, chunk, sample): texts of ``nodes`` whose candidate pairs are verified together."""
    rows = nodes.select("doc_id", "size", F.posexplode("keys").alias("band", "key"))
    full = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.when(F.col("n") > bucket, F.ceil(2 * F.col("n") / bucket)).otherwise(1).cast("long")
    dealt = (rows.join(full, "key").withColumn("parts", parts)
             .withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")))
             .join(nodes.select("doc_id", "sample"), "doc_id")
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    return (dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "doc_id",
                         "band", (F.col("part") > F.col("other")).alias("side"), "size", "sample")
            .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "doc_id")
            .mapInArrow(_bucket_pass, "group string, doc_id long, side boolean, chunk boolean, sample binary"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard of two (hash, count) runs."""
    wa, wb = a[1] * idf[_slots(a[0])], b[1] * idf[_slots(b[0])]
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(wa[ia], wb[ib]).sum()
    whole = wa.sum() + wb.sum() - shared
    return float(shared / whole) if whole else 0.0


def links(runs: list[tuple[np.ndarray, np.ndarray]], near: np.ndarray, idf: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of ``near`` have a weighted Jaccard of ``threshold`` or more; all at once, over their common shingles."""
    n = len(runs)
    value, times = (np.concatenate(x) for x in zip(*runs))
    row = np.repeat(np.arange(n), [len(v) for v, _ in runs])
    weight = idf[_slots(value)]
    whole = np.bincount(row, weight * times, n)
    # the k-th occurrence of a shingle is a feature of its own, so that smaller counts are what two texts share
    at = np.repeat(np.arange(len(value)), times)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    _, feature, count = np.unique(mix(value[at] ^ mix(turn.astype(U64))), return_inverse=True, return_counts=True)
    common = count[feature] > 1
    at, feature = at[common], (np.cumsum(count > 1) - 1)[feature[common]]
    order = np.argsort(feature, kind="stable")
    at, feature = at[order], feature[order]
    shared, step = np.zeros((n, n)), max(64, _CELLS // n)
    for begin in range(0, int(feature[-1]) + 1 if len(feature) else 0, step):
        i, j = np.searchsorted(feature, [begin, begin + step])
        has, by = np.zeros((n, step)), np.zeros(step)
        has[row[at[i:j]], feature[i:j] - begin] = 1
        by[feature[i:j] - begin] = weight[at[i:j]]
        shared += (has * by) @ has.T
    union = whole[:, None] + whole[None, :] - shared
    score = np.divide(shared, union, out=np.zeros((n, n)), where=union > 0)
    found = near & (score >= threshold)
    for i, j in zip(*np.nonzero(near & (np.abs(score - threshold) < 1e-9))):
        found[i, j] = similarity(runs[i], runs[j], idf) >= threshold
    return found


def _verify(idf, threshold: float):
    """Rows (group, doc_id, side, chunk, sample, text) ordered by group and doc_id -> spanning links (a, b, null) and the
    number of links (a, null, n) of each text in its group."""
    def read(batches):
        """The text of each row replaced by its shingles, few texts at a time."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part, runs = batch.slice(begin, min(512, batch.num_rows - begin)), []
                for _, data, offsets in text_blocks(part):
                    row, value, times = shingles(data, offsets)
                    cut = np.searchsorted(row, np.arange(len(offsets)))
                    runs += [(value[i:j], times[i:j]) for i, j in zip(cut[:-1], cut[1:])]
                yield from zip(*(part.column(i).to_pylist() for i in range(5)), runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for _, rows in groupby(read(batches), key=lambda r: r[0]):
            rows = list({r[1]: r for r in rows}.values())
            band, sides, chunks = map(int, rows[0][0].split(",")[:3])
            ids = np.array([r[1] for r in rows])
            across = [np.array([r[i] for r in rows]) for i, wanted in ((2, sides), (3, chunks)) if wanted]
            near = candidates(ids, _matrix([r[4] for r in rows]), band, *across)
            found = links([r[5] for r in rows], near, table, threshold)
            if not found.any():
                continue
            first = _clusters(len(ids), *np.nonzero(found))
            number = found.sum(0) + found.sum(1)
            tree, counted = np.flatnonzero(first != np.arange(len(ids))), np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[first[tree]], ids[counted]], pa.int64()),
                 pa.array(ids[tree].tolist() + [None] * len(counted), pa.int64()),
                 pa.array([None] * len(tree) + number[counted].tolist(), pa.int64())], names=["a", "b", "n"])

    return run


def links_and_nodes(docs: DataFrame, threshold: float = THRESHOLD,
                    bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links a, b that span the classes of different texts; node, n_links; node of every document)."""
    spark = docs.sparkSession
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = spark.sparkContext.broadcast(idf_table(rows))
    sketch = materialize(rows.mapInArrow(
        _sketch(idf), "doc_id long, print1 long, print2 long, keys array<long>, sample binary, size long"), "sketch")
    firsts = sketch.filter("print1 is not null").groupBy("print1", "print2").agg(F.min("doc_id").alias("node"))
    nodes = (sketch.join(firsts.select(F.col("node").alias("doc_id"), "print1", "print2"),
                         ["doc_id", "print1", "print2"]).select("doc_id", "keys", "sample", "size")
             .dropDuplicates(["doc_id"]))
    groups = materialize(_groups(nodes, bucket), "groups")
    wanted = groups.select("doc_id").distinct()
    # one plan at every size: the ids wanted grow with the corpus, so that they are not broadcast even while they are few
    texts = materialize(rows.join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id"]), "texts")
    found = materialize(
        groups.join(texts.hint("merge"), "doc_id").select("group", "doc_id", "side", "chunk", "sample", "text")
        .repartition("group").sortWithinPartitions("group", "doc_id")
        .mapInArrow(_verify(idf, threshold), "a long, b long, n long"), "links")
    degree = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return (found.filter("b is not null").select("a", "b"), degree,
            sketch.select("doc_id", "print1", "print2").join(firsts, ["print1", "print2"], "left"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id among documents joined by links of similarity ``threshold`` or more, or by having the
    same shingles (copies); n_links counts the links of the document's shingle set to different ones. Null and empty texts
    and texts without a word are classes of their own, so is a row without doc_id (class_id null). Rows that repeat a
    doc_id count as the same document. Further columns are ignored; no rows give no rows.
    """
    spanning, degree, nodes = links_and_nodes(docs, threshold, bucket)
    grouped = components(spanning)
    known = grouped.join(degree, "node")
    firsts = (nodes.filter("node = doc_id").select("node", "print1", "print2").distinct()
              .join(known, "node").select("print1", "print2", "class", "n_links"))
    plain = nodes.join(firsts, ["print1", "print2"], "left").select(
        "doc_id", F.coalesce("class", "node", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    bare = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"),
                                                F.lit(None).cast("long").alias("class_id"),
                                                F.lit(0).cast("long").alias("n_links"))
    return plain.unionByName(bare)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class (the smallest doc_id, once), all columns; rows without doc_id stay."""
    kept = classes(docs, threshold).filter("doc_id = class_id").select("doc_id").distinct()
    return (docs.join(kept, "doc_id").dropDuplicates(["doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
            .unionByName(docs.filter("doc_id is null")))
