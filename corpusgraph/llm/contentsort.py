"""Exact deduplication by sorting contents.

Sampled splitters range-partition the normalised texts by their first characters, a hash that tells texts with a common
beginning apart, and a hash of the identifier, so that even the rows of one very frequent text are dealt over many partitions.
Each partition is sorted on the whole content (externally, by Spark), so that equal texts lie next to each other, the row to
keep first. One pass over a partition compares every text in full with its predecessor and closes a run where they differ. Only
runs at the edges of a partition can go on in another one: those few meet once more by their full text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.tables import pack, unpack
from corpusgraph.session import materialize

#: Characters of the normalised text in a splitter; a splitter is this long at most, whatever the texts are.
HEAD = 32


def normalised(text: str) -> Column:
    """A text without blanks, tabs, line feeds, form feeds and carriage returns; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _runs(carried: list[str]):
    """Rows of a sorted partition with their run; ``carried`` columns go on with the first row of each run only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # the open run, without texts but for its first row
        number, before, last_print, collides = -1, None, None, False

        def emit(rows: pa.RecordBatch, edge: np.ndarray, size: np.ndarray, first_number: int) -> pa.RecordBatch:
            """Closed runs: ``rows`` begin with a run, ``size`` and ``edge`` are given for each run."""
            begin = np.cumsum(size) - size
            at = np.repeat(begin, size)
            first = np.zeros(rows.num_rows, bool)
            first[begin] = True
            digest = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in rows["norm"].take(pa.array(begin))])
            of = np.repeat(np.arange(len(size)), size)
            row = np.arange(len(of))
            ends = pa.array(row, mask=~(first & edge[of]))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(of), part, np.int32)), pa.array(first_number + of), rows["doc_id"], rows["chars"],
                 rows["doc_id"].take(pa.array(at)), pa.array(size[of]), pa.array(first), pa.array(edge[of]),
                 digest.take(pa.array(of)), rows["norm"].take(ends),
                 *(rows[c].take(pa.array(row, mask=~first)) for c in carried)],
                names=["part", "run", "doc_id", "chars", "keep_id", "group_size", "kept", "edge", "text_sha256", "norm",
                       *carried])

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            """The open run; its rows may be many, so they go out as they came in."""
            total = sum(b.num_rows for b in held)
            lead = held[0].slice(0, 1)
            digest = hashlib.sha256(lead["norm"][0].as_buffer()).hexdigest()
            for i, b in enumerate(held):
                out = emit(b, np.array([edge and i == 0]), np.array([b.num_rows]), number)
                n = b.num_rows
                kept = np.zeros(n, bool)
                kept[0] = i == 0
                new = {"keep_id": pa.array([lead["doc_id"][0]] * n, lead["doc_id"].type), "group_size": pa.array(np.full(n, total)),
                       "kept": pa.array(kept), "edge": pa.array(np.full(n, edge)), "text_sha256": pa.array([digest] * n)}
                yield pa.RecordBatch.from_arrays([new.get(c, out[c]) for c in out.schema.names], schema=out.schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            norm = batch["norm"].cast(pa.large_binary())
            prints = batch["print"].to_numpy()
            batch = pa.RecordBatch.from_arrays([norm if c == "norm" else batch[c] for c in batch.schema.names],
                                               names=batch.schema.names)
            fresh = np.ones(len(norm), bool)
            fresh[1:] = ~pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = before is None or norm[0].as_py() != before
            begin = np.flatnonzero(fresh)
            if not len(begin):
                held.append(_light(batch, carried))
                continue
            if begin[0] > 0:
                held.append(_light(batch.slice(0, begin[0]), carried))
            same = prints[begin] == np.r_[last_print if last_print is not None else ~prints[0], prints[begin[:-1]]]
            if held:
                yield from close(number == 0 or collides or bool(same[0]))
            if len(begin) > 1:
                edge = same | np.r_[same[1:], False]
                edge[0] |= number == -1
                yield emit(batch.slice(begin[0], begin[-1] - begin[0]), edge[:-1], np.diff(begin), number + 1)
            number += len(begin)
            last_print, before, collides = prints[begin[-1]], norm[begin[-1]].as_py(), bool(same[-1])
            held = [batch.slice(begin[-1], 1), *([_light(batch.slice(begin[-1] + 1), carried)]
                                                 if begin[-1] + 1 < len(norm) else [])]
        if held:
            yield from close(True)

    return run


def _light(batch: pa.RecordBatch, carried: list[str]) -> pa.RecordBatch:
    """Rows of an open run behind its first one: their texts are dropped at once, so that the run stays small in memory."""
    drop = {"norm", *carried}
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [pa.array([b""] * n, batch[c].type) if c == "norm" else pa.nulls(n, batch[c].type) if c in drop else batch[c]
         for c in batch.schema.names], schema=batch.schema)


def _groups(rows: DataFrame, carried: list[str]) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the ``carried`` columns of kept rows, of (doc_id, text, carried)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    dealt = (rows.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), normalised("text").alias("norm"),
                         *carried)
             .withColumn("print", F.xxhash64("norm")).withColumn("head", F.substring("norm", 1, HEAD))
             .repartitionByRange("head", "print", F.xxhash64("doc_id"))
             .sortWithinPartitions("head", "print", "norm", F.desc("chars"), F.asc_nulls_last("doc_id"))
             .select("doc_id", "chars", "norm", "print", *carried))
    runs = materialize(dealt.mapInArrow(
        _runs(carried), f"part int, run long, doc_id {kind}, chars int, keep_id {kind}, group_size long, kept boolean, "
                        f"edge boolean, text_sha256 string, norm binary{kinds}"), "runs")
    # two runs of a partition at most (but for equal hashes of different texts), each with its text once
    ends = runs.filter("edge and kept").select("part", "run", "doc_id", "chars", "group_size", "norm")
    whole = ends.groupBy("norm").agg(
        F.sum("group_size").alias("all_size"),
        F.min(F.struct((-F.col("chars")).alias("chars"), F.isnull("doc_id").alias("no_id"), "doc_id", "part", "run")).alias("best"))
    met = ends.join(whole, "norm").select("part", "run", "all_size", "best")
    stitched = runs.filter("edge").join(met, ["part", "run"]).withColumns({
        "keep_id": F.col("best.doc_id"), "group_size": F.col("all_size"),
        "kept": F.col("kept") & (F.col("best.part") == F.col("part")) & (F.col("best.run") == F.col("run"))})
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *carried]
    return runs.filter("not edge").select(*columns).unionByName(stitched.select(*columns))


def content_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text).

    Texts are equal if identical without white space (``normalised``; null counts as empty). Of equal texts the row with the
    most characters stays, of these the one with the smallest doc_id (null last). Exactly one row of each group is ``kept``, also
    where rows repeat or doc_id is null; ``keep_id`` is its doc_id. Very long texts are compared in full. Further columns are
    ignored; no rows give no rows.
    """
    return _groups(docs.select("doc_id", "text"), [])


def deduplicate(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, with all their columns, whatever these are called; cases as in ``content_groups``."""
    packed = pack(docs).withColumn("whole", F.struct("text", "rest")).select("doc_id", "text", "whole")
    kept = _groups(packed, ["whole"]).filter("kept").select("doc_id", "whole.text", "whole.rest")
    return unpack(kept, docs.columns)
