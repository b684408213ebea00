"""Nesting inside one file by sorting and stacks: block ends, deciding lines, smallest containing chunk.

Each takes whole columns of a file's lines or chunks as arrays and is near linear in them, so that a long file costs what its
length costs (a slice of an array in the JVM would copy the whole array for each block). Texts are unpacked and handed back a few
megabytes at a time, so that a task's memory does not follow the number of files in an Arrow batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())
#: Bytes of text that a task unpacks, or hands back, at a time (or one longer text).
PART_BYTES = 1 << 21
#: Added to a function's line, so that functions come after a file's classes.
FUNCTION_PASS = 1_000_000_000
CHUNK_ROW = ("path string, project_id string, language string, start_line int, end_line int, node_type string, name string, "
             "content string, list_no int")
CHUNK_ARROW = pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in CHUNK_ROW.split(", ")])


def block_spans(no: np.ndarray, indent: np.ndarray, is_class: np.ndarray, head: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(last line, whether inside a class) of the blocks that begin at the lines ``head``, which are among the solid lines ``no``.

    A block ends before the next line that is not deeper than its header. It is in a class if the nearest line above that is
    shallower and a class, or not deeper and no class, is a class.
    """
    head = np.searchsorted(no, head)
    end, method = np.full(len(head), last, np.int64), np.zeros(len(head), bool)
    for depth in np.unique(indent[head]):
        own = np.flatnonzero(indent[head] == depth)
        at = head[own]
        closing = np.flatnonzero(indent <= depth)
        after = np.searchsorted(closing, at, "right")
        found = after < len(closing)
        end[own[found]] = no[closing[after[found]]] - 1
        deciding = np.flatnonzero(np.where(is_class, indent < depth, indent <= depth))
        before = np.searchsorted(deciding, at, "left") - 1
        method[own] = (before >= 0) & is_class[deciding[np.maximum(before, 0)]] if len(deciding) else False
    return end, method


def brace_ends(brace_no: np.ndarray, step: np.ndarray, head_no: np.ndarray, last: int) -> np.ndarray:
    """Line of the first closing brace that brings the depth counted from each header line back to zero, else ``last``."""
    depth = np.cumsum(step)
    first = np.searchsorted(brace_no, head_no, "left")
    base = np.r_[0, depth][first]
    closing = np.flatnonzero(step < 0)
    order = np.lexsort((closing, depth[closing]))
    closing = closing[order]
    # (depth, place) as one number each, so that one search finds the next place of that depth
    width = len(step) + 1
    low = int(min(depth.min(initial=0), 0))
    keys = (depth[closing] - low) * width + closing
    at = np.searchsorted(keys, (base - low) * width + first, "left")
    hit = at < len(closing)
    hit[hit] &= depth[closing[at[hit]]] == base[hit]
    end = np.full(len(head_no), last, np.int64)
    end[hit] = brace_no[closing[at[hit]]]
    return end


def smallest_around(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the shortest earlier interval that reaches as far as each one, or -1; intervals come in start order, and the
    first of equals counts."""
    out = np.full(len(start), -1, np.int64)
    # open candidates by end; a longer reach is only kept with a longer size
    ends: list[int] = []
    places: list[int] = []
    for i, (s, e) in enumerate(zip(start.tolist(), end.tolist())):
        at = bisect_left(ends, e)
        if at < len(ends):
            out[i] = places[at]
            p = places[at]
            if end[p] - start[p] <= e - s:
                continue
        below = at
        if at < len(ends) and ends[at] == e:
            at += 1
        while below > 0 and end[places[below - 1]] - start[places[below - 1]] > e - s:
            below -= 1
        ends[below:at], places[below:at] = [e], [i]
    return out


def _ints(x) -> np.ndarray:
    return np.asarray(x if x is not None else [], np.int64)


def _lists(col: pa.Array) -> list[np.ndarray]:
    """The rows of a list column; a null has no items."""
    ends = np.cumsum(pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(col.flatten().to_numpy(zero_copy_only=False), ends[:-1]) if len(col) else []


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``PART_BYTES`` of text each, so that an Arrow batch of long texts is not unpacked at once."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("content")).fill_null(0).to_numpy(zero_copy_only=False)
        run = np.cumsum(sizes, dtype=np.int64) // PART_BYTES
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _found(batches: Iterator[pa.RecordBatch], spans: Callable) -> Iterator[tuple]:
    """Chunk rows of each file: classes, then functions. ``spans(lists, heads, lines)`` gives last lines and whether inside a class."""
    for part in _parts(batches):
        lists = {name: _lists(part.column(name)) for name in part.schema.names if name.startswith("_")}
        texts, files = part.column("content"), [part.column(c).to_pylist() for c in ("path", "project_id", "language")]
        for i in range(part.num_rows):
            lines = (texts[i].as_py() or "").split("\n")
            own = {name: rows[i] for name, rows in lists.items()}
            for heads, names, types, first in (("_classes", "_class_names", ["class_definition"] * 2, 0),
                                               ("_functions", "_function_names", ["function_definition", "method_definition"], FUNCTION_PASS)):
                start = _ints(own[heads])
                end, inside = spans(own, start, len(lines))
                for at, last, name, method in zip(start.tolist(), end.tolist(), own[names].tolist(), inside.tolist()):
                    yield (*(f[i] for f in files), at, last, types[method], name, "\n".join(lines[at - 1:last]), at + first)


def _written(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``PART_BYTES`` of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[7]) + 100
        if size >= PART_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), CHUNK_ARROW.types)], schema=CHUNK_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), CHUNK_ARROW.types)], schema=CHUNK_ARROW)


def block_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of files whose blocks end by indent (columns of ``outline.outline_python``)."""
    return _written(_found(batches, lambda own, head, last: block_spans(
        _ints(own["_no"]), _ints(own["_indent"]), np.asarray(own["_is_class"], bool), head, last)))


def brace_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of files whose blocks end by braces (columns of ``outline.outline_braces``)."""
    return _written(_found(batches, lambda own, head, last: (
        brace_ends(_ints(own["_brace_no"]), _ints(own["_step"]), head, last), np.zeros(len(head), int))))


@F.pandas_udf(_INTS)
def smallest_around_of(start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([smallest_around(_ints(a), _ints(b)).astype(np.int32) for a, b in zip(start, end)], dtype=object)
