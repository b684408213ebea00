"""Removal of repeated passages through deep-shallow sorting of sampled suffixes.

Every string of ``length`` bytes has one anchor: its leftmost smallest ``SEED``-byte fingerprint. Equal strings have equal
anchors, so strings meet by their anchor instead of each travelling alone, and neighbouring strings of one text that
share an anchor form one segment (about one per 33 bytes of text):

1. Segments are dealt by anchor and ordered there. A segment whose bytes were seen at an earlier place repeats as a whole;
   an anchor that stands in one kind of segment only needs nothing more.
2. Segments with equal anchors and different bytes (the ends of repeated passages) are fetched and dealt again, and the
   suffixes that start in them are put in order by deep-shallow sorting: multikey quicksort on eight-byte symbols to
   ``SHALLOW`` bytes, then one blind trie for each group that still agrees. Suffixes that agree on ``length`` bytes are
   equal strings; all but the earliest repeat.
3. The byte ranges found meet their text and are cut out.

Anchors of very many segments (a passage quoted in a third of all texts) are split into single strings, dealt by their own
fingerprint and thinned before the shuffle, so that no key gathers more than its neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import RollingHash, mix, signed, text_blocks
from corpusgraph.llm.tables import pack, unpack
from corpusgraph.session import materialize

SEED = 32
SHALLOW = 32
#: An anchor with more different segments than this is split into single strings.
SPLIT_ABOVE = 1000
_NULL_ID = -(1 << 63)
#: Bytes of pieces sorted at once; their strings take about seventy times as much.
_FLUSH_BYTES = 1 << 21


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int):
    """Segments of a block: (anchor hash, segment hash, first string start, last string start)."""
    sizes = offsets[1:] - offsets[:-1]
    if not (sizes >= length).any():
        return None
    rolling, width = RollingHash(data), length - seed + 1
    best = rolling.fixed(seed)
    at = np.zeros(len(best), np.int32)
    step = 1

    def halve(best, at, shift):
        lower = best[shift:] < best[:-shift]
        return np.where(lower, best[shift:], best[:-shift]), np.where(lower, at[shift:] + np.int32(shift), at[:-shift])

    seeds = best
    while 2 * step <= width:
        best, at = halve(best, at, step)
        step *= 2
    if step < width:
        best, at = halve(best, at, width - step)
    whole = sizes >= length
    marks = np.zeros(len(data) + 1, np.int8)
    np.add.at(marks, offsets[:-1][whole], 1)
    np.add.at(marks, offsets[1:][whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks, dtype=np.int8) > 0)
    anchor = starts + at[starts]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    begin, last = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]]
    return seeds[anchor[first]], rolling(begin, last + length), begin, last


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("doc_id")).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def _join_ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of ranges that touch or overlap in the same document."""
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    out = []
    if len(doc):
        new_doc = np.r_[True, doc[1:] != doc[:-1]]
        group = np.cumsum(new_doc) - 1
        span = int(end.max()) + 1
        reach = np.maximum.accumulate(end + group * span) - group * span
        fresh = np.flatnonzero(new_doc | np.r_[True, start[1:] > reach[:-1]])
        out = [doc[fresh], start[fresh], reach[np.r_[fresh[1:] - 1, len(doc) - 1]]]
    return out or [doc, start, end]


def _segments(length: int, seed: int):
    """Mapper of step 1. Repeats inside a batch are settled here: they travel as ranges, not as segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = _ids(batch), []
            for rows, data, offsets in text_blocks(batch):
                found = _anchors(data, offsets, length, seed)
                if found is not None:
                    anchor, body, begin, last = found
                    row = np.searchsorted(offsets, begin, "right") - 1
                    parts.append((anchor, body, ids[rows][row], begin - offsets[row], last - offsets[row] + length))
            if not parts:
                continue
            anchor, body, doc, start, end = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((start, doc, body, anchor))
            a, b, d, s = anchor[order], body[order], doc[order], start[order]
            same = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
            # a row that repeats an id and start is the same place, not an earlier one
            place = np.r_[False, (d[1:] == d[:-1]) & (s[1:] == s[:-1])]
            again, keep = order[same & ~place], order[~same]
            m_doc, m_start, m_end = _join_ranges(doc[again], start[again], end[again])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[np.zeros(len(keep), bool), np.ones(len(m_doc), bool)]),
                pa.array(signed(np.r_[anchor[keep], mix(m_doc.view(np.uint64))])),
                pa.array(signed(np.r_[body[keep], np.zeros(len(m_doc), np.uint64)])),
                pa.array(np.r_[doc[keep], m_doc]), pa.array(np.r_[start[keep], m_start].astype(np.int64)),
                pa.array(np.r_[end[keep], m_end].astype(np.int64))],
                names=["settled", "anchor", "body", "doc_id", "start", "end"])

    return run


def _pieces(length: int, split_above: int):
    """Mapper of step 2: bytes of the undecided segments, those of hot anchors as single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, docs, starts, bodies = _ids(batch), [], [], [], []
            held = batch.column(batch.schema.get_field_index("segments")).to_pylist()
            seen: dict[bytes, tuple[int, int]] = {}
            order = np.argsort(ids, kind="stable")
            texts = batch.column(batch.schema.get_field_index("text"))
            for row in order:
                text = (texts[int(row)].as_py() or "").encode("utf-8")
                for x in sorted(held[row], key=lambda x: x["start"]):
                    if x["kinds"] <= split_above:
                        keys.append(x["anchor"])
                        docs.append(ids[row])
                        starts.append(x["start"])
                        bodies.append(text[x["start"]:x["end"]])
                        continue
                    for at in range(x["start"], x["end"] - length + 1):
                        body = text[at:at + length]
                        key = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
                        docs.append(ids[row])
                        starts.append(at)
                        # a later copy inside the batch needs no bytes: it is settled
                        here = (int(ids[row]), at)
                        fresh = seen.setdefault(body, here) == here
                        keys.append(key if fresh else here[0])
                        bodies.append(body if fresh else None)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()),
                pa.array(bodies, pa.binary())], names=["key", "doc_id", "start", "body"])

    return run


class BlindTrie:
    """Binary trie that stores only branching bits; one comparison with a leaf finds where a new key differs."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, key: int) -> bool:
        """True if the key is already there."""
        node = self.root
        if node is None:
            self.root = [-1, key, None]
            return False
        while node[0] >= 0:
            node = node[1 + (key >> node[0] & 1)]
        differ = node[1] ^ key
        if not differ:
            return True
        bit = differ.bit_length() - 1
        above, node = None, self.root
        while node[0] > bit:
            above, node = node, node[1 + (key >> node[0] & 1)]
        leaf = [-1, key, None]
        inner = [bit, node, leaf] if key >> bit & 1 else [bit, leaf, node]
        if above is None:
            self.root = inner
        else:
            above[1 + (key >> above[0] & 1)] = inner
        return False

    def keys(self) -> list[int]:
        """All keys in order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.append(node[1])
            else:
                stack += [node[2], node[1]]
        return out


def repeated(strings: np.ndarray) -> np.ndarray:
    """Flags of rows (n x length bytes, earliest place first) that equal an earlier row, by deep-shallow sorting."""
    n, length = strings.shape
    again = np.zeros(n, bool)
    if n < 2:
        return again
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = strings
    symbols = padded.view(">u8").astype(np.uint64)
    perm, group = np.arange(n), np.zeros(n, np.int64)
    live = np.arange(n)
    for column in range(min(SHALLOW // 8, symbols.shape[1])):
        rows = perm[live]
        symbol = symbols[rows, column]
        order = np.lexsort((rows, symbol, group[live]))
        perm[live] = rows[order]
        symbol, owner = symbol[order], group[live]
        fresh = np.r_[True, (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])]
        number = np.cumsum(fresh) - 1
        group[live] = live[fresh][number]
        live = live[np.bincount(number)[number] > 1]
        if not len(live):
            return again
    owner = group[live]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
    deep = padded[:, min(SHALLOW, padded.shape[1]):]
    for a, b in zip(cuts[:-1], cuts[1:]):
        trie = BlindTrie()
        for row in perm[live[a:b]].tolist():
            if trie.add(int.from_bytes(deep[row].tobytes(), "big")):
                again[row] = True
    return again


def _decide(length: int):
    """Reducer of step 2: rows come ordered by key; whole keys are sorted together in blocks of bounded size."""

    def block(table: pa.Table):
        table = table.combine_chunks()
        doc, start = table["doc_id"].to_numpy(), table["start"].to_numpy()
        body = table["body"].combine_chunks().cast(pa.large_binary())
        if isinstance(body, pa.ChunkedArray):
            body = pa.concat_arrays(body.chunks)
        offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        count = np.maximum(offsets[1:] - offsets[:-1] - length + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[:-1][row] + inner
        # a string whose fingerprint stands alone in its block cannot repeat
        prints = RollingHash(data)(at, at + length)
        _, code, times = np.unique(prints, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[code] > 1)
        w_doc, w_start, at = doc[row[some]], start[row[some]] + inner[some], at[some]
        order = np.lexsort((w_start, w_doc))
        w_doc, w_start, at = w_doc[order], w_start[order], at[order]
        fresh = np.r_[True, (w_doc[1:] != w_doc[:-1]) | (w_start[1:] != w_start[:-1])][:len(at)]
        w_doc, w_start, at = w_doc[fresh], w_start[fresh], at[fresh]
        if not len(at):
            return None
        again = repeated(np.lib.stride_tricks.sliding_window_view(data, length)[at])
        return w_doc[again], w_start[again], w_start[again] + length

    def emit(found):
        doc, start, end = _join_ranges(*found)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(end)],
                                          names=["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            settled = table.filter(table["body"].is_null())
            if len(settled):
                start = settled["start"].to_numpy()
                yield emit((settled["doc_id"].to_numpy(), start, start + length))
                table = table.filter(table["body"].is_valid())
            if not len(table):
                continue
            held.append(table)
            if sum(t.nbytes for t in held) < _FLUSH_BYTES:
                continue
            table = pa.concat_tables(held).combine_chunks()
            keys = table["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                found = block(table.slice(0, cut))
                if found:
                    yield emit(found)
            held = [table.slice(cut)]
        if held:
            found = block(pa.concat_tables(held))
            if found:
                yield emit(found)

    return run


def repeated_ranges(docs: DataFrame, length: int = 100, seed: int = SEED,
                    split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(doc_id, start, end): byte ranges of ``docs`` (doc_id, text) covered by strings that start earlier."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = Window.partitionBy("settled", "anchor")
    ordered = same.orderBy("body", "doc_id", "start")
    equal_before = F.lag("body").over(ordered) == F.col("body")
    same_place = (F.lag("doc_id").over(ordered) == F.col("doc_id")) & (F.lag("start").over(ordered) == F.col("start"))
    found = materialize(
        rows.mapInArrow(_segments(length, seed),
                        "settled boolean, anchor long, body long, doc_id long, start long, end long")
        .withColumn("known", F.coalesce(equal_before, F.lit(False)))
        .withColumn("here", F.coalesce(same_place, F.lit(False)))
        .withColumn("kinds", F.sum(F.when(F.col("known"), 0).otherwise(1)).over(same))
        .withColumn("repeats", F.col("settled") | (F.col("known") & ~F.col("here")))
        .filter(F.col("repeats") | (~F.col("settled") & ~F.col("known") & (F.col("kinds") > 1)))
        .select("doc_id", "start", "end", "repeats", "anchor", "kinds"),
        "repeats")
    open_segments = found.filter(~F.col("repeats")).groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "start", "end", "kinds")).alias("segments"))
    keyed = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)))
    strings = (keyed.join(open_segments, "doc_id")
               .mapInArrow(_pieces(length, split_above), "key long, doc_id long, start long, body binary")
               .repartition("key").sortWithinPartitions("key")
               .mapInArrow(_decide(length), "doc_id long, start long, end long"))
    return found.filter("repeats").select("doc_id", "start", "end").unionByName(strings)


def _cut(whole_characters: bool):
    """(counts and digest) or (text and the other columns) of each row after its ranges are cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.schema.get_field_index
            texts, ranges = batch.column(field("text")), batch.column(field("ranges")).to_pylist()
            counts, digests, rests = [], [], []
            for row, spans in enumerate(ranges):
                text = (texts[row].as_py() or "").encode("utf-8")
                merged: list[list[int]] = []
                for start, end in sorted((x["start"], min(x["end"], len(text))) for x in spans or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    elif start < end:
                        merged.append([start, end])
                kept, last, removed, runs = [], 0, 0, 0
                for start, end in merged:
                    if whole_characters:  # a character that would be cut in two stays
                        while start < end and text[start] & 0xC0 == 0x80:
                            start += 1
                        while start < end < len(text) and text[end] & 0xC0 == 0x80:
                            end -= 1
                    if start < end:
                        kept.append(text[last:start])
                        removed, runs, last = removed + end - start, runs + 1, end
                kept.append(text[last:])
                rest = b"".join(kept)
                counts.append((len(text), removed, runs))
                if whole_characters:
                    rests.append(rest.decode("utf-8") if texts[row].is_valid else None)
                else:
                    digests.append(hashlib.sha256(rest).hexdigest())
            ids = batch.column(field("doc_id"))
            if whole_characters:
                yield pa.RecordBatch.from_arrays([ids, pa.array(rests, pa.string()), batch.column(field("rest"))],
                                                 names=["doc_id", "text", "rest"])
            else:
                numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(digests, pa.string())],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with_ranges(docs: DataFrame, length: int) -> DataFrame:
    ranges = repeated_ranges(docs, length).groupBy(F.col("doc_id").alias("key")).agg(
        F.collect_list(F.struct("start", "end")).alias("ranges"))
    return docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).join(ranges, "key", "left")


def report(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    A byte goes if a string of ``length`` bytes over it also starts at an earlier place (smaller doc_id, or earlier in
    the same text). Null and empty texts have no bytes; texts below ``length`` bytes lose nothing. A null doc_id sorts
    first. Rows that repeat a doc_id count as the same document and share their ranges. No rows give no rows; further
    columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_ranges(docs, length).mapInArrow(
        _cut(False), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with all its columns, repeated passages cut out of ``text`` (whole characters only; null stays null)."""
    packed = pack(docs)
    return unpack(_with_ranges(packed, length).mapInArrow(_cut(True), packed.schema), docs.columns)
