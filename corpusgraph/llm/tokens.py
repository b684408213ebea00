"""Token counts of whole texts as a given tokenizer library gives them.

Texts up to ``chunk_chars`` are encoded as one piece. Longer ones are cut into overlapping chunks that are encoded on their
own, by different tasks, with offsets. Inside an overlap a boundary is stable if both encodings end a token there, white
space follows, and both have the same tokens since the boundary before it: token and word rules of the supported
vocabularies never reach over that white space, so the tokens beyond the boundary are those of the whole text. Counts are
spliced at the first such boundary of each overlap. Texts with an overlap that has none are cut again with chunks and
overlaps four times as large, until every overlap aligns or the text fits into one chunk.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.session import materialize, spread

CHUNK_CHARS, OVERLAP = 32768, 512
_MEMO_WORDS = 500_000
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """One vocabulary: ``.json`` files are read by tokenizers, ``.model`` files by sentencepiece; nothing is added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        self.piece = self.bpe = None
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            inner = any("▁" in self.piece.id_to_piece(i).lstrip("▁") for i in range(self.piece.get_piece_size()))
            if inner:
                raise ValueError("a piece of this vocabulary reaches over white space")
        else:
            from tokenizers import Tokenizer

            self.bpe = Tokenizer.from_file(path)
            # vocabularies with word ends drop white space, so that words between blanks do not affect each other
            with open(path, encoding="utf-8") as f:
                self.by_word = bool(json.load(f)["model"].get("end_of_word_suffix"))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; words between blanks are encoded once each while the memo holds them."""
        if self.piece:
            return [len(x) for x in self.piece.encode(texts, num_threads=1)]
        if not self.by_word:
            return [len(x.ids) for x in self.bpe.encode_batch(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list({w for words in split for w in words if w not in self.memo})
        if len(self.memo) + len(new) > _MEMO_WORDS:
            self.memo.clear()
            new = list({w for words in split for w in words})
        for i in range(0, len(new), 4096):
            part = new[i:i + 4096]
            for word, code in zip(part, self.bpe.encode_batch_fast(part, add_special_tokens=False)):
                self.memo[word] = len(code.ids)
        return [sum(map(self.memo.__getitem__, words)) for words in split]

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """Token ids and the character offset behind each token."""
        if self.piece:
            found = self.piece.encode(text, return_type="proto").pieces
            # its offsets are bytes
            chars = np.r_[0, np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80)]
            return [p.id for p in found], chars[[p.end for p in found]].tolist()
        code = self.bpe.encode(text, add_special_tokens=False)
        return code.ids, [end for _, end in code.offsets]


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            counts: list[int] = []
            for at in range(0, batch.num_rows, 128):
                counts += _encoder(path).counts(texts.slice(at, 128).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def chunks(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks of a text."""
    out, start = [], 0
    while start + chunk < length:
        out.append((start, start + chunk))
        start += chunk - overlap
    return [*out, (start, length)]


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                cuts = chunks(len(text), chunk, overlap)
                for i in range(0, len(cuts), 64):
                    part = cuts[i:i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[row].as_py()] * len(part), pa.int64()),
                         pa.array(range(i, i + len(part)), pa.int64()), pa.array([len(cuts)] * len(part), pa.int64()),
                         pa.array([a for a, _ in part], pa.int64()), pa.array([text[a:b] for a, b in part], pa.string())],
                        names=["row", "chunk", "chunks", "start", "text"])

    return run


def boundaries(text: str, ids: list[int], ends: list[int]) -> list[tuple[int, int, int]]:
    """(offset, tokens up to it, hash of the tokens since the boundary before) for token ends that white space follows."""
    out, last, behind = [], 0, 0
    for i, end in enumerate(ends):
        if (i + 1 == len(ends) or ends[i + 1] > end) and end < len(text) and text[end] in " \n":
            if out:  # what stands before the first boundary may be cut
                out.append((end, i + 1, hash((end - behind, *ids[last:i + 1]))))
            else:
                out.append((end, i + 1, -1))
            last, behind = i + 1, end
    return out[1:]


def _encode_chunks(path: str, overlap: int):
    """seam i lies between chunk i and chunk i + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk, chunks_, start, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids, ends = _encoder(path).spans(text)
                rows = [(-1, 0, 0, len(ids), 0)]
                for end, upto, code in boundaries(text, ids, ends):
                    if chunk and end <= overlap:
                        rows.append((chunk - 1, start + end, code, 0, upto))
                    if chunk < chunks_ - 1 and end >= len(text) - overlap:
                        rows.append((chunk, start + end, code, len(ids) - upto, -1))
                seam, at, code, n, before = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(rows), pa.int64()), pa.array([chunks_] * len(rows), pa.int64()),
                     *(pa.array(x, pa.int64()) for x in (seam, at, code, n, before))],
                    names=["row", "chunks", "seam", "at", "code", "n", "before"])

    return run


def _spliced(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of the texts whose overlaps all align."""
    cut = long.select("row", "text").mapInArrow(_cut(chunk, overlap),
                                                "row long, chunk long, chunks long, start long, text string")
    ends = materialize(spread(cut, "row", "chunk").mapInArrow(
        _encode_chunks(path, overlap),
        "row long, chunks long, seam long, at long, code long, n long, before long"), "chunks")
    total = ends.filter("seam < 0").groupBy("row").agg(F.sum("n").alias("n"), F.max("chunks").alias("chunks"))
    common = (ends.filter("seam >= 0").groupBy("row", "seam", "at", "code")
              .agg(F.max("before").alias("before"), F.max(F.when(F.col("before") < 0, F.col("n"))).alias("after"))
              .filter("before >= 0 and after is not null"))
    splice = (common.groupBy("row", "seam").agg(F.min_by(F.col("before") + F.col("after"), "at").alias("twice"))
              .groupBy("row").agg(F.sum("twice").alias("twice"), F.count(F.lit(1)).alias("seams")))
    return (total.join(splice, "row", "left").fillna(0, ["twice", "seams"]).filter("seams = chunks - 1")
            .select("row", (F.col("n") - F.col("twice")).alias("n_tokens")))


def count_tokens(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of ``docs`` (doc_id, text), encoded by the vocabulary file ``path``.

    No begin, end or added tokens, no truncation; special strings inside texts count as the library's default has it. A
    null or empty text has no bytes and no tokens. Repeated rows are counted each; a null doc_id stays; further columns are
    ignored; no rows give no rows. ``path`` must exist on every worker.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = rows.filter(~is_long).mapInArrow(_count(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    long = materialize(rows.filter(is_long).withColumn("row", F.monotonically_increasing_id()), "long")
    counted, todo = None, long
    while not todo.isEmpty():
        done = materialize(_spliced(todo, path, chunk_chars, overlap), "spliced")
        counted = done if counted is None else counted.unionByName(done)
        todo = materialize(todo.join(done, "row", "left_anti"), "wider")
        chunk_chars, overlap = 4 * chunk_chars, 4 * overlap
    if counted is None:
        return short
    return short.unionByName(long.drop("text").join(counted, "row").select("doc_id", "n_bytes", "n_tokens"))
