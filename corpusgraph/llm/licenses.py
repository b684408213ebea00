"""License scans through a positional index of rare licence words.

The index maps the rarest words of each template (by document frequency over the whole corpus) to (template, position). A
file's occurrences of such words vote for the template at a relative position (place in the file minus place in the
template). Each alignment voted for is verified: a mandatory key phrase of the template must stand there word for word. Every
phrase has its rarest word in the index, so no place of a phrase is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.blocks import hash_words, signed, text_blocks, words

# Fixed values: (label, template words, mandatory key phrases). The first three are the base phrases.
TEMPLATES = [
    ("cc-by", "cc by", ["cc by"]),
    ("gpl", "general public license", ["general public license"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "this program is licensed under the gnu affero general public license", ["affero general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ["permission to use copy modify and or distribute"]),
]
BASE = 3
#: Words of each template that the index holds besides the rarest word of each phrase.
INDEXED = 3


@dataclass
class Index:
    idf: dict[int, float]
    words: np.ndarray  # sorted hashes of indexed words
    postings: list[list[tuple[int, int]]]  # per indexed word: (template, position)
    templates: list[np.ndarray]
    phrases: list[list[tuple[int, np.ndarray]]]  # per template: (position of the phrase, its words)


def _vocabulary() -> np.ndarray:
    return np.unique(np.concatenate([hash_words(text) for _, text, _ in TEMPLATES]))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary()
    counts, documents = np.zeros(len(vocabulary), np.int64), 0
    for batch in batches:
        documents += batch.num_rows
        for _, data, offsets in text_blocks(batch):
            word, _, _, first = words(data, offsets)
            at = np.searchsorted(vocabulary, word)
            at[at == len(vocabulary)] = 0
            hit = np.flatnonzero(vocabulary[at] == word)
            row = np.searchsorted(first, hit, "right") - 1
            counts += np.bincount(np.unique(row * len(vocabulary) + at[hit]) % len(vocabulary), minlength=len(vocabulary))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[signed(vocabulary), 0]), pa.array(np.r_[counts, documents]),
                                      pa.array(np.r_[np.zeros(len(vocabulary), bool), True])],
                                     names=["word", "n", "total"])


def build_index(docs: DataFrame) -> Index:
    """Index of ``TEMPLATES`` with document frequencies over all of ``docs``; the driver sees one row per template word."""
    rows = (docs.select("text").mapInArrow(_document_counts, "word long, n long, total boolean")
            .groupBy("word", "total").agg(F.sum("n").alias("n")).collect())
    total = max(1, sum(r["n"] for r in rows if r["total"]))
    frequency = {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in rows if not r["total"]}
    idf = {int(w): float(np.log((total + 1) / (frequency.get(int(w), 0) + 1))) for w in _vocabulary()}
    templates = [hash_words(text) for _, text, _ in TEMPLATES]
    phrases, chosen = [], []
    for own, (_, text, keys) in zip(templates, TEMPLATES):
        listed = text.split(" ")
        found = []
        for key in keys:
            parts = key.split(" ")
            at = next(i for i in range(len(listed)) if listed[i:i + len(parts)] == parts)
            found.append((at, own[at:at + len(parts)]))
        phrases.append(found)
        rarest = sorted(range(len(own)), key=lambda i: (-idf[int(own[i])], i))[:INDEXED]
        rarest += [min(range(at, at + len(key)), key=lambda i: (-idf[int(own[i])], i)) for at, key in found]
        chosen.append(sorted(set(rarest)))
    indexed = np.unique(np.concatenate([own[c] for own, c in zip(templates, chosen)]))
    postings: list[list[tuple[int, int]]] = [[] for _ in indexed]
    for t, (own, c) in enumerate(zip(templates, chosen)):
        for i in c:
            postings[int(np.searchsorted(indexed, own[i]))].append((t, i))
    return Index(idf, indexed, postings, templates, phrases)


def _stands(word: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the words ``key`` stand at ``at``, within [low, high)."""
    ok = (at >= low) & (at + len(key) <= high)
    for j, k in enumerate(key):
        ok &= word[np.clip(at + j, 0, len(word) - 1)] == k
    return ok


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        labels = np.array([t[0] for t in TEMPLATES], object)
        for batch in batches:
            out: list[tuple] = []
            for _, data, offsets in text_blocks(batch):
                word, _, _, first = words(data, offsets)
                n = len(offsets) - 1
                places: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                found: list[dict[int, float]] = [{} for _ in range(n)]
                at = np.searchsorted(index.words, word)
                at[at == len(index.words)] = 0
                hit = np.flatnonzero(index.words[at] == word) if len(word) else np.zeros(0, np.int64)
                votes: list[list[np.ndarray]] = [[] for _ in TEMPLATES]
                for k in np.unique(at[hit]):
                    where = hit[at[hit] == k]
                    row = np.searchsorted(first, where, "right") - 1
                    for t, position in index.postings[k]:
                        votes[t].append(np.stack([where - position, row]))
                for t, parts in enumerate(votes):
                    if not parts:
                        continue
                    aligned = np.unique(np.concatenate(parts, axis=1), axis=1)
                    start, row = aligned
                    low, high, own = first[row], first[row + 1], index.templates[t]
                    good = np.zeros(len(start), bool)
                    for position, key in index.phrases[t]:
                        stands = _stands(word, start + position, low, high, key)
                        good |= stands
                        if t < BASE:
                            for r, place in zip(row[stands], (start + position - low)[stands]):
                                places[r].append((int(place), t))
                    start, row, low, high = start[good], row[good], low[good], high[good]
                    if not len(start):
                        continue
                    weight = np.array([index.idf[int(w)] + 1e-9 for w in own])
                    score = np.zeros(len(start))
                    for j, w in enumerate(own):
                        score += weight[j] * _stands(word, start + j, low, high, own[j:j + 1])
                    for r, s in zip(row.tolist(), (score / weight.sum()).tolist()):
                        found[r][t] = max(found[r].get(t, 0.0), s)
                for r in range(n):
                    base = sorted(set(places[r]))
                    out.append((int(first[r + 1] - first[r]), len(base), base[0][0] if base else None,
                                base[-1][0] if base else None, ",".join(sorted({labels[t] for _, t in base})),
                                ",".join(sorted(labels[t] for t in found[r])),
                                min(1.0, max(found[r].values(), default=0.0))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    n_base counts all places of the base phrases, first_word and last_word are the smallest and largest of them (null if
    none); labels are those of all templates with a verified phrase (empty string if none); score is the largest
    IDF-weighted share of a template's words that stand in line with its phrase. Null and empty texts have no words.
    Repeated rows each get a row; further columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_index(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scan(shared), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                       "labels string, score double")
