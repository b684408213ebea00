"""Word shingles of whole texts as sorted (hash, count) runs."""

from __future__ import annotations

import numpy as np

from corpusgraph.llm.blocks import U64, mix, words

WORDS = 5
_FACTORS = mix(np.arange(101, 101 + WORDS, dtype=U64)) | U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct five-word shingles of each text of a block: (row, hash, count), sorted by row and hash.

    Words are lower-cased (A-Z); a text of one to four words has one shingle made of all its words, one without words has
    none.
    """
    word, _, _, first = words(data, offsets)
    size = first[1:] - first[:-1]
    count = np.where(size >= WORDS, size - WORDS + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    at = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    end, padded = first[1:][row], np.r_[word, np.zeros(WORDS, U64)]
    value = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(_FACTORS):
            here = padded[at + j] * factor
            value += here if j == 0 else np.where(at + j < end, here, U64(0))
    value = mix(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])][:len(row)])
    return row[fresh], value[fresh], np.diff(np.r_[fresh, len(row)])
