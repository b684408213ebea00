"""Byte-level helpers shared by the operators: Arrow text columns as NumPy blocks, words and their 64-bit hashes.

All of them look at one block of whole texts at a time (``BLOCK_BYTES`` of text, or one longer text), so that the
temporaries of a task stay near forty times that size whatever the Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_VALUES = _byte_values()
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the hash base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 4096)
        with np.errstate(over="ignore"):
            for base, name in ((_BASE, "_powers"), (_BASE_INVERSE, "_inverses")):
                steps = np.full(size, base, U64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)
    return _powers[:n], _inverses[:n]


class RollingHash:
    """Hash of any byte range of one block: equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[data] * power[:-1], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of all ranges of ``length`` bytes."""
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def text_blocks(batch: pa.RecordBatch, column: str = "text",
                limit: int | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of blocks of whole texts; a null text counts as empty."""
    limit = limit or BLOCK_BYTES
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    if col.null_count:
        col = pa.concat_arrays([col.fill_null("")])
    if not len(col):
        return
    _, offset_buffer, data_buffer = col.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(col))
        yield slice(row, end), data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: After A-Z became a-z: 0-9, a-z and every byte of a character beyond ASCII belong to a word.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Everything except blank, \t, \n, \v, \f and \r belongs to a token.
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[9, 10, 11, 12, 13, 32]] = False


def words(data: np.ndarray, offsets: np.ndarray, belongs: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, ...]:
    """Words of a block of lower-cased texts: (hash, start byte, end byte, index of the first word of each text + total)."""
    lowered = LOWER[data]
    inside = belongs[lowered]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[begins] = False
    after[begins[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return RollingHash(lowered)(starts, ends), starts, ends, np.searchsorted(starts, offsets)


def hash_words(text: str, belongs: np.ndarray = WORD_BYTES) -> np.ndarray:
    """Word hashes of one short string."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return words(data, np.array([0, len(data)]), belongs)[0]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
