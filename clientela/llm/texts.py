"""Words and word-shingle hashes of whole Arrow columns of texts, in numpy.

Words are runs of bytes outside ``20 09-0D`` (hex), with A-Z lower-cased. A word's hash is a
polynomial in its bytes modulo 2^64, mixed; a shingle's hash mixes those of its words. Sets are
compared by these 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken by so many bytes at a time; a worker's arrays have eight bytes and more for each.
SLICE_BYTES = 1 << 18
SHINGLE = 5

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
#: The value of each byte, none of a word's being 0 and all separators' 0: one look-up finds both.
_VALUES = {lower: np.where(_SEPARATOR, np.uint64(0), _LETTER_VALUE[_LOWER] if lower else _LETTER_VALUE) for lower in (True, False)}
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PAD = np.uint64(0x5851F42D4C957F2D)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        steps = np.full(max(length, SLICE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
        if len(table) > 4 * SLICE_BYTES:  # one huge text: not kept
            del _powers[base]
    return table[:length]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column without nulls (null: empty), in one chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_string()).fill_null("")


def flat(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text starts (one more entry: the end)."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of a run of texts: hash of each, and where each text's words start (one more: the end)."""

    hashes: np.ndarray
    starts: np.ndarray


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    if not len(data):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    value = _VALUES[lower].take(data.astype(np.intp))
    word = value != 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = word[edge]
    start = np.flatnonzero(begins)
    starts = np.searchsorted(start, offsets).astype(np.int64)
    if not len(start):
        return Words(np.zeros(0, np.uint64), starts)
    value *= _power_table(_BASE, len(data))
    sums = np.add.reduceat(value, start)
    return Words(mix(sums * _power_table(_INVERSE, len(data))[start]), starts)


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` words; a shorter text is one shingle as a whole."""
    counts = np.diff(words.starts)
    n_words = len(words.hashes)
    if not n_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    left = words.starts[1:][text] - np.arange(n_words)  # words from here to the text's end
    begins = np.flatnonzero((left >= size) | ((counts[text] < size) & (left == counts[text])))
    padded = np.concatenate([words.hashes, np.full(size, _PAD)])
    total = np.zeros(len(begins), np.uint64)
    for k in range(size):
        part = padded[begins + k]
        part[left[begins] <= k] = _PAD
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + part)
    return text[begins], total


def distinct_by_text(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    keep = np.ones(len(text), dtype=bool)
    keep[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[keep], hashes[keep]


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, text number within the run, shingle hash): distinct, ascending by text and hash."""
    data, offsets = flat(column)
    for first, last in slices(offsets):
        at = offsets[first : last + 1]
        words = word_hashes(data[at[0] : at[-1]], at - at[0])
        yield first, last, *distinct_by_text(*shingle_hashes(words))
