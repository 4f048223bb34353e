"""Vectorised word hashing for Arrow text columns.

Words are maximal runs of bytes that are not space or ``\\x09-\\x0D``; ASCII letters are lower-cased on
request. All hashes are 64 bits and the same on every machine and at every batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from jobloom.llm.memory import give_back

#: Texts are hashed in slices of about this many bytes, which bounds a task's memory; one text is never cut.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Separators may also be all ASCII characters but letters and digits.
_IS_ALNUM = np.array([byte >= 0x80 or chr(byte).isalnum() for byte in range(256)])
#: As before, with signs of percent and currency; digits and other characters are then words of their own.
_IS_QUANTITY = _IS_ALNUM.copy()
_IS_QUANTITY[[ord("%"), ord("$")]] = True
_IS_DIGIT = np.array([0x30 <= byte <= 0x39 for byte in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.arange(256, dtype=np.uint8)


def powers_of_step(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers_of_step(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: ``doc[i]:doc[i + 1]`` are the words of text i."""

    data: np.ndarray  #: bytes of the slice, lower-cased if asked for
    raw: np.ndarray  #: bytes of the slice as they are
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    hash: np.ndarray  #: hash of each word
    doc: np.ndarray  #: word offsets of the texts
    text: np.ndarray  #: byte offsets of the texts


def _hash_slice(raw: np.ndarray, text: np.ndarray, lower: bool, is_word: np.ndarray, digits: bool) -> Words:
    global _POWERS
    data = (_LOWER if lower else _KEEP)[raw]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    begins = inside[1:-1] & ~inside[:-2]
    first = text[:-1][text[:-1] < text[1:]]
    begins[first] |= inside[1:-1][first]  # a text begins a new word whatever stands before it
    ends = inside[1:-1] & ~inside[2:]
    if digits:
        turns = np.flatnonzero(_IS_DIGIT[data[1:]] != _IS_DIGIT[data[:-1]])
        turns = turns[inside[1:-1][turns] & inside[2:][turns]]
        begins[turns + 1], ends[turns] = True, True
    start = np.flatnonzero(begins)
    last = text[1:][text[:-1] < text[1:]] - 1
    ends[last] |= inside[1:-1][last]
    end = np.flatnonzero(ends) + 1
    if len(start):
        size = end - start
        if (longest := int(size.max())) > len(_POWERS):
            _POWERS = powers_of_step(longest + 1024)
        at = np.flatnonzero(inside[1:-1])
        head = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(len(at)) - np.repeat(head, size)
        hashed = mix(np.add.reduceat(_BYTE[data[at]] * _POWERS[place], head) + size.astype(np.uint64))
    else:
        hashed = np.zeros(0, dtype=np.uint64)
    return Words(data, raw, start, end, hashed, np.searchsorted(start, text), text)


def words(column: pa.Array, lower: bool = True, alnum: bool = False, digits: bool = False) -> Iterator[tuple[int, Words]]:
    """Yield (index of the first text, Words) for slices of a string column; null counts as empty.

    With ``digits`` words end where digits begin or end, and signs of percent and currency are words.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, values = column.buffers()
    is_word = _IS_QUANTITY if digits else _IS_ALNUM if alnum else _IS_WORD
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        yield i, _hash_slice(data[off[i] : off[j]], off[i : j + 1] - off[i], lower, is_word, digits)
        i = j
    give_back()


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams of each text and their offsets; a shorter non-empty text is one shingle."""
    n_words = np.diff(w.doc)
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(n_words.dtype))
    offsets = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(w.doc[:-1], count) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
    total = np.zeros(len(first), dtype=np.uint64)
    length = np.repeat(np.minimum(n_words, size), count)
    for k in range(size):
        ok = length > k
        if ok.all():
            total += w.hash[first + k] * _SHINGLE[k]
        else:
            total[ok] += w.hash[first[ok] + k] * _SHINGLE[k]
    return mix(total + length.astype(np.uint64)), offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run, and the new offsets."""
    runs = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    return (np.concatenate(runs) if runs else values[:0]), np.concatenate(([0], np.cumsum(sizes)))
