"""Word shingles of texts as sorted sets of 64-bit hashes, computed over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of a string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, ASCII letters in lower case, and how many words each row has."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    letter = ~_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[row_starts] = letter[row_starts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    index = np.flatnonzero(letter)
    counts = np.add.reduceat(letter, starts, dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    place = np.arange(len(index)) - np.repeat(first, counts)
    powers = np.full(int(counts.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = (_LOWER[data[index]].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = np.add.reduceat(values, first) + counts.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    per_row = np.diff(np.searchsorted(starts, offsets))
    return mix(hashes), per_row


def shingles_of(words: np.ndarray, per_row: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's shingles of k words, with repetition; a row of fewer words has one of all its words, a row without words none."""
    out: list[np.ndarray] = []
    ends = np.cumsum(per_row)
    shingles = np.zeros(0, np.uint64)
    if len(words) >= k:
        total = words[: len(words) - k + 1] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(1, k):
            total = mix(total) + words[j : len(words) - k + 1 + j] * np.uint64(0x9E3779B97F4A7C15)
        shingles = mix(total)
    for end, count in zip(ends.tolist(), per_row.tolist()):
        if count >= k:
            out.append(shingles[end - count : end - k + 1])
        elif count:
            total = np.array([count], dtype=np.uint64)
            for word in words[end - count : end]:
                total = mix(total) + word * np.uint64(0xC2B2AE3D27D4EB4F)
            out.append(mix(total))
        else:
            out.append(shingles[:0])
    return out


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for row, data, offsets in text_chunks(texts):
        with np.errstate(over="ignore"):
            found = shingles_of(*word_hashes(data, offsets), k)
        for j, shingles in enumerate(found):
            yield row + j, np.unique(shingles)
