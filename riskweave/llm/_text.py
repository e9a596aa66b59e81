"""Vectorised helpers on Arrow batches of text: tokens, hashes, chunks. They run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, and bytes of words hashed at once. A longer text stands alone; beside its words' arrays (about 60 bytes a word) it takes
#: a few bytes for each of its own, not the 40 of a piece.
CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 20


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets of the texts; null counts as empty. Without a copy where nulls hold no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = array.buffers()
        at = np.frombuffer(offsets, kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
        body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        return body, at - at[0]

    body, at = parts(column)
    if column.null_count and np.diff(at)[column.is_null().to_numpy(zero_copy_only=False)].any():
        body, at = parts(column.fill_null(""))
    return body, at


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, most_rows: int = 1 << 14) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of at most ``most_rows`` rows with about ``most`` bytes; one larger row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n, i + most_rows)
        yield i, j
        i = j


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))


class WordTable:
    """Which bytes belong to words, their value (of a-z for A-Z, unless ``fold`` is False), and the random tables of the word hash."""

    BLOCK = 4096

    def __init__(self, separators: bytes, fold: bool = True):
        folded = np.arange(256, dtype=np.uint8)
        folded[65:91] += 32 * fold
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        random = np.random.default_rng(20240229)
        table = random.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.value = table[folded]
        powers = random.integers(0, 1 << 64, self.BLOCK, dtype=np.uint64) | np.uint64(1)
        self.power = powers

    def words(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row, start byte and end byte of each word of the texts, in order."""
        inside = self.is_word[body]
        if not inside.any():
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none, none
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(body))]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        rows = np.searchsorted(offsets, starts, "right") - 1
        return self._hashes(body, starts, ends), rows, starts, ends

    def _hashes(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words, which are sums over their bytes: taken a piece of about PIECE_BYTES at a time, within long words too."""
        length = ends - starts
        upto = np.cumsum(length)
        out = np.zeros(len(starts), np.uint64)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] - length[i] + PIECE_BYTES, "right")))
                if j == i + 1 and length[i] > self.BLOCK:
                    for a in range(starts[i], ends[i], PIECE_BYTES):
                        b = min(ends[i], a + PIECE_BYTES)
                        out[i] += (self.value[body[a:b]] * self._factor(np.arange(a, b) - starts[i])).sum(dtype=np.uint64)
                else:
                    size = length[i:j]
                    first = np.cumsum(size) - size
                    place = np.arange(int(size.sum())) - np.repeat(first, size)
                    out[i:j] = np.add.reduceat(self.value[body[place + np.repeat(starts[i:j], size)]] * self._factor(place), first)
                i = j
            return _mixed(out + length.astype(np.uint64))

    def _factor(self, place: np.ndarray) -> np.ndarray:
        """An odd factor for each place in a word: random ones within a block, times a hash of the block's number."""
        factor = self.power[place & (self.BLOCK - 1)]
        far = place >= self.BLOCK
        if far.any():
            factor[far] *= mix(place[far] // self.BLOCK, 7) | np.uint64(1)
        return factor


#: White space as in [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
#: Everything in ASCII that is neither a letter nor a digit.
NON_WORDS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

