"""Words and word shingles of a batch of texts as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words are found
on the UTF-8 bytes of the whole batch at once; no text becomes a Python string.
Words and shingles are 64-bit fingerprints with a fixed seed: the same in every
process and for every batching.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts handled at once; a longer text is a chunk of its own

_U = np.uint64
_WORD_BASE = _U(0x9E3779B97F4A7C15)
_SHINGLE_BASE = _U(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> _U(30)
    v *= _U(0xBF58476D1CE4E5B9)
    v ^= v >> _U(27)
    v *= _U(0x94D049BB133111EB)
    v ^= v >> _U(31)
    return v


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# everything but ASCII letters and digits and what is not ASCII
PUNCTUATION = np.array([i < 0x80 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array; text ``i`` is ``bytes[offsets[i]:offsets[i + 1]]``; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if offsets[-1] == offsets[0] or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text each, and one text at least."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), start + 4096, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of some texts: byte positions, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = SPACE):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~between[self.data]
        size = len(inside)
        before = np.zeros(size + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(size + 1, bool)
        after[:-1] = inside
        self.starts = np.flatnonzero(inside & ~before[:-1])
        after[offsets] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.inside = inside
        self.first = np.searchsorted(self.starts, offsets)  # of each text's words; one entry more than texts
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One fingerprint per word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        heads = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _WORD_BASE, np.uint64))
        values = _BYTE_VALUES[self.data[self.inside]] * powers[place]
        return mix(np.add.reduceat(values, heads))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all ``size``-word windows, and how many each text has (none if it has fewer words)."""
    held = np.maximum(counts - size + 1, 0)
    total = len(hashes) - size + 1
    if total <= 0 or not held.any():
        return np.zeros(0, np.uint64), held
    joined = np.zeros(total, np.uint64)
    for k in range(size):
        joined = joined * _SHINGLE_BASE + hashes[k : k + total]
    first = np.cumsum(counts) - counts
    keep = np.arange(int(held.sum())) + np.repeat(first - (np.cumsum(held) - held), held)
    return mix(joined[keep]), held


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct ``size``-word shingles of each text; fewer words make one shingle, no words none."""
    values, held = windows(hashes, counts, size)
    stops = np.cumsum(held)
    firsts = np.cumsum(counts) - counts
    out = []
    for i, n in enumerate(held.tolist()):
        if n:
            own = np.sort(values[stops[i] - n : stops[i]])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif counts[i]:
            whole = np.array([counts[i]], np.uint64)
            for k in range(firsts[i], firsts[i] + counts[i]):
                whole = whole * _SHINGLE_BASE + hashes[k : k + 1]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
