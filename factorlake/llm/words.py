"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a maximal run of bytes other than space and 0x09-0x0D, so UTF-8 characters never break. A batch is
cut into pieces of whole texts of about ``PIECE_BYTES``; memory follows the piece, or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LONG_SPAN = 512

_random = np.random.Generator(np.random.PCG64(20240229))
_SEED, _LENGTH, _BLOCK = (_random.integers(1, 2**63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_STEP = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_NONE = np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (a bijection of 64-bit values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each text starts (one more entry at the end). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``max_bytes`` of text each (a longer text is a slice of its own)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span.

    A span is read eight bytes at a time; each block is folded into the state and the state mixed by a bijection, starting
    from the length. So spans of one length differ from their first different block on, unless a later block happens
    to undo it, and no arithmetic structure of the bytes (as of polynomials modulo a power of two) can bring that about.
    Spans above ``LONG_SPAN`` bytes are few and hashed one by one.
    """
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    out = mix(np.uint64(_SEED) ^ (size.astype(np.uint64) * np.uint64(_LENGTH)))
    long = np.flatnonzero(size > LONG_SPAN)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), _SEED >> 1)
    rows = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = start[rows], size[rows]
    while len(rows):
        out[rows] = mix((out[rows] ^ (blocks[at] & _MASK[np.minimum(left, 8)])) * np.uint64(_BLOCK))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    text_at: np.ndarray  # start of each text in data, with the end of the last
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    text: np.ndarray  # index of its text
    first: np.ndarray  # of each text: index of its first word, with the total at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, self.start, self.end)


def words_of(texts: pa.Array) -> Words:
    data, text_at = flat(texts)
    n = len(text_at) - 1
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[text_at] = True
    here, before = inside[1:], inside[:-1]
    start = np.flatnonzero(here[:-1] & (~before[:-1] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(before[1:] & (~here[1:] | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    first = np.searchsorted(start, text_at)
    return Words(data, text_at, start, end, np.repeat(np.arange(n), np.diff(first)), first)


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside one text, and the index of its first word."""
    total = len(words)
    if total < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total - size + 1, np.uint64)
    for k in range(size):
        h += words[k : total - size + 1 + k] * _STEP[k]
    last = np.repeat(first[1:], np.diff(first))  # end of each word's text
    at = np.flatnonzero(np.arange(total - size + 1) + size <= last[: total - size + 1])
    return mix(h[at]), at


def shingle_sets(words: Words, hashes: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and where each text's set starts.

    A text with fewer than ``size`` words has its whole sequence as its one shingle; one without words has none.
    """
    counts = words.counts
    h, at = window_hashes(hashes, words.first, size)
    runs = np.searchsorted(at, words.first)
    sets: list[np.ndarray] = []
    for i, n in enumerate(counts):
        if n >= size:
            sets.append(np.unique(h[runs[i] : runs[i + 1]]))
        elif n:
            own = hashes[words.first[i] : words.first[i + 1]]
            short = (own * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
            sets.append(mix(mix(short)))
        else:
            sets.append(_NONE)
    sizes = np.array([len(s) for s in sets], np.int64)
    where = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(sizes, out=where[1:])
    return (np.concatenate(sets) if sets else _NONE), where


def prefix_hasher(data: np.ndarray):
    """``span_hashes`` for many sets of spans of the same bytes; a number tells the sets apart."""
    return lambda start, end, kind: mix(span_hashes(data, start, end) ^ mix(np.full(1, kind, np.uint64)))
