"""Substring dedup: repeated windows of words, found by rolling hashes, merged into maximal intervals and removed.

A window's 64-bit hash is a sum over its words' polynomial hashes. Each chunk of consecutive ids sends its distinct
window hashes to buckets of the hash range; there the first chunk of a hash owns it, and all later chunks hear one bit
per hash they sent. Inside a chunk the smallest id owns. What any earlier document owns is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_UNITS, round_trip
from .words import PIECE_BYTES, pieces, window_hashes, words_of


def _windows(texts: pa.Table, size: int) -> Iterator[tuple[pa.RecordBatch, object, np.ndarray, np.ndarray]]:
    """Pieces of a chunk with their words, window hashes and the windows' first words; null ids have no windows."""
    for batch in texts.combine_chunks().to_batches():
        for part in pieces(batch, "text", PIECE_BYTES):
            words = words_of(part.column("text"))
            hashes, at = window_hashes(words.hashes(), words.first, size)
            null = np.asarray(part.column("id").is_null())
            if null.any():
                own = ~null[words.text[at]]
                hashes, at = hashes[own], at[own]
            yield part, words, hashes, at


def _distinct(texts: pa.Table, size: int) -> np.ndarray:
    found = [h for _, _, h, _ in _windows(texts, size)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _bucket_bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of the hash range starts in sorted ``hashes``."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _shrunk(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _grown(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)


def _squeezed(hashes: np.ndarray) -> bytes:
    """Sorted hashes by byte plane, so that the slowly growing high bytes compress."""
    return _shrunk(np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueezed(message: bytes) -> np.ndarray:
    planes = np.frombuffer(_grown(message), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _owned_before(chunks: list[int], messages: list[bytes]) -> list[bytes]:
    """For each chunk's hashes, bits that say whether an earlier chunk sent the same hash."""
    parts = [_unsqueezed(m) for m in messages]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")  # equal hashes stay in order of chunks
    again = np.zeros(len(every), bool)
    again[order[1:]] = every[order[1:]] == every[order[:-1]]
    at = np.cumsum([len(p) for p in parts])
    return [_shrunk(np.packbits(bits).tobytes()) for bits in np.split(again, at[:-1])]


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, window: int = 13, chunk_units: int = CHUNK_UNITS
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Returns per row ``id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a space) and ``removed``
    (maximal intervals of words: start, end exclusive). Windows are judged on the input. Null and empty texts
    have no words; a text shorter than a window keeps all. Repeated rows of one id do not remove each other's
    words. Rows with null ids are kept whole and remove nothing. An empty table gives an empty result. A text longer than a
    chunk is a chunk of its own; other columns are not read.
    """

    def ask(texts: pa.Table, buckets: int) -> Iterator[tuple[int, bytes]]:
        hashes = _distinct(texts, window)
        at = _bucket_bounds(hashes, buckets)
        for b in range(buckets):
            if at[b + 1] > at[b]:
                yield b, _squeezed(hashes[at[b] : at[b + 1]])

    def finish(texts: pa.Table, buckets: int, replies: dict[int, bytes]) -> pa.Table:
        known = _distinct(texts, window)
        at = _bucket_bounds(known, buckets)
        before = np.zeros(len(known), bool)
        for b, bits in replies.items():
            n = int(at[b + 1] - at[b])
            before[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(_grown(bits), np.uint8), count=n).astype(bool)
        owner = np.full(len(known), np.iinfo(np.int64).max)
        rows: list[pa.Table] = []
        for part, words, hashes, first in _windows(texts, window):  # texts come in order of ids
            place = np.searchsorted(known, hashes)
            number = pc.fill_null(part.column("id"), 0).to_numpy(zero_copy_only=False)[words.text[first]]
            np.minimum.at(owner, place, number)
            drop = first[before[place] | (number > owner[place])]
            gone = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(gone, drop, 1)
            np.add.at(gone, drop + window, -1)
            covered = np.cumsum(gone[:-1]) > 0
            rows.append(_part_rows(part, words, covered))
        return pa.concat_tables(rows)

    renamed = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:int,end:int>>"
    return round_trip(renamed, ask, _owned_before, finish, schema, chunk_units).withColumnRenamed("id", id)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _part_rows(part: pa.RecordBatch, words, covered: np.ndarray) -> pa.Table:
    raw = words.data.tobytes()
    kept, spans, removed = [], [], []
    for i in range(part.num_rows):
        a, b = words.first[i], words.first[i + 1]
        own = covered[a:b]
        n = int(own.sum())
        text = raw[words.text_at[i] : words.text_at[i + 1]].split()  # the same words, as bytes
        if n:
            step = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
            spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist())])
            text = [text[k] for k in np.flatnonzero(~own).tolist()]
        else:
            spans.append([])
        kept.append(b" ".join(text).decode())
        removed.append(n)
    return pa.table(
        {
            "id": part.column("id"),
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.string()),
            "removed": pa.array(spans, pa.list_(_SPAN)),
        }
    )
