"""Byte-level BPE: every distinct pre-token is encoded once, ids return to their places, and ids decode to bytes.

Pre-tokens ("words") are the matches of a pattern, each encoded by itself. A task splits the texts of a chunk once and
keeps, for each position, the number of its word in the chunk; each distinct word of a chunk is one row (chunk, place,
word). Shuffled and sorted by word, each distinct word of all chunks is encoded once, and its ids go back to the chunks that
asked, where they take their places. Decoding looks ids up in the table of token bytes, whose size is that of the
vocabulary. What is shuffled grows in proportion to the table: positions once, and a row per chunk and distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import joined, packed, parted, planes, unpacked, unplanes
from .vocab import BYTE_BPE, PATTERN, ranks, single
from .words import PIECE_BYTES, flat, pieces

CHUNK_BYTES = 16 << 20
ANSWER_ROWS = 1 << 18
SLICE_WORDS = 1 << 18  # words put in place at a time, or those of one longer text


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    return regex.compile(pattern).findall


@lru_cache(maxsize=4)
def token_bytes(vocabulary: str = BYTE_BPE) -> np.ndarray:
    """Bytes of each token id, as an array of objects."""
    table = ranks(vocabulary)
    out = np.full(max(table.values()) + 1, None, object)
    for token, rank in table.items():
        out[rank] = token
    return out


def _offsets(sizes: pa.Array) -> pa.Array:
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes.to_numpy(), out=at[1:])
    return pa.array(at)


def _gather(place: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Tokens of the words at ``place``, one after the other."""
    start, size = at[place], at[place + 1] - at[place]
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]


def _slices(first: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``words`` words, one text at least; ``first`` holds where each text starts, and the end."""
    start, n = 0, len(first) - 1
    while start < n or not n:
        end = min(n, max(start + 1, int(np.searchsorted(first, first[start] + words, "right")) - 1))
        yield start, end
        if end >= n:
            return
        start = end


def _positions(pattern: str, chunk_bytes: int):
    """Rows (chunk, blob): the distinct words of a chunk in order of their numbers, its documents' ids and lengths, and
    the numbers of all their words. The pattern runs over each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, chunk = _splitter(pattern), TaskContext.get().partitionId() << 33
        number: dict[str, int] = {}
        parts, numbers, held = [], [], 0

        def close() -> pa.RecordBatch:
            words = pa.table({"word": pa.array(list(number), pa.large_string())})
            blob = joined(packed(words), packed(pa.concat_tables(parts).combine_chunks()), planes(np.concatenate(numbers)))
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                sizes = []
                for text in piece.column("text"):
                    words = find(text.as_py()) if text.is_valid else []
                    numbers.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                    sizes.append(len(words))
                parts.append(pa.table({"id": piece.column("id"), "size": pa.array(sizes, pa.int64())}))
                held += piece.column("text").nbytes + 64 * len(piece)
                if held >= chunk_bytes:
                    yield close()
                    chunk, parts, numbers, held = chunk + 1, [], [], 0
                    number.clear()
        if parts:
            yield close()

    return run


CHUNK_SIZE, PLACE_SIZE = 8, 4  # bytes before and after a word: its chunk, and its number there


def _asked(table: pa.Table) -> pa.Table:
    """A row for each distinct word of a chunk: chunk, word and number in one value. Sorted, and with what changes most at
    its end, neighbouring values share their starts and shuffle small."""
    ((chunk, blob),) = zip(table.column("chunk"), table.column("blob"))
    words = unpacked(parted(blob.as_buffer())[0]).column("word").combine_chunks()
    order = np.asarray(pc.sort_indices(words), np.int64)
    data, at = flat(words.take(pa.array(order)))
    n, more = len(order), CHUNK_SIZE + PLACE_SIZE
    start = at + more * np.arange(n + 1)  # of each value, and the end of the last
    out = np.empty(int(start[-1]), np.uint8)
    out[start[:-1, None] + np.arange(CHUNK_SIZE)] = np.frombuffer(np.int64(chunk.as_py()).tobytes(), np.uint8)
    out[start[1:, None] - PLACE_SIZE + np.arange(PLACE_SIZE)] = order.astype("<i4").view(np.uint8).reshape(n, PLACE_SIZE)
    out[np.arange(len(data)) + CHUNK_SIZE + more * np.repeat(np.arange(n), np.diff(at))] = data
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(start.astype(np.int64)), pa.py_buffer(out)])
    return pa.table({"word": values.cast(pa.binary())})


def _encoded(vocabulary: str):
    """Encode words that come sorted, each once; answers of one chunk travel together, as far as a task holds them."""

    def answers(held: list[tuple]) -> pa.RecordBatch:
        asked, place, size, tokens = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, asked))
        tokens = _gather(order, np.append(0, np.cumsum(size)), tokens)
        asked, place, size = asked[order], place[order], size[order]
        first = np.flatnonzero(np.diff(asked, prepend=-1))
        blobs, ends = [], np.append(0, np.cumsum(size))
        for s, e in zip(first, [*first[1:], len(asked)]):
            blobs.append(joined(planes(np.diff(place[s:e], prepend=0)), planes(size[s:e]), planes(tokens[ends[s] : ends[e]])))
        return pa.RecordBatch.from_arrays([pa.array(asked[first]), pa.array(blobs, pa.binary())], ["asked", "answer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, last, ids = single(vocabulary).encode_ordinary, None, []
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = flat(batch.column("word"))
            found, raw = [], data.tobytes()
            for start, end in zip((at[:-1] + CHUNK_SIZE).tolist(), (at[1:] - PLACE_SIZE).tolist()):
                word = raw[start:end]
                if word != last:
                    last, ids = word, one(word.decode())
                found.append(ids)
            size = np.fromiter(map(len, found), np.int64, len(found))
            tokens = np.fromiter((t for i in found for t in i), np.int32, int(size.sum()))
            asked = data[at[:-1, None] + np.arange(CHUNK_SIZE)].view("<i8").ravel()
            place = data[at[1:, None] - PLACE_SIZE + np.arange(PLACE_SIZE)].view("<i4").ravel()
            held.append((asked, place, size, tokens))
            rows += len(found)
            if rows >= ANSWER_ROWS:
                yield answers(held)
                held, rows = [], 0
        if held:
            yield answers(held)

    return run


def encode(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    *,
    vocabulary: str = BYTE_BPE,
    pattern: str = PATTERN,
    decoded: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``id`` and ``ids`` (array of token ids of the whole text, no special tokens).

    Null and empty texts have an empty array. Repeated rows and rows with null ids are encoded one by one; an
    empty table gives an empty result. Other columns are not read. ``vocabulary`` is the path of a tiktoken rank
    file that every executor can read. ``decoded`` names a further column with the bytes that the ids stand for, looked up
    where they are put together, which saves ``decode`` a task of its own.

    Long texts: a task holds a chunk (``chunk_bytes`` of text or one longer text) as word numbers and tokens. Chunks are cut
    in the order of the scan, so ids may repeat without limit. A word that is everywhere has one row per chunk.
    """

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [[unplanes(p) for p in parted(x.as_buffer())] for x in answers.column("answer")] or [[np.zeros(0, np.int32)] * 3]
        place = np.concatenate([np.cumsum(p) for p, _, _ in parts]).astype(np.int64)
        size, tokens = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        order = np.argsort(place)
        tokens = _gather(order, np.append(0, np.cumsum(size, dtype=np.int64)), tokens)
        of, out = np.append(0, np.cumsum(size[order], dtype=np.int64)), []
        for blob in rows.column("blob"):
            _, docs_, numbers = parted(blob.as_buffer())
            whole, at = unpacked(docs_), unplanes(numbers)
            first = np.append(0, np.cumsum(np.asarray(whole.column("size"))))
            for s, e in _slices(first, SLICE_WORDS):
                here = at[first[s] : first[e]].astype(np.int64)
                ends = np.append(0, np.cumsum(of[here + 1] - of[here]))[first[s : e + 1] - first[s]].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(_gather(here, of, tokens)))
                table = pa.table({"id": whole.column("id").slice(s, e - s), "ids": ids})
                out.append(table if decoded is None else table.append_column(decoded, _bytes(table.column("ids"), vocabulary)))
        return pa.concat_tables(out)

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    # Both uses read the same exchange of chunks.
    chunks = rows.mapInArrow(_positions(pattern, chunk_bytes), "chunk bigint, blob binary")
    asked = chunks.groupBy("chunk").applyInArrow(_asked, "word binary")
    word = F.expr(f"substring(word, {CHUNK_SIZE + 1}, octet_length(word) - {CHUNK_SIZE + PLACE_SIZE})")
    sorted_words = asked.repartition(word).sortWithinPartitions(word)
    answers = sorted_words.mapInArrow(_encoded(vocabulary), "asked bigint, answer binary")
    schema = "id bigint, ids array<int>" + (f", `{decoded}` binary" if decoded else "")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("asked")).applyInArrow(finish, schema).withColumnRenamed("id", id)


def _bytes(ids, vocabulary: str) -> pa.Array:
    table = token_bytes(vocabulary)
    return pa.array([b"".join(table[one.values.to_numpy()].tolist()) if one.is_valid else None for one in ids], pa.binary())


def decode(tokens: DataFrame, ids: str = "ids", into: str = "decoded", *, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``tokens`` with the bytes of its ``ids`` as binary column ``into`` (null ids: null). An unknown id is an error."""
    rest = [c for c in tokens.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(into, _bytes(batch.column(ids), vocabulary))

    frame = tokens.select(*[F.col(f"`{c}`") for c in rest])
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(into, T.BinaryType())]))
