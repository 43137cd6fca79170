"""Whole texts in chunks of consecutive ids, packed for the shuffle, and messages between chunks and buckets.

Operators that look every word or window up in a table of all words or windows would shuffle one row for each.
Here a chunk (some megabytes of text) sends each bucket of keys one packed row with its distinct keys, gets one packed
row back, and meets its texts again. Texts cross the shuffle once, compressed: both uses read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

UNIT_BYTES = 8192
CHUNK_UNITS = 2000  # a unit is a text of up to UNIT_BYTES, so a chunk has 16 MB of text at most (or one longer text)

def packed(table) -> bytes:
    sink = pa.BufferOutputStream()
    zstd = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, table.schema, options=zstd) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer() if hasattr(blob, "as_buffer") else blob).read_all()


def joined(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(blob: pa.Buffer) -> list[pa.Buffer]:
    """The parts that ``joined`` put together."""
    out, at = [], 0
    while at < blob.size:
        size = int.from_bytes(blob[at : at + 8].to_pybytes(), "little")
        out.append(blob[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed by byte plane: high bytes are mostly alike."""
    raw = np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unplanes(blob: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(blob[:8].to_pybytes(), "little")
    raw = pa.Codec("zstd").decompress(blob[8:], decompressed_size=4 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.int32).ravel()


def bounds_of(docs: DataFrame, chunk_units: int = CHUNK_UNITS) -> list[int]:
    """Ids that end each chunk but the last: one number for each 16 MB of text or less."""
    weight = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / UNIT_BYTES).cast("int")
    weights = stored(docs.select("id", weight.alias("units")), "weights")
    total = weights.agg(F.sum("units")).first()[0] or 0
    chunks = -(-total // chunk_units)
    if chunks < 2:
        return []
    ids = weights.where("id is not null").select(F.explode(F.array_repeat("id", F.col("units"))).alias("id"))
    shares = [k / chunks for k in range(1, chunks)]
    cut = ids.agg(F.percentile_approx("id", shares, max(10_000, 20 * chunks))).first()[0]
    return sorted(set(cut or []))


def packed_texts(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """``docs`` (id, text) as rows (chunk, blob): many texts a row, chunks in order of ids.

    Equal ids share a chunk. Rows with null ids are dealt over all chunks.
    """
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            ids = batch.column("id")
            chunk = np.searchsorted(edges, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "left")
            null = np.asarray(ids.is_null())
            chunk = np.where(null, (np.arange(len(ids)) + turn) % (len(edges) + 1), chunk)
            turn += len(ids)
            order = np.argsort(chunk, kind="stable")
            found, at = np.unique(chunk[order], return_index=True)
            blobs = [packed(batch.take(pa.array(rows))) for rows in np.split(order, at[1:])] if len(order) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "blob"]
            )

    return docs.mapInArrow(run, "chunk int, blob binary")


def texts_of(table: pa.Table) -> pa.Table:
    """The texts of one chunk, in order of ids (nulls last)."""
    whole = pa.concat_tables([unpacked(b) for b in table.column("blob")])
    return whole.take(pc.sort_indices(whole, sort_keys=[("id", "ascending")]))


def round_trip(
    docs: DataFrame,
    ask: Callable[[pa.Table, int], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[int], list[bytes]], list[bytes]],
    finish: Callable[[pa.Table, int, dict[int, bytes]], pa.Table],
    schema: str,
    chunk_units: int = CHUNK_UNITS,
) -> DataFrame:
    """Ask all buckets about each chunk of ``docs`` (id, text) and finish each chunk with the answers.

    ``ask(texts, buckets)`` gives (bucket, message) pairs; ``answer(chunks, messages)`` gets all messages of one
    bucket, ordered by chunk, and gives one reply each; ``finish(texts, buckets, replies by bucket)`` returns rows.
    There are as many buckets as chunks, so a bucket's messages are as large as a chunk's.
    """
    bounds = bounds_of(docs, chunk_units)
    buckets = len(bounds) + 1
    texts = packed_texts(docs, bounds)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        cells = list(ask(texts_of(table), buckets))
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in cells], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(cells), pa.int32()),
                "message": pa.array([m for _, m in cells], pa.binary()),
            }
        )

    def reply(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("chunk", "ascending")]))
        chunks, messages = table.column("chunk").to_pylist(), table.column("message").to_pylist()
        return pa.table(
            {
                "chunk": pa.array(chunks, pa.int32()),
                "bucket": pa.array([key[0].as_py()] * len(chunks), pa.int32()),
                "message": pa.array(answer(chunks, messages), pa.binary()),
            }
        )

    def close(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("message").to_pylist()))
        return finish(texts_of(left), buckets, replies)

    asked = texts.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, message binary")
    replied = asked.groupBy("bucket").applyInArrow(reply, "chunk int, bucket int, message binary")
    return texts.groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(close, schema)
