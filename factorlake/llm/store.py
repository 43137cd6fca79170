"""Intermediate tables in the shared folder, and groups streamed through tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.operators.skew import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet into the cluster's shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)



def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys (one or many runs each), from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = last_change(batch, keys)
        if cut == 0:  # one run: it may go on from before
            if held and not same(held[-1], held[-1].num_rows - 1, batch, 0, keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int, keys: Sequence[str]) -> bool:
    return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)


def last_change(batch: pa.RecordBatch, keys: Sequence[str]) -> int:
    """Index of the first row of the last run."""
    changed = starts(batch, keys)
    return int(changed[-1])


def starts(table, keys: Sequence[str]) -> np.ndarray:
    """Indexes at which a run of equal (non-null) keys starts."""
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        c = table.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if n > 1:
            new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)))
    return np.flatnonzero(new)


def over_groups(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    order: Sequence[str] = (),
) -> DataFrame:
    """Apply ``fn`` to tables of whole groups; ``fn`` gets the table and the indexes at which its groups start.

    One shuffle and one sort by ``keys``; many small groups share a call, so that a group costs microseconds.
    Groups must be bounded by construction (blocks of a fixed size).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, keys):
            yield from fn(table, starts(table, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def block_pairs(df: DataFrame, key: str, member: str, size: str, block_rows: int) -> DataFrame:
    """Cut groups of known ``size`` into blocks and place every row with each block that it must meet.

    Adds ``_lo``, ``_hi`` (the pair of blocks that meet) and ``_block`` (the row's own). Rows of a group of up
    to ``block_rows`` appear once, with both equal; every two rows of a group meet in exactly one pair of blocks.
    """
    blocks = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    return (
        df.withColumn("_block", own)
        .withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"_lo": F.least("_block", "_with"), "_hi": F.greatest("_block", "_with")})
        .drop("_with", size)
    )
