"""Exact top-k by inner product, a block of documents at a time, with blocks that cannot matter left out.

A vector of integers is a document whose terms are its dimensions. Documents are laid out in ranges: a seeded sign code
puts like vectors side by side, ``block_rows`` of them are a block, and a shard is ``shard_rows`` of them. A block has a
forward index (its documents' weights) and the extremes of each term. A query's weight times the extreme that helps it
most, summed over terms, bounds every score in the block. A shard visits the blocks of each query in descending
order of bounds, scores whole blocks through their forward indexes, and stops where the bound falls below the query's
kth score so far. Nothing is approximate: a block is passed over only if none of its documents can be among the k.

Every query is first answered in the shard it lies in, where like vectors are. It goes on to the other shards with
its kth score as the bar, so most of what it meets there fails at the bound. A task holds one shard and one packed
set of queries at a time, whatever the table; queries are also cut into slices, so that a shard's work is not one task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.operators.skew import positions

from .chunks import packed, unpacked
from .store import over_groups, runs, stored

CODE_BITS = 32
NONE = np.iinfo(np.int64).min  # no kth score yet
FOUND = "array<struct<query:bigint,query_id:bigint,row:bigint,vec_id:bigint,score:bigint>>"
FOUND_TYPE = pa.struct([(n, pa.int64()) for n in ("query", "query_id", "row", "vec_id", "score")])


def weights(vector: Column, scale: int = 256) -> Column:
    """Integer weights of a vector's components: the floor of ``scale`` times each, taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("bigint"))


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of int64; shorter rows are filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(pc.list_value_length(lists), np.int64)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten(), np.int64)
    return out


def sign_codes(rows: np.ndarray, seed: int) -> np.ndarray:
    """Signs of seeded random projections, most significant first. Equal rows have equal codes."""
    planes = np.random.default_rng(seed).standard_normal((rows.shape[1], CODE_BITS))
    return ((rows.astype(np.float64) @ planes) > 0) @ (1 << np.arange(CODE_BITS, dtype=np.int64)[::-1])


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


@dataclass
class Shard:
    forward: list[np.ndarray]  # per block: documents x terms
    high: np.ndarray  # blocks x terms
    low: np.ndarray
    start: np.ndarray  # of each block's documents
    row: np.ndarray
    id: np.ndarray
    no_id: np.ndarray
    asks: np.ndarray

    @staticmethod
    def of(blocks: pa.Table) -> Shard:
        docs = blocks.column("docs").combine_chunks().flatten()
        whole = matrix(docs.field("weights"))
        start = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(blocks.column("docs"))))]).astype(np.int64)
        parts = [whole[a:b] for a, b in zip(start[:-1], start[1:])]
        width, id = whole.shape[1], docs.field("id")
        return Shard(
            parts,
            _wide(matrix(blocks.column("high")), width),
            _wide(matrix(blocks.column("low")), width),
            start,
            np.asarray(docs.field("row")),
            np.asarray(pc.fill_null(id, 0)),
            np.asarray(id.is_null()),
            np.asarray(docs.field("asks")),
        )


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(width - rows.shape[1], 0))))


def _exact(*arrays: np.ndarray) -> type:
    """A type in which inner products of the arrays' rows are exact, the fastest first."""
    a, b = (max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in arrays)
    most = a * b * max(arrays[0].shape[1], 1)
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores as int64; beyond 64 bits they stay at the limit."""
    out = a @ b.T
    if out.dtype == object:
        out = np.clip(out, NONE + 1, np.iinfo(np.int64).max)
    return out.astype(np.int64)


def search(shard: Shard, asked: np.ndarray, rows: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` documents of the shard for each asked vector that reach its ``bar`` (``NONE``: any), but for its own
    row: query index, document index and score, best first; and how many blocks were scored."""
    width = max(asked.shape[1], shard.high.shape[1])
    asked = _wide(asked, width)
    kind = _exact(asked, np.concatenate([_wide(shard.high, width), _wide(shard.low, width)]))
    want = asked.astype(kind)
    high, low = _wide(shard.high, width).astype(kind), _wide(shard.low, width).astype(kind)
    zero = np.zeros((), kind)
    sums = (np.maximum(want, zero) @ high.T) + (np.minimum(want, zero) @ low.T)
    if kind is object:
        sums = np.clip(sums, NONE + 1, np.iinfo(np.int64).max)
    bounds = sums.astype(np.int64)
    order = np.argsort(-bounds, axis=1, kind="stable")
    forward = [_wide(f, width).astype(kind) for f in shard.forward]
    bar, live, scored = bar.copy(), np.arange(len(asked)), 0
    q, d, s = (np.zeros(0, np.int64) for _ in range(3))
    for turn in range(len(forward)):
        block = order[live, turn]
        open_ = bounds[live, block] >= bar[live]
        live, block = live[open_], block[open_]
        if not len(live):
            break
        scored += len(live)
        new = [(q, d, s)]
        by_block = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[by_block])) + 1
        for some in np.split(by_block, cuts):
            b, who = block[some[0]], live[some]
            scores = _product(want[who], forward[b])
            docs = np.arange(shard.start[b], shard.start[b + 1])
            hit = (scores >= bar[who, None]) & (shard.row[docs] != rows[who, None])
            at, doc = np.nonzero(hit)
            new.append((who[at], docs[doc], scores[at, doc]))
        q, d, s = (np.concatenate(part) for part in zip(*new))
        best = np.lexsort((shard.row[d], shard.id[d], shard.no_id[d], -s, q))
        q, d, s = q[best], d[best], s[best]
        head = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        full = place == k - 1
        bar[q[full]] = np.maximum(bar[q[full]], s[full])
        q, d, s = q[place < k], d[place < k], s[place < k]
    return q, d, s, scored


def _found(shard: Shard, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, d: np.ndarray, s: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(rows[q]), pa.array(ids[q]), pa.array(shard.row[d]), pa.array(shard.id[d], mask=shard.no_id[d]), pa.array(s)],
        fields=list(FOUND_TYPE),
    )


def block_index(vectors: DataFrame, id: str, vector: str, queries: Column, scale: int, shard_rows: int, block_rows: int, seed: int) -> DataFrame:
    """The index as a stored table: shard, block, ``docs`` (row, id, asks, weights of each), ``high``, ``low`` (extremes
    of each term)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("code", pa.array(sign_codes(matrix(batch.column("weights")), seed), pa.int64()))

    def build(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        docs = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("row", "id", "asks", "weights")], ["row", "id", "asks", "weights"])
        whole = matrix(table.column("weights"))
        ends = np.append(at, table.num_rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("shard").combine_chunks().take(pa.array(at)),
                table.column("block").combine_chunks().take(pa.array(at)),
                pa.ListArray.from_arrays(pa.array(ends), docs),
                _lists(np.maximum.reduceat(whole, at, axis=0) if whole.size else np.zeros((len(at), 0), np.int64)),
                _lists(np.minimum.reduceat(whole, at, axis=0) if whole.size else np.zeros((len(at), 0), np.int64)),
            ],
            ["shard", "block", "docs", "high", "low"],
        )

    rows = vectors.select(
        F.col(id).cast("bigint").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.col(vector).alias("v")
    ).where(usable(F.col("v")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "asks", weights(F.col("v"), scale).alias("weights"))
    kept = "row bigint, id bigint, asks boolean, weights array<bigint>"
    coded = stored(rows.mapInArrow(code, f"{kept}, code bigint"), "weights")
    placed = positions(coded, [], ["code", "row"], "at").select(
        F.expr(f"at div {shard_rows}").alias("shard"), F.expr(f"at div {block_rows}").alias("block"), "at", *coded.columns[:-1]
    )
    docs = "array<struct<row:bigint,id:bigint,asks:boolean,weights:array<bigint>>>"
    schema = f"shard bigint, block bigint, docs {docs}, high array<bigint>, low array<bigint>"
    return stored(over_groups(placed, ["shard", "block"], build, schema, ["at"]), "blocks")


def _at_home(k: int):
    """Answer a shard's own queries in it; pack them with the score to beat elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["shard"]):
            for own in np.unique(np.asarray(table.column("shard"))):
                shard = Shard.of(table.filter(pc.equal(table.column("shard"), pa.scalar(int(own)))))
                asks = np.flatnonzero(shard.asks)
                if not len(asks):
                    continue
                asked = np.concatenate(shard.forward)[asks]
                rows, ids = shard.row[asks], shard.id[asks]
                q, d, s, scored = search(shard, asked, rows, np.full(len(asks), NONE), k)
                bar = np.full(len(asks), NONE)
                np.minimum.at(low := np.full(len(asks), np.iinfo(np.int64).max), q, s)
                full = np.bincount(q, minlength=len(asks)) >= k
                bar[full] = low[full]
                pack = packed(pa.table({"row": rows, "id": ids, "bar": bar, "weights": _lists(asked)}))
                found = _found(shard, rows, ids, q, d, s)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(own)]),
                        pa.array([len(asks)], pa.int64()),
                        pa.array([pack], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found),
                        pa.array([scored], pa.int64()),
                    ],
                    ["shard", "queries", "pack", "found", "scored"],
                )

    return run


def _elsewhere(k: int):
    """Answer packed queries in a shard whose blocks come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, blocks, shard = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key = row.column("shard")[0].as_py(), row.column("slice")[0].as_py()
                if key != here:
                    here, blocks, shard = key, [], None
                if not row.column("pack")[0].is_valid:
                    blocks.append(row)
                    continue
                if shard is None:
                    shard = Shard.of(pa.Table.from_batches(blocks))
                    blocks = []
                pack = unpacked(row.column("pack")[0])
                rows, ids, bar = (np.asarray(pack.column(c)) for c in ("row", "id", "bar"))
                q, d, s, scored = search(shard, matrix(pack.column("weights")), rows, bar, k)
                found = _found(shard, rows, ids, q, d, s)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found), pa.array([scored], pa.int64())],
                    ["found", "scored"],
                )

    return run


def top_k(
    vectors: DataFrame,
    queries: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 8192,
    block_rows: int = 128,
    slice_queries: int = 65_536,
    seed: int = 12,
) -> DataFrame:
    """The ``k`` rows with the highest scores for each row that meets ``queries``: query_id, rank (from 1), vec_id, score.

    The score is the inner product of integer weights (floor of ``scale`` times each component); ties go to the
    smaller id, null ids last. Every row but the query's own is a candidate, repeated rows one by one; a repeated query row is
    a query of its own and gets ranks of its own. Queries with fewer than ``k`` candidates get all of them. Vectors
    that are null or hold null or non-finite components take no part; an empty vector scores 0, a shorter one counts as
    filled with zeros. Weights and scores beyond 64 bits stay at the limit. An empty table gives an empty result. Other
    columns are not read. A task holds a shard (``shard_rows`` vectors) and the queries of one other shard; make shards
    as large as executors allow, as there is one message for every two of them.
    """
    if block_rows < 1 or shard_rows % block_rows:
        raise ValueError("shard_rows must be a multiple of block_rows")
    index = block_index(vectors, id, vector, queries, scale, shard_rows, block_rows, seed)
    own = index.repartition("shard").sortWithinPartitions("shard", "block")
    answer = f"shard bigint, queries bigint, pack binary, found {FOUND}, scored bigint"
    home = stored(own.mapInArrow(_at_home(k), answer), "home")
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    slices = max(1, -(-(home.agg(F.sum("queries")).first()[0] or 0) // slice_queries))
    found = home.select("found")
    if shards > 1:
        all_shards, all_slices = (F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) for n in (shards, slices))
        docs = index.withColumns({"slice": F.explode(all_slices), "pack": F.lit(None).cast("binary")})
        asked = home.select(
            F.explode(F.array_remove(all_shards, F.col("shard"))).alias("shard"),
            F.col("shard").alias("block"),
            (F.col("shard") % slices).alias("slice"),
            "pack",
        )
        both = docs.unionByName(asked, allowMissingColumns=True).withColumn("asked", F.col("pack").isNotNull())
        away = both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "asked", "block")
        away = away.mapInArrow(_elsewhere(k), f"found {FOUND}, scored bigint")
        found = found.unionByName(away.select("found"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    rows = found.select(F.explode("found").alias("f")).select("f.*").withColumn("rank", F.row_number().over(best))
    return rows.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(table: str, queries: str, id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> str:
    """The search in DuckDB SQL."""
    return f"""
    WITH v AS (
        SELECT row_number() OVER () AS row, {id} AS id, {queries} AS asks,
            list_transform({vector}, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS w
        FROM {table} WHERE {vector} IS NOT NULL
            AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank, vec_id, score FROM (
        SELECT query_id, vec_id, score,
            row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, row)::INTEGER AS rank
        FROM (SELECT a.row AS query, a.id AS query_id, b.row, b.id AS vec_id,
                coalesce(list_sum(list_transform(list_zip(a.w, b.w), lambda p: p[1] * p[2])), 0)::BIGINT AS score
            FROM v a JOIN v b ON a.row <> b.row WHERE a.asks))
    WHERE rank <= {k}
    """
