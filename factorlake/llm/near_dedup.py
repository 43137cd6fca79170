"""Near duplicates by MinHash bands, verified by odd sketches and confirmed on full shingle sets.

1. Every text becomes its set of distinct word shingles (64-bit hashes), ``SAMPLES`` MinHash values, band keys
   of ``rows`` values each, and an odd sketch: each (sample, value) flips one bit of a bitmap. The number of
   set bits in the XOR of two sketches estimates how many samples differ, and so the similarity.
2. Texts with the same set are one class, represented by its smallest id; only representatives go on.
3. Representatives that share a band key are compared by sketch, block against block inside tasks. Those
   estimated at ``slack`` below the threshold or above are joined into candidate groups; a bucket sends on a
   spanning forest, never its pairs.
4. Each candidate group gets its full sets (once per pair of blocks) and confirms links exactly, again sending
   on a spanning forest. Components of the confirmed links are the result.

At similarity 0.85 a pair misses all 32 bands of 8 rows with probability 4e-5, at 0.8 all 42 bands of 6 rows with
3e-6, and is underestimated by 0.12 with probability below 1e-6. No bucket or group is capped: larger ones are cut into more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Forest, components
from .store import block_pairs, over_groups, stored
from .words import mix, pieces, shingle_sets, words_of

SAMPLES = 256
SKETCH_BITS = 1024
BUCKET_BLOCK, GROUP_BLOCK = 512, 1024

_random = np.random.Generator(np.random.PCG64(7))
_SCALE = _random.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _random.integers(1, 2**63, SAMPLES, dtype=np.uint64)


def min_hashes(sets: np.ndarray, where: np.ndarray) -> np.ndarray:
    """MinHash values, one row per non-empty set."""
    full = np.flatnonzero(np.diff(where))
    at = where[full]
    out = np.empty((len(full), SAMPLES), np.uint64)
    if len(full):
        for j in range(SAMPLES):
            out[:, j] = np.minimum.reduceat(sets * _SCALE[j], at)
    return mix(out ^ _SALT)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmap of each row of MinHash values (SKETCH_BITS / 8 bytes a row)."""
    n = len(mins)
    bit = (mix(mins) & np.uint64(SKETCH_BITS - 1)).astype(np.int64) + (np.arange(n) * SKETCH_BITS)[:, None]
    odd = np.bincount(bit.ravel(), minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, SKETCH_BITS), axis=1)


def estimate(flipped: np.ndarray) -> np.ndarray:
    """Similarity from the number of set bits in the XOR of two odd sketches."""
    share = np.minimum(2.0 * flipped / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-share)


def most_flipped(similarity: float) -> int:
    """Largest XOR count whose estimate is at least ``similarity``."""
    return int(np.flatnonzero(estimate(np.arange(SKETCH_BITS // 2)) >= similarity).max())


def signatures(docs: DataFrame, id: str, text: str, size: int, rows: int) -> DataFrame:
    """Per row: id, n_shingles, set_a, set_b (identity of the set), bands, sketch (null without shingles)."""
    count = SAMPLES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = words_of(part.column("text"))
                sets, where = shingle_sets(words, words.hashes(lower=True), size)
                n = np.diff(where)
                full = n > 0
                mins = min_hashes(sets, where)
                keys = mix(sets + np.uint64(1))
                a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if full.any():
                    a[full] = np.add.reduceat(keys, where[:-1][full])
                    b[full] = np.add.reduceat(mix(keys), where[:-1][full])
                band = np.zeros((len(mins), count), np.uint64)
                for r in range(rows):
                    band = mix(band + mins[:, r::rows][:, :count] * _SCALE[r])
                band = mix(band + np.arange(count, dtype=np.uint64) * _SCALE[rows])
                at = np.cumsum(full) - 1
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), count).cast(
                    pa.list_(pa.int64())
                )
                take = pa.array(np.where(full, at, 0), mask=~full)
                sketch = pa.array([row.tobytes() for row in odd_sketches(mins)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n, pa.int64()),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        bands.take(take),
                        sketch.take(take),
                    ],
                    ["id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    schema = "id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch binary"
    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """Full sets of the rows of ``docs`` (id, group, group_size, sketch, text) in place of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = words_of(part.column("text"))
                sets, where = shingle_sets(words, words.hashes(lower=True), size)
                full = [sets[where[i] : where[i + 1]].tobytes() for i in range(part.num_rows)]
                yield part.drop_columns(["text"]).append_column("shingles", pa.array(full, pa.binary()))

    return docs.mapInArrow(run, "id bigint, sketch binary, group bigint, group_size bigint, shingles binary")


def _similar(sketches: np.ndarray, left: np.ndarray, right: np.ndarray, most: int):
    """Index pairs (in left, in right, flipped bits) with at most ``most`` flipped bits, some rows at a time."""
    step = max(1, (1 << 17) // max(1, len(right)))
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        flipped = np.zeros((len(rows), len(right)), np.int32)
        for w in range(sketches.shape[1]):
            flipped += np.bitwise_count(sketches[rows, w][:, None] ^ sketches[right, w][None, :])
        x, y = np.nonzero(flipped <= most)
        yield rows[x], right[y], flipped[x, y]


def _sides(lo: int, hi: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    everyone = np.arange(len(block))
    return (everyone, everyone) if lo == hi else (everyone[block == lo], everyone[block == hi])


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _sketch_matrix(table: pa.Table) -> np.ndarray:
    raw = b"".join(table.column("sketch").to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(table.num_rows, SKETCH_BITS // 64)


def _star_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (a, b)], ["a", "b"])


def candidate_links(buckets: DataFrame, floor: float) -> DataFrame:
    """A spanning forest of each pair of blocks of each bucket: ids estimated at ``floor`` or more."""
    most = most_flipped(floor)

    def run(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, lo, hi, block = _columns(table, "id", "_lo", "_hi", "_block")
        sketches, a, b = _sketch_matrix(table), [], []
        ends = np.append(at[1:], table.num_rows)
        small = ends - at == 2  # most buckets: one pair each, all at once
        one = at[small]
        near = np.bitwise_count(sketches[one] ^ sketches[one + 1]).sum(axis=1) <= most
        near &= (block[one] != block[one + 1]) | (lo[one] == hi[one])
        a.append(ids[one[near]])
        b.append(ids[one[near] + 1])
        for s, e in zip(at[~small], ends[~small]):
            left, right = _sides(lo[s], hi[s], block[s:e])
            if e - s < 2 or not len(left) or not len(right):
                continue
            forest, own = Forest(e - s), ids[s:e]
            for x, y, _ in _similar(sketches[s:e], left, right, most):
                # a row whose first partner joins it needs no more of its pairs with the same root
                for i, j in zip(x.tolist(), y.tolist()):
                    if i != j:
                        forest.join(i, j)
            root = forest.roots()
            away = root != np.arange(e - s)
            a.append(own[away])
            b.append(own[root[away]])
        yield _star_batch(a, b)

    return over_groups(buckets, ["bucket", "_lo", "_hi"], run, "a bigint, b bigint")


def confirmed_links(groups: DataFrame, percent: int, floor: float) -> DataFrame:
    """A spanning forest of the exact links in each pair of blocks of each candidate group.

    Pairs are tried from the most similar estimate down, and those already connected are skipped, since they
    change no component.
    """
    most = most_flipped(floor)

    def run(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, lo, hi, block = _columns(table, "id", "_lo", "_hi", "_block")
        sketches, a, b = _sketch_matrix(table), [], []
        shingles = table.column("shingles").combine_chunks()
        for s, e in zip(at, np.append(at[1:], table.num_rows)):
            left, right = _sides(lo[s], hi[s], block[s:e])
            if e - s < 2 or not len(left) or not len(right):
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles.slice(s, e - s)]
            sizes = np.array([len(x) for x in sets])
            code = np.unique(np.concatenate(sets), return_inverse=True)[1]
            where = np.append(0, np.cumsum(sizes))
            forest = Forest(e - s)
            seen = np.zeros(int(code.max()) + 1, bool)
            root = np.arange(e - s)
            # two sweeps: likely links first, so that the long tail of near misses meets larger components
            for low, high in ((-1, most_flipped(percent / 100 + 0.03)), (most_flipped(percent / 100 + 0.03), most)):
                for x, y, flipped in _similar(sketches[s:e], left, right, high):
                    keep = (flipped > low) & (x != y) if low >= 0 else x != y
                    if lo[s] == hi[s]:
                        keep &= x < y
                    x, y = x[keep], y[keep]
                    for i in np.unique(x):
                        others = y[x == i]
                        others = others[root[others] != root[i]]
                        if not len(others):
                            continue
                        seen[code[where[i] : where[i + 1]]] = True
                        lengths = sizes[others]
                        begin = np.append(0, np.cumsum(lengths)[:-1])
                        pick = np.arange(lengths.sum()) + np.repeat(where[others] - begin, lengths)
                        both = np.add.reduceat(seen[code[pick]].astype(np.int64), begin)
                        seen[code[where[i] : where[i + 1]]] = False
                        for j in others[100 * both >= percent * (sizes[i] + lengths - both)].tolist():
                            if forest.join(int(i), j):
                                old, new = max(root[i], root[j]), min(root[i], root[j])
                                root[root == old] = new
            away = root != np.arange(e - s)
            own = ids[s:e]
            a.append(own[away])
            b.append(own[root[away]])
        yield _star_batch(a, b)

    return over_groups(groups, ["group", "_lo", "_hi"], run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    *,
    percent: int = 80,
    shingle: int = 5,
    slack: float = 0.12,
    rows: int | None = None,
) -> DataFrame:
    """Near-duplicate components: one row per row of ``docs``.

    Two texts are linked if ``100 * |intersection| >= percent * |union|`` of their sets of ``shingle``-word
    shingles (words lower-cased in A-Z). Returns ``id``, ``n_shingles``, ``component_id`` (smallest id
    reachable) and ``kept`` (id = component_id). Other columns of ``docs`` are not read. ``rows`` values make a band
    (8 from 85 per cent on, 6 below).

    A null or empty text, or one without words, has no shingles, is linked with nothing and kept. Repeated rows
    share the component of their id and are all returned. A row with a null id is linked with nothing, has a
    null component and is kept. An empty table gives an empty result. Texts of any length are hashed whole, a megabyte or
    one longer text at a time; the full sets of a block of candidates meet in one task.
    """
    floor = percent / 100 - slack
    signed = stored(signatures(docs, id, text, shingle, rows or (8 if percent >= 85 else 6)), "signatures")
    known = signed.where("n_shingles > 0 and id is not null")
    reps = known.groupBy("set_a", "set_b").agg(F.min("id").alias("id"))
    classes = stored(reps, "classes")
    # A representative's own row gives its bands and sketch; repeated rows of one id count once.
    marked = (
        known.join(classes, ["id", "set_a", "set_b"], "left_semi")
        .dropDuplicates(["id", "set_a", "set_b"])
        .select("id", "bands", "sketch")
    )
    marked = stored(marked, "representatives")
    exploded = marked.select("id", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = exploded.join(shared, "bucket").join(marked.select("id", "sketch"), "id")
    coarse = components(candidate_links(block_pairs(buckets, "bucket", "id", "n", BUCKET_BLOCK), floor))
    coarse = stored(coarse, "groups")
    sizes = coarse.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    members = (
        coarse.join(sizes, "component")
        .select(F.col("node").alias("id"), F.col("component").alias("group"), "group_size")
        .join(marked.select("id", "sketch"), "id")
        .select("id", "sketch", "group", "group_size")
    )
    texts = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    texts = texts.join(members, "id").select("id", "sketch", "group", "group_size", "text")
    full = shingle_rows(texts, shingle).dropDuplicates(["id", "shingles"])
    links = confirmed_links(block_pairs(full, "group", "id", "group_size", GROUP_BLOCK), percent, floor)
    found = components(links)
    place = classes.join(found, classes["id"] == found["node"], "left").select(
        "set_a", "set_b", F.coalesce("component", "id").alias("component_id")
    )
    return (
        signed.drop("bands", "sketch")
        .join(place, ["set_a", "set_b"], "left")
        .select(
            "id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
        .withColumnRenamed("id", id)
    )
