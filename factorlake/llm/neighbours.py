"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Vectors become unit vectors in double precision; equal ones are one class, represented by its smallest id.
2. The first graph comes from several tables of random-hyperplane cells, cut into blocks of bounded size: exact
   nearest neighbours inside each block.
3. Each round joins every vector's neighbours, forward and reverse, with each other and keeps the best of each list,
   until hardly any list that is not saturated gains a neighbour near the threshold.
4. Pairs at the threshold are confirmed in double precision and give the components. A block or local join also sends
   the edges of a spanning forest of its pairs at the threshold, and the pairs too close to it to tell that the forest
   leaves apart, so that full lists cannot hide how groups hang together.
5. A list whose neighbours all reach the threshold is saturated: it is enlarged to the whole component, compared in
   pairs of blocks, of which only counts leave the task. No list length limits the number of links.
6. Recall is audited: a bounded sample of vectors is compared with all rows, each vector weighing the same, saturated
   ones apart. Below the target, the graph is built on with further tables; if ``attempts`` have passed and one more
   does not raise recall, the call fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import Forest, components
from .store import block_pairs, over_groups, stored

BLOCK = 512
ROUNDED = 1e-6  # more than the error of a cosine in single precision
QUANTISED = 0.03  # more than the error of a cosine of 8-bit codes
AUDITED = 1024  # vectors that one pass of the recall audit compares with all rows, saturated and other ones each
LINKED = 200  # audited vectors with a link that a recall of either kind should rest on
PASSES = 8  # of the audit, at most


# ---- vectors -----------------------------------------------------------------------------------


def _unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are usable vectors of ``dim`` components, and their unit vectors."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    values = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(len(right), dim)
    top = np.abs(values).max(axis=1) if dim else np.zeros(len(right))
    good = np.isfinite(top) & (top > 0)
    values = values[good] / top[good, None]
    return right[good], values / np.linalg.norm(values, axis=1, keepdims=True) + 0.0


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column, dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def unit_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``id`` and ``unit`` (binary of doubles) of the usable rows of ``vectors`` (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = _unit_rows(batch.column("vector"), dim)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), _binary(units)], ["id", "unit"])

    return vectors.mapInArrow(run, "id bigint, unit binary")


# ---- graph -------------------------------------------------------------------------------------


def _forest_of(cosines: np.ndarray, threshold: float, error: float, ids: np.ndarray, a: list, b: list) -> None:
    """Add pairs to the link lists that hold together what the pairs at the threshold of a square matrix do.

    Pairs above the threshold by more than ``error`` give the edges of a spanning forest. Pairs within ``error`` may
    fail in double precision, so no tree may rest on them: all of them that the forest leaves apart are added.
    """
    x, y = np.nonzero(np.triu(cosines >= threshold - error, 1))
    sure = cosines[x, y] >= threshold + error
    forest = Forest(len(ids))
    tree = [(i, j) for i, j in zip(x[sure].tolist(), y[sure].tolist()) if forest.join(i, j)]
    root = forest.roots()
    x, y = x[~sure], y[~sure]
    apart = root[x] != root[y]
    i, j = np.array(tree, np.int64).reshape(-1, 2).T
    a.append(ids[np.concatenate((i, x[apart]))])
    b.append(ids[np.concatenate((j, y[apart]))])


def _edges(src: list, dst: list, sim: list, kind: list) -> pa.RecordBatch:
    def of(x, t):
        return pa.array(np.concatenate(x) if x else np.zeros(0, t))

    return pa.RecordBatch.from_arrays(
        [of(src, np.int64), of(dst, np.int64), of(sim, np.float32), of(kind, bool)], ["src", "dst", "sim", "link"]
    )


EDGES = "src bigint, dst bigint, sim float, link boolean"


def _cells(units: DataFrame, dim: int, tables: range, bits: int) -> DataFrame:
    """Rows (id, code, cell): one for each table, with the signs of its random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [np.random.Generator(np.random.PCG64([11, t])).standard_normal((dim, bits)) for t in tables]
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch.column("unit"), np.float64, dim)
            narrow = _binary(rows.astype(np.float32))
            for t, plane in zip(tables, planes):
                cell = ((rows @ plane) > 0) @ weights + (np.int64(t) << 40)
                yield pa.RecordBatch.from_arrays([batch.column("id"), narrow, pa.array(cell, pa.int64())], ["id", "code", "cell"])

    return units.select("id", "unit").mapInArrow(run, "id bigint, code binary, cell bigint")


def first_graph(units: DataFrame, dim: int, tables: range, bits: int, k: int, threshold: float) -> DataFrame:
    """Nearest neighbours inside blocks of random cells (``link``: a pair that holds a block's groups at the threshold together)."""

    def run(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table.column("id").to_numpy()
        rows = _matrix(table.column("code"), np.float32, dim)
        src, dst, sim, kind = [], [], [], []
        for s, e in zip(at, np.append(at[1:], table.num_rows)):
            if e - s < 2:
                continue
            own, n = ids[s:e], e - s
            cosines = rows[s:e] @ rows[s:e].T
            a, b = [], []
            _forest_of(cosines, threshold, ROUNDED, own, a, b)
            np.fill_diagonal(cosines, -2)
            top = np.argpartition(-cosines, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
            src += [np.repeat(own, top.shape[1]), a[0]]
            dst += [own[top].ravel(), b[0]]
            sim += [np.take_along_axis(cosines, top, 1).ravel(), np.full(len(a[0]), threshold, np.float32)]
            kind += [np.zeros(top.size, bool), np.ones(len(a[0]), bool)]
        yield _edges(src, dst, sim, kind)

    cells = _cells(units, dim, tables, bits)
    sizes = cells.select("cell").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id", "cell"), blocks)).drop("n")
    return over_groups(dealt, ["cell", "block"], run, EDGES)


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar neighbours of each vector, with the similarity a further one must exceed (``bar``)."""
    ranked = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    kept = ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return kept.select("src", "dst", "sim", F.when(F.col("nth") == k, F.col("sim")).alias("bar"))


def local_joins(lists: DataFrame, codes: DataFrame, dim: int, k: int, turn: int, threshold: float) -> DataFrame:
    """Compare each vector's neighbours, forward and reverse, with each other; edges that improve a list."""

    def run(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table.column("u").to_numpy()
        bar = table.column("bar").to_numpy()
        rows = _matrix(table.column("code"), np.int8, dim).astype(np.float32)
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        src, dst, sim, kind = [], [], [], []
        for s, e in zip(at, np.append(at[1:], table.num_rows)):
            if e - s < 2:
                continue
            own = ids[s:e]
            cosines = rows[s:e] @ rows[s:e].T
            np.fill_diagonal(cosines, -2)
            x, y = np.nonzero(cosines > bar[s:e, None])
            a, b = [], []
            if (cosines >= threshold - QUANTISED).any():
                _forest_of(cosines, threshold, QUANTISED, own, a, b)
            src += [own[x], *a]
            dst += [own[y], *b]
            sim += [cosines[x, y], *[np.full(len(f), threshold, np.float32) for f in a]]
            kind += [np.zeros(len(x), bool), *[np.ones(len(f), bool) for f in a]]
        yield _edges(src, dst, sim, kind)

    forward = lists.select(F.col("src").alias("v"), F.col("dst").alias("u"))
    # A vector may be in any number of lists; like every NN-descent, a round joins a random share of those.
    order = Window.partitionBy("v").orderBy(F.xxhash64("u", F.lit(turn)), "u")
    reverse = forward.select(F.col("u").alias("v"), F.col("v").alias("u"))
    reverse = reverse.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")
    bars = lists.groupBy("src").agg(F.coalesce(F.max("bar"), F.lit(-1.0)).cast("float").alias("bar"))
    members = codes.join(bars, codes["id"] == bars["src"]).select(F.col("id").alias("u"), "code", "bar")
    return over_groups(forward.unionByName(reverse).distinct().join(members, "u"), ["v"], run, EDGES)


def codes_of(units: DataFrame, dim: int) -> DataFrame:
    """8-bit codes of unit vectors, an eighth of their size, for the joins of the descent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("unit"), np.float64, dim)
            codes = np.rint(rows * (127 / np.abs(rows).max(axis=1, keepdims=True))).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(codes)], ["id", "code"])

    return units.select("id", "unit").mapInArrow(run, "id bigint, code binary")


# ---- links -------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, units: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Distinct pairs (a < b) whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(c), np.float64, dim) for c in ("x", "y"))
            good = pa.array(np.einsum("ij,ij->i", x, y) >= threshold)
            yield batch.select(["a", "b"]).filter(good)

    pairs = pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()
    left = units.select(F.col("id").alias("a"), F.col("unit").alias("x"))
    right = units.select(F.col("id").alias("b"), F.col("unit").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def component_links(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Links of the saturated vectors of each component (id, links), in pairs of blocks.

    ``members``: id, unit, copies, saturated, component, size. Copies of a linked vector count one by one.
    """

    def run(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, copies, full, lo, hi, block = (
            table.column(c).to_numpy() for c in ("id", "copies", "saturated", "_lo", "_hi", "_block")
        )
        rows = _matrix(table.column("unit"), np.float64, dim)
        out, links = [], []
        for s, e in zip(at, np.append(at[1:], table.num_rows)):
            everyone = np.arange(s, e)
            one, two = everyone[block[s:e] == lo[s]], everyone[block[s:e] == hi[s]]
            for left, right in ((one, two),) if lo[s] == hi[s] else ((one, two), (two, one)):
                left = left[full[left]]
                if len(left) and len(right):
                    near = (rows[left] @ rows[right].T) >= threshold
                    near &= left[:, None] != right[None, :]
                    out.append(ids[left])
                    links.append(near @ copies[right])
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (out, links)], ["id", "links"])

    dealt = block_pairs(members, "component", "id", "size", BLOCK)
    return over_groups(dealt, ["component", "_lo", "_hi"], run, "id bigint, links bigint").groupBy("id").agg(
        F.sum("links").alias("links")
    )


def audit(units: DataFrame, found: DataFrame, dim: int, threshold: float) -> float | None:
    """Share of its links that an audited vector has found: the mean over those with a link, so that each weighs the same.

    Saturated vectors and others are averaged apart, and the lower mean counts: links of large groups cannot hide
    lost ones of small groups. Vectors are taken by the hash of their id, ``AUDITED`` of either kind in a pass, until
    ``LINKED`` of the kind have links, all were compared, or ``PASSES`` are over. Without any link there is no recall.
    """
    shares: dict[bool, list[float]] = {True: [], False: []}
    open_kinds = [True, False]
    for turn in range(PASSES):
        taken = []
        for kind in list(open_kinds):
            some = found.where(F.col("saturated") == kind).select("id", "links").orderBy(F.xxhash64("id", F.lit("audit")), "id")
            some = some.offset(turn * AUDITED).limit(AUDITED).join(units.select("id", "unit"), "id").collect()
            taken += [(r["id"], r["links"], kind, bytes(r["unit"])) for r in some]
            if len(some) < AUDITED:
                open_kinds.remove(kind)
        if taken:
            true = _true_links(units, np.array([r[0] for r in taken]), [r[3] for r in taken], dim, threshold)
            for i, links, kind, _ in taken:
                if true[i]:
                    shares[kind].append(min(links, true[i]) / true[i])
        open_kinds = [kind for kind in open_kinds if len(shares[kind]) < LINKED]
        if not open_kinds:
            break
    return min((float(np.mean(x)) for x in shares.values() if x), default=None)


def _true_links(units: DataFrame, ids: np.ndarray, asked: list[bytes], dim: int, threshold: float) -> dict[int, int]:
    """Links of a bounded number of vectors, which are sent to all tasks; everything else is compared in place."""
    asked = np.frombuffer(b"".join(asked), np.float64).reshape(len(ids), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            own, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            rows = _matrix(batch.column("unit"), np.float64, dim)
            for s in range(0, len(own), 4096):
                near = (asked @ rows[s : s + 4096].T) >= threshold
                near &= ids[:, None] != own[None, s : s + 4096]
                total += near @ copies[s : s + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "links"])

    true = units.select("id", "copies", "unit").mapInArrow(run, "id bigint, links bigint")
    return {r["id"]: r["true"] for r in true.groupBy("id").agg(F.sum("links").alias("true")).collect()}


def _near_counts(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.groupBy("src").agg(F.count_if(F.col("sim") >= threshold - QUANTISED).alias("n"))


def gains(before: DataFrame, after: DataFrame, k: int, threshold: float) -> tuple[int, int]:
    """Near neighbours that the lists not saturated before have gained, and how many they hold now."""
    was = _near_counts(before, threshold).where(F.col("n") < k).withColumnRenamed("n", "was")
    both = was.join(_near_counts(after, threshold), "src")
    row = both.agg(F.sum(F.greatest(F.col("n") - F.col("was"), F.lit(0))), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def near_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    *,
    threshold: float = 0.95,
    k: int = 10,
    tables: int = 6,
    rounds: int = 6,
    settled: float = 0.002,
    target_recall: float = 0.95,
    attempts: int = 3,
) -> DataFrame:
    """Links at ``threshold`` cosine or more: ``id``, ``n_links``, ``component_id``, ``kept``, ``audit_recall``.

    ``n_links`` counts the other rows linked directly, equal vectors included. A vector that is null, zero, holds
    a null or non-finite component, or has another number of components than most rows links with nothing and is
    kept. Repeated rows of one id are counted like other rows and each get that id's largest number of links and its
    smallest component; a row with a null id links with nothing and has a null component. An empty table gives an empty result. Labels and other columns are not read.
    ``audit_recall`` is null where no audited vector has a link.
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    sizes = rows.where("id is not null and vector is not null").groupBy(F.size("vector").alias("dim"))
    common = sizes.count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    usable = unit_vectors(rows.where("id is not null"), dim).select(
        "id", "unit", F.xxhash64("unit").alias("key_a"), F.xxhash64("unit", F.lit(1)).alias("key_b")
    )
    keyed = stored(usable, "units")
    classes = keyed.groupBy("key_a", "key_b").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")
    )
    classes = stored(classes, "classes")
    total = classes.count()
    bits = max(1, int(np.ceil(np.log2(max(total, 2) / 128)))) if total > 128 else 1
    codes = stored(codes_of(classes, dim), "codes")
    edges, recall, table, attempt = None, None, 0, 0
    while True:
        more = stored(first_graph(classes, dim, range(table, table + tables), bits, k, threshold), "graph")
        table += tables
        edges = more if edges is None else edges.unionByName(more)
        forest = edges.where("link")
        lists = stored(best_lists(edges, k), "lists")
        for turn in range(rounds):
            gained = stored(local_joins(lists, codes, dim, k, table + turn, threshold), "joins")
            forest = forest.unionByName(gained.where("link"))
            merged = lists.select("src", "dst", "sim").unionByName(gained.where("not link").select("src", "dst", "sim"))
            before, lists = lists, stored(best_lists(merged, k), "lists")
            gained_now, now = gains(before, lists, k, threshold)
            if turn and gained_now <= settled * now:
                break
        close = lists.where(F.col("sim") >= threshold - QUANTISED)
        pairs = stored(confirmed(close.select("src", "dst").unionByName(forest.select("src", "dst")), classes, dim, threshold), "links")
        place = stored(components(pairs), "components")
        full = close.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("src").alias("id"), F.lit(True).alias("saturated"))
        found = stored(_counted(classes, place, pairs, full, dim, threshold), "found")
        last, recall, attempt = recall, audit(classes, found, dim, threshold), attempt + 1
        edges = lists.select("src", "dst", "sim", F.lit(False).alias("link")).unionByName(
            forest.select("src", "dst", "sim", "link")
        )
        if recall is None or recall >= target_recall:
            break
        if attempt >= attempts and recall <= (last or 0.0):
            raise RuntimeError(f"audited recall {recall:.4f} is below {target_recall} and no longer rises after {attempt} attempts")
    result = (
        keyed.select("id", "key_a", "key_b")
        .join(found.select("key_a", "key_b", "links", "component", "copies"), ["key_a", "key_b"])
        .groupBy("id")
        .agg(F.max(F.col("links") + F.col("copies") - 1).alias("n_links"), F.min("component").alias("component"))
    )
    return (
        rows.select("id")
        .join(result, "id", "left")
        .select(
            F.col("id").alias(id),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
            F.lit(recall).cast("double").alias("audit_recall"),
        )
    )


def _counted(classes: DataFrame, place: DataFrame, pairs: DataFrame, full: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Per class: links to other classes' rows and component; exact in components with saturated vectors."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    weights = classes.select(F.col("id").alias("other"), "copies")
    listed = both.join(weights, "other").groupBy("id").agg(F.sum("copies").alias("links"))
    marked = place.join(full, place["node"] == full["id"], "left").select(
        "node", "component", F.coalesce("saturated", F.lit(False)).alias("saturated")
    )
    # Only components that hold a saturated vector are compared in full.
    sizes = marked.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.max("saturated").alias("any"))
    members = (
        marked.join(sizes.where("any").drop("any"), "component")
        .join(classes.select("id", "copies", "unit"), F.col("node") == F.col("id"))
        .select("id", "unit", "copies", "saturated", "component", "size")
    )
    exact = component_links(members, dim, threshold).withColumnRenamed("links", "exact")
    return (
        classes.drop("unit")
        .join(listed, "id", "left")
        .join(exact, "id", "left")
        .join(place.withColumnRenamed("node", "id"), "id", "left")
        .join(full, "id", "left")
        .select(
            "id",
            "key_a",
            "key_b",
            "copies",
            F.coalesce("exact", "links", F.lit(0)).alias("links"),
            F.coalesce("saturated", F.lit(False)).alias("saturated"),
            F.coalesce("component", "id").alias("component"),
        )
    )
