"""Merkle manifest of a table: a content-addressed DAG of digests, descended from its root for proofs of single rows.

Every row is a leaf. Leaves of a group form a tree in a given order, and the roots of all groups form the tree on top.
A node is the digest of its children's digests (``fan`` consecutive ones). The store keeps, for each digest, the digests
of its children; equal contents share records. Records are clustered in segments: a subtree of ``levels`` levels
under its top digest is one row, so a tree of any size is built and descended in a few rounds, and a task holds
a thousand digests of one segment at a time.

A proof comes from a descent: a request starts at the root, takes in each node the child that the next digit of its rank
(base ``fan``) names, and collects the others. Requests that share their way travel as one until it parts. The steps
collected from root to leaf are the proof when reversed; who holds a row and its proof can recompute the root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.operators.skew import positions

from .store import over_groups, stored

SEGMENT_LEAVES = 1024
PATH = "array<struct<left:string,right:string>>"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
NODES = "array<struct<digest:string,children:array<string>>>"


def content_digest(columns: Sequence[str | Column]) -> Column:
    """Hex SHA-256 of the columns' values one after the other: ``-`` if null, else UTF-8 byte count, ``:``, value."""

    def field(c: str | Column) -> Column:
        value = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def node_digest(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


@dataclass
class Tree:
    """A forest: ``roots`` (tree, n, height, digest) and its segments, leaves' first."""

    roots: DataFrame
    segments: list[DataFrame]


@dataclass
class Manifest:
    leaves: DataFrame  # tree, rank, digest, the group and the kept columns
    groups: Tree
    top: Tree
    fan: int
    levels: int

    def records(self) -> DataFrame:
        """``digest`` and ``children`` of every node above the leaves, each once."""
        rows = [s.select(F.explode("nodes").alias("n")) for s in (*self.groups.segments, *self.top.segments)]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out.select("n.digest", "n.children").distinct()


def _levels(fan: int) -> int:
    return max(1, int(math.log(SEGMENT_LEAVES, fan) + 1e-9))


def _height(n: Column, fan: int) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    powers = [1]
    while powers[-1] * fan < 2**63:
        powers.append(powers[-1] * fan)
    return F.size(F.filter(F.array(*[F.lit(p).cast("bigint") for p in powers]), lambda p: p < n))


def climb(nodes: DataFrame, sizes: DataFrame, fan: int, levels: int) -> Tree:
    """Build the trees over ``nodes`` (tree, rank, height, digest; ``height`` of the whole tree), given
    ``sizes`` (tree, n, height)."""

    def build(table: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        digests, heights = table.column("digest").to_pylist(), table.column("height").to_pylist()
        first = table.take(pa.array(at))
        tops, below, ends, kids, kid_ends = [], [], [0], [], [0]
        for s, e in zip(at.tolist(), [*at[1:].tolist(), table.num_rows]):
            row, seen = digests[s:e], {}
            for _ in range(min(levels, heights[s])):
                runs = [row[i : i + fan] for i in range(0, len(row), fan)]
                row = [node_digest(r) for r in runs]
                seen.update(zip(row, runs))
            tops.append(row[0])
            below.extend(seen)
            ends.append(len(below))
            for run in seen.values():
                kids.extend(run)
                kid_ends.append(len(kids))
        children = pa.ListArray.from_arrays(pa.array(kid_ends, pa.int32()), pa.array(kids, pa.string()))
        node = pa.StructArray.from_arrays([pa.array(below, pa.string()), children], ["digest", "children"])
        left = [max(h - levels, 0) for h in first.column("height").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                first.column("tree").combine_chunks(),
                first.column("block").combine_chunks(),
                pa.array(left, pa.int32()),
                pa.array(tops, pa.string()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), node),
            ],
            ["tree", "rank", "height", "digest", "nodes"],
        )

    size, segments = fan**levels, []
    rounds = max(1, -(-(sizes.agg(F.max("height")).first()[0] or 0) // levels))
    for _ in range(rounds):
        cut = nodes.select("tree", "rank", F.expr(f"rank div {size}").alias("block"), "height", "digest")
        built = over_groups(cut, ["tree", "block"], build, f"tree bigint, rank bigint, height int, digest string, nodes {NODES}", ["rank"])
        segments.append(stored(built, "segments"))
        nodes = segments[-1]
    return Tree(sizes.join(nodes.select("tree", "digest"), "tree"), segments)


def manifest(
    docs: DataFrame,
    columns: Sequence[str],
    group: str,
    order: str,
    *,
    fan: int = 2,
    keep: Mapping[str, Column] | None = None,
) -> Manifest:
    """Build the manifest of ``docs``: leaves are digests of ``columns``, in trees by ``group``, ordered by ``order``.

    Null is a group and an order value of its own, ahead of all others; groups are ordered bytewise. Rows with
    equal order values are ordered by digest, so repeated rows are leaves side by side and the root does not depend
    on how rows are dealt out. Very long texts are hashed inside the scan and never shuffled. ``keep`` names columns to
    carry with each leaf. Other columns are not read. An empty table has no trees and no root.
    """
    if fan < 2:
        raise ValueError("fan must be 2 or more")
    levels, keep = _levels(fan), dict(keep or {})
    rows = docs.select(
        F.col(f"`{group}`").cast("string").alias("group"),
        F.col(f"`{order}`").alias("order"),
        content_digest(columns).alias("digest"),
        F.struct(*[c.alias(n) for n, c in keep.items()] or [F.lit(True).alias("none")]).alias("kept"),
    )
    rows = stored(rows.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    placed = positions(rows, ["group"], ["order", "digest", "nth"], "rank")
    sizes = stored(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "groups")
    sizes = stored(
        positions(sizes, [], ["group"], "tree").select("tree", "group", "n", _height(F.col("n"), fan).alias("height")), "trees"
    )
    named = sizes.select("tree", "height", F.col("group").alias("of"))
    leaves = placed.join(named, placed["group"].eqNullSafe(named["of"])).select("tree", "rank", "height", "digest", "group", "kept")
    leaves = stored(leaves, "placed")
    groups = climb(leaves.select("tree", "rank", "height", "digest"), sizes.select("tree", "n", "height"), fan, levels)
    count = groups.roots.count()
    whole = docs.sparkSession.range(min(count, 1)).select(F.lit(0).cast("bigint").alias("tree"), F.lit(count).cast("bigint").alias("n"))
    whole = whole.withColumn("height", _height(F.col("n"), fan))
    tops = groups.roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), _height(F.lit(count), fan).alias("height"), "digest")
    top = climb(tops, whole, fan, levels)
    return Manifest(leaves, groups, top, fan, levels)


def _steps(ways: list[list[tuple[str, str]]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ways)])
    flat = [s for way in ways for s in way]
    sides = [pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, fields=list(STEP)))


def _ways(bundle: dict, ranks: Sequence[int], depth: int, fan: int) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Descend from a bundle's digest for each rank: the digest reached, and the steps of the whole way so far."""
    children = {n["digest"]: n["children"] for n in bundle["nodes"]}
    come = [(s["left"], s["right"]) for s in bundle["path"]]
    for rank in ranks:
        at, way = bundle["digest"], list(come)
        for level in range(depth - 1, -1, -1):
            run, digit = children[at], rank // fan**level % fan
            way.append(("".join(run[:digit]), "".join(run[digit + 1 :])))
            at = run[digit]
        yield at, way


def descend(tree: Tree, starts: DataFrame, requests: DataFrame, fan: int, levels: int) -> DataFrame:
    """``requests`` (tree, rank, kept) with ``carried`` of their tree's start, and ``path``: the steps from the
    start's digest down to the request's leaf, behind the start's own. ``starts``: tree, n, height, digest, path, carried.
    """
    size = fan**levels
    carried = starts.schema["carried"].dataType.simpleString()
    state = f"tree bigint, rank bigint, digest string, path {PATH}, n bigint, height int, carried {carried}"

    def opened(at: DataFrame, segments: DataFrame) -> DataFrame:
        return at.join(segments.select("digest", "nodes").dropDuplicates(["digest"]), "digest")

    def depth(bundle: dict, r: int) -> int:
        return min(max(bundle["height"] - r * levels, 0), levels)

    at = starts.select("tree", F.lit(0).cast("bigint").alias("rank"), "digest", "path", "n", "height", "carried")

    def parted(r: int):
        def part(table: pa.Table) -> pa.Table:
            (bundle,) = table.to_pylist()
            below = -(-bundle["n"] // size**r)  # nodes of this tree at the foot of the segment
            ranks = range(bundle["rank"] * size, min((bundle["rank"] + 1) * size, below)) if depth(bundle, r) else [bundle["rank"]]
            found = list(_ways(bundle, ranks, depth(bundle, r), fan))
            same = table.select(["tree", "n", "height", "carried"]).take(pa.array([0] * len(found)))
            return pa.table(
                {
                    "tree": same["tree"],
                    "rank": pa.array(ranks, pa.int64()),
                    "digest": pa.array([d for d, _ in found], pa.string()),
                    "path": _steps([w for _, w in found]),
                    "n": same["n"],
                    "height": same["height"],
                    "carried": same["carried"],
                }
            )

        return part

    for r in range(len(tree.segments) - 1, 0, -1):
        at = opened(at, tree.segments[r]).groupBy("tree", "rank").applyInArrow(parted(r), state)

    def meet(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return asked.schema.empty_table().select(["kept"]).append_column("path", _steps([])).append_column("carried", table["carried"].slice(0, 0))
        (bundle,) = table.to_pylist()
        ways = [w for _, w in _ways(bundle, asked["rank"].to_pylist(), depth(bundle, 0), fan)]
        return pa.table({"kept": asked["kept"], "path": _steps(ways), "carried": table["carried"].take(pa.array([0] * len(ways)))})

    here = requests.select("tree", F.expr(f"rank div {size}").alias("block"), "rank", "kept").groupBy("tree", "block")
    kept = requests.schema["kept"].dataType.simpleString()
    bundles = opened(at, tree.segments[0]).groupBy("tree", "rank")
    return here.cogroup(bundles).applyInArrow(meet, f"kept {kept}, path {PATH}, carried {carried}")


def proofs(of: Manifest, requests: Column | None = None) -> DataFrame:
    """A proof of every leaf, or of those that meet ``requests`` (a condition on ``kept``): the kept columns, ``leaf``,
    ``subroot``, ``root`` and ``proof``, the siblings left and right of the way from leaf to root, level by level."""
    fan, levels = of.fan, of.levels
    start = of.top.roots.select("tree", "n", "height", "digest", F.array().cast(PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("carried"))
    trees = of.groups.roots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.struct("tree", "n", "height", "digest").alias("kept"))
    ways = stored(descend(of.top, start, trees, fan, levels), "ways")
    starts = ways.select("kept.*", "path", F.struct(F.col("kept.digest").alias("subroot"), F.col("carried.root").alias("root")).alias("carried"))
    leaves = of.leaves if requests is None else of.leaves.where(requests)
    asked = leaves.select("tree", "rank", F.struct(F.col("digest").alias("leaf"), "kept.*").alias("kept"))
    found = descend(of.groups, starts, asked, fan, levels)
    return found.select("kept.*", "carried.*", F.reverse("path").alias("proof"))


def folded(leaf: Column, proof: str | Column = "proof") -> Column:
    """The root that follows from a leaf's digest and its proof alone."""
    up = lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256)
    return F.aggregate(proof, leaf, up)


def proof_digest(proof: str | Column = "proof") -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame, id: str = "doc_id", number: str = "n_chars", *, fan: int = 2) -> DataFrame:
    """Tamper with some rows of ``documents`` and verify all against the manifest of the untouched table.

    Where 7 divides the CRC-32 of the decimal id, ``number`` grows by one (null ids are left alone, null numbers stay).
    Per row: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` of the untouched table, ``folded_root`` from the row as
    it now is, and ``verified``: whether that is the root.
    """
    hit = F.crc32(F.col(id).cast("string").cast("binary")) % 7 == 0
    changed = [F.col(c) + 1 if c == number else F.col(c) for c in MANIFEST_COLUMNS]
    keep = {id: F.col(id), "_now": F.when(hit, content_digest(changed))}
    found = proofs(manifest(docs, MANIFEST_COLUMNS, "lang", id, fan=fan, keep=keep))
    out = found.withColumn("folded_root", folded(F.coalesce("_now", "leaf")))
    return out.select(id, "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def audit_sql(table: str) -> str:
    """The audit with ``fan`` 2 in DuckDB SQL."""
    fields = {
        "doc_id": "doc_id::varchar", "source": "source", "lang": "lang", "n_chars": "n_chars::varchar", "text": "text",
    }

    def digest(columns: Mapping[str, str]) -> str:
        parts = [f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns.values()]
        return f"sha256({' || '.join(parts)})"

    changed = fields | {"n_chars": "(n_chars + 1)::varchar"}
    codes = "list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::BIGINT)"
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: {byte}), 4294967295)"
    climb = """
        SELECT {tree}, level + 1, idx // 2, sha256(digest || coalesce(sib, '')), (n + 1) // 2 FROM (
            SELECT *, lead(digest) OVER (PARTITION BY {tree} ORDER BY idx) AS sib FROM {name}) WHERE idx % 2 = 0 AND n > 1"""
    fold = """
        SELECT f.row, f.tree, f.level + 1, f.idx // 2,
            CASE WHEN f.idx % 2 = 0 THEN sha256(f.now || coalesce(s.digest, '')) ELSE sha256(s.digest || f.now) END,
            list_append(f.way, coalesce(s.digest, ''))
        FROM {name} f JOIN {nodes} p ON p.tree = f.tree AND p.level = f.level AND p.idx = f.idx
        LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE p.n > 1"""
    return f"""
    WITH RECURSIVE leaf AS (
        SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, d) AS row, doc_id, d AS leaf, coalesce(now, d) AS now,
            dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
        FROM (SELECT doc_id, lang, {digest(fields)} AS d, CASE WHEN {crc} % 7 = 0 THEN {digest(changed)} END AS now FROM {table})),
    node(tree, level, idx, digest, n) AS (
        SELECT tree, 0, idx, leaf, n FROM leaf UNION ALL ({climb.format(tree="tree", name="node")})),
    subroot AS (SELECT tree, digest, count(*) OVER () AS n FROM node WHERE n = 1),
    top(tree, level, idx, digest, n) AS (
        SELECT 0, 0, tree, digest, n FROM subroot UNION ALL ({climb.format(tree="tree", name="top")})),
    below(row, tree, level, idx, now, way) AS (
        SELECT row, tree, 0, idx, now, []::VARCHAR[] FROM leaf UNION ALL ({fold.format(name="below", nodes="node")})),
    above(row, tree, level, idx, now, way) AS (
        SELECT b.row, 0, 0, b.tree, b.now, b.way FROM below b JOIN node p ON p.tree = b.tree AND p.level = b.level AND p.idx = b.idx
        WHERE p.n = 1 UNION ALL ({fold.format(name="above", nodes="top")}))
    SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(array_to_string(a.way, '')) AS proof_sha256,
        a.now AS folded_root, a.now = t.digest AS verified
    FROM leaf l JOIN subroot s USING (tree) JOIN above a ON a.row = l.row
    JOIN top t ON t.level = a.level AND t.idx = a.idx AND t.n = 1
    """
