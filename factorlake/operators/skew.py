"""Keeping any one group from landing in one task.

Most groups here are small: a ticker has at most one row per calendar day. Nothing stops an input from
holding a group of billions of rows, so operators that need a whole group in one window first ask
``hot_keys`` (one narrow aggregate over the key columns, partially combined before its shuffle). Without
hot keys the plain window plan is used. Otherwise only the hot keys take a second route, in which rows
are range-partitioned over the cluster, numbered, and cut into blocks that overlap by exactly the rows
the frames need, so results stay the same.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MAX_GROUP_ROWS = 2_000_000

Stage = Callable[[WindowSpec], dict[str, Column]]


def shared_dir(spark) -> str:
    """The cluster's checkpoint folder (``spark.checkpoint.dir``), made the context's if it has none yet.

    Where the setting is missing, a session on one machine (tests) gets a temporary folder that is removed at
    exit; on a cluster that is an error, since executors do not share local folders.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder, so that later uses survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group as ``_count``, computed once (combined per task before the shuffle)."""
    return durable(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_count")))


def hot_keys(
    df: DataFrame, by: Sequence[str], max_rows: int | None = MAX_GROUP_ROWS, sizes: DataFrame | None = None
) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows (at most total/max_rows of them), or None if there are none.

    ``sizes`` (see ``group_sizes``) saves counting again. ``max_rows=None`` skips the check, for inputs
    whose groups are bounded by construction.
    """
    if max_rows is None:
        return None
    counted = sizes if sizes is not None else df.groupBy(*by).agg(F.count(F.lit(1)).alias("_count"))
    hot = counted.where(F.col("_count") > max_rows).select(*by)
    return None if hot.isEmpty() else durable(hot)


def route(
    df: DataFrame,
    by: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    spread: Callable[[DataFrame], DataFrame],
    max_rows: int | None = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``plain`` for ordinary groups, ``spread`` for hot ones."""
    hot = hot_keys(df, by, max_rows, sizes)
    if hot is None:
        return plain(df)
    keyed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in by])
    match = F.lit(True)
    for k in by:
        match = match & df[k].eqNullSafe(keyed[f"_hot_{k}"])  # null keys can be a hot group, too
    return plain(df.join(keyed, match, "left_anti")).unionByName(spread(df.join(keyed, match, "left_semi")))


def join_nullsafe(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where null equals null."""
    other = other.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(other, match).drop(*[f"_r_{k}" for k in keys])


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "_pos") -> DataFrame:
    """Exact zero-based row number within each group, for groups of any size.

    Rows are range-partitioned on ``(by, order)`` and sorted, so that each task holds a contiguous run;
    the run lengths per (group, partition) are summed up into offsets.
    """
    by, order = list(by), list(order)
    runs = durable(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"))
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        runs.groupBy(*by, "_part")
        .agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    return (
        join_nullsafe(runs, heads, [*by, "_part"])
        .withColumn(name, F.col("_seq") + F.col("_shift"))
        .drop("_part", "_seq", "_shift")
    )


def counts_before(tally: DataFrame, by: Sequence[str], value: str, count: str, name: str = "_before") -> DataFrame:
    """Add to each distinct ``value`` of a tally how many rows of its group have a smaller one.

    Values are range-partitioned, so a group of any size is spread; ties have been counted together before.
    """
    by = list(by)
    runs = durable(tally.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = runs.groupBy(*by, "_part").agg(F.sum(count).alias("_n"))
    heads = heads.select(*by, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_in", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    both = join_nullsafe(placed, heads, [*by, "_part"])
    return both.withColumn(name, F.col("_in") + F.col("_shift")).drop("_in", "_shift", "_part")


def over_series(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    stages: Sequence[Stage],
    *,
    back: int,
    ahead: int,
    running: Mapping[str, Column] | None = None,
    max_rows: int | None = MAX_GROUP_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """Add window columns stage by stage; a stage may use the columns of earlier ones.

    Every stage gets the same window, so the frame is shuffled and sorted once. ``back`` and ``ahead``
    are how many rows any output reaches in total, over all stages; hot keys are cut into blocks of
    ``block_rows`` that carry that many rows of their neighbours. ``running`` adds sums from the start of
    the series, ahead of all stages; over blocks they are carried as one number per block.
    """
    by, order, running = list(by), list(order), dict(running or {})
    upto = (Window.unboundedPreceding, Window.currentRow)

    def run(frame: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        for stage in stages:
            frame = frame.withColumns(stage(w))
        return frame

    def plain(frame: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)
        return run(frame.withColumns({n: F.sum(c).over(w) for n, c in running.items()}) if running else frame, by)

    def spread(frame: DataFrame) -> DataFrame:
        size = max(block_rows or max_rows // 4, back, ahead, 1)
        home = F.floor(F.col("_pos") / size)
        at = F.col("_pos") % size
        homes = F.array_compact(
            F.array(
                home,
                F.when(at >= size - back, home + 1) if back else F.lit(None).cast("long"),
                F.when((at < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("long"),
            )
        )
        placed = positions(frame, by, order).withColumn("_home", home)
        if running:
            placed = _carried_sums(placed, by, running)
        out = run(placed.withColumn("_block", F.explode(homes)), [*by, "_block"])
        return out.where(F.col("_block") == F.col("_home")).drop("_pos", "_home", "_block")

    return route(df, by, plain, spread, max_rows)


def _carried_sums(placed: DataFrame, by: list[str], sums: Mapping[str, Column]) -> DataFrame:
    """Running sums over blocks (``_home``, ordered by ``_pos``): inside each block, plus all blocks before it."""
    inner = Window.partitionBy(*by, "_home").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "_home").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    carried = totals.select(*by, "_home", *[F.sum(n).over(before).alias(f"_carry_{n}") for n in sums])
    own = placed.withColumns({f"_own_{n}": F.sum(c).over(inner) for n, c in sums.items()})
    both = join_nullsafe(own, carried, [*by, "_home"])

    def total(n: str) -> Column:
        own_, carry = F.col(f"_own_{n}"), F.col(f"_carry_{n}")
        return F.when(own_.isNull(), carry).when(carry.isNull(), own_).otherwise(own_ + carry)

    extra = [f"_{kind}_{n}" for kind in ("own", "carry") for n in sums]
    return both.withColumns({n: total(n) for n in sums}).drop(*extra)


def row_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    max_rows: int | None = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One-based row number of each row in its group (ascending ``order`` columns)."""

    def plain(f: DataFrame) -> DataFrame:
        return f.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))

    def spread(f: DataFrame) -> DataFrame:
        return positions(f, by, order, name).withColumn(name, F.col(name) + 1)

    return route(df, by, plain, spread, max_rows, sizes)


def rank_and_count(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    *,
    max_rows: int | None = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``_rank`` (ties share the lowest rank) and ``_count`` per group."""
    by = list(by)

    def plain(f: DataFrame) -> DataFrame:
        return f.withColumns(
            {
                "_rank": F.rank().over(Window.partitionBy(*by).orderBy(value)).cast("long"),
                "_count": F.count(F.lit(1)).over(Window.partitionBy(*by)),
            }
        )

    def spread(f: DataFrame) -> DataFrame:
        tally = f.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
        ranks = counts_before(tally, by, value, "_c").select(*by, value, (F.col("_before") + 1).alias("_rank"))
        counts = tally.groupBy(*by).agg(F.sum("_c").alias("_count"))
        return join_nullsafe(join_nullsafe(f, ranks, [*by, value]), counts, by)

    return route(df, by, plain, spread, max_rows, sizes)


def carry_last(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    *,
    max_rows: int | None = MAX_GROUP_ROWS,
    block_rows: int | None = None,
) -> DataFrame:
    """Last non-null ``value`` up to and including each row, however far back it lies."""
    by, order = list(by), list(order)
    upto = (Window.unboundedPreceding, Window.currentRow)

    def plain(f: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)
        return f.withColumn(name, F.last(value, ignorenulls=True).over(w))

    def spread(f: DataFrame) -> DataFrame:
        size = block_rows or max(max_rows // 4, 1)
        cut = positions(f, by, order).withColumn("_block", F.floor(F.col("_pos") / size))
        inner = Window.partitionBy(*by, "_block").orderBy("_pos").rowsBetween(*upto)
        ends = cut.groupBy(*by, "_block").agg(
            F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_pos"))).alias("_end")
        )
        earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
        return (
            join_nullsafe(cut.withColumn(name, F.last(value, ignorenulls=True).over(inner)), carried, [*by, "_block"])
            .withColumn(name, F.coalesce(name, "_carry"))
            .drop("_pos", "_block", "_carry")
        )

    return route(df, by, plain, spread, max_rows)
