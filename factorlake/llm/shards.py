"""Balanced shards from a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Each shard owns ``points`` arcs of the ring; a row belongs to the arc on which the hash of its id falls. Every
shard has a capacity in rows, and the capacities add up to the table, so counts differ by one at most. A shard
above its capacity keeps the same share of each of its arcs; what overflows continues clockwise and takes the
first room that no earlier overflow has taken. All of this is decided on counts per arc (``shards * points`` rows,
whatever the table), as prefix sums around the ring; rows only look up the segment their rank falls into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

RING_BITS = 32
CELL_BITS = 16  # equal cells of the ring, to look arcs up by an equality


def ring(spark, shards: int, points: int) -> DataFrame:
    """arc (numbered clockwise), shard, point (its end on the ring) of every virtual node.

    A point depends on its shard and number alone, so a further shard leaves the other points where they are.
    """
    nodes = spark.range(shards * points, numPartitions=1).select(
        F.floor(F.col("id") / points).cast("int").alias("shard"), (F.col("id") % points).cast("int").alias("nth")
    )
    point = F.pmod(F.xxhash64(F.lit("node"), "shard", "nth"), F.lit(1 << RING_BITS))
    return nodes.select("shard", "nth", point.alias("point")).select(
        (F.row_number().over(Window.orderBy("point", "shard", "nth")) - 1).alias("arc"), "shard", "point"
    )


def arc_cells(arcs: DataFrame) -> DataFrame:
    """One row per (arc, cell of the ring) with the positions the arc covers, ends included."""
    after = F.lag("point").over(Window.orderBy("arc"))
    top = (1 << RING_BITS) - 1
    spans = arcs.select("arc", F.coalesce(after + 1, F.lit(0)).alias("lo"), F.col("point").alias("hi"))
    last = arcs.agg((F.max("point") + 1).alias("lo")).select(F.lit(0).alias("arc"), "lo", F.lit(top).alias("hi"))
    shift = RING_BITS - CELL_BITS
    return (
        spans.unionByName(last)
        .where("lo <= hi")
        .withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))
    )


def capacities(loads: DataFrame, shards: int) -> DataFrame:
    """Rows that each arc keeps or may take at most: per shard they add up to its capacity exactly."""
    all_rows, own = Window.partitionBy(), Window.partitionBy("shard")
    exact = "decimal(38,0)"
    total = F.sum("load").over(all_rows)
    shares = loads.withColumns(
        {
            "capacity": F.floor(total / shards).cast("bigint") + (F.col("shard") < total % shards).cast("int"),
            "natural": F.sum("load").over(own),
            "arcs": F.count(F.lit(1)).over(own),
        }
    )
    weight = F.when(F.col("natural") > 0, F.col("load")).otherwise(1).cast(exact)
    whole = F.when(F.col("natural") > 0, F.col("natural")).otherwise(F.col("arcs")).cast(exact)
    part = weight * F.col("capacity").cast("decimal(18,0)")
    shares = shares.withColumns(
        {"rest": (part % whole).cast(exact), "whole": whole}
    ).withColumn("base", ((part - F.col("rest")) / F.col("whole")).cast("bigint"))
    spare = F.col("capacity") - F.sum("base").over(own)
    nth = F.row_number().over(own.orderBy(F.desc("rest"), "arc"))
    return shares.select("arc", "shard", "load", (F.col("base") + (nth <= spare).cast("int")).alias("room"))


def segments(caps: DataFrame) -> DataFrame:
    """Where the rows of each arc go: arc, first and last rank, shard, and the slot of the first rank."""
    around = Window.orderBy("arc")
    flow = caps.select(
        "arc",
        "shard",
        F.least("load", "room").alias("keep"),
        F.greatest(F.col("load") - F.col("room"), F.lit(0)).alias("over"),
        F.greatest(F.col("room") - F.col("load"), F.lit(0)).alias("free"),
    )
    # Start behind the arc where the running surplus is lowest: from there, room never comes before what fills it.
    level = flow.withColumn("level", F.sum(F.col("over") - F.col("free")).over(around))
    turn = level.withColumn("start", F.first("arc").over(Window.partitionBy().orderBy("level", "arc")))
    turn = turn.withColumn("turn", F.pmod(F.col("arc") - F.col("start") - 1, F.count(F.lit(1)).over(Window.partitionBy())))
    past = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    queue = turn.withColumns(
        {"out_at": F.coalesce(F.sum("over").over(past), F.lit(0)), "in_at": F.coalesce(F.sum("free").over(past), F.lit(0))}
    )
    # Overflow and room are both numbered along the ring; cut at all starts, each piece has one source and one goal.
    source = F.struct("arc", F.lit(1).alias("of"), "keep", "out_at")
    goal = F.struct("arc", "shard")
    cuts = (
        queue.where("over > 0")
        .select(F.col("out_at").alias("k"), source.alias("source"), F.lit(None).cast("struct<arc:int,shard:int>").alias("goal"), (F.col("out_at") + F.col("over")).alias("end"))
        .unionByName(
            queue.where("free > 0").select(F.col("in_at").alias("k"), goal.alias("goal"), F.lit(None).alias("source"), F.lit(None).cast("bigint").alias("end")),
        )
        .groupBy("k")
        .agg(F.first("source", True).alias("source"), F.first("goal", True).alias("goal"), F.max("end").alias("end"))
    )
    along = Window.orderBy("k")
    pieces = cuts.select(
        "k",
        F.coalesce(F.lead("k").over(along), F.max("end").over(Window.partitionBy())).alias("until"),
        F.last("source", True).over(along).alias("source"),
        F.last("goal", True).over(along).alias("goal"),
    ).where("k < until and source is not null and goal is not null")
    first = F.col("source.keep") + F.col("k") - F.col("source.out_at") + 1
    moved = pieces.select(
        F.col("source.arc").alias("arc"),
        first.alias("lo"),
        (first + F.col("until") - F.col("k") - 1).alias("hi"),
        F.col("goal.shard").alias("shard"),
        F.lit(1).alias("kind"),
    )
    stay = flow.where("keep > 0").select("arc", F.lit(1).cast("bigint").alias("lo"), F.col("keep").alias("hi"), "shard", F.lit(0).alias("kind"))
    before = Window.partitionBy("shard").orderBy("kind", "arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
    return stay.unionByName(moved).withColumn(
        "slot_at", F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1).over(before), F.lit(0))
    )


def ring_shards(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, shards: int = 40, points: int = 1024
) -> DataFrame:
    """Place every row into a shard: ``id``, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``law`` (``rows``:
    counts are at most one apart), ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` (null) and
    ``displaced`` (true for the few rows that continue beyond their own shard).

    A null text has no bytes. Rows are hashed by id, rows with a null id by their text, so that many such rows
    spread; repeated rows are placed one by one. An empty table gives an empty result. Other columns are not read.
    The shuffle carries ids and checksums only, by arc; raise ``points`` where an arc would be too large for a task. More
    points also even out the ring, so that fewer rows continue past their own shard, and fewer move when one is added.
    Very long texts are measured inside the scan.
    """
    spark = docs.sparkSession
    bytes_ = F.encode(F.col(text), "UTF-8")
    key: Column = F.coalesce(F.xxhash64(F.lit("row"), F.when(F.col(id).isNotNull(), F.col(id))), F.lit(0))
    key = F.when(F.col(id).isNull(), F.xxhash64(F.lit("null"), F.col(text))).otherwise(key)
    rows = docs.select(
        F.col(id).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.coalesce(F.crc32(bytes_), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.pmod(key, F.lit(1 << RING_BITS)).alias("position"),
    ).withColumn("cell", F.shiftright("position", RING_BITS - CELL_BITS))
    # The ring has shards * points arcs whatever the input, so its tables are bounded and may be broadcast.
    arcs = stored(ring(spark, shards, points).withColumn("arc", F.col("arc").cast("int")), "ring")
    on_arc = rows.join(F.broadcast(arc_cells(arcs).withColumnRenamed("cell", "arc_cell")), (F.col("cell") == F.col("arc_cell")) & F.col("position").between(F.col("lo"), F.col("hi")))
    on_arc = stored(on_arc.select("id", "size", "text_crc32", "position", F.col("arc").cast("int").alias("arc")), "rows")
    counts = on_arc.groupBy("arc").agg(F.count(F.lit(1)).alias("load"))
    loads = arcs.join(counts, "arc", "left").select("arc", "shard", F.coalesce("load", F.lit(0)).alias("load"))
    where = stored(segments(capacities(loads, shards)), "segments").withColumnRenamed("arc", "from_arc")
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("position", "id", "text_crc32", "size"))
    return (
        on_arc.withColumn("rank", rank.cast("bigint"))
        .join(F.broadcast(where), (F.col("arc") == F.col("from_arc")) & F.col("rank").between(F.col("lo"), F.col("hi")))
        .select(
            F.col("id").alias(id),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("slot_at") + F.col("rank") - F.col("lo")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            (F.col("kind") == 1).alias("displaced"),
        )
    )
