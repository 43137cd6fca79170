"""Mixing sources to target weights by hierarchical budgets.

A tree (say domain, language, source) holds integer weights. A token budget flows from the root to the leaves: at each
node it is divided among the children by weight, no child gets more than its texts can give in ``max_epochs`` passes,
and what a short child cannot use goes to its siblings first and to its parent's siblings only when all of them are
full. That division has a closed form, computed as windows over the (small) table of nodes.
Each leaf then takes whole epochs and a token-prefix of one more epoch, in an order seeded by epoch.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free, stored

WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"
NONE = "(none)"  # the node of rows without a value
SLOT_DIGITS = 3  # hexadecimal digits of the order that cut a leaf into 4096 slots


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(id: str, text: str) -> Column:
    """What a row is drawn by: its id, or a digest of its text where it has none."""
    return F.coalesce(F.col(id).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def draw(key: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key))


def divide(nodes: DataFrame, parent: Sequence[str], node: str, weights: Mapping[str, int], default: int) -> DataFrame:
    """Divide ``amount`` (of the parent) among its children: adds ``share`` to rows (parent.., node, capacity, amount).

    With children in order of capacity per weight, a prefix of them is filled up; the rest share what is left by
    weight. Child i is filled if filling everyone to its level costs no more than the amount.
    """
    weight = F.lit(default)
    for name, value in weights.items():
        weight = F.when(F.col(node) == name, value).otherwise(weight)
    rows = nodes.withColumn("w", weight.cast(BIG)).withColumn("cap", F.col("capacity").cast(BIG))
    by = Window.partitionBy(*parent)
    order = by.orderBy((F.col("capacity").cast("double") / F.col("w").cast("double")), node)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    cost = F.sum("cap").over(upto).cast("decimal(28,0)") * F.col("w").cast("decimal(9,0)") + F.col("cap").cast(
        "decimal(28,0)"
    ) * F.coalesce(F.sum("w").over(after), F.lit(0)).cast("decimal(9,0)")
    full = cost <= F.col("amount").cast("decimal(28,0)") * F.col("w").cast("decimal(9,0)")
    rows = rows.withColumn("full", full)
    left = F.col("amount").cast(BIG) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(by)
    product = left.cast("decimal(28,0)") * F.col("w").cast("decimal(9,0)")
    part = (product - product % open_.cast("decimal(28,0)")).cast(BIG) / open_
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.least(part.cast("bigint"), F.col("capacity")))
    return rows.withColumn("share", share).drop("w", "cap", "full")


def leaf_quotas(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    budget: int | None,
    max_epochs: int,
    default: int = 1,
) -> DataFrame:
    """``quota`` of each leaf. ``leaves``: the levels and ``tokens``; no budget means all tokens there are."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    above = None
    for i, node in enumerate(levels):
        at = [*levels[: i + 1]]
        nodes = leaves.groupBy(*at).agg(F.sum("capacity").cast("bigint").alias("capacity"))
        if above is None:
            total = leaves.agg(F.sum("tokens")).first()[0] or 0
            nodes = nodes.withColumn("amount", F.lit(total if budget is None else budget).cast("bigint"))
        else:
            nodes = nodes.join(above.withColumnRenamed("share", "amount"), at[:-1])
        above = divide(nodes, at[:-1], node, weights.get(node, {}), default).select(*at, "share")
    return leaves.join(above.withColumnRenamed("share", "quota"), [*levels]).drop("capacity")


def plan(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    *,
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per leaf: the levels (as ``_level0``..), ``quota``, whole ``epochs`` and the last row (``cut_hash``,
    ``cut_key``) of the prefix that the next epoch gives.

    The prefix is found without one task per leaf: tokens are summed per slot of the order, and only the slot where
    the quota ends is looked into.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    named = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(names, levels.values())]
    rows = stored(docs.select(*named, words_in(text).alias("tokens"), order_key(id, text).alias("key")), "mixing-rows")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").cast("bigint").alias("tokens"))
    by_name = {n: weights.get(level, {}) for n, level in zip(names, levels)}
    quotas = leaf_quotas(stored(leaves, "mixing-leaves"), names, by_name, budget, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(0)
    quotas = stored(
        quotas.withColumn("epochs", epochs.cast("bigint")).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens")),
        "mixing-quotas",
    )
    drawn = rows.join(quotas.select(*names, "epochs", "rest"), names).withColumn(
        "hash", draw(F.col("key"), F.col("epochs") + 1, seed)
    )
    drawn = drawn.withColumn("slot", F.substring("hash", 1, SLOT_DIGITS))
    slots = drawn.groupBy(*names, "slot", "rest").agg(F.sum("tokens").alias("slot_tokens"))
    before = Window.partitionBy(*names).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_tokens").over(before), F.lit(0)))
    last = slots.where(F.col("before") <= F.col("rest")).groupBy(*names).agg(F.max_by(F.struct("slot", "before"), "slot").alias("at"))
    ends = last.select(*names, F.col("at.slot").alias("slot"), F.col("at.before").alias("before"))
    # Rows of equal hash and key are taken together or not at all.
    peers = Window.partitionBy(*names).orderBy("hash", "key")
    inside = drawn.join(ends, [*names, "slot"]).withColumn("upto", F.col("before") + F.sum("tokens").over(peers))
    cuts = inside.where(F.col("upto") <= F.col("rest")).groupBy(*names).agg(F.max(F.struct("hash", "key")).alias("cut"))
    return (
        quotas.join(ends.select(*names, "slot"), names, "left")
        .join(cuts, names, "left")
        .select(
            *names,
            "quota",
            "epochs",
            # Before the first row of the last slot lies everything of the slots before it.
            F.coalesce(F.col("cut.hash"), F.col("slot"), F.lit("")).alias("cut_hash"),
            F.coalesce(F.col("cut.key"), F.lit("")).alias("cut_key"),
        )
    )


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    *,
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
    into: str = "_mix",
) -> DataFrame:
    """``docs`` with a struct ``into`` (replacing one of that name): ``tokens`` (words), ``quota`` of its leaf,
    ``copies`` (0: not drawn).

    ``levels`` maps level names to columns, from the root down; ``weights`` gives integer weights by level and value
    (1 where not given; a weight must be positive). A null level value is a node of its own. Empty and null texts
    have no tokens and are drawn wherever the prefix reaches them. Repeated rows are drawn together. An empty table
    gives an empty result. Texts are not shuffled: rows only look up their leaf.
    """
    names = [f"_level{i}" for i in range(len(levels))]
    named = {n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, levels.values())}
    cuts = stored(plan(docs, levels, weights, budget=budget, max_epochs=max_epochs, seed=seed, id=id, text=text), "mixing-plan")
    docs = docs.drop(into)
    leaf, found = free(docs, "_leaf"), free(docs, "_plan")
    cuts = cuts.select(F.struct(*names).alias(leaf), F.struct("quota", "epochs", "cut_hash", "cut_key").alias(found))
    joined = docs.withColumn(leaf, F.struct(*[c.alias(n) for n, c in named.items()])).join(cuts, leaf, "left")
    of = {c: F.col(f"{found}.{c}") for c in ("quota", "epochs", "cut_hash", "cut_key")}
    key = order_key(id, text)
    drawn = F.struct(draw(key, of["epochs"] + 1, seed), key) <= F.struct(of["cut_hash"], of["cut_key"])
    copies = (of["epochs"] + drawn.cast("int")).cast("bigint")
    mixed = F.struct(words_in(text).alias("tokens"), of["quota"].alias("quota"), copies.alias("copies"))
    return joined.withColumn(into, mixed).select(*[F.col(f"`{c}`") for c in docs.columns], into)


# ---- the same in SQL ---------------------------------------------------------------------------


def mix_sql(
    source: str,
    levels: Mapping[str, str],
    weights: Mapping[str, Mapping[str, int]],
    *,
    budget: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
) -> str:
    """DuckDB SQL for the drawn rows: ``id``, the levels, tokens, quota, copies."""
    names = list(levels)
    on = ", ".join(names)
    parts = [
        "rows_ AS (SELECT {id} AS id, {levels}, coalesce(len(regexp_extract_all({text}, '{word}')), 0)::BIGINT AS tokens, "
        "coalesce({id}::VARCHAR, 't' || md5(coalesce({text}, ''))) AS key FROM {source})".format(
            id=id,
            text=text,
            word=WORD,
            source=source,
            levels=", ".join(f"coalesce(({e})::VARCHAR, '{NONE}') AS {n}" for n, e in levels.items()),
        ),
        f"leaves AS (SELECT {on}, sum(tokens)::HUGEINT AS tokens FROM rows_ GROUP BY {on})",
    ]
    for i, node in enumerate(names):
        at, up = ", ".join(names[: i + 1]), ", ".join(names[:i])
        cases = "".join(f" WHEN '{v}' THEN {w}" for v, w in weights.get(node, {}).items())
        weight = f"(CASE {node}{cases} ELSE 1 END)::HUGEINT" if cases else "1::HUGEINT"
        root = "(SELECT sum(tokens)::HUGEINT FROM leaves)" if budget is None else f"{budget}::HUGEINT"
        amount = "any_value(amount)" if i else root
        joined = "leaves" if i == 0 else f"leaves JOIN (SELECT {up}, share AS amount FROM level{i - 1}) USING ({up})"
        by = f"PARTITION BY {up}" if up else ""
        order = f"{by} ORDER BY cap::DOUBLE / w::DOUBLE, {node}"
        parts += [
            f"nodes{i} AS (SELECT {at}, sum(tokens) * {max_epochs} AS cap, {weight} AS w, {amount} AS amount "
            f"FROM {joined} GROUP BY {at})",
            f"fill{i} AS (SELECT *, sum(cap) OVER ({order} ROWS UNBOUNDED PRECEDING) * w + cap * coalesce(sum(w) OVER "
            f"({order} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) <= amount * w AS filled FROM nodes{i})",
            f"level{i} AS (SELECT {at}, CASE WHEN filled THEN cap ELSE least(cap, ((amount - coalesce(sum(CASE WHEN filled THEN "
            f"cap END) OVER ({by}), 0))::HUGEINT * w) // (sum(CASE WHEN NOT filled THEN w END) OVER ({by}))::HUGEINT) END AS share FROM fill{i})",
        ]
    parts += [
        f"quotas AS (SELECT {on}, tokens AS leaf_tokens, share AS quota, CASE WHEN tokens > 0 THEN share::HUGEINT // tokens ELSE 0 END AS epochs "
        f"FROM leaves JOIN level{len(names) - 1} USING ({on}))",
        f"drawn AS (SELECT *, quota - epochs * leaf_tokens AS rest, md5('{seed}:' || (epochs + 1)::BIGINT || ':' || key) AS hash "
        f"FROM rows_ JOIN quotas USING ({on}))",
        f"placed AS (SELECT *, sum(tokens) OVER (PARTITION BY {on} ORDER BY hash, key) AS upto FROM drawn)",
    ]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT id AS {id}, {on}, tokens, quota::BIGINT AS quota, "
        "(epochs + (upto <= rest)::INT)::BIGINT AS copies FROM placed WHERE epochs + (upto <= rest)::INT > 0"
    )
