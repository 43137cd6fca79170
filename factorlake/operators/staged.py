"""Staged metrics: the surface on which factor groups, built-in or user-defined, are declared.

A provider names its inputs and outputs and lists stages. A stage maps a window (ordered per series) to
named columns and may use what earlier stages produced. Stage *i* of all providers is evaluated in one
projection, so any number of groups costs one shuffle and one sort.

Every provider says how many rows its outputs reach (``back``, ``ahead``), since series too long for a task are cut
into blocks that overlap by so many rows. What reaches back without limit, a running total, is declared by name in
``running`` and carried from block to block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import MAX_GROUP_ROWS, Stage, over_series


class MetricProvider(Protocol):
    inputs: Sequence[str]
    outputs: Sequence[str]
    stages: Sequence[Stage]
    back: int | None
    ahead: int | None
    running: Mapping[str, Column]


@dataclass(frozen=True)
class FeatureGroup:
    """A provider. ``back``/``ahead``: how many rows its outputs reach, over all stages.

    ``running`` names running totals (sums from the start of the series up to each row) for the stages to use;
    they add nothing to the reach.
    """

    outputs: tuple[str, ...] = ()
    stages: tuple[Stage, ...] = ()
    inputs: tuple[str, ...] = ()
    back: int | None = None
    ahead: int | None = None
    running: Mapping[str, Column] = field(default_factory=dict)


def reach(providers: Sequence[MetricProvider]) -> dict[str, int]:
    """Largest declared reach; a provider with stages that does not declare it is an error, whatever the data."""
    for p in providers:
        for side in ("back", "ahead"):
            rows = getattr(p, side, None)
            if p.stages and (not isinstance(rows, int) or rows < 0):
                raise ValueError(f"provider of {list(p.outputs)} must declare how many rows it reaches {side}, not {rows!r}")
    return {side: max((getattr(p, side, None) or 0 for p in providers), default=0) for side in ("back", "ahead")}


def staged_metrics(
    df: DataFrame,
    providers: Sequence[MetricProvider],
    idents: Sequence[str] = (),
    mode: str = "append",
    *,
    by: Sequence[str] = (),
    order: Sequence[str] = (),
    max_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Evaluate providers stage by stage.

    ``append`` keeps the input and intermediate columns, ``select`` returns ``idents`` and the declared
    outputs. With ``order`` but no ``by`` the frame is one series; without ``order`` stages get None
    instead of a window.
    """
    if mode not in ("append", "select"):
        raise ValueError(f"mode must be append or select, not {mode!r}")
    for p in providers:
        lacking = [c for c in p.inputs if c not in df.columns]
        if lacking:
            raise ValueError(f"missing input columns {lacking}")

    def merged(i: int) -> Stage:
        def stage(w):
            cols = {}
            for p in providers:
                if i < len(p.stages):
                    cols.update(p.stages[i](w))
            return cols

        return stage

    stages = [merged(i) for i in range(max((len(p.stages) for p in providers), default=0))]
    running = {name: c for p in providers for name, c in getattr(p, "running", {}).items()}
    if order:
        rows = reach(providers)
        series = df if by else df.withColumn("_series", F.lit(0))
        out = over_series(series, by or ["_series"], order, stages, running=running, max_rows=max_rows, **rows)
        out = out if by else out.drop("_series")
    elif running:
        raise ValueError("running totals need an order")
    else:
        out = df
        for stage in stages:
            out = out.withColumns(stage(None))
    if mode == "select":
        outputs = dict.fromkeys([*idents, *[o for p in providers for o in p.outputs]])
        out = out.select(*outputs)
    return out
