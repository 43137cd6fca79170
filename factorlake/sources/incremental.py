"""Feature tables that grow: an append recomputes only what the new rows touch.

The reach that metric providers declare says which rows an append can change: the new ones, and the last ``ahead`` rows
of each series before them (forward returns, say). To recompute those takes ``back`` rows more. So the table keeps, per
series, its last ``back + ahead`` input rows, and for each running total its sum up to there. An append reads
that state and the new rows, never the history.

Layout under the table's path: ``rows/batch=<n>`` holds what append ``n`` found. Its column ``_part`` is 0 in rows that no later
append changes, 1 in such rows with their inputs, 2 in inputs only (as a folder it would have wide rows sorted by it before
they are written). Outputs are stored once, when they are final; those
of the last ``ahead`` rows of a series are computed from their inputs when the table is read. Inputs are stored once, too, until
those added since are as many as those kept before: then the next append writes down anew what is needed of them. ``state/batch=<n>``
holds the schema and where the inputs begin; it is written last and makes the append valid. One that failed before
leaves nothing behind that is read, and is repeated under its number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import MAX_GROUP_ROWS, join_nullsafe, row_position
from ..operators.staged import FeatureGroup, MetricProvider, reach, staged_metrics


_MARKS = ("_since", "_kept", "_added")


@dataclass(frozen=True)
class GrowingFeatures:
    """A stored table of staged metrics (see ``staged_metrics``), kept up to date by ``append``."""

    spark: SparkSession
    path: str
    providers: Sequence[MetricProvider]
    by: Sequence[str] = ("ts_code",)
    order: str = "date"
    idents: Sequence[str] = ("ts_code", "date")
    max_rows: int | None = MAX_GROUP_ROWS

    def _folder(self, part: str, batch: int) -> str:
        return f"{self.path.rstrip('/')}/{part}/batch={batch}"

    def last_batch(self) -> int:
        """Number of the last complete append, 0 if there is none."""
        try:
            files = self.spark.read.parquet(f"{self.path.rstrip('/')}/state").inputFiles()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return 0
        return max((int(n) for f in files for n in re.findall(r"/state/batch=(\d+)/", f)), default=0)

    def _rows(self, n: int) -> DataFrame:
        """What the first ``n`` appends wrote, with ``batch``."""
        fields = [f for f in self.spark.read.parquet(self._folder("state", n)).schema if f.name not in _MARKS]
        schema = T.StructType(fields).add("batch", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path.rstrip('/')}/rows").where(F.col("batch") <= n)

    def read(self) -> DataFrame:
        """All rows, with ``idents`` and the providers' outputs. Those of the last ``ahead`` rows are computed here."""
        n = self.last_batch()
        if not n:
            raise ValueError(f"nothing was appended to {self.path} yet")
        final = self._rows(n).where(F.col("_part") < 2).select(*self._outputs())
        if not self._reach()[0]:
            return final
        still = self._computed(self._inputs(n)).where(F.col("_left") < self._reach()[0])
        return final.unionByName(still.select(*self._outputs()))

    def _outputs(self) -> list[str]:
        return list(dict.fromkeys([*self.idents, *[o for p in self.providers for o in p.outputs]]))

    def _reach(self) -> tuple[int, int]:
        """Rows ahead, and rows of a series that the next append needs: one at least, with its running totals and place."""
        rows = reach(self.providers)
        return rows["ahead"], max(rows["back"] + rows["ahead"], 1)

    def _sums(self) -> dict[str, Column]:
        return {name: c for p in self.providers for name, c in getattr(p, "running", {}).items()}

    def _max_rows(self, rows: DataFrame) -> int | None:
        bounded = isinstance(rows.schema[self.order].dataType, T.DateType) and self.max_rows == MAX_GROUP_ROWS
        return None if bounded else self.max_rows

    def state(self) -> DataFrame:
        """Input rows that the next append needs: ``back + ahead`` per series at most (one, if that is none)."""
        kept = self._inputs(self.last_batch())
        return self._placed(kept, self._max_rows(kept)).where(F.col("_left") < self._reach()[1]).select(*kept.columns)

    def _mark(self, n: int) -> tuple[int, int, int]:
        """The append where the stored inputs begin, how many it wrote, and how many were added since."""
        return tuple(self.spark.read.parquet(self._folder("state", n)).select(*_MARKS).first())

    def _inputs(self, n: int) -> DataFrame:
        """Stored inputs: those that the next append needs, and some before them."""
        kept = self._rows(n).where((F.col("batch") >= self._mark(n)[0]) & (F.col("_part") > 0))
        names = {c: c[len("_in_") :] for c in kept.columns if c.startswith("_in_")}
        extra = ["_first", *[f"_sum_{s}" for s in self._sums()]]
        return kept.select(*[F.col(c).alias(name) for c, name in names.items()], *extra, F.lit(True).alias("_old"))

    def _computed(self, both: DataFrame) -> DataFrame:
        """Metrics of input rows as ``_inputs`` gives them, with their places in their series."""
        sums, max_rows = self._sums(), self._max_rows(both)

        # A running total starts from what it came to at the first row kept.
        def start(name: str):
            return F.when(F.col("_first"), F.col(f"_sum_{name}")).otherwise(sums[name].cast(both.schema[f"_sum_{name}"].dataType))

        given = FeatureGroup(back=0, ahead=0, running={s: start(s) for s in sums})
        bare = [_Bare(p) for p in self.providers]
        full = staged_metrics(both, [given, *bare], by=self.by, order=[self.order], max_rows=max_rows)
        return self._placed(full, max_rows)

    def append(self, rows: DataFrame) -> None:
        """Add input rows later than all that their series hold; earlier ones are an error.

        ``rows`` has one row per series and order value, and the same columns at every append. A series may be new. Rows
        without an order value are left out. An append without rows changes nothing but its number. With a DATE as order
        the calendar bounds a series, whose size is then not checked unless ``max_rows`` is set; otherwise ``rows`` is
        evaluated more than once, so it must give the same rows each time.
        """
        by, n, sums = list(self.by), self.last_batch(), self._sums()
        ahead, reached = self._reach()
        since, kept, added = self._mark(n) if n else (1, 0, 0)
        new = rows.where(F.col(self.order).isNotNull())
        inputs = list(new.columns)
        types = new.select(*[F.sum(c).alias(s) for s, c in sums.items()]).schema if sums else {}
        blank = {f"_sum_{s}": F.lit(None).cast(types[s].dataType) for s in sums}
        both = new.withColumns({"_first": F.lit(False), "_old": F.lit(False)} | blank)
        if n:  # dealt alike, so that windows over both need no exchange of them
            both = both.repartition(*by).unionByName(self._inputs(n).repartition(*by))
        placed = self._computed(both)
        left, old = F.col("_left"), F.col("_old")
        anew = added >= kept  # as at the first append
        first = F.lit(anew) & (left == F.least(F.col("_rows"), F.lit(reached)) - 1)
        needed = left < reached if anew else ~old
        due = (left >= ahead) & (~old | (F.col("_olds") - F.col("_at") < ahead))
        late = ~old & (F.col(self.order) <= F.col("_to"))
        out = placed.where(needed | due).select(
            *[F.when(due, F.col(c)).alias(c) for c in self._outputs()],
            *[F.when(needed | late, F.col(c)).alias(f"_in_{c}") for c in inputs],
            first.alias("_first"),
            *[F.when(first, F.col(s)).cast(types[s].dataType).alias(f"_sum_{s}") for s in sums],
            late.alias("_late"),
            F.when(~due, 2).when(needed, 1).otherwise(0).alias("_part"),
        )
        out.write.mode("overwrite").option("compression", "zstd").parquet(self._folder("rows", n + 1))
        wrote = self.spark.read.schema(out.schema).parquet(self._folder("rows", n + 1))
        early = wrote.where("_late").select(*[F.col(f"_in_{c}").alias(c) for c in (*by, self.order)]).limit(3).collect()
        if early:
            raise ValueError(f"rows that are not later than those stored: {[r.asDict() for r in early]}")
        count = wrote.where("_part > 0").count()
        marks = (n + 1, count, 0) if anew else (since, kept, added + count)
        mark = self.spark.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema], *[F.lit(v).cast("long").alias(c) for c, v in zip(_MARKS, marks)]
        )
        mark.coalesce(1).write.mode("overwrite").parquet(self._folder("state", n + 1))

    def _placed(self, full: DataFrame, max_rows: int | None) -> DataFrame:
        """``full`` with ``_rows`` of its series, how many of them are old and where those end (``_olds``, ``_to``), and how
        many are behind each row (``_left``)."""
        by = list(self.by)
        size = {
            "_rows": F.count(F.lit(1)),
            "_olds": F.count(F.when(F.col("_old"), 1)),
            "_to": F.max(F.when(F.col("_old"), F.col(self.order))),
        }
        if max_rows is None:  # the window the metrics were computed in, sorted as it is
            series = Window.partitionBy(*by)
            at = F.row_number().over(series.orderBy(self.order)).cast("long")
            placed = full.withColumns({"_at": at} | {name: c.over(series) for name, c in size.items()})
        else:
            place = row_position(full, by, [self.order], "_at", max_rows=max_rows)
            placed = join_nullsafe(place, full.groupBy(*by).agg(*[c.alias(name) for name, c in size.items()]), by)
        return placed.withColumn("_left", F.col("_rows") - F.col("_at"))


class _Bare:
    """A provider without its running totals, which ``append`` declares anew."""

    def __init__(self, p: MetricProvider):
        self.inputs, self.outputs, self.stages, self.back, self.ahead = p.inputs, p.outputs, p.stages, p.back, p.ahead
        self.running: dict = {}
