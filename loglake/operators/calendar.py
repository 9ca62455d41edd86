"""Rows in time order, and totals over them, without bringing all of them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Functions for totals, and what adds up their values per stretch.
_ADDED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def beside(
    rows: DataFrame, at: str, width: int, after: bool = False, totals: dict[str, tuple[str, str]] | None = None, **wanted: str
) -> DataFrame:
    """``rows`` with columns of the row before (or after) in the order of ``at``: ``wanted`` maps new names to columns.

    ``totals`` maps further names to a function (``sum``, ``count``, ``min`` or ``max``) of a column over all rows.

    Rows fall into stretches of ``width`` along ``at``, each ordered on its own; what lies beyond a stretch's edge is the
    last (or first) row of the next stretch that has any. That, and the totals, are found over one row per stretch: what a
    task orders is bounded by the calendar, not by rows.
    """
    totals = totals or {}
    placed = rows.withColumn("_stretch", F.floor(F.col(at) / width))
    over_all = Window.partitionBy(F.lit(0))
    summed = [getattr(F, function)(column).alias(name) for name, (function, column) in totals.items()]
    added = [_ADDED[function](name).over(over_all).alias(name) for name, (function, _) in totals.items()]
    if not wanted:
        stretches = placed.groupBy("_stretch").agg(*summed).select("_stretch", *added)
        return placed.join(stretches, "_stretch").select(*rows.columns, *totals)
    taken = F.struct(*[F.col(column).alias(name) for name, column in wanted.items()])
    step, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    inner = placed.withColumn("_inner", step(taken).over(Window.partitionBy("_stretch").orderBy(at)))
    stretches = placed.groupBy("_stretch").agg(edge(taken, F.col(at)).alias("_edge"), *summed)
    next_edge = step("_edge").over(Window.orderBy("_stretch")).alias("_edge")
    joined = inner.join(stretches.select("_stretch", next_edge, *added), "_stretch")
    found = [F.coalesce("_inner", "_edge")[name].alias(name) for name in wanted]
    return joined.select(*rows.columns, *found, *totals)
