"""Exact quartiles with linear interpolation, at any number of rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tablewright.functions.columns import finite_double
from tablewright.operators.selection import DIRECT_ROWS, Extent, interpolate, order_statistics

QUARTILES = (0.25, 0.5, 0.75)


def quantiles(
    df: DataFrame,
    statistics: list[dict],
    probabilities: tuple[float, ...] = QUARTILES,
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float | None]]:
    """Quantiles of the numeric columns described by `statistics`.

    Infinities and NaN take part in the ranking (NaN last); a quantile that falls on one is null.
    """
    positions = {
        s["field"].name: [p * (s["filled"] - 1) for p in probabilities]
        for s in statistics
        if s["filled"]
    }
    values, extents, ranks, offsets = {}, {}, {}, {}
    for s in statistics:
        name = s["field"].name
        if not s["finite"]:
            continue
        offsets[name] = s["below_finite"]
        wanted = {
            edge + 1 - offsets[name]
            for position in positions[name]
            for edge in (math.floor(position), math.ceil(position))
        }
        values[name] = finite_double(s["field"])
        extents[name] = Extent(s["low"], s["high"], s["finite"])
        ranks[name] = {rank for rank in wanted if 1 <= rank <= s["finite"]}

    found = order_statistics(df, values, extents, ranks, direct_rows)

    def at(name: str, position: float) -> float | None:
        low, high = math.floor(position), math.ceil(position)
        edges = [found.get((name, edge + 1 - offsets.get(name, 0))) for edge in (low, high)]
        if None in edges:
            return None
        return interpolate(position - low, edges[0].value, edges[1].value)

    return {
        s["field"].name: [at(s["field"].name, p) for p in positions.get(s["field"].name, [])]
        or [None] * len(probabilities)
        for s in statistics
    }
