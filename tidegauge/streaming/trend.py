"""The damped local trend as a stateful stream: a series' state is two numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernels import dlt_step

SCHEMA = "series_id string, t long, y double, level double, slope double, component double"


def streamed_components(stream: DataFrame, lev_sm: float, slp_sm: float, theta: float) -> DataFrame:
    """series_id, t, y, level, slope and component of the rows (series_id, t, y) of a stream.

    The rows of a micro-batch are taken in order of t; a row whose t is not after the last one seen of
    its series is late and left out. Null y takes the forecast; a series begins with its first y that
    is not null. With batches in order the result is that of the batch recursion."""
    import numpy as np

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("t")
        level, slope, last = state.get if state.exists else (0.0, 0.0, None)
        out = []
        for t, y in zip(rows["t"].tolist(), rows["y"].tolist(), strict=True):
            y = float("nan") if y is None else float(y)
            if last is None:
                if np.isnan(y):
                    continue
                level, c = y, y
                new, slp, c = dlt_step(np.float64(level), np.float64(0.0), np.float64(y), lev_sm, slp_sm, theta)
            elif t <= last:
                continue
            else:
                new, slp, c = dlt_step(np.float64(level), np.float64(slope), np.float64(y), lev_sm, slp_sm, theta)
            level, slope, last = float(new), float(slp), int(t)
            out.append((key[0], t, y, level, slope, float(c)))
        if last is not None:
            state.update((level, slope, last))
        yield pd.DataFrame(out, columns=["series_id", "t", "y", "level", "slope", "component"]).astype({"t": "int64"})

    rows = stream.selectExpr("cast(series_id as string) as series_id", "cast(t as long) as t", "cast(y as double) as y")
    return rows.groupBy("series_id").applyInPandasWithState(fold, SCHEMA, "level double, slope double, last long", "append", GroupStateTimeout.NoTimeout)
