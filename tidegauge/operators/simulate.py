"""Seeded simulation of states and forecasts, a task for each group of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .estimate import _rng


def simulated_states(df: DataFrame, a0, p0, sigma_h, sigma_q, *, draws: int = 100, seed: int = 0) -> DataFrame:
    """Quantiles over draws of the states given the observations: series_id, t, state, q05, q50, q95."""
    kinds = pa.schema([("series_id", pa.string()), ("t", pa.int64()), ("state", pa.int32()), ("q05", pa.float64()), ("q50", pa.float64()), ("q95", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        pdf = rows.to_pandas().sort_values("t")
        series = pdf["series_id"].iloc[0]
        got = kernels.simulation_smoother(pdf["y"].to_numpy(float), np.stack(pdf["z"].to_numpy()), a0, p0, sigma_h, sigma_q, _rng(seed, series), draws)
        q = np.quantile(got, [0.05, 0.5, 0.95], axis=0)
        steps, n = got.shape[1:]
        out = {"series_id": [series] * (steps * n), "t": np.repeat(pdf["t"].to_numpy(), n), "state": np.tile(np.arange(n), steps), **{c: q[i].ravel() for i, c in enumerate(("q05", "q50", "q95"))}}
        return pa.Table.from_pandas(pd.DataFrame(out), schema=kinds, preserve_index=False)

    return df.select("series_id", F.col("t").cast("long").alias("t"), "y", "z").groupBy("series_id").applyInArrow(run, "series_id string, t long, state int, q05 double, q50 double, q95 double")


def simulated_forecasts(filtered: DataFrame, sigma_h: float, sigma_q, *, horizon: int, draws: int = 100, seed: int = 0) -> DataFrame:
    """Random-walk forecasts from each series' last state, with the first state as the level."""
    last = filtered.groupBy("series_id").agg(F.max_by("a", "t").alias("a"))
    kinds = pa.schema([("series_id", pa.string()), ("sample", pa.int32()), ("h", pa.int32()), ("forecast", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        series, a = rows.column(0)[0].as_py(), rows.column(1)[0].as_py()
        z = np.zeros((horizon, len(a)))
        z[:, 0] = 1.0
        got = kernels.simulate_forecast(a, z, sigma_h, sigma_q, _rng(seed, series), draws)
        return pa.table([pa.array([series] * (draws * horizon)), pa.array(np.repeat(np.arange(draws), horizon), pa.int32()), pa.array(np.tile(np.arange(horizon), draws), pa.int32()), pa.array(got.ravel())], schema=kinds)

    return last.groupBy("series_id").applyInArrow(run, "series_id string, sample int, h int, forecast double")
