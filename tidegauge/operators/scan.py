"""Recursions over the series of a panel: one shuffle by series, then a fold over the sorted partition.

A partition is sorted by series and time and read as a stream. Whole series are folded together as
soon as FOLD_ROWS rows of them have come, so the time loop runs once for many series and a worker
holds about that many rows, whatever the partition's size; a longer series is folded alone. Columns
go between Arrow and NumPy without Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Rows of whole series that are folded at a time.
FOLD_ROWS = 200_000


def _cut(table: pa.Table, key: str) -> int:
    """The first row of the last series of a table that is sorted by series."""
    ids = table.column(key)
    last = ids[-1].as_py()
    same = pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False)
    return pc.index(same, True).as_py()


def whole_series(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole series, of about ``rows`` rows, from the batches of a sorted partition."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            if at := _cut(table, key):
                yield table.slice(0, at)
                table = table.slice(at)
            held, n = table.combine_chunks().to_batches(), table.num_rows
            if not at:
                rows = max(rows, 2 * n)  # one long series: don't look again at every batch
    if n:
        yield pa.Table.from_batches(held)


def by_length(table: pa.Table, key: str) -> Iterator[np.ndarray]:
    """Row numbers (B, T) of the series of each length, which are folded together without padding."""
    coded = pc.dictionary_encode(table.column(key).combine_chunks(), null_encoding="encode")
    code = np.asarray(coded.indices)
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(code)))
    for n in np.unique(sizes).tolist():
        yield starts[sizes == n][:, None] + np.arange(n)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return table.column(name).cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)


def vectors(table: pa.Table, name: str, n: int, missing: float = np.nan) -> np.ndarray:
    """A column of arrays of n doubles as a matrix; null arrays and entries count as ``missing``."""
    column = table.column(name).combine_chunks()
    out = np.full((len(column), n), missing)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    if ((sizes != n) & (sizes != 0)).any() or ((sizes == 0) & np.asarray(pc.is_valid(column))).any():
        raise ValueError(f"{name} needs {n} entries")
    flat = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), missing)
    out[sizes == n] = np.asarray(flat).reshape(-1, n)
    return out


def lists(x: np.ndarray | None, rows: int) -> pa.Array:
    """A matrix as a column of arrays of doubles; nulls without one."""
    if x is None:
        return pa.nulls(rows, pa.list_(pa.float64()))
    n = x.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * n + 1, n) if n else np.zeros(rows + 1, np.int64), pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def folded(df: DataFrame, fold: Callable[[pa.Table], Iterator[pa.Table]], schema: str, key: str = "series_id", rows: int = FOLD_ROWS, heavy: bool = False) -> DataFrame:
    """``fold`` over the whole series of df (key, t and others), which comes sorted by key and t.

    ``heavy`` work for each row is dealt to as many tasks as there are shuffle partitions, even where the
    rows are few and adaptive execution would put them into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_series(batches, key, rows):
            for out in fold(table):
                yield from out.to_batches(max_chunksize=10_000)

    parts = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if heavy else []
    return df.repartition(*parts, key).sortWithinPartitions(key, "t").mapInArrow(run, schema)


def _panel(df: DataFrame, *columns: str, key: str = "series_id") -> DataFrame:
    return df.select(F.col(key).cast("string").alias(key), F.col("t").cast("long").alias("t"), *columns)


def dlt_components(df: DataFrame, lev_sm: float, slp_sm: float, theta: float, rows: int = FOLD_ROWS) -> DataFrame:
    """series_id, t, y, level, slope and component of the damped local trend of each series.

    df has series_id, t and y; null y is missing and replaced by the forecast, except as the first of
    a series, which is an error; infinite y leaves the state as it is."""

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        y = numbers(table, "y")
        for at in by_length(table, "series_id"):
            parts = kernels.dlt_scan(y[at], lev_sm, slp_sm, theta)
            own = table.take(pa.array(at.ravel()))
            yield pa.table([own.column("series_id"), own.column("t"), own.column("y"), *(pa.array(x.ravel()) for x in parts)], ["series_id", "t", "y", "level", "slope", "component"])

    return folded(_panel(df, F.col("y").cast("double").alias("y")), fold, "series_id string, t long, y double, level double, slope double, component double", rows=rows)


_FILTER_SCHEMA = "series_id string, t long, a array<double>, p array<double>, k array<double>, v double, f double, log_p double, a_smooth array<double>, p_smooth array<double>"


def filtered(df: DataFrame, a0: list[float], p0: list[float], sigma_h, sigma_q, *, positivity: list[bool] | None = None, exponent: float | None = None, smoother: str | None = None, skip_missing: bool = False, rows: int = FOLD_ROWS) -> DataFrame:
    """Filter output of each series, with a smoother's means (and variances) if one is named.

    df has series_id, t, y and the array z; optional arrays a_obs and p_obs disclose states (a null
    array discloses nothing), and columns sigma_h and sigma_q (array) override the arguments.
    smoother: None, "dk" or "rts". ``log_p`` is the running log-likelihood. Everything but y, z,
    disclosures and noise is shared by all series. Missing y are an error unless ``skip_missing``."""
    if smoother not in (None, "dk", "rts"):
        raise ValueError(f"no smoother {smoother!r}")
    extra = [c for c in ("a_obs", "p_obs", "sigma_h", "sigma_q") if c in df.columns]
    if ("a_obs" in extra) != ("p_obs" in extra):
        raise ValueError("a_obs and p_obs come together")
    n = len(a0)

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        y, z = numbers(table, "y"), vectors(table, "z", n)
        told = {c: vectors(table, c, n, nothing) for c, nothing in (("a_obs", 0.0), ("p_obs", np.inf)) if c in extra}
        own_h = numbers(table, "sigma_h") if "sigma_h" in extra else None
        own_q = vectors(table, "sigma_q", n) if "sigma_q" in extra else None
        for at in by_length(table, "series_id"):
            h = sigma_h if own_h is None else own_h[at[:, 0]]
            q = sigma_q if own_q is None else own_q[at[:, 0]]
            own = {c: x[at] for c, x in told.items()}
            res = kernels.kalman_filter(y[at], z[at], a0, p0, h, q, positivity=positivity, exponent=exponent, skip_missing=skip_missing, **own)
            a_s = p_s = None
            if smoother == "dk":
                a_s = kernels.dk_smoother(res, z[at], a0, p0, sigma_q=q, exponent=exponent, positivity=positivity, **own)
            elif smoother == "rts":
                a_s, p_s = kernels.rts_smoother(res, q, ekf=exponent is not None)
            terms = np.where(np.isnan(res["v"]), 0.0, -0.5 * (kernels.LOG_2PI + np.log(res["f"]) + res["v"] ** 2 / res["f"]))
            same, size = table.take(pa.array(at.ravel())), at.size
            flat = lambda x, size=size: lists(None if x is None else x.reshape(size, -1), size)
            yield pa.table([same.column("series_id"), same.column("t"), flat(res["a"]), flat(res["p"]), flat(res["k"]), *(pa.array(x.ravel()) for x in (res["v"], res["f"], terms.cumsum(1))), flat(a_s), flat(p_s)], [f.split()[0] for f in _FILTER_SCHEMA.split(", ")])

    return folded(_panel(df, F.col("y").cast("double").alias("y"), F.col("z").cast("array<double>").alias("z"), *extra), fold, _FILTER_SCHEMA, rows=rows)


_ST_SCHEMA = "panel_id string, t long, a array<double>, p array<double>, v array<double>, log_p double, a_smooth array<double>"


def filtered_st(df: DataFrame, a0: list[float], p0: list[list[float]], sigma_h, sigma_q, *, positivity: list[bool] | None = None, exponent: float | None = None, smooth_diagonal: bool = False) -> DataFrame:
    """Filter output of panels whose series share states: df has panel_id, t, y (array over series)
    and z (array of arrays), and may have a_obs and p_obs (arrays over states).

    A panel is folded as one, step by step; panels run side by side. ``smooth_diagonal`` overlays the
    diagonal smoother. ``log_p`` is the whole panel's."""
    n = len(a0)
    extra = [c for c in ("a_obs", "p_obs") if c in df.columns]
    if len(extra) == 1:
        raise ValueError("a_obs and p_obs come together")

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        for group in by_length(table, "panel_id"):
            for at in group:
                own = table.slice(int(at[0]), len(at))
                m = len(own.column("y")[0])
                z = np.asarray(pc.list_flatten(pc.list_flatten(own.column("z").combine_chunks())).cast(pa.float64())).reshape(len(at), m, n)
                told = {c: vectors(own, c, n, nothing) for c, nothing in (("a_obs", 0.0), ("p_obs", np.inf)) if c in extra}
                res = kernels.kalman_filter_st(vectors(own, "y", m), z, a0, p0, sigma_h, sigma_q, positivity=positivity, exponent=exponent, **told)
                smooth = kernels.rts_smoother({"a": res["a"][None], "p": np.einsum("tii->ti", res["p"])[None]}, sigma_q, ekf=exponent is not None)[0][0] if smooth_diagonal else None
                size = len(at)
                yield pa.table([own.column("panel_id"), own.column("t"), lists(res["a"], size), lists(res["p"].reshape(size, -1), size), lists(res["v"], size), pa.array(np.full(size, res["log_p"])), lists(smooth, size)], [f.split()[0] for f in _ST_SCHEMA.split(", ")])

    return folded(_panel(df, "y", "z", *extra, key="panel_id"), fold, _ST_SCHEMA, key="panel_id")


def smoothed_draws(df: DataFrame, draws: DataFrame, a0: list[float], p0: list[float], *, exponent: float | None = None, positivity: list[bool] | None = None) -> DataFrame:
    """series_id, chain, draw, t, a_smooth and ``mu``, the fitted mean, of each posterior draw.

    df has series_id, t, y and z; draws has series_id, chain, draw, sigma_h and sigma_q (array). History
    and draws meet by series, each shuffled once; a series is filtered and smoothed under all of its
    draws at once. Masked states of an extended filter enter the mean as exp(exponent * a)."""
    n = len(a0)
    history = _panel(df, F.col("y").cast("double").alias("y"), F.col("z").cast("array<double>").alias("z"))
    own = draws.select(F.col("series_id").cast("string").alias("series_id"), F.col("chain").cast("int").alias("chain"), F.col("draw").cast("int").alias("draw"), F.col("sigma_h").cast("double").alias("sigma_h"), F.col("sigma_q").cast("array<double>").alias("sigma_q"))
    mask = np.ones(n, bool) if positivity is None else np.asarray(positivity, bool)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, draws: pa.Table) -> pa.Table:
        rows = rows.sort_by("t")
        m, steps = draws.num_rows, rows.num_rows
        z, q = vectors(rows, "z", n), vectors(draws, "sigma_q", n)
        a = np.zeros((m, steps, n))
        if m and steps:
            res = kernels.kalman_filter(np.broadcast_to(numbers(rows, "y"), (m, steps)), z, a0, p0, numbers(draws, "sigma_h"), q, positivity=positivity, exponent=exponent)
            a = kernels.rts_smoother(res, q, ekf=exponent is not None)[0]
        state = a if exponent is None else np.where(mask, np.exp(np.clip(exponent * a, -10, 10)), a)
        spread = lambda c: draws.column(c).take(pa.array(np.repeat(np.arange(m), steps)))
        return pa.table([pa.array([key[0].as_py()] * (m * steps), pa.string()), spread("chain"), spread("draw"), pa.array(np.tile(np.asarray(rows.column("t")), m), pa.int64()), lists(a.reshape(m * steps, n), m * steps), pa.array((state * z).sum(2).ravel())], ["series_id", "chain", "draw", "t", "a_smooth", "mu"])

    return history.groupBy("series_id").cogroup(own.groupBy("series_id")).applyInArrow(run, "series_id string, chain int, draw int, t long, a_smooth array<double>, mu double")


def final_states(df: DataFrame, lev_sm: float, slp_sm: float, theta: float) -> DataFrame:
    """Last level and slope of short series, as a fold inside Catalyst: no Python, one row a series.

    A series is gathered in one row, so ``dlt_components`` is the way for long ones."""
    packed = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("h"))
    start = F.struct(F.col("h")[0]["y"].cast("double").alias("level"), F.lit(0.0).alias("slope"))

    def step(s, x):
        c = s["level"] + theta * s["slope"]
        seen = F.when(x["y"].isNull() | F.isnan(x["y"]), c).otherwise(x["y"])
        level = lev_sm * seen + (1 - lev_sm) * c
        return F.struct(level.alias("level"), (slp_sm * (level - s["level"]) + (1 - slp_sm) * s["slope"]).alias("slope"))

    return packed.select("series_id", F.aggregate("h", start, step).alias("s")).select("series_id", "s.level", "s.slope")
