"""Estimation: Gibbs for the damped trend, MAP by Adam and adaptive MCMC for filters, WBIC tuning.

For given smoothing and missing steps the damped trend is linear in its data, so with regressors X
the residual is (I - L)y - (I - L)X beta. One pass over the data runs the trend over y and over each
regressor (``basis``); Gram sums of what is left, and the last states, are a small row a series.
Chains, draws, tuning and forecasts work on those rows and never see the data again.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .scan import FOLD_ROWS, by_length, folded, lists, numbers


def _rng(seed: int, *parts) -> np.random.Generator:
    """A generator that depends on the seed and the names, not on partitions."""
    return np.random.Generator(np.random.Philox(key=[seed, zlib.crc32("|".join(map(str, parts)).encode())]))


def _truncated(rng, mean: float, sd: float, sign: str) -> float:
    """A normal draw held to one side of 0 where the sign says so."""
    if sign == "=":
        return float(rng.normal(mean, sd))
    flip = -1.0 if sign == "-" else 1.0
    low = -flip * mean / sd
    if low < 4:
        while True:
            z = rng.normal(size=64)
            if (z := z[z >= low]).size:
                return flip * (flip * mean + sd * float(z[0]))
    rate = (low + math.sqrt(low * low + 4)) / 2  # exponential proposals far in the tail
    while True:
        z = low + rng.exponential(1 / rate)
        if rng.random() <= math.exp(-((z - rate) ** 2) / 2):
            return flip * (flip * mean + sd * z)


def gibbs(xx, xy, yy, n, signs, loc, scale, rng, warmup: int, draws: int, sigma_scale: float = 5.0):
    """Draws of coefficients and noise: truncated normals one by one, then sigma by slice sampling."""
    k = len(xy)
    beta = np.array([abs(m) if s == "+" else -abs(m) if s == "-" else m for m, s in zip(loc, signs, strict=True)], float)
    sigma, out_b, out_s = max(math.sqrt(yy / max(n, 1)), 1e-6), np.empty((draws, k)), np.empty(draws)
    for it in range(warmup + draws):
        for j in range(k):
            precision = xx[j, j] / sigma**2 + 1 / scale[j] ** 2
            mean = ((xy[j] - xx[j] @ beta + xx[j, j] * beta[j]) / sigma**2 + loc[j] / scale[j] ** 2) / precision
            beta[j] = _truncated(rng, mean, precision**-0.5, signs[j])
        rss = max(yy - 2 * beta @ xy + beta @ xx @ beta, 1e-12)
        log_density = lambda u, rss=rss: -(n - 1) * u - rss / 2 * math.exp(-2 * u) - math.exp(2 * u) / (2 * sigma_scale**2)  # noqa: E731  of log sigma, half-normal prior
        u = math.log(sigma)
        level, low = log_density(u) - rng.exponential(), u - rng.random()
        high = low + 1.0
        while log_density(low) > level:
            low -= 1.0
        while log_density(high) > level:
            high += 1.0
        while True:
            new = low + rng.random() * (high - low)
            if log_density(new) > level:
                break
            low, high = (new, high) if new < u else (low, new)
        sigma = math.exp(new)
        if it >= warmup:
            out_b[it - warmup], out_s[it - warmup] = beta, sigma
    return out_b, out_s


# ------------------------------------------------------------------ the damped trend

BASIS_SCHEMA = "series_id string, t long, y double, x array<double>, c array<double>, level array<double>, slope array<double>"


def basis(df: DataFrame, lev_sm: float, slp_sm: float, theta: float, regressors: list[str] | None = None, rows: int = FOLD_ROWS) -> DataFrame:
    """The trend over y and over each regressor: component, level and slope arrays, y's first.

    df has series_id, t, y and the regressors. Where y is missing the regressors count as missing
    too; a regressor that is missing elsewhere, and a first y that is missing, are errors."""
    names = list(regressors or [])

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        y = numbers(table, "y")
        x = np.column_stack([numbers(table, n) for n in names]) if names else np.zeros((len(y), 0))
        if np.isnan(x[~np.isnan(y)]).any():
            raise ValueError("a regressor is missing where y is not")
        both = np.column_stack([y, np.where(np.isnan(y)[:, None], np.nan, x)])
        for at in by_length(table, "series_id"):
            b, steps = at.shape
            data = both[at].transpose(0, 2, 1).reshape(-1, steps)
            level, slope, c = (v.reshape(b, -1, steps).transpose(0, 2, 1).reshape(b * steps, -1) for v in kernels.dlt_scan(data, lev_sm, slp_sm, theta))
            own = table.take(pa.array(at.ravel()))
            yield pa.table([own.column("series_id"), own.column("t"), own.column("y"), lists(x[at.ravel()], at.size), lists(c, at.size), lists(level, at.size), lists(slope, at.size)], [f.split()[0] for f in BASIS_SCHEMA.split(", ")])

    chosen = df.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("y").cast("double").alias("y"), *(F.col(n).cast("double").alias(n) for n in names))
    return folded(chosen, fold, BASIS_SCHEMA, rows=rows)


def gram(found: DataFrame, k: int) -> DataFrame:
    """Of each series: the Gram sums g of (y, x1..xk) less their trends in row order of the upper
    triangle, the count n of seen steps, the steps, and the last levels and slopes."""
    seen = F.abs("y") < float("inf")  # neither null nor NaN nor infinite
    e = [F.col("y") - F.col("c")[0], *(F.col("x")[i] - F.col("c")[i + 1] for i in range(k))]
    cells = [F.coalesce(F.sum(F.when(seen, e[i] * e[j])), F.lit(0.0)) for i in range(k + 1) for j in range(i, k + 1)]
    last = F.max_by(F.struct("level", "slope"), "t")
    out = found.groupBy("series_id").agg(F.array(*cells).alias("g"), F.count_if(seen).alias("n"), F.count("*").alias("steps"), last.alias("last"))
    return out.select("series_id", "g", "n", "steps", F.col("last.level").alias("level"), F.col("last.slope").alias("slope"))


def _unpacked(g: list[float], k: int) -> tuple[np.ndarray, np.ndarray, float]:
    full = np.zeros((k + 1, k + 1))
    full[np.triu_indices(k + 1)] = g
    full = np.triu(full) + np.triu(full, 1).T
    return full[1:, 1:], full[0, 1:], float(full[0, 0])


FIT_SCHEMA = "series_id string, chain int, draw int, sigma double, last_level double, last_slope double, coef array<double>, regressors array<string>, steps long"


def _prior(df: DataFrame, regressors: list[str] | None, scheme) -> tuple[list[str], list[list]]:
    names = sorted(regressors if regressors is not None else scheme or [])
    scheme = scheme or {n: ("=", 0.0, 1.0) for n in names}
    if missing := sorted((set(scheme) | set(names)) - set(df.columns)):
        raise ValueError(f"no covariates {missing}")
    if unknown := sorted(set(names) - set(scheme)):
        raise ValueError(f"the scheme lacks {unknown}")
    return names, [[scheme[n][i] for n in names] for i in range(3)]


def sample_dlt(sums: DataFrame, names: list[str], prior: list[list], *, warmup: int, draws: int, chains: int, seed: int, sigma_scale: float = 5.0) -> DataFrame:
    """Posterior draws from the rows of ``gram``, a row for each series and chain dealt anew."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b, s = gibbs(*_unpacked(r["g"], k), r["n"], *prior, _rng(seed, r["series_id"], r["chain"]), warmup, draws, sigma_scale)
                level, slope = np.array(r["level"]), np.array(r["slope"])
                columns = [pa.array([r["series_id"]] * draws, pa.string()), pa.array(np.full(draws, r["chain"]), pa.int32()), pa.array(np.arange(draws), pa.int32()), pa.array(s), pa.array(level[0] - b @ level[1:]), pa.array(slope[0] - b @ slope[1:]), lists(b, draws), pa.array([names] * draws, pa.list_(pa.string())), pa.array(np.full(draws, r["steps"]), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FIT_SCHEMA.split(", ")])

    each = sums.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    return each.repartition("series_id", "chain").mapInArrow(run, FIT_SCHEMA)


def fit_dlt(df: DataFrame, lev_sm: float, slp_sm: float, theta: float, *, regressors: list[str] | None = None, scheme=None, warmup: int = 100, draws: int = 100, chains: int = 4, seed: int = 0, sigma_scale: float = 5.0) -> DataFrame:
    """Posterior draws of the damped trend with regressors.

    df has series_id, t, y and the regressors; ``scheme`` maps each to (sign, loc, scale). The noise
    has a half-normal prior of scale ``sigma_scale``. Names stay with their coefficients whatever
    their signs. A first y that is missing, and a scheme without the columns it names, are errors."""
    names, prior = _prior(df, regressors, scheme)
    return sample_dlt(gram(basis(df, lev_sm, slp_sm, theta, names), len(names)), names, prior, warmup=warmup, draws=draws, chains=chains, seed=seed, sigma_scale=sigma_scale)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)


def in_sample(fits: DataFrame, found: DataFrame) -> DataFrame:
    """series_id, chain, draw, t, component, reg (array), reg_total, yhat, y, resid and sigma of each draw
    over the fitted steps, by joining the draws with the rows of ``basis``."""
    joined = found.select("series_id", "t", "y", "x", "c").join(fits.select("series_id", "chain", "draw", "coef", "sigma"), "series_id")
    reg = F.zip_with("coef", "x", lambda b, x: b * x)
    total = F.aggregate(reg, F.lit(0.0), lambda a, b: a + b)
    component = F.col("c")[0] - _dot(F.col("coef"), F.slice("c", 2, 1 << 20))
    out = joined.withColumns({"component": component, "reg": reg}).withColumns({"reg_total": total, "yhat": F.col("component") + total})
    return out.select("series_id", "chain", "draw", "t", "component", "reg", "reg_total", "yhat", "y", (F.col("y") - F.col("yhat")).alias("resid"), "sigma")


def medians(fits: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series_id, regressor, coef_p50) and (series_id, t, component_p50, reg_p50, yhat_p50); the fitted
    median is the component's median plus the coefficients' medians times the regressors."""
    coefs = fits.select("series_id", F.explode(F.arrays_zip("regressors", "coef")).alias("r")).select("series_id", F.col("r.regressors").alias("regressor"), F.col("r.coef").alias("coef"))
    coefs = coefs.groupBy("series_id", "regressor").agg(F.percentile("coef", 0.5).alias("coef_p50"))
    trend = in_sample(fits, found).groupBy("series_id", "t").agg(F.percentile("component", 0.5).alias("component_p50"))
    ordered = coefs.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("regressor", "coef_p50"))), lambda r: r["coef_p50"]).alias("_b"))
    rows = trend.join(found.select("series_id", "t", "x"), ["series_id", "t"]).join(ordered, "series_id", "left")
    reg = F.coalesce(_dot(F.col("_b"), F.col("x")), F.lit(0.0))
    return coefs, rows.select("series_id", "t", "component_p50", reg.alias("reg_p50"), (F.col("component_p50") + reg).alias("yhat_p50"))


AHEAD_SCHEMA = "series_id string, chain int, draw int, t long, component double, sigma double, coef array<double>"


def components_ahead(fits: DataFrame, lev_sm: float, slp_sm: float, theta: float, end_step: int, *, noise: bool = True, observed: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Components of each draw from its fitted steps to ``end_step``: series_id, chain, draw, t (from
    0), component, and the draw's sigma and coef.

    Each step takes on its own forecast, with an observation error where ``noise`` is set, or the
    value that ``observed`` (series_id, t, y; less regression) has for it. Series and steps that
    ``observed`` lacks count as missing. The errors depend on seed, series, chain and draw alone."""
    rows = fits.select("series_id", "chain", "draw", "sigma", "last_level", "last_slope", "steps", "coef")
    if observed is not None:
        known = observed.filter("y is not null").groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("t").cast("long"), F.col("y").cast("double")))).alias("known"))
        rows = rows.join(known, "series_id", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("map<bigint,double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ids, chain, draw = (batch.column(i).to_pylist() for i in range(3))
            sigma, level, slope, steps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
            horizon = max(0, int((end_step - steps).max(initial=0)))
            eps = np.array([_rng(seed, "ahead", *k).standard_normal(horizon) for k in zip(ids, chain, draw, strict=True)]).reshape(n, horizon) * sigma[:, None] * noise
            y = np.full((n, horizon), np.nan)
            for i, told in enumerate(batch.column(8).to_pylist()):
                for t, v in told or ():
                    if 0 <= t - steps[i] < horizon:
                        y[i, t - int(steps[i])] = v
            c = kernels.dlt_scan(y, lev_sm, slp_sm, theta, level, slope, eps)[2]
            t = steps[:, None] + np.arange(horizon)
            row, step = np.nonzero(t < end_step)
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(3)), pa.array(t[row, step].astype(np.int64)), pa.array(c[row, step]), batch.column(3).take(own), batch.column(7).take(own)], [f.split()[0] for f in AHEAD_SCHEMA.split(", ")])

    return rows.mapInArrow(run, AHEAD_SCHEMA)


def make_inference(fits: DataFrame, found: DataFrame, lev_sm: float, slp_sm: float, theta: float, *, regressors: list[str] | None = None, end_step: int | None = None, future: DataFrame | None = None, noise_embed: bool = False, evolve: bool = True, observed: DataFrame | None = None, transform=None, seed: int = 0) -> DataFrame:
    """series_id, chain, draw, t, component, reg (array), eps and forecast over all steps to ``end_step``.

    ``found`` comes from ``basis`` and t counts from 0; fits are read several times and had better be a
    written table. With regressors, future (series_id, t, regressors in the order of the fit) goes on
    after the fitted steps and sets the end, which else is that of the data; without them ``end_step``
    is needed, and cuts the fitted steps where it is smaller. ``evolve`` has errors drive the trend
    ahead; ``noise_embed`` adds independent ones to the forecast, and ``transform`` maps the column of
    forecasts to another."""
    if not regressors and end_step is None:
        raise ValueError("end_step is needed where there are no covariates")
    keep = ["series_id", "chain", "draw", "t", "component", "reg", "sigma"]
    out = in_sample(fits, found).select(*keep)
    if regressors:
        end_step = None
        if future is not None:
            last = future.agg(F.max("t")).first()[0]
            x = future.select("series_id", F.col("t").cast("long").alias("t"), F.array(*(F.col(n).cast("double") for n in sorted(regressors))).alias("_x"))
            ahead = components_ahead(fits, lev_sm, slp_sm, theta, int(-1 if last is None else last) + 1, noise=evolve, observed=observed, seed=seed)
            out = out.unionByName(ahead.join(x, ["series_id", "t"]).withColumn("reg", F.zip_with("coef", "_x", lambda b, v: b * v)).select(*keep))
    else:
        ahead = components_ahead(fits, lev_sm, slp_sm, theta, end_step, noise=evolve, observed=observed, seed=seed)
        out = out.unionByName(ahead.withColumn("reg", F.array().cast("array<double>")).select(*keep)).filter(F.col("t") < end_step)
    out = out.withColumn("eps", F.col("sigma") * _normal(F.xxhash64(F.lit(seed), F.lit("eps"), "series_id", "chain", "draw", "t")))
    value = F.col("component") + F.aggregate("reg", F.lit(0.0), lambda a, b: a + b)
    if noise_embed:
        value = value + F.col("eps")
    return out.select("series_id", "chain", "draw", "t", "component", "reg", "eps", (transform(value) if transform else value).alias("forecast"))


def forecast_dlt(fits: DataFrame, slp_sm: float, theta: float, horizon: int, future: DataFrame | None = None, *, noise: bool = False, seed: int = 0, transform=None) -> DataFrame:
    """Draws ahead (series_id, chain, draw, t from 0, component, forecast) in closed form: without new
    observations or errors the level takes on its own forecast, and each step leaves
    1 - slp_sm * (1 - theta) of the slope.

    future has series_id, t (from 0) and the regressors. ``noise`` adds the observation error, and
    ``transform`` maps the column of forecasts to another."""
    steps = fits.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    left = 1 - slp_sm * (1 - theta)
    ahead = F.col("t") + 1 if left == 1.0 else (1 - F.pow(F.lit(left), F.col("t") + 1)) / F.lit(1 - left)
    out = steps.withColumn("component", F.col("last_level") + F.col("last_slope") * theta * ahead)
    reg = F.lit(0.0)
    if future is not None:
        names = sorted(c for c in future.columns if c not in ("series_id", "t"))
        x = future.select("series_id", F.col("t").cast("int").alias("t"), F.array(*(F.col(c).cast("double") for c in names)).alias("_x"))
        out = out.join(x, ["series_id", "t"])
        reg = _dot(F.col("coef"), F.col("_x"))
    eps = F.col("sigma") * _normal(F.xxhash64(F.lit(seed), "series_id", "chain", "draw", "t")) if noise else F.lit(0.0)
    value = F.col("component") + reg + eps
    return out.select("series_id", "chain", "draw", "t", "component", (transform(value) if transform else value).alias("forecast"))


def _normal(hashed: Column) -> Column:
    """A standard normal number from a hash (Box-Muller on two 26-bit halves)."""
    u = (hashed.bitwiseAND((1 << 26) - 1) + 0.5) / float(1 << 26)
    v = (F.shiftrightunsigned(hashed, 26).bitwiseAND((1 << 26) - 1) + 0.5) / float(1 << 26)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def noise_components(fits: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """Observation errors N(0, sigma) of each draw for a number of steps."""
    out = fits.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return out.select("series_id", "chain", "draw", "t", (F.col("sigma") * _normal(F.xxhash64(F.lit(seed), "series_id", "chain", "draw", "t"))).alias("eps"))


def contributions(fits: DataFrame, covariates: DataFrame) -> DataFrame:
    """series_id, chain, draw, t, regressor, value: each coefficient times its regressor.

    covariates is long: series_id, t, regressor, x. The draws of a series meet its covariates by
    regressor; nothing else is paired."""
    coefs = fits.select("series_id", "chain", "draw", F.explode(F.arrays_zip("regressors", "coef")).alias("r"))
    coefs = coefs.select("series_id", "chain", "draw", F.col("r.regressors").alias("regressor"), F.col("r.coef").alias("coef"))
    return covariates.join(coefs, ["series_id", "regressor"]).select("series_id", "chain", "draw", "t", "regressor", (F.col("coef") * F.col("x")).alias("value"))


# ------------------------------------------------------------------ tuning by WBIC

TUNE_SCHEMA = "series_id string, trial int, lev_sm double, slp_sm double, theta double, wbic double"
_BOUNDS = {"lev_sm": (1e-4, 0.1), "slp_sm": (1e-3, 0.1), "theta": (0.0, 1.0)}


def wbic(y: np.ndarray, component: np.ndarray, reg: np.ndarray, sigma: np.ndarray, horizon: int) -> float:
    """-log(windows * horizon) times the mean log-likelihood of spans that hold the component flat.

    component and reg are (draws, steps). Missing observations are left out of the means and counted
    among the observations."""
    n = len(y) - horizon + 1
    if n < 1:
        raise ValueError("the series is shorter than the horizon")
    windows = lambda v: np.lib.stride_tricks.sliding_window_view(v, horizon, axis=-1)
    each = []
    for c, g, s in zip(component, reg, sigma, strict=True):
        error = windows(y) - (c[:n, None] + windows(g))
        each.append(np.nanmean(-0.5 * kernels.LOG_2PI - np.log(s) - 0.5 * (error / s) ** 2))
    return float(-np.log(n * horizon) * np.nanmean(each))


def forecast_spans(fitted: DataFrame, horizon: int) -> DataFrame:
    """series_id, chain, draw, t, h, yhat, y and sigma: at each step the ``horizon`` steps from it on, with
    the component held flat and the regression of each step. fitted has series_id, chain, draw, t,
    component, reg_total, y and sigma (see ``in_sample``); a series has steps - horizon + 1 spans."""
    ahead = Window.partitionBy("series_id", "chain", "draw").orderBy("t").rowsBetween(0, horizon - 1)
    spans = fitted.withColumn("_s", F.collect_list(F.struct("reg_total", "y")).over(ahead)).filter(F.size("_s") == horizon)
    each = spans.select("series_id", "chain", "draw", "t", "component", "sigma", F.posexplode("_s").alias("h", "s"))
    return each.select("series_id", "chain", "draw", "t", "h", (F.col("component") + F.col("s.reg_total")).alias("yhat"), F.col("s.y").alias("y"), "sigma")


def span_log_likelihood(spans: DataFrame) -> DataFrame:
    """spans with ``log_likelihood``; null where the observation is missing."""
    z = (F.col("y") - F.col("yhat")) / F.col("sigma")
    return spans.withColumn("log_likelihood", -0.5 * kernels.LOG_2PI - F.log("sigma") - 0.5 * z * z)


def wbic_of_spans(spans: DataFrame) -> DataFrame:
    """series_id and WBIC of the spans with their log-likelihoods: -log(windows * horizon) times the mean
    over draws of each draw's mean, missing observations left out of the means alone."""
    finite = F.when(~F.isnan("log_likelihood"), F.col("log_likelihood"))
    each = spans.groupBy("series_id", "chain", "draw").agg(F.avg(finite).alias("m"), F.count("*").alias("n"))
    return each.groupBy("series_id").agg((-F.log(F.max("n").cast("double")) * F.avg("m")).alias("wbic"))


def log_joint(sums: DataFrame, points: DataFrame, names: list[str], prior: list[list], sigma_scale: float = 5.0) -> DataFrame:
    """Log density of data and parameters at given points (series_id, chain, draw, sigma, coef) from the
    rows of ``gram``: columns log_likelihood, log_prior and log_joint.

    Coefficients are normal, truncated to one side of 0 where the sign says so (outside it the prior is
    minus infinity), sigma is half-normal; normalising constants are included."""
    k = len(names)
    at = lambda i, j: i * (k + 1) - i * (i - 1) // 2 + j - i  # noqa: E731  place in the upper triangle
    g, b, s = F.col("g"), F.col("coef"), F.col("sigma")
    rss = g[at(0, 0)]
    for i in range(k):
        rss = rss - 2 * b[i] * g[at(0, i + 1)] + b[i] * b[i] * g[at(i + 1, i + 1)]
        for j in range(i + 1, k):
            rss = rss + 2 * b[i] * b[j] * g[at(i + 1, j + 1)]
    likelihood = -F.col("n") * (0.5 * kernels.LOG_2PI + F.log(s)) - rss / (2 * s * s)
    out = math.log(2) - 0.5 * kernels.LOG_2PI - math.log(sigma_scale) - s * s / (2 * sigma_scale**2)
    for i, (sign, loc, scale) in enumerate(zip(*prior, strict=True)):
        flip = -1.0 if sign == "-" else 1.0
        mass = 1.0 if sign == "=" else 0.5 * math.erfc(-flip * loc / scale / math.sqrt(2))
        own = -0.5 * kernels.LOG_2PI - math.log(scale) - math.log(mass) - 0.5 * ((b[i] - loc) / scale) * ((b[i] - loc) / scale)
        out = out + (own if sign == "=" else F.when(flip * b[i] >= 0, own).otherwise(-math.inf))
    joined = points.join(sums.select("series_id", "g", "n"), "series_id")
    return joined.select("series_id", "chain", "draw", likelihood.alias("log_likelihood"), out.alias("log_prior"), (likelihood + out).alias("log_joint"))


def tune_dlt(df: DataFrame, *, trials: int = 15, refine: int = 0, regressors: list[str] | None = None, scheme=None, horizon: int = 12, draws: int = 20, warmup: int = 20, seed: int = 0) -> DataFrame:
    """WBIC of seeded (lev_sm, slp_sm, theta) trials for each series: a row for each series and trial.

    The first trials are drawn log-uniformly (theta uniformly) from their bounds; ``refine`` more are
    drawn near each series' best of those. A trial fits the trend with its regressors to ``draws``
    posterior draws. The panel is shuffled once, by series: all trials of a series run where it is, each
    over all series of one length at once."""
    names, prior = _prior(df, regressors, scheme)
    rng = np.random.default_rng(seed)
    points = [(float(10 ** rng.uniform(-4, -1)), float(10 ** rng.uniform(-3, -1)), float(rng.uniform())) for _ in range(trials)]

    def tried(trial: int, point: np.ndarray, ids: list, y: np.ndarray, x: np.ndarray) -> list[tuple]:
        """Rows of one trial; point (3, B), y (B, T), x (B, k, T)."""
        data = np.concatenate([y[:, None], np.where(np.isnan(y)[:, None], np.nan, x)], 1)
        b, width, steps = data.shape
        lev, slp, theta = (np.repeat(p, width) for p in point)
        c = kernels.dlt_scan(data.reshape(-1, steps), lev, slp, theta)[2].reshape(b, width, steps)
        out = []
        for i, series in enumerate(ids):
            rest = (data[i] - c[i])[:, ~np.isnan(y[i])]
            g = rest @ rest.T
            coef, s = gibbs(g[1:, 1:], g[0, 1:], float(g[0, 0]), rest.shape[1], *prior, _rng(seed, series, trial), warmup, draws)
            out.append((series, trial, *(float(p[i]) for p in point), wbic(y[i], c[i, 0] - coef @ c[i, 1:], coef @ x[i], s, horizon)))
        return out

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        values = np.column_stack([numbers(table, n) for n in ["y", *names]])
        for at in by_length(table, "series_id"):
            both = values[at].transpose(0, 2, 1)
            y, x, ids = both[:, 0], both[:, 1:], table.column("series_id").take(pa.array(at[:, 0])).to_pylist()
            rows = [r for i, p in enumerate(points) for r in tried(i, np.repeat(np.array(p)[:, None], len(ids), 1), ids, y, x)]
            if refine:
                ranked = sorted(rows, key=lambda r: (r[5], r[1]), reverse=True)
                best = {r[0]: r[2:5] for r in ranked}  # the last of a series is its best
                for i in range(trials, trials + refine):
                    z = np.array([_rng(seed, "near", s, i).standard_normal(3) for s in ids])
                    near = np.array([best[s] for s in ids])
                    near = np.column_stack([near[:, :2] * np.exp(0.3 * z[:, :2]), near[:, 2] + 0.1 * z[:, 2]])
                    rows += tried(i, np.clip(near, *np.array(list(_BOUNDS.values())).T).T, ids, y, x)
            yield pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), *[pa.float64()] * 4), strict=True)], [f.split()[0] for f in TUNE_SCHEMA.split(", ")])

    chosen = df.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("y").cast("double").alias("y"), *(F.col(n).cast("double").alias(n) for n in names))
    return folded(chosen, fold, TUNE_SCHEMA, heavy=True)


# ------------------------------------------------------------------ maximum a posteriori


def _loss_gradient(theta: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihood of the linear filter (a0 = 0, P0 = 1) and its gradient by forward
    sensitivities, for softplus parameters (B, 3): sigma_h, level noise, seasonal noise.

    A step changes the states alone that its row of z has; the variances of the others grow by their
    noise, which is added when they are next seen. Arrays are laid out with the series last."""
    b, steps = y.shape
    n = z.shape[1]
    sigma, slope = np.logaddexp(0, theta).T.copy(), (1 / (1 + np.exp(-theta))).T
    q, dq = sigma[1:] ** 2, 2 * sigma[1:] * slope[1:]  # of the level and of the others
    h, dh = sigma[0] ** 2, 2 * sigma[0] * slope[0]
    a, p = np.zeros((n, b)), np.ones((n, b))
    da, dp = np.zeros((n, 3, b)), np.zeros((n, 3, b))
    seen = np.zeros(n, np.int64)  # steps whose noise a state's variance has
    loss, grad = np.zeros(b), np.zeros((3, b))
    columns = np.ascontiguousarray(y.T)
    active = [np.flatnonzero(row).tolist() for row in z]
    for t in range(steps):
        own = active[t]
        for i in own:
            if late := t - int(seen[i]):
                kind = int(i > 0)
                p[i] += late * q[kind]
                dp[i, 1 + kind] += late * dq[kind]
                seen[i] = t
        v, f = columns[t].copy(), h.copy()
        dv, df = np.zeros((3, b)), np.zeros((3, b))
        df[0] = dh
        for i in own:
            c = z[t, i]
            v -= c * a[i]
            f += c * c * p[i]
            dv -= c * da[i]
            df += c * c * dp[i]
        w = v / f
        loss += 0.5 * (kernels.LOG_2PI + np.log(f) + v * w)
        df /= f
        grad += 0.5 * (1 - v * w) * df + w * dv
        for i in own:
            c = z[t, i]
            k = c * p[i] / f
            dk = c * dp[i] / f - k * df
            a[i] += k * v
            da[i] += dk * v + k * dv
            dp[i] = dp[i] * (1 - c * k) - c * p[i] * dk
            p[i] *= 1 - c * k
    return loss, grad.T


def adam(y: np.ndarray, z: np.ndarray, iterations: int = 500, rate: float = 3e-2, patience: int | None = None, tolerance: float = 1e-5, bounds: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best parameters (B, 3) and losses, each series by itself; the parameters kept are those that
    the loss was computed at. ``patience`` freezes a series that has not improved for so long."""
    start = np.log(np.expm1(np.array([0.30, 0.055, 0.055])) + 1e-12)
    low, high = np.log(np.expm1(np.array(bounds, float))).T if bounds else (-np.inf, np.inf)
    theta = np.clip(np.tile(start, (len(y), 1)), low, high)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    best, best_loss, since = theta.copy(), np.full(len(y), np.inf), np.zeros(len(y))
    live = np.ones(len(y), bool)
    for it in range(1, iterations + 1):
        loss, g = _loss_gradient(theta, y, z)
        better = loss < best_loss - (tolerance if patience else 0.0)
        since = np.where(better, 0, since + 1)
        best[loss < best_loss], best_loss = theta[loss < best_loss], np.minimum(loss, best_loss)
        if patience:
            live = since < patience
            if not live.any():
                break
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - np.where(live[:, None], rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8), 0.0)
        theta = np.clip(theta, low, high)
    return np.logaddexp(0, best), best_loss


#: Rows of whole series that are fitted together, so that a step's work outweighs its calls.
MAP_ROWS = 2_000_000
MAP_SCHEMA = "series_id string, sigma_h double, sigma_level double, sigma_season double, loss double, response_norm double, a_last array<double>, p_last array<double>, last_t long"


def season_design(steps: np.ndarray, season: int, intercept: bool) -> np.ndarray:
    """Periodic dummies without the first, after a column of ones where there is an intercept."""
    return np.column_stack([np.ones(len(steps))] * intercept + [(steps % season == j).astype(float) for j in range(1, season)])


def _response(sales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = np.maximum(sales, 0.1)
    norm = held.mean(1)
    return np.log(held / norm[:, None]), norm


def _map_rows(ids, last: np.ndarray, sigma: np.ndarray, loss: np.ndarray, y: np.ndarray, z: np.ndarray, norm: np.ndarray) -> pa.Table:
    b, n = len(y), z.shape[1]
    q = np.column_stack([sigma[:, 1:2], np.repeat(sigma[:, 2:], n - 1, 1)])
    res = kernels.kalman_filter(y, z, np.zeros(n), np.ones(n), sigma[:, 0], q)
    columns = [ids, *(pa.array(sigma[:, i]) for i in range(3)), pa.array(loss), pa.array(norm), lists(res["a"][:, -1], b), lists(res["p"][:, -1], b), pa.array(last.astype(np.int64))]
    return pa.table(columns, [f.split()[0] for f in MAP_SCHEMA.split(", ")])


def fit_map(df: DataFrame, *, season: int = 7, intercept: bool = True, iterations: int = 100, rate: float = 3e-2, patience: int | None = None, bounds: tuple | None = None, rows: int = MAP_ROWS) -> DataFrame:
    """MAP parameters and last states of each series (series_id, t, sales): local level and periodic
    dummies on log(sales / mean), sales held above 0.1. Series of one length that come together are
    fitted together; each keeps the best parameters that it was at. ``bounds`` are (low, high) of each of
    sigma_h, sigma_level and sigma_season, and hold at every step."""

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        sales, t = numbers(table, "sales"), numbers(table, "t")
        for at in by_length(table, "series_id"):
            starts = t[at[:, 0]] % season
            for phase in np.unique(starts):
                own = at[starts == phase]
                z = season_design(t[own[0]], season, intercept)
                y, norm = _response(sales[own])
                sigma, loss = adam(y, z, iterations, rate, patience, bounds=bounds)
                yield _map_rows(table.column("series_id").take(pa.array(own[:, 0])), t[own[:, -1]], sigma, loss, y, z, norm)

    chosen = df.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("sales").cast("double").alias("sales"))
    return folded(chosen, fold, MAP_SCHEMA, rows=rows, heavy=True)


def refilter(df: DataFrame, params: DataFrame, *, season: int = 7, intercept: bool = True, horizon: int = 28, expected: int | None = 28, rows: int = FOLD_ROWS) -> DataFrame:
    """Forecasts of saved parameters: the states are filtered again over df (series_id, t, sales) with
    each series' sigma_h, sigma_level and sigma_season, then carried ``horizon`` steps ahead.

    A training span of one step or less, and a horizon other than ``expected``, are errors."""
    if expected is not None and horizon != expected:
        raise ValueError(f"the horizon is {horizon}, not {expected}")

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        sales, t = numbers(table, "sales"), numbers(table, "t")
        given = np.column_stack([numbers(table, c) for c in ("sigma_h", "sigma_level", "sigma_season")])
        for at in by_length(table, "series_id"):
            at = at[np.isnan(t[at[:, 0]])]  # of those that have a row of parameters, which comes first
            if at.shape[1] > 1 and np.isnan(t[at[:, 1]]).any():
                raise ValueError("a series has several rows of parameters")
            first, at = at[:, 0], at[:, 1:]
            if len(at) and at.shape[1] == 1:
                raise ValueError("a training span of one step or less")
            if not at.size:
                continue
            starts = t[at[:, 0]] % season
            for phase in np.unique(starts):
                own = at[starts == phase]
                y, norm = _response(sales[own])
                yield _map_rows(table.column("series_id").take(pa.array(own[:, 0])), t[own[:, -1]], given[first[starts == phase]], np.zeros(len(own)), y, season_design(t[own[0]], season, intercept), norm)

    none = F.lit(None)
    chosen = df.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("sales").cast("double").alias("sales"), *(none.cast("double").alias(c) for c in ("sigma_h", "sigma_level", "sigma_season")))
    told = params.select(F.col("series_id").cast("string").alias("series_id"), none.cast("long").alias("t"), none.cast("double").alias("sales"), "sigma_h", "sigma_level", "sigma_season")
    return forecast_seasonal(folded(chosen.filter("t is not null").unionByName(told), fold, MAP_SCHEMA, rows=rows), horizon, season=season, intercept=intercept)


def forecast_map(fits: DataFrame, future: DataFrame) -> DataFrame:
    """Log-normal means ahead: exp(z a + (z^2 P + sigma_h^2) / 2) * norm; future has t and array z,
    one row a step of the horizon, which is broadcast."""
    return _log_normal_mean(fits.crossJoin(F.broadcast(future)))


def forecast_seasonal(fits: DataFrame, horizon: int, *, season: int = 7, intercept: bool = True) -> DataFrame:
    """The same for the ``horizon`` steps after each series' own last step, with the design of
    ``season_design``."""
    ahead = fits.withColumn("t", F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.col("last_t") + h)))
    ones = [F.lit(1.0)] if intercept else []
    return _log_normal_mean(ahead.withColumn("z", F.array(*ones, *((F.pmod("t", F.lit(season)) == j).cast("double") for j in range(1, season)))))


def _log_normal_mean(rows: DataFrame) -> DataFrame:
    z2 = F.transform("z", lambda x: x * x)
    value = F.exp(_dot(F.col("z"), F.col("a_last")) + 0.5 * (_dot(z2, F.col("p_last")) + F.col("sigma_h") * F.col("sigma_h"))) * F.col("response_norm")
    return rows.select("series_id", "t", value.alias("forecast"))


# ------------------------------------------------------------------ adaptive MCMC


@dataclass(frozen=True)
class NoisePrior:
    """Priors of sigma_h and of sigma_q of the first and of the other states.

    "truncated_normal": (loc, scale, low, high) each. "beta": (alpha, beta, scale) each, the deviation
    being a beta number times the scale."""

    family: str = "truncated_normal"
    h: tuple[float, ...] = (0.1, 1.0, 1e-5, 1.0)
    level: tuple[float, ...] = (0.05, 0.05, 1e-5, 0.1)
    other: tuple[float, ...] = (0.01, 0.01, 1e-5, 0.1)

    def __post_init__(self):
        if self.family not in ("truncated_normal", "beta"):
            raise ValueError(f"no family {self.family!r}")
        if any(len(p) != (4 if self.family == "truncated_normal" else 3) for p in (self.h, self.level, self.other)):
            raise ValueError(f"wrong number of parameters for {self.family}")

    def log_density(self, s: np.ndarray) -> float:
        """Of (sigma_h..., level, other) without constants; all but the last two are sigma_h's."""
        total = 0.0
        for i, x in enumerate(s):
            own = (self.level, self.other)[i - len(s) + 2] if i >= len(s) - 2 else self.h
            if self.family == "beta":
                a, b, scale = own
                u = x / scale
                if not 0 < u < 1:
                    return -math.inf
                total += (a - 1) * math.log(u) + (b - 1) * math.log1p(-u)
            else:
                loc, scale, low, high = own
                if not low <= x <= high:
                    return -math.inf
                total -= 0.5 * ((x - loc) / scale) ** 2
        return total

    def start(self, m: int = 1) -> np.ndarray:
        if self.family == "beta":
            mean = lambda p: p[2] * p[0] / (p[0] + p[1])
        else:
            mean = lambda p: min(max(p[0], 0.5 * p[1], 1.01 * p[2]), 0.99 * p[3])
        return np.array([*[mean(self.h)] * m, mean(self.level), mean(self.other)])


def adaptive_metropolis(log_density, start: np.ndarray, rngs: list[np.random.Generator], warmup: int, draws: int) -> np.ndarray:
    """Random-walk draws (draws, N, k) of N chains at once, each with its own generator and a covariance
    that follows it during the warm-up; ``log_density`` maps (N, k) to (N,)."""
    n, k = start.shape
    steps = np.array([r.standard_normal((warmup + draws, k)) for r in rngs]).reshape(n, -1, k)
    chance = np.array([r.random(warmup + draws) for r in rngs]).reshape(n, -1)
    x, lp = start.astype(float), log_density(start)
    cov, mean, scale, out = np.tile(np.eye(k) * 0.01, (n, 1, 1)), start.astype(float), np.ones(n), np.empty((draws, n, k))
    for it in range(warmup + draws):
        root = np.linalg.cholesky(cov + 1e-9 * np.eye(k))
        new = x + (scale * 2.38 / math.sqrt(k))[:, None] * np.einsum("nij,nj->ni", root, steps[:, it])
        lp_new = log_density(new)
        with np.errstate(invalid="ignore", over="ignore"):
            accept = np.where(np.isfinite(lp_new), np.exp(np.minimum(0.0, lp_new - lp)), 0.0)
        taken = chance[:, it] < accept
        x, lp = np.where(taken[:, None], new, x), np.where(taken, lp_new, lp)
        if it < warmup:
            w = 1 / (it + 2)
            d = x - mean
            mean, cov = mean + w * d, (1 - w) * cov + w * d[:, :, None] * d[:, None, :]
            scale = scale * np.exp((accept - 0.3) / math.sqrt(it + 1))
        else:
            out[it - warmup] = x
    return out


MCMC_SCHEMA = "series_id string, chain int, draw int, sigma_h array<double>, sigma_q array<double>, log_p double, a_last array<double>"
#: Rows of whole series whose chains run at once.
MCMC_ROWS = 20_000


def _posterior(ids: list, m: int, density, prior: NoisePrior, warmup: int, draws: int, chains: int, seed: int) -> tuple[np.ndarray, list]:
    """Noise draws (draws, N, m + 2) of the chains of the given series, series by series, and what
    ``density`` (sigmas (N, m + 2) to (log_p, ...)) gives for each draw."""
    rngs = [_rng(seed, s, c) for s in ids for c in range(chains)]

    def log_density(u):
        s = np.exp(u)
        own = np.array([prior.log_density(x) for x in s])
        inside = np.isfinite(own)
        held = np.where(inside[:, None], s, prior.start(m))
        return np.where(inside, own + u.sum(1) + density(held)[0], -np.inf)

    got = np.exp(adaptive_metropolis(log_density, np.tile(np.log(prior.start(m)), (len(rngs), 1)), rngs, warmup, draws))
    return got, [density(s) for s in got]


def _whole(s: np.ndarray, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma_h (N, m) and sigma_q (N, n) of sigmas (N, m + 2)."""
    return s[:, :m], np.concatenate([s[:, m : m + 1], np.repeat(s[:, m + 1 :], n - 1, 1)], 1)


def _drawn(ids: list, chains: int, found: tuple[np.ndarray, list], m: int, n: int) -> pa.Table:
    """The rows of MCMC_SCHEMA of what ``_posterior`` found."""
    got, ends = found
    draws, chain_count = got.shape[:2]
    flat = got.transpose(1, 0, 2).reshape(draws * chain_count, -1)
    h, q = _whole(flat, m, n)
    log_p, last = (np.array([e[i] for e in ends]).swapaxes(0, 1).reshape(draws * chain_count, -1) for i in (0, 1))
    columns = [pa.array(np.repeat(np.array(ids, object), chains * draws), pa.string()), pa.array(np.tile(np.repeat(np.arange(chains), draws), len(ids)), pa.int32()), pa.array(np.tile(np.arange(draws), chain_count), pa.int32()), lists(h, len(h)), lists(q, len(q)), pa.array(log_p[:, 0]), lists(last, len(last))]
    return pa.table(columns, [f.split()[0] for f in MCMC_SCHEMA.split(", ")])


def fit_mcmc(df: DataFrame, z_columns: list[str], *, exponent: float | None = None, positivity: list[bool] | None = None, a0=None, p0=None, prior: NoisePrior | None = None, warmup: int = 200, draws: int = 100, chains: int = 4, seed: int = 0) -> DataFrame:
    """Posterior draws of sigma_h and sigma_q, with the log-likelihood and last state, of each series
    (series_id, t, y and the z columns). The panel is shuffled once; the chains of all series of one
    length that come together are filtered together."""
    n, prior = len(z_columns), prior or NoisePrior()
    start, spread = np.zeros(n) if a0 is None else np.asarray(a0, float), np.ones(n) if p0 is None else np.asarray(p0, float)

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        y, z = numbers(table, "y"), np.column_stack([numbers(table, c) for c in z_columns])
        for at in by_length(table, "series_id"):
            each, ids = np.repeat(at, chains, 0), table.column("series_id").take(pa.array(at[:, 0])).to_pylist()

            def density(s, own=(y[each], z[each])):
                h, q = _whole(s, 1, n)
                out = kernels.kalman_filter(*own, start, spread, h[:, 0], q, exponent=exponent, positivity=positivity)
                return out["log_p"], out["a"][:, -1]

            yield _drawn(ids, chains, _posterior(ids, 1, density, prior, warmup, draws, chains, seed), 1, n)

    chosen = df.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in z_columns))
    return folded(chosen, fold, MCMC_SCHEMA, rows=MCMC_ROWS, heavy=True)


def fit_mcmc_st(df: DataFrame, a0: list[float], p0: list[list[float]], *, exponent: float | None = None, positivity: list[bool] | None = None, prior: NoisePrior | None = None, warmup: int = 200, draws: int = 100, chains: int = 4, seed: int = 0) -> DataFrame:
    """The same for panels (panel_id as series_id; t, y array, z array of arrays; a_obs and p_obs where
    they are) whose series share states; each series has a sigma_h. A panel's chains run in its task."""
    extra, n = [c for c in ("a_obs", "p_obs") if c in df.columns], len(a0)
    prior = prior or NoisePrior()

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        for group in by_length(table, "series_id"):
            for at in group:
                pdf = table.slice(int(at[0]), len(at)).to_pandas()
                y, z = np.stack(pdf["y"].to_numpy()).astype(float), np.array([[list(r) for r in x] for x in pdf["z"]], float)
                told, ids, m = {c: np.stack(pdf[c].to_numpy()).astype(float) for c in extra}, [pdf["series_id"].iloc[0]], y.shape[1]

                def density(s, y=y, z=z, told=told, m=m):
                    outs = [kernels.kalman_filter_st(y, z, a0, p0, h, q, exponent=exponent, positivity=positivity, **told) for h, q in zip(*_whole(s, m, n), strict=True)]
                    return np.array([o["log_p"] for o in outs]), np.array([o["a"][-1] for o in outs])

                yield _drawn(ids, chains, _posterior(ids, m, density, prior, warmup, draws, chains, seed), m, n)

    chosen = df.select(F.col("panel_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), "y", "z", *extra)
    return folded(chosen, fold, MCMC_SCHEMA, rows=1, heavy=True)


LEVEL_SCHEMA = "series_id string, chain int, draw int, sigma_h double, sigma_q double, beta array<double>, log_p double, a_last double"


def fit_level_regression(df: DataFrame, x_columns: list[str], *, beta_scale: float = 10.0, prior: NoisePrior | None = None, warmup: int = 200, draws: int = 100, chains: int = 4, seed: int = 0) -> DataFrame:
    """A local level whose regression is outside the state: draws of sigma_h, sigma_q and the coefficients.

    The filter (a0 = 0, P0 = 1) is linear in its data, so innovations of y less regression are those of y
    less those of the regressors. With normal priors of scale ``beta_scale`` the coefficients are
    integrated out of the likelihood of the noise, and drawn given each draw of it. ``log_p`` is that
    likelihood, ``a_last`` the last level."""
    k = len(x_columns)
    prior = prior or NoisePrior(h=(0.0, 0.1, 1e-5, 0.1), level=(0.0, 0.01, 1e-5, 0.8), other=(0.0, 0.01, 1e-5, 0.8))

    def fold(table: pa.Table) -> Iterator[pa.Table]:
        values = np.column_stack([numbers(table, c) for c in ["y", *x_columns]])
        for at in by_length(table, "series_id"):
            b, steps = at.shape
            ids = table.column("series_id").take(pa.array(at[:, 0])).to_pylist()
            data = np.repeat(values[at].transpose(0, 2, 1), chains, 0)  # (N, 1 + k, T)
            count = len(data)

            def solved(s, data=data, count=count, steps=steps):
                """Precision and information of the coefficients, log-likelihood, last levels of y and x."""
                h, q = np.repeat(s[:, 0], k + 1), np.repeat(s[:, 1], k + 1)
                out = kernels.kalman_filter(data.reshape(-1, steps), np.ones((steps, 1)), [0.0], [1.0], h, q[:, None])
                v, f = out["v"].reshape(count, k + 1, steps), out["f"].reshape(count, k + 1, steps)[:, 0]
                g = np.einsum("nit,njt,nt->nij", v, v, 1 / f)
                precision, info = g[:, 1:, 1:] + np.eye(k) / beta_scale**2, g[:, 1:, 0]
                best = np.linalg.solve(precision, info[..., None])[..., 0]
                log_p = -0.5 * (steps * kernels.LOG_2PI + np.log(f).sum(1) + g[:, 0, 0] - (info * best).sum(1) + np.linalg.slogdet(precision)[1] + 2 * k * math.log(beta_scale))
                return log_p, precision, best, out["a"][:, -1, 0].reshape(count, k + 1)

            # the prior's third kind is not used: its sigma stays at the start
            got, ends = _posterior(ids, 1, lambda s, solved=solved: solved(s[:, :2]), prior, warmup, draws, chains, seed)
            rngs, out = [_rng(seed, "beta", s, c) for s in ids for c in range(chains)], []
            for d, (log_p, precision, best, last) in enumerate(ends):
                for i in range(count):
                    beta = best[i] + np.linalg.solve(np.linalg.cholesky(precision[i]).T, rngs[i].standard_normal(k))
                    out.append((ids[i // chains], i % chains, d, float(got[d, i, 0]), float(got[d, i, 1]), beta.tolist(), float(log_p[i]), float(last[i, 0] - beta @ last[i, 1:])))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64())
            yield pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in LEVEL_SCHEMA.split(", ")])

    chosen = df.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), *(F.col(c).cast("double").alias(c) for c in ["y", *x_columns]))
    return folded(chosen, fold, LEVEL_SCHEMA, rows=MCMC_ROWS, heavy=True)


def level_regression_mean(df: DataFrame, fits: DataFrame, x_columns: list[str]) -> DataFrame:
    """series_id, chain, draw, t, level and mu = level + regression, of each draw of ``fit_level_regression``:
    history and draws meet by series, each shuffled once."""
    history = df.select(F.col("series_id").cast("string").alias("series_id"), F.col("t").cast("long").alias("t"), *(F.col(c).cast("double").alias(c) for c in ["y", *x_columns]))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, draws: pa.Table) -> pa.Table:
        rows = rows.sort_by("t")
        m, steps = draws.num_rows, rows.num_rows
        x, beta = np.column_stack([numbers(rows, c) for c in x_columns]), np.array(draws.column("beta").to_pylist(), float).reshape(m, len(x_columns))
        reg = beta @ x.T
        out = kernels.kalman_filter(numbers(rows, "y") - reg, np.ones((steps, 1)), [0.0], [1.0], numbers(draws, "sigma_h"), numbers(draws, "sigma_q")[:, None]) if m and steps else {"a": np.zeros((m, steps, 1))}
        level = out["a"][..., 0]
        spread = lambda c: draws.column(c).take(pa.array(np.repeat(np.arange(m), steps)))
        return pa.table([pa.array([key[0].as_py()] * (m * steps), pa.string()), spread("chain"), spread("draw"), pa.array(np.tile(np.asarray(rows.column("t")), m), pa.int64()), pa.array(level.ravel()), pa.array((level + reg).ravel())], ["series_id", "chain", "draw", "t", "level", "mu"])

    return history.groupBy("series_id").cogroup(fits.select("series_id", "chain", "draw", "sigma_h", "sigma_q", "beta").groupBy("series_id")).applyInArrow(run, "series_id string, chain int, draw int, t long, level double, mu double")


def fit_dlt_global(df: DataFrame, lev_sm: float, slp_sm: float, theta: float, *, seasonal: list[str], trend: str = "glb", warmup: int = 100, draws: int = 100, chains: int = 4, seed: int = 0) -> DataFrame:
    """The damped trend over what a global line and seasonal terms leave: y = a + b * trend + seasonal terms
    + local trend + noise, with a and b normal of scale 1, seasonal coefficients of scale 0.3, and a
    half-normal sigma of scale 0.5. df has series_id, t, y, the trend and the seasonal columns; the draws
    are those of ``fit_dlt``, the intercept being the regressor ``one``."""
    scheme = {"one": ("=", 0.0, 1.0), trend: ("=", 0.0, 1.0)} | {c: ("=", 0.0, 0.3) for c in seasonal}
    return fit_dlt(df.withColumn("one", F.lit(1.0)), lev_sm, slp_sm, theta, scheme=scheme, warmup=warmup, draws=draws, chains=chains, seed=seed, sigma_scale=0.5)


def forecast_mcmc(fits: DataFrame, future: DataFrame, norms: DataFrame | None = None, *, seed: int = 42) -> DataFrame:
    """series_id, t and the median over draws of exp(z a + N(0, sigma_h)) * norm; future has t and the
    array z, norms has series_id and response_norm (1 without)."""
    rows = fits.crossJoin(F.broadcast(future))
    eps = F.col("sigma_h")[0] * _normal(F.xxhash64(F.lit(seed), "series_id", "chain", "draw", "t"))
    out = rows.select("series_id", "t", F.exp(_dot(F.col("z"), F.col("a_last")) + eps).alias("v"))
    out = out.groupBy("series_id", "t").agg(F.percentile("v", 0.5).alias("v"))
    if norms is None:
        return out.withColumnRenamed("v", "forecast")
    return out.join(norms.select("series_id", "response_norm"), "series_id").select("series_id", "t", (F.col("v") * F.col("response_norm")).alias("forecast"))
