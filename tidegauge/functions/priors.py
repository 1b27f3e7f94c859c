"""State-space priors carried from natural units to the exponent's space, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = ("mean", "median", "linearize")
FAMILIES = ("truncated_normal", "beta")


def check_match(match: str) -> None:
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}, not {match!r}")


def _ratio(variance: Column, mean: Column) -> Column:
    return F.log1p(variance / (mean * mean))


def a_mean(mean: Column, variance: Column, positive: Column, k: float, match: str) -> Column:
    """Location in a-space of a positive state with the given moments; others pass through."""
    check_match(match)
    own = (F.log(mean) - _ratio(variance, mean) / 2) / k if match == "mean" else F.log(mean) / k
    return F.when(positive, own).otherwise(mean)


def a_variance(mean: Column, variance: Column, positive: Column, k: float, match: str) -> Column:
    check_match(match)
    own = variance / (k * k * mean * mean) if match == "linearize" else _ratio(variance, mean) / (k * k)
    return F.when(positive, own).otherwise(variance)


def a_sigma(mean: Column, sigma: Column, positive: Column, k: float, match: str) -> Column:
    """A deviation in a-space, without a correction of the mean."""
    check_match(match)
    own = sigma / (mean * k) if match == "linearize" else F.sqrt(_ratio(sigma * sigma, mean)) / k
    return F.when(positive, own).otherwise(sigma)


def beta_scale(alpha: Column, beta: Column, scale: Column, mean: Column, positive: Column, k: float, match: str) -> Column:
    """The scale of a beta prior whose mode moves as a deviation does."""
    mode = (alpha - 1) / (alpha + beta - 2)
    return F.when(positive, a_sigma(mean, scale * mode, F.lit(True), k, match) / mode).otherwise(scale)


def a_observation(value: Column, variance: Column, positive: Column, k: float, match: str) -> tuple[Column, Column]:
    """Disclosed states: infinite variances stay and say nothing; values not over 0 count as 1."""
    told = positive & (variance < float("inf")) & ~F.isnan(variance)
    safe = F.when(value > 0, value).otherwise(1.0)
    return F.when(told, a_mean(safe, variance, F.lit(True), k, match)).otherwise(value), F.when(told, a_variance(safe, variance, F.lit(True), k, match)).otherwise(variance)


def a_covariance(cov: Column, mean_i: Column, mean_j: Column, positive_i: Column, positive_j: Column, k: float, match: str) -> Column:
    """Off-diagonal entries of a state covariance."""
    check_match(match)
    both = cov / (k * k * mean_i * mean_j) if match == "linearize" else F.log1p(cov / (mean_i * mean_j)) / (k * k)
    return F.when(positive_i & positive_j, both).when(positive_i, cov / (mean_i * k)).when(positive_j, cov / (mean_j * k)).otherwise(cov)


@dataclass
class Priors:
    """a0, p0 (a vector or a matrix), the positivity mask and the sigma-q block in natural units."""

    a0: list[float]
    p0: list
    positivity: list[bool]
    sigma_q: dict[str, list[float]] = field(default_factory=dict)
    family: str = "truncated_normal"
    a_obs: list[list[float]] | None = None
    p_obs: list[list[float]] | None = None
    obs_idx: list[int] | None = None
    match: str | None = None


def _check(p: Priors, match: str, dims: int) -> None:
    check_match(match)
    if p.positivity is None or len(p.positivity) != len(p.a0):
        raise ValueError("positivity needs an entry for each state")
    if (p.a_obs is None) != (p.p_obs is None):
        raise ValueError("a_obs and p_obs come together")
    if np.ndim(p.p0) != dims:
        raise ValueError(f"p0 needs {dims} dimension(s)")
    if any(m and a <= 0 for m, a in zip(p.positivity, p.a0, strict=True)):
        raise ValueError("a positive state needs a0 > 0")
    if p.family not in FAMILIES:
        raise ValueError(f"no family {p.family!r}")


def sigma_alignment(values: list[float], n_states: int) -> list[int]:
    """The states whose means go with a sigma block: all, or states 0 and 1 for a block of two."""
    if len(values) == n_states:
        return list(range(n_states))
    if len(values) == 2:
        return [0, 1]
    raise ValueError(f"a sigma block of {len(values)} does not fit {n_states} states")


def state_table(spark: SparkSession, p: Priors) -> DataFrame:
    diagonal = np.diag(p.p0) if np.ndim(p.p0) == 2 else p.p0
    return spark.createDataFrame([(i, float(a), float(v), bool(m)) for i, (a, v, m) in enumerate(zip(p.a0, diagonal, p.positivity, strict=True))], "state int, a0 double, p0 double, positive boolean")


def to_ekf(spark: SparkSession, p: Priors, exponent: float = 0.5, match: str = "mean", stacked: bool = False) -> Priors:
    """The priors in a-space; ``stacked`` for a covariance matrix shared by several series."""
    _check(p, match, 2 if stacked else 1)
    k, n = exponent, len(p.a0)
    a, v, m = F.col("a0"), F.col("p0"), F.col("positive")
    rows = state_table(spark, p).select("state", a_mean(a, v, m, k, match).alias("a"), a_variance(a, v, m, k, match).alias("v")).orderBy("state").collect()
    new_a, new_v = [r.a for r in rows], [r.v for r in rows]
    p0 = new_v
    if stacked:
        cells = spark.createDataFrame([(i, j, float(p.p0[i][j]), float(p.a0[i]), float(p.a0[j]), bool(p.positivity[i]), bool(p.positivity[j])) for i in range(n) for j in range(n) if i != j], "i int, j int, c double, mi double, mj double, pi boolean, pj boolean")
        p0 = np.diag(new_v)
        for r in cells.select("i", "j", a_covariance(F.col("c"), F.col("mi"), F.col("mj"), F.col("pi"), F.col("pj"), k, match).alias("c")).collect():
            p0[r.i, r.j] = r.c
        p0 = ((p0 + p0.T) / 2).tolist()
    out = Priors(new_a, p0, p.positivity, family=p.family, obs_idx=p.obs_idx, match=match)
    if p.sigma_q:
        out.sigma_q = _sigma_block(spark, p, k, match)
    if p.a_obs is not None:
        flat = spark.createDataFrame([(t, i, float(p.a_obs[t][i]), float(p.p_obs[t][i]), bool(p.positivity[i])) for t in range(len(p.a_obs)) for i in range(n)], "t int, i int, a double, p double, m boolean")
        oa, op = a_observation(F.col("a"), F.col("p"), F.col("m"), k, match)
        got = {(r.t, r.i): (r.oa, r.op) for r in flat.select("t", "i", oa.alias("oa"), op.alias("op")).collect()}
        out.a_obs = [[got[t, i][0] for i in range(n)] for t in range(len(p.a_obs))]
        out.p_obs = [[got[t, i][1] for i in range(n)] for t in range(len(p.a_obs))]
    return out


def _sigma_block(spark: SparkSession, p: Priors, k: float, match: str) -> dict[str, list[float]]:
    first = next(iter(p.sigma_q.values()))
    at = sigma_alignment(first, len(p.a0))
    rows = [(i, float(p.a0[s]), bool(p.positivity[s]), *(float(v[i]) for v in p.sigma_q.values())) for i, s in enumerate(at)]
    names = list(p.sigma_q)
    df = spark.createDataFrame(rows, "i int, mean double, positive boolean, " + ", ".join(f"{c} double" for c in names))
    mean, positive = F.col("mean"), F.col("positive")
    if p.family == "beta":
        if any(x <= 1 for c in ("alpha", "beta") for x in p.sigma_q[c]):
            raise ValueError("a beta prior needs alpha and beta over 1")
        new = {"alpha": F.col("alpha"), "beta": F.col("beta"), "scale": beta_scale(F.col("alpha"), F.col("beta"), F.col("scale"), mean, positive, k, match)}
    else:
        new = {c: a_sigma(mean, F.col(c), positive, k, match) for c in names}
    got = df.select("i", *(v.alias(c) for c, v in new.items())).orderBy("i").collect()
    return {c: [r[c] for r in got] for c in new}


def disclosed_states(true_states: list[list[float]], n_periods: int = 3, n_points: int = 7, seed: int = 42, obs_scale: float = 0.1, positivity: list[bool] | None = None) -> Priors:
    """Priors with the true states disclosed in a few distinct windows; the first state is not."""
    truth = np.asarray(true_states, float)
    n, k = truth.shape
    starts = np.random.default_rng(seed).choice(n - n_points + 1, n_periods, replace=False)
    seen = sorted({int(s) + i for s in starts for i in range(n_points)})
    a_obs, p_obs = np.zeros((n, k)), np.full((n, k), np.inf)
    a_obs[seen] = truth[seen]
    p_obs[np.ix_(seen, range(1, k))] = obs_scale**2
    return Priors([1.0] * k, [1.0] * k, positivity or [False] + [True] * (k - 1), a_obs=a_obs.tolist(), p_obs=p_obs.tolist(), obs_idx=seen)


def time_point_priors(steps: DataFrame, betas: DataFrame, weeks: int = 4, variance: float = 0.01) -> DataFrame:
    """Disclosures (t, ds, variable, a_obs, p_obs) at every 7 * weeks steps that the table of betas
    (date, variable, mid) covers; a variable that it lacks at such a date is an error of the data
    and left undisclosed."""
    due = steps.filter(F.pmod(F.col("t"), F.lit(7 * weeks)) == 0)
    joined = due.join(betas.select(F.col("date").alias("ds"), "variable", "mid"), "ds", "inner").filter(F.col("mid").isNotNull())
    return joined.select("t", "ds", "variable", F.col("mid").alias("a_obs"), F.lit(variance).alias("p_obs"))
