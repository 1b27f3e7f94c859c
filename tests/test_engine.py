"""Scans, features, schemes, priors, estimation, scores, sources and the stream, each on small tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.config import RunConfig
from tidegauge.functions import features as ft
from tidegauge.functions import priors
from tidegauge.functions.scheme import RegressionScheme
from tidegauge.operators import estimate, kernels, scan, scoring
from tidegauge.sources import panel as src
from tidegauge.streaming.trend import streamed_components

SERIES = "series_id string, t long, y double"


def panel(spark, n_series: int = 7, seed: int = 0):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", t, float(rng.normal(5, 1))) for i in range(n_series) for t in range(10 + i)]
    return rows, spark.createDataFrame(rows, SERIES)


# ---------------------------------------------------------------- scans


@pytest.mark.parametrize("rows", [1, 25, 10_000])
def test_folds_do_not_depend_on_blocks_order_or_partitions(spark, rows):
    data, df = panel(spark)
    got = scan.dlt_components(df.orderBy(F.rand(1)).repartition(5), 0.3, 0.2, 0.9, rows=rows).collect()
    by = {(r.series_id, r.t): r for r in got}
    assert len(got) == len(data) == len(by)
    for s in {r[0] for r in data}:
        y = np.array([[v for i, _, v in data if i == s]])
        level, slope, comp = kernels.dlt_scan(y, 0.3, 0.2, 0.9)
        for t in range(y.shape[1]):
            r = by[s, t]
            assert (r.level, r.slope, r.component) == pytest.approx((level[0, t], slope[0, t], comp[0, t]), abs=1e-12)


def test_a_subset_of_series_gives_the_same(spark):
    _, df = panel(spark)
    whole = scan.dlt_components(df, 0.3, 0.2, 0.9).filter("series_id in ('s2', 's5')")
    part = scan.dlt_components(df.filter("series_id in ('s2', 's5')"), 0.3, 0.2, 0.9)
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))


def test_odd_series(spark):
    one = spark.createDataFrame([("a", 0, 3.0), (None, 0, 1.0), (None, 1, None), ("b", 0, 2.0), ("b", 1, math.inf)], SERIES)
    got = {(r.series_id, r.t): r for r in scan.dlt_components(one, 0.5, 0.5, 0.5).collect()}
    assert len(got) == 5 and got["a", 0].level == 3.0 and got["b", 1].level == 2.0 and got[None, 1].level == 1.0
    assert scan.dlt_components(one.limit(0), 0.5, 0.5, 0.5).count() == 0
    with pytest.raises(Exception, match="first observation"):
        scan.dlt_components(spark.createDataFrame([("a", 0, None)], SERIES), 0.5, 0.5, 0.5).collect()


def test_filters_take_their_columns(spark):
    data, df = panel(spark, 3)
    z = df.withColumn("z", F.array(F.lit(1.0), F.cos("t")))
    out = scan.filtered(z.withColumns({"sigma_h": F.lit(0.4), "sigma_q": F.array(F.lit(0.1), F.lit(0.2))}), [0.0, 0.0], [1.0, 1.0], None, None, smoother="dk")
    same = scan.filtered(z, [0.0, 0.0], [1.0, 1.0], 0.4, [0.1, 0.2], smoother="dk")
    assert sorted(map(str, out.collect())) == sorted(map(str, same.collect()))
    told = z.withColumns({"a_obs": F.lit(None).cast("array<double>"), "p_obs": F.lit(None).cast("array<double>")})
    none = scan.filtered(told, [0.0, 0.0], [1.0, 1.0], 0.4, [0.1, 0.2]).agg(F.sum("v")).first()[0]
    assert none == pytest.approx(same.agg(F.sum("v")).first()[0])
    for bad in (lambda: scan.filtered(z, [0.0], [1.0], 0.4, [0.1], smoother="x"), lambda: scan.filtered(told.drop("p_obs"), [0.0], [1.0], 0.4, [0.1]), lambda: scan.filtered_st(told.drop("a_obs"), [0.0], [[1.0]], 0.4, [0.1])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="missing observations"):
        scan.filtered(z.withColumn("y", F.when(F.col("t") != 3, F.col("y"))), [0.0, 0.0], [1.0, 1.0], 0.4, [0.1, 0.2]).collect()


def test_draws_under_the_smoother(spark):
    _, df = panel(spark, 2)
    z = df.withColumn("z", F.array(F.lit(1.0)))
    draws = spark.createDataFrame([(s, c, 0, 0.3 + c, [0.2]) for s in ("s0", "s1") for c in (0, 1)], "series_id string, chain int, draw int, sigma_h double, sigma_q array<double>")
    got = scan.smoothed_draws(z, draws, [0.0], [1.0])
    for c in (0, 1):
        one = scan.filtered(z, [0.0], [1.0], 0.3 + c, [0.2], smoother="rts").select("series_id", "t", F.col("a_smooth")[0].alias("mu"))
        a = {(r.series_id, r.t): r.mu for r in one.collect()}
        assert {(r.series_id, r.t): r.mu for r in got.filter(F.col("chain") == c).collect()} == pytest.approx(a)


def test_the_plan_has_one_shuffle(spark):
    _, df = panel(spark)
    plan = scan.dlt_components(df, 0.3, 0.2, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# ---------------------------------------------------------------- features and schemes


def test_saturation(spark):
    values = [(None,), (float("nan"),), (-1.0,), (0.0,), (3.0,), (1e9,)]
    got = [r[0] for r in spark.createDataFrame(values, "x double").select(ft.hill("x", 3.0, 2.0, 4.0)).collect()]
    assert got[:5] == [None, 0.0, 0.0, 0.0, 2.0] and got[5] == pytest.approx(4.0)
    assert ft.hill(3.0, 3.0, 2.0, 4.0) == 2.0 and ft.hill(float("nan"), 1.0, 1.0) == 0.0
    curve = [ft.hill(x, 5.0, 1.5) for x in np.linspace(0, 50, 60)]
    assert all(a < b for a, b in zip(curve, curve[1:], strict=False)) and max(curve) < 1


def test_round_trips_of_states(spark):
    df = spark.createDataFrame([([0.5, -2.0, 3.0],)], "a array<double>")
    back = df.select(ft.lam_to_a(ft.a_to_lam("a", 0.4, [True, False, True]), 0.4, [True, False, True]).alias("b")).first().b
    assert back == pytest.approx([0.5, -2.0, 3.0])
    assert df.select(ft.lam_to_a("a", 0.4).alias("b")).first().b[1] is None
    assert df.select(ft.clipped_lam(F.lit(1000.0))).first()[0] == pytest.approx(math.exp(10))
    assert ft.generate_seed() > 1_600_000_000


def test_schemes(spark):
    s = RegressionScheme(spark).add_regressors(["z", "a"], sign=["+", "-"], scale=2.0)
    t = s.add_regressors(["a", "m"], loc=[1.0, 0.0])
    assert s.regressors() == ["a", "z"] and t.regressors() == ["a", "m", "z"]
    assert [tuple(r) for r in t.table.collect()] == [("a", "=", 1.0, 1.0), ("m", "=", 0.0, 1.0), ("z", "+", 0.0, 2.0)]
    for bad in (lambda: s.add_regressors(["q"], sign="*"), lambda: s.add_regressors(["q"], loc=[1.0, 2.0]), lambda: RegressionScheme.validate(s.table.drop("sign")), lambda: RegressionScheme.validate(s.table.drop("regressor"))):
        with pytest.raises(ValueError):
            bad()


# ---------------------------------------------------------------- priors


def natural(**kw):
    return priors.Priors(**({"a0": [1.5, 2.5], "p0": [0.4, 0.6], "positivity": [False, True], "sigma_q": {"loc": [0.1, 0.2], "scale": [0.3, 0.4]}} | kw))


@pytest.mark.parametrize("match", priors.MATCHES)
def test_moments(spark, match):
    k, (m, v) = 0.4, (2.5, 0.6)
    out = priors.to_ekf(spark, natural(), k, match)
    s2 = math.log1p(v / m**2)
    assert out.a0 == pytest.approx([1.5, (math.log(m) - (s2 / 2 if match == "mean" else 0)) / k])
    assert out.p0 == pytest.approx([0.4, v / (k * m) ** 2 if match == "linearize" else s2 / k**2])
    assert out.sigma_q["loc"] == pytest.approx([0.1, 0.2 / (k * m) if match == "linearize" else math.sqrt(math.log1p(0.04 / m**2)) / k])
    if match == "mean":  # the mean of exp(k a) is the natural mean
        assert math.exp(k * out.a0[1] + k**2 * out.p0[1] / 2) == pytest.approx(m)


def test_covariances_and_observations(spark):
    inf = math.inf
    p = natural(a0=[1.5, 2.5, 0.8], p0=[[0.4, 0.1, 0.05], [0.1, 0.6, 0.02], [0.05, 0.02, 0.3]], positivity=[False, True, True], sigma_q={}, a_obs=[[0.0, 3.0, -1.0], [0.0, 0.0, 2.0]], p_obs=[[inf, 0.2, 0.1], [inf, inf, 0.5]])
    out = priors.to_ekf(spark, p, 0.5, "mean", stacked=True)
    assert out.p0[0][1] == out.p0[1][0] == pytest.approx(0.1 / (0.5 * 2.5))
    assert out.p0[1][2] == pytest.approx(math.log1p(0.02 / (2.5 * 0.8)) / 0.25)
    assert out.p_obs[0][0] == out.p_obs[1][1] == inf and out.a_obs[1][1] == 0.0
    assert out.p_obs[0][2] == pytest.approx(math.log1p(0.1) / 0.25)  # a value under 0 counts as 1


@pytest.mark.parametrize("kw", [{"a0": [1.0, -2.0]}, {"positivity": [True]}, {"a_obs": [[0.0, 0.0]]}, {"p0": [[1.0, 0.0], [0.0, 1.0]]}, {"family": "gamma"}, {"sigma_q": {"loc": [1.0] * 3}}, {"family": "beta", "sigma_q": {"alpha": [1.0, 2.0], "beta": [2.0, 2.0], "scale": [1.0, 1.0]}}])
def test_priors_that_are_errors(spark, kw):
    with pytest.raises(ValueError):
        priors.to_ekf(spark, natural(**kw))
    with pytest.raises(ValueError):
        priors.to_ekf(spark, natural(), match="mode")


def test_disclosed_windows():
    p = priors.disclosed_states(np.arange(120.0).reshape(60, 2).tolist())
    assert 7 <= len(p.obs_idx) <= 21 and np.isinf(np.array(p.p_obs)[:, 0]).all()
    assert np.isfinite(np.array(p.p_obs)[p.obs_idx, 1]).all()


# ---------------------------------------------------------------- estimation


def regression(spark, gaps=()):
    rng = np.random.default_rng(2)
    rows, level = [], 10.0
    for t in range(120):
        level += 0.02
        x, w = float(rng.normal()), float(rng.normal())
        rows.append(("s", t, None if t in gaps else level + 1.5 * x - 0.8 * w + float(rng.normal(0, 0.2)), x, w))
    return rows, spark.createDataFrame(rows, SERIES + ", x double, w double")


def test_gram_rows_are_the_residuals(spark):
    rows, df = regression(spark, gaps=(5, 50, 51))
    r = estimate.gram(estimate.basis(df, 0.1, 0.05, 0.8, ["w", "x"]), 2).first()
    y = np.array([np.nan if v is None else v for _, _, v, _, _ in rows])
    beta = np.array([-0.8, 1.5])
    x = np.array([[w, x] for *_, x, w in rows])
    rest = y - x @ beta
    direct = (rest - kernels.dlt_scan(rest[None], 0.1, 0.05, 0.8)[2][0])[~np.isnan(y)]
    g = np.zeros((3, 3))
    g[np.triu_indices(3)] = r.g
    full = g + np.triu(g, 1).T
    one = np.array([1, *-beta])
    assert one @ full @ one == pytest.approx(direct @ direct, abs=1e-8)
    assert (r.n, r.steps) == (117, 120)
    assert one @ np.array(r.level) == pytest.approx(kernels.dlt_scan(rest[None], 0.1, 0.05, 0.8)[0][0, -1])


def test_posterior_finds_the_coefficients(spark):
    _, df = regression(spark)
    fits = estimate.fit_dlt(df, 0.1, 0.05, 0.8, scheme={"x": ("+", 0.0, 5.0), "w": ("-", 0.0, 5.0)}, warmup=100, draws=200, chains=2).cache()
    r = fits.agg(F.avg(F.col("coef")[0]).alias("w"), F.avg(F.col("coef")[1]).alias("x"), F.avg("sigma").alias("s"), F.min(F.col("coef")[1]).alias("low")).first()
    assert (r.w, r.x) == pytest.approx((-0.8, 1.5), abs=0.1) and 0.15 < r.s < 0.3 and r.low > 0
    assert fits.first().regressors == ["w", "x"] and fits.count() == 400
    again = estimate.fit_dlt(df.repartition(3), 0.1, 0.05, 0.8, scheme={"x": ("+", 0.0, 5.0), "w": ("-", 0.0, 5.0)}, warmup=100, draws=200, chains=2)
    assert sorted(map(str, again.select("draw", "sigma").collect())) == sorted(map(str, fits.select("draw", "sigma").collect()))


def test_gibbs_is_the_grid_posterior():
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 0.1 * x + rng.normal(0, 0.5, 60)
    b, s = estimate.gibbs(np.array([[x @ x]]), np.array([x @ y]), float(y @ y), 60, ["+"], [0.0], [1.0], rng, 200, 6000)
    grid_b, grid_s = np.linspace(1e-4, 1, 400)[:, None], np.linspace(0.2, 1.2, 400)[None]
    rss = y @ y - 2 * grid_b * (x @ y) + grid_b**2 * (x @ x)
    log_p = -60 * np.log(grid_s) - rss / (2 * grid_s**2) - grid_b**2 / 2 - grid_s**2 / 50
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    assert b.mean() == pytest.approx(float((p * grid_b).sum()), abs=0.01)
    assert s.mean() == pytest.approx(float((p * grid_s).sum()), abs=0.01)


def test_inference(spark):
    _, df = regression(spark)
    found = estimate.basis(df, 0.1, 0.05, 0.8)
    fits = estimate.fit_dlt(df, 0.1, 0.05, 0.8, warmup=20, draws=10, chains=2).cache()
    flat = estimate.make_inference(fits, found, 0.1, 0.05, 0.8, end_step=130, evolve=False)
    assert flat.count() == 20 * 130
    closed = estimate.forecast_dlt(fits, 0.05, 0.8, 10).select("series_id", "chain", "draw", (F.col("t") + 120).alias("t"), F.col("component").alias("c"))
    assert flat.join(closed, ["series_id", "chain", "draw", "t"]).agg(F.max(F.abs(F.col("component") - F.col("c")))).first()[0] < 1e-9
    assert estimate.make_inference(fits, found, 0.1, 0.05, 0.8, end_step=50).agg(F.max("t")).first()[0] == 49
    assert estimate.make_inference(fits, found, 0.1, 0.05, 0.8, end_step=125, transform=F.exp).agg(F.min("forecast")).first()[0] > 0
    with pytest.raises(ValueError):
        estimate.make_inference(fits, found, 0.1, 0.05, 0.8)
    told = spark.createDataFrame([("s", 120, 40.0)], SERIES)
    pulled = estimate.components_ahead(fits, 0.1, 0.05, 0.8, 122, noise=False, observed=told).filter("t = 121").first().component
    assert pulled > flat.filter("t = 121").first().component + 1
    coefs, rows = estimate.medians(fits, found)
    assert coefs.count() == 0 and rows.count() == 120 and rows.filter("reg_p50 != 0").count() == 0


def test_errors_of_fits(spark):
    _, df = regression(spark)
    for kw in ({"scheme": {"nothing": ("=", 0.0, 1.0)}}, {"regressors": ["x"], "scheme": {"w": ("=", 0.0, 1.0)}}):
        with pytest.raises(ValueError):
            estimate.fit_dlt(df, 0.1, 0.05, 0.8, **kw)


def test_gradient_and_optimum():
    rng = np.random.default_rng(3)
    y, z = rng.normal(0, 0.3, (2, 30)), np.column_stack([np.ones(30), np.arange(30) % 2])
    theta = rng.normal(-2, 0.3, (2, 3))
    _, g = estimate._loss_gradient(theta, y, z)
    for j in range(3):
        e = np.zeros((2, 3))
        e[:, j] = 1e-5
        central = (estimate._loss_gradient(theta + e, y, z)[0] - estimate._loss_gradient(theta - e, y, z)[0]) / 2e-5
        assert np.allclose(g[:, j], central, rtol=1e-5, atol=1e-6)
    best, loss = estimate.adam(y, z, 300)
    one, alone = estimate.adam(y[:1], z, 300)
    assert np.allclose(best[:1], one) and loss[0] == pytest.approx(alone[0])
    raw = np.log(np.expm1(best))
    assert np.allclose(estimate._loss_gradient(raw, y, z)[0], loss, atol=1e-8)


def test_saved_parameters_forecast_again(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{i}", t, float(20 + 5 * (t % 7 == i) + rng.normal())) for i in range(3) for t in range(40 + i)]
    sales = spark.createDataFrame(rows, "series_id string, t long, sales double")
    fits = estimate.fit_map(sales, iterations=40).cache()
    direct = {(r.series_id, r.t): r.forecast for r in estimate.forecast_seasonal(fits, 28).collect()}
    again = {(r.series_id, r.t): r.forecast for r in estimate.refilter(sales, fits).collect()}
    assert again == pytest.approx(direct) and len(direct) == 84 and min(t for s, t in direct if s == "s2") == 42
    with pytest.raises(ValueError):
        estimate.refilter(sales, fits, horizon=10)
    with pytest.raises(Exception, match="one step"):
        estimate.refilter(sales.filter("t = 0"), fits).collect()


def test_noise_priors():
    p = estimate.NoisePrior()
    assert p.log_density(np.array([2.0, 0.05, 0.01])) == -math.inf
    assert p.log_density(np.array([0.1, 0.05, 0.01])) == 0.0
    b = estimate.NoisePrior("beta", (2.0, 10.0, 3.0), (2.0, 4.0, 1.0), (2.0, 4.0, 1.0))
    assert np.isfinite(b.log_density(b.start(4))) and b.log_density(np.array([3.1, 0.1, 0.1])) == -math.inf
    for bad in (("gamma",), ("beta",)):
        with pytest.raises(ValueError):
            estimate.NoisePrior(*bad)


def test_wbic_by_hand():
    y, c = np.array([1.0, 2.0, np.nan, 4.0]), np.array([[1.0, 1.0, 2.0, 2.0]])
    got = estimate.wbic(y, c, np.zeros((1, 4)), np.array([0.5]), 2)
    ll = [-0.5 * math.log(2 * math.pi) - math.log(0.5) - 0.5 * (e / 0.5) ** 2 for e in (0.0, 1.0, 1.0, 2.0)]
    assert got == pytest.approx(-math.log(6) * np.mean(ll))
    assert np.isfinite(estimate.wbic(y, c, np.zeros((1, 4)), np.array([0.5]), 1))


def test_seasonal_gradient_and_bounds(spark):
    """Seven states of which a step sees two; bounds hold for what a fit gives."""
    rng = np.random.default_rng(6)
    y, z = rng.normal(0, 0.3, (3, 40)), estimate.season_design(np.arange(3, 43), 7, True)
    theta = rng.normal(-2, 0.3, (3, 3))
    loss, g = estimate._loss_gradient(theta, y, z)
    sigma = np.logaddexp(0, theta)
    q = np.column_stack([sigma[:, 1:2], np.repeat(sigma[:, 2:], 6, 1)])
    assert np.allclose(loss, -kernels.kalman_filter(y, z, np.zeros(7), np.ones(7), sigma[:, 0], q)["log_p"])
    for j in range(3):
        e = np.zeros((3, 3))
        e[:, j] = 1e-5
        central = (estimate._loss_gradient(theta + e, y, z)[0] - estimate._loss_gradient(theta - e, y, z)[0]) / 2e-5
        assert np.allclose(g[:, j], central, rtol=1e-5, atol=1e-6)
    sales = spark.createDataFrame([("s", t, float(abs(rng.normal(5, 3)))) for t in range(40)], "series_id string, t long, sales double")
    r = estimate.fit_map(sales, iterations=30, bounds=((0.35, 0.4), (0.01, 0.02), (0.05, 0.06))).first()
    assert 0.35 <= r.sigma_h <= 0.4 + 1e-12 and 0.01 - 1e-12 <= r.sigma_level <= 0.02 and 0.05 - 1e-12 <= r.sigma_season <= 0.06 + 1e-12


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_fits_shuffle_their_panel_once(spark):
    _, df = regression(spark)
    z = df.withColumns({"z": F.array(F.lit(1.0)), "z0": F.lit(1.0), "sales": F.col("y")})
    draws = spark.createDataFrame([("s", 0, d, 0.3, [0.2]) for d in range(3)], "series_id string, chain int, draw int, sigma_h double, sigma_q array<double>")
    params = spark.createDataFrame([("s", 0.3, 0.1, 0.1)], "series_id string, sigma_h double, sigma_level double, sigma_season double")
    assert exchanges(estimate.tune_dlt(df, trials=4, refine=2, regressors=["x"])) == 1
    assert exchanges(estimate.fit_mcmc(z, ["z0"], warmup=2, draws=2)) == 1
    assert exchanges(estimate.refilter(z, params)) == 1
    assert exchanges(scan.smoothed_draws(z, draws, [0.0], [1.0])) == 2  # the history's and the draws'


def test_chains_do_not_meet(spark):
    """A series' draws are the same whatever series come with it."""
    rng = np.random.default_rng(8)
    rows = [(f"s{i}", t, float(rng.normal(i)), 1.0) for i in range(3) for t in range(25)]
    df = spark.createDataFrame(rows, SERIES + ", z0 double")
    kw = {"warmup": 15, "draws": 5, "chains": 2}
    both = {(r.series_id, r.chain, r.draw): (r.sigma_h[0], r.log_p) for r in estimate.fit_mcmc(df, ["z0"], **kw).collect()}
    one = {(r.series_id, r.chain, r.draw): (r.sigma_h[0], r.log_p) for r in estimate.fit_mcmc(df.filter("series_id = 's1'"), ["z0"], **kw).collect()}
    assert len(both) == 30 and len(one) == 10 and all(both[k] == pytest.approx(v) for k, v in one.items())
    h, q = estimate.fit_mcmc(df, ["z0"], **kw).filter("series_id = 's2' and chain = 1 and draw = 4").select("sigma_h", "sigma_q").first()
    direct = kernels.kalman_filter(np.array([[v for s, _, v, _ in rows if s == "s2"]]), np.ones((25, 1)), [0.0], [1.0], h[0], q)
    assert both["s2", 1, 4][1] == pytest.approx(float(direct["log_p"][0]))


def test_metropolis_is_the_grid_posterior():
    rngs = [np.random.default_rng(i) for i in range(6)]
    got = estimate.adaptive_metropolis(lambda x: -0.5 * (((x - [1.0, -2.0]) / [0.5, 2.0]) ** 2).sum(1), np.zeros((6, 2)), rngs, 500, 3000)
    assert got.mean((0, 1)) == pytest.approx([1.0, -2.0], abs=0.15) and got.std((0, 1)) == pytest.approx([0.5, 2.0], rel=0.1)


def test_level_with_outer_regression(spark):
    rng = np.random.default_rng(9)
    level, rows = np.cumsum(rng.normal(0, 0.05, 90)), []
    for t in range(90):
        x, w = float(rng.normal()), float(rng.normal())
        rows.append(("s", t, float(level[t] + 0.7 * x - 1.2 * w + rng.normal(0, 0.05)), x, w))
    df = spark.createDataFrame(rows, SERIES + ", x double, w double")
    fits = estimate.fit_level_regression(df, ["x", "w"], warmup=60, draws=60, chains=2).cache()
    r = fits.agg(F.avg(F.col("beta")[0]).alias("x"), F.avg(F.col("beta")[1]).alias("w"), F.count("*").alias("n")).first()
    assert (r.x, r.w) == pytest.approx((0.7, -1.2), abs=0.05) and r.n == 120
    # the likelihood with the coefficients integrated out, as one dense Gaussian: a level of variance
    # 1 + q^2 t at step t, coefficients of variance 100
    first = fits.first()
    t = np.arange(90)
    x = np.array([[a, b] for *_, a, b in rows])
    cov = 1 + first.sigma_q**2 * np.minimum(t[:, None], t) + 100 * x @ x.T + first.sigma_h**2 * np.eye(90)
    y = np.array([v for _, _, v, _, _ in rows])
    assert first.log_p == pytest.approx(-0.5 * (90 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + y @ np.linalg.solve(cov, y)), abs=1e-6)
    mean = estimate.level_regression_mean(df, fits.filter("chain = 0 and draw < 2"), ["x", "w"]).collect()
    assert len(mean) == 180 and np.mean([abs(m.mu - y[m.t]) for m in mean]) < 0.2
    last = {(m.chain, m.draw): m.level for m in mean if m.t == 89}
    assert all(last[f.chain, f.draw] == pytest.approx(f.a_last) for f in fits.filter("chain = 0 and draw < 2").collect())


def test_trend_with_a_global_line(spark):
    rng = np.random.default_rng(10)
    rows = [("s", t, 0.5 + 1.2 * t / 100 + 0.3 * math.cos(t) + float(rng.normal(0, 0.05)), t / 100, math.cos(t)) for t in range(100)]
    df = spark.createDataFrame(rows, SERIES + ", glb double, c double")
    fits = estimate.fit_dlt_global(df, 0.05, 0.05, 0.5, seasonal=["c"], warmup=80, draws=80, chains=2)
    r = fits.agg(F.avg(F.col("coef")[0]).alias("c"), F.max("sigma").alias("s"), F.first("regressors").alias("names")).first()
    assert r.names == ["c", "glb", "one"] and r.c == pytest.approx(0.3, abs=0.05) and r.s < 0.2


def test_spans_are_windows_in_numpy(spark):
    rows, df = regression(spark, gaps=(7, 60))
    found = estimate.basis(df, 0.1, 0.05, 0.8, ["w", "x"])
    points = spark.createDataFrame([("s", 0, 0, 0.4, [-0.8, 1.4]), ("s", 0, 1, 0.6, [-0.7, 1.6])], "series_id string, chain int, draw int, sigma double, coef array<double>")
    fitted = estimate.in_sample(points, found).cache()
    out = estimate.span_log_likelihood(estimate.forecast_spans(fitted, 6))
    y = np.array([np.nan if v is None else v for _, _, v, _, _ in rows])
    each = {d: sorted((r.t, r.component, r.reg_total) for r in fitted.filter(F.col("draw") == d).collect()) for d in (0, 1)}
    component, reg = (np.array([[r[k] for r in each[d]] for d in (0, 1)]) for k in (1, 2))
    assert out.count() == 2 * 115 * 6
    assert estimate.wbic_of_spans(out).first().wbic == pytest.approx(estimate.wbic(y, component, reg, np.array([0.4, 0.6]), 6))
    joint = {r.draw: r for r in estimate.log_joint(estimate.gram(found, 2), points, ["w", "x"], [["-", "="], [-1.0, 0.0], [1.0, 2.0]]).collect()}
    for r in points.collect():
        rest = np.array([v.resid for v in fitted.filter(F.col("draw") == r.draw).orderBy("t").collect() if v.resid is not None], float)
        assert joint[r.draw].log_likelihood == pytest.approx(float((-0.5 * math.log(2 * math.pi) - math.log(r.sigma) - 0.5 * (rest / r.sigma) ** 2).sum()))
        normal = lambda v, m, s: -0.5 * math.log(2 * math.pi) - math.log(s) - 0.5 * ((v - m) / s) ** 2
        mass = 0.5 * math.erfc(-1.0 / math.sqrt(2))  # of N(-1, 1) under 0
        assert joint[r.draw].log_prior == pytest.approx(normal(r.coef[0], -1, 1) - math.log(mass) + normal(r.coef[1], 0, 2) + math.log(2) + normal(r.sigma, 0, 5))


# ---------------------------------------------------------------- hierarchies and whole tables


def retail(seed: int = 3):
    rng, rows = np.random.default_rng(seed), []
    for i in range(6):
        for st in range(4):
            zero = i == 2
            for t in range(20):
                rows.append((f"st{st // 2}", f"w{st}", f"c{i // 4}", f"d{i // 2}", f"i{i}", t, 0.0 if zero or rng.random() < 0.2 else float(rng.integers(1, 9)), None if (i, st, t) == (3, 1, 13) else float(1 + i)))
    return rows


def test_twelve_levels_by_hand(spark):
    """Scores and bias by dollars in NumPy, with a series that sells nothing and one without a price."""
    from tidegauge.plans.catalog import KEYS, LEVELS, WITHIN

    rows, h = retail(), 5
    df = spark.createDataFrame(rows, "state string, store string, cat string, dept string, item string, t int, sales double, price double")
    train, valid = df.filter("t < 15"), df.filter("t >= 15").withColumn("forecast", F.lit(3.0) + F.length("item"))
    sales, price = {}, {}
    for *k, t, s, p in rows:
        sales.setdefault(tuple(k), []).append(s)
        price.setdefault(tuple(k), []).append(p)
    dollars = {k: 0.0 if None in price[k][10:15] else sum(s * p for s, p in zip(v[10:15], price[k][10:15], strict=True)) for k, v in sales.items()}
    for within in (None, WITHIN):
        got = {r.level: r for r in scoring.wrmsse(train, valid, LEVELS, KEYS, h, within).collect()}
        for i, lv in enumerate(LEVELS, 1):
            groups: dict = {}
            for k in sales:
                groups.setdefault(tuple(k[KEYS.index(c)] for c in lv), []).append(k)
            stats = []
            for own in groups.values():
                y, f = sum(np.array(sales[k]) for k in own), 5.0 * len(own)
                scale = np.mean(np.diff(y[:15]) ** 2) or 1.0
                a = y[15:].mean()
                stats.append((sum(dollars[k] for k in own), math.sqrt(np.mean((f - y[15:]) ** 2) / scale), a, f, f - a, 100 * (f - a) / (a or 1.0)))
            s = np.array(stats)
            w = s[:, 0] / s[:, 0].sum()
            want = [len(s), (w * s[:, 1]).sum(), s[:, 1].mean(), *(w @ s[:, 2:])]
            assert [got[i][c] for c in ("n_series", "wrmsse", "mean_rmsse", "actual_mean", "forecast_mean", "bias_signed", "bias_pct")] == pytest.approx(want), (i, within)
    none = scoring.wrmsse(train.withColumn("price", F.lit(None).cast("double")), valid, [[], ["item"]], KEYS, h).collect()
    assert all(r.wrmsse == pytest.approx(r.mean_rmsse) for r in none)


def test_levels_from_a_waist_are_grouping_sets(spark):
    from tidegauge.plans.catalog import KEYS, LEVELS, WITHIN

    df = spark.createDataFrame(retail(4), "state string, store string, cat string, dept string, item string, t int, sales double, price double")
    rows = lambda within: sorted(map(str, scoring.hierarchy_sums(df, LEVELS, ["t"], ["sales"], within).select("level", *KEYS, "t", "sales").collect()))
    assert rows(WITHIN) == rows(None) and len(rows(None)) == 20 * (1 + 2 + 4 + 2 + 3 + 4 + 6 + 8 + 12 + 6 + 12 + 24)


def test_whole_quantiles_are_numpy(spark):
    rng = np.random.default_rng(1)
    for values in ([float(v) for v in rng.normal(size=500)], [1.0] * 40 + [2.0, 3.0], [5.0], [float(v) for v in rng.integers(0, 4, 300)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
        qs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
        assert scoring.whole_quantiles(df, "v", qs) == pytest.approx(np.quantile(values, qs).tolist())
    assert scoring.whole_quantiles(df.limit(0), "v", [0.5]) == [None]


# ---------------------------------------------------------------- scores, sources, stream


def test_diagnostics(spark):
    rng = np.random.default_rng(5)
    rows = [(k, c, d, float(rng.normal() + (c if k == "apart" else 0))) for k in ("good", "apart") for c in range(4) for d in range(300)]
    got = {r.k: r for r in scoring.summary(spark.createDataFrame(rows, "k string, chain int, draw int, v double"), ["k"], "v").collect()}
    assert got["good"].converged and not got["apart"].converged
    assert got["good"].r_hat < 1.02 < got["apart"].r_hat and 700 < got["good"].ess_bulk < 1600 > got["apart"].ess_bulk
    assert got["good"].mcse_mean == pytest.approx(got["good"].sd / math.sqrt(got["good"].n_eff))
    slow = np.cumsum(rng.normal(size=(4, 400)), 1)
    assert scoring.effective_size(slow) < 100


def test_errors_of_sources(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, F1 double")
    for bad in (lambda: src.checked_submission(a, 2), lambda: src.checked_submission(a, 1, 3), lambda: src.align_by_id(a, a.filter("id = 1"), "id"), lambda: src.posterior_long(a, "F1"), lambda: src.posterior_long(a, "F1", ["F1"], ["F1"]), lambda: src.posterior_long(a, ["F1"], drop=["F1"]), lambda: scoring.state_ribbons(a, [], [])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        src.matched(a, a.filter("id = 1"), "id")
    with pytest.raises(FileNotFoundError):
        src.read_first(spark, [src.scratch(spark, "none")], "a int")
    with pytest.raises(ValueError):
        src.submission(spark.createDataFrame([("x", 1)], "id string, place int"), spark.createDataFrame([("y_validation", 1.0)], "id string, F1 double"), 1)


def test_settings():
    assert RunConfig.from_arguments(["--n-series", "5", "--rate", "0.1"]) == RunConfig(n_series=5, rate=0.1)
    for bad in ({"sample_mode": "some"}, {"horizon": 0}):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_stream_is_the_batch(spark, tmp_path):
    data, df = panel(spark, 3)
    folder = f"file://{tmp_path}/in"
    for part in (df.filter("t < 4"), df.filter("t >= 4 and t < 9"), df.filter("t >= 9")):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SERIES).parquet(folder)
        run = streamed_components(stream, 0.3, 0.2, 0.9).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = {(r.series_id, r.t): (r.level, r.component) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r.series_id, r.t): (r.level, r.component) for r in scan.dlt_components(df, 0.3, 0.2, 0.9).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
