"""Registered queries over given posterior draws and parameters, which SQL can follow, and of the models
beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.scheme import RegressionScheme
from ..operators import estimate, scan, scoring
from ..sources import panel as src
from ..sources.panel import scratch
from . import catalog as c
from . import oracles as sql
from .registry import query

# ---------------------------------------------------------------- the trend under given draws

#: chain, draw, sigma, the coefficient of cos(t), and a standard normal number.
_POINTS = [(0, 0, 0.8, 0.5, 0.3), (0, 1, 1.0, -0.3, -1.1), (1, 0, 1.2, 0.2, 0.7)]
_DR = "dr AS (SELECT CAST(chain AS INT) AS chain, CAST(draw AS INT) AS draw, sigma, coef, z FROM (VALUES " + ", ".join(f"({a}, {b}, {s}::DOUBLE, {k}::DOUBLE, {z}::DOUBLE)" for a, b, s, k, z in _POINTS) + ") v(chain, draw, sigma, coef, z))"
_SCAN = f"WITH RECURSIVE {sql.basis_cte(c.EV, *c._DLT)}, {_DR}"
_FIT = f"{_SCAN}, fit AS (SELECT series_id, chain, draw, t, y, c - coef * c_x AS component, coef * x AS reg, sigma, z FROM scan CROSS JOIN dr)"
_H = 5


def _fixed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trend's basis, its Gram rows, and the given draws of each series as fits."""
    found = src.saved(estimate.basis(c._with_x(spark, d), *c._DLT, ["x1"]), scratch(spark, "basis"))
    sums = estimate.gram(found, 1)
    points = spark.createDataFrame([(a, b, s, [k], z) for a, b, s, k, z in _POINTS], "chain int, draw int, sigma double, coef array<double>, z double")
    rest = lambda v: F.col(v)[0] - F.col("coef")[0] * F.col(v)[1]
    fits = sums.crossJoin(F.broadcast(points)).select("series_id", "chain", "draw", "sigma", rest("level").alias("last_level"), rest("slope").alias("last_slope"), "coef", F.array(F.lit("x1")).alias("regressors"), "steps", "z")
    return found, sums, fits


@query("e1_log_joint", f"{_FIT}, l AS (SELECT series_id, chain, draw, sum(-0.5 * ln(2 * pi()) - ln(sigma) - 0.5 * pow((y - component - reg) / sigma, 2)) AS ll FROM fit GROUP BY ALL) SELECT series_id, chain, draw, round(ll, 4) AS log_likelihood, round(CASE WHEN coef < 0 THEN -1e9 ELSE ln(2 / sqrt(2 * pi()) / 2) - 0.5 * pow(coef / 2, 2) END + ln(2 / sqrt(2 * pi()) / 5) - 0.5 * pow(sigma / 5, 2), 6) AS log_prior FROM l JOIN dr USING (chain, draw)")
def e1(spark, d):
    _, sums, fits = _fixed(spark, d)
    out = estimate.log_joint(sums, fits, ["x1"], [["+"], [0.0], [2.0]])
    own = F.when(F.col("log_prior") == float("-inf"), -1e9 + F.lit(_half(5.0)) - F.col("sigma") * F.col("sigma") / 50).otherwise(F.col("log_prior"))
    return out.join(fits.select("series_id", "chain", "draw", "sigma"), ["series_id", "chain", "draw"]).select("series_id", "chain", "draw", c.r(F.col("log_likelihood"), "log_likelihood", 4), c.r(own, "log_prior"))


def _half(scale: float) -> float:
    import math

    return math.log(2 / math.sqrt(2 * math.pi) / scale)


@query("k3_e4_components_ahead", f"{_SCAN}, {sql.ahead_cte(*c._DLT, 44, 't = 33|7.5')} SELECT series_id, chain, draw, t, round(c, 6) AS component FROM ahead WHERE t >= 30")
def e4(spark, d):
    fits = _fixed(spark, d)[2]
    known = fits.select("series_id").distinct().select("series_id", F.lit(33).cast("long").alias("t"), F.lit(7.5).alias("y"))
    out = estimate.components_ahead(fits, *c._DLT, 44, noise=False, observed=known)
    return out.select("series_id", "chain", "draw", "t", c.r(F.col("component"), "component"))


@query("e5_forecast_of_draws", f"{_SCAN}, l AS (SELECT * FROM scan JOIN (SELECT series_id, max(t) AS t FROM scan GROUP BY series_id) USING (series_id, t)), a AS (SELECT series_id, chain, draw, CAST(h AS INT) AS t, level - coef * level_x + (slope - coef * slope_x) * {c._DLT[2]} * (1 - pow({1 - c._DLT[1] * (1 - c._DLT[2])!r}, h + 1)) / {c._DLT[1] * (1 - c._DLT[2])!r} AS component, coef * cos(30 + h) AS reg FROM l CROSS JOIN dr CROSS JOIN (SELECT unnest(generate_series(0, 13)) AS h)) SELECT series_id, chain, draw, t, round(component, 5) AS component, round(component + reg, 5) AS forecast FROM a")
def e5(spark, d):
    fits = _fixed(spark, d)[2]
    future = fits.select("series_id").distinct().crossJoin(spark.range(14).select(F.col("id").alias("t"), F.cos(F.col("id") + 30).alias("x1")))
    out = estimate.forecast_dlt(fits, c._DLT[1], c._DLT[2], 14, future)
    return out.select("series_id", "chain", "draw", "t", c.r(F.col("component"), "component", 5), c.r(F.col("forecast"), "forecast", 5))


_LL = f"{_FIT}, sp AS (SELECT a.series_id, a.chain, a.draw, a.t, CAST(b.t - a.t AS INT) AS h, a.component + b.reg AS yhat, -0.5 * ln(2 * pi()) - ln(a.sigma) - 0.5 * pow((b.y - a.component - b.reg) / a.sigma, 2) AS ll FROM fit a JOIN fit b ON a.series_id = b.series_id AND a.chain = b.chain AND a.draw = b.draw AND b.t BETWEEN a.t AND a.t + {_H - 1} WHERE a.t <= (SELECT max(t) - {_H - 1} FROM fit m WHERE m.series_id = a.series_id))"


def _spans(spark, d) -> DataFrame:
    found, _, fits = _fixed(spark, d)
    return estimate.span_log_likelihood(estimate.forecast_spans(estimate.in_sample(fits, found), _H))


@query("e15_e16_span_log_likelihood", f"{_LL} SELECT series_id, chain, draw, t, h, round(yhat, 5) AS yhat, round(ll, 5) AS log_likelihood FROM sp")
def e15(spark, d):
    return _spans(spark, d).select("series_id", "chain", "draw", "t", "h", c.r(F.col("yhat"), "yhat", 5), c.r(F.col("log_likelihood"), "log_likelihood", 5))


@query("e17_wbic", f"{_LL}, m AS (SELECT series_id, chain, draw, avg(ll) AS m, count(*) AS n FROM sp GROUP BY ALL) SELECT series_id, round(-ln(max(n)) * avg(m), 5) AS wbic FROM m GROUP BY series_id")
def e17(spark, d):
    return estimate.wbic_of_spans(_spans(spark, d)).select("series_id", c.r(F.col("wbic"), "wbic", 5))


@query("s15_predictive_interval", f"{_FIT} SELECT series_id, t, {', '.join(f'round(quantile_cont(exp((component + reg + sigma * z) / 10) * 3, {q}), 5) AS {n}' for q, n in ((0.05, 'q05'), (0.5, 'q50'), (0.95, 'q95')))} FROM fit GROUP BY series_id, t")
def s15(spark, d):
    found, _, fits = _fixed(spark, d)
    drawn = estimate.in_sample(fits, found).join(F.broadcast(fits.select("series_id", "chain", "draw", "z")), ["series_id", "chain", "draw"])
    drawn = drawn.withColumns({"mean": F.col("yhat") / 10, "noise": F.col("sigma") * F.col("z") / 10})
    out = scoring.predictive_interval(drawn, ["series_id", "t"], "mean", "noise", F.lit(3.0))
    return out.select("series_id", "t", *(c.r(F.col(q), q, 5) for q in ("q05", "q50", "q95")))


# ---------------------------------------------------------------- states under given draws

_NOISE = [(0, 0, 0.6, [0.2, 0.05, 0.04]), (0, 1, 0.5, [0.3, 0.05, 0.04]), (1, 0, 0.7, [0.1, 0.02, 0.04])]
_SMOOTH = "sm AS (" + " UNION ALL ".join(f"SELECT CAST({a} AS INT) AS chain, CAST({b} AS INT) AS draw, * FROM ({sql.rts_sql(sql.Z3, c._A0, c._P0, h, q).replace(', 6)', ', 13)')})" for a, b, h, q in _NOISE) + ")"
_COS, _SIN = "cos(2 * pi() * t / 7)", "sin(2 * pi() * t / 7)"


def _smoothed(spark, d) -> tuple[DataFrame, DataFrame]:
    draws = spark.createDataFrame(_NOISE, "chain int, draw int, sigma_h double, sigma_q array<double>")
    p = c._panel(spark, d)
    return p, scan.smoothed_draws(p, p.select("series_id").distinct().crossJoin(F.broadcast(draws)), c._A0, c._P0)


@query("k17_smoothed_draws", f"WITH {_SMOOTH} SELECT series_id, chain, draw, t, round(s1 + {_COS} * s2 + {_SIN} * s3, 5) AS mu FROM sm")
def k17(spark, d):
    return _smoothed(spark, d)[1].select("series_id", "chain", "draw", "t", c.r(F.col("mu"), "mu", 5))


@query("j9_s16_attribution", f"WITH {c.EV}, {_SMOOTH}, lo AS (SELECT min(ds) AS lo FROM ev), x AS (SELECT series_id, chain, draw, CAST(floor(date_diff('day', lo, ds) / 7) AS BIGINT) AS week, unnest([0, 1, 2]) AS state, unnest([s1, s2 * {_COS}, s3 * {_SIN}]) AS v FROM sm JOIN ev USING (series_id, t) CROSS JOIN lo), w AS (SELECT series_id, chain, draw, state, week, sum(v) AS v FROM x GROUP BY ALL) SELECT series_id, CAST(state AS INT) AS state, week, {', '.join(f'round(quantile_cont(v, {q}), 4) + 0.0 AS {n}' for q, n in ((0.05, 'q05'), (0.5, 'q50'), (0.95, 'q95')))} FROM w GROUP BY series_id, state, week")
def s16(spark, d):
    p, drawn = _smoothed(spark, d)
    states = drawn.join(p.select("series_id", "t", "ds", "z"), ["series_id", "t"]).withColumnRenamed("a_smooth", "a_nat")
    out = scoring.attribution_ribbons(states, ["series_id"], "ds", 3)
    return out.select("series_id", "state", "week", *((F.round(q, 4) + 0.0).alias(q) for q in ("q05", "q50", "q95")))


@query("e9_e11_map_forecast", f"WITH RECURSIVE {sql.filter_cte(sql.Z3, c._A0, c._P0, c._H, c._Q)}, l AS (SELECT f.* FROM flt f JOIN (SELECT series_id, max(t) AS t FROM flt GROUP BY series_id) USING (series_id, t)), h AS (SELECT unnest(generate_series(0, 27)) AS t) SELECT series_id, h.t, round(exp((a1 + {_COS.replace('t /', 'h.t /')} * a2 + {_SIN.replace('t /', 'h.t /')} * a3 + 0.5 * (p1 + pow({_COS.replace('t /', 'h.t /')}, 2) * p2 + pow({_SIN.replace('t /', 'h.t /')}, 2) * p3 + {c._H * c._H!r})) / 10) * 2, 6) AS forecast FROM l CROSS JOIN h")
def e9(spark, d):
    """The last states of a filter over each series, carried on by the batch's forecast; both in tenths."""
    last = scoring.last_value(scan.filtered(c._panel(spark, d), c._A0, c._P0, c._H, c._Q), ["series_id"], "t", ["a", "p"])
    tenth = lambda v, by: F.transform(v, lambda x: x / by)
    fits = last.select("series_id", F.lit(c._H / 10**0.5).alias("sigma_h"), tenth("a", 10).alias("a_last"), tenth("p", 10).alias("p_last"), F.lit(2.0).alias("response_norm"))
    angle = 2 * F.pi() * F.col("id") / 7
    future = spark.range(28).select(F.col("id").alias("t"), F.array(F.lit(1.0), F.cos(angle), F.sin(angle)).alias("z"))
    return estimate.forecast_map(fits, future).select("series_id", "t", c.r(F.col("forecast"), "forecast"))


_DUMMIES = ["1.0", *(f"CASE WHEN t % 7 = {j} THEN 1.0 ELSE 0.0 END" for j in range(1, 7))]
_SALES = f"{c.EV}, nm AS (SELECT series_id, avg(greatest(y, 0.1)) AS norm FROM ev GROUP BY series_id), panel AS (SELECT series_id, t, ln(greatest(y, 0.1) / norm) AS y FROM ev JOIN nm USING (series_id))"
_SAVED = (0.3, 0.1, 0.05)


@query("i4_s12_saved_parameters", f"WITH RECURSIVE {sql.filter_cte(_DUMMIES, [0.0] * 7, [1.0] * 7, _SAVED[0], [_SAVED[1], *[_SAVED[2]] * 6], panel=_SALES)}, l AS (SELECT f.*, f.t AS last FROM flt f JOIN (SELECT series_id, max(t) AS t FROM flt GROUP BY series_id) USING (series_id, t)), x AS (SELECT l.* EXCLUDE (t), last + h AS t FROM l CROSS JOIN (SELECT unnest(generate_series(1, 28)) AS h)) SELECT series_id, t, round(exp({' + '.join(f'({z}) * a{i}' for i, z in enumerate(_DUMMIES, 1))} + 0.5 * ({' + '.join(f'({z}) * p{i}' for i, z in enumerate(_DUMMIES, 1))} + {_SAVED[0] ** 2!r})) * norm, 3) AS forecast FROM x JOIN nm USING (series_id)")
def i4(spark, d):
    sales = c._sales(spark, d)
    params = sales.select("series_id").distinct().select("series_id", *(F.lit(v).alias(n) for n, v in zip(("sigma_h", "sigma_level", "sigma_season"), _SAVED, strict=True)))
    params = src.saved(params, scratch(spark, "params"))
    return estimate.refilter(sales, params).select("series_id", "t", c.r(F.col("forecast"), "forecast", 3))


# ---------------------------------------------------------------- models

_BETA = {"family": "beta", "h": (2.0, 10.0, 1.0), "level": (2.0, 10.0, 0.1), "other": (2.0, 10.0, 0.1)}


@query("e12_mmm_linear")
def e12(spark, d):
    p = ft.mean_normalised(c.events(spark, d), ["series_id"], ["y"]).withColumns({"z0": F.lit(1.0), "z1": F.abs(F.sin(F.col("t")))})
    fits = estimate.fit_mcmc(p, ["z0", "z1"], positivity=[False, True], prior=estimate.NoisePrior(**_BETA), warmup=40, draws=30, chains=2)
    return fits.groupBy("series_id").agg(F.percentile(F.col("sigma_h")[0], 0.5).alias("sigma_h"), F.percentile(F.col("a_last")[1], 0.5).alias("z1_last"), F.count("*").alias("draws"))


@query("e12_mmm_st")
def e12st(spark, d):
    wide = estimate.NoisePrior(**(_BETA | {"h": (2.0, 10.0, 2.0), "level": (2.0, 10.0, 0.4)}))
    fits = estimate.fit_mcmc_st(c._stacked(spark, d), c._A0, [[1.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.5]], prior=wide, warmup=20, draws=15, chains=2)
    return fits.select("series_id", "chain", "draw", F.col("sigma_q")[0].alias("sigma_level"), "log_p")


@query("e13_level_with_regression")
def e13(spark, d):
    p = c._with_x(spark, d).withColumn("y", F.col("y") / 10)
    fits = src.saved(estimate.fit_level_regression(p, ["x1", "x3"], warmup=60, draws=40, chains=2), scratch(spark, "fits"))
    mean = estimate.level_regression_mean(p, fits, ["x1", "x3"])
    return scoring.quantiles(mean, ["series_id", "t"], "mu")


@query("e20_trend_with_global_line")
def e20(spark, d):
    p = c._with_x(spark, d).withColumns({"y": F.log(F.col("y")), "glb": F.col("t") / 30})
    fits = estimate.fit_dlt_global(p, *c._DLT, seasonal=["x1", "x2"], warmup=40, draws=40, chains=2)
    return fits.groupBy("series_id").agg(*(F.percentile(F.col("coef")[i], 0.5).alias(n) for i, n in enumerate(("glb", "one", "x1", "x2"))))


# ---------------------------------------------------------------- schemes

_ROWS = "(VALUES ('promo', '+', 0.0::DOUBLE, 1.0::DOUBLE), ('price', '-', 0.5, 2.0), ('trend', '=', 0.0, 1.0)) v(regressor, sign, loc_prior, scale_prior)"


def _scheme(spark) -> RegressionScheme:
    return RegressionScheme(spark).add_regressors(["trend", "promo"], sign=["=", "+"]).add_regressors(["price"], sign="-", loc=0.5, scale=2.0)


@query("r1_r2_empty_scheme", "SELECT CAST(NULL AS VARCHAR) AS regressor, CAST(NULL AS VARCHAR) AS sign, CAST(NULL AS DOUBLE) AS loc_prior, CAST(NULL AS DOUBLE) AS scale_prior WHERE false")
def r1(spark, d):
    return RegressionScheme(spark).table


@query("r3_r5_scheme_set_and_added", f"SELECT * FROM {_ROWS}")
def r3(spark, d):
    return RegressionScheme(spark, _scheme(spark).table).table


@query("r6_regressors", f"SELECT regressor, row_number() OVER (ORDER BY regressor) AS place FROM {_ROWS}")
def r6(spark, d):
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(_scheme(spark).regressors())], "regressor string, place long")


# ---------------------------------------------------------------- shared states of two series

_FULL = [[1.0, 0.1, 0.0], [0.1, 0.5, 0.0], [0.0, 0.0, 0.5]]
_PAIR = f"{c.EV}, pair AS (SELECT a.t, a.y / 1000 AS y1, b.y / 1000 AS y2 FROM ev a JOIN ev b USING (t) WHERE a.series_id = (SELECT min(series_id) FROM ev) AND b.series_id = (SELECT max(series_id) FROM ev))"


def _pair(spark, d) -> DataFrame:
    """The first and the last series as one panel; the second has half the first's design."""
    p = c._panel(spark, d)
    ends = p.agg(F.min("series_id").alias("lo"), F.max("series_id").alias("hi")).first()
    one = p.filter(F.col("series_id") == ends.lo).select("t", F.col("y").alias("y1"), "z")
    two = p.filter(F.col("series_id") == ends.hi).select("t", F.col("y").alias("y2"))
    return one.join(two, "t").select(F.lit("pair").alias("panel_id"), "t", F.array("y1", "y2").alias("y"), F.array("z", F.transform("z", lambda x: x / 2)).alias("z"))


def _shared(name: str, **kw) -> None:
    linear = f"WITH RECURSIVE {_PAIR}, {sql.shared_cte(c._A0, _FULL, c._H, c._Q, exponent=kw.get('exponent'), mask=kw.get('positivity'))}"

    @query(name, f"{linear} SELECT t, round(a1, 6) + 0.0 AS a1, round(a2, 6) + 0.0 AS a2, round(a3, 6) + 0.0 AS a3, round(p11, 6) AS p11, round(p12, 6) + 0.0 AS p12, round(p33, 6) AS p33, round((SELECT max_by(log_p, t) FROM flt), 5) AS log_p FROM flt WHERE t >= 0")
    def run(spark, d):
        out = scan.filtered_st(_pair(spark, d), c._A0, _FULL, c._H, c._Q, **kw)
        zero = lambda x, n: (F.round(x, 6) + 0.0).alias(n)
        return out.select("t", *(zero(F.col("a")[i], f"a{i + 1}") for i in range(3)), *(zero(F.col("p")[i], n) for i, n in ((0, "p11"), (1, "p12"), (8, "p33"))), c.r(F.col("log_p"), "log_p", 5))


_shared("k10_kalman_st_pair")
_shared("k11_ekf_st_pair", exponent=0.5, positivity=c._POS)


@query("k16_st_rts_overlay_pair", f"WITH RECURSIVE {_PAIR}, {sql.shared_cte(c._A0, _FULL, c._H, c._Q)}, {sql.shared_rts_cte(c._Q)} SELECT t, round(s1, 6) + 0.0 AS s1, round(s2, 6) + 0.0 AS s2, round(s3, 6) + 0.0 AS s3 FROM back")
def k16(spark, d):
    out = scan.filtered_st(_pair(spark, d), c._A0, _FULL, c._H, c._Q, smooth_diagonal=True)
    return out.select("t", *((F.round(F.col("a_smooth")[i], 6) + 0.0).alias(f"s{i + 1}") for i in range(3)))


# ---------------------------------------------------------------- priors and prices in full


@query("j11_time_point_betas", f"WITH {c.EV}, s AS (SELECT DISTINCT t, ds FROM ev), b AS (SELECT ds AS date, variable, mid FROM (SELECT DISTINCT ds FROM ev WHERE t % 14 = 0) CROSS JOIN (VALUES ('tv', 0.4::DOUBLE), ('radio', NULL)) v(variable, mid)) SELECT t, ds, variable, mid AS a_obs, 0.01::DOUBLE AS p_obs FROM s JOIN b ON b.date = s.ds WHERE t % 14 = 0 AND mid IS NOT NULL")
def j11(spark, d):
    from ..functions import priors

    s = c.events(spark, d).select("t", "ds").distinct()
    known = spark.createDataFrame([("tv", 0.4), ("radio", None)], "variable string, mid double")
    betas = s.filter("t % 14 = 0").select(F.col("ds").alias("date")).distinct().crossJoin(F.broadcast(known))
    return priors.time_point_priors(s, betas, weeks=2)


@query("j1_prices_of_all_days", f"""WITH {c.LI}, cal AS (SELECT unnest(generate_series((SELECT min(ds) FROM li), (SELECT max(ds) FROM li), INTERVAL 1 DAY))::DATE AS ds), wk AS (SELECT ds, CAST(floor(date_diff('day', (SELECT min(ds) FROM li), ds) / 7) AS BIGINT) AS wk FROM cal),
each AS (SELECT series_id, CAST(floor(date_diff('day', (SELECT min(ds) FROM li), ds) / 7) AS BIGINT) AS wk, y FROM li), price AS (SELECT series_id, wk, min(y) AS p FROM each WHERE wk % 3 <> 1 GROUP BY 1, 2) SELECT s.series_id, wk.ds, p AS sell_price FROM (SELECT DISTINCT series_id FROM li) s CROSS JOIN wk LEFT JOIN price USING (series_id, wk)""")
def j1(spark, d):
    """Weekly prices on every day of every series, null in weeks without one, through the retail panel."""
    x = c.lines(spark, d)
    ends = x.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    calendar = ends.select("lo", F.explode(F.sequence("lo", "hi")).alias("date"))
    n = F.datediff("date", "lo")
    calendar = calendar.select("date", F.floor(n / 7).cast("long").alias("wm_yr_wk"), F.concat(F.lit("d_"), n + 1).alias("d"), F.lit(0).alias("snap_x"))
    prices = x.crossJoin(F.broadcast(ends)).select(F.lit("x").alias("store_id"), F.col("series_id").alias("item_id"), F.floor(F.datediff("ds", "lo") / 7).cast("long").alias("wm_yr_wk"), F.col("y").alias("sell_price")).filter("wm_yr_wk % 3 <> 1")
    ids = [F.lit(v).alias(k) for k, v in (("dept_id", "d"), ("cat_id", "c"), ("store_id", "x"), ("state_id", "x"))]
    sales = x.select("series_id").distinct().select(F.concat("series_id", F.lit("_validation")).alias("id"), F.col("series_id").alias("item_id"), *ids, F.lit(1).alias("d_1"))
    return src.retail_panel(calendar, prices, sales).select("series_id", "ds", "sell_price")
