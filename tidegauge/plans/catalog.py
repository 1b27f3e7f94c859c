"""The registered queries of the time-series engine and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import priors
from ..functions.scheme import RegressionScheme
from ..operators import estimate, scan, scoring
from ..sources.panel import align_by_id, daily, gap_filled, indexed, long_to_wide, saved, scratch, submission, table
from . import oracles as sql
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

def r(c: Column, name: str, places: int = 6) -> Column:
    return F.round(c, places).alias(name)


# ---------------------------------------------------------------- panels

EV = "ev AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS ds, round(sum(value), 6) AS y, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) - 1 AS t FROM events GROUP BY event_type, CAST(ts AS DATE))"
LI = "li AS (SELECT l_returnflag || l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS ds, round(sum(l_quantity), 6) AS y FROM lineitem GROUP BY 1, 2)"
OD = "od AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds, round(sum(o_totalprice), 6) AS y FROM orders GROUP BY 1, 2)"


def events(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return indexed(daily(e, F.col("event_type"), F.col("ts"), F.col("value")), ["series_id"], "ds")


def lines(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem")
    return daily(x, F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"), F.col("l_quantity"))


def orders(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return daily(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"))


def steps(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("i"))


# ---------------------------------------------------------------- features


@query("f1_hill", "SELECT p_partkey, round(CASE WHEN x IS NULL THEN NULL WHEN x <= 0 THEN 0.0 ELSE 2.5 * pow(x, 1.7) / (pow(300.0, 1.7) + pow(x, 1.7)) END, 6) AS effect FROM (SELECT p_partkey, p_retailprice - 1200 AS x FROM part)")
def f1(spark, d):
    return table(spark, d, "part").select("p_partkey", r(ft.hill(F.col("p_retailprice") - 1200, 300.0, 1.7, 2.5), "effect"))


@query("f3_log_saturation", "SELECT event_id, round(ln(1 + value / CASE event_type WHEN 'click' THEN 50.0 WHEN 'view' THEN 80.0 ELSE 120.0 END), 6) AS effect FROM events")
def f3(spark, d):
    sat = F.broadcast(spark.createDataFrame([("click", 50.0), ("view", 80.0)], "event_type string, saturation double"))
    return table(spark, d, "events").join(sat, "event_type", "left").select("event_id", r(ft.log_saturation("value", F.coalesce("saturation", F.lit(120.0))), "effect"))


def _waves(columns: list[Column], names: list[str]) -> list[Column]:
    return [r(c, n) for c, n in zip(columns, names, strict=True)]


_CS = ["cos_1", "cos_2", "sin_1", "sin_2"]


@query("f4_fourier_index", "SELECT i, round(cos(2 * pi() * (i + 3) / 7), 6) + 0.0 AS cos_1, round(cos(4 * pi() * (i + 3) / 7), 6) + 0.0 AS cos_2, round(sin(2 * pi() * (i + 3) / 7), 6) + 0.0 AS sin_1, round(sin(4 * pi() * (i + 3) / 7), 6) + 0.0 AS sin_2 FROM (SELECT event_id AS i FROM events)")
def f4(spark, d):
    return steps(spark, d).select("i", *_waves(ft.fourier_index("i", 7, 2, 2), _CS))


@query("f5_fourier_timestamp", "SELECT event_id, round(cos(2 * pi() * x / 365.25), 6) + 0.0 AS cos_1, round(cos(4 * pi() * x / 365.25), 6) + 0.0 AS cos_2, round(sin(2 * pi() * x / 365.25), 6) + 0.0 AS sin_1, round(sin(4 * pi() * x / 365.25), 6) + 0.0 AS sin_2 FROM (SELECT event_id, floor(epoch(ts)) / 86400.0 AS x FROM events)")
def f5(spark, d):
    return table(spark, d, "events").select("event_id", *_waves(ft.fourier_timestamp("ts", 365.25, 2), _CS))


@query("f6_fourier_steps", "SELECT i, round(sin(2 * pi() * i / 30.5), 6) + 0.0 AS sin_1, round(sin(4 * pi() * i / 30.5), 6) + 0.0 AS sin_2, round(cos(2 * pi() * i / 30.5), 6) + 0.0 AS cos_1, round(cos(4 * pi() * i / 30.5), 6) + 0.0 AS cos_2 FROM (SELECT event_id AS i FROM events)")
def f6(spark, d):
    return steps(spark, d).select("i", *_waves(ft.fourier_steps("i", 30.5, 2), ["sin_1", "sin_2", "cos_1", "cos_2"]))


@query("f7_periodic_dummies", "SELECT i, " + ", ".join(f"CAST(i % 5 = {j} AS DOUBLE) AS period_{j}" for j in range(1, 5)) + " FROM (SELECT event_id AS i FROM events)")
def f7(spark, d):
    return steps(spark, d).select("i", *ft.periodic_dummies("i", 5))


@query("f8_weekday_dummies", f"WITH {OD} SELECT series_id, ds, " + ", ".join(f"CAST(isodow(ds) - 1 = {j} AS DOUBLE) AS dow_{j}" for j in range(1, 7)) + " FROM od")
def f8(spark, d):
    return orders(spark, d).select("series_id", "ds", *ft.weekday_dummies("ds"))


@query("f9_global_trend", f"WITH {EV} SELECT series_id, t, 1.0::DOUBLE AS intercept, round((t + 100) / 365.25, 6) AS slope FROM ev")
def f9(spark, d):
    one, slope = ft.global_trend("t", 100)
    return events(spark, d).select("series_id", "t", one, r(slope, "slope"))


@query("f10_log_response", f"WITH {EV} SELECT series_id, t, round(n, 4) AS response_norm, round(ln(greatest(y, 0.1) / n), 6) AS response FROM (SELECT *, avg(greatest(y, 0.1)) OVER (PARTITION BY series_id) AS n FROM ev)")
def f10(spark, d):
    return ft.log_response(events(spark, d), ["series_id"], "y").select("series_id", "t", r(F.col("response_norm"), "response_norm", 4), r(F.col("response"), "response"))


@query("f11_mean_normalised", f"WITH {EV} SELECT series_id, t, round(y / avg(y) OVER (PARTITION BY series_id), 6) AS y FROM ev")
def f11(spark, d):
    return ft.mean_normalised(events(spark, d), ["series_id"], ["y"]).select("series_id", "t", r(F.col("y"), "y"))


@query("f12_offset_first", "SELECT l_orderkey, l_partkey, l_suppkey, round(l_quantity + l_discount, 6) AS z0, round(l_extendedprice, 6) AS z1 FROM lineitem")
def f12(spark, d):
    z = ft.offset_first(["l_quantity", "l_discount"], ["l_extendedprice"])
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", r(z[0], "z0"), r(z[1], "z1"))


@query("f13_date_parts", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS TINYINT) AS dow, CAST(day(o_orderdate) AS TINYINT) AS dom, CAST(month(o_orderdate) AS TINYINT) AS month FROM orders")
def f13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *ft.date_parts("o_orderdate"))


@query("f14_split_label", "SELECT o_orderkey, CASE WHEN n <= 1913 THEN 'train' WHEN n <= 1941 THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders)")
def f14(spark, d):
    n = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", ft.split_label(F.concat(F.lit("d_"), n)).alias("split"))


@query("f15_suffixes", "SELECT p_partkey, p_brand AS stem, p_brand || '_evaluation' AS swapped FROM part")
def f15(spark, d):
    named = F.concat("p_brand", F.lit("_validation"))
    return table(spark, d, "part").select("p_partkey", ft.strip_suffix(named).alias("stem"), ft.swap_suffix(named).alias("swapped"))


@query("f16_missing_regressors", f"WITH {LI}, days AS (SELECT unnest(generate_series((SELECT min(ds) FROM li), (SELECT max(ds) FROM li), INTERVAL 1 DAY))::DATE AS ds), s AS (SELECT DISTINCT series_id FROM li) SELECT s.series_id, days.ds, coalesce(y, 0.0) AS y FROM s CROSS JOIN days LEFT JOIN li ON li.series_id = s.series_id AND li.ds = days.ds")
def f16(spark, d):
    return gap_filled(lines(spark, d)).fillna(0.0, ["y"])


@query("f17_f18_lambda", "SELECT event_id, round(exp(0.5 * value / 100), 6) AS lam, round(value / 100, 6) AS linear, round(value / 100, 6) AS back FROM events")
def f17(spark, d):
    x = F.col("value") / 100
    lam = ft.a_to_lam(F.array(x, x), 0.5, [True, False])
    back = ft.lam_to_a(lam, 0.5, [True, False])
    return table(spark, d, "events").select("event_id", r(lam[0], "lam"), r(lam[1], "linear"), r(back[0], "back"))


@query("f19_clipped_lambda", "SELECT event_id, round(exp(least(10.0, greatest(-10.0, 0.5 * (value - 200) / 5))), 4) AS lam FROM events")
def f19(spark, d):
    return table(spark, d, "events").select("event_id", r(ft.clipped_lam((F.col("value") - 200) / 5), "lam", 4))


@query("f20_pooled", "SELECT event_type, round(sum(value / (s * s)) / sum(1 / (s * s)), 6) AS pooled, round(stddev_pop(value), 6) AS spread FROM (SELECT event_type, value, 1 + (event_id % 7) AS s FROM events) GROUP BY event_type")
def f20(spark, d):
    e = table(spark, d, "events").withColumn("s", 1.0 + F.col("event_id") % 7)
    p = ft.pooled_inverse_variance(e, ["event_type"], "value", "s")
    return p.select("event_type", r(F.col("pooled"), "pooled"), r(F.col("spread"), "spread"))


@query("f21_sample_number", "SELECT event_id, CAST((event_id // 10) * 10 + event_id % 10 AS BIGINT) AS sample FROM events")
def f21(spark, d):
    return table(spark, d, "events").select("event_id", ft.sample_number(F.floor(F.col("event_id") / 10), F.col("event_id") % 10, 10).cast("long").alias("sample"))


@query("f23_softplus", "SELECT event_id, round(ln(1 + exp(value / 100)), 6) AS forth, round(ln(exp(ln(1 + exp(value / 100))) - 1 + 1e-12), 6) AS back FROM events")
def f23(spark, d):
    forth = ft.softplus(F.col("value") / 100)
    return table(spark, d, "events").select("event_id", r(forth, "forth"), r(ft.softplus_inverse(forth), "back"))


@query("r4_scheme_update", "SELECT * FROM (VALUES ('a', '+', 0.5::DOUBLE, 1.0::DOUBLE), ('m', '-', 0.0, 2.0), ('z', '=', 0.0, 1.0)) v(regressor, sign, loc_prior, scale_prior)")
def r4(spark, d):
    return RegressionScheme(spark).add_regressors(["z", "m"], scale=[1.0, 2.0]).add_regressors(["m", "a"], sign=["-", "+"], loc=[0.0, 0.5], scale=[2.0, 1.0]).table


# ---------------------------------------------------------------- recursions

_DLT = (0.3, 0.2, 0.9)


@query("k2_dlt_scan", sql.dlt_sql(EV.replace("ev AS", "panel AS"), *_DLT, columns="round(level, 4) AS level, round(slope, 4) AS slope, round(component, 4) AS component"))
def k2(spark, d):
    out = scan.dlt_components(events(spark, d), *_DLT)
    return out.select("series_id", "t", *(r(F.col(c), c, 4) for c in ("level", "slope", "component")))


_DAYS = "days AS (SELECT unnest(generate_series((SELECT min(ds) FROM li), (SELECT max(ds) FROM li), INTERVAL 1 DAY))::DATE AS ds), s AS (SELECT DISTINCT series_id FROM li)"
_GAPS = f"{LI}, {_DAYS}, panel AS (SELECT s.series_id, date_diff('day', (SELECT min(ds) FROM li), days.ds) AS t, CASE WHEN days.ds = (SELECT min(ds) FROM li) THEN coalesce(y, 1.0) ELSE y END AS y FROM s CROSS JOIN days LEFT JOIN li ON li.series_id = s.series_id AND li.ds = days.ds)"


@query("k1_dlt_missing", sql.dlt_sql(_GAPS, *_DLT, columns="round(level, 4) AS level, round(component, 4) AS component"))
def k1(spark, d):
    filled = indexed(gap_filled(lines(spark, d)), ["series_id"], "ds")
    filled = filled.withColumn("y", F.when(F.col("t") == 0, F.coalesce("y", F.lit(1.0))).otherwise(F.col("y")))
    return scan.dlt_components(filled, *_DLT).select("series_id", "t", r(F.col("level"), "level", 4), r(F.col("component"), "component", 4))


@query("k3_dlt_final_states", sql.dlt_sql(EV.replace("ev AS", "panel AS"), *_DLT, columns="round(level, 4) AS level, round(slope, 4) AS slope") + " WHERE t = (SELECT max(t) FROM panel p WHERE p.series_id = scan.series_id)")
def k3(spark, d):
    out = scan.final_states(events(spark, d), *_DLT).join(events(spark, d).groupBy("series_id").agg(F.max("t").alias("t")), "series_id")
    return out.select("series_id", "t", r(F.col("level"), "level", 4), r(F.col("slope"), "slope", 4))


_A0, _P0, _H, _Q = [0.5, 0.1, -0.1], [1.0, 0.5, 0.5], 0.6, [0.2, 0.05, 0.04]
_TOLD = {1: "t = 5 OR t = 12|9.5|0.01", 2: "t = 12|0.3|0.02"}
_POS = [True, False, True]


def _panel(spark, d, told: bool = False) -> DataFrame:
    p = events(spark, d).withColumn("y", F.col("y") / 1000)
    t = F.lit(2) * F.pi() * F.col("t") / 7
    p = p.withColumn("z", F.array(F.lit(1.0), F.cos(t), F.sin(t)))
    if told:
        inf, one, two = F.lit(float("inf")), F.col("t").isin(5, 12), F.col("t") == 12
        p = p.withColumn("a_obs", F.array(F.when(one, 9.5).otherwise(0.0), F.when(two, 0.3).otherwise(0.0), F.lit(0.0)))
        p = p.withColumn("p_obs", F.array(F.when(one, 0.01).otherwise(inf), F.when(two, 0.02).otherwise(inf), inf))
    return p


def _filter_out(out: DataFrame) -> DataFrame:
    arrays = [r(F.col(c)[i], f"{c}{i + 1}") for i in range(3) for c in ("a", "p", "k")]
    return out.select("series_id", "t", *arrays, *(r(F.col(c), c) for c in ("v", "f", "log_p")))


def _smooth_out(out: DataFrame, variances: bool = True) -> DataFrame:
    both = [r(F.col("a_smooth")[i], f"s{i + 1}") for i in range(3)] + [r(F.col("p_smooth")[i], f"d{i + 1}") for i in range(3 * variances)]
    return out.select("series_id", "t", *both)


_LINEAR = (sql.Z3, _A0, _P0, _H, _Q)


def _variant(name: str, kind: str, exponent: float | None, told: bool, positivity: list[bool] | None) -> None:
    kw = {"exponent": exponent, "positivity": positivity} | ({"told": _TOLD} if told else {})
    oracle = {"filter": sql.filter_sql, "rts": sql.rts_sql, "dk": sql.dk_sql}[kind](*_LINEAR, **kw)

    @query(name, oracle)
    def run(spark, d):
        out = scan.filtered(_panel(spark, d, told), _A0, _P0, _H, _Q, positivity=positivity, exponent=exponent, smoother=None if kind == "filter" else kind)
        return _filter_out(out) if kind == "filter" else _smooth_out(out, kind == "rts")


for _name, *_rest in (
    ("k4_kalman_1d", "filter", None, False, None), ("k4_kalman_1d_disclosed", "filter", None, True, None), ("k4_kalman_1d_positive", "filter", None, False, _POS),
    ("k5_dk_smoother", "dk", None, False, None), ("k5_dk_smoother_disclosed", "dk", None, True, None), ("k6_rts_smoother", "rts", None, False, None),
    ("k7_ekf_1d", "filter", 0.5, False, _POS), ("k7_ekf_1d_disclosed", "filter", 0.5, True, [False, False, True]), ("k8_ekf_dk_smoother", "dk", 0.5, False, _POS), ("k9_ekf_rts_smoother", "rts", 0.5, False, _POS),
):
    _variant(_name, *_rest)


@query("k13_local_level", f"WITH RECURSIVE {sql.filter_cte(['1.0'], [0.0], [1.0], 0.5, [0.3])} SELECT series_id, t, round(a1, 6) AS a, round(p1, 6) AS p FROM flt WHERE t >= 0")
def k13(spark, d):
    p = _panel(spark, d).withColumn("z", F.array(F.lit(1.0)))
    return scan.filtered(p, [0.0], [1.0], 0.5, [0.3]).select("series_id", "t", r(F.col("a")[0], "a"), r(F.col("p")[0], "p"))


def _stacked(spark, d) -> DataFrame:
    """One panel in which all series share their states."""
    m = _panel(spark, d).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("series_id", "y", "z"))).alias("m"))
    return m.select(F.lit("all").alias("panel_id"), "t", F.transform("m", lambda x: x["y"]).alias("y"), F.transform("m", lambda x: x["z"]).alias("z"))


@query("k10_kalman_st")
def k10(spark, d):
    out = scan.filtered_st(_stacked(spark, d), _A0, [[1.0, 0.1, 0.0], [0.1, 0.5, 0.0], [0.0, 0.0, 0.5]], _H, _Q)
    return out.select("panel_id", "t", *(r(F.col("a")[i], f"a{i + 1}") for i in range(3)), r(F.col("log_p"), "log_p"))


@query("k11_ekf_st")
def k11(spark, d):
    out = scan.filtered_st(_stacked(spark, d), _A0, [[1.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.5]], _H, _Q, exponent=0.5, positivity=_POS)
    return out.select("panel_id", "t", *(r(F.col("a")[i], f"a{i + 1}") for i in range(3)), r(F.col("log_p"), "log_p"))


@query("k12_batch", f"WITH RECURSIVE {sql.filter_cte(*_LINEAR)} SELECT series_id, round(max_by(log_p, t), 6) AS log_p FROM flt GROUP BY series_id")
def k12(spark, d):
    own = _panel(spark, d).withColumns({"sigma_h": F.lit(_H), "sigma_q": F.array(*map(F.lit, _Q))})
    out = scan.filtered(own, _A0, _P0, None, None, rows=50)
    return scoring.last_value(out, ["series_id"], "t", ["log_p"]).select("series_id", r(F.col("log_p"), "log_p"))


@query("k16_st_rts_overlay")
def k16(spark, d):
    out = scan.filtered_st(_stacked(spark, d), _A0, [[1.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.5]], _H, _Q, smooth_diagonal=True)
    return out.select("panel_id", "t", *(r(F.col("a_smooth")[i], f"s{i + 1}") for i in range(3)))


@query("k17_smoothed_mean", "SELECT series_id, t, round(s1 + cos(2 * pi() * t / 7) * s2 + sin(2 * pi() * t / 7) * s3, 4) AS mu FROM (" + sql.rts_sql(*_LINEAR).replace(", 6)", ", 9)") + ")")
def k17(spark, d):
    p = _panel(spark, d)
    out = scan.filtered(p, _A0, _P0, _H, _Q, smoother="rts").select("series_id", "t", "a_smooth").join(p.select("series_id", "t", "z"), ["series_id", "t"])
    return out.select("series_id", "t", r(F.aggregate(F.zip_with("a_smooth", "z", lambda a, z: a * z), F.lit(0.0), lambda a, b: a + b), "mu", 4))


@query("k14_simulation_smoother")
def k14(spark, d):
    from ..operators.simulate import simulated_states

    return simulated_states(_panel(spark, d), _A0, _P0, _H, _Q, draws=50)


@query("k15_simulated_forecast")
def k15(spark, d):
    from ..operators.simulate import simulated_forecasts

    return simulated_forecasts(scan.filtered(_panel(spark, d), _A0, _P0, _H, _Q), _H, _Q, horizon=7, draws=50)


# ---------------------------------------------------------------- priors

_PRIOR_ROWS = "(VALUES (0, 1.0::DOUBLE, 0.5::DOUBLE, false), (1, 2.0, 0.3, true), (2, 0.7, 0.2, true)) v(state, m, v, pos)"


def _prior_states(spark) -> DataFrame:
    return spark.createDataFrame([(0, 1.0, 0.5, False), (1, 2.0, 0.3, True), (2, 0.7, 0.2, True)], "state int, m double, v double, pos boolean")


for _match, _mean, _var, _sd in (("mean", "(ln(m) - ln(1 + v / (m * m)) / 2) / 0.5", "ln(1 + v / (m * m)) / 0.25", "sqrt(ln(1 + v * v / (m * m))) / 0.5"), ("median", "ln(m) / 0.5", "ln(1 + v / (m * m)) / 0.25", "sqrt(ln(1 + v * v / (m * m))) / 0.5"), ("linearize", "ln(m) / 0.5", "v / (0.25 * m * m)", "v / (0.5 * m)")):

    @query(f"t2_t6_moments_{_match}", f"SELECT state, round(CASE WHEN pos THEN {_mean} ELSE m END, 6) AS a0, round(CASE WHEN pos THEN {_var} ELSE v END, 6) AS p0, round(CASE WHEN pos THEN {_sd} ELSE v END, 6) AS sigma FROM {_PRIOR_ROWS}")
    def t2(spark, d, match=_match):
        m, v, pos = F.col("m"), F.col("v"), F.col("pos")
        return _prior_states(spark).select("state", r(priors.a_mean(m, v, pos, 0.5, match), "a0"), r(priors.a_variance(m, v, pos, 0.5, match), "p0"), r(priors.a_sigma(m, v, pos, 0.5, match), "sigma"))


@query("t5_covariance", f"WITH c AS (SELECT a.state AS i, b.state AS j, a.m AS mi, b.m AS mj, a.pos AS pi, b.pos AS pj, 0.05 * (a.state + b.state) AS c FROM {_PRIOR_ROWS.replace('v(', 'a(')} CROSS JOIN {_PRIOR_ROWS.replace('v(', 'b(')} WHERE a.state <> b.state) SELECT i, j, round(CASE WHEN pi AND pj THEN ln(1 + c / (mi * mj)) / 0.25 WHEN pi THEN c / (0.5 * mi) WHEN pj THEN c / (0.5 * mj) ELSE c END, 6) AS cov FROM c")
def t5(spark, d):
    s = _prior_states(spark)
    a, b = (s.select(*(F.col(c).alias(f"{c}_{k}") for c in s.columns)) for k in "ij")
    cells = a.join(b, F.col("state_i") != F.col("state_j"))
    cov = priors.a_covariance(0.05 * (F.col("state_i") + F.col("state_j")), F.col("m_i"), F.col("m_j"), F.col("pos_i"), F.col("pos_j"), 0.5, "mean")
    return cells.select(F.col("state_i").alias("i"), F.col("state_j").alias("j"), r(cov, "cov"))


@query("t9_beta_scale", f"SELECT state, round(CASE WHEN pos THEN sqrt(ln(1 + (0.4 * 0.25) * (0.4 * 0.25) / (m * m))) / 0.5 / 0.25 ELSE 0.4 END, 6) AS scale FROM {_PRIOR_ROWS}")
def t9(spark, d):
    return _prior_states(spark).select("state", r(priors.beta_scale(F.lit(2.0), F.lit(4.0), F.lit(0.4), F.col("m"), F.col("pos"), 0.5, "mean"), "scale"))


@query("t12_time_point_priors", f"WITH {EV}, b AS (SELECT DISTINCT ds AS date, variable, mid FROM ev CROSS JOIN (VALUES ('tv', 0.4::DOUBLE), ('radio', 0.2)) x(variable, mid) WHERE t % 14 = 0) SELECT t, ds, variable, mid AS a_obs, 0.01::DOUBLE AS p_obs FROM (SELECT DISTINCT t, ds FROM ev) s JOIN b ON b.date = s.ds WHERE t % 7 = 0")
def t12(spark, d):
    s = events(spark, d).select("t", "ds").distinct()
    betas = s.filter("t % 14 = 0").select(F.col("ds").alias("date")).distinct().crossJoin(F.broadcast(spark.createDataFrame([("tv", 0.4), ("radio", 0.2)], "variable string, mid double")))
    return priors.time_point_priors(s, betas, weeks=1)


# ---------------------------------------------------------------- estimation

_DRAWS = "draws AS (SELECT event_type AS series_id, CAST(event_id % 4 AS BIGINT) AS chain, CAST(row_number() OVER (PARTITION BY event_type, event_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS draw, value FROM events)"


def _draws(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("chain", F.col("event_id") % 4)
    w = Window.partitionBy("event_type", "chain").orderBy("event_id")
    return e.select(F.col("event_type").alias("series_id"), "chain", (F.row_number().over(w) - 1).cast("long").alias("draw"), "value")


def _scheme():
    return {"x1": ("+", 0.0, 1.0), "x2": ("-", 0.0, 1.0), "x3": ("=", 0.0, 1.0)}


def _with_x(spark, d) -> DataFrame:
    t = F.col("t")
    return events(spark, d).withColumns({"y": F.col("y") / 1000, "x1": F.cos(t), "x2": F.sin(t / 3), "x3": (t % 7 == 0).cast("double")})


_X = ["x1", "x2", "x3"]


def _fits(spark, d, **kw) -> tuple[DataFrame, DataFrame]:
    p = _with_x(spark, d)
    found = estimate.basis(p, *_DLT, _X)
    names, prior = estimate._prior(p, _X, _scheme())
    draws = estimate.sample_dlt(estimate.gram(found, 3), names, prior, **({"warmup": 50, "draws": 50, "chains": 2, "seed": 0} | kw))
    return found, saved(draws, scratch(spark, "draws"))


def _ahead(spark, d, horizon: int) -> DataFrame:
    t = F.col("t")
    last = events(spark, d).groupBy("series_id").agg(F.max("t").alias("last"))
    rows = last.select("series_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.col("last") + h)).alias("t"))
    return rows.withColumns({"x1": F.cos(t), "x2": F.sin(t / 3), "x3": (t % 7 == 0).cast("double")})


@query("e1_gram", sql.gram_sql(EV, *_DLT))
def e1(spark, d):
    g = estimate.gram(estimate.basis(_with_x(spark, d), *_DLT, ["x1"]), 1)
    return g.select("series_id", *(r(F.col("g")[i], c, 4) for i, c in enumerate(("yy", "xy", "xx"))), r(F.col("level")[0], "level", 4), r(F.col("level")[1], "level_x", 4))


@query("e2_dlt_fit")
def e2(spark, d):
    _, fits = _fits(spark, d)
    return fits.groupBy("series_id").agg(*(F.percentile(F.col("coef")[i], 0.5).alias(f"x{i + 1}_p50") for i in range(3)), F.percentile("sigma", 0.5).alias("sigma_p50"))


@query("e2_dlt_medians")
def e2m(spark, d):
    found, fits = _fits(spark, d)
    return estimate.medians(fits, found)[1]


@query("e3_noise")
def e3(spark, d):
    return estimate.noise_components(estimate.fit_dlt(_with_x(spark, d), *_DLT, warmup=20, draws=20, chains=1), 5)


@query("e4_components_ahead")
def e4(spark, d):
    _, fits = _fits(spark, d)
    return scoring.quantiles(estimate.components_ahead(fits, *_DLT, 44), ["series_id", "t"], "component")


@query("e5_dlt_inference")
def e5(spark, d):
    found, fits = _fits(spark, d)
    out = estimate.make_inference(fits, found, *_DLT, regressors=_X, future=_ahead(spark, d, 14), noise_embed=True, transform=lambda c: F.exp(c / 10))
    return scoring.quantiles(out, ["series_id", "t"], "forecast", (0.1, 0.5, 0.9))


@query("e5_dlt_forecast_closed_form")
def e5c(spark, d):
    fits = estimate.fit_dlt(_with_x(spark, d), *_DLT, warmup=50, draws=50, chains=2)
    return scoring.quantiles(estimate.forecast_dlt(fits, _DLT[1], _DLT[2], 14, noise=True), ["series_id", "t"], "forecast")


@query("e6_e7_mcmc_forecast")
def e6(spark, d):
    logged = ft.log_response(events(spark, d), ["series_id"], "y").withColumns({"z0": F.lit(1.0), "z1": F.cos(F.col("t") * 2 * F.pi() / 7)})
    fits = estimate.fit_mcmc(logged.select("series_id", "t", F.col("response").alias("y"), "z0", "z1"), ["z0", "z1"], warmup=60, draws=40, chains=2)
    ahead = spark.range(7).select(F.col("id").alias("t"), F.array(F.lit(1.0), F.cos(F.col("id") * 2 * F.pi() / 7)).alias("z"))
    return estimate.forecast_mcmc(fits, ahead, logged.select("series_id", "response_norm").distinct())


def _sales(spark, d) -> DataFrame:
    return events(spark, d).select("series_id", "t", F.col("y").alias("sales"))


@query("e8_e10_map")
def e8(spark, d):
    return estimate.fit_map(_sales(spark, d), iterations=60).select("series_id", "sigma_h", "sigma_level", "sigma_season", "loss")


@query("e12_mmm_ekf")
def e12(spark, d):
    p = ft.mean_normalised(events(spark, d), ["series_id"], ["y"]).withColumns({"z0": F.lit(1.0), "z1": F.abs(F.sin(F.col("t")))})
    beta = estimate.NoisePrior("beta", h=(2.0, 10.0, 1.0), level=(2.0, 4.0, 0.2), other=(2.0, 4.0, 0.1))
    fits = estimate.fit_mcmc(p, ["z0", "z1"], exponent=0.5, positivity=[False, True], prior=beta, warmup=40, draws=30, chains=1)
    return fits.groupBy("series_id").agg(F.percentile(F.col("sigma_h")[0], 0.5).alias("sigma_h"), F.count("*").alias("draws"))


@query("e12_mmm_ekf_st")
def e12st(spark, d):
    beta = estimate.NoisePrior("beta", h=(2.0, 10.0, 2.0), level=(2.0, 4.0, 0.4), other=(2.0, 4.0, 0.2))
    fits = estimate.fit_mcmc_st(_stacked(spark, d), _A0, [[1.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.5]], exponent=0.5, positivity=_POS, prior=beta, warmup=30, draws=20, chains=2)
    return fits.select("series_id", "chain", "draw", F.col("sigma_q")[0].alias("sigma_level"), "log_p")


@query("e14_spans", f"WITH {EV}, w AS (SELECT series_id, t, list(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS span FROM ev) SELECT series_id, t, span[1] AS first_y, span[7] AS last_y FROM w WHERE len(span) = 7")
def e14(spark, d):
    return scoring.sliding_windows(events(spark, d), ["series_id"], "t", "y", 7).select("series_id", "t", F.col("span")[0].alias("first_y"), F.col("span")[6].alias("last_y"))


@query("e18_e19_tuned")
def e19(spark, d):
    out = estimate.tune_dlt(_with_x(spark, d), trials=6, refine=3, regressors=_X, scheme=_scheme(), horizon=7)
    return scoring.best_iteration(out, ["series_id"], "wbic", "trial")


# ---------------------------------------------------------------- aggregation and scoring

_GEO = "geo AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _geo(spark, d) -> DataFrame:
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), F.to_date("o_orderdate").alias("ds"), F.col("o_totalprice").alias("v"))


@query("a1_group_sums", f"WITH {_GEO} SELECT region, segment, round(sum(v), 2) AS v FROM geo GROUP BY region, segment")
def a1(spark, d):
    return scoring.grouped_sums(_geo(spark, d), ["region", "segment"], ["v"]).select("region", "segment", r(F.col("v"), "v", 2))


@query("a3_a4_ribbons", "SELECT event_type, user_id, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY event_type, user_id")
def a4(spark, d):
    q = scoring.quantiles(table(spark, d, "events"), ["event_type", "user_id"], "value")
    return q.select("event_type", "user_id", *(r(F.col(c), c) for c in ("q05", "q50", "q95")))


@query("a5_hdi", f"WITH {_DRAWS}, x AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY value) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM draws), w AS (SELECT a.series_id, a.value AS lo, b.value AS hi, row_number() OVER (PARTITION BY a.series_id ORDER BY b.value - a.value, a.value, b.value) AS k FROM x a JOIN x b ON a.series_id = b.series_id AND b.i = a.i + floor(a.n * 0.94)) SELECT series_id, lo AS hdi_low, hi AS hdi_high FROM w WHERE k = 1")
def a5(spark, d):
    return scoring.hdi(_draws(spark, d), ["series_id"], "value")


@query("a6_split_rhat", f"WITH {_DRAWS}, h AS (SELECT *, draw > max(draw) OVER (PARTITION BY series_id, chain) / 2 AS half FROM draws), e AS (SELECT series_id, avg(value) AS m, var_samp(value) AS s, count(*) AS n FROM h GROUP BY series_id, chain, half) SELECT series_id, round(sqrt(((avg(n) - 1) / avg(n) * avg(s) + var_samp(m)) / avg(s)), 6) AS r_hat FROM e GROUP BY series_id")
def a6(spark, d):
    return scoring.split_rhat(_draws(spark, d), ["series_id"], "value").select("series_id", r(F.col("r_hat"), "r_hat"))


@query("a7_weekly", f"WITH {EV} SELECT series_id, CAST(floor(date_diff('day', (SELECT min(ds) FROM ev), ds) / 7) AS BIGINT) AS week, round(sum(y), 4) AS y FROM ev GROUP BY 1, 2")
def a7(spark, d):
    return scoring.weekly(events(spark, d), ["series_id"], "ds", "y").select("series_id", "week", r(F.col("y"), "y", 4))


@query("a8_distribution", f"WITH {LI} SELECT series_id, count(y) AS count, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, min(y) AS min, round(quantile_cont(y, 0.25), 6) AS p25, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.75), 6) AS p75, max(y) AS max, round(avg((y = 0)::DOUBLE), 6) AS frac_zero FROM li GROUP BY series_id")
def a8(spark, d):
    x = scoring.distribution(lines(spark, d), ["series_id"], "y")
    return x.select("series_id", "count", *(r(F.col(c), c) if c not in ("min", "max") else F.col(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max", "frac_zero")))


_PAIR = f"{EV}, pair AS (SELECT series_id, t, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS before FROM ev)"


def _pair(spark, d) -> DataFrame:
    e = events(spark, d)
    return e.withColumn("before", F.lag("y").over(Window.partitionBy("series_id").orderBy("t"))).filter("before is not null")


@query("a9_differences", f"WITH {_PAIR} SELECT series_id, round(avg(abs(y - before)), 5) AS mae, round(sqrt(avg((y - before) * (y - before))), 5) AS rmse, round(quantile_cont(abs(y - before), 0.5), 5) AS median_abs, round(avg(y - before), 5) AS bias, round(corr(y, before), 6) AS pearson FROM pair WHERE before IS NOT NULL GROUP BY series_id")
def a9(spark, d):
    x = scoring.differences(_pair(spark, d), ["series_id"], "y", "before")
    return x.select("series_id", *(r(F.col(c), c, 6 if c == "pearson" else 5) for c in ("mae", "rmse", "median_abs", "bias", "pearson")))


@query("a13_smape", f"WITH {_PAIR} SELECT series_id, round(avg(2 * abs(before - y) / (abs(y) + abs(before))), 6) AS smape, round(avg(abs(before - y)), 5) AS mae FROM pair WHERE before IS NOT NULL GROUP BY series_id")
def a13(spark, d):
    x = scoring.smape(_pair(spark, d), ["series_id"], "y", "before")
    return x.select("series_id", r(F.col("smape"), "smape"), r(F.col("mae"), "mae", 5))


@query("a14_log_likelihood", f"WITH RECURSIVE {sql.filter_cte(*_LINEAR)} SELECT series_id, round(sum(-0.5 * (ln(2 * pi()) + ln(f) + v * v / f)), 6) AS log_p FROM flt WHERE t >= 0 GROUP BY series_id")
def a14(spark, d):
    x = scoring.series_log_likelihood(scan.filtered(_panel(spark, d), _A0, _P0, _H, _Q), ["series_id"])
    return x.select("series_id", r(F.col("log_p"), "log_p"))


@query("a15_best_iteration", f"WITH {_DRAWS} SELECT series_id, min(value) AS best_loss, arg_min(draw * 4 + chain, (value, draw * 4 + chain)) AS best_iteration FROM draws GROUP BY series_id")
def a15(spark, d):
    return scoring.best_iteration(_draws(spark, d).withColumn("it", F.col("draw") * 4 + F.col("chain")), ["series_id"], "value", "it")


@query("a16_histogram", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(99, floor((value - lo) / ((hi - lo) / 100))) AS INT) AS bin, count(*) AS n FROM events CROSS JOIN e GROUP BY 1")
def a16(spark, d):
    return scoring.equal_width_histogram(table(spark, d, "events"), "value")


@query("b1_a11_volume_buckets", "WITH v AS (SELECT o_custkey, round(sum(o_totalprice), 4) AS v FROM orders GROUP BY 1), e AS (SELECT list_distinct([quantile_cont(v, 0.0), quantile_cont(v, 0.2), quantile_cont(v, 0.4), quantile_cont(v, 0.6), quantile_cont(v, 0.8), quantile_cont(v, 1.0)]) AS e FROM v) SELECT CAST(greatest(1, len(list_filter(e, lambda x: x < v))) AS INT) AS bucket, count(*) AS size, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median FROM v CROSS JOIN e GROUP BY 1")
def b1(spark, d):
    v = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("v"))
    x = scoring.quantile_buckets(v, "v", 5)
    return x.groupBy("bucket").agg(F.count("*").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.percentile("v", 0.5), 4).alias("median"))


@query("b2_b3_top_volume", "SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def b2(spark, d):
    v = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return scoring.top(v, "v", 20, "o_custkey")


@query("b4_seeded_sample")
def b4(spark, d):
    return scoring.seeded_sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50, 7)


@query("w1_first_difference", f"WITH {EV} SELECT series_id, t, round(y - lag(y) OVER (PARTITION BY series_id ORDER BY t), 6) AS d FROM ev")
def w1(spark, d):
    e = events(spark, d)
    return e.select("series_id", "t", r(scoring.first_difference(e, ["series_id"], "t", "y"), "d"))


@query("w2_w4_last_rows", f"WITH {LI} SELECT series_id, ds, y FROM li QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 28")
def w2(spark, d):
    return scoring.last_rows(lines(spark, d), ["series_id"], "ds", 28)


@query("w5_w6_last_state", f"WITH {EV} SELECT series_id, max(t) AS t, max_by(y, t) AS y FROM ev GROUP BY series_id")
def w6(spark, d):
    return scoring.last_value(events(spark, d).withColumn("u", F.col("t")), ["series_id"], "u", ["t", "y"])


@query("w7_scaled_residual", f"WITH {EV}, x AS (SELECT series_id, t, y - avg(y) OVER (PARTITION BY series_id) AS e FROM ev) SELECT series_id, t, round(e / stddev_pop(e) OVER (PARTITION BY series_id), 6) AS e FROM x")
def w7(spark, d):
    w = Window.partitionBy("series_id")
    x = events(spark, d).withColumn("e", F.col("y") - F.avg("y").over(w))
    return x.select("series_id", "t", r(F.col("e") / F.stddev_pop("e").over(w), "e"))


@query("x1_gap_filled", f"WITH {LI}, days AS (SELECT unnest(generate_series((SELECT min(ds) FROM li), (SELECT max(ds) FROM li), INTERVAL 1 DAY))::DATE AS ds), s AS (SELECT DISTINCT series_id FROM li) SELECT s.series_id, days.ds, y FROM s CROSS JOIN days LEFT JOIN li ON li.series_id = s.series_id AND li.ds = days.ds")
def x1(spark, d):
    return gap_filled(lines(spark, d))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("x2_pivot", f"WITH {EV} SELECT ds, " + ", ".join(f"max(CASE WHEN series_id = '{s}' THEN y END) AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM ev GROUP BY ds")
def x2(spark, d):
    return long_to_wide(events(spark, d), "ds", "series_id", "y", _TYPES)


@query("x3_x7_union_except", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def x7(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("id"))
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return big.distinct().join(gone, "id", "left_anti")


@query("x8_posterior_long", "SELECT 'coef' AS variable, CAST(event_id % 2 AS BIGINT) AS chain, event_id AS draw, CAST(i AS INT) AS idx, CASE i WHEN 0 THEN value ELSE -value END AS value FROM events CROSS JOIN (VALUES (0), (1)) k(i)")
def x8(spark, d):
    from ..sources.panel import posterior_long

    e = table(spark, d, "events").select((F.col("event_id") % 2).alias("chain"), F.col("event_id").alias("draw"), F.array(F.col("value"), -F.col("value")).alias("coef"))
    return posterior_long(e, "coef")


@query("j1_calendar_prices", "WITH p AS (SELECT l_partkey % 20 AS item, date_trunc('week', l_shipdate)::DATE AS wk, round(avg(l_extendedprice / l_quantity), 7) AS price FROM lineitem GROUP BY 1, 2), c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders) SELECT item, ds, price FROM c JOIN p ON p.wk = date_trunc('week', c.ds)::DATE")
def j1(spark, d):
    week = lambda c: F.to_date(F.date_trunc("week", c))
    p = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 20).alias("item"), week("l_shipdate").alias("wk")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 7).alias("price"))
    c = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("ds")).distinct().withColumn("wk", week("ds"))
    return c.join(p, "wk").select("item", "ds", "price")


@query("j3_s11_submission", "WITH s AS (SELECT n_name AS id, CAST(n_nationkey AS DOUBLE) AS f FROM nation) SELECT id || k AS id, f AS F1, f + 1 AS F2 FROM s CROSS JOIN (VALUES ('_validation'), ('_evaluation')) x(k)")
def j3(spark, d):
    n = table(spark, d, "nation")
    p = n.select(F.concat("n_name", F.lit("_validation")).alias("id"), F.col("n_nationkey").cast("double").alias("F1"), (F.col("n_nationkey") + 1).cast("double").alias("F2"))
    both = p.select("id").unionByName(p.select(ft.swap_suffix("id").alias("id")))
    return submission(both.withColumn("place", F.xxhash64("id")), p, 2)


@query("j4_aligned", "SELECT s_suppkey AS id, round(s_acctbal, 2) AS a, round(2 * s_acctbal, 2) AS b FROM supplier")
def j4(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal", 2).alias("a"))
    return align_by_id(s, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(2 * F.col("s_acctbal"), 2).alias("b")), "id")


def _wr(spark, d) -> tuple[DataFrame, DataFrame]:
    """Daily sales of region and segment over all days; the last 28 are there to be forecast."""
    x = _geo(spark, d).groupBy("region", "segment", "ds").agg(F.round(F.sum("v") / 1000, 6).alias("y")).withColumn("series_id", F.struct("region", "segment"))
    full = gap_filled(x.select("series_id", "ds", "y")).select("series_id.region", "series_id.segment", "ds", F.coalesce("y", F.lit(0.0)).alias("sales"))
    full = indexed(full, ["region", "segment"], "ds").withColumn("price", 1.0 + F.length("segment") / 10)
    left = F.max("ds").over(Window.partitionBy("region", "segment"))
    full = saved(full.withColumn("left", F.datediff(left, "ds")).drop("ds"), scratch(spark, "sales"))  # each score reads it
    train, valid = full.filter("left >= 28").drop("left"), full.filter("left < 28").drop("left")
    mean = train.groupBy("region", "segment").agg(F.round(F.avg("sales"), 6).alias("forecast"))
    return train, valid.join(mean, ["region", "segment"])


#: Weighed by dollars; bias_pct is that of each group's own relative bias.
_WR_OUT = "SELECT level, count(*) AS n_series, round(sum(w * r), 6) AS wrmsse, round(avg(r), 6) AS mean_rmsse, round(sum(w * a), 4) AS actual_mean, round(sum(w * f), 4) AS forecast_mean, round(sum(w * (f - a)), 4) AS bias_signed, round(sum(w * 100 * (f - a) / CASE WHEN a = 0 THEN 1 ELSE a END), 4) AS bias_pct FROM g GROUP BY level"
_WR_SQL = f"""WITH {_GEO}, x0 AS (SELECT region, segment, ds, round(sum(v) / 1000, 6) AS sales FROM geo GROUP BY ALL),
x AS (SELECT region, segment, date_diff('day', (SELECT min(ds) FROM x0), ds) AS t, sales FROM x0),
n AS (SELECT max(t) + 1 - 28 AS n FROM x),
full_ AS (SELECT k.region, k.segment, g.t, coalesce(x.sales, 0.0) AS sales, 1.0 + length(k.segment) / 10 AS price FROM (SELECT DISTINCT region, segment FROM x) k CROSS JOIN (SELECT unnest(generate_series(0, (SELECT max(t) FROM x))) AS t) g LEFT JOIN x ON x.region = k.region AND x.segment = k.segment AND x.t = g.t),
f AS (SELECT region, segment, round(avg(sales), 6) AS forecast FROM full_ WHERE t < (SELECT n FROM n) GROUP BY ALL),
lv AS (SELECT 1 AS level UNION ALL SELECT 2 UNION ALL SELECT 3),
tagged AS (SELECT level, CASE WHEN level >= 2 THEN region ELSE '' END || '|' || CASE WHEN level = 3 THEN segment ELSE '' END AS k, t, sales, price, forecast FROM full_ JOIN f USING (region, segment) CROSS JOIN lv),
s AS (SELECT level, k, t, sum(sales) AS sales, sum(forecast) AS forecast FROM tagged GROUP BY ALL),
d AS (SELECT level, k, sales - lag(sales) OVER (PARTITION BY level, k ORDER BY t) AS d FROM s WHERE t < (SELECT n FROM n)),
sc AS (SELECT level, k, CASE WHEN avg(d * d) > 0 THEN avg(d * d) ELSE 1 END AS scale FROM d GROUP BY ALL),
w AS (SELECT level, k, sum(sales * price) AS dollars FROM tagged WHERE t >= (SELECT n FROM n) - 28 AND t < (SELECT n FROM n) GROUP BY ALL),
e AS (SELECT level, k, avg((forecast - sales) * (forecast - sales)) AS mse, avg(sales) AS a, avg(forecast) AS f FROM s WHERE t >= (SELECT n FROM n) GROUP BY ALL),
g AS (SELECT level, sqrt(mse) / sqrt(scale) AS r, a, f, dollars / sum(dollars) OVER (PARTITION BY level) AS w FROM e JOIN sc USING (level, k) JOIN w USING (level, k))
{_WR_OUT}"""


def _wr_out(out: DataFrame) -> DataFrame:
    return out.select("level", "n_series", r(F.col("wrmsse"), "wrmsse"), r(F.col("mean_rmsse"), "mean_rmsse"), *(r(F.col(c), c, 4) for c in ("actual_mean", "forecast_mean", "bias_signed", "bias_pct")))


@query("s9_s10_wrmsse", _WR_SQL)
def s10(spark, d):
    return _wr_out(scoring.wrmsse(*_wr(spark, d), [[], ["region"], ["region", "segment"]], ["region", "segment"]))


#: The twelve levels of a retail hierarchy, and what lies in what.
LEVELS = [[], ["state"], ["store"], ["cat"], ["dept"], ["state", "cat"], ["state", "dept"], ["store", "cat"], ["store", "dept"], ["item"], ["item", "state"], ["item", "store"]]
WITHIN = {"store": "state", "dept": "cat", "item": "dept"}
KEYS = ["state", "store", "cat", "dept", "item"]
_SHOP = "shop AS (SELECT r_name AS state, n_name AS store, 'c' || (o_orderkey % 6) // 4 AS cat, 'd' || (o_orderkey % 6) // 2 AS dept, 'i' || o_orderkey % 6 AS item, CAST(o_orderdate AS DATE) AS ds, o_totalprice / 1000 AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _shop(spark, d) -> DataFrame:
    """Orders as the sales of items (of six, in three departments and two categories) in nations."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    i = F.col("o_orderkey") % 6
    name = lambda letter, of: F.concat(F.lit(letter), F.floor(i / of).cast("string"))
    return o.select(F.col("r_name").alias("state"), F.col("n_name").alias("store"), name("c", 4).alias("cat"), name("d", 2).alias("dept"), name("i", 1).alias("item"), F.to_date("o_orderdate").alias("ds"), (F.col("o_totalprice") / 1000).alias("v"))


_SETS = ", ".join(f"({', '.join(lv)})" for lv in LEVELS)
_CODE = "CASE grouping(state, store, cat, dept, item) " + " ".join(f"WHEN {sum(1 << 4 - p for p, k in enumerate(KEYS) if k not in lv)} THEN {i}" for i, lv in enumerate(LEVELS, 1)) + " END"


@query("a2_hierarchy", f"WITH {_SHOP} SELECT {_CODE} AS level, state, store, cat, dept, item, round(sum(v), 2) AS v FROM shop GROUP BY GROUPING SETS ({_SETS})")
def a2(spark, d):
    out = scoring.hierarchy_sums(_shop(spark, d).drop("ds"), LEVELS, [], ["v"], WITHIN)
    return out.select("level", *KEYS, r(F.col("v"), "v", 2))


def _weeks(spark, d) -> tuple[DataFrame, DataFrame]:
    """Weekly sales of items in stores over all weeks; the last 28 are forecast by the mean of the others."""
    x = _shop(spark, d)
    ends = x.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    week = F.floor(F.datediff("ds", "lo") / 7).cast("long")
    sums = x.crossJoin(F.broadcast(ends)).groupBy(*KEYS, week.alias("t")).agg(F.round(F.sum("v"), 6).alias("v"))
    weeks = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.datediff("hi", "lo") / 7).cast("long"))).alias("t"), F.floor(F.datediff("hi", "lo") / 7).alias("last"))
    series = sums.select(*KEYS).distinct().crossJoin(F.broadcast(weeks))
    full = series.join(sums, [*KEYS, "t"], "left").withColumns({"sales": F.coalesce("v", F.lit(0.0)), "price": 1.0 + F.length("store") / 10})
    full = saved(full.select(*KEYS, "t", "sales", "price", (F.col("last") - F.col("t")).alias("left")), scratch(spark, "weeks"))
    train, valid = full.filter("left >= 28").drop("left"), full.filter("left < 28").drop("left")
    mean = train.groupBy("item", "store").agg(F.round(F.avg("sales"), 6).alias("forecast"))
    return train, valid.join(mean, ["item", "store"])


_WEEKS = f"""{_SHOP}, ends AS (SELECT min(ds) AS lo, max(ds) AS hi FROM shop), sums AS (SELECT state, store, cat, dept, item, CAST(floor(date_diff('day', lo, ds) / 7) AS BIGINT) AS t, round(sum(v), 6) AS v FROM shop CROSS JOIN ends GROUP BY ALL),
wk AS (SELECT unnest(generate_series(0, (SELECT CAST(floor(date_diff('day', lo, hi) / 7) AS BIGINT) FROM ends))) AS t), n AS (SELECT max(t) + 1 - 28 AS n FROM wk),
full_ AS (SELECT k.*, wk.t, coalesce(s.v, 0.0) AS sales, 1.0 + CAST(length(k.store) AS DOUBLE) / 10 AS price FROM (SELECT DISTINCT state, store, cat, dept, item FROM sums) k CROSS JOIN wk LEFT JOIN sums s ON s.store = k.store AND s.item = k.item AND s.t = wk.t),
fc AS (SELECT item, store, round(avg(sales), 6) AS forecast FROM full_ WHERE t < (SELECT n FROM n) GROUP BY ALL),
tagged AS ({" UNION ALL ".join(f"SELECT {i} AS level, {" || '|' || ".join(lv) or "''"} AS k, t, sales, price, forecast FROM full_ JOIN fc USING (item, store)" for i, lv in enumerate(LEVELS, 1))})"""


@query("s10_wrmsse_twelve_levels", f"WITH {_WEEKS}, " + _WR_SQL[_WR_SQL.index("s AS (SELECT level, k, t, sum") :])
def s10w(spark, d):
    return _wr_out(scoring.wrmsse(*_weeks(spark, d), LEVELS, KEYS, within=WITHIN))


from . import pipelines, posteriors  # noqa: E402, F401  register the others
