"""Registered queries of sources, joins, reshaping, priors in full and end-to-end panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import features as ft
from ..functions import priors
from ..operators import estimate, scan, scoring
from ..sources import panel as src
from ..sources.panel import scratch, table
from . import catalog as c
from .registry import query

# ---------------------------------------------------------------- sources and sinks


@query("i1_i5_csv_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def i1(spark, d):
    path = scratch(spark, "csv")
    src.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return src.read_csv(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query("i2_first_file", "SELECT n_nationkey, n_name FROM nation")
def i2(spark, d):
    path = scratch(spark, "csv")
    src.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return src.read_first(spark, [scratch(spark, "none"), path], "n_nationkey int, n_name string")


@query("i3_partitioned_panel", f"WITH {c.EV} SELECT series_id, ds, y, CASE WHEN t < 20 THEN 'train' ELSE 'test' END AS split FROM ev")
def i3(spark, d):
    path = scratch(spark, "panel")
    src.write_panel(c.events(spark, d).select("series_id", "ds", "y", F.when(F.col("t") < 20, "train").otherwise("test").alias("split")), path)
    return spark.read.parquet(path).select("series_id", "ds", "y", "split")


@query("i7_b3_configured_sample", "SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def i7(spark, d):
    config = RunConfig.from_arguments(["--n-series", "10", "--sample-mode", "top"])
    volume = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return scoring.top(volume, "v", config.n_series, "o_custkey")


# ---------------------------------------------------------------- draws under the filter


@query("k10_kalman_st_disclosed")
def k10(spark, d):
    p = c._stacked(spark, d)
    inf, told = F.lit(float("inf")), F.col("t") == 12
    p = p.withColumns({"a_obs": F.array(F.when(told, 9.5).otherwise(0.0), F.lit(0.0), F.lit(0.0)), "p_obs": F.array(F.when(told, 0.01).otherwise(inf), inf, inf)})
    out = scan.filtered_st(p, c._A0, [[1.0, 0.1, 0.0], [0.1, 0.5, 0.0], [0.0, 0.0, 0.5]], c._H, c._Q, positivity=c._POS)
    return out.select("panel_id", "t", *(c.r(F.col("a")[i], f"a{i + 1}") for i in range(3)), c.r(F.col("log_p"), "log_p"))


# ---------------------------------------------------------------- priors


@query("t3_observations", "SELECT event_id, round(CASE WHEN pos THEN (CASE WHEN x > 0 THEN ln(x) ELSE 0 END - ln(1 + 0.2 / pow(CASE WHEN x > 0 THEN x ELSE 1 END, 2)) / 2) / 0.5 ELSE x END, 6) AS a_obs, round(CASE WHEN pos THEN ln(1 + 0.2 / pow(CASE WHEN x > 0 THEN x ELSE 1 END, 2)) / 0.25 ELSE 0.2 END, 6) AS p_obs FROM (SELECT event_id, value / 100 - 1 AS x, event_id % 2 = 0 AS pos FROM events)")
def t3(spark, d):
    x, pos = F.col("value") / 100 - 1, F.col("event_id") % 2 == 0
    a, p = priors.a_observation(x, F.lit(0.2), pos, 0.5, "mean")
    return table(spark, d, "events").select("event_id", c.r(a, "a_obs"), c.r(p, "p_obs"))


def _priors(**kw) -> priors.Priors:
    base = {"a0": [1.0, 2.0, 0.7], "p0": [0.5, 0.3, 0.2], "positivity": [False, True, True], "sigma_q": {"loc": [0.1, 0.2, 0.3], "scale": [0.2, 0.2, 0.2]}}
    return priors.Priors(**(base | kw))


def _rows(spark, p: priors.Priors) -> DataFrame:
    names = list(p.sigma_q)
    rows = [(i, *(float(x) for x in (a, v, *(p.sigma_q[n][i] for n in names)))) for i, (a, v) in enumerate(zip(p.a0, p.p0, strict=True))]
    out = spark.createDataFrame(rows, ", ".join(["state int", *(f"{n} double" for n in ("a0", "p0", *names))]))
    return out.select("state", *(c.r(F.col(n), n) for n in ("a0", "p0", *names)))


_A, _V = "(ln(m) - ln(1 + v / (m * m)) / 2) / 0.5", "ln(1 + v / (m * m)) / 0.25"
_S = lambda x: f"round(CASE WHEN pos THEN sqrt(ln(1 + {x} * {x} / (m * m))) / 0.5 ELSE {x} END, 6)"


@query("t4_t7_t8_truncated_normal", f"SELECT state, round(CASE WHEN pos THEN {_A} ELSE m END, 6) AS a0, round(CASE WHEN pos THEN {_V} ELSE v END, 6) AS p0, {_S('(0.1 * (state + 1))')} AS loc, {_S('0.2')} AS scale FROM {c._PRIOR_ROWS}")
def t8(spark, d):
    return _rows(spark, priors.to_ekf(spark, _priors()))


@query("t10_beta_family", f"SELECT state, round(CASE WHEN pos THEN {_A} ELSE m END, 6) AS a0, round(CASE WHEN pos THEN {_V} ELSE v END, 6) AS p0, 2.0::DOUBLE AS alpha, 4.0::DOUBLE AS beta, round(CASE WHEN pos THEN sqrt(ln(1 + 0.1 * 0.1 / (m * m))) / 0.5 / 0.25 ELSE 0.4 END, 6) AS scale FROM {c._PRIOR_ROWS}")
def t10(spark, d):
    return _rows(spark, priors.to_ekf(spark, _priors(family="beta", sigma_q={"alpha": [2.0] * 3, "beta": [4.0] * 3, "scale": [0.4] * 3})))


@query("t11_disclosed_windows")
def t11(spark, d):
    truth = [[1.0, 0.1 * t] for t in range(60)]
    p = priors.disclosed_states(truth)
    return spark.createDataFrame([(t, *p.a_obs[t], p.p_obs[t][1]) for t in p.obs_idx], "t int, a0 double, a1 double, p1 double")


# ---------------------------------------------------------------- joins and reshaping


@query("j2_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j2(spark, d):
    return table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("j5_positions", "SELECT c_custkey, n_nationkey AS place FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j5(spark, d):
    order = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("place"))
    return src.matched(table(spark, d, "customer").select("c_custkey", "c_nationkey"), order, "c_nationkey").select("c_custkey", "place")


@query("j7_merged_priors", "SELECT coalesce(a.k, b.k) AS state, n_a, n_b FROM (SELECT o_custkey % 9 AS k, count(*) AS n_a FROM orders GROUP BY 1) a FULL JOIN (SELECT 3 + l_suppkey % 9 AS k, count(*) AS n_b FROM lineitem GROUP BY 1) b ON a.k = b.k")
def j7(spark, d):
    a = table(spark, d, "orders").groupBy((F.col("o_custkey") % 9).alias("state")).agg(F.count("*").alias("n_a"))
    b = table(spark, d, "lineitem").groupBy((3 + F.col("l_suppkey") % 9).alias("state")).agg(F.count("*").alias("n_b"))
    return src.merged_priors(["state"], a, b)


@query("j8_draws_by_covariates", f"WITH {c.EV}, d AS (SELECT * FROM (VALUES (0, 0, 'a', 0.5::DOUBLE), (0, 0, 'b', -1.0), (0, 1, 'a', 0.7), (0, 1, 'b', -1.5)) v(chain, draw, regressor, coef)) SELECT series_id, CAST(chain AS INT) AS chain, CAST(draw AS INT) AS draw, t, regressor, round(coef * CASE regressor WHEN 'a' THEN t ELSE y / 1000 END, 6) AS value FROM ev CROSS JOIN d")
def j8(spark, d):
    e = c.events(spark, d)
    draws = spark.createDataFrame([(0, 0, ["a", "b"], [0.5, -1.0]), (0, 1, ["a", "b"], [0.7, -1.5])], "chain int, draw int, regressors array<string>, coef array<double>")
    fits = e.select("series_id").distinct().crossJoin(F.broadcast(draws))
    long = e.select("series_id", "t", F.col("t").cast("double").alias("a"), (F.col("y") / 1000).alias("b")).unpivot(["series_id", "t"], ["a", "b"], "regressor", "x")
    out = estimate.contributions(fits, long)
    return out.select("series_id", "chain", "draw", "t", "regressor", c.r(F.col("value"), "value"))


@query("j10_training_volume", "SELECT c_custkey AS id, c_mktsegment AS segment, coalesce(v, 0.0) AS v FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j10(spark, d):
    volume = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return table(spark, d, "customer").join(volume, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query("x1_b5_wide_to_long", "SELECT p_partkey, CAST(i AS INT) AS day, p_retailprice * i AS x FROM part CROSS JOIN (VALUES (1), (2), (10)) k(i)")
def x1(spark, d):
    wide = table(spark, d, "part").select("p_partkey", *((F.col("p_retailprice") * i).alias(f"d_{i}") for i in (10, 2, 1)))
    return src.wide_to_long(wide, ["p_partkey"], "d_", "x").select("p_partkey", "day", "x")


@query("x3_x4_x5_union", f"WITH {c.EV} SELECT series_id, t, y, 'seen' AS part FROM ev UNION ALL SELECT series_id, t + 30, y, 'ahead' FROM ev")
def x3(spark, d):
    e = c.events(spark, d).select("series_id", "t", "y")
    ahead = e.select("series_id", (F.col("t") + 30).alias("t"), "y", F.lit("ahead").alias("part"))
    return e.withColumn("part", F.lit("seen")).unionByName(ahead)


@query("x6_distinct_windows", "SELECT DISTINCT CAST((event_id % 50) + i AS BIGINT) AS t FROM events CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS i)")
def x6(spark, d):
    starts = table(spark, d, "events").select((F.col("event_id") % 50).alias("s")).distinct()
    return starts.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.col("s") + i).cast("long"))).alias("t")).distinct()


@query("x10_expanded_noise", "SELECT event_id, value AS q1, value / 2 AS q2, value / 2 AS q4 FROM events")
def x10(spark, d):
    q = ft.expanded_sigma(F.array(F.col("value"), F.col("value") / 2), 4)
    return table(spark, d, "events").select("event_id", q[0].alias("q1"), q[1].alias("q2"), q[3].alias("q4"))


# ---------------------------------------------------------------- aggregation and reports


@query("a5_a6_summary")
def a5(spark, d):
    return scoring.summary(c._draws(spark, d), ["series_id"], "value")


@query("a10_rowwise", "SELECT o_custkey, count(*) AS n, round(avg(abs(a - b)), 9) AS mae, round(sqrt(avg((a - b) * (a - b))), 9) AS rmse, round(CASE WHEN stddev_pop(a) > 1e-9 AND stddev_pop(b) > 1e-9 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END, 6) AS pearson FROM (SELECT o_custkey, o_totalprice / 1000 AS a, CAST(o_orderkey % 100 AS DOUBLE) AS b FROM orders) GROUP BY 1 HAVING count(*) > 2")
def a10(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("a"), (F.col("o_orderkey") % 100).cast("double").alias("b"))
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 2")
    out = scoring.differences(o, ["o_custkey"], "a", "b").join(n, "o_custkey")
    return out.select("o_custkey", "n", *(c.r(F.col(x), x, 6 if x == "pearson" else 9) for x in ("mae", "rmse", "pearson")))


@query("a12_volume", f"WITH {c.LI} SELECT series_id, round(sum(y), 2) AS volume FROM li GROUP BY series_id")
def a12(spark, d):
    return c.lines(spark, d).groupBy("series_id").agg(F.round(F.sum("y"), 2).alias("volume"))


@query("s13_submission_long", "SELECT n_name AS id, CAST(h AS INT) AS h, CAST(n_nationkey + h AS DOUBLE) AS forecast FROM nation CROSS JOIN (VALUES (1), (2), (3)) k(h)")
def s13(spark, d):
    wide = table(spark, d, "nation").select(F.col("n_name").alias("id"), *((F.col("n_nationkey") + h).cast("double").alias(f"F{h}") for h in (1, 2, 3)))
    return src.unpivoted(src.checked_submission(wide, 3, 25), 3).select("id", "h", "forecast")


_RETAIL = """cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ds FROM orders), first AS (SELECT min(ds) AS lo FROM cal),
days AS (SELECT ds, date_diff('day', lo, ds) + 1 AS day, CAST(floor(date_diff('day', lo, ds) / 7) AS BIGINT) AS wk FROM cal CROSS JOIN first),
series AS (SELECT DISTINCT n_name || '_validation' AS id, n_name AS item, r_name AS store FROM nation JOIN region ON n_regionkey = r_regionkey),
price AS (SELECT store, item, wk, 1.0 + CAST(length(item) AS DOUBLE) + wk % 3 AS sell_price FROM series CROSS JOIN (SELECT DISTINCT wk FROM days WHERE wk % 2 = 0))"""


@query("s14_retail_panel", f"WITH {_RETAIL} SELECT item AS series_id, ds, CAST(day AS INT) AS day, CASE day WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 20.0 WHEN 3 THEN 30.0 END AS sales, sell_price, CAST(CASE store WHEN 'ASIA' THEN day % 2 WHEN 'EUROPE' THEN 0 END AS TINYINT) AS snap, CAST(isodow(ds) - 1 AS TINYINT) AS dow, CASE WHEN day <= 1913 THEN 'train' WHEN day <= 1941 THEN 'validation' ELSE 'test' END AS split FROM series CROSS JOIN days LEFT JOIN price USING (store, item, wk)")
def s14(spark, d):
    lo = table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("lo"))
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().crossJoin(F.broadcast(lo))
    n = F.datediff("date", "lo")
    calendar = days.select("date", F.floor(n / 7).cast("long").alias("wm_yr_wk"), F.concat(F.lit("d_"), n + 1).alias("d"), ((n + 1) % 2).alias("snap_ASIA"), F.lit(0).alias("snap_EUROPE"))
    series = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    sales = series.select(F.concat("n_name", F.lit("_validation")).alias("id"), F.col("n_name").alias("item_id"), F.lit("d").alias("dept_id"), F.lit("c").alias("cat_id"), F.col("r_name").alias("store_id"), F.col("r_name").alias("state_id"), F.lit(10).alias("d_1"), F.lit(20).alias("d_2"), F.lit(30).alias("d_3"))
    weeks = calendar.select("wm_yr_wk").distinct().filter("wm_yr_wk % 2 = 0")
    prices = sales.select("store_id", "item_id").crossJoin(F.broadcast(weeks)).withColumn("sell_price", 1.0 + F.length("item_id") + F.col("wm_yr_wk") % 3)
    return src.retail_panel(calendar, prices, sales).select("series_id", "ds", "day", "sales", "sell_price", "snap", "dow", "split")


@query("s17_i6_ribbons", "SELECT 'level' AS variable, CAST(event_id % 7 AS BIGINT) AS t, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, CASE WHEN event_id % 7 = 3 THEN 2.5::DOUBLE END AS a_obs FROM events GROUP BY event_id % 7")
def s17(spark, d):
    draws = table(spark, d, "events").select((F.col("event_id") % 7).alias("t"), F.lit("level").alias("variable"), "value")
    told = spark.createDataFrame([("level", 3, 2.5, 0.1), ("level", 4, 0.0, float("inf"))], "variable string, t long, a_obs double, p_obs double")
    out = scoring.state_ribbons(draws, ["t"], ["level"], told)
    return out.select("variable", "t", *(c.r(F.col(q), q) for q in ("q05", "q50", "q95")), "a_obs")


@query("w3_w4_train_test", f"WITH {c.LI}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS i FROM li) SELECT series_id, ds, y, CASE WHEN i <= 90 THEN 'test' ELSE 'train' END AS part FROM n")
def w4(spark, d):
    last = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ds")))
    return c.lines(spark, d).withColumn("part", F.when(last <= 90, "test").otherwise("train"))
