"""Aggregation, quantiles, hierarchies and forecast scores in Spark SQL; chain diagnostics in NumPy."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import saved, scratch


def grouped_sums(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def _summed_levels(df: DataFrame, levels: list[tuple[int, list[str]]], keys: list[str], by: list[str], values: list[str]) -> DataFrame:
    """level, keys, by and values at the numbered levels, in one pass of GROUPING SETS."""
    columns = [F.col(k) for k in keys]
    sets = [[F.col(c) for c in [*lv, *by]] for _, lv in levels]
    summed = df.groupingSets(sets, *columns, *map(F.col, by)).agg(F.grouping_id().alias("_g"), *(F.sum(v).alias(v) for v in values))
    everything = [*keys, *by]
    number = None
    for i, lv in levels:
        code = sum(1 << (len(everything) - 1 - p) for p, c in enumerate(everything) if c not in lv and c not in by)
        number = F.when(F.col("_g") == code, i) if number is None else number.when(F.col("_g") == code, i)
    return summed.withColumn("level", number).drop("_g")


def _closed(level: list[str], within: dict[str, str]) -> set[str]:
    out = set(level)
    while more := {within[k] for k in out if k in within} - out:
        out |= more
    return out


def hierarchy_sums(df: DataFrame, levels: list[list[str]], by: list[str], values: list[str], within: dict[str, str] | None = None) -> DataFrame:
    """Sums at every level of a hierarchy.

    A level is a list of key columns; ``by`` is kept at all of them. ``level`` counts from 1. GROUPING
    SETS read each row once a level. ``within`` says what key lies in what other (a store in its state):
    then the level from which most others follow is summed first, and those are summed from its rows,
    so the rows of df are read once for it and once for each level that does not follow."""
    keys = list(dict.fromkeys(k for lv in levels for k in lv))
    numbered = list(enumerate(levels, 1))
    closed = {i: _closed(lv, within or {}) for i, lv in numbered}
    under = {i: [j for j, lv in numbered if set(lv) <= closed[i]] for i in closed}
    finest = max(len(closed[i]) for i in closed)
    waist = max((i for i in closed if len(closed[i]) < finest), key=lambda i: (len(under[i]), -len(closed[i])), default=0) if within else 0
    if not waist or len(under[waist]) < 3:
        return _summed_levels(df, numbered, keys, by, values)
    of_waist = [k for k in keys if k in closed[waist]]
    narrow = df.groupBy(*of_waist, *by).agg(*(F.sum(v).alias(v) for v in values))
    low = _summed_levels(narrow, [(j, lv) for j, lv in numbered if j in under[waist]], of_waist, by, values)
    rest = [(j, lv) for j, lv in numbered if j not in under[waist]]
    return low.unionByName(_summed_levels(df, rest, keys, by, values), allowMissingColumns=True) if rest else low.select(*(F.col(k) if k in of_waist else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys), *by, *values, "level")


def quantiles(df: DataFrame, keys: list[str], value: str, qs=(0.05, 0.5, 0.95)) -> DataFrame:
    """Exact, linearly interpolated quantiles in columns q05, q50 and so on."""
    packed = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, qs))).alias("_q"))
    return packed.select(*keys, *(F.col("_q")[i].alias(f"q{round(q * 100):02d}") for i, q in enumerate(qs)))


def whole_quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Exact, linearly interpolated quantiles of a whole column, without gathering it anywhere.

    Equal values are counted together, their counts are dealt out by ranges of the value, and the driver
    gets the sums of the ranges and the values at the wanted ranks. Nulls are left out; an empty column
    has nulls."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = saved(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), scratch(spark, "ranges"))
    spans = sorted((r.low, r.part, r.n) for r in ranged.groupBy("part").agg(F.min("v").alias("low"), F.sum("n").alias("n")).collect())
    total = sum(n for _, _, n in spans)
    if not total:
        return [None] * len(qs)
    at = [q * (total - 1) for q in qs]
    ranks = sorted({int(np.floor(x)) for x in at} | {int(np.ceil(x)) for x in at})
    starts, begin = {}, 0
    for _, part, n in spans:
        starts[part] = begin
        begin += n
    wanted = {p: [k - starts[p] for k in ranks if starts[p] <= k < starts[p] + n] for _, p, n in spans}
    wanted = {p: ks for p, ks in wanted.items() if ks}
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    some = ranged.filter(F.col("part").isin(*wanted)).withColumn("upto", upto)
    hit = None
    for p, ks in wanted.items():
        for k in ks:
            own = (F.col("part") == p) & (F.col("upto") > k) & (F.col("upto") - F.col("n") <= k)
            hit = own if hit is None else hit | own
    rows = [(starts[r.part] + r.upto - r.n, starts[r.part] + r.upto, r.v) for r in some.filter(hit).collect()]
    find = lambda k: next(v for low, high, v in rows if low <= k < high)
    return [find(int(np.floor(x))) + (x - np.floor(x)) * (find(int(np.ceil(x))) - find(int(np.floor(x)))) for x in at]


def hdi(df: DataFrame, keys: list[str], value: str, mass: float = 0.94) -> DataFrame:
    """Shortest interval that holds ``mass`` of the draws within the keys."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = df.withColumns({"_i": F.row_number().over(w), "_n": n}).withColumn("_k", F.floor(F.col("_n") * mass).cast("int"))
    ahead = ranked.alias("h").select(*keys, F.col("_i").alias("_j"), F.col(value).alias("_upper"))
    ends = ranked.withColumn("_j", F.col("_i") + F.col("_k")).join(ahead, [*keys, "_j"])
    best = F.min(F.struct((F.col("_upper") - F.col(value)).alias("w"), F.col(value).alias("lo"), F.col("_upper").alias("hi"))).alias("b")
    return ends.groupBy(*keys).agg(best).select(*keys, F.col("b.lo").alias("hdi_low"), F.col("b.hi").alias("hdi_high"))


def split_rhat(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Split R-hat of draws (chain, draw): each chain counts as two halves."""
    last = F.max("draw").over(Window.partitionBy(*keys, "chain"))
    halves = df.withColumn("_half", (F.col("draw") > last / 2).cast("int"))
    each = halves.groupBy(*keys, "chain", "_half").agg(F.avg(value).alias("m"), F.var_samp(value).alias("s"), F.count("*").alias("n"))
    out = each.groupBy(*keys).agg(F.avg("s").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    return out.select(*keys, F.when(F.col("w") > 0, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))).alias("r_hat"))


def _autocovariance(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    padded = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(1, keepdims=True), padded, axis=1)
    return np.fft.irfft(f * np.conj(f), padded, axis=1)[:, :n] / n


def effective_size(x: np.ndarray) -> float:
    """Effective number of draws (chains, draws), by Geyer's initial monotone sequence."""
    m, n = x.shape
    if n < 4 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return float("nan") if not np.isfinite(x).all() else float(m * n)
    cov = _autocovariance(x)
    within = cov[:, 0].mean() * n / (n - 1)
    whole = within * (n - 1) / n + (x.mean(1).var(ddof=1) if m > 1 else 0.0)
    rho = 1 - (within - cov.mean(0) * n / (n - 1)) / whole
    rho[0] = 1.0
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    negative = np.flatnonzero(pairs < 0)
    pairs = np.minimum.accumulate(pairs[: negative[0] if len(negative) else len(pairs)])
    return float(m * n / max(-1 + 2 * pairs.sum(), 1 / np.log10(max(m * n, 10))))


def _halves(x: np.ndarray) -> np.ndarray:
    n = x.shape[1] // 2
    return np.vstack([x[:, :n], x[:, -n:]])


def rank_normalised(x: np.ndarray) -> np.ndarray:
    """Normal scores of the average ranks of all draws."""
    _, at, counts = np.unique(x.ravel(), return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[at.ravel()]
    score = NormalDist().inv_cdf
    return np.array([score(float(r)) for r in (rank - 0.375) / (x.size + 0.25)]).reshape(x.shape)


def r_hat(x: np.ndarray) -> float:
    m, n = x.shape
    within, between = x.var(1, ddof=1).mean(), x.mean(1).var(ddof=1)
    return float(np.sqrt(((n - 1) / n * within + between) / within)) if within > 0 else float("nan")


SUMMARY = "mean double, sd double, hdi_low double, hdi_high double, mcse_mean double, ess_bulk double, r_hat double, split_r_hat double, n_eff double, converged boolean"


def summary(df: DataFrame, keys: list[str], value: str, mass: float = 0.94, most_r_hat: float = 1.01, least_n: float = 100.0) -> DataFrame:
    """Mean, deviation, shortest interval and chain diagnostics of the draws (keys, chain, draw, value).

    ``r_hat`` and ``ess_bulk`` are of rank-normalised half chains, r_hat the larger of the bulk's and the
    folded draws'; ``split_r_hat`` and ``n_eff`` of the half chains as they are, from which ``converged``
    is told. Chains are cut to the shortest. A group is the draws of one quantity."""
    kinds = df.select(*keys).schema
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds]) + ", " + SUMMARY

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("chain", "ascending"), ("draw", "ascending")])
        chain, v = np.asarray(rows.column("chain")), np.asarray(rows.column(value).combine_chunks().cast(pa.float64()))
        own = np.split(v, np.flatnonzero(chain[1:] != chain[:-1]) + 1)
        n = min(map(len, own))
        x = np.array([c[:n] for c in own])
        flat = np.sort(x.ravel())
        k = int(np.floor(mass * len(flat)))
        low = int(np.argmin(flat[k:] - flat[: len(flat) - k]))
        sd = float(x.std(ddof=1)) if x.size > 1 else 0.0
        halves = _halves(x) if n >= 4 else x
        z = rank_normalised(halves)
        folded = rank_normalised(np.abs(halves - np.median(halves)))
        plain, size = (r_hat(halves), effective_size(halves)) if n >= 4 else (float("nan"), float("nan"))
        bulk = effective_size(z) if n >= 4 else float("nan")
        ranked = max(r_hat(z), r_hat(folded)) if n >= 4 else float("nan")
        # of the mean itself: its own effective size, not that of the ranks
        out = [float(x.mean()), sd, float(flat[low]), float(flat[low + k]) if k < len(flat) else float(flat[-1]), sd / np.sqrt(size), bulk, ranked, plain, size, bool(plain <= most_r_hat and size >= least_n)]
        return pa.table([*(pa.array([g.as_py()], g.type) for g in key), *(pa.array([o]) for o in out)], [*keys, *(f.split()[0] for f in SUMMARY.split(", "))])

    return df.select(*keys, "chain", "draw", value).groupBy(*keys).applyInArrow(run, schema)


def state_ribbons(draws: DataFrame, keys: list[str], variables: list[str], disclosed: DataFrame | None = None, qs=(0.05, 0.5, 0.95)) -> DataFrame:
    """What a plot of states shows: quantiles over chains and draws of each variable (keys, variable,
    value), and the disclosed mean and variance where ``disclosed`` (keys, variable, a_obs, p_obs) has a
    finite variance. No variables, and variables that are not there, are errors."""
    if not variables:
        raise ValueError("no variables")
    own = draws.filter(F.col("variable").isin(*variables))
    ribbons = quantiles(own, ["variable", *keys], "value", qs)
    if disclosed is None:
        return ribbons
    told = disclosed.filter(F.abs("p_obs") < float("inf")).select("variable", *keys, "a_obs", "p_obs")
    return ribbons.join(told, ["variable", *keys], "left")


def series_log_likelihood(filtered: DataFrame, keys: list[str]) -> DataFrame:
    """Log-likelihood from innovations and their variances."""
    return filtered.groupBy(*keys).agg(F.sum(-0.5 * (F.log(2 * F.pi()) + F.log("f") + F.col("v") * F.col("v") / F.col("f"))).alias("log_p"))


def weekly(df: DataFrame, keys: list[str], ds: str, value: str) -> DataFrame:
    """Sums over seven-day bins that begin at the first date of all."""
    start = df.agg(F.min(ds).alias("_start"))
    binned = df.crossJoin(F.broadcast(start)).withColumn("week", F.floor(F.datediff(ds, "_start") / 7).cast("long"))
    return binned.groupBy(*keys, "week").agg(F.sum(value).alias(value))


def _percentiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> list[Column]:
    """Exact quantiles as aggregates of the groups, or as numbers where the whole table is one."""
    if keys:
        return [F.percentile(value, q) for q in qs]
    return [F.lit(q).cast("double") for q in whole_quantiles(df, value, qs)]


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    p25, p50, p75 = _percentiles(df, keys, value, [0.25, 0.5, 0.75])
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), p25.alias("p25"),
        p50.alias("p50"), p75.alias("p75"), F.max(v).alias("max"), F.avg((v == 0).cast("double")).alias("frac_zero"),
    )


def differences(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """MAE, RMSE, median absolute difference, bias and correlation (null without variance)."""
    d = F.col(a) - F.col(b)
    df = df.withColumn("_abs", F.abs(d))
    (median,) = _percentiles(df, keys, "_abs", [0.5])
    out = df.groupBy(*keys).agg(F.avg("_abs").alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), median.alias("median_abs"), F.avg(d).alias("bias"), F.stddev_pop(a).alias("_a"), F.stddev_pop(b).alias("_b"), F.covar_pop(a, b).alias("_c"))
    return out.withColumn("pearson", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_c") / (F.col("_a") * F.col("_b")))).drop("_a", "_b", "_c")


def smape(df: DataFrame, keys: list[str], actual: str, forecast: str) -> DataFrame:
    a, f = F.col(actual), F.col(forecast)
    size = F.abs(a) + F.abs(f)
    return df.groupBy(*keys).agg(F.avg(F.when(size > 0, 2 * F.abs(f - a) / size).otherwise(0.0)).alias("smape"), F.avg(F.abs(f - a)).alias("mae"))


def quantile_buckets(df: DataFrame, value: str, n: int) -> DataFrame:
    """Adds ``bucket`` 1..n by quantile edges; equal edges fall together, intervals close on the right."""
    edges = sorted({q for q in whole_quantiles(df, value, [i / n for i in range(n + 1)]) if q is not None})
    inside = F.lit(0)
    for e in edges:
        inside = inside + (F.col(value) > F.lit(e)).cast("int")
    return df.withColumn("bucket", F.when(F.col(value).isNotNull(), F.greatest(F.lit(1), inside)))


def equal_width_histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Counts in equal-width bins from the least to the largest value; the last bin is closed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width)).cast("int")
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", F.when(width > 0, at).otherwise(0)).groupBy("bin").agg(F.count("*").alias("n"))


def top(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(value), tie).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for the same seed whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def best_iteration(df: DataFrame, keys: list[str], loss: str, iteration: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.struct(loss, iteration)).alias("b")).select(*keys, F.col(f"b.{loss}").alias("best_loss"), F.col(f"b.{iteration}").alias("best_iteration"))


def first_difference(df: DataFrame, keys: list[str], order: str, value: str) -> Column:
    return F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))


def last_rows(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def sliding_windows(df: DataFrame, keys: list[str], order: str, value: str, h: int) -> DataFrame:
    """Every run of h successive values as an array; a series has n - h + 1 of them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, h - 1)
    return df.withColumn("span", F.collect_list(value).over(w)).filter(F.size("span") == h)


def last_value(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.max_by(v, order).alias(v) for v in values))


def wrmsse(train: DataFrame, valid: DataFrame, levels: list[list[str]], keys: list[str], horizon: int = 28, within: dict[str, str] | None = None) -> DataFrame:
    """Weighted scaled errors and bias at each level of a hierarchy, one row a level; the final score is
    the mean of ``wrmsse`` over the levels.

    train has keys, t, sales and price; valid has keys, t, sales and forecast. A series weighs what
    it earned in its last ``horizon`` training steps, and nothing if one of them has no sales or
    price; all weigh the same where nothing was earned. Scales are mean squared first differences over
    the whole training span, 1 where that is 0. ``actual_mean``, ``forecast_mean`` and ``bias_signed`` are
    means by weight, and ``bias_pct`` is that of each group's own relative bias (to 1 where its actual
    mean is 0). Keys that a level does not group by are null there and compared as such; ``within`` is
    that of ``hierarchy_sums``. Training and validation are summed in one pass."""
    spans = valid.groupBy(*keys).count().filter(F.col("count") != horizon)
    if not spans.isEmpty():
        raise ValueError(f"the validation span of a series is not {horizon} steps")
    recent = last_rows(train, keys, "t", horizon)
    product = F.col("sales") * F.col("price")
    dollars = recent.groupBy(*keys).agg(F.when(F.count(product) == horizon, F.sum(product)).otherwise(0.0).alias("dollars"))
    all_keys = list(dict.fromkeys(k for lv in levels for k in lv))
    on = ["level", *all_keys]
    both = train.select(*all_keys, "t", "sales", F.lit(None).cast("double").alias("forecast"), F.lit(True).alias("seen"))
    both = both.unionByName(valid.select(*all_keys, "t", "sales", F.col("forecast").cast("double").alias("forecast"), F.lit(False).alias("seen")))
    sums = hierarchy_sums(both, levels, ["t", "seen"], ["sales", "forecast"], within)
    d = F.when(F.col("seen"), first_difference(sums, [*on, "seen"], "t", "sales"))
    e = F.when(~F.col("seen"), F.col("forecast") - F.col("sales"))
    later = lambda c: F.avg(F.when(~F.col("seen"), F.col(c)))
    each = sums.withColumns({"_d": d, "_e": e}).groupBy(*on).agg(F.avg(F.col("_d") * F.col("_d")).alias("scale"), F.avg(F.col("_e") * F.col("_e")).alias("mse"), later("sales").alias("actual"), later("forecast").alias("forecast"))
    each = each.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    weight = hierarchy_sums(dollars, levels, [], ["dollars"], within)
    w = weight.withColumnsRenamed({c: f"w_{c}" for c in on})
    joined = each.join(w, [each[c].eqNullSafe(w[f"w_{c}"]) for c in on])
    bias = F.col("forecast") - F.col("actual")
    measures = {"wrmsse": F.sqrt("mse") / F.sqrt("scale"), "actual_mean": F.col("actual"), "forecast_mean": F.col("forecast"), "bias_signed": bias, "bias_pct": 100 * bias / F.when(F.col("actual") == 0, 1.0).otherwise(F.col("actual"))}
    by_weight = lambda c: F.when(F.sum("dollars") > 0, F.sum(c * F.col("dollars")) / F.when(F.sum("dollars") > 0, F.sum("dollars"))).otherwise(F.avg(c))
    return joined.groupBy("level").agg(F.count("*").alias("n_series"), F.avg(measures["wrmsse"]).alias("mean_rmsse"), *(by_weight(c).alias(name) for name, c in measures.items()))


def predictive_interval(draws: DataFrame, keys: list[str], mean: str, noise: str, norm: Column | None = None, qs=(0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles over draws of exp(mean + noise) times the norm of the response."""
    value = F.exp(F.col(mean) + F.col(noise)) * (F.lit(1.0) if norm is None else norm)
    return quantiles(draws.withColumn("_v", value), keys, "_v", qs)


def attribution_ribbons(states: DataFrame, keys: list[str], ds: str, n: int, qs=(0.05, 0.5, 0.95)) -> DataFrame:
    """Weekly contributions of each state: keys, state (from 0), week and quantiles over the draws.

    states has the keys, chain, draw, the date, and the arrays ``a_nat`` (states on the natural scale)
    and ``z``. A draw's contributions are a_nat times z, summed over the series and days of a week; weeks
    are of seven days from the first date of all."""
    parts = F.posexplode(F.zip_with("a_nat", "z", lambda a, z: a * z)).alias("state", "value")
    each = states.select(*keys, "chain", "draw", ds, parts).filter(F.col("state") < n)
    return quantiles(weekly(each, [*keys, "chain", "draw", "state"], ds, "value"), [*keys, "state", "week"], "value", qs)
