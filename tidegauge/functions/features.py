"""Feature construction as Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    """NaN stays NaN (least and greatest would take it for the largest number)."""
    return F.when(F.isnan(x), x).when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def hill(x, k, s, max_effect=1.0):
    """Saturating response ``max * x**s / (k**s + x**s)``: 0 for x <= 0 and NaN, null for null.

    Plain numbers give a number, columns a column."""
    if not any(isinstance(v, Column | str) for v in (x, k, s, max_effect)):
        return 0.0 if math.isnan(x) or x <= 0 else max_effect * x**s / (k**s + x**s)
    x, k, s, top = map(_c, (x, k, s, max_effect))
    raised = F.pow(x, s)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x) | (x <= 0), 0.0).otherwise(top * raised / (F.pow(k, s) + raised))


def log_saturation(x, saturation) -> Column:
    """``log(1 + x / saturation)``."""
    ratio = _c(x) / _c(saturation)
    return F.when(ratio > -1, F.log1p(ratio))


def _waves(t: Column, period: float, order: int, sines_first: bool) -> list[Column]:
    args = [t * F.lit(2 * math.pi * i / period) for i in range(1, order + 1)]
    cos = [F.cos(a).alias(f"cos_{i + 1}") for i, a in enumerate(args)]
    sin = [F.sin(a).alias(f"sin_{i + 1}") for i, a in enumerate(args)]
    return sin + cos if sines_first else cos + sin


def fourier_index(index, period: float, order: int = 3, shift: float = 0.0) -> list[Column]:
    """Cosines, then sines, of the one-based step number ``index + 1 + shift`` (index from 0)."""
    return _waves(_c(index) + F.lit(1.0 + shift), period, order, False)


def fourier_timestamp(ts, period: float, order: int = 3) -> list[Column]:
    """Cosines, then sines, of fractional days since the epoch, whole seconds."""
    return _waves(F.unix_timestamp(_c(ts)) / F.lit(86400.0), period, order, False)


def fourier_steps(index, period: float, order: int = 3) -> list[Column]:
    """Sines, then cosines, of the zero-based step number."""
    return _waves(_c(index).cast("double"), period, order, True)


def periodic_dummies(index, period: int, drop_first: bool = True) -> list[Column]:
    """One-hot columns of ``index mod period``."""
    return [F.when(F.pmod(_c(index), F.lit(period)) == j, 1.0).otherwise(0.0).alias(f"period_{j}") for j in range(int(drop_first), period)]


def weekday_dummies(ds) -> list[Column]:
    """Tuesday to Sunday against Monday."""
    return [F.when(F.weekday(_c(ds)) == j, 1.0).otherwise(0.0).alias(f"dow_{j}") for j in range(1, 7)]


def global_trend(index, offset: int = 0) -> list[Column]:
    """Intercept and slope a year; future steps go on at ``offset``."""
    return [F.lit(1.0).alias("intercept"), ((_c(index) + offset) / F.lit(365.25)).alias("slope")]


def log_response(df: DataFrame, keys: list[str], y: str, floor: float = 0.1) -> DataFrame:
    """Adds ``response_norm``, the mean of y held above the floor, and ``response``, its logarithm."""
    held = F.greatest(F.col(y), F.lit(floor))
    norm = F.avg(held).over(Window.partitionBy(*keys))
    return df.withColumn("response_norm", norm).withColumn("response", F.log(held / F.col("response_norm")))


def mean_normalised(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Divides each column by its mean within the keys (null where that is 0)."""
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.try_divide(F.col(c), F.avg(c).over(w)) for c in columns})


def offset_first(trend: list, states: list) -> Column:
    """State array whose first entry is the sum of the trend columns."""
    return F.concat(F.array(sum((_c(c) for c in trend[1:]), _c(trend[0]))), F.array(*map(_c, states)))


def date_parts(ds) -> list[Column]:
    d = _c(ds)
    return [F.weekday(d).cast("tinyint").alias("dow"), F.dayofmonth(d).cast("tinyint").alias("dom"), F.month(d).cast("tinyint").alias("month")]


def split_label(day, train_end: int = 1913, valid_end: int = 1941) -> Column:
    """train, validation or test by the number in a day name such as d_17, or by a number."""
    n = F.regexp_replace(_c(day).cast("string"), "^d_", "").cast("int")
    return F.when(n <= train_end, "train").when(n <= valid_end, "validation").otherwise("test")


def strip_suffix(series) -> Column:
    return F.regexp_replace(_c(series), "_(validation|evaluation)$", "")


def swap_suffix(series, to: str = "evaluation") -> Column:
    return F.regexp_replace(_c(series), "_(validation|evaluation)$", f"_{to}")


def a_to_lam(states, exponent: float = 0.5, mask: list[bool] | None = None) -> Column:
    """``exp(k * a)`` of the masked entries of an array (all without a mask); unclipped."""
    if mask is None:
        return F.transform(_c(states), lambda a: F.exp(a * exponent))
    return F.zip_with(_c(states), F.array(*map(F.lit, mask)), lambda a, m: F.when(m, F.exp(a * exponent)).otherwise(a))


def lam_to_a(lam, exponent: float = 0.5, mask: list[bool] | None = None) -> Column:
    """The inverse of ``a_to_lam``; null where a masked entry is not positive."""
    own = lambda v: F.when(v > 0, F.log(v) / exponent)
    if mask is None:
        return F.transform(_c(lam), own)
    return F.zip_with(_c(lam), F.array(*map(F.lit, mask)), lambda v, m: F.when(m, own(v)).otherwise(v))


def clipped_lam(a, exponent: float = 0.5, bound: float = 10.0) -> Column:
    """``exp(k * a)`` with the exponent held within the bound."""
    return F.exp(clip(_c(a) * exponent, -bound, bound))


def pooled_inverse_variance(df: DataFrame, keys: list[str], value: str, sd: str) -> DataFrame:
    """Means weighted by ``1 / sd**2`` within the keys, and the population deviation of the values."""
    w = 1.0 / (F.col(sd) * F.col(sd))
    return df.filter(F.col(sd) > 0).groupBy(*keys).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("pooled"), F.stddev_pop(value).alias("spread"))


def sample_number(chain, draw, n_draws: int) -> Column:
    """Chain and draw as one number, chains one after the other."""
    return _c(chain) * n_draws + _c(draw)


def expanded_sigma(q, n_states: int) -> Column:
    """A pair of deviations as one for each state: the first state's, then the other for all others."""
    return F.concat(F.array(_c(q)[0]), F.array_repeat(_c(q)[1], n_states - 1))


def softplus(x) -> Column:
    return F.log1p(F.exp(_c(x)))


def softplus_inverse(v) -> Column:
    return F.log(F.expm1(_c(v)) + 1e-12)


def generate_seed() -> int:
    return int(time.time())
