"""Regression schemes: which regressors there are, with sign and prior, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNS = ("=", "+", "-")
SCHEMA = T.StructType([T.StructField("regressor", T.StringType()), T.StructField("sign", T.StringType()), T.StructField("loc_prior", T.DoubleType()), T.StructField("scale_prior", T.DoubleType())])


class RegressionScheme:
    """An immutable table of regressors; each change gives a new scheme, sorted by regressor."""

    def __init__(self, spark: SparkSession, table: DataFrame | None = None):
        self.spark = spark
        self.table = table if table is not None else spark.createDataFrame([], SCHEMA)
        self.validate(self.table)

    @staticmethod
    def validate(table: DataFrame) -> None:
        if "regressor" not in table.columns:
            raise ValueError("a scheme is keyed by regressor")
        if missing := {"sign", "loc_prior", "scale_prior"} - set(table.columns):
            raise ValueError(f"a scheme needs {sorted(missing)}")
        if not table.filter(~F.col("sign").isin(*SIGNS)).isEmpty():
            raise ValueError(f"signs are {SIGNS}")

    def update(self, new: DataFrame) -> RegressionScheme:
        """What is not null in ``new`` wins; regressors of both stay."""
        old = self.table.alias("o")
        joined = old.join(new.alias("n"), F.col("o.regressor") == F.col("n.regressor"), "full_outer")
        merged = joined.select(*(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in SCHEMA.names))
        return RegressionScheme(self.spark, merged.orderBy("regressor"))

    def add_regressors(self, names: list[str], sign="=", loc=0.0, scale=1.0) -> RegressionScheme:
        """Adds or overwrites regressors; the other arguments are one for all or a list."""
        spread = [v if isinstance(v, list) else [v] * len(names) for v in (sign, loc, scale)]
        if any(len(v) != len(names) for v in spread):
            raise ValueError("a list needs one entry for each regressor")
        return self.update(self.spark.createDataFrame([(n, s, float(lo), float(sc)) for n, s, lo, sc in zip(names, *spread, strict=True)], SCHEMA))

    def regressors(self) -> list[str]:
        return [r.regressor for r in self.table.select("regressor").orderBy("regressor").collect()]
