"""Reading, reshaping and joining panels; sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import date_parts, split_label, strip_suffix

_folder: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a temporary one where none is set."""
    global _folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _folder = _folder or f"file://{tempfile.mkdtemp(prefix='tidegauge-')}"
        named = _folder
    return f"{named.rstrip('/')}/tidegauge/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and an explicit schema; dates are parsed by it."""
    return spark.read.csv(path, header=True, schema=schema)


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several paths that exists, on any file system of Spark's."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return read_csv(spark, path, schema)
    raise FileNotFoundError(f"none of {paths}")


def write_panel(df: DataFrame, path: str, partition_by: str = "split") -> None:
    df.write.partitionBy(partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``t``, the number of a row within its series from 0."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def daily(df: DataFrame, series: Column, ts: Column, value: Column) -> DataFrame:
    """series_id, ds, y: sums a day, rounded so that the order of summation does not show."""
    return df.groupBy(series.alias("series_id"), F.to_date(ts).alias("ds")).agg(F.round(F.sum(value), 6).alias("y"))


def gap_filled(df: DataFrame) -> DataFrame:
    """Every date between the first and last of all, for each series; y is null where there is none."""
    ends = df.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    days = ends.select(F.explode(F.sequence("lo", "hi")).alias("ds"))
    return df.select("series_id").distinct().crossJoin(F.broadcast(days)).join(df, ["series_id", "ds"], "left")


def wide_to_long(df: DataFrame, id_columns: list[str], prefix: str, value: str) -> DataFrame:
    """Columns such as d_1, d_2 as rows, with their number, in numeric order of the suffix."""
    columns = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c.removeprefix(prefix)))
    long = df.unpivot(id_columns, columns, "_name", value)
    return long.withColumn("day", F.regexp_replace("_name", f"^{prefix}", "").cast("int")).drop("_name")


def long_to_wide(df: DataFrame, key: str, column: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(key).pivot(column, names).agg(F.first(value))


def align_by_id(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables that must have the same ids."""
    for one, other in ((a, b), (b, a)):
        if not one.select(key).join(other.select(key), key, "left_anti").isEmpty():
            raise ValueError("the tables have different ids")
    return a.join(b, key)


def submission(template: DataFrame, predictions: DataFrame, horizon: int) -> DataFrame:
    """template (id, place) with the predictions' F1..Fh for validation ids and their evaluation twins."""
    columns = [f"F{i}" for i in range(1, horizon + 1)]
    twin = predictions.withColumn("id", F.regexp_replace("id", "_validation$", "_evaluation"))
    out = template.join(predictions.unionByName(twin), "id", "left").orderBy("place").select("id", *columns)
    if out.count() != template.count() or not out.filter(" or ".join(f"{c} is null" for c in columns)).isEmpty():
        raise ValueError("the submission does not cover the template")
    return out


SUBMISSION_ROWS = 60_980


def checked_submission(df: DataFrame, horizon: int = 28, rows: int | None = SUBMISSION_ROWS) -> DataFrame:
    """A table of forecasts that has id and F1..Fh in order and as many rows as it should."""
    wanted = ["id", *(f"F{i}" for i in range(1, horizon + 1))]
    if df.columns != wanted:
        raise ValueError(f"the columns are {df.columns}, not {wanted}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows, not {rows}")
    return df


def unpivoted(df: DataFrame, horizon: int) -> DataFrame:
    """(id, h, forecast) of a table of forecasts."""
    return wide_to_long(df, ["id"], "F", "forecast").withColumnRenamed("day", "h").filter(F.col("h") <= horizon)


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that every row of ``left`` must find in ``right``."""
    if (lost := left.join(right, key, "left_anti").select(key).first()) is not None:
        raise KeyError(f"{lost[0]!r} has no match")
    return left.join(right, key)


def merged_priors(on: list[str], *tables: DataFrame) -> DataFrame:
    """Outer join of tables of priors by their coordinates."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, on, "full_outer")
    return out


def retail_panel(calendar: DataFrame, prices: DataFrame, sales: DataFrame, train_end: int = 1913, valid_end: int = 1941) -> DataFrame:
    """One row a series and calendar day: hierarchy, sales (null where the table of sales ends before
    the calendar), price of the week, snap of the state, date parts and split.

    calendar has date, wm_yr_wk, d and snap_<state> columns; prices has store_id, item_id, wm_yr_wk
    and sell_price, of which the least counts where there are several; sales is wide, with d_1, d_2
    and so on. The calendar is small beside the sales and broadcast; prices meet by store, item, week."""
    ids = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    states = [c for c in calendar.columns if c.startswith("snap_")]
    days = calendar.select("date", "wm_yr_wk", F.regexp_replace("d", "^d_", "").cast("int").alias("day"), F.map_from_arrays(F.array(*(F.lit(c.removeprefix("snap_")) for c in states)), F.array(*(F.col(c).cast("tinyint") for c in states))).alias("_snap"))
    series = sales.select(*ids)
    long = wide_to_long(sales, ids, "d_", "sales").select("id", "day", F.col("sales").cast("double").alias("sales"))
    fact = series.crossJoin(F.broadcast(days)).join(long, ["id", "day"], "left")
    price = prices.groupBy("store_id", "item_id", "wm_yr_wk").agg(F.min("sell_price").alias("sell_price"))
    fact = fact.join(price, ["store_id", "item_id", "wm_yr_wk"], "left")
    return fact.select(
        strip_suffix("id").alias("series_id"), *ids[1:], "day", F.to_date("date").alias("ds"), "sales", "sell_price",
        F.try_element_at("_snap", F.col("state_id")).alias("snap"), *date_parts(F.to_date("date")), split_label(F.col("day"), train_end, valid_end).alias("split"),
    )


def posterior_long(df: DataFrame, variable: str | list[str], keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """(variable, chain, draw, idx, value) of array or number columns of draws.

    variable is a column or a list of them, cut down by ``keep`` or ``drop`` (names that are not there
    are passed over; both at once, and nothing left, are errors)."""
    if keep is not None and drop is not None:
        raise ValueError("keep or drop, not both")
    names = [variable] if isinstance(variable, str) else list(variable)
    names = [n for n in names if (keep is None or n in keep) and (drop is None or n not in drop)]
    if not names:
        raise ValueError("no variable is left")
    if missing := [c for c in ("chain", "draw", *names) if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    kinds = dict(df.dtypes)
    parts = []
    for n in names:
        value = F.col(n) if kinds[n].startswith("array") else F.array(F.col(n))
        parts.append(df.select(F.lit(n).alias("variable"), "chain", "draw", F.posexplode(value.cast("array<double>")).alias("idx", "value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes a table as Parquet and reads it again, such as parameters between a fit and its use."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
