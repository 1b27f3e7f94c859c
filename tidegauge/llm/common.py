"""Helpers shared by the training-data operators: shared tables, byte-bounded Arrow blocks, words."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and Python. Texts are cut further by bytes in ``blocks``.
ARROW_ROWS = 1024
ARROW_BYTES = 8 << 20
#: Text bytes that one vectorised step of a Python worker handles at a time.
BLOCK_BYTES = 2 << 20

_own_dir: str | None = None
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a batch of very long texts still fits in a worker.

    Spark reads these settings when a plan runs, so they hold for the session: the same for every
    operator here, and only where the session has none of its own."""
    for key, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session names none."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidegauge-")
    return f"file://{_own_dir}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/tidegauge/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: the lineage is cut and
    the rows outlive any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``materialise`` that no result is computed from any more."""
    for df in tables:
        if df.written_to in _written:
            _written.remove(df.written_to)
            _remove(df.sparkSession, df.written_to)


def release(spark: SparkSession, since: int = 0) -> None:
    """Removes all that ``materialise`` and ``shared_path`` have made in this session, or what came
    after the first ``since`` of them. Results that are still to be computed from those tables must
    be written before."""
    while len(_written) > since:
        _remove(spark, _written.pop())


def written() -> int:
    """How many tables and folders there are that ``release`` would remove."""
    return len(_written)


def remainder(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES):
    """Slices of a batch whose texts hold about ``limit`` bytes each (a longer text stands alone)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The texts as large strings, null as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return pc.fill_null(column.cast(pa.large_string()), "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
