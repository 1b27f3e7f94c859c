"""Session settings, tables in the shared folder, and blocks of texts."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest

from tidegauge.llm import common, matroska, packing, queries, url_rules, warc

from .helpers import ODD, table

KEYS = tuple(f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))


@pytest.mark.parametrize("own", [False, True])
def test_settings_stay_as_they_are(spark, small, own):
    """Operators set the size of Arrow batches where the session has none, and nothing else ever."""
    old = {k: spark.conf.get(k, None) for k in KEYS}
    try:
        for k in KEYS:
            spark.conf.unset(k)
        if own:
            spark.conf.set(KEYS[0], "77")
            spark.conf.set(KEYS[1], "5000000")
        before = dict(spark.conf.getAll)
        built = [queries.QUERIES[name](spark, small) for name in ("op10_warc", "op1_packing", "op5_matroska", "op2_quality")]
        after = dict(spark.conf.getAll)
        assert {k: v for k, v in after.items() if before.get(k) != v} == ({} if own else {KEYS[0]: str(common.ARROW_ROWS), KEYS[1]: str(common.ARROW_BYTES)})
        sizes = spark.range(300).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        assert max(r.n for r in sizes.collect()) == (77 if own else 300)  # op10 has not left batches of one row
        assert built[0].count() == spark.read.parquet(f"{small}/pages.parquet").count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_are_removed(spark):
    start = common.written()
    first, second = (common.materialise(spark.range(3), "kept") for _ in range(2))
    place = lambda df: df.written_to.removeprefix("file://")
    common.discard(first)
    assert not os.path.exists(place(first)) and os.path.exists(place(second)) and common.written() == start + 1
    common.discard(first)  # again: nothing
    common.release(spark, start)
    assert not os.path.exists(place(second)) and common.written() == start


def test_blocks_hold_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), pa.array(ODD, pa.string())], ["doc_id", "text"])
    for limit in (1, 100, 1 << 30):
        parts = list(common.blocks(batch, limit=limit))
        assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
        assert all(p.num_rows == 1 or common.texts_of(p).nbytes <= limit + 16 * p.num_rows + 80 for p in parts)


def test_names_that_are_free(spark):
    df = table(spark, [(1, "x", 1)], "doc_id long, text string, _Key int")
    assert common.fresh(df, "_key") == "__key" and common.fresh(df, "other") == "other"
    assert all(m.__doc__ for m in (matroska, packing, url_rules, warc))
