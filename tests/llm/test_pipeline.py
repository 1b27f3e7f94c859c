"""The corpus pipeline: what goes, what stays, and that every stage carries odd rows."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp
from tidegauge.llm.common import release

from .helpers import ODD, write_tables
from .test_scores import LABELS, labelled

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = labelled(200)
    copies = [(5000 + i, t + " copied here") for i, t in docs if len(t.split()) > 60]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}", len(t)) for i, t in docs + copies]
    return write_tables(spark, f"file://{tmp_path_factory.mktemp('tables')}", documents=spark.createDataFrame(rows, COLUMNS), labels=spark.createDataFrame(labels, LABELS))


def stage(k, spark, docs, folder):
    return cp.STAGES[k][1](spark, docs, folder)


def test_stages_in_order():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = stage(0, spark, docs, folder)
    clean = stage(1, spark, good, folder)
    single = stage(2, spark, clean, folder)
    mixed = stage(3, spark, single, folder)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert all(df.columns == docs.columns for df in (good, clean, single, mixed))
    assert sum(labels[i].quality for i in ids(good) if i in labels) > 0.9 * sum(r.quality for r in labels.values())
    assert sum(not labels[i].quality for i in ids(good) if i in labels) < 0.1 * len(labels)
    assert not [i for i in ids(clean) if i in labels and labels[i].toxic][10:]
    assert ids(single) <= ids(clean) and not [i for i in ids(single) if i >= 5000 and i - 5000 in ids(clean)]
    assert ids(mixed) <= ids(single) and mixed.count() > 0
    packed = cp.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids_crc32"} <= set(packed.columns)
    assert ids(packed) == ids(mixed)
    assert texts.keys() >= ids(packed)
    release(spark)


def test_similarity_of_four_fifths_is_a_near_duplicate(spark, folder):
    text = [f"w{i}" for i in range(100)]
    near = [*text]
    near[30], near[70] = "x", "y"  # 86 of 106 shingles, 0.811
    far = [*text]
    far[20], far[50], far[80] = "x", "y", "z"  # 81 of 111 with the text, 0.730
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in ((1, text), (2, near), (3, far))]
    out = stage(2, spark, spark.createDataFrame(rows, COLUMNS), folder)
    assert {r.doc_id for r in out.collect()} == {1, 3}


def test_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(9000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (9000, "one two three four five six", "en", "s", 1), (9000, "one two three four five six", "en", "s", 1)], COLUMNS)
    for k in range(4):
        out = stage(k, spark, docs.unionByName(odd), folder)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(k, spark, docs.limit(0), folder).count() == 0
    assert stage(4, spark, odd, folder).count() > 0
    assert stage(4, spark, odd.limit(0), folder).count() == 0


def test_other_columns_that_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as score", "'x' as Kept", "2 as _key0", "3 as quality_score", "4 as copies", "5 as rate")
    for k in range(4):
        assert stage(k, spark, docs, folder).columns == docs.columns
