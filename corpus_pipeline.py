"""The corpus pipeline: quality, toxicity, near duplicates, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import mixing, near_dedup, packing, quality, toxicity
from tidegauge.llm.common import fresh, release, shared_path, table, written
from tidegauge.llm.queries import QUALITY_CUT, TOXIC_CUT


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; all of them where labels tell no difference."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    if not len(model.roots):
        return docs
    score = fresh(docs, "quality_score")
    return quality.score_quality(docs, model, score).filter(F.col(score) >= QUALITY_CUT).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the cut; all of them without a lexicon."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    if not model.terms:
        return docs
    score = fresh(docs, "toxicity_score")
    return toxicity.score_toxicity(docs, model, score).filter(F.col(score) < TOXIC_CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, a similarity of 0.8 or more) the document with
    the smallest doc_id."""
    return near_dedup.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the languages' tokens to their targets."""
    mix = mixing.learn(docs, "lang", table(spark, sf_dir, "labels"))
    return mixing.mixed(docs, mixing.fit(mixing.measured(docs, "lang", mix), mix))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences, with their token ids."""
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the trees nor the automaton nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written; the tables that it was computed by are removed then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        before = written()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before)
        docs = spark.read.parquet(path)
    return docs
