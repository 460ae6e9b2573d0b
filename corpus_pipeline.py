"""A training corpus from raw documents: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.llm import langid, mixing, order_minhash, packing, secrets
from tallygrove.llm.common import BATCH_BYTES, BATCH_ROWS, TEXT_BYTES, stored
from tallygrove.llm.queries import TEMPER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _whole_texts(spark: SparkSession) -> None:
    """The pipeline's setting: rows that hold whole texts go to Python in batches of at most 1,000 rows and a few MB."""
    spark.conf.set(BATCH_BYTES, TEXT_BYTES)
    spark.conf.set(BATCH_ROWS, min(1000, int(spark.conf.get(BATCH_ROWS))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; ``lang`` becomes the predicted language."""
    _whole_texts(spark)
    named = langid.identify(docs.select(*COLUMNS), langid.train(docs))
    return named.where(~F.col("lang_rejected")).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate class stays; documents without id stay."""
    _whole_texts(spark)
    gone = order_minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, plain or encoded, are replaced by a mark and ``n_chars`` is counted anew."""
    _whole_texts(spark)
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that meet the tempered source, language and topic shares."""
    return mixing.mix(docs.select(*COLUMNS), temper=TEMPER).where("mix_kept").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    _whole_texts(spark)
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing sources to target weights", mix_sources), ("packing", pack_sequences)]

#: No SQL: tokenizing and alignment have no counterpart there; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
