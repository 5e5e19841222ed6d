"""A training corpus from `documents`: language ID, near-dedup, mixing, packing. Each stage's rows are written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import langid, mixing, packing, simhash
from tapeworks.llm.common import new_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach; `und` and those whose best language has under half the posterior go.

    Null texts and texts without a letter go; rows of equal text share their fate; other columns, whatever their names, are kept.
    If no document has a language, none is recognised, so all go. An empty table gives an empty one.
    """
    scored = langid.predict(docs, langid.train(docs), names=("__lang_pred", "__score"))
    return scored.where((F.col("__lang_pred") != "und") & (F.col("__score") >= 0.5)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at similarity 0.8 or more: that of the smallest id, null last.

    Null, empty and blank texts are copies of each other; of rows of equal texts and ids one stays. An empty table gives an empty one.
    """
    return simhash.drop_near_duplicates(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, repeats as rows of their own, in training order.

    A null source is a source; documents without words are in no mix; ties in position keep no order. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A null or empty text is its end id alone; repeated rows are documents of their own. An empty table gives no pieces.
    """
    return packing.pack(docs, "word_bpe_49k.json", 1, 2048, cache=100_000)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]
#: Posteriors, SimHash and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
