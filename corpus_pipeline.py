"""Corpus pipeline: language ID, quality classifier, near-dedup, decontamination, tokenisation.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

In all stages extra columns are dropped, whatever their names, and empty tables give empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, neardup, quality, sentencepiece_codec
from quern.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language must have at least this share of a text's letters; the others go.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language that has at least half of the letters.

    Null texts and texts without letters go; rows with a null id are judged but not learned from;
    repeated rows are judged alike.
    """
    model = langid.fit(docs)
    marked = langid.predict(docs.select(COLUMNS), model, "text", COLUMNS, spans=False)
    return marked.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the scorer holds for good.

    Null, empty and blank texts go; null ids don't matter; repeated rows are judged alike.
    """
    return quality.classify(docs.select(COLUMNS), quality.fit(docs)).where("quality_keep").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Two texts are near copies if the sets of their shingles of five words have a similarity of 0.8
    or more, and groups are what such links connect. Null, empty and blank texts are one group; rows
    with a null id all stay; of several rows with one id one stays, if that id is the smallest of one
    of their groups.
    """
    return neardup.keep_first(docs.select(COLUMNS)).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item.

    Null texts have no words and stay; null ids don't matter; repeated rows are judged alike.
    """
    return decontaminate.remove_documents(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of the ids and of the decoded text.

    A null text is an empty one; null ids and repeated rows are kept.
    """
    encoded = sentencepiece_codec.encode(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"), "text", ["doc_id", "lang", "source", "n_chars"])
    return encoded.drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece_tokens", sentencepiece_tokens),
]

#: SQL can express neither the learned stages nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result lies in the shared folder until the next one does."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
