"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Rows that the quality classifier rejects go; of each group of near copies one document stays; documents that hold
benchmark passages go; personal data is put under pseudonyms; what is left is encoded and decoded. Every stage
works on all rows that its predecessor kept, and its model and statistics come from those rows.

Null and empty texts are scored, kept, cleaned and encoded like any others; only the classifier's score decides about them, and
they are no near copies of each other. Rows with a null id are told apart by their text. Of repeated rows (equal id and
text) near_copies keeps one; of a class the smallest id stays. Empty tables give empty tables, and without labels
all rows get one score. All stages but the last pass on the columns of documents, further ones too, whatever their
names, if they do not end in two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe_dp import encode_decode, vocabulary_path
from tidemark.llm.common import table, written
from tidemark.llm.decontaminate import clean
from tidemark.llm.near_jaccard import one_of_each_class
from tidemark.llm.pii_feistel import pseudonymise
from tidemark.llm.quality_ri import THRESHOLD, fitted, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at or above its threshold."""
    network, vectors = fitted(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, network, vectors, docs.columns, out="score__").filter(F.col("score__") >= THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; n_chars follows the new text."""
    out = pseudonymise(docs, docs.columns, spans="spans__")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (binary, little-endian uint32) of every document, and a digest of what they decode to."""
    out = encode_decode(docs, vocabulary_path("word_bpe_49k.json"), ["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("privacy", privacy), ("tokens", tokens)]

#: The classifier, the pseudonyms and the tokens cannot be stated in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
