"""From raw documents to encoded clean ones: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. Repeated rows, null ids and null or empty texts go through the stages
as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolattice.llm import decontaminate, line_dedup, quality, sentencepiece_codec, simhash
from duolattice.llm.common import materialized, table
from duolattice.llm.queries import quality_model, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality_model(spark, sf_dir, docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go from the texts."""
    return line_dedup.deduplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as piece ids."""
    coded = sentencepiece_codec.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.split("ids", " ").cast("array<int>").alias("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: The stages' models and hashes can't be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), "stage")
    return docs
