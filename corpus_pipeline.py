"""From raw documents to token ids: language identification, near-duplicates, mixing of sources, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return the
columns of documents; the last adds piece_ids and decoded. Edge cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from campaignry.llm import language_id, mixing, sentencepiece_sa, simhash_dedup
from campaignry.llm.common import materialize
from campaignry.llm.registry import vocabulary

#: A network and its arithmetic are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of a language that the network doesn't recognize, go."""
    return language_id.known_language(docs, language_id.train_network(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least doc_id."""
    return simhash_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are weighted by the square root of their documents, about as many rows in all; documents repeat or go accordingly."""
    return mixing.poisson_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text and the text that they decode to."""
    return sentencepiece_sa.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("language ID", keep_known_languages), ("SimHash near-dedup", drop_near_duplicates), ("mixing sources", mix_sources), ("SentencePiece", encode_pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
