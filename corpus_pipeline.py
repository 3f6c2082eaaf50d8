"""A training-data pipeline over documents: toxicity, near-duplicates, repeated passages, source mix, tokens.

Each stage takes the documents that the stage before it kept, calls one operator of the llm subpackage, and returns
documents again; the last returns their token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import bpe, mixing, near_copies, suffix_dedup, toxicity
from fathomline.llm.common import table, written
from fathomline.llm.registry import vocabulary_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from these documents' labels, does not predict toxic.

    Null and empty texts stay, as do rows without an id.
    """
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity of 0.8 of five-word shingles.

    SimHash proposes pairs, an exact comparison decides them and what SimHash leaves apart. Rows without an id stay.
    """
    return near_copies.representatives(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that a 50-byte string of an earlier document covers; n_chars follows the text.

    A null text becomes empty; rows that share an id take nothing from each other; no row goes.
    """
    return suffix_dedup.deduplicated(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: no row more than three times.

    Rows without words stay once; rows that share an id are taken as often as the most taken of them.
    """
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix; a null text has no tokens."""
    return bpe.digests(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

#: SQL has no learned grammar or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each stage's result is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
