"""A training corpus from documents in five stages, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.llm.common import table
from schedlake.llm.decontamination import clean_rows
from schedlake.llm.exact_dedup import exact_dedup
from schedlake.llm.quality import accepted_rows
from schedlake.llm.sentencepiece_chunks import encode_decode
from schedlake.llm.simhash import one_of_each
from schedlake.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return accepted_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more the one with the smallest id stays."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold part of a benchmark item go."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left (little-endian uint32, with begin and end ids) and digests of ids and decoded text."""
    import public_tokenizers

    coded = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None  # fingerprints, co-training and pieces have no SQL: tests/llm/test_pipeline.py holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
