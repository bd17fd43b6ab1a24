"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, in the
columns of documents; the last gives the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarate.llm import decontamination, jaccard, packing, quality_model, simhash, suffixes
from stellarate.llm.cluster import Scratch
from stellarate.session import scratch_path

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, rejects go.

    Null and empty texts are scored like others; repeated rows are judged alike; without
    labels, or rows, nothing is rejected. All columns stay.
    """
    return quality_model.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, by fingerprints and by shingles.

    Null, empty and blank texts are copies of each other. Of repeated rows one stays, also
    without a doc_id; different texts under one id are documents by themselves. All columns stay.
    """
    with Scratch(spark) as scratch:
        return simhash.one_of_each(docs, scratch, further=jaccard.links(docs, scratch))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that started earlier are cut out of the texts.

    No row goes; null texts become empty and ``n_chars`` is counted anew. Null ids come first,
    repeated rows get the same text each. All columns stay.
    """
    with Scratch(spark) as scratch:
        return suffixes.without_repeats(docs, scratch)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts, of documents or items, contain nothing and are contained nowhere;
    without items nothing goes. All columns stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_items(docs, items)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, placed in sequences.

    Null and empty texts are one piece of one id; repeated rows and ids are packed like others.
    """
    packed = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
