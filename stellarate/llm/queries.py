"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarate.llm import (
    decontamination,
    embedding_links,
    lexical,
    license,
    merkle,
    packing,
    quality_model,
    quality_rules,
    simhash,
    suffixes,
    token_files,
    toxicity,
    url_rules,
)
from stellarate.llm.cluster import Scratch
from stellarate.session import scratch_path

TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license.scan(table(spark, sf, "documents"))


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = simhash.near_copies(table(spark, sf, "documents"), scratch)
        return found.select(
            "doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id"
        )


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        cut = suffixes.remove_repeats(table(spark, sf, "documents"), scratch, keep_text=False)
        return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    trusted = table(spark, sf, "labels").where("quality = 1")
    return quality_rules.judge(table(spark, sf, "documents"), trusted)


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    tokenizer = public_tokenizers.path(TOKENIZER)
    token_files.write_shards(table(spark, sf, "documents"), tokenizer, path)
    return token_files.read_documents(spark, path)


def op6_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return url_rules.judge(table(spark, sf, "pages"), scratch)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels"), scratch)


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contained_items(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return quality_model.scores(
            table(spark, sf, "documents"), table(spark, sf, "labels"), scratch
        )


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )


def op11_embedding_links(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return embedding_links.linked(table(spark, sf, "embeddings"), scratch)


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        made = merkle.manifest(table(spark, sf, "documents"), scratch)
        return merkle.proofs(made, scratch)


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return lexical.search(
            table(spark, sf, "documents"), table(spark, sf, "benchmark"), scratch
        )


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_files": op5_token_files,
    "op6_url_rules": op6_url_rules,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_embedding_links": op11_embedding_links,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}
