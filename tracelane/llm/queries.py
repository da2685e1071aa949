"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelane.llm.common import documents
from tracelane.llm.oracle import ORACLE_SQL

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.spotsigs import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.packing import pack

    return pack(documents(spark, sf_dir), _tokenizer(WORD_BPE)).drop("ids")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.records import token_records

    return token_records(documents(spark, sf_dir), _tokenizer(BYTE_BPE)).drop("path", "offset")


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.neighbours import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).drop("spans", "kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.secrets import digest, scan

    return digest(scan(documents(spark, sf_dir)))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.matroska import stored

    return stored(documents(spark, sf_dir)).drop("media")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.similarity_join import jaccard_join

    return jaccard_join(documents(spark, sf_dir)).drop("kept", "digest")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelane.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), _tokenizer(PIECES))


QUERIES = {
    f.__name__: f
    for f in (op1_spotsigs, op2_packing, op3_records, op4_neighbour_quality, op5_repeats, op6_secrets, op7_matroska, op8_mixing, op9_similarity_join, op10_token_counts)
}
