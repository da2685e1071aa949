"""A training corpus from the table documents: what a classifier accepts, one of each group of near copies, without secrets,
mixed to source weights, and packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import documents, stage
from tracelane.llm.mixing import mixed
from tracelane.llm.neighbours import classify
from tracelane.llm.packing import pack
from tracelane.llm.queries import WORD_BPE, _tokenizer
from tracelane.llm.secrets import redact, scan
from tracelane.llm.similarity_join import keep_one


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str, tuple[str, ...]]:
    """docs with its columns named by place, so that no operator's own columns clash; the names of id, text and the others."""
    work = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ident, body = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    return work, ident, body, tuple(c for c in work.columns if c != ident)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the neighbour vote rejects. Null and empty texts are judged as empty ones; each row by itself, so equal rows go or stay together; without labels of
    both kinds all stay. An empty table stays empty; other columns pass through, whatever their names."""
    work, ident, body, rest = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", ident)
    judged = classify(work, labels, id_col=ident, text=body, carry=rest)
    return judged.where("predicted = 1").select(*work.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of the similarity join: the one of the least id, null last; of equal rows one. Null, empty and blank texts are one class. Columns pass through."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in the place of every secret; n_chars follows the text. Rows without secrets stay as they are, null texts null; equal rows stay equal; every row is kept."""
    work, ident, body, rest = _numbered(docs)
    found = scan(work.withColumn("scanned", F.col(body)), id_col=ident, text="scanned", carry=rest)
    clean = found.withColumn(body, F.when(F.size("spans") > 0, redact(F.col("scanned"), F.col("spans"))).otherwise(F.col(body)))
    if "n_chars" in docs.columns:
        count = f"c{docs.columns.index('n_chars')}"
        clean = clean.withColumn(count, F.when(F.size("spans") > 0, F.length(body).cast(work.schema[count].dataType)).otherwise(F.col(count)))
    return clean.select(*work.columns).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them more than once, so that the sources meet their weights. Null sources are one source; texts without words weigh nothing and come as often as their
    hash says; rows of one id are taken together. Columns pass through."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences along the curve: a row for each piece. Null and empty texts are their end id alone; equal rows are packed each."""
    return pack(docs, _tokenizer(WORD_BPE)).drop("ids")


STAGES = [("quality", quality), ("near copies", near_copies), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: A trained classifier and a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
