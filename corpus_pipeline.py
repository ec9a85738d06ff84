"""Raw documents to training tokens, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept. Its result is written as Parquet in
the folder that ``spark.checkpoint.dir`` names and read again as the next stage's docs, so a lost executor costs no earlier
stage. Rows that share an id are one document to quality and near duplicates, where rows without an id stay; the other stages
take each row by itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloop.llm import containment, jaccard, pieces, quality, secrets
from askloop.session import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text of their language."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return jaccard.keep_one(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return containment.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their own secrets blanked out."""
    return secrets.redact(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns of each document, its ids, their number, and whether they decode to the text.

    The library reads a word mark in a text as a space, so such a text is not held against its ids.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(docs, path, decoded="decoded", linger=False)
    same = F.col("decoded") == F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(pieces.MARK), F.lit(" "))
    return coded.withColumns({"n_tokens": F.size("ids").cast("bigint"), "decodes": same}).drop("text", "decoded")


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_test_items),
    ("secrets", without_secrets),
    ("tokens", tokenized),
]
# Training a language model and merging pieces are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
