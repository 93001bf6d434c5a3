"""The corpus pipeline: language, near copies, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last keep the columns of
``documents``. Rows with null ``doc_id`` pass every stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packproof.llm import bpe, common, language, minhash, mixing, secrets

#: Documents whose language is less certain than this are rejected.
CERTAIN = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; ``und`` and uncertain ones go."""
    labelled = docs.filter(~F.coalesce(language.held_out(), F.lit(True))).select("doc_id", "lang", "text")
    model = language.learn(labelled)
    found = language.identify(docs, model)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= CERTAIN)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest ``doc_id``, of each class of near copies."""
    return minhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which every secret is replaced by a mark."""
    return secrets.redact(docs, common.shared_path(spark, "ledger"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their rates: toxic ones go; clean ones stay, as often as the target weights need."""
    return mixing.apply(docs, common.table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, piece_ends and n_tokens of every document."""
    return bpe.encode(docs, ("doc_id",)).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", known_language),
    ("near-duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Learned models, signatures and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
