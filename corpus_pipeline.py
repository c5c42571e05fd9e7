"""A training-data pipeline in five stages, each an operator of strandfold.llm on all that its predecessor kept.

STAGES are functions (spark, docs, sf_dir) -> DataFrame; run() writes each one's result as Parquet
into the shared folder and rereads it as the next one's docs. All but the last return the columns of
documents, and any others, unchanged.

Rows: a null or empty text holds no toxicity beyond the share of such examples and no letter, so the
language stage drops it; a null doc_id or one that repeats is a row like any other, told apart by its
text; repeated rows are near duplicates of each other, one stays; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.llm import bpe, language, mixing, near_dedup, toxicity
from strandfold.llm import words as W
from strandfold.llm.columns import fresh

TOXIC_FROM = 0.7
LANGUAGE_FROM = 0.4


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; all columns stay as they are, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    score, evidence = fresh(docs, "score", "evidence")
    told = toxicity.score(docs, toxicity.train(docs.select("doc_id", "text").join(labels, "doc_id"), F.col("toxic"), docs), name=score, evidence=evidence)
    W.release()  # the driver lives on for the later stages; what was fitted is broadcast by now and held nowhere else
    return told.where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def languages_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language of probability LANGUAGE_FROM or more; those without letters (und) go."""
    name, score = fresh(docs, "lang_pred", "score")
    told = language.predict(docs, language.train(docs.where("lang is not null"), F.col("lang")), name=name, score=score)
    W.release()  # as above
    return told.where((F.col(name) != "und") & (F.col(score) >= LANGUAGE_FROM)).select(*docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component one row, of its least id."""
    return near_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with their number and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", toxic_out),
    ("language ID", languages_in),
    ("MinHash near-dedup", near_duplicates_out),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokens),
]

#: Fitted classifiers and hashed draws can't be told in SQL; tests hold the stages against the operators' own scores, brute-force components and sizes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
