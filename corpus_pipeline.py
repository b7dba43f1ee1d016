"""From raw documents to tokens: five stages, each one operator over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldquery.llm import decontaminate, ngram_join, quality, sentencepiece, substring_dedup
from foldquery.llm.common import table, unused, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores below 0.5 go. It learns from the labels of documents that are there.

    Null texts, languages and sources count as empty; equal rows go or stay together; without labels of both kinds, and of an
    empty table, all stay. Other columns stay as they are, whatever their names.
    """
    viewed = quality.view(docs)
    name = unused("quality_score", docs.columns)
    return quality.score(viewed, quality.train(viewed, table(spark, sf_dir, "labels")), name).where(F.col(name) >= 0.5).drop(name)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard of five-word shingles of 0.8 or more the smallest doc_id stays.

    Null and blank texts link with nothing and stay, as do rows without an id; rows that repeat a doc_id that stays all stay;
    an empty table gives no rows. Other columns stay as they are.
    """
    return ngram_join.keep_one(docs, ngram=5, num=80, den=100)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from all texts but the first; n_chars follows. A document keeps its row.

    A null text stays null, and so does its n_chars; rows without an id lose nothing; rows that repeat an id lose nothing to each
    other; an empty table gives no rows.
    """
    own = unused("removed", docs.columns)
    return substring_dedup.dedup_units(docs, as_=own).drop(own).withColumn("n_chars", F.length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or refilled, go; repeated rows go together.

    Null and empty texts stay, and with an empty benchmark all do; an empty table gives no rows. Other columns stay as they are.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text, of every document; a null text has no ids. Repeated rows
    all stay; an empty table gives no rows."""
    return sentencepiece.encode(docs.select("doc_id", "text")).select("doc_id", "ids", F.size("ids").alias("n_tokens"), "exact")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Training and Viterbi search can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
