"""Where sequences come from: files, literals, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldquery.functions.nucleotides import from_letters, normalize


def sequence_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, nt): each file whole as one sequence, in normal form."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return df.select("path", normalize(F.col("value")).alias("nt"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, accession, definition, nt) of the records of FASTA files, split at their headers by the reader."""
    df = spark.read.option("lineSep", "\n>").text(path).withColumn("path", F.input_file_name())
    head = F.ltrim(F.regexp_extract("value", r"^>?([^\n]*)", 1))
    body = F.regexp_replace("value", r"^>?[^\n]*", "")
    return df.where("trim(value) <> ''").select("path", F.substring_index(head, " ", 1).alias("accession"), F.ltrim(F.regexp_replace(head, r"^\S*", "")).alias("definition"), normalize(body).alias("nt"))


def literal(spark: SparkSession, *sequences: str) -> DataFrame:
    """(seq_id, nt) of sequences given in the call."""
    return spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "seq_id long, nt string").withColumn("nt", normalize(F.col("nt")))


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows dealt over so many tasks (as many as the session runs at once, if None), whatever the number of files."""
    return df.repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)


def rna_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, nt): the whole text of each document as a made-up sequence, spread over all tasks."""
    docs = spread(collection(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("seq_id"), from_letters(F.col("text"), 2**31 - 1).alias("nt"))
