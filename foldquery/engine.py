"""The service's calls as methods over a Store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldquery.functions.energy import Tables, fe_turner, turner_udf
from foldquery.functions.render import counted_from, hit_string, paint_udf
from foldquery.operators import store as ops
from foldquery.operators.regions import regions
from foldquery.plans.cssd import join, parse, split, validate
from foldquery.plans.search import search
from foldquery.sources.sinks import SCHEMAS, Store, one_id, sequence_errors


class RequestError(ValueError):
    """A call is refused; the text says why."""


def register(spark: SparkSession, tables: Tables | None = None) -> None:
    """Makes rna_fe(nt, chain, constraints) and rna_hit_string(chain, constraints) known to SQL."""
    spark.udf.register("rna_fe", turner_udf(tables))
    spark.udf.register("rna_hit_string", paint_udf())


class Engine:
    def __init__(self, spark: SparkSession, root: str, tables: Tables | None = None):
        self.spark, self.store, self.tables = spark, Store(spark, root), tables or Tables()

    # -- search ------------------------------------------------------------------------

    def scan(self, sequences: DataFrame, ss: str, pos_var: str = "") -> DataFrame:
        """sequences (seq_id, nt) to hits with energy and bracket string."""
        return self._finished(search(sequences, parse(ss, pos_var), context=4))

    def _finished(self, hits: DataFrame) -> DataFrame:
        near = counted_from(hits, "around_start").withColumn("fe", fe_turner(F.col("around"), F.col("chain"), F.col("constraints"), self.tables))
        near = near.withColumn("hit_string", hit_string(F.col("chain"), F.col("constraints")))
        back = lambda c, keys, rest: F.transform(c, lambda x: F.struct(*((x[k] + F.col("around_start") - 1 if k in keys else x[k]).alias(k) for k in rest)))
        near = near.withColumns({"chain": back("chain", ("fp", "tp"), ("el", "fp", "tp", "len")), "constraints": back("constraints", ("start",), ("constraint", "role", "start", "len"))})
        return near.drop("around", "around_start")

    def filter(self, sequences: DataFrame, ss: str, pos_var: str = "") -> DataFrame:
        return regions(sequences, parse(ss, pos_var))

    # -- records -----------------------------------------------------------------------

    def create_sequence(self, group: str, definition: str, accession: str, nt: str, ref_id: int) -> str:
        row = self.spark.createDataFrame([(accession, definition, nt, group, ref_id)], "accession string, definition string, seqnt string, group string, ref_id long")
        if error := sequence_errors(row).first().error:
            raise RequestError(error)
        return self._insert("sequences", row, "a sequence with this accession or definition")

    def _insert(self, name: str, row: DataFrame, what: str) -> str:
        """Adds one row and tells its id; refused if one of its unique keys is taken."""
        id_ = one_id()
        self.store.append(name, row.withColumn("_id", F.lit(id_)))
        if self.store.read(name).where(F.col("_id") == id_).isEmpty():
            raise RequestError(f"there is {what} already")
        return id_

    def create_cssd(self, name: str, ss: str, pos_var: str, ref_id: int, published: bool = False) -> str:
        if error := validate(ss, pos_var):
            raise RequestError(error)
        row = self.spark.createDataFrame([(join(ss, pos_var), name, ref_id, published)], "cs string, name string, ref_id long, published boolean")
        return self._insert("cs", row, "a pattern of this name or text")

    def create_user(self, name: str, sub_id: str) -> int:
        """The new user's ref_id, one more than the largest."""
        last = self.store.read("users").agg(F.max("ref_id")).first()[0] or 0
        self._insert("users", self.spark.createDataFrame([(name, sub_id, last + 1)], "name string, sub_id string, ref_id long"), "a user of this subject")
        return last + 1

    def user(self, sub_id: str) -> DataFrame:
        return self.store.read("users").where(F.col("sub_id") == sub_id)

    def update_cssd(self, cssd_id: str, ref_id: int, **values) -> None:
        if "cs" in values and (error := validate(*split(values["cs"]))):
            raise RequestError(error)
        self.store.update("cs", (F.col("_id") == cssd_id) & (F.col("ref_id") == ref_id), **values)

    def create_job(self, sequence_id: str, cssd_id: str, ref_id: int) -> str:
        """Runs a stored pattern over a stored sequence; the hits are kept first, then the job as done. A search that fails
        leaves no job."""
        sequence = self.store.read("sequences").where(F.col("_id") == sequence_id)
        cs = self.store.read("cs").where(F.col("_id") == cssd_id).first()
        if cs is None or sequence.isEmpty():
            raise RequestError("no such sequence or pattern")
        job_id = one_id()
        hits = self.scan(sequence.select(F.col("_id").alias("seq_id"), F.col("seqnt").alias("nt")), *split(cs.cs))
        self.store.append("results", hits.select(F.lit(job_id).alias("job_id"), F.lit(None).cast("double").alias("time"), "position", "fe", "hit_string", F.lit(ref_id).alias("ref_id")))
        job = [(job_id, sequence_id, cssd_id, ops.DONE, 0, 1, 1, 0, ref_id)]
        self.store.append("jobs", self.spark.createDataFrame(job, SCHEMAS["jobs"]))
        return job_id

    def sequences(self, ref_id: int, start: int = 1, limit: int = 0) -> DataFrame:
        return ops.page(self.store.read("sequences").where(F.col("ref_id") == ref_id).orderBy(*ops.by_text("group", "definition", "accession"), "_id"), start, limit)

    def cssds(self, ref_id: int, start: int = 1, limit: int = 0, curator: bool = False) -> DataFrame:
        cs = self.store.read("cs")
        return ops.page(ops.published(cs, curator).where((F.col("ref_id") == ref_id) | F.col("published")).orderBy(*ops.by_text("name"), "_id"), start, limit)

    def jobs(self, ref_id: int, start: int = 1, limit: int = 0, descending: bool = True) -> DataFrame:
        """Jobs with their sequence and pattern."""
        df = self.store.read("jobs").where(F.col("ref_id") == ref_id)
        seqs = self.store.read("sequences").select(F.col("_id").alias("sequence_id"), "accession", "definition", "group")
        df = ops.lookup(ops.lookup(df, seqs, "sequence_id"), self.store.read("cs").select(F.col("_id").alias("cssd_id"), "name", "cs"), "cssd_id")
        return ops.page(df.orderBy(F.col("_id").desc() if descending else F.col("_id")), start, limit)

    def job(self, job_id: str) -> DataFrame:
        return self.store.read("jobs").where(F.col("_id") == job_id)

    def results(self, job_id: str, start: int = 1, limit: int = 0, first: str = "position", descending: bool = False) -> DataFrame:
        return ops.page(self.store.read("results").where(F.col("job_id") == job_id).orderBy(*ops.by_results(first, descending), "hit_string"), start, limit)

    def result(self, result_id: str) -> DataFrame:
        return self.store.read("results").where(F.col("_id") == result_id)

    def results_summary(self, job_id: str) -> DataFrame:
        return ops.fe_distribution(self.store.read("results").where(F.col("job_id") == job_id))

    def result_index(self, job_id: str, position: int, fe: float, first: str = "position", descending: bool = False) -> int:
        return ops.result_index(self.store.read("results").where(F.col("job_id") == job_id), position, fe, first, descending).first().result_index

    def delete_sequence(self, sequence_id: str, ref_id: int) -> None:
        self.store.delete("sequences", (F.col("_id") == sequence_id) & (F.col("ref_id") == ref_id))

    def delete_cssd(self, cssd_id: str, ref_id: int) -> None:
        self.store.delete("cs", (F.col("_id") == cssd_id) & (F.col("ref_id") == ref_id))

    def delete_job_with_results(self, job_id: str, ref_id: int) -> None:
        self.store.delete("results", (F.col("job_id") == job_id) & (F.col("ref_id") == ref_id))
        self.store.delete("jobs", (F.col("_id") == job_id) & (F.col("ref_id") == ref_id))
