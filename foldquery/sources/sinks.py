"""Appending to stored tables, each row checked, unique keys kept; rewriting them for updates and deletes."""

from __future__ import annotations

import itertools
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldquery.functions.nucleotides import accession_error, definition_error, group_error, is_sequence
from foldquery.operators.store import KEYS, delete, new_only, update

SCHEMAS = {
    "sequences": "_id string, accession string, definition string, seqnt string, group string, ref_id long",
    "cs": "_id string, cs string, name string, ref_id long, published boolean",
    "jobs": "_id string, sequence_id string, cssd_id string, status int, error int, num_windows int, num_windows_success int, num_windows_fail int, ref_id long",
    "results": "_id string, job_id string, time double, position int, fe double, hit_string string, ref_id long",
    "users": "_id string, name string, sub_id string, ref_id long",
    "counters": "_id string, seq long",
    "changes": "_id string, op string, collection string, row_id string, ref_id long",
}
_last = itertools.count()


def new_id() -> Column:
    """24 hexadecimal digits for each row: the microseconds when the query began, then random ones. Later calls' ids are larger."""
    return F.concat(F.lpad(F.lower(F.hex(F.unix_micros(F.current_timestamp()))), 14, "0"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 10))


def one_id() -> str:
    """One id of this kind, larger than all that this process made before."""
    time.sleep(2e-6)
    return f"{time.time_ns() // 1000:014x}{next(_last) % 16**4:04x}{uuid.uuid4().hex[:6]}"


class Store:
    """Tables as Parquet folders under a root that the executors share; one writer at a time.

    Every insert, update and delete also adds rows to the table `changes`, which streams read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame:
        p, fs = self._fs(self.path(name))
        if not fs.exists(p) and not self._recovered(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    def _recovered(self, name: str) -> bool:
        """A rewrite that broke off between its two renames left the new table, whole, beside the old one: it takes its place."""
        p, fs = self._fs(self.path(name))
        fresh = self._fs(f"{self.path(name)}.new")[0]
        return fs.exists(fresh) and fs.exists(self._fs(f"{self.path(name)}.new/_SUCCESS")[0]) and fs.rename(fresh, p)

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows get an id if they have none; those whose unique key is there already are left out."""
        if "_id" not in rows.columns:
            rows = rows.withColumn("_id", new_id())
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMAS[name]).schema}
        rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
        there = self.read(name)
        for key in KEYS.get(name, []):
            rows = new_only(rows, there, list(key))
        before = self._files(name)
        rows.write.mode("append").parquet(self.path(name))
        fresh = [f for f in self._files(name) if f not in before]
        if fresh and name != "counters":
            self._changed("insert", name, self.spark.read.schema(SCHEMAS[name]).parquet(*fresh))

    def _files(self, name: str) -> list[str]:
        p, fs = self._fs(self.path(name))
        return [str(f.getPath()) for f in fs.listStatus(p) if f.getPath().getName().endswith(".parquet")] if fs.exists(p) else []

    def _changed(self, op: str, name: str, rows: DataFrame) -> None:
        told = rows.select(new_id().alias("_id"), F.lit(op).alias("op"), F.lit(name).alias("collection"), F.col("_id").alias("row_id"), F.col("ref_id").cast("long").alias("ref_id"))
        told.write.mode("append").parquet(self.path("changes"))

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """The table becomes rows, which may be made from it: written beside it, then put in its place by two renames. At any
        time the old or the new table is there whole; read() mends a rewrite that broke off."""
        at, fresh, gone = self.path(name), f"{self.path(name)}.new", f"{self.path(name)}.old"
        rows.write.mode("overwrite").parquet(fresh)
        (old, fs), (new, _), (away, _) = self._fs(at), self._fs(fresh), self._fs(gone)
        fs.delete(away, True)
        if fs.exists(old) and not fs.rename(old, away) or not fs.rename(new, old):
            raise OSError(f"{fresh} can't take the place of {at}")
        fs.delete(away, True)
        self.spark.catalog.refreshByPath(at)

    def update(self, table: str, where: Column, /, **values) -> None:
        rows = self.read(table)
        self._changed("update", table, rows.where(where))
        self.rewrite(table, update(rows, where, **values))

    def delete(self, name: str, where: Column) -> None:
        rows = self.read(name)
        self._changed("delete", name, rows.where(where))
        self.rewrite(name, delete(rows, where))


def sequence_errors(rows: DataFrame) -> DataFrame:
    """rows with `error`: why a sequence record is refused, or null."""
    nt = F.when(~F.coalesce(is_sequence(F.col("seqnt")), F.lit(False)), F.lit("sequence must be 5 to 3000 residues a, c, g, u"))
    return rows.withColumn("error", F.coalesce(definition_error(F.col("definition")), accession_error(F.col("accession")), group_error(F.col("group")), nt))
