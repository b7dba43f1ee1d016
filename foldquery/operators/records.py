"""Small operators over the catalogue's tables: projections, filters, sums and lists of hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a list of each table shows.
FIELDS = {
    "sequences": ["_id", "accession", "definition", "group", "ref_id"],
    "cs": ["_id", "cs", "name", "ref_id", "published"],
    "jobs": ["_id", "sequence_id", "cssd_id", "status", "error", "ref_id"],
    "results": ["job_id", "position", "fe"],
}


def project(df: DataFrame, name: str) -> DataFrame:
    """The columns that a list of the table shows, those that df has."""
    return df.select(*(c for c in FIELDS[name] if c in df.columns))


def without(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def first_match(df: DataFrame, side: DataFrame, key: str, value: str, as_: str) -> DataFrame:
    """df with the first (smallest) of the side's values for its key; rows without any go."""
    return df.join(side.groupBy(key).agg(F.min(value).alias(as_)), key)


def hex_id(number: Column) -> Column:
    """A number as 24 hexadecimal digits."""
    return F.lpad(F.hex(number), 24, "0")


def decimal_id(hex_: Column) -> Column:
    """The number of 24 hexadecimal digits, of which the last 16 count."""
    return F.conv(F.substring(hex_, 9, 16), 16, 10).cast("long")


def shown_energy(fe: Column | str) -> Column:
    """Two decimals."""
    return F.round(fe, 2)


def plotted_energy(fe: Column | str, low: float = -50.0, high: float = 5.0) -> Column:
    return F.greatest(F.least(F.col(fe) if isinstance(fe, str) else fe, F.lit(high)), F.lit(low))


def equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values; nulls never do."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in values.items())))


def between(df: DataFrame, below: dict[str, float], least: dict[str, float]) -> DataFrame:
    """Rows with some columns under a bound and others from one on."""
    tests = [F.col(c) < v for c, v in below.items()] + [F.col(c) >= v for c, v in least.items()]
    return df.where(reduce(lambda a, b: a & b, tests))


def newest_equal(df: DataFrame, column: str, value: str, id_col: str = "_id") -> DataFrame:
    """The largest id of the rows whose text equals a value: one row, null if there is none."""
    return df.where(F.col(column) == value).agg(F.max(id_col).alias(id_col))


def energy_cut(hits: DataFrame, most: float, count: int = 500, id_col: str = "_id") -> DataFrame:
    """The `count` best hits of an energy of at most `most`; the cut is the feature."""
    return hits.where(F.col("fe") <= most).orderBy("fe", id_col).limit(count)


def cap_hits(hits: DataFrame, count: int = 500, id_col: str = "_id") -> DataFrame:
    return hits.orderBy("fe", id_col).limit(count)


def total_time(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id").agg(F.sum("time").alias("total_time"))


def mean_time(results: DataFrame, most: float = 999.0) -> DataFrame:
    return results.groupBy("job_id").agg(F.least(F.sum("time") / F.count(F.lit(1)), F.lit(most)).alias("mean_time"))


def result_count(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


def collection_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    counts = [df.select(F.lit(name).alias("t")) for name, df in tables.items()]
    every = reduce(DataFrame.unionByName, counts)
    return every.agg(*(F.count_if(F.col("t") == name).alias(name) for name in tables))


def list_sum(df: DataFrame, column: str, by: int) -> DataFrame:
    """A constant more in every row."""
    return df.withColumn(column, F.col(column) + by)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def own_and_guests(df: DataFrame, ref_id: int, guest: int = 0) -> DataFrame:
    """A user's rows, then those that all users see."""
    return equal(df, ref_id=ref_id).unionAll(equal(df, ref_id=guest))


def distinct_results(results: DataFrame) -> DataFrame:
    keys = ["job_id", "position", "hit_string"]
    return results.select(*keys).dropDuplicates(keys)


def newest_jobs(jobs: DataFrame, id_col: str = "_id", descending: bool = True) -> DataFrame:
    return jobs.orderBy(F.col(id_col).desc() if descending else F.col(id_col))


def present(hits: DataFrame, among: DataFrame, *keys: str) -> DataFrame:
    """hits that a second list holds too."""
    return hits.join(among.select(*keys).distinct(), list(keys), "left_semi")


def printed(df: DataFrame) -> DataFrame:
    """Rows as lines: every column as text with tabs between, nulls empty."""
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("line"))


def validated(df: DataFrame, column: str, check: Callable[[str], str | None], as_: str = "error") -> DataFrame:
    """df with why each text is refused, or null: every different text is looked at once."""

    @F.pandas_udf("string")
    def reason(texts):
        return texts.map(lambda t: check(t or ""))

    texts = df.select(F.col(column).alias("_text")).distinct().withColumn(as_, reason("_text"))
    return df.join(texts, df[column].eqNullSafe(texts["_text"]), "left").drop("_text")
