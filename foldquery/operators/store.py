"""The catalogue around the search: filters, paging, orders, lookups, summaries, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INIT, PENDING, SUBMITTED, DONE = 0, 1, 2, 3
KEYS = {
    "cs": [("cs", "ref_id"), ("name", "ref_id")],
    "results": [("job_id", "position", "hit_string")],
    "sequences": [("accession", "ref_id"), ("definition", "ref_id")],
    "users": [("sub_id",), ("ref_id",)],
}


def page(df: DataFrame, start: int, limit: int) -> DataFrame:
    """From the 1-based row start; limit 0 is all that follows."""
    if start < 1 or limit < 0:
        raise ValueError("start counts from 1 and limit from 0")
    df = df.offset(start - 1) if start > 1 else df
    return df.limit(limit) if limit else df


def by_text(*columns: str) -> list[Column]:
    """Sort columns that ignore case and accents."""
    return [F.collate(F.col(c), "UNICODE_CI_AI") for c in columns]


def by_results(first: str = "position", descending: bool = False) -> list[Column]:
    """(position, fe) or (fe, position), both in one direction."""
    order = ["position", "fe"] if first == "position" else ["fe", "position"]
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def search_term(df: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows where any of the columns contains the term, whatever the case."""
    return df.where(reduce(lambda a, b: a | b, (F.upper(F.col(c)).contains(term.upper()) for c in columns)))


def published(cs: DataFrame, curator: bool = False) -> DataFrame:
    return cs if curator else cs.where("published")


def newest(df: DataFrame, id_col: str = "_id") -> DataFrame:
    return df.orderBy(F.col(id_col).desc()).limit(1)


def lookup(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Inner join by key to a table where it is unique; columns of df win where names clash."""
    extra = [c for c in side.columns if c not in df.columns]
    return df.join(side.select(key, *extra), key)


def fe_distribution(results: DataFrame, *by: str) -> DataFrame:
    """By position: least, greatest, mean and sample deviation of the energy (null for one hit), and the number of hits."""
    keys = [*by, "position"]
    out = results.groupBy(*keys).agg(F.min("fe").alias("min_fe"), F.max("fe").alias("max_fe"), F.avg("fe").alias("avg_fe"), F.stddev_samp("fe").alias("std_fe"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(*keys)


def result_index(results: DataFrame, position: int, fe: float, first: str = "position", descending: bool = False, tolerance: float = 0.01) -> DataFrame:
    """How many hits come before this one: one row, 0-based. Energies within the tolerance count as equal."""
    less_fe = (F.col("fe") > fe + tolerance) if descending else (F.col("fe") < fe - tolerance)
    same_fe = F.abs(F.col("fe") - fe) <= tolerance
    less_p = (F.col("position") > position) if descending else (F.col("position") < position)
    before = less_p | ((F.col("position") == position) & less_fe) if first == "position" else less_fe | (same_fe & less_p)
    return results.agg(F.count_if(before).alias("result_index"))


def window_counters(windows: DataFrame) -> DataFrame:
    """(job_id, ok), ok null while under way, to num_windows, num_windows_success, num_windows_fail."""
    return windows.groupBy("job_id").agg(F.count(F.lit(1)).alias("num_windows"), F.count_if("ok").alias("num_windows_success"), F.count_if(~F.col("ok")).alias("num_windows_fail"))


def job_state(filter_done: Column, n: Column, ok: Column, fail: Column) -> Column:
    return F.when(~filter_done, F.when(n > 0, PENDING).otherwise(INIT)).when(n == ok + fail, DONE).otherwise(SUBMITTED)


def next_ids(df: DataFrame, last: int, order: str) -> DataFrame:
    """df with ids that go on from last, in the given order; numbered by partition, without moving all rows to one.

    The number of partitions is given, so that both readers of the numbered rows see the same ones. Equal rows get ids in
    any order among them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    numbered = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return numbered.join(F.broadcast(base.select("_p", "_base")), "_p").withColumn("seq", F.lit(last) + F.col("_base") + F.col("_k")).drop("_p", "_k", "_base")


def parse_results(lines: DataFrame, value: str = "value") -> DataFrame:
    """time, position, fe and hit_string of tab-separated lines; lines with other than four fields are left out."""
    f = F.split(value, "\t", -1)
    df = lines.withColumn("_f", f).where(F.size("_f") == 4)
    return df.select(*[c for c in lines.columns if c != value], F.col("_f")[0].try_cast("double").alias("time"), F.col("_f")[1].try_cast("int").alias("position"), F.col("_f")[2].try_cast("double").alias("fe"), F.col("_f")[3].alias("hit_string"))


def new_only(rows: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert: one for each key, none whose key is there already."""
    return rows.dropDuplicates(keys).join(there.select(*keys), keys, "left_anti")


def update(df: DataFrame, where: Column, /, **values) -> DataFrame:
    """df with columns set in the rows that match; others, null conditions included, stay."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone, keys, "left_anti")


def sum_combine(a: DataFrame, b: DataFrame, column: str = "n") -> DataFrame:
    """The distinct sums of two small sets of counts. Both are bounded by the pattern's lengths, not by data."""
    left, right = (df.agg(F.collect_set(column).alias(s)) for df, s in ((a, "x"), (b, "y")))
    both = left.withColumn("k", F.lit(1)).join(right.withColumn("k", F.lit(1)), "k")
    return both.select(F.explode(F.expr("array_distinct(flatten(transform(x, p -> transform(y, q -> p + q))))")).alias(column))


def fe_percentile(hits: DataFrame, histogram: DataFrame) -> DataFrame:
    """hits (len, fe) with the share of the histogram (len, fe, n) of their length at or below their energy."""
    w = Window.partitionBy("len").orderBy("fe")
    cum = histogram.withColumn("below", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("len")))
    cum = cum.select("len", F.col("fe").alias("edge"), (F.col("below") / F.col("total")).alias("share")).groupBy("len").agg(F.sort_array(F.collect_list(F.struct("edge", "share"))).alias("steps"))
    share = F.expr("coalesce(array_max(transform(filter(steps, s -> s.edge <= fe), s -> s.share)), 0D)")
    return hits.join(cum, "len", "left").withColumn("percentile", share * 100).drop("steps")


def to_json_rows(df: DataFrame) -> Column:
    """A row as a JSON object of strings."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns)))
