"""Regions of interest: where a pattern's largest helix and its constraints could stand. A superset of all hits' extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldquery.operators.helices import constraint_possible
from foldquery.plans.cssd import Model
from foldquery.plans.search import _placements, windows


def segments(sequences: DataFrame, step: int, overlap: int, id_col: str = "seq_id") -> DataFrame:
    """(id, start, nt): pieces of `step` residues, each with the first `overlap` of what follows."""
    at = F.explode(F.expr(f"transform(sequence(0, greatest(length(nt) - 1, 0) div {step}), k -> k * {step} + 1)"))
    return sequences.where("length(nt) > 0").withColumn("start", at).select(id_col, "start", F.expr(f"substring(nt, start, {step + overlap})").alias("nt"))


def seeds(sequences: DataFrame, model: Model, constraints: bool = True, id_col: str = "seq_id") -> DataFrame:
    """(id, fp, tp, len, start, end): placements of the largest helix that leave room for the least lead and trail, with the
    extent that the pattern reaches at most; with constraints, only those around which every constraint could hold."""
    h = model.largest()
    helix, (near, far) = model.helices[h], model.spans[h]
    limits = model.limits()
    (lead, lead_far), (trail, trail_far) = limits["lead"], limits["trail"]
    df = windows(sequences, 2 * helix.high + far + trail_far, lead_far, id_col=id_col)
    df = df.withColumn("g", F.explode(F.expr(_placements(helix.low, helix.high, near, far, False))))
    df = df.where(f"cur - {lead} >= 1 and g.tp + g.len - 1 + {trail} <= size(b)")
    if constraints:
        df = df.where(constraint_possible(model, h))
    start, end = f"greatest(1, cur - {lead_far}) + off", f"least(size(b), g.tp + g.len - 1 + {trail_far}) + off"
    return df.select(id_col, F.expr("cur + off").alias("fp"), F.expr("g.tp + off").alias("tp"), F.col("g.len").alias("len"), F.expr(start).cast("int").alias("start"), F.expr(end).cast("int").alias("end"))


def subsume(extents: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(id, start, end) without those that lie in another one."""
    before = Window.partitionBy(id_col).orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    df = extents.select(id_col, "start", "end").distinct().withColumn("reach", F.max("end").over(before))
    return df.where("reach is null or reach < end").drop("reach")


def extend(extents: DataFrame, most: int, id_col: str = "seq_id") -> DataFrame:
    """Extents stretched to `most` residues from their start, from left to right; one whose end lies in the last stretched one is dropped.

    The walk is sequential, so a sequence's extents meet in one row; their number is bounded by its length.
    """
    row = "named_struct('start', x.start, 'end', x.start + {0} - 1)".format(most)
    keep = f"aggregate(e, named_struct('reach', 0, 'kept', cast(array() as array<struct<start:int,end:int>>)), (a, x) -> if(x.end <= a.reach, a, named_struct('reach', x.start + {most} - 1, 'kept', concat(a.kept, array({row})))), a -> a.kept)"
    grouped = extents.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("e"))
    return grouped.select(id_col, F.explode(F.expr(keep)).alias("x")).select(id_col, "x.start", "x.end")


def emit(sequences: DataFrame, regions: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(id, start, end) of every sequence; (0, 0) where nothing was found."""
    return sequences.select(id_col).join(regions, id_col, "left").select(id_col, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("start", "end")))


def regions(sequences: DataFrame, model: Model, id_col: str = "seq_id") -> DataFrame:
    return subsume(seeds(sequences, model, id_col=id_col), id_col)
