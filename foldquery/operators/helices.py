"""Base pairs and helices as tables, and the joins between them.

Positions are joined by equality only: a small literal range of distances is exploded first, so no join is planned as a
nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldquery.plans.cssd import Model
from foldquery.plans.search import _placements, stack_holds, windows


def explode_positions(sequences: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """(id, pos, nt), positions from 1."""
    return sequences.select(id_col, F.posexplode(F.split("nt", "")).alias("pos", "nt")).where("nt <> ''").withColumn("pos", F.col("pos") + 1)


def pair_self_join(sequences: DataFrame, near: int, far: int, id_col: str = "seq_id") -> DataFrame:
    """(id, i, j): pairs with j - i from near to far; each residue meets only those at these distances, inside its window."""
    df = windows(sequences, far + 1, id_col=id_col)
    df = df.withColumn("d", F.explode(F.expr(f"filter(sequence({near}, {far}), d -> (get(b, cur - 1) | get(b, cur + d - 1)) in (6, 9, 12))")))
    return df.select(id_col, F.expr("cur + off").alias("i"), F.expr("cur + d + off").alias("j"))


def enum_helices(sequences: DataFrame, low: int, high: int, near: int, far: int, id_col: str = "seq_id") -> DataFrame:
    """(id, fp, tp, len): every helix of low to high pairs that encloses near to far residues."""
    df = windows(sequences, 2 * high + far, id_col=id_col).withColumn("g", F.explode(F.expr(_placements(low, high, near, far, False))))
    return df.select(id_col, F.expr("cur + off").alias("fp"), F.expr("g.tp + off").alias("tp"), F.col("g.len").alias("len"))


class HelixTables:
    """Helices of one sequence table, kept for the patterns that ask for the same lengths and distances.

    Kept rows spill to the executors' disks and are made again if an executor is lost; drop() lets them go.
    """

    def __init__(self, sequences: DataFrame, id_col: str = "seq_id"):
        self.sequences, self.id_col = sequences, id_col
        self.kept: dict[tuple[int, int, int, int], DataFrame] = {}

    def get(self, low: int, high: int, near: int, far: int) -> DataFrame:
        key = (low, high, near, far)
        if key not in self.kept:
            self.kept[key] = enum_helices(self.sequences, *key, id_col=self.id_col).persist()
        return self.kept[key]

    def of(self, model: Model, helix: int) -> DataFrame:
        h = model.helices[helix]
        return self.get(h.low, h.high, *model.spans[helix])

    def drop(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()


def enum_helices_ext(sequences: DataFrame, low: int, high: int, near: int, far: int, intrusion: int, extrusion: int, id_col: str = "seq_id") -> DataFrame:
    """As enum_helices, of helices whose pairing goes on for `intrusion` pairs inside and `extrusion` outside."""
    wide = windows(sequences, 2 * high + far + extrusion, extrusion, id_col=id_col).withColumn("g", F.explode(F.expr(_placements(low, high, near, far, False))))
    inside = stack_holds("(cur + g.len)", "(g.tp - 1)", str(intrusion))
    outside = stack_holds(f"(cur - {extrusion})", f"(g.tp + g.len - 1 + {extrusion})", str(extrusion))
    room = f"cur - {extrusion} >= 1 and g.tp + g.len - 1 + {extrusion} <= size(b)"
    return wide.where(f"{room} and {inside} and {outside}").select(id_col, F.expr("cur + off").alias("fp"), F.expr("g.tp + off").alias("tp"), F.col("g.len").alias("len"))


def helix_runs(pairs: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """pairs (id, i, j) with run: how many pairs follow inward without a gap, the pair itself included.

    Pairs of a helix share i + j; runs are islands of consecutive i on such an anti-diagonal.
    """
    line = Window.partitionBy(id_col, F.col("i") + F.col("j")).orderBy("i")
    df = pairs.withColumn("island", F.col("i") - F.row_number().over(line))
    rest = Window.partitionBy(id_col, F.col("i") + F.col("j"), "island").orderBy(F.col("i").desc())
    return df.withColumn("run", F.row_number().over(rest)).drop("island")


def cap(helices: DataFrame, most: int, id_col: str = "seq_id") -> DataFrame:
    """At most `most` placements for each sequence, length and enclosed distance, in order of position."""
    w = Window.partitionBy(id_col, "len", F.col("tp") - F.col("fp") - F.col("len")).orderBy("fp", "tp")
    return helices.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def advance(partial: DataFrame, helices: DataFrame, skip_low: int, skip_high: int, id_col: str = "seq_id") -> DataFrame:
    """partial (id, cur, ...) joined with the helices that start skip_low to skip_high residues on; cur moves into them."""
    at = partial.withColumn("skip", F.explode(F.sequence(F.lit(skip_low), F.lit(skip_high)))).withColumn("fp", F.col("cur") + F.col("skip"))
    return at.join(helices, [id_col, "fp"]).withColumn("cur", F.col("fp") + F.col("len"))


def null_advance(partial: DataFrame, helices: DataFrame, skip_low: int, skip_high: int, id_col: str = "seq_id") -> DataFrame:
    """advance(), and each partial hit once more with the helix left out."""
    met = advance(partial, helices, skip_low, skip_high, id_col)
    absent = partial.withColumns({"skip": F.lit(None).cast("int"), "fp": F.lit(None).cast("int"), "tp": F.lit(None).cast("int"), "len": F.lit(0)})
    return met.unionByName(absent)


def all_helices(partial: DataFrame, helices: DataFrame, id_col: str = "seq_id") -> DataFrame:
    """What the empty outermost pair meets: every helix of its sequence."""
    return partial.join(helices, id_col).withColumn("cur", F.col("fp") + F.col("len"))


def _around(outer: DataFrame, lead: tuple[int, int], tail: tuple[int, int], id_col: str) -> DataFrame:
    """Each outer helix with each place (fp, last) that a helix inside of it may take."""
    steps = lambda r: F.explode(F.sequence(F.lit(r[0]), F.lit(r[1])))
    df = outer.select(id_col, F.col("fp").alias("o_fp"), F.col("tp").alias("o_tp"), F.col("len").alias("o_len")).withColumn("x", steps(lead)).withColumn("y", steps(tail))
    return df.select(id_col, "o_fp", "o_tp", "o_len", F.expr("o_fp + o_len + x").alias("fp"), F.expr("o_tp - 1 - y").alias("last"))


def contained(outer: DataFrame, inner: DataFrame, lead: tuple[int, int], tail: tuple[int, int], id_col: str = "seq_id") -> DataFrame:
    """Pairs of helices with lead residues between their 5' strands and tail between their 3' strands."""
    return _around(outer, lead, tail, id_col).join(inner.withColumn("last", F.col("tp") + F.col("len") - 1), [id_col, "fp", "last"])


def with_outer(inner: DataFrame, outer: DataFrame, lead: tuple[int, int], tail: tuple[int, int], id_col: str = "seq_id") -> DataFrame:
    """The inner helices that some outer helix contains."""
    places = _around(outer, lead, tail, id_col).select(id_col, "fp", "last")
    return inner.withColumn("last", F.col("tp") + F.col("len") - 1).join(places, [id_col, "fp", "last"], "left_semi").drop("last")


def with_inner(outer: DataFrame, inner: DataFrame, lead: tuple[int, int], tail: tuple[int, int], id_col: str = "seq_id") -> DataFrame:
    """The outer helices that contain some inner helix."""
    ends = inner.select(id_col, "fp", F.expr("tp + len - 1").alias("last"))
    found = _around(outer, lead, tail, id_col).join(ends, [id_col, "fp", "last"], "left_semi")
    return found.select(id_col, F.col("o_fp").alias("fp"), F.col("o_tp").alias("tp"), F.col("o_len").alias("len")).distinct()


def offsets(model: Model, helix: int) -> dict[tuple[int, str], tuple[str, int, int]]:
    """For each constraint strand, from where its start is counted (before, inside or after the helix) and by how much.

    before: from the helix's start downwards; inside: from the end of its 5' strand; after: from the end of its 3' strand.
    """
    tokens = model.tokens
    a = next(i for i, t in enumerate(tokens) if t.kind == "open" and t.ref == helix)
    b = next(i for i, t in enumerate(tokens) if t.kind == "close" and t.ref == helix)
    out = {}
    for i, t in enumerate(tokens):
        role = {"knot5": "fp", "knot3": "tp", "triple5": "fp", "triple3": "tp", "single": "single"}.get(t.kind)
        if role:
            side, part = ("before", tokens[i:a]) if i < a else ("inside", tokens[a + 1 : i]) if i < b else ("after", tokens[b + 1 : i])
            ranges = [model._reach(x) for x in part]
            out[t.ref, role] = side, sum(r[0] for r in ranges), sum(r[1] for r in ranges)
    return out


def constraint_possible(model: Model, helix: int) -> str:
    """SQL over cur, g.len, g.tp and b: can every constraint hold somewhere around a placement of the helix?"""
    where = offsets(model, helix)
    tests = []
    for k, c in enumerate(model.constraints):
        roles = ["fp", "tp"] if c.kind == "pseudoknot" else ["fp", "tp", "single"]
        places, loops = [], []
        for n, role in enumerate(roles):
            side, low, high = where[k, role]
            v = f"v{k}_{n}"
            loops.append((v, low, high))
            places.append(f"(cur - {v})" if side == "before" else f"(cur + g.len + {v})" if side == "inside" else f"(g.tp + g.len + {v})")
        if c.kind == "pseudoknot":
            test = stack_holds(places[0], f"({places[1]} + n - 1)", "n")
            test = f"exists(sequence({c.low}, {c.high}), n -> {places[0]} >= 1 and {places[1]} + n - 1 <= size(b) and {test})"
        else:
            from foldquery.plans.search import _triple

            test = f"(least({', '.join(places)}) >= 1 and greatest({', '.join(places)}) <= size(b) and coalesce({_triple(*places)}, false))"
        for v, low, high in reversed(loops):
            test = f"exists(sequence({low}, {high}), {v} -> {test})"
        tests.append(test)
    return " and ".join(tests) or "true"
