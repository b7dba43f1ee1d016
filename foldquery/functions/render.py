"""Hits as bracket strings and as text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KNOTS = ("[]", "{}")


def paint(chain: Sequence, constraints: Sequence = ()) -> str:
    """The hit from its first residue to its last: < > helices of stems, ( ) helices around a junction, pseudoknots, triples;
    residues of hairpin loops _, junctions a comma, interior loops and bulges -, and : outside of all helices."""
    helices = sorted((tuple(h)[-3:] for h in chain if tuple(h)[-1]), key=lambda h: (h[0], -h[1]))
    strands = [tuple(s) for s in constraints if tuple(s)[3]]
    spans = [(fp, fp + n) for fp, _, n in helices] + [(tp, tp + n) for _, tp, n in helices] + [(s, s + n) for *_, s, n in strands]
    if not spans:
        return ""
    first, end = min(a for a, _ in spans), max(b for _, b in spans)
    out = [":"] * (end - first)
    inner: dict[int, int | None] = {}  # helix to the helix around it
    for k, (fp, tp, _) in enumerate(helices):
        inner[k] = next((m for m in range(k - 1, -1, -1) if helices[m][0] < fp and tp < helices[m][1]), None)
    kids = [[k for k, m in inner.items() if m == h] for h in range(len(helices))]
    around = set()  # helices with a junction inside
    for h in range(len(helices)):
        x = h
        while len(kids[x]) == 1:
            x = kids[x][0]
        if len(kids[x]) > 1:
            around.add(h)
    for h, (fp, tp, n) in enumerate(helices):  # outer helices first, so that inner ones paint over them
        loop = "_" if not kids[h] else "-" if len(kids[h]) == 1 else ","
        out[fp + n - first : tp - first] = loop * (tp - fp - n)
        left, right = "()" if h in around else "<>"
        out[fp - first : fp + n - first] = left * n
        out[tp - first : tp + n - first] = right * n
    singles = {s[0] for s in strands if s[1] == "single"}
    knots = sorted({s[0] for s in strands} - singles)
    for c, role, start, n in strands:
        mark = ("." if role == "single" else "~") if c in singles else _KNOTS[knots.index(c)][role == "tp"]
        out[start - first : start + n - first] = mark * n
    return "".join(out)


def paint_udf():
    """paint() over columns."""

    @F.pandas_udf("string")
    def run(chains, parts):
        import pandas as pd

        row = lambda xs: [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (xs if xs is not None else ())]
        return pd.Series([paint(row(c), row(p)) for c, p in zip(chains, parts, strict=True)])

    return run


def hit_string(chain: Column, constraints: Column) -> Column:
    """The painted hit, in Arrow batches."""
    return paint_udf()(chain, constraints)


def hit_line(*columns: str) -> Column:
    """ref_id, job_id, time, position, fe, hit with tabs between; energies with five decimals."""
    return F.concat_ws("\t", *(F.format_string("%.5f", F.col(c).cast("double")) if c == "fe" else F.col(c).cast("string") for c in columns))


def hit_dump(chain: str = "chain") -> Column:
    """fp,tp(len) -> ... in chain order."""
    return F.array_join(F.transform(chain, lambda h: F.concat(h["fp"].cast("string"), F.lit(","), h["tp"].cast("string"), F.lit("("), h["len"].cast("string"), F.lit(")"))), " -> ")


def counted_from(hits: DataFrame, first: str) -> DataFrame:
    """hits with the places in chain and constraints counted from the column `first`, which is place 1."""
    shifted = lambda column, places, rest: F.transform(column, lambda x: F.struct(*((x[k] - F.col(first) + 1 if k in places else x[k]).alias(k) for k in rest)))
    return hits.withColumns({
        "chain": shifted("chain", ("fp", "tp"), ("el", "fp", "tp", "len")),
        "constraints": shifted("constraints", ("start",), ("constraint", "role", "start", "len")),
    })
