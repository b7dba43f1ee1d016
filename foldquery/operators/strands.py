"""Runs and containment inside one sequence: no join, no shuffle.

Both relate pairs that stand within a few residues of each other, so the task that reads a sequence has all it takes. Residues go
to Arrow batches; which positions pair at a distance is one array operation, and a helix or a pair of helices is an `and` of
such arrays, shifted. The same relations over tables of pairs or helices that exist already are in operators.helices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions looked at together; what stands beyond them is read, however long the sequence is.
_CHUNK = 1 << 17
#: Residues that go to Python in one row; a longer sequence is cut into parts that overlap.
_PART = 1 << 22
_OWN = np.zeros(256, np.uint8)
_OWN[list(b"acgu")] = 1, 2, 4, 8
#: For each residue the ones that it pairs with: a with u, c with g, g with c and u, u with a and g.
_MATE = np.zeros(256, np.uint8)
_MATE[list(b"acgu")] = 8, 4, 10, 5


def _parts(sequences: DataFrame, span: int, before: int, id_col: str) -> DataFrame:
    """(id, at, own, nt): parts of each sequence, `own` positions from `at` on (from 0), after up to `before` others.

    A part goes on for span - 1 residues after its own and ends with `span` that pair with none, so nothing reaches into the next row.
    """
    cut = f"""transform(sequence(0, (n_nt - 1) div {_PART}), k -> named_struct('at', cast(k * {_PART} as int), 'own', cast(least({_PART}, n_nt - k * {_PART}) as int),
        'nt', if(n_nt <= {_PART}, nt, substring(nt, k * {_PART} - least({before}, k * {_PART}) + 1, least({before}, k * {_PART}) + {_PART + span - 1}))))"""
    df = sequences.select(id_col, "nt", F.length("nt").alias("n_nt"))  # no filter: it would make the residues twice
    df = df.select(id_col, F.explode(F.expr(f"if(n_nt > 0, {cut}, array())")).alias("w"))
    return df.select(id_col, "w.at", "w.own", F.concat("w.nt", F.lit("-" * span)).alias("nt"))


def _residues(col: pa.Array, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all rows in one array with `tail` bytes after them, and where each row starts; a letter of several
    bytes counts once."""
    wide = pa.types.is_large_string(col.type)
    starts = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    text = np.frombuffer(col.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    if len(text) and text.max() >= 0x80:
        first = (text & 0xC0) != 0x80
        starts = np.concatenate(([0], np.cumsum(first)))[starts]
        text = text[first]
    return np.concatenate((text, np.zeros(tail, np.uint8))), starts


class _Pairing:
    """Which positions of a stretch pair, at each distance that is asked for."""

    def __init__(self, letters: np.ndarray):
        self.own, self.mate = _OWN[letters], _MATE[letters]
        self.kept: dict = {}

    def pairs(self, distance: int) -> np.ndarray:
        """For each position that has one so far on: do the two pair?"""
        if distance not in self.kept:
            self.kept[distance] = (self.mate[: len(self.mate) - distance] & self.own[distance:]) != 0
        return self.kept[distance]

    def stems(self, length: int, loop: int, n: int) -> np.ndarray:
        """For each of the first n positions: does a helix of `length` pairs around `loop` residues start there?"""
        key = (length, loop, n)
        if key not in self.kept:
            last = 2 * length + loop - 1
            found = self.pairs(last)[:n]
            for r in range(1, length):
                found = found & self.pairs(last - 2 * r)[r : r + n]
            self.kept[key] = found
        return self.kept[key]


def _counter(id_col: str, near: int, far: int) -> Callable:
    most = max(0, (far - near) // 2 + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.uint8 if most < 255 else np.int32
        for batch in batches:
            own = batch.column("own").to_numpy()
            text, starts = _residues(batch.column("nt"), far)
            # own positions begin each row, as no part asks for residues before them
            counts = np.zeros((len(own), most + 1), np.int64)
            ends = starts[:-1] + own
            for s in range(0, int(starts[-1]), _CHUNK):
                e = min(s + _CHUNK, int(starts[-1]))
                r0, r1 = np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, e, "left")
                # a bin for each row and run; what lies after a row's own positions goes to a bin past the last row
                cuts = np.clip(np.stack((starts[r0:r1], ends[r0:r1]), 1).ravel(), s, e)
                bins = np.full((r1 - r0, 2), r1 - r0, np.int64)
                bins[:, 0] = np.arange(r1 - r0)
                row = np.repeat(bins.ravel() * (most + 1), np.diff(np.append(cuts, e)))
                found = _Pairing(text[s : e + far])
                runs: dict[int, np.ndarray] = {}
                for d in range(near, far + 1):
                    here = found.pairs(d).astype(small)
                    if d - 2 in runs:
                        here *= 1 + runs[d - 2][1 : 1 + len(here)]
                    runs[d] = here
                    got = np.bincount(row + here[: e - s], minlength=(r1 - r0 + 1) * (most + 1))
                    counts[r0:r1] += got.reshape(-1, most + 1)[:-1]
            counts[:, 0] = 0
            rows, lengths = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows)), pa.array(lengths.astype(np.int64)), pa.array(counts[rows, lengths])], [id_col, "run", "n"])

    return run


def run_counts(sequences: DataFrame, near: int, far: int, id_col: str = "seq_id") -> DataFrame:
    """(id, run, n): how many pairs with j - i from near to far have `run` pairs inward without a gap, themselves included.

    What helices.helix_runs tells of the pairs of helices.pair_self_join, counted. Inward neighbours are pairs of these
    distances as well. Only the counts are shuffled.
    """
    if not 1 <= near <= far:
        raise ValueError("distances are from 1 up")
    kind = dict(sequences.dtypes)[id_col]
    df = _parts(sequences, far + 1, 0, id_col).select(id_col, "own", "nt").mapInArrow(_counter(id_col, near, far), f"`{id_col}` {kind}, run long, n long")
    return df.groupBy(id_col, "run").agg(F.sum("n").alias("n"))


Helices = tuple[int, int, int, int]


def _nestings(outer: Helices, inner: Helices, lead: tuple[int, int], tail: tuple[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Each (length, loop, skip, inner length, inner loop) that the ranges allow; skip is from start to start."""
    out = []
    for length in range(max(1, outer[0]), outer[1] + 1):
        for n in range(max(1, inner[0]), inner[1] + 1):
            for d in range(inner[2], inner[3] + 1):
                for x in range(lead[0], lead[1] + 1):
                    out += [(length, loop, length + x, n, d) for y in range(tail[0], tail[1] + 1) if outer[2] <= (loop := x + 2 * n + d + y) <= outer[3]]
    return out


def _nester(id_col: str, ways: list[tuple[int, int, int, int, int]], span: int, before: int, keep: str) -> Callable:
    names = {"both": ["o_fp", "o_tp", "o_len", "fp", "tp", "len"]}.get(keep, ["fp", "tp", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if ways else ():
            at, own = (batch.column(c).to_numpy().astype(np.int64) for c in ("at", "own"))
            text, starts = _residues(batch.column("nt"), 2 * span)
            left = np.minimum(before, at)  # residues of a row before its own
            for s in range(0, int(starts[-1]), _CHUNK):
                e = min(s + _CHUNK, int(starts[-1]))
                low = max(0, s - before)
                found, n = _Pairing(text[low : e + 2 * span]), e - low
                marked: dict[tuple[int, int], np.ndarray] = {}
                hits = []
                for length, loop, skip, n2, d in ways:
                    hit = found.stems(length, loop, n) & found.stems(n2, d, n + span)[skip : skip + n]
                    if keep == "both":
                        hits.append((low + np.flatnonzero(hit), length, loop, skip, n2, d))
                    elif keep == "outer":
                        marked[length, loop] = marked.get((length, loop), False) | hit
                    else:
                        there = marked.setdefault((n2, d), np.zeros(n + span, bool))
                        there[skip : skip + n] |= hit
                hits += [(fp, length, loop) for (length, loop), m in marked.items() for fp in [low + np.flatnonzero(m)]]
                made = []
                for fp, *rest in hits:
                    fp = fp[(fp >= s) & (fp < e)]
                    row = np.searchsorted(starts, fp, "right") - 1
                    place = fp - starts[row] - left[row]
                    mine = (place >= 0) & (place < own[row])
                    fp, row = place[mine] + at[row[mine]] + 1, row[mine]
                    strands = [(0, *rest[:2]), rest[2:]] if keep == "both" else [(0, *rest)]
                    made.append([row, *(x for skip, n2, d in strands for x in (fp + skip, fp + skip + n2 + d, np.full(len(fp), n2)))])
                rows, *columns = (np.concatenate(x) for x in zip(*made, strict=True))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows)), *(pa.array(c.astype(np.int32)) for c in columns)], [id_col, *names])

    return run


def nested(sequences: DataFrame, outer: Helices, inner: Helices, lead: tuple[int, int], tail: tuple[int, int], keep: str = "both", id_col: str = "seq_id") -> DataFrame:
    """Helices (low, high, near, far as in helices.enum_helices) with others inside, lead residues between their 5' strands and
    tail between their 3' strands.

    keep: both (id, o_fp, o_tp, o_len, fp, tp, len; a row for each two), outer or inner (id, fp, tp, len; each helix once that
    has one inside, or that is inside of one). What helices.contained, with_inner and with_outer tell of the tables. As there,
    sequences without an id are passed over. Ids are taken to be unique: helices of two rows never meet.
    """
    if keep not in ("both", "outer", "inner"):
        raise ValueError("keep is both, outer or inner")
    ways = _nestings(outer, inner, lead, tail)
    span = max([2 * length + loop for length, loop, *_ in ways], default=1)
    before = max([skip for _, _, skip, *_ in ways], default=0) if keep == "inner" else 0
    kind = dict(sequences.dtypes)[id_col]
    columns = "o_fp int, o_tp int, o_len int, fp int, tp int, len int" if keep == "both" else "fp int, tp int, len int"
    df = _parts(sequences.where(F.col(id_col).isNotNull()), span, before, id_col)
    return df.mapInArrow(_nester(id_col, ways, span, before, keep), f"`{id_col}` {kind}, {columns}")
