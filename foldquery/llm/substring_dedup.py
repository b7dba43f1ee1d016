"""Substring deduplication: hash lines and the sentences in them, keep the earliest occurrence, cut the rest out.

A unit ends at a line break, or at a sentence end (. ! ? before white space) once it has `least_words` words, so a passage
that is pasted into the middle of other lines falls into equal units from its second sentence on. Units are compared by a
128-bit digest of their lower-cased words. Over the corpus only the smallest doc_id of each digest is gathered, with sums
combined before the shuffle; the digests that a document has to lose then come back to it.
A unit is a repeat if a smaller doc_id has it or it came before in the same text. Runs of adjacent repeats are cut if they
have `run_words` words or more, and a repeat that is a whole line whatever its length; a short sentence that many texts
share stays where it stands alone inside a line. A short line of several sentences is compared as a line as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldquery.llm.common import forget, table, unused, written

_END = re.compile(r"[.!?][ \t\r]+|\n+")
LEAST_WORDS, RUN_WORDS = 4, 8
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def units(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised unit): the spans cover the text without gaps; offsets count characters."""
    out, start, parts = [], 0, []
    ends = [m.end() for m in _END.finditer(text)]
    at = 0
    for end in [*ends, len(text)]:
        if end == at:
            continue
        parts += text[at:end].lower().split()
        at = end
        if len(parts) >= least_words or text[end - 1] == "\n" or end == len(text):
            out.append((start, end, len(parts), " ".join(parts)))
            start, parts = end, []
    return out


def _lines(text: str, least_words: int) -> Iterator[list[tuple[int, int, int, str]]]:
    """The units, line by line."""
    line = []
    for u in units(text, least_words):
        line.append(u)
        if text[u[1] - 1] == "\n":
            yield line
            line = []
    if line:
        yield line


def _short(line: list[tuple[int, int, int, str]], run_words: int) -> str | None:
    """A line of several units that has too few words for a run, as one unit."""
    if len(line) == 1 or sum(u[2] for u in line) >= run_words:
        return None
    said = [u[3] for u in line if u[2]]
    return " ".join(said) if len(said) > 1 else None


def _digests(text: str, least_words: int, run_words: int) -> set[bytes]:
    lines = [*_lines(text, least_words)]
    return {_digest(u[3]) for line in lines for u in line if u[2]} | {_digest(s) for line in lines if (s := _short(line, run_words))}


def _digest(unit: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass"))


def _hashed(least_words: int, run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                found = [_digests(t, least_words, run_words) if t else () for t in texts]
                d = np.frombuffer(b"".join(x for s in found for x in s), dtype=">i8").astype(np.int64)  # hex(d1) || hex(d2) is the digest
                owner = pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found]))
                yield pa.record_batch([pa.array(d[0::2]), pa.array(d[1::2]), part.column(0).take(owner)], ["d1", "d2", "id"])

    return run


def cut(text: str, lost: set[bytes], least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """The spans to cut from one text: runs of units that are in `lost` or came before in the text, and whole lines that are."""
    seen: set[bytes] = set()
    spans, run, n, whole = [], None, 0, []

    def repeated(unit: str) -> bool:
        d = _digest(unit)
        known = d in lost or d in seen
        seen.add(d)
        return known

    for line in _lines(text, least_words):
        marks = [repeated(u[3]) if u[2] else None for u in line]  # blank: belongs to whatever stands before
        joined = _short(line, run_words)
        lost_line = repeated(joined) if joined else [m for m in marks if m is not None] == [True]
        if lost_line:
            marks = [m if m is None else True for m in marks]
        for (start, end, k, _), repeat in zip(line, marks, strict=True):
            if repeat is False:
                spans += [run] if run and n >= run_words else whole
                run, n, whole = None, 0, []
            elif repeat or run:
                run, n = (run[0] if run else start, end), n + k
        start, end = line[0][0], line[-1][1]
        if whole and whole[-1][1] == start and (lost_line or not any(u[2] for u in line)):
            whole[-1] = (whole[-1][0], end)
        elif lost_line:
            whole.append((start, end))
    return spans + ([run] if run and n >= run_words else whole)


def _cutter(names: list[str], text_col: str, least_words: int, run_words: int, as_: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, lost = part.column(names.index(text_col)).to_pylist(), part.column(len(names)).to_pylist()
                spans = [cut(t, {*(x or ())}, least_words, run_words) if t else [] for t, x in zip(texts, lost, strict=True)]
                kept = []
                for t, s in zip(texts, spans, strict=True):
                    for a, b in reversed(s):
                        t = t[:a] + t[b:]
                    kept.append(t)
                cols = [pa.array(kept, pa.string()) if n == text_col else part.column(i) for i, n in enumerate(names)]
                cols.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.record_batch(cols, [*names, as_])

    return run


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS, as_: str = "removed") -> DataFrame:
    """docs with the text cut and a column `removed` (or as_): array of (start, end) in characters of the original text.

    Ids are of any ordered type. A null text stays null, an empty one empty, with nothing removed. Rows that share an id never
    lose units to each other, only to smaller ids; rows with a null id lose nothing to others and make others lose nothing. An
    empty table gives no rows. Other columns stay, whatever their names, but one called as_ is replaced.
    """
    docs = docs.drop(as_)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    hashed = written(keyed.mapInArrow(_hashed(least_words, run_words), f"d1 long, d2 long, id {kind}"), "units")
    first = hashed.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    digest = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("d1", "d2"))))
    id_, lost_ = unused("_id", docs.columns), unused("_lost", docs.columns)
    lost = hashed.join(first, ["d1", "d2"]).where("id > first").groupBy(F.col("id").alias(id_)).agg(F.collect_set(digest).alias(lost_))
    lost = written(lost, "lost")
    forget(hashed)
    joined = docs.join(lost, docs[id_col] == lost[id_], "left").drop(id_)
    schema = T.StructType([*docs.schema.fields, T.StructField(as_, SPANS)])
    return joined.mapInArrow(_cutter(docs.columns, text_col, least_words, run_words, as_), schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, what was removed of the original, and how many characters that is."""
    out = dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "text", "removed", n.cast("long").alias("removed_chars"))
