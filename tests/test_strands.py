"""Runs and containment inside a sequence against the same relations over tables, and what they shuffle."""

import random
import re

import pyarrow as pa
import pytest

from foldquery import queries
from foldquery.operators import helices, strands

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rna(spark):
    """Sequences of any length, some with other letters, one without, one null, one of another task's size."""
    draw = random.Random(5)
    rows = [(k, "".join(draw.choices("acgu", k=n))) for k, n in enumerate([1, 4, 5, 15, 16, 17, 18, 19, 20, 21, 22, 40, 333, 1500])]
    rows += [(k, "".join(draw.choices("acguacgunNé\U0001f600", k=200))) for k in range(50, 56)]
    return spark.createDataFrame([*rows, (90, ""), (91, None), (92, "gggg" * 40 + "cccc" * 40)], "seq_id long, nt string").repartition(3).cache()


def told(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def batch(rows, span):
    """Rows (id, at, own, residues) as a task gets them."""
    ids, at, own, nt = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at, pa.int32()), pa.array(own, pa.int32()), pa.array([x + "-" * span for x in nt])], ["seq_id", "at", "own", "nt"])


def rows_of(batches):
    return sorted(tuple(r.values()) for b in batches for r in b.to_pylist())


@pytest.mark.parametrize("part", [1 << 20, 37])
@pytest.mark.parametrize("near,far", [(4, 20), (1, 6), (7, 7)])
def test_run_counts(spark, rna, monkeypatch, near, far, part):
    monkeypatch.setattr(strands, "_PART", part)
    runs = helices.helix_runs(helices.pair_self_join(rna, near, far)).groupBy("seq_id", "run").count()
    assert told(strands.run_counts(rna, near, far)) == told(runs) != []


def test_run_counts_by_chunks(monkeypatch):
    draw = random.Random(6)
    rows = [(k, 0, n, "".join(draw.choices("acgu", k=n))) for k, n in enumerate([30, 1, 200, 7, 90])]
    whole = rows_of(strands._counter("seq_id", 4, 20)([batch(rows, 21)]))
    monkeypatch.setattr(strands, "_CHUNK", 13)
    assert rows_of(strands._counter("seq_id", 4, 20)([batch(rows, 21)])) == whole != []


def test_helix_runs_shuffles_counts_only(spark):
    """Pairs are several times the residues; the texts are dealt out once, then only counts are."""
    text = plan(queries.QUERIES["helix_runs"](spark, SF))
    assert "Window" not in text and "SortMergeJoin" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "partial_sum" in text
    assert text.count("regexp_replace(") == 1  # residues are made once


TABLES = {"both": helices.contained, "inner": lambda o, i, *r: helices.with_outer(i, o, *r), "outer": helices.with_inner}
RANGES = [((2, 2, 11, 14), (4, 4, 3, 3), (0, 2), (0, 1)), ((1, 3, 4, 9), (1, 2, 0, 3), (0, 1), (1, 2)), ((0, 2, 7, 8), (2, 3, 1, 2), (2, 2), (0, 0))]


def by_tables(rna, outer, inner, lead, tail, keep):
    found = TABLES[keep](helices.enum_helices(rna, *outer), helices.enum_helices(rna, *inner), lead, tail)
    return told(found.select("seq_id", *(["o_fp", "o_tp", "o_len"] if keep == "both" else []), "fp", "tp", "len"))


def by_chunks(monkeypatch, keep):
    """What a task makes of rows cut into parts, at any chunk, is what it makes of the whole sequences."""
    draw = random.Random(7)
    rows = [(k, 0, n, "".join(draw.choices("cg", k=n))) for k, n in enumerate([60, 16, 400, 3, 90])]
    ways = strands._nestings(*RANGES[0])
    span, before = 18, 4 if keep == "inner" else 0
    run = strands._nester("seq_id", ways, span, before, keep)
    whole = rows_of(run([batch(rows, span)]))
    cut = [(k, a, min(25, n - a), nt[max(0, a - before) : a + 25 + span - 1]) for k, _, n, nt in rows for a in range(0, n, 25)]
    monkeypatch.setattr(strands, "_CHUNK", 13)
    assert rows_of(run([batch(rows, span)])) == whole != []
    assert rows_of(run([batch(cut, span)])) == whole


def stays_in_its_task(spark, name):
    """The texts are dealt out once; helices meet where they are found."""
    text = plan(queries.QUERIES[name](spark, SF))
    assert "Join" not in text and "hashpartitioning" not in text and "Aggregate" not in text


@pytest.mark.parametrize("part", [1 << 20, 37])
@pytest.mark.parametrize("ranges", RANGES)
def test_nested_both(spark, rna, monkeypatch, ranges, part):
    monkeypatch.setattr(strands, "_PART", part)
    assert told(strands.nested(rna, *ranges)) == by_tables(rna, *ranges, "both") != []


def test_nested_both_by_chunks(monkeypatch):
    by_chunks(monkeypatch, "both")


def test_join_containment_without_join(spark):
    stays_in_its_task(spark, "join_containment")


def test_nested_of_nothing(spark, rna):
    """Ranges that leave no room, and a sequence without an id."""
    assert told(strands.nested(rna, (2, 2, 3, 4), (4, 4, 3, 3), (0, 2), (0, 1))) == []
    nobody = spark.createDataFrame([(None, "gggg" * 40 + "cccc" * 40)], "seq_id long, nt string")
    assert told(strands.nested(nobody, *RANGES[0])) == by_tables(nobody, *RANGES[0], "both") == []
    with pytest.raises(ValueError, match="keep"):
        strands.nested(rna, *RANGES[0], keep="none")


@pytest.mark.parametrize("part", [1 << 20, 37])
@pytest.mark.parametrize("ranges", RANGES)
def test_nested_outer(spark, rna, monkeypatch, ranges, part):
    monkeypatch.setattr(strands, "_PART", part)
    assert told(strands.nested(rna, *ranges, "outer")) == by_tables(rna, *ranges, "outer") != []


def test_nested_outer_by_chunks(monkeypatch):
    by_chunks(monkeypatch, "outer")


def test_semi_join_down_without_join(spark):
    stays_in_its_task(spark, "semi_join_down")


@pytest.mark.parametrize("part", [1 << 20, 37])
@pytest.mark.parametrize("ranges", RANGES)
def test_nested_inner(spark, rna, monkeypatch, ranges, part):
    monkeypatch.setattr(strands, "_PART", part)
    assert told(strands.nested(rna, *ranges, "inner")) == by_tables(rna, *ranges, "inner") != []


def test_nested_inner_by_chunks(monkeypatch):
    by_chunks(monkeypatch, "inner")


def test_semi_join_up_without_join(spark):
    stays_in_its_task(spark, "semi_join_up")
