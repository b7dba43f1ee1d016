import pytest
from pyspark.sql import functions as F

from foldquery.functions.energy import Tables, fe_simple, fe_turner, hit_energy
from foldquery.functions.nucleotides import accession_error, definition_error, group_error, is_sequence, normalize
from foldquery.functions.render import paint
from foldquery.plans.search import search


def test_worked_energies():
    assert hit_energy("gggaaaccc", [(0, 1, 7, 3)]) == pytest.approx(-1.12)
    assert hit_energy("ccccaaaagggg", [(0, 3, 9, 2)]) == pytest.approx(0.84)


def test_energy_terms():
    # special hairpin: its own energy replaces initiation and mismatch; both strands read gc, so symmetry counts
    assert hit_energy("gcuacggc", [(0, 1, 7, 2)]) == pytest.approx(-3.42 + 2.8 + 0.43)
    # bulge of one: 3.81, stacks go on across it; the bulged a could stand for no other base
    assert hit_energy("ggagaaaccc", [(0, 1, 9, 2), (1, 4, 8, 1)]) == pytest.approx(2 * -3.26 + 3.81 + 5.4)
    # bulge of three, and ends beside it
    assert hit_energy("ggaaaggaaacccc", [(0, 1, 13, 2), (1, 6, 11, 2)]) == pytest.approx(2 * -3.26 + 3.2 + 5.4)
    # an interior loop of 1 by 1 by rule, then from a table
    helices = [(0, 1, 12, 2), (1, 4, 9, 2)]
    plain = hit_energy("ggaggaaaccacc", helices)
    assert plain == pytest.approx(2 * -3.26 + 0.5 + 5.4)
    assert hit_energy("ggaggaaaccacc", helices, tables=Tables({"gc.a.gc.a": 0.9})) == pytest.approx(plain + 0.4)
    # pseudoknot: the stacks along its helix
    knot = hit_energy("gggagggacccaaaccc", [(0, 1, 9, 3)], [(0, "fp", 5, 3), (0, "tp", 15, 3)])
    assert knot == pytest.approx(4 * -3.26)


def test_columns(spark):
    rows = spark.createDataFrame([(1, "gggaaaccc")], "seq_id int, nt string")
    r = search(rows, "<<<___>>>").join(rows, "seq_id").select(fe_turner(F.col("nt"), F.col("chain"), F.col("constraints")).alias("fe"), fe_simple().alias("simple")).first()
    assert (round(r.fe, 2), round(r.simple, 2)) == (-1.12, -6.52)


def test_paint():
    assert paint([(0, 1, 33, 4), (1, 8, 15, 4), (2, 22, 28, 3)]) == "((((,,,<<<<___>>>>,,,<<<___>>>,,))))"
    assert paint([(0, 1, 9, 3)], [(0, "fp", 5, 3), (0, "tp", 15, 3)]) == "<<<_[[[_>>>:::]]]"
    assert paint([(0, 1, 11, 1), (1, 3, 8, 2)], [(0, "fp", 2, 1), (0, "tp", 10, 1), (0, "single", 12, 1)]) == "<~<<___>>~>."
    assert paint([]) == ""


def test_fields(spark):
    rows = spark.createDataFrame([("Some definition", "AB.1", "virus-1", "acgua"), ("short", "a", "no spaces", "acgn"), (None, None, None, None), ("x" * 201, "y" * 21, "z" * 13, "a" * 3001)], "d string, a string, g string, nt string")
    got = rows.select(definition_error(F.col("d")), accession_error(F.col("a")), group_error(F.col("g")), is_sequence(F.col("nt"))).collect()
    assert list(got[0]) == [None, None, None, True]
    assert all(got[1][i] for i in range(3)) and got[1][3] is False
    assert all(got[2][i] for i in range(3)) and got[2][3] is None
    assert all("more than" in got[3][i] for i in range(3)) and got[3][3] is False
    assert spark.range(1).select(normalize(F.lit("AC 12\ngT"))).first()[0] == "acgu"


def test_extend(spark):
    from foldquery.operators.regions import extend, subsume

    rows = spark.createDataFrame([(1, 1, 10), (1, 4, 13), (1, 8, 22), (1, 12, 21), (2, 5, 9)], "seq_id int, start int, end int")
    assert sorted(map(tuple, extend(rows, 15).collect())) == [(1, 1, 15), (1, 8, 22), (2, 5, 19)]
    assert sorted(map(tuple, subsume(rows).collect())) == [(1, 1, 10), (1, 4, 13), (1, 8, 22), (2, 5, 9)]
