import pytest

from foldquery.plans.cssd import PatternError, close_position, join, parse, split, symbols_match, validate, variable, variable_symbol

REFUSED = [
    ("", "", "the pattern is empty"),
    ("<<___>", "", "< and > don't balance"),
    ("((,,)", "", "( and ) don't balance"),
    ("<<_[[_>>::]", "", "there are not as many [ as ]"),
    ("]]_[[", "", "] comes before ["),
    ("<<_[_[_>>:]]", "", "[ or ] stands in more than one run"),
    ("<~<___>>", "", "a triple needs two ~ and one ."),
    ("<<:__>>", "", "place 3: a free residue can't stand inside a helix"),
    ("_<<___>>", "", "place 1: _ stands outside of a stem's loop"),
    (",<<___>>", "", "place 1: a comma stands outside of a junction"),
    ("<<_x_>>", "", "place 4: x is no symbol"),
    ("<<<___>>>", "1 1", "place 3: the run has a variable already"),
    ("<<<___>>>", "      1", "place 7: the closing side takes no variable"),
    ("<<<___>>>", "0", "place 1: 0 is no variable"),
    ("<<<___>>>", "          1", "variables stand past the end"),
]


@pytest.mark.parametrize(("ss", "pos_var", "starts"), REFUSED)
def test_refused(ss, pos_var, starts):
    assert (validate(ss, pos_var) or "").startswith(starts)
    with pytest.raises(PatternError):
        parse(ss, pos_var)


def test_brackets_and_ranges():
    assert [close_position("((<>[)]", i) for i in range(-1, 8)] == [-1, -1, 5, 3, -1, 6, -1, -1, -1]
    assert symbols_match("((__))", "<<-->>") and symbols_match("<<,:>>", "((__))") and not symbols_match("<<__>>", "<<__>~") and not symbols_match("<<_>>", "<<__>>")
    model = parse("((,,<<<___>>>,<<__>>,))", "  1")
    assert [model.variable_range(t) for t in model.tokens if t.kind == "free"][0] == 1
    assert model.contained() == [(0, 1, 1, 2), (0, 2, 11, 12)]


def test_variables():
    assert [variable(c) for c in " 19ap"] == [0, 1, 9, 10, 25]
    assert variable("q") == variable("0") == -1
    assert all(variable(variable_symbol(v)) == v for v in range(26))


def test_lengths():
    m = parse("<<<___>>>", "1")
    assert (m.helices[0].low, m.helices[0].high, m.size(), m.length()) == (2, 3, 2, (7, 9))
    assert m.spans == {0: (3, 3)}
    assert parse("((,,,,,))", "  1").spans == {0: (4, 5)}
    assert not m.wrapped and parse("::<<<___>>>").wrapped


def test_nested_helices():
    m = parse("<<-<___>>->", "1 1      1")
    assert [(h.low, h.high) for h in m.helices] == [(0, 1), (1, 1), (1, 1)]
    assert m.largest() == 1
    assert m.limits()["lead"] == (0, 1)


def test_partitions():
    m = parse("<<<_________>>>:::::<<<___>>>", "   p            p")
    assert m.size() == 26 * 26
    parts = m.partitions(100)
    assert len(parts) == 26 and len({tuple(p.items()) for p in parts}) == 26
    assert m.partitions() == [{}]


def test_stored_form():
    assert split(join("<<___>>", "1")) == ("<<___>>", "1")
    assert split("<<___>>") == ("<<___>>", "")
