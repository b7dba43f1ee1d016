import random
import re
from itertools import product
from pathlib import Path

import pytest

from foldquery.plans.cssd import parse
from foldquery.plans.search import search

FIXTURES = Path(__file__).parent.parent / "FIXTURES.md"
PAIRS = {"gc", "gu", "au", "cg", "ug", "ua"}


def goldens():
    out = []
    for line in FIXTURES.read_text().splitlines() if FIXTURES.exists() else []:
        if m := re.match(r"\| (\d+) \| `([^`]+)` \| `([^`]+)` \| `([acgu]+)` \| (\d+) \| (.+?) \| `tests", line):
            hits = []
            for x in m[6].split("; "):
                k = re.match(r"\((\d+),(\d+)\)(?:x(\d+))?", x)
                hits += [(int(k[1]), int(k[2]))] * int(k[3] or 1)
            out.append((int(m[1]), m[2], "" if m[3] == "-" else m[3].replace(".", " "), m[4], sorted(hits)))
    return out


@pytest.mark.parametrize("golden", goldens(), ids=lambda g: str(g[0]))
def test_golden(spark, golden):
    n, ss, pos_var, nt, expected = golden
    model = parse(ss, pos_var)
    assert model.unparse()[0] == ss
    rows = search(spark.createDataFrame([(n, nt)], "seq_id int, nt string"), model).collect()
    assert sorted((r.fp, r.tp) for r in rows) == expected


def by_hand(ss, pos_var, nt):
    """All placements of a pattern without optional helices, from its tokens and every choice of lengths."""
    model = parse(ss, pos_var)
    tokens = list(model.tokens)
    while tokens[0].kind == "free":
        tokens.pop(0)
    while tokens[-1].kind == "free":
        tokens.pop()
    free = [i for i, t in enumerate(tokens) if t.kind == "free"]
    found = set()
    for lengths in product(*(range(tokens[i].low, tokens[i].high + 1) for i in free), *(range(x.low, x.high + 1) for x in [*model.helices, *model.constraints])):
        run = dict(zip(free, lengths, strict=False))
        hel, con = lengths[len(free) : len(free) + len(model.helices)], lengths[len(free) + len(model.helices) :]
        for start in range(len(nt)):
            at, place = start, {}
            for i, t in enumerate(tokens):
                n = run[i] if t.kind == "free" else hel[t.ref] if t.kind in ("open", "close") else con[t.ref]
                if t.kind != "free":
                    place[t.kind, t.ref] = (at, n)
                at += n
            if at > len(nt):
                continue
            ok = all(nt[a + r] + nt[b + n - 1 - r] in PAIRS for h in range(len(hel)) for (a, n), (b, _) in [(place["open", h], place["close", h])] for r in range(n))
            for k, c in enumerate(model.constraints):
                if c.kind == "pseudoknot":
                    (a, n), (b, _) = place["knot5", k], place["knot3", k]
                    ok = ok and all(nt[a + r] + nt[b + n - 1 - r] in PAIRS for r in range(n))
                else:
                    five, three, single = (place[x, k][0] for x in ("triple5", "triple3", "single"))
                    if single < five:
                        five, three = three, five
                    ok = ok and nt[five] + nt[three] + nt[single] in ("cgc", "ugc", "uau")
            if ok:
                found.add(tuple(sorted((kind, ref, a + 1, n) for (kind, ref), (a, n) in place.items())))
    return found


@pytest.mark.parametrize(("ss", "pos_var"), [("<<<___>>>", "1"), ("<<-<<___>>>>", "1  1 1"), ("((<<___>>,<<___>>))", "1"), ("<<_[[_>>::]]", "  1 1   1"), ("<~<___>~>:.", "   1     1"), (".:<~<___>~>", " 2"), ("[[:<<___>>]]", "1 2")])
def test_against_by_hand(spark, ss, pos_var):
    rng = random.Random(ss)
    seqs = ["".join(rng.choice("ggccau") for _ in range(rng.randrange(0, 34))) for _ in range(30)]
    got = {}
    names = {("knot5"): "fp", "knot3": "tp", "triple5": "fp", "triple3": "tp", "single": "single"}
    for r in search(spark.createDataFrame(list(enumerate(seqs)), "seq_id int, nt string"), (ss, pos_var)).collect():
        places = {("open", h.el, h.fp, h.len) for h in r.chain} | {("close", h.el, h.tp, h.len) for h in r.chain} | {(s.role, s.constraint, s.start, s.len) for s in r.constraints}
        got.setdefault(r.seq_id, []).append(tuple(sorted(places)))
    for i, nt in enumerate(seqs):
        want = sorted(tuple(sorted((names.get(k, k), ref, a, n) for k, ref, a, n in hit)) for hit in by_hand(ss, pos_var, nt))
        assert sorted(got.get(i, [])) == want, nt


def test_long_sequences_and_odd_rows(spark):
    rng = random.Random(1)
    nt = "".join(rng.choice("acgu") for _ in range(3000))
    rows = spark.createDataFrame([(0, nt), (1, None), (2, ""), (3, "ggnaaaccc"), (4, "gggaaaccc")], "seq_id int, nt string")
    hits = search(rows, ("<<<____>>>", "   2")).collect()
    want = {(i + 1, i + 1 + 3 + d) for i in range(len(nt)) for d in (3, 4, 5) if i + 6 + d <= len(nt) and all(nt[i + r] + nt[i + 5 + d - r] in PAIRS for r in range(3))}
    assert {(r.fp, r.tp) for r in hits if r.seq_id == 0} == want
    assert {r.seq_id for r in hits} == {0, 4}
    assert search(rows.limit(0), "<<<___>>>").count() == 0


def test_helices_are_made_once(spark):
    from foldquery.operators.helices import HelixTables
    from foldquery.plans.cssd import parse

    tables = HelixTables(spark.createDataFrame([(1, "gggaaacccgggaaaccc")], "seq_id int, nt string"))
    one, two = parse("<<<___>>>"), parse("<<<___>>>:::<<<___>>>")
    first = tables.of(one, 0)
    assert tables.of(two, 0) is first and tables.of(two, 1) is first and first.storageLevel.useMemory
    assert sorted((r.fp, r.tp) for r in first.collect()) == [(1, 7), (10, 16)]
    tables.drop()
    assert not tables.kept and not first.storageLevel.useMemory


def test_residues_come_with_hits(spark):
    rows = spark.createDataFrame([(1, "aagggaaacccu" + "a" * 700 + "ngggaaaccc")], "seq_id int, nt string")
    got = sorted((r.position, r.around_start, r.around) for r in search(rows, "<<<___>>>", context=2).collect() if r.around.endswith(("cccu", "cccua", "aaaccc")))
    assert (3, 1, "aagggaaacccua") in got and got[-1] == (714, 712, "angggaaaccc")


def test_no_pairs_of_all(spark):
    """No plan joins all with all or tests pairs in a loop."""
    from foldquery import queries

    for name in ("list_advance", "join_containment", "semi_join_up", "pair_self_join", "member", "search_optional_helix", "lookup_inner"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name
