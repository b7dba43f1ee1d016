import random
import re

import pytest
from pyspark.sql import functions as F

from foldquery.llm import common
from foldquery.llm.common import components, words
from foldquery.llm.ngram_join import jaccard_components, keep_one

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    assert [x.encode() for x in w] == words(text or "")
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_force(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and den * len(a & b) >= num * len(a | b) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies(rng, n, length, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num", "options"), [(3, 90, {}), (5, 80, {}), (3, 90, {"frequent": 2, "room": 6}), (2, 60, {"frequent": 3, "room": 300, "rounds": 1}), (3, 90, {"frequent": 1, "room": 5000, "rounds": 0})])
def test_brute_force(spark, k, num, options):
    rng = random.Random(k)
    texts = near_copies(rng, 60, 80, 6) + near_copies(rng, 30, 25, 3) + near_copies(rng, 30, 200, 12)
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    texts += texts[:10] + ["", "  \t\n", "a", "É\x1c\x85x\u00a0y Ü\u2003z", "A", "a b", "A  B", "a b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), ngram=k, num=num, den=100, **options).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, k, num, 100)


def test_odd_rows(spark):
    rows = [(1, "a b c d", 1), (2, "A b  c d", 2), (2, "A b  c d", 2), (None, "a b c d", 3), (3, None, 4), (4, "", 5), (5, "e f", 6), (5, "g h", 7), (6, "g h", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int").withColumns({"n": F.lit(1), "root": F.lit("x"), "key": F.lit(0)})
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_components(df, ngram=3, num=90).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3), (4, 0, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0


def test_hot_group(spark):
    """2,000 copies of one text with up to 24 changes, so about half of them lie beyond the threshold from the text itself:
    the pairs that are verified grow with the group, not with its square."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(2000):
        w = list(base)
        for _ in range(rng.randrange(25)):
            w[rng.randrange(150)] = f"x{rng.randrange(60)}"
        texts.append(" ".join(w))
    rows, seen = list(enumerate(texts)), []
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), ngram=3, num=90, tell=lambda r, n: seen.append(n)).collect()
    assert sorted(map(tuple, got)) == brute_force(rows, 3, 90, 100)
    assert sum(seen) < 20 * len(rows)


def test_string_ids(spark):
    rows = [("b", "p q r s t"), ("a", "p q r s t"), ("c", "p q r s t u v"), (None, "p q")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id string, text string"), ngram=3, num=50).collect()
    assert sorted(((r.id, r.component_id) for r in got), key=str) == sorted([("a", "a"), ("b", "a"), ("c", "a"), (None, None)], key=str)


def test_steps_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    rows = [(i, " ".join(f"w{i // 5}{k}" for k in range(30)) + f" {i % 2}") for i in range(50)]
    jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), ngram=3, num=60).collect()
    assert len(list(tmp_path.iterdir())) == 3  # what the result itself reads
    common.forget_written()
    assert not list(tmp_path.iterdir())


def test_long_text(spark):
    rng = random.Random(0)
    w = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:59_000] + ["z"] * 5)), (3, " ".join(w[:30_000]))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), ngram=5, num=80).collect()
    assert {r.id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_keep_one(spark):
    rows = [(7, "a b c d e f", "en"), (3, "a b c d e f", "fr"), (None, "a b c d e f", "de"), (9, "other", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 9, None]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (3, 2), (4, 3), (5, 4), (9, 8), (8, 7)], [(i, i + 1) for i in range(60)], [(100, i) for i in range(50)] + [(200, i) for i in range(50, 80)] + [(200, 100)]])
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in edges)}
