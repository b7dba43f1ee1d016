import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldquery.llm import quality, toxicity

CALM, RUDE = [f"word{i}" for i in range(200)], ["trashy", "mucko", "grumpel", "muckling", "muckster"]


def best_segments(scores):
    """Maximal-scoring segments by their definition: the best segment, then those left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    score, _, a, b = max((round(sums[b] - sums[a], 9), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    return [*best_segments(scores[:a]), (a, b, score), *[(x + b, y + b, s) for x, y, s in best_segments(scores[b:])]]


def test_segments():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.uniform(-3, 2) for _ in range(rng.randrange(0, 25))]
        got = toxicity.segments(np.array(scores))
        want = best_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])
    assert toxicity.segments(np.array([1.0, -1.0, 1.0])) == [(0, 1, 1.0), (2, 3, 1.0)]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(CALM) for _ in range(rng.randrange(5, 120))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = corpus(400, 2)
    docs += [(1000, None), (1001, ""), (1002, "word1 " * 20_000 + "trashy mucko grumpel"), (1003, "a mucklet came, grumpel and trashy")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(9), "passages": F.lit("x")})
    known = spark.createDataFrame([*labels[:300], (None, 1), (5, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(d.select("doc_id", "text"), known)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    right = sum((got[i].score >= 0.5) == bool(y) for i, y in labels[300:])
    assert right >= 97
    assert got[1000].score < 0.5 and got[1001].score == got[1000].score and got[1000].passages == []
    assert got[1002].score >= 0.5 and got[1003].score >= 0.5
    p = got[1002].passages[-1]
    assert (p.first_token, p.end_token) == (20_000, 20_003) and p.expected < 0.05
    nothing = toxicity.train(d.select("doc_id", "text"), known.limit(0))
    assert all(r.score <= 0.5 for r in toxicity.score(d, nothing).collect())
    assert toxicity.score(d.limit(0), model).count() == 0


def test_lexicon_and_calibration_by_hand(spark):
    """The whole fit again, over lists: log-odds with their prior for every significant word, and the tail of ordinary scores."""
    docs, labels = corpus(300, 7)
    docs = [(i, f"{t} {RUDE[i % 5]}" if i % 7 == 1 else t) for i, t in docs]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (999, 1), (998, 0)], "doc_id long, toxic int"))
    toxic = dict(labels)
    n1, n0 = sum(toxic.values()), 300 - sum(toxic.values())
    held = [(toxicity.features(set(toxicity.tokens(t))), toxic[i]) for i, t in docs]
    want = {}
    for w in {w for f, _ in held for w in f}:
        y1, n = sum(y for f, y in held if w in f), sum(w in f for f, _ in held)
        a = (n + 0.5) / 301 * 50
        d = np.log((y1 + a) / (n1 + 50 - y1 - a)) - np.log((n - y1 + a) / (n0 + 50 - (n - y1) - a))
        if n >= 3 and abs(d / np.sqrt(1 / (y1 + a) + 1 / (n - y1 + a))) >= 2.5:
            want[w] = d
    assert set(want) == set(model.lexicon) and all(model.lexicon[w] == pytest.approx(d) for w, d in want.items()) and len(want) > 5
    calm = [t for i, t in docs if not toxic[i]]
    tops = sorted(s for t in calm for *_, s in best_segments_of(model, t))
    edge = tops[(len(tops) - 1) // 2]
    over = [s for s in tops if s >= edge]
    lam = 1 / max(0.2, sum(over) / len(over) - edge)
    assert model.lam == pytest.approx(lam) and model.k == pytest.approx(min(1.0, len(over) / sum(len(toxicity.tokens(t)) for t in calm) * np.exp(min(50, lam * edge))))


def best_segments_of(model, text):
    scores = [model.score_of(w) for w in toxicity.tokens(text)]
    return best_segments(scores)


def test_words_said_before_score_again():
    model = toxicity.ToxicModel({w: 4.0 for w in RUDE}, drift=1.0)
    calm = " ".join(CALM[:100])
    text = f"trashy {calm} mucko {calm} grumpel {calm} trashy mucko grumpel {calm} trashy so mucko and grumpel"
    n, found = model.passages(text)
    assert n == 411
    assert [(a, b, s) for a, b, s, e in found if e <= model.significant] == [(303, 306, 9.0), (406, 411, 7.0)]
    assert len(found) == 5 and model.passages("trashy " * 3)[1][0][:3] == (0, 3, 9.0)


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(CALM) for _ in range(rng.randrange(30, 200))]
        if bad := i % 5 == 0:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [rng.choice(w)] * len(w) if kind == 1 else [x + "***" for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", "fr"]), f"src{i % 7}", "x"))
        labels.append((i, int(not bad)))
    rows += [(900, None, None, None, None), (901, "", "", "", ""), (902, "word " * 30_000, "en", "src1", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality_score string")
    known = spark.createDataFrame([*labels[:350], (None, 1), (3, None)], "doc_id long, quality int")
    df = df.withColumns({"_x": F.lit("own"), "y": F.lit(1), "id": F.lit("z")})
    seen = quality.view(df)
    model = quality.train(seen, known)
    out = quality.score(seen, model)
    assert sorted(out.columns) == sorted(df.columns) and {r["_x"] for r in out.collect()} == {"own"}
    got = {r.doc_id: r.quality_score for r in out.collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels[350:]) >= 147
    assert all(0 <= s <= 1 for s in got.values()) and {900, 901, 902} <= set(got)
    assert quality.train(seen, known.limit(0)) is None
    assert all(r.quality_score == 1 for r in quality.score(seen, None).collect())
    none = quality.view(df.limit(0))
    assert quality.score(none, model).count() == 0 and quality.train(none, known) is None
    by_hand(df, dict(labels[:350]), model, got)


def by_hand(df, labels, model, got):
    """The rounds over all rows at once, in one process: same pseudo-labels, same scores."""
    rows = df.collect()
    x = np.array([quality.text_view(r.text or "") for r in rows], dtype=np.float32).astype(float)
    m = np.array([quality.meta_view(r.text or "", r.lang, r.source) for r in rows], dtype=np.float32).astype(float)
    y = np.array([labels.get(r.doc_id, -1) for r in rows])
    held, free = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    held = held[np.argsort([r.doc_id for r in rows if r.doc_id in labels])]
    fold = np.array([zlib.crc32(str(rows[i].doc_id).encode()) % quality.FOLDS for i in held])
    same = quality.cotrain((x[held], m[held]), y[held].astype(float), fold, lambda models, bound: quality.sums((x[free], m[free]), models, bound))
    assert [t.tolist() for t in same.told] == [t.tolist() for t in model.told] and model.told[0].sum() > 50
    want = same.probability(x, m)
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


def test_compression_reads_the_whole_text():
    rng = random.Random(6)
    varied = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))
    head = varied(4_000)  # 28 kB
    same, other = head + " " + "spam " * 20_000, head + " " + varied(15_000)
    assert quality.text_view(same)[14] < 0.5 * quality.text_view(other)[14]
    for text in ("a", "é" * 50 + varied(300), same, other):
        data = text.encode()
        assert quality.text_view(text)[14] == pytest.approx(len(zlib.compress(data, 1)) / len(data), rel=0.01)
        assert quality.compressed_share(text, 1000) == pytest.approx(quality.compressed_share(text), rel=0.01)
    assert quality.text_view("")[14] == 0


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    x, m = (y[:, None] * 2 - 1 + rng.normal(0, 1.2, (3000, 2)) for _ in (0, 1))
    few, free = slice(0, 30), slice(30, 1500)
    fold = np.arange(30) % quality.FOLDS
    right = []
    for rounds in (0, 3):
        model = quality.cotrain((x[few], m[few]), y[few].astype(float), fold, lambda models, bound: quality.sums((x[free], m[free]), models, bound), rounds=rounds) if rounds else quality.cotrain((x[few], m[few]), y[few].astype(float), fold, None, rounds=0)
        right.append(((model.probability(x[1500:], m[1500:]) >= 0.5) == y[1500:]).mean())
    assert right[1] > 0.85 and right[1] >= right[0] - 0.005


def test_the_metadata_view_reads_no_words():
    assert quality.meta_view("Good words here\nand there", "en", "s") == quality.meta_view("!!!! ***** ZZZZ\n@@@ #####", "en", "s")


def test_logistic_separates():
    x = np.linspace(-1, 1, 40)[:, None]
    w = toxicity.logistic(x, (x[:, 0] > 0).astype(float))
    assert w[1] > 1 and w[0] == pytest.approx(0, abs=0.2)
