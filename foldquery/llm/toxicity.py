"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration.

Training counts, for each word and each 4- to 9-character word beginning, the toxic and the other labelled documents that
hold it. Its score is the log-odds ratio of the two under an informative Dirichlet prior (the prior's mean is the pooled
rate), kept where it is `least_z` standard deviations from 0. A token scores as its word, else as its longest known
beginning, else 0; every token also pays `drift`, so that scores fall in ordinary text. A linear-time scan finds all
maximal-scoring segments. Their scores are calibrated as extreme values: in ordinary text of n tokens the expected number
of segments scoring S or more is K n exp(-lambda S); lambda and K are
fitted to the upper half of the segments of ordinary training documents. A logistic fit to two features of the significant segments gives the probability.

The fit uses at most `sample` labelled documents (the smallest by a hash of their id); the lexicon has every significant
entry of these, so only the sample bounds what goes to driver and workers. Segment scores are summed up where they are;
the driver gets the two features of each sampled document. Scoring reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldquery.llm.common import forget, table, written

_WORD = re.compile(r"\w+")
HEADS = (9, 8, 7, 6, 5, 4)


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: set[str]) -> set[str]:
    """The words, and as `beginning*` their first 4 to 9 characters."""
    return words | {w[:n] + "*" for w in words for n in HEADS if len(w) > n}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), left to right; linear in the number of scores.

    Each is a run whose every proper beginning and end scores more than 0, and that can't be extended without loss;
    equal scores keep the shorter run.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, total[i], total[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, float(b - a)) for s, e, a, b in found]


@dataclass
class ToxicModel:
    lexicon: dict[str, float]
    drift: float
    lam: float = 1.0
    k: float = 0.01
    weights: tuple[float, float, float] = (-3.0, 1.0, 0.0)
    significant: float = 0.05

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def score_of(self, word: str) -> float:
        s = self.lexicon.get(word)
        if s is None:
            for n in HEADS:
                if len(word) > n and (s := self.lexicon.get(word[:n] + "*")) is not None:
                    break
        return (s or 0.0) - self.drift

    def token_scores(self, words: list[str]) -> np.ndarray:
        """Of each token, wherever it stands: a word said before counts again, or a later passage would be lost."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        out = []
        for w in words:
            if (s := known.get(w)) is None:
                s = known[w] = self.score_of(w)
            out.append(s)
        return np.array(out, dtype=np.float64)

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens; (first token, end, score, expected number by chance) of each segment."""
        words = tokens(text or "")
        n = max(1, len(words))
        return len(words), [(a, b, s, self.k * n * math.exp(-self.lam * s)) for a, b, s in segments(self.token_scores(words))]

    def inputs(self, found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """The best segment's -ln E, at least 0, and the significant segments' summed scores; both damped."""
        best = max((-math.log(max(e, 1e-300)) for *_, e in found), default=0.0)
        return math.log1p(max(0.0, best)), math.log1p(sum(s for *_, s, e in found if e <= self.significant))

    def probability(self, found: list[tuple[int, int, float, float]]) -> float:
        a, b, c = self.weights
        x, y = self.inputs(found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the intercept first) by Newton steps, with ridge on all but the intercept; targets smoothed as by Platt."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([np.ones(len(x)), x])
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) + r * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(r)
        step = np.linalg.solve(h, g)
        norm = np.abs(step).max()
        w -= step if norm < 5 else step * (5 / norm)
        if norm < 1e-8:
            break
    return w


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            texts, toxic = (c.to_pylist() for c in batch.slice(at, 200).columns)
            found = [sorted(features(set(tokens(t or "")))) for t in texts]
            y = np.repeat(np.array(toxic, dtype=np.int32), [len(f) for f in found])
            yield pa.record_batch([pa.array([w for f in found for w in f], pa.string()), pa.array(y)], ["w", "toxic"])


def _summed(model: ToxicModel):
    """Training documents to (label, tokens, scores of segments)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = (c.to_pylist() for c in batch.columns)
            words = [tokens(t or "") for t in texts]
            seg = [[x[2] for x in segments(model.token_scores(w))] for w in words]
            yield pa.record_batch([pa.array(toxic, pa.int32()), pa.array([len(w) for w in words], pa.int32()), pa.array(seg, pa.list_(pa.float64()))], ["toxic", "n", "seg"])

    return run


def _inputs(model: ToxicModel):
    """(toxic, tokens, scores of segments) to (toxic, the two inputs of the logistic fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, seg = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            both = [model.inputs([(0, 0, v, model.k * max(1, m) * math.exp(-model.lam * v)) for v in s]) for m, s in zip(n, seg, strict=True)]
            yield pa.record_batch([batch.column(0), *(pa.array([b[i] for b in both], pa.float64()) for i in (0, 1))], ["toxic", "x", "y"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least_docs: int = 3, least_z: float = 2.5, drift: float = 1.0, prior: float = 50.0) -> ToxicModel:
    """docs (doc_id, text), labels (doc_id, toxic). Null labels and ids are left out; of several labels of one id the largest holds; rows that repeat an id count each; labels without a document count nowhere. Without labels of both kinds the model scores every text 0.5 or less."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")  # at most `sample` ids
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n1 = float(totals.t or 0)
    n0 = float(totals.n) - n1
    model = ToxicModel({}, drift)
    if not n1 or not n0:
        return model
    counts = rows.mapInArrow(_listed, "w string, toxic int").groupBy("w").agg(F.sum("toxic").cast("double").alias("y1"), F.count(F.lit(1)).cast("double").alias("n")).where(F.col("n") >= least_docs)
    a = (F.col("n") + 0.5) / (n0 + n1 + 1) * prior  # the prior's documents that hold the word: always some, never all
    odds = lambda y, n: F.log((y + a) / (n + prior - y - a))
    y0 = F.col("n") - F.col("y1")
    delta = odds(F.col("y1"), n1) - odds(y0, n0)
    z = delta / F.sqrt(1 / (F.col("y1") + a) + 1 / (y0 + a))
    picked = counts.select("w", delta.alias("d"), z.alias("z")).where(F.abs("z") >= least_z).collect()  # at most the sample's words
    model.lexicon = {r.w: r.d for r in picked}
    got = written(rows.mapInArrow(_summed(model), "toxic int, n int, seg array<double>"), "segments")
    calm = got.where("toxic = 0").select("n", F.explode_outer("seg").alias("s"))
    n = got.where("toxic = 0").agg(F.sum("n")).first()[0] or 1
    edge = calm.agg(F.percentile_approx("s", 0.5, 10_000)).first()[0]
    if edge is not None:
        over = calm.where(F.col("s") >= edge).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("s") - edge).alias("mean")).first()
        model.lam = float(1 / max(0.2, over["mean"]))
        model.k = float(min(1.0, over["n"] / n * math.exp(min(50.0, model.lam * edge))))
    else:
        model.k = 1 / n
    inputs = got.mapInArrow(_inputs(model), "toxic int, x double, y double").toArrow()  # at most `sample` rows
    x, y = np.column_stack([inputs.column(c).to_numpy() for c in ("x", "y")]), inputs.column("toxic").to_numpy()
    order = np.lexsort((y, x[:, 1], x[:, 0]))  # sums of the fit don't depend on the order of tasks
    x, y = x[order], y[order]
    forget(got)
    model.weights = tuple(logistic(x, y.astype(float)).tolist())
    return model


PASSAGES = T.ArrayType(T.StructType([T.StructField("first_token", T.IntegerType()), T.StructField("end_token", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
_PASSAGES = pa.list_(pa.struct([("first_token", pa.int32()), ("end_token", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def _scorer(shared, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [model.passages(t)[1] for t in part.column(names.index(text_col)).to_pylist()]
                scores = pa.array([model.probability(f) for f in found], pa.float64())
                told = [[{"first_token": a, "end_token": b, "score": s, "expected": e} for a, b, s, e in f if e <= model.significant] for f in found]
                kept = [part.column(i) for i, n in enumerate(names) if n != text_col]
                yield pa.record_batch([*kept, scores, pa.array(told, _PASSAGES)], [*(n for n in names if n != text_col), "score", "passages"])

    return run


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `passages` (the significant ones, by token) in place of the text.

    Null and empty texts have no passage and the lowest score; equal texts score equally, repeated rows all stay; an empty
    table gives no rows. Columns already called score or passages are replaced.
    """
    docs = docs.drop("score", "passages")
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)])
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), docs.columns, text_col), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every document; labels of held-out rows are never read."""
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held)
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
