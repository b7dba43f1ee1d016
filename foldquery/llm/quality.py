"""Quality by co-training: one classifier sees the text, the other the page's metadata; each teaches the other.

Text view: shares of capitals, digits, symbols, repeats and the like, how well the text compresses, and the shares of its
word endings in hash buckets. Metadata view: length, lines, layout, language and source; it reads no words. Neither has a
feature of the other's kind.

Both classifiers are linear discriminants. Their common covariance and first means come from at most `sample` labelled
documents (the smallest by a hash of their id). In each round every document without a label is scored by both views;
where a view's log-odds are beyond `confident`, the document joins the other view's means as a pseudo-label. These means
are sums over the whole corpus, made where the rows are; all pseudo-labels of a class together weigh up to as much as
its labels, the more the later the round. Last, each view is calibrated by a logistic fit and the calibrated log-odds
are combined by another; both see a labelled row only as scored by a model that was fitted without its fifth.

Features are computed once and written; all rounds read these, and the score is an expression over them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldquery.llm.common import forget, table, unused, written
from foldquery.llm.toxicity import logistic

SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?-]")
ENDINGS, BUCKETS, FOLDS = 32, 16, 5
TEXT_WIDTH, META_WIDTH = 15 + ENDINGS, 6 + 2 * BUCKETS
#: Log-odds are kept within these bounds.
MOST = 12.0
_buckets: dict[str, int] = {}


def text_view(text: str) -> list[float]:
    """Numbers between 0 and about 5 that describe the words of a text; all 0 for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * TEXT_WIDTH
    letters = sum(map(len, words))
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    marks = len(SYMBOLS.findall(text))
    tails = Counter(w[-3:] for w in words)
    ends = [0.0] * ENDINGS
    if len(_buckets) > 100_000:
        _buckets.clear()
    for tail, k in tails.items():
        if (b := _buckets.get(tail)) is None:
            b = _buckets[tail] = zlib.crc32(tail.lower().encode("utf-8", "surrogatepass")) % ENDINGS
        ends[b] += k
    odd = {w: (w.isupper() and len(w) > 1, any(map(str.isdigit, w)), not any(map(str.isalnum, w)), w[-1] in ".,;:?!") for w in seen}
    capitals, digits, bare, closed = (sum(seen[w] for w, f in odd.items() if f[i]) / n for i in range(4))
    return [
        capitals, marks / n, min(5.0, marks / max(1, letters) * 10), len(seen) / n, pairs / max(1, n - 1),
        seen.most_common(1)[0][1] / n, tails.most_common(1)[0][1] / n, letters / n / 5, digits, sum(x == y for x, y in zip(words, words[1:])) / n,
        closed, bare, min(1.0, n / 50), min(2.0, text.count("|") * 10 / len(text)), compressed_share(text), *(e / n for e in ends),
    ]


def compressed_share(text: str, step: int = 1 << 20) -> float:
    """Compressed bytes for each byte of the whole text, which goes through the compressor in steps; 0 for an empty one."""
    if not text:
        return 0.0
    data = memoryview(text.encode("utf-8", "replace"))
    packer = zlib.compressobj(1)
    out = sum(len(packer.compress(data[a : a + step])) for a in range(0, len(data), step))
    return (out + len(packer.flush())) / len(data)


def meta_view(text: str, lang: str | None, source: str | None) -> list[float]:
    """What a page's record says without reading its words: size, layout, language, source."""
    n = len(text)
    lines = text.count("\n") + 1
    places = [0.0] * (2 * BUCKETS)
    places[zlib.crc32((lang or "").encode("utf-8", "surrogatepass")) % BUCKETS] = 1.0
    places[BUCKETS + zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % BUCKETS] = 1.0
    return [np.log1p(n) / 5, np.log1p(lines) / 3, min(5.0, n / lines / 200), min(2.0, 4 * text.count(" ") / max(1, n)), float(n < 200), float(n == 0), *places]


@dataclass
class Linear:
    """Log-odds b + x w."""

    w: np.ndarray
    b: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.b + x @ self.w, -MOST, MOST)


@dataclass
class QualityModel:
    """The two views, their calibrations and the combination; told: pseudo-labels by round, view and class."""

    views: list[Linear]
    calibrated: list[Linear]
    combined: Linear
    told: list[np.ndarray] = field(default_factory=list)

    def probability(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        both = np.column_stack([c.odds(v.odds(f)[:, None]) for v, c, f in zip(self.views, self.calibrated, (x, m), strict=True)])
        return 1 / (1 + np.exp(-self.combined.odds(both)))

    def column(self, x: Column, m: Column) -> Column:
        """probability() as an expression over the two arrays of features."""
        bound = lambda c: F.least(F.greatest(c, F.lit(-MOST)), F.lit(MOST))
        total = lambda c, w: F.aggregate(F.zip_with(c, F.array(*map(F.lit, w.tolist())), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b)
        odds = [bound(F.lit(float(c.b)) + float(c.w[0]) * bound(F.lit(float(v.b)) + total(f, v.w))) for v, c, f in zip(self.views, self.calibrated, (x, m), strict=True)]
        return 1 / (1 + F.exp(-bound(F.lit(float(self.combined.b)) + float(self.combined.w[0]) * odds[0] + float(self.combined.w[1]) * odds[1])))


def discriminant(x: np.ndarray, y: np.ndarray, told: np.ndarray | None, weight: float, ridge: float = 1e-4) -> Linear:
    """From labelled rows and the sums of pseudo-labelled ones (a row for each class: their number, then the sum of x).

    A class's mean is that of its labels and, with up to `weight` of their number, that of its pseudo-labels.
    """
    means, spread = [], ridge * np.eye(x.shape[1])
    for c in (0, 1):
        own = x[y == c]
        mean = own.mean(axis=0)
        spread += (own - mean).T @ (own - mean) / len(x)
        if told is not None and told[c, 0]:
            extra = min(told[c, 0], weight * len(own))
            mean = (mean * len(own) + told[c, 1:] / told[c, 0] * extra) / (len(own) + extra)
        means.append(mean)
    w = np.linalg.solve(spread, means[1] - means[0])
    return Linear(w, float(-(means[0] + means[1]) @ w / 2 + np.log(y.sum() / (len(y) - y.sum()))))


def _fitted(x: np.ndarray, y: np.ndarray) -> Linear:
    w = logistic(x, y)
    return Linear(w[1:], float(w[0]))


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, gather: Callable[[list[Linear], float], list[np.ndarray]], rounds: int = 3, confident: float = 2.0) -> QualityModel:
    """views: of the labelled rows; fold: of each, from 0 to FOLDS - 1; gather: two models and the bound to the sums that
    they tell each other, by the view that learns."""
    told: list[np.ndarray | None] = [None, None]
    history = []
    fit = lambda rows, r: [discriminant(x[rows], y[rows], t, r / max(1, rounds)) for x, t in zip(views, told, strict=True)]
    every = np.ones(len(y), bool)
    for r in range(rounds):
        told = list(gather(fit(every, r), confident))
        history.append(np.array([t[:, 0] for t in told]))
    models = fit(every, rounds)
    own = np.zeros((len(y), 2))
    for k in range(FOLDS):
        rest = fold != k
        left = fit(rest, rounds) if 0 < y[rest].sum() < rest.sum() else models
        own[~rest] = np.column_stack([v.odds(x[~rest]) for v, x in zip(left, views, strict=True)])
    calibrated = [_fitted(own[:, [v]], y) for v in (0, 1)]
    both = np.column_stack([c.odds(own[:, [v]]) for v, c in enumerate(calibrated)])
    return QualityModel(models, calibrated, _fitted(both, y), history)


def sums(views: tuple[np.ndarray, np.ndarray], models: list[Linear], confident: float) -> list[np.ndarray]:
    """For each view what the other one teaches it of these rows: by class, the number of rows and the sums of their features."""
    out = []
    for v in (0, 1):
        odds = models[1 - v].odds(views[1 - v])
        out.append(np.array([[(m := s * odds > confident).sum(), *views[v][m].sum(axis=0)] for s in (-1, 1)]))
    return out


def _grid(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _taught(models: list[Linear], confident: float):
    """Features (x, m) to a row (at, total) for each cell of sums(), one set for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (1 + TEXT_WIDTH) + 2 * (1 + META_WIDTH))
        for batch in batches:
            views = _grid(batch.column(0), TEXT_WIDTH), _grid(batch.column(1), META_WIDTH)
            total += np.concatenate([s.ravel() for s in sums(views, models, confident)])
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "total"])

    return run


def _viewed(names: list[str], kept: list[str], x: str, m: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, langs, sources = (part.column(names.index(c)).to_pylist() for c in ("text", "lang", "source"))
                a = [text_view(t or "") for t in texts]
                b = [meta_view(t or "", lang, source) for t, lang, source in zip(texts, langs, sources, strict=True)]
                yield pa.record_batch([*(part.column(names.index(c)) for c in kept), *(pa.array(f, pa.list_(pa.float32())) for f in (a, b))], [*kept, x, m])

    return run


@dataclass
class Viewed:
    """Documents with the features of both views in two more columns, written once."""

    rows: DataFrame
    x: str
    m: str


def view(docs: DataFrame, kept: list[str] | None = None) -> Viewed:
    """docs (doc_id, text, lang, source, ...): `kept` of its columns (all, if None) with their features."""
    kept = docs.columns if kept is None else kept
    x, m = unused("_x", docs.columns), unused("_m", docs.columns)
    numbers = T.ArrayType(T.FloatType())
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(x, numbers), T.StructField(m, numbers)])
    return Viewed(written(docs.mapInArrow(_viewed(docs.columns, kept, x, m), schema), "features"), x, m)


def train(docs: Viewed, labels: DataFrame, sample: int = 20_000, rounds: int = 3, confident: float = 2.0) -> QualityModel | None:
    """None without labels of both kinds. Null labels and ids are left out; of several labels of one id the smallest holds.
    Rows of docs that repeat an id count each. sample: at most so many labelled ids are fitted on."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.least(F.min("quality"), F.lit(1)).cast("int").alias("y"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("id"), "y", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold"))
    features = docs.rows.select(F.col("doc_id").alias("id"), F.col(docs.x).alias("x"), F.col(docs.m).alias("m"))
    got = features.join(F.broadcast(first), "id").select("x", "m", "y", "fold").toArrow().combine_chunks()  # at most `sample` ids
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    grids = tuple(_grid(got.column(c).combine_chunks(), w) for c, w in (("x", TEXT_WIDTH), ("m", META_WIDTH)))
    free = written(features.join(known.select(F.col("doc_id").alias("id")), "id", "left_anti").select("x", "m"), "free")

    def gather(models: list[Linear], bound: float) -> list[np.ndarray]:
        cells = free.mapInArrow(_taught(models, bound), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros(2 * (1 + TEXT_WIDTH) + 2 * (1 + META_WIDTH))
        total[cells.column("at").to_numpy()] = cells.column("total").to_numpy()
        cut = 2 * (1 + TEXT_WIDTH)
        return [total[:cut].reshape(2, -1), total[cut:].reshape(2, -1)]

    model = cotrain(grids, y, got.column("fold").to_numpy(), gather, rounds, confident)
    forget(free)
    return model


def score(docs: Viewed, model: QualityModel | None, as_: str = "quality_score") -> DataFrame:
    """The viewed documents, without their features, with the probability of label 1.

    Null texts, languages and sources count as empty, an empty text has no words; equal rows score equally. Without a
    model (no labels to learn from) every score is 1. A column already called so is replaced; an empty table gives no rows.
    """
    kept = [F.col(f"`{c}`") for c in docs.rows.columns if c.lower() not in (docs.x, docs.m, as_.lower())]
    told = F.lit(1.0) if model is None else model.column(F.col(docs.x), F.col(docs.m))
    return docs.rows.select(*kept, told.alias(as_))


def op9_quality_cotraining(spark, sf_dir: str) -> DataFrame:
    """doc_id, score, keep (score of 0.5 or more) for every document."""
    docs = view(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), "score")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).alias("keep"))
