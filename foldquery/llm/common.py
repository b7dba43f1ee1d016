"""What several operators share: reading tables, cutting lineage, hashing words, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's, else the context's checkpoint folder, else on a cluster the
    warehouse. A folder of this machine only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    return _own_dir() if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="foldquery-")


@contextmanager
def _frugal(spark: SparkSession) -> Iterator[None]:
    """Queries run here delete their shuffle files when they end, and not when the driver happens to collect garbage; and
    texts go to Python in batches of some megabytes."""
    with_ = {_CLEANUP: "true", _BATCH: _ROWS}
    before = {k: spark.conf.get(k, None) for k in with_}
    try:
        for k, v in with_.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, what: str = "step") -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here and lost executors cost nothing.

    forget() deletes the table when its successor is written; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldquery-{what}-{uuid.uuid4().hex}"
    with _frugal(spark):
        df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes the tables of written(); frames that read them can no longer be run."""
    for df in frames:
        if (path := getattr(df, "written_at", None) if df is not None else None) and (spark := _written.pop(path, None)):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def forget_written() -> None:
    """Deletes all tables of written() that are left."""
    while _written:
        path, spark = _written.popitem()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended
            return


def unused(name: str, columns: list[str]) -> str:
    """name, lengthened until no column has it, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column | str) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- words and shingles as 64-bit numbers -------------------------------------------------

ODD, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased: bytes know no other letters and no other white space than ASCII's."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


class WordHash:
    """64-bit numbers of words, the same in every process. Remembers up to `room` of them and one text's, so memory is bounded."""

    def __init__(self, room: int = 400_000):
        import xxhash

        self._of, self._room, self._hash = {}, room, xxhash.xxh3_64_intdigest

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        known, digest = self._of, self._hash
        if len(known) > self._room:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """One number for each run of k words, in order; with fewer words one for them all; none without words."""
    if not len(tokens):
        return tokens
    n = max(1, len(tokens) - k + 1)
    k = min(k, len(tokens))
    h = tokens[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            h *= ODD
            h += tokens[i : i + n]
        return mixed(h + np.uint64(k))


def shingle_set(text: str | None, k: int, hasher: WordHash) -> np.ndarray:
    """The distinct shingles of a text (A-Z lower-cased), ascending."""
    return np.unique(shingle_hashes(hasher(words(text)), k)) if text else np.empty(0, np.uint64)


# ---- connected components -----------------------------------------------------------------


def _flat(hooks: DataFrame) -> DataFrame:
    """hooks (id, up), up < id: a forest. Each id with its root, by pointer jumping."""
    while True:
        hooks = written(hooks, "hooks")
        further = hooks.alias("a").join(hooks.alias("b"), F.col("a.up") == F.col("b.id"), "left")
        step = further.select("a.id", F.coalesce("b.up", "a.up").alias("up"), F.col("b.id").isNotNull().alias("moved"))
        step = written(step, "jump")
        forget(hooks)
        hooks = step.select("id", "up")
        hooks.written_at = step.written_at
        if step.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of the edges (src, dst): root is the smallest id of its component. Ids of any ordered type.

    Each round hooks every root that has a smaller neighbour to the smallest of them, flattens the forest and maps the
    edges to the roots. Minima are combined before each shuffle and hub vertices meet only one row of the other side in
    a join, which adaptive execution splits; nothing reaches the driver but whether rows remain. Tables of earlier rounds
    are deleted as soon as the next ones are written.
    """
    lower, upper = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    left = written(edges.where(F.col("src") != F.col("dst")).select(lower, upper).distinct(), "edges")
    roots = None
    while not left.isEmpty():
        hooks = _flat(left.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("up")))
        ends = left.select(F.col("hi").alias("id")).union(left.select(F.col("lo").alias("id"))).distinct() if roots is None else None
        before = ends.select("id", F.col("id").alias("root")) if roots is None else roots
        h = hooks.select(F.col("id").alias("root"), "up")
        old, roots = roots, written(before.join(h, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "roots")
        up = lambda c: F.coalesce(f"{c}_up", c)
        moved = left
        for c in ("lo", "hi"):
            moved = moved.join(hooks.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up")), c, "left")
        moved = moved.select(up("lo").alias("a"), up("hi").alias("b")).where("a <> b")
        before, left = left, written(moved.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
        forget(old, hooks, before)
    if roots is None:
        none = left.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        none.written_at = left.written_at
        return none
    forget(left)
    return roots
