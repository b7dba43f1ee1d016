"""N-gram Jaccard join: every link between texts whose shingle sets overlap enough, as components.

Method: token-combination prefixes. A document's tokens are the 64-bit numbers of its distinct word shingles.

1. Documents with equal sets form one class; only its smallest id goes on.
2. Extended prefixes. In the order of the token numbers, two sets that link share at least l(n) tokens among their first
   n - ceil(t n) + l(n) tokens, where l(n) grows with n. Only those are counted over the corpus, so the counts cost a
   third of the tokens and not all. A document goes on if l of its prefix tokens occur elsewhere; most don't.
3. The whole sets of the documents that are left are counted. In the order of these counts, sets that link share k tokens
   among all but their last ceil(t n) - k. Tokens that one document alone has link nothing, however many come first.
4. Token classes, by these counts: a rare token (count up to `frequent`) is a key by itself; from a frequent one (up to its
   square) every pair with a later token of the prefix is a key, from a very frequent one every triple; the prefix is
   extended by one token for each further one of a key. Sets too small for a class, or with more than `room`
   combinations, use its single tokens; the others carry these as well, to meet only such sets.
5. Position. In the bucket of the first token that two sets share they share no token before it, so at most the smaller
   number of shared tokens from there on. Near copies with many changes of their own never meet in the buckets of what all
   copies have in common, but only in those of rarer tokens.
6. Buckets of equal keys are not expanded into pairs. In each round a bucket's largest component sends one leader (first
   the one with the fewest tokens below the key's class, which is nearest to what its copies have in common) to the members
   outside of it; links found join components; buckets of one component are done. After the rounds, every untried pair
   between different components of an open bucket that size and position allow is verified, so no link is lost.
7. Verification intersects the two whole sets.

Steps 2 to 6 lose nothing whatever the counts or classes of tokens are; these only decide the cost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldquery.llm.common import ODD, WordHash, components, forget, mixed, shingle_set, written


def least_overlap(n: int, num: int, den: int) -> int:
    """ceil(n * num / den): what a set of n shares at least with any set that links with it."""
    return -(-n * num // den)


def _extra(n, share: int):
    """l(n): a share in percent of n, at least 1; never falls as n grows."""
    return np.maximum(1, n * share // 100)


def _scanner(ngram: int, num: int, den: int, share: int, whole: bool):
    """Rows (id, text) to (id, n, d1, d2, tokens): the set's size, its digest, and its tokens or its extended prefix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [shingle_set(t, ngram, hasher) for t in part.column(1).to_pylist()]
                sizes = [len(s) for s in out]
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in out), dtype=np.int64)
                keep = sizes if whole else [min(n, n - least_overlap(n, num, den) + int(_extra(n, share))) for n in sizes]
                blobs = [s[:p].tobytes() for s, p in zip(out, keep, strict=True)]
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int32()), pa.array(d[0::2]), pa.array(d[1::2]), pa.array(blobs, pa.binary())], ["id", "n", "d1", "d2", "tokens"])

    return scan


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) to a row (tok, id) for each token."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            blobs = part.column(1).to_pylist()
            owner = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
            tok = np.frombuffer(b"".join(blobs), dtype=np.int64)
            yield pa.record_batch([pa.array(tok), part.column(0).take(pa.array(owner))], ["tok", "id"])


def _linker(num: int, den: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            good = []
            for i in range(batch.num_rows):
                p, q = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both > 0 and den * both >= num * (len(p) + len(q) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.record_batch([a.filter(mask), b.filter(mask)], ["src", "dst"])

    return link


def _counted(sets: DataFrame, kind: str) -> DataFrame:
    """(id, tokens) to (id, tok, c) of the tokens that c > 1 of the rows hold."""
    toks = sets.select("id", "tokens").mapInArrow(_exploded, f"tok long, id {kind}")
    return toks.join(toks.groupBy("tok").agg(F.count(F.lit(1)).cast("int").alias("c")).where("c > 1"), "tok")


def classes_of(counts: np.ndarray, frequent: int) -> tuple[int, int]:
    """Where the frequent and the very frequent tokens of an ascending row of counts begin."""
    return int(np.searchsorted(counts, frequent, "right")), int(np.searchsorted(counts, frequent * frequent, "right"))


def combinations(counts: np.ndarray, n: int, num: int, den: int, frequent: int, room: int) -> list[tuple[tuple[int, ...], int, bool]]:
    """The keys of a set of n whose shared tokens have these ascending counts: (places of its tokens, class, lone).

    The first token that two linked sets share stands among the first s - m + 1 of either, the k-th among s - m + k (s shared
    tokens, m = least_overlap). A rare first token is a key alone; from a frequent one pairs go out, from a very frequent one
    triples. A class whose combinations would be more than `room`, or that m doesn't fill, is lone: its single tokens are
    keys. Sets that aren't lone have these too, to meet the lone ones only.
    """
    s, m = len(counts), least_overlap(n, num, den)
    if s < m or not s:
        return []
    edges = (0, *classes_of(counts, frequent), s)
    out = []
    for k in (1, 2, 3):
        first, last = edges[k - 1], min(edges[k], s - m + 1)
        if first >= last:
            continue
        if k == 1:
            out += [((i,), 0, True) for i in range(first, last)]
            continue
        ends = s - m + k
        lone = m < k or sum(comb(ends - i - 1, k - 1) for i in range(first, last)) > room
        out += [((i,), 1, lone) for i in range(first, last)]
        if not lone:
            out += [((i, *rest), k, True) for i in range(first, last) for rest in itertools.combinations(range(i + 1, ends), k - 1)]
    return out


def _keyed(num: int, den: int, frequent: int, room: int):
    """(id, n, tokens with their counts, ascending) to bucket rows (key, lone, id, n, rest, own).

    rest: how many of the set's shared tokens stand at the key's first one or later. In the bucket of the first token that
    two sets share they can't share more than the smaller rest. own: how many tokens are below the first one's class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                key, lone, owner, rest, alone = [], [], [], [], []
                for row, (n, toks, counts) in enumerate(zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                    t = np.array(toks, dtype=np.int64).view(np.uint64)
                    found = combinations(c := np.array(counts), n, num, den, frequent, room)
                    edges = np.array([0, *classes_of(c, frequent)])
                    for size in (1, 2, 3):
                        own = [f for f in found if len(f[0]) == size]
                        if own:
                            places = np.array([f[0] for f in own])
                            h = np.array([f[1] for f in own], dtype=np.uint64)
                            with np.errstate(over="ignore"):
                                for j in range(size):
                                    h = mixed(h * ODD + t[places[:, j]])
                            key.append(h)
                            lone += [f[2] for f in own]
                            owner += [row] * len(own)
                            rest.append(len(t) - places[:, 0])
                            alone.append(n - len(t) + edges[np.searchsorted(edges, places[:, 0], "right") - 1])
                if not key:
                    continue
                owner = pa.array(owner)
                columns = [pa.array(np.concatenate(key).view(np.int64)), pa.array(lone), part.column(0).take(owner), part.column(1).take(owner), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (rest, alone))]
                yield pa.record_batch(columns, ["key", "lone", "id", "n", "rest", "own"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, num: int = 80, den: int = 100, share: int = 10, frequent: int = 32, room: int = 220, rounds: int = 3, tell=None) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (smallest id reachable by links with 100 * both >= t * union).

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer than `ngram` words is
    one shingle; null or blank texts have none and link with nothing. Ids are of any ordered type. Rows that share an id count
    as one document with several texts. A row whose id is null links with nothing and has a null component. Any other
    columns are ignored; an empty table gives no rows; ties don't arise, as links have no order.
    share: percent of a set by which its prefix is extended; frequent, room, rounds: as in the module's text (cost only).
    tell: called with (round, pairs to verify), for tests.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n int, d1 long, d2 long, tokens binary"
    scanned = written(source.mapInArrow(_scanner(ngram, num, den, share, False), schema), "prefixes")
    nodes = scanned.where("id is not null and n > 0")
    classes = written(nodes.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "n")

    m = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * num / den) * share / 100))
    active = written(_counted(nodes, kind).groupBy("id").agg(F.count(F.lit(1)).alias("s")).join(reps, "id").where(F.col("s") >= m).select("id"), "active")
    sets = source.join(active, "id", "left_semi").mapInArrow(_scanner(ngram, num, den, share, True), schema)
    sets = written(sets.join(reps, ["id", "n"], "left_semi").select("id", "n", "tokens"), "sets")
    forget(active)
    shared = _counted(sets, kind).join(sets.select("id", "n"), "id")
    doc = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("t")).select("id", "n", F.col("t.tok").alias("toks"), F.col("t.c").alias("counts"))
    rows = written(doc.mapInArrow(_keyed(num, den, frequent, room), f"key long, lone boolean, id {kind}, n int, rest int, own int"), "keys")
    alive = rows.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.max("lone").alias("any")).where("g > 1 and any").select("key")
    buckets = written(rows.join(alive, "key"), "buckets")
    forget(rows)

    def links(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        return both.mapInArrow(_linker(num, den), f"src {kind}, dst {kind}")

    near = F.least("a_n", "b_n", "a_rest", "b_rest") * (num + den) >= (F.col("a_n") + F.col("b_n")) * num
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    comp = written(buckets.select("id", F.col("id").alias("root")).distinct(), "roots")
    tried = []
    for r in range(rounds + 1):
        placed = buckets.join(comp, "id")
        first = F.xxhash64("id", F.lit(r)) if r else (F.col("own") * 10_000 / F.col("n")).cast("long")
        groups = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("g"), F.min(F.struct(first.alias("o"), "id", "n", "rest", "lone")).alias("lead"))
        main = groups.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("g", F.bitwise_not("lead.o").alias("o"), "root", "lead")).alias("main")).where("k > 1")
        if r < rounds:
            main = main.select("key", F.col("main.root").alias("top"), F.col("main.lead.id").alias("a"), F.col("main.lead.n").alias("a_n"), F.col("main.lead.rest").alias("a_rest"), F.col("main.lead.lone").alias("a_lone"))
            found = placed.withColumnsRenamed({"id": "b", "n": "b_n", "rest": "b_rest", "lone": "b_lone"}).join(main, "key").where(F.col("root") != F.col("top"))
        else:
            open_ = placed.join(main.select("key", F.col("main.root").alias("top")), "key")
            open_ = written(open_, "open")
            # of all rows in the bucket the one that leaves an outsider the most room: without a chance there, it has none
            most = open_.groupBy("key").agg(F.max("rest").alias("most"), F.min("n").alias("least"))
            chance = F.least("rest", "most", "n") * (num + den) >= (F.col("n") + F.greatest("least", F.ceil(F.col("n") * num / den))) * num
            out = open_.where("root <> top").join(most, "key").where(chance).select("key", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"), F.col("lone").alias("a_lone"), F.col("root").alias("a_root"))
            inn = open_.select("key", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"), F.col("lone").alias("b_lone"), "root", "top")
            found = out.join(inn, "key").where((F.col("a_root") != F.col("root")) & ((F.col("root") == F.col("top")) | (F.col("a") < F.col("b"))))
        pairs = pair(found.where(near & (F.col("a_lone") | F.col("b_lone")) & (F.col("a") != F.col("b"))))
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if r == rounds:
            forget(open_)
        if tell:
            tell(r, pairs.count())
        tried.append(pairs)
        if pairs.isEmpty():
            continue
        linked = written(links(pairs), "links")
        at = lambda c: comp.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        edges = linked.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))
        moved = components(edges)
        old, comp = comp, written(comp.join(moved.select(F.col("id").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root")), "roots")
        forget(old, linked, moved)
    forget(sets, buckets, *tried)

    shared_id = classes.join(comp.withColumnsRenamed({"id": "rep"}), "rep", "left").select("d1", "d2", F.col("n").alias("n_"), F.coalesce("root", "rep").alias("root"))
    out = scanned.select("id", "n", "d1", "d2")
    here = (out.d1 == shared_id.d1) & (out.d2 == shared_id.d2) & (out.n == shared_id.n_) & out.id.isNotNull()
    return out.join(shared_id, here, "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def keep_one(docs: DataFrame, ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id.

    Of rows that repeat a kept doc_id all stay: they are one document. Rows with a null doc_id and rows without words stay.
    """
    gone = jaccard_components(docs, ngram=ngram, num=num, den=den).where("component_id <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard of 0.9 or more, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, ngram=3, num=90, den=100).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({lower}, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
    ELSE list_distinct(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) END AS t FROM w),
tok AS (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM s),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS p, any_value(y.n) AS q, count(*) AS c FROM tok x JOIN tok y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2)
  WHERE 100 * c >= 90 * (p + q - c)),
linked AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk AS (SELECT a AS id, a AS root FROM linked UNION SELECT linked.b, walk.root FROM walk JOIN linked ON linked.a = walk.id),
comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id)
SELECT s.doc_id, CAST(len(t) AS BIGINT) AS n_shingles, coalesce(comp.root, s.doc_id) AS component_id FROM s LEFT JOIN comp ON comp.id = s.doc_id"""


SQL = _sql()
