"""Benchmark decontamination by template windows.

Numbers, names and units of measure become typed placeholders. A capitalised word inside a sentence is a name; one that
begins a sentence may be, so every text is read twice: it is a word in the first reading, a name in the second. Windows
of five template words that hold two literal ones are keys in either reading; windows of little but placeholders are keys
by their very words, so a row of numbers or names is found where it is copied.

1. The benchmark's keys make a table (key, item).
2. Every window of every text is looked up in a bit table of that table, whose size is a parameter; the texts' keys that
   may be there are joined with it by hash. Only counts of common keys by text and item go on.
3. Pairs of text and item with enough of them are verified word by word: hits that run side by side in both must cover 80 %
   of the item, and the placeholders' fillings must agree: of the fillings that come more than once, 80 % stand for one
   and the same on the other side. Each run of hits that covers enough is tried. An item under five words counts only where
   it is a whole sentence or line, word for word.

Equal texts are looked up once for each copy but verified by their digest's rows; nothing of the corpus reaches the driver,
and of the benchmark only the bit table does.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldquery.llm.common import ODD, forget, mixed, table, unused, written

WINDOW, COVER, AGREE = 5, 0.8, 0.8
_CORE = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?$")
_JOINED = re.compile(r"([+-]?\d[\d.,]*)([a-z%°]+)$")
# Words for numbers, and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNIT_WORDS = frozenset("m cm mm km kilometer kilometers kilometre kilometres meter meters metre metres mile miles foot feet inch inches yard yards g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent kmh mph degree degrees celsius fahrenheit joule joules watt watts volt volts % °".split())
_SPECIAL = NUMBER_WORDS | UNIT_WORDS
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_PLAIN = np.uint64(0x5555555555555555)  # keeps keys of very words apart from those of templates
_SLOT = {NUMBER: "\x00number", NAME: "\x00name", UNIT: "\x00unit"}


_MARKS = ".,;:!?\"'()[]{}<>-*_/"


def bare(word: str) -> str:
    """The word without what stands around its letters and digits; the word itself if it has none."""
    inner = word if word.isalnum() else word.strip(_MARKS)
    if not inner.isalnum():
        inner = _CORE.sub("", word)
    return inner or word


def _kind(word: str) -> tuple[str, int, bool, bool]:
    """(literal form or slot marker, kind, capitalised, ends a sentence)."""
    inner = bare(word)
    low = inner.lower()
    end = not word[-1].isalnum() and word.rstrip("\"')]}»”").endswith((".", "!", "?", ":"))
    if not low[0].isalpha() and _NUMBER.match(low) or low in NUMBER_WORDS:
        return _SLOT[NUMBER], NUMBER, False, end
    if low in UNIT_WORDS or not low[0].isalpha() and (m := _JOINED.match(low)) and m[2] in UNIT_WORDS:
        return _SLOT[UNIT], UNIT, False, end
    return low, LITERAL, inner[0].isupper(), end


def _windows_at(h: np.ndarray, at: np.ndarray | slice, n: int, k: int) -> np.ndarray:
    """Numbers of the windows of k words at the given places of n."""
    whole = isinstance(at, slice)
    out = h[:n].copy() if whole else h[at]
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out *= ODD
            out += h[j : j + n] if whole else h[at + j]
        return mixed(out + np.uint64(k))


@dataclass
class Reading:
    """The words of one or several texts, their numbers in three readings, their kinds in the first two, and their texts."""

    words: list[str]
    first: np.ndarray
    second: np.ndarray
    plain: np.ndarray
    kinds: np.ndarray
    names: np.ndarray
    text: np.ndarray

    def keys(self, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, keys) of the windows of k words inside one text, for each reading."""
        n = len(self.words) - k + 1
        if n < 1:
            return []
        inside = self.text[k - 1 :] == self.text[:n]
        if k < WINDOW:
            at = np.flatnonzero(inside)
            return [(at, _windows_at(self.plain, at, n, k) ^ _PLAIN)]
        count = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int32)]))[k:] - c[:-k]
        literal = count(self.names == LITERAL)
        ones = np.flatnonzero(inside & (count(self.kinds == LITERAL) >= 2))
        twos = np.flatnonzero(inside & (literal >= 2) & (count(self.first != self.second) > 0))
        bare = np.flatnonzero(inside & (literal < 2))
        out = [(ones, _windows_at(self.first, slice(None), n, k)[ones]), (twos, _windows_at(self.second, twos, n, k))]
        return [*out, (bare, _windows_at(self.plain, bare, n, k) ^ _PLAIN)] if len(bare) else out


class Templates:
    """Texts to readings. Remembers a bounded number of words."""

    def __init__(self, room: int = 400_000):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.room, self.name = room, np.uint64(self.digest(_SLOT[NAME].encode()))
        self._start()

    def _start(self) -> None:
        self.at: dict[str, int] = {}
        self.hashes, self.plain, self.flags = array("Q"), array("Q"), array("B")

    def _add(self, word: str) -> None:
        self.at[word] = len(self.at)
        if word.isalpha() and (low := word.lower()) not in _SPECIAL:  # most words, at once
            form, kind, capital, end = low, LITERAL, word[0].isupper(), False
        else:
            form, kind, capital, end = _kind(word)
        h = self.digest(form.encode("utf-8", "surrogatepass"))
        self.hashes.append(h)
        self.plain.append(h if kind == LITERAL else self.digest(core(word).encode("utf-8", "surrogatepass")))
        self.flags.append(kind | capital << 2 | end << 3)

    def __call__(self, *texts: str) -> Reading:
        parts = [t.split() for t in texts]
        words = parts[0] if len(parts) == 1 else [w for p in parts for w in p]
        if len(self.at) + 1 >= self.room:
            self._start()
        found: list[list[np.ndarray]] = [[np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint8)]]
        for a in range(0, len(words), 100_000):
            part = words[a : a + 100_000]
            if len(self.at) + len(part) >= self.room:
                self._start()
            for w in set(part).difference(self.at):
                self._add(w)
            idx = np.fromiter(map(self.at.__getitem__, part), np.int64, len(part))
            found.append([np.frombuffer(x, t)[idx] for x, t in ((self.hashes, np.uint64), (self.plain, np.uint64), (self.flags, np.uint8))])
        h, plain, f = (np.concatenate(x) if len(found) > 2 else x[-1] for x in zip(*found, strict=True))
        text = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        kinds = f & 3
        starts = np.ones(len(f), bool)
        starts[1:] = ((f[:-1] & 8) > 0) | (text[1:] != text[:-1])
        capital = ((f & 4) > 0) & (kinds == LITERAL)
        second = np.where(capital, self.name, h)
        named = capital & ~starts
        return Reading(words, np.where(named, self.name, h), second, plain, np.where(named, NAME, kinds), np.where(capital, NAME, kinds), text)


def core(word: str) -> str:
    return bare(word).lower()


def _sentences(text: str) -> list[tuple[str, ...]]:
    """The sentences of each line, as words without marks."""
    out: list[tuple[str, ...]] = []
    for line in text.splitlines():
        now: list[str] = []
        for word in line.split():
            now.append(core(word))
            if _kind(word)[3]:
                out.append(tuple(now))
                now = []
        if now:
            out.append(tuple(now))
    return out


def compare(text: Reading, item: Reading) -> tuple[float, bool] | None:
    """(share of the item's words that the text covers, fillings differ) of the best run of hits that holds; None without."""
    n, k = len(item.words), WINDOW
    where: dict[int, set[int]] = defaultdict(set)
    for at, keys in item.keys(k):
        for i, w in zip(at.tolist(), keys.tolist(), strict=True):
            where[w].add(i)
    wanted = np.fromiter(where, np.uint64, len(where))
    hits: set[tuple[int, int, int]] = set()
    for at, keys in text.keys(k):
        for x in np.flatnonzero(np.isin(keys, wanted)).tolist():
            j = int(at[x])
            hits |= {(j - i, i, j) for i in where[int(keys[x])]}
    found = sorted(hits)
    slack, a = n // 8 + 2, 0
    best: tuple[float, bool] | None = None
    for b in range(len(found)):
        while found[b][0] - found[a][0] > slack:
            a += 1
        if (b - a + 1) * k < COVER * n or b + 1 < len(found) and found[b + 1][0] - found[a][0] <= slack:
            continue
        run = found[a : b + 1]
        covered = np.zeros(n, bool)
        for _, i, _ in run:
            covered[i : i + k] = True
        share = float(covered.mean())
        if share >= COVER and (best is None or share > best[0]) and (agreed := _fillings(text, item, run)) is not None:
            best = share, agreed
    return best


def _fillings(text: Reading, item: Reading, run: list[tuple[int, int, int]]) -> bool | None:
    """Do the fillings of the run's placeholders differ from the item's? None if they contradict each other."""
    fill: dict[tuple[int, str], dict[int, str]] = defaultdict(dict)
    back: dict[tuple[int, str], dict[int, str]] = defaultdict(dict)
    differ = False
    for _, i, j in run:
        for x in range(WINDOW):
            if (kind := int(item.names[i + x])) != LITERAL:
                p, q = bare(item.words[i + x]), bare(text.words[j + x])
                fill[kind, p][i + x] = q
                back[kind, q][j + x] = p
                differ |= p != q
    again = [len(set(s.values())) == 1 for s in [*fill.values(), *back.values()] if len(s) > 1]  # fillings used more than once
    return None if again and sum(again) < AGREE * len(again) else differ


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (item, text) to (w, item, k, n, times): keys, the words of a window and of the item, how often the key comes in it."""
    read = Templates()
    for batch in batches:
        items, texts = (c.to_pylist() for c in batch.columns)
        rows = []
        for item, text in zip(items, texts, strict=True):
            r = read(text)
            n = len(r.words)
            k = min(WINDOW, n)
            if n:
                rows += [(w, item, k, n, c) for w, c in Counter(w for _, keys in r.keys(k) for w in keys.view(np.int64).tolist()).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["w", "item", "k", "n", "times"])


def _slot(w: np.ndarray, bits: int) -> np.ndarray:
    return w & np.uint64((1 << bits) - 1)


def _looked_up(shared, widths: list[int], bits: int):
    """Texts (k1, k2, text) to (k1, k2, w): the distinct keys of a text that may be the benchmark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, read = np.frombuffer(shared.value, np.uint8), Templates()
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                r = read(*part.column(2).to_pylist())
                rows, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for k in widths:
                    for where, keys in r.keys(k):
                        s = _slot(keys, bits)
                        hit = np.flatnonzero((there[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1)
                        rows.append(r.text[where[hit]].astype(np.int64))
                        found.append(keys[hit])
                owner, w = np.concatenate(rows), np.concatenate(found)
                order = np.lexsort((w, owner))
                owner, w = owner[order], w[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (owner[1:] != owner[:-1])
                owner = pa.array(owner[new])
                yield pa.record_batch([part.column(0).take(owner), part.column(1).take(owner), pa.array(w[new].view(np.int64))], ["k1", "k2", "w"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (k1, k2, text, item_id, item_text) to (k1, k2, item_id, cover, refilled) of those that hold."""
    read = Templates()
    last: tuple[str, Reading | None] = ("", None)
    for batch in batches:
        keep, cover, differ = [], [], []
        for row, (text, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            wanted = read(item)
            if len(wanted.words) < WINDOW:
                got = (1.0, False) if tuple(map(core, wanted.words)) in _sentences(text) else None
            else:
                if last[1] is None or last[0] != text:
                    last = text, read(text)
                got = compare(last[1], wanted)
            if got:
                keep.append(row)
                cover.append(got[0])
                differ.append(got[1])
        at = pa.array(keep, pa.int64())
        yield pa.record_batch([*(batch.column(i).take(at) for i in (0, 1, 3)), pa.array(cover, pa.float64()), pa.array(differ, pa.bool_())], ["k1", "k2", "item_id", "cover", "refilled"])


def _bit_table(windows: DataFrame, bits: int) -> bytes:
    """One bit for each key modulo 2 ** bits. At most 2 ** (bits - 6) rows come to the driver, whatever the benchmark's size."""
    slot = f"(w & {(1 << bits) - 1}L)"
    words = windows.groupBy(F.expr(f"shiftright({slot}, 6)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} % 64 as int)))").alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("x").to_numpy()
    return out.tobytes()


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bits: int = 26, as_: str = "found") -> DataFrame:
    """docs with a column `found` (or as_): array of (item_id, cover, refilled) of the benchmark items that the text holds, by id.

    Null or blank texts hold nothing; items without an id or words are left out; items shorter than five words must be a
    whole sentence or line. Equal items and repeated rows are all reported; of runs that cover equally much the first holds.
    With an empty benchmark nothing is found; an empty table gives no rows. Other columns stay, whatever their names, but a
    column called as_ is replaced. bits: of the bit table (8 MB); with fewer more keys are joined, with the same result.
    """
    spark, docs = docs.sparkSession, docs.drop(as_)
    id_type = benchmark.schema["item_id"].dataType
    found_type = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("cover", T.DoubleType()), T.StructField("refilled", T.BooleanType())]))
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_id is not null and item_text is not null").distinct().withColumn("item", F.xxhash64("item_id", "item_text"))
    windows = written(items.select("item", "item_text").mapInArrow(_windows, "w long, item long, k int, n int, times int"), "windows")
    widths = sorted(r.k for r in windows.select("k").distinct().collect())  # 1 to 5
    if not widths:
        forget(windows)
        return docs.withColumn(as_, F.array().cast(found_type))
    shared = spark.sparkContext.broadcast(_bit_table(windows, bits))
    keyed = docs.select(F.xxhash64(text_col).alias("k1"), F.xxhash64(text_col, F.lit(1)).alias("k2"), F.col(text_col).alias("text")).where("text is not null")
    keys = keyed.mapInArrow(_looked_up(shared, widths, bits), "k1 long, k2 long, w long")
    common = keys.join(windows, "w").groupBy("k1", "k2", "item", "k", "n").agg(F.sum("times").alias("hits")).where(F.col("hits") * F.col("k") >= F.col("n") * COVER)
    pairs = written(common.select("k1", "k2", "item"), "candidates")
    texts = keyed.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    both = texts.join(pairs, ["k1", "k2"]).join(items, "item").select("k1", "k2", "text", "item_id", "item_text")
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *found_type.elementType.fields])
    held = written(both.mapInArrow(_verified, schema).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("item_id", "cover", "refilled"))).alias("found")), "found")
    forget(windows, pairs)
    k1, k2, own = unused("_k1", docs.columns), unused("_k2", docs.columns), unused("_found", docs.columns)
    held = held.withColumnsRenamed({"k1": k1, "k2": k2, "found": own})
    out = docs.withColumns({k1: F.xxhash64(text_col), k2: F.xxhash64(text_col, F.lit(1))}).join(held, [k1, k2], "left")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce(own, F.array().cast(found_type)).alias(as_))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows and columns else as they are."""
    own = unused("found", docs.columns)
    return find_items(docs, benchmark, as_=own).where(F.size(own) == 0).drop(own)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, the items' ids, the largest share covered, and the ids of refilled items."""
    out = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = lambda c: F.transform(c, lambda x: x["item_id"])
    return out.select("doc_id", (F.size("found") > 0).alias("contaminated"), ids(F.col("found")).alias("item_ids"), F.array_max(F.transform("found", lambda x: x["cover"])).alias("cover"), ids(F.filter("found", lambda x: x["refilled"])).alias("refilled_ids"))
