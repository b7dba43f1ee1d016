"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The model file is a parameter and is read on the driver; workers get three integer arrays and the scores, as large as
the vocabulary and no larger. White space is marked with U+2581, and a marker is put before a non-empty text. No piece
holds a marker after another character, so the best path of a text is the best paths of its marked words one after the
other: each word is solved once and remembered in a bounded table. Characters without a piece cost the lowest score less
10 and are written as byte pieces.

Log scores: a unigram file's own. A file of the merge-order kind has ranks for scores; there the log score of the piece of
rank r is -ln(1 + r), a Zipf law, ranks being counted over the pieces by falling score, then id. A piece that the user
defined scores more than any way around it. Of the file's normaliser the marker before the text and the removal of extra
spaces are followed; a file with a character map is refused.

Every text's ids are decoded again where they are made, and `exact` tells whether that gives the text.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldquery.llm.common import table, unused

#: Public vocabulary files of this machine; pass another path on another one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM = 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0], at + n
        yield tag >> 3, kind, value


def read_rules(model: bytes) -> tuple[bool, bool]:
    """(a marker goes before the text, extra spaces go), by the file's normaliser."""
    found = next((dict((n, v) for n, _, v in fields(value)) for number, _, value in fields(model) if number == 3), {})
    if found.get(2):
        raise ValueError(f"the normaliser {found.get(1, b'').decode()} has a character map; only plain ones are known")
    return bool(found.get(3, 1)), bool(found.get(4, 1))


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) by id."""
    pieces, kind = [], UNIGRAM
    for number, _, value in fields(model):
        if number == 1:
            f = {n: v for n, _, v in fields(value)}
            pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
        elif number == 2:
            kind = {n: v for n, _, v in fields(value)}.get(3, UNIGRAM)
    if kind != UNIGRAM:
        order = sorted((i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)), key=lambda i: (-pieces[i][1], i))
        for rank, i in enumerate(order):
            pieces[i] = (pieces[i][0], -math.log(1 + rank), pieces[i][2])
    most = max((score for _, score, k in pieces if k == NORMAL), default=0.0)
    return [(p, len(p) * most - 0.1, k) if k == USER else (p, score, k) for p, score, k in pieces]


class DoubleArray:
    """A trie over bytes: the child of node s by byte c is t = base[s] + c if check[t] == s; value[t] is an id or -1."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key in keys:
            node = tree
            for c in key:
                node = node.setdefault(c, {})
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = -2  # the root is nobody's child
        free, queue = 1, [(0, tree, b"")]
        for s, node, prefix in queue:
            if not node:
                continue
            codes = sorted(node)
            while check[free] != -1:
                free += 1
                if free >= size - 257:
                    break
            b, tries = max(1, free - codes[0]), 0
            while True:
                while b + 256 >= size:
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                    size *= 2
                if all(check[b + c] == -1 for c in codes):
                    break
                b, tries = b + 1, tries + 1
            if tries > 64:  # the region is crowded: search on from here
                free = max(free, b - 32)
            base[s] = b
            for c in codes:
                t, key = b + c, prefix + bytes((c,))
                check[t], value[t] = s, keys.get(key, -1)
                queue.append((t, node[c], key))
        base, check, value = (x + [f] * 256 for x, f in ((base, 0), (check, -1), (value, -1)))  # no child lies past the end
        self.base, self.check, self.value = (np.array(x, dtype=np.int32) for x in (base, check, value))


@dataclass
class Model:
    """What workers need; its size is that of the vocabulary."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    surface: list[bytes]
    byte_ids: list[int]
    unknown: int
    whole: bool  # a piece holds a marker after another character: words can't be solved apart
    prefix: bool = True  # a marker goes before the text
    squeeze: bool = False  # of several spaces one stays, none at either end

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces = read_pieces(data)
        keys = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        trie = DoubleArray(keys)
        byte_ids = [-1] * 256
        surface = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(p[3:5], 16)] = i
                surface.append(bytes((int(p[3:5], 16),)))
            else:
                surface.append(p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"")
        whole = any(MARK in p.lstrip(MARK) or "\n" in p for p, _, kind in pieces if kind in (NORMAL, USER))
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        return cls(trie.base, trie.check, trie.value, np.array([p[1] for p in pieces]), surface, byte_ids, unknown, whole, *read_rules(data))


#: Longer words are solved without being remembered.
LONG = 64


class _Words(dict):
    """Words to their ids as bytes of int32; solves what it doesn't have, and starts anew when it has `room`."""

    def __init__(self, encoder: Encoder, room: int):
        super().__init__()
        self.encoder, self.room = encoder, room

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.best(word.replace(" ", MARK))
        out = struct.pack(f"={len(ids)}i", *ids)
        if len(word) <= LONG:
            if len(self) >= self.room:
                self.clear()
            self[word] = out
        return out


class Encoder:
    _WORD = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, model: Model, room: int = 600_000):
        self.m, self.words = model, _Words(self, room)
        self.base, self.check, self.value, self.scores = (x.tolist() for x in (model.base, model.check, model.value, model.scores))
        normal = [s for s, b in zip(self.scores, model.surface, strict=True) if b]
        self.unk = min(normal, default=0.0) - 10
        self.longest = max((len(x) + 2 * x.count(b" ") for x in model.surface), default=1)  # a marker takes three bytes

    def best(self, text: str) -> list[int]:
        """Viterbi over one string; of equal paths the first found stays, as in a left-to-right scan by length."""
        data = text.encode()
        n, base, check, value, scores = len(data), self.base, self.check, self.value, self.scores
        low, longest = float("-inf"), self.longest
        best, back, by = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            first = data[at]
            step = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            here, node, alone = best[at], 0, False
            to = at
            for c in data[at : at + longest]:
                t = base[node] + c
                if check[t] != node:
                    break
                node = t
                to += 1
                if (piece := value[t]) >= 0:
                    if to == at + step:
                        alone = True
                    if (s := here + scores[piece]) > best[to]:
                        best[to], back[to], by[to] = s, at, piece
            if not alone and (s := here + self.unk) > best[at + step]:
                best[at + step], back[at + step], by[at + step] = s, at, -1
            at += step
        out: list[int] = []
        at = n
        while at:
            start = back[at]
            if by[at] >= 0:
                out.append(by[at])
            else:
                out += [self.m.byte_ids[c] if self.m.byte_ids[c] >= 0 else self.m.unknown for c in reversed(data[start:at])]
            at = start
        return out[::-1]

    def normal(self, text: str) -> str:
        """The text as it is encoded, but for the markers."""
        text = text.replace(MARK, " ")
        return " ".join(w for w in text.split(" ") if w) if self.m.squeeze else text

    def blob(self, text: str) -> bytes:
        """The ids of a normal text as bytes of int32."""
        if not text:
            return b""
        text = " " + text if self.m.prefix else text
        if self.m.whole:
            return np.array(self.best(text.replace(" ", MARK)), dtype=np.int32).tobytes()
        return b"".join(map(self.words.__getitem__, self._WORD.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.blob(self.normal(text)), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.m.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def _worker(shared, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(names.index(text_col)).to_pylist()]
                done = [encoder.blob(encoder.normal(t)) for t in texts]
                flat = np.frombuffer(b"".join(done), dtype=np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in done)], dtype=np.int32)
                every = flat.tolist()
                same = [encoder.decode(every[a:b]) == t for a, b, t in zip(ends.tolist(), ends[1:].tolist(), texts, strict=False)]
                cols = [part.column(i) for i, n in enumerate(names) if n != text_col]
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.record_batch([*cols, out, pa.array(same)], [*(n for n in names if n != text_col), "ids", "exact"])

    return run


_models: dict[str, Model] = {}


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """docs with `ids` (array of int) and `exact` (the ids decode to the text) in place of the text.

    A null or empty text has no ids and is exact. exact is false where a text holds U+2581 itself, which decoding
    turns into a space, or where the model's normaliser removes spaces. Equal texts have equal ids; repeated rows all stay. Columns already called ids or exact are replaced; an empty table gives no rows.
    """
    docs = docs.drop("ids", "exact")
    if model not in _models:
        _models[model] = Model.read(model)
    shared = docs.sparkSession.sparkContext.broadcast(_models[model])
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return docs.mapInArrow(_worker(shared, docs.columns, text_col), schema)


def decode(tokens: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """tokens with a column `text`, decoded from the ids; null ids decode to the empty text."""
    if model not in _models:
        _models[model] = Model.read(model)
    shared = tokens.sparkSession.sparkContext.broadcast(_models[model])

    out = unused("text", [c for c in tokens.columns if c != "text"])
    tokens = tokens.drop(out)
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [encoder.decode(x) if x is not None else "" for x in part.column(names.index(ids_col)).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], [*names, out])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())]))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the whole text, their number, and whether they decode to the text."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "exact")
