"""Substring deduplication, decontamination, SentencePiece, licences."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foldquery.llm import decontaminate, licenses, sentencepiece, substring_dedup

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    """The cuts of each row, by looking at every smaller id's units."""
    own = {}
    for i, t in rows:
        if i is not None and t is not None:
            own.setdefault(i, set()).update(u[3] for u in substring_dedup.units(t) if u[2])
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, []))
            continue
        before = {u for j, s in own.items() if i is not None and j < i for u in s}
        spans, run, n, seen = [], None, 0, set()
        for a, b, k, u in [*substring_dedup.units(t), (len(t), len(t), 1, None)]:
            if k and u is not None and (u in before or u in seen) or (not k and run):
                run, n = (run[0] if run else a, b), n + k
            elif k:
                if run and n >= substring_dedup.RUN_WORDS:
                    spans.append(run)
                run, n = None, 0
            seen.add(u)
        kept = "".join(c for p, c in enumerate(t) if not any(a <= p < b for a, b in spans))
        out.append((i, kept, spans))
    return sorted(out, key=str)


def test_substring_dedup(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 14))).capitalize() + rng.choice([".", "!", "?"])
    shared = [" ".join(sentence() for _ in range(9)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(rng.randrange(1, 10))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        rows.append((i, rng.choice([" ", "\n", "\n\n"]).join(parts)))
    rows += [(60, None), (61, ""), (62, " \n\n "), (None, shared[0]), (70, rows[0][1]), (70, rows[0][1]), (71, shared[1].upper())]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "_id": F.lit(1), "_lost": F.lit(3), "removed": F.lit(2), "lang": F.lit(None).cast("string")})
    out = substring_dedup.dedup_units(df)
    assert out.columns == ["doc_id", "text", "id", "_id", "_lost", "lang", "removed"]
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.removed]) for r in out.collect()), key=str)
    assert got == by_hand(rows)
    assert sum(bool(x[2]) for x in got) > 10
    assert substring_dedup.dedup_units(df.limit(0)).count() == 0


def test_short_lines_go(spark):
    own = lambda i: f"here stands a line that only text {i} has, of more words than eight"
    rows = [
        (0, f"Alpha beta gamma.\n{own(0)}\nOne two three four. Five six.\nx y"),
        (1, f"{own(1)}\nalpha beta gamma.\n \n\n{own('1b')}\nOne two three four. Five six.\n{own('1c')}\nX Y"),
        (2, f"{own(2)}. One two three four. And on it goes for long after that."),  # a piece inside a line
        (3, f"One two three four. x y\n{own(3)}"),  # both pieces are known, the line is not
        (4, f"p q\n{own(4)}\np q\n{own('4b')}\nOne two three four.\u00a0Five six."),
    ]
    got = {r.doc_id: r.text for r in substring_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(rows)
    want[1] = f"{own(1)}\n{own('1b')}\n{own('1c')}\n"
    want[4] = f"p q\n{own(4)}\n{own('4b')}\n"
    assert got == want


def test_a_short_line_in_many_documents_stays_once(spark):
    rows = [(f"{i:04}", f"own words of {i} alone\nShare this\nand more of {i} here") for i in range(1000)]
    out = substring_dedup.dedup_units(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.doc_id for r in out if "Share this" in r.text] == ["0000"]
    assert all(r.text.startswith(f"own words of {int(r.doc_id)} alone") for r in out)


def test_units_cover_the_text():
    for text in ("", "one", "A b c d. E f.\n\nG h i j k! L", "x" * 5000 + "\n" * 50, "a. b. c. d. e. f."):
        spans = substring_dedup.units(text)
        assert "".join(text[a:b] for a, b, *_ in spans) == text


QUESTION = "If Mary drives 120 km in 2 hours towards the old harbour, how many km does Mary drive in 5 hours?"
PLAIN = "the quick brown fox jumps over the lazy dog and then it runs away from all the noise"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("x"))
    out = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)))
    return {r.doc_id: [(x.item_id, x.refilled) for x in r.found] for r in out.collect()}


def test_decontamination(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    renamed = QUESTION.replace("Mary", "Peter").replace("120", "90").replace("2 hours", "3 hours").replace("5", "7")
    mixed = QUESTION.replace("Mary", "Peter", 1).replace("does Mary", "does Susan").replace("2 hours", "2 days")
    texts = [
        noise(50) + " " + QUESTION + " " + noise(50), f"{noise(5)}. {renamed} {noise(9)}", mixed, PLAIN, PLAIN.replace("lazy", "sleepy"), " ".join(PLAIN.split()[:9]),
        noise(30_000) + " " + PLAIN.upper().lower() + " " + noise(10), None, "", "short item", noise(200), PLAIN + " " + QUESTION,
    ]
    got = found(spark, texts, [(1, QUESTION), (2, PLAIN), (3, "short item"), (4, None), (5, ""), (None, "nothing of note here at all")])
    assert got == {0: [(1, False)], 1: [(1, True)], 2: [], 3: [(2, False)], 4: [(2, False)] if got[4] else [], 5: [], 6: [(2, False)], 7: [], 8: [], 9: [(3, False)], 10: [], 11: [(1, False), (2, False)]}
    assert found(spark, texts, []) == {i: [] for i in range(len(texts))}


def test_table_size_changes_nothing(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(30))) for i in range(20)]
    docs = spark.createDataFrame([(i, f"start {t} end") for i, t in items], "doc_id long, text string").withColumns({"_k1": F.lit(1), "w": F.lit("x"), "Found": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted((r.doc_id, r["_k1"], str(r.found)) for r in decontaminate.find_items(docs, bench, bits=b).collect()) for b in (26, 8))
    assert one == many and all("item_id" in x[2] for x in one)
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


def test_verbatim_and_short_items(spark):
    """Items of little but placeholders are found word for word, and not otherwise; short ones as whole sentences only."""
    items = [(1, "What comes next: 12, 15, 18, 21, 24, 27, 30, 33"), (2, "the Paris London Berlin Rome Madrid Vienna"), (3, "yes"), (4, "12 km"), (5, "ha " * 60)]
    texts = [f"we asked: {items[0][1]} and then", items[0][1].replace("15", "16").replace("27", "28"), f"so {items[1][1]}", "well yes of course", "He said so.\nYes!\nThen he left", "it took 12 km to go", "Long way. 12 km. Then home", "ha " * 70]
    assert found(spark, texts, items) == {0: [(1, False)], 1: [], 2: [(2, False)], 3: [], 4: [(3, False)], 5: [], 6: [(4, False)], 7: [(5, False)]}


def test_names_at_sentence_starts(spark):
    ask = "{a} has {n} apples. {b} gives her {m} more. How many apples does {a} have?"
    item = ask.format(a="Alice", b="Bob", n=3, m=4)
    texts = [ask.format(a="Carol", b="Dave", n=7, m=2), f"Here it is. {item} Think.", ask.format(a="Carol", b="Dave", n=7, m=2).replace("does Carol", "does Erin")]
    assert found(spark, texts, [(1, item)]) == {0: [(1, True)], 1: [(1, False)], 2: []}


def test_recall_of_refilled_questions(spark):
    """Questions of 40 frames with names, numbers and units exchanged, in long texts; frames without copies stay clean."""
    rng = random.Random(9)
    names, units = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi"], ["km", "miles", "meters", "hours"]
    plain = [f"v{i}" for i in range(300)]
    frames = []
    for _ in range(40):
        w = [rng.choice(plain) for _ in range(rng.randrange(12, 30))]
        for slot in ("{a}", "{a}", "{b}", "{x}", "{y}", "{u}"):
            w.insert(rng.randrange(len(w) + 1), slot)
        frames.append(" ".join(w) + "?")

    def fill(f):
        a, b = rng.sample(names, 2)
        return f.format(a=a, b=b, x=rng.randrange(2, 99), y=rng.randrange(100, 999), u=rng.choice(units))

    items = [(i, fill(f)) for i, f in enumerate(frames)]
    texts = [" ".join(rng.choice(plain) for _ in range(200)) + f". {fill(f)} " + " ".join(rng.choice(plain) for _ in range(200)) for f in frames[:30]]
    texts += [" ".join(rng.choice(plain) for _ in range(400)) for _ in range(30)]
    got = found(spark, texts, items)
    assert sum([i for i, _ in got[k]] == [k] for k in range(30)) >= 27
    assert not any(got[k] for k in range(30, 60))


TEXTS = ["Hello world", "", " two  spaces ", "tabs\tand\nlines\n\n", "naïve café — ünïcödé", "日本語 🙂 emoji", "aaaaaaaa" * 50, "¿Qué? ¡Sí!", "x" * 300, "a b c " * 300]


def unigram_model():
    """The public vocabulary as a unigram model for the library: the same pieces with this module's log scores."""
    import struct

    with open(sentencepiece.MODEL, "rb") as f:
        data = f.read()
    pieces = sentencepiece.read_pieces(data)

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes((n & 127 | 128,)), n >> 7
        return out + bytes((n,))

    out, k = b"", 0
    for number, wire, value in sentencepiece.fields(data):
        if number == 1:
            p, score, kind = pieces[k]
            k += 1
            body = b"\x0a" + varint(len(p.encode())) + p.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(kind)
        elif number == 2:
            body = b""
            for n, w, v in sentencepiece.fields(value):
                v = sentencepiece.UNIGRAM if n == 3 else v
                body += varint(n << 3 | w) + (varint(v) if w == 0 else varint(len(v)) + v if w == 2 else struct.pack("<f", v))
        else:
            body = value
        assert wire == 2
        out += varint(number << 3 | 2) + varint(len(body)) + body
    return out


@pytest.fixture(scope="module")
def encoder():
    if not os.path.exists(sentencepiece.MODEL):
        pytest.skip("no vocabulary file here")
    return sentencepiece.Encoder(sentencepiece.Model.read(sentencepiece.MODEL))


def test_same_as_the_library(encoder):
    import sentencepiece as library

    theirs = library.SentencePieceProcessor(model_proto=unigram_model())
    rng = random.Random(7)
    words = ["tion", "the", "ing", "é", "ß", "x", "123", "\n", "  ", "Zürich", "antidisestablishmentarianism"]
    texts = [t for t in TEXTS if len(t) < 200] + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    same = 0
    for t in texts:
        ours, want = encoder.encode(t), theirs.encode(t)
        score = lambda ids: sum(encoder.scores[i] if encoder.m.surface[i] and i not in encoder.m.byte_ids else encoder.unk for i in ids)
        assert encoder.decode(ours) == theirs.decode(ours) == t
        same += ours == want
        assert ours == want or abs(score(ours) - score(want)) < 1e-3, (t, ours, want)  # paths of equal score may differ
    assert same > 0.98 * len(texts)


def test_words_apart_as_whole(encoder):
    for t in TEXTS:
        whole = encoder.best((" " + t).replace(" ", sentencepiece.MARK)) if t else []
        assert encoder.encode(t) == whole, t


def test_user_pieces_and_normaliser(tmp_path, encoder):
    """Against the library, on a model with user-defined pieces that removes extra spaces."""
    import sentencepiece as library

    data = unigram_model()
    user = {"<sep>", "ation", "▁the"}
    varint = lambda n: bytes((n & 127 | 128, *varint(n >> 7))) if n > 127 else bytes((n,))
    out = b""
    for number, _, value in sentencepiece.fields(data):
        if number == 1:
            p = next(v for n, _, v in sentencepiece.fields(value) if n == 1).decode()
            if p in user:
                value = value[:-1] + bytes((sentencepiece.USER,))
        if number == 3:
            value = value.replace(b"\x20\x00", b"\x20\x01")
        out += varint(number << 3 | 2) + varint(len(value)) + value
    (tmp_path / "m").write_bytes(out)
    ours, theirs = sentencepiece.Encoder(sentencepiece.Model.read(str(tmp_path / "m"))), library.SentencePieceProcessor(model_proto=out)
    assert ours.m.squeeze and sum(k == sentencepiece.USER for *_, k in sentencepiece.read_pieces(out)) == 2
    for t in ("the nation  stationed   there", " mentions of the other ", "tiontion", "rationthe"):
        assert ours.encode(t) == theirs.encode(t), t
        assert ours.decode(ours.encode(t)) == theirs.decode(theirs.encode(t)) == " ".join(t.split())
    with pytest.raises(ValueError, match="character map"):
        sentencepiece.read_rules(b"\x1a\x08" + b"\x0a\x03abc\x12\x01x")


def test_trie():
    keys = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "ßx", "zz", "▁the"])}
    trie = sentencepiece.DoubleArray(keys)
    for key, i in keys.items():
        node = 0
        for c in key:
            t = int(trie.base[node]) + c
            assert trie.check[t] == node
            node = t
        assert trie.value[node] == i


def test_encode_rows(spark, encoder):
    rows = [*enumerate(TEXTS), (99, None), (100, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "exact": F.lit("x"), "n": F.lit(2)})
    out = sentencepiece.encode(df)
    assert out.columns == ["doc_id", "n", "ids", "exact"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].ids == encoder.encode(t) and got[i].exact for i, t in enumerate(TEXTS))
    assert got[99].ids == [] and got[99].exact and not got[100].exact
    back = {r.doc_id: r.text for r in sentencepiece.decode(out).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    assert sentencepiece.encode(df.limit(0)).count() == 0


MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_licences_as_they_stand_in_files(spark):
    """Wrapped, commented and quoted texts, SPDX lines, British spelling; the SQL tells the same."""
    marked = lambda text, lead: "\n".join((lead + line).rstrip() for line in text.split("\n"))
    texts = {
        MIT: "MIT", marked(MIT, "# "): "MIT", marked(MIT, "> "): "MIT", "int x;\n/*\n" + marked(APACHE, " * ") + "\n */\nint y;": "Apache-2.0", marked(APACHE, "// "): "Apache-2.0", marked(LGPL, ";; "): "LGPL-2.1-or-later",
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nx = 1": "Apache-2.0,MIT", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) */\nfoo": "GPL-2.0-only", "# SPDX-License-Identifier: BSD-3-Clause.": "BSD-3-Clause",
        "Released under the MIT Licence.": "MIT", "This project is licensed under the terms of the ISC License.": "ISC", "Available under Mozilla Public License 2.0": "MPL-2.0", "distributed under the table": "",
    }
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_s": F.lit(1), "_left": F.lit(2), "_m0": F.lit(3)})
    out = licenses.scan(df).orderBy("doc_id")
    got = out.collect()
    assert [r.licenses for r in got] == list(texts.values())
    assert out.columns[:4] == ["doc_id", "_s", "_left", "_m0"] and all((r["_s"], r["_left"], r["_m0"]) == (1, 2, 3) for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(f"SELECT doc_id, licenses, identifiers, unmatched, n_sentences FROM ({licenses.SQL}) ORDER BY 1").fetchall()
    assert want == [(r.doc_id, r.licenses, r.identifiers, r.unmatched, r.n_sentences) for r in got]


def test_licences(spark):
    mit = "Copyright (c) 2020 Somebody.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    rows = [
        (1, "Some text. Licensed under the Apache License, Version 2.0. More text."), (2, mit), (3, None), (4, ""), (5, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (6, "This licence is my own."), (7, "No word of it, licensed or not"), (8, "x " * 50_000 + ". All rights reserved."), (9, "LICENSED UNDER CC BY-NC 4.0"), (9, "LICENSED UNDER CC BY-NC 4.0"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(0))
    got = sorted((r.doc_id, r.licenses, r.unmatched, r.n_sentences) for r in licenses.scan(df).collect())
    assert got == [(1, "Apache-2.0", "", 3), (2, "MIT", "unknown", 4), (3, "", "", 0), (4, "", "", 0), (5, "MIT,CC-BY-NC-4.0", "", 2), (6, "", "unknown", 1), (7, "", "unknown", 1), (8, "All-Rights-Reserved", "", 2), (9, "CC-BY-NC-4.0", "", 1), (9, "CC-BY-NC-4.0", "", 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows[:8])
    want = con.sql(f"SELECT doc_id, licenses, unmatched, n_sentences FROM ({licenses.SQL}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in want] == got[:8]
    assert licenses.scan(df.limit(0)).count() == 0
