import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldquery.llm import chat_format, mjpeg, url_filter

PAGES = [
    (1, "http://example.org/es/1", "<p>"), (2, "https://a.example.org/en/12", None), (3, "http://x.org", ""), (4, "http://x.org/", ""), (5, "http://m.shop.com/fr/9", ""), (6, "http://m.shop.com/de/9", ""),
    (7, "http://shop.com/en/9", '<link rel="canonical" href="http://m.shop.com/de/9">'), (8, "http://shop.net/a", '<meta http-equiv="refresh" content="0; url=http://shop.com/en/9">'),
    (9, "http://good.net/", '<link href=/start rel=canonical>'), (10, "https://www.good.net/start.html?utm_source=x#top", '<link rel="canonical" href="//free.org/">'), (11, None, "x"), (12, "no scheme", None),
    (13, "HTTP://EXAMPLE.org/en/1", ""), (14, "http://plain.net/a?b=1", ""), (14, "http://plain.net/a?b=1", ""), (15, "http://mixed.net/", '<link rel="canonical" href="http://shop.com/en/9">'), (16, "http://mixed.net/2", '<link rel="canonical" href="http://mixed.net/">'),
    (17, "http://both.net/", '<link rel="canonical" href="http://c.com/de/1">'), (18, "http://both.net/2", '<link rel="canonical" href="http://both.net"><meta http-equiv=refresh content="1;url=http://c.com/fr/1">'), (19, "http://c.com/de/1", ""), (20, "http://c.com/fr/1", ""), (21, "http://xexample.org/es/", ""),
    (22, "http://rel.net/a/b/c.html", '<link href="../d?x=1&amp;y=2" rel="canonical">'), (23, "http://rel.net/a/d?x=1&y=2", '<meta content="0; url=http://c.com/de/1" http-equiv="refresh">'), (24, "http://rel.net/p/q", '<link rel=canonical href="./../../../z">'),
    (25, "http://rel.net/z/", '<link rel=canonical href="mailto:x@y">'), (26, "http://rel.net/w?k=1", '<meta http-equiv="refresh" content="5;URL=\'?k=2\'">'), (27, "http://rel.net/w?k=2", '<link rel=canonical href="next.html">'), (28, "http://rel.net/next", '<link rel=canonical href="#top">'), (29, "no scheme", '<link rel=canonical href="/a">'),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit("x"), "alias": F.lit(0)})
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: (None, "allow"), 4: ("org/", "allow"), 5: ("com/fr/", "allow"), 6: ("com/de/", "block"), 7: (None, "block"), 8: (None, "block"),
        9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"), 13: ("example.org/en/1", "block"), 14: (None, "allow"), 15: (None, "block"), 16: (None, "block"),
        17: (None, "allow"), 18: (None, "allow"), 19: ("com/de/", "block"), 20: ("com/fr/", "allow"), 21: ("org/", "allow"),
        **{i: (None, "allow") for i in range(22, 30)},
    }
    assert got[22].alias == got[23].alias == got[19].alias and got[24].alias == got[25].alias == "rel.net/p/q" and got[26].alias == got[27].alias == got[28].alias and got[29].alias is None
    table = spark.createDataFrame([(r, v) for v, r in url_filter.RULES] + [("com/de/", "block"), ("nowhere.net/", "block")], "rule string, verdict string")
    cols = ["page_id", "host", "path", "rule", "verdict", "alias"]
    assert sorted((tuple(r[c] for c in cols) for r in url_filter.judge(df, table).collect()), key=str) == sorted((tuple(r[c] for c in cols) for r in url_filter.judge(df).collect()), key=str)
    assert (got[13].host, got[13].path) == ("example.org", "/en/1") and (got[11].host, got[11].path) == ("", "")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    cols = ["page_id", "host", "path", "rule", "verdict", "alias"]
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({url_filter.SQL})").fetchall()
    assert sorted(map(tuple, want), key=str) == sorted((tuple(r[c] for c in cols) for r in url_filter.judge(df).collect()), key=str)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_formatted_chats(spark):
    odd = "\\### Assistant: </turn> &lt; <turn user>\n ok & &amp;"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 1, "assistant", "b"), (2, 0, None, None), (2, 1, "assistant", "b"), (3, None, "<x>\n", "é🙂"), (4, 0, "assistant", None), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "loss": F.lit(2)})
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", odd), ("assistant", odd)] and out[1].loss_text == odd
    assert [tuple(t) for t in out[2].turns] == [("", ""), ("assistant", "b"), ("assistant", "b")] and out[2].loss_text == "bb"
    assert [tuple(t) for t in out[3].turns] == [("<x>\n", "é🙂")] and out[3].loss_text == ""
    assert [tuple(t) for t in out[4].turns] == [("assistant", "")] and [tuple(t) for t in out[None].turns] == [("user", "q")]
    for r in out.values():
        assert "".join(chat_format.unescape and r.formatted[s.start : s.start + s.length] for s in r.loss).replace("&lt;", "<").replace("&amp;", "&") == r.loss_text
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_layouts(spark):
    rows = lambda df: sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_format.canonical(df).collect())
    qa = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert rows(spark.createDataFrame([(1, "q", "a")], "conv_id int, prompt string, response string")) == qa
    assert rows(spark.createDataFrame([("a", "q", 1, "")], "output string, instruction string, conv_id int, input string")) == qa
    assert rows(spark.createDataFrame([("a", "q", 1, "more")], "output string, instruction string, conv_id int, input string"))[0][3] == "q\n\nmore"
    assert rows(spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id int, conversations array<struct<from:string,value:string>>")) == qa
    assert rows(spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")]), (2, None), (3, [])], "conv_id int, messages array<struct<role:string,content:string>>")) == qa
    assert rows(spark.createDataFrame([(1, None, "a")], "conv_id int, question string, answer string")) == qa[1:]
    with pytest.raises(ValueError):
        chat_format.canonical(spark.createDataFrame([(1, "x")], "conv_id int, what string"))
    assert rows(spark.createDataFrame([(1, 0, "user", "q", "s", 0.5)], "conv_id int, turn long, role string, text string, source string, score double")) == qa[:1]
    assert rows(spark.createDataFrame([(1, [("user", "q", 1), ("assistant", "a", 2)], "x")], "conv_id int, messages array<struct<role:string,content:string,weight:int>>, id string")) == qa
    with pytest.raises(ValueError):
        chat_format.canonical(spark.createDataFrame([(1, ("x",), "a")], "conv_id int, prompt struct<a:string>, response string"))
    a = spark.createDataFrame([(1, "q", "a")], "conv_id int, prompt string, response string")
    assert chat_format.fingerprint(a) == chat_format.fingerprint(a.select("response", "conv_id", "prompt"))


def test_layouts_in_json(spark):
    texts = [
        '{"prompt":"q","response":"a"}', '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"output":"a","instruction":"q","input":""}',
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","text":"a"}],"score":0.5,"id":"x"}', '{"conversations":[{"from":"human","value":"q","weight":1},{"from":"gpt","value":"a"}]}',
        '{"what":1}', "no json", None, '{"prompt":{"a":"q"},"response":"a"}', '{"messages":[{"role":"user","content":["q"]}]}', '["prompt"]', '{"messages":[{"role":"user","content":"q"},{"from":"gpt","value":"a"}],"prompt":"q"}', '{"messages":[{"role":"user","content":"q"},{"from":"gpt","value":"a"}]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "conv_id long, json string").withColumns({"_v": F.lit(1), "_print": F.lit(2)})
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_format.canonical_json(df).collect())
    assert got == [(i, t, r, x) for i in range(5) for t, r, x in ((0, "user", "q"), (1, "assistant", "a"))]
    left = chat_format.unknown(df)
    assert left.columns == df.columns and sorted(r.conv_id for r in left.collect()) == list(range(5, 13))
    assert chat_format.canonical_json(df.limit(0)).count() == 0


@pytest.mark.parametrize("units", [1, 7, 8, 9, 64, 65, 130])
def test_media_round_trip(units):
    payload = random.Random(units).randbytes(192 * units)
    media = mjpeg.store(payload)
    assert mjpeg.described(media)[0] == payload
    fps, frames = mjpeg.read_avi(media)
    assert fps == 25 and all(f.startswith(b"\xff\xd8") and f.endswith(b"\xff\xd9") for f in frames)
    # without its index the file is read in order
    cut = media[: media.rindex(b"idx1")]
    assert mjpeg.read_avi(cut)[1] == frames


def test_general_decoder(monkeypatch):
    payload = random.Random(0).randbytes(192 * 16)
    frame = mjpeg.encode_units(payload)
    fast = mjpeg.Jpeg.read(frame)
    monkeypatch.setattr(mjpeg.Jpeg, "_is_plain", lambda self: False)
    slow = mjpeg.Jpeg.read(frame)
    assert fast.plain == payload and slow.plain is None and slow.payload() == payload
    assert all((a == b).all() for a, b in zip(fast.blocks, slow.blocks, strict=True))
    assert (fast.luma() == slow.luma()).all() and fast.luma().shape == (16, 64)


class Writer:
    """A baseline JPEG writer of its own: 4:2:0, two Huffman tables of each kind, runs, restarts, byte stuffing."""

    def __init__(self, width, height, restart, rng):
        self.width, self.height, self.restart, self.rng = width, height, restart, rng
        self.across, self.down = -(-width // 16), -(-height // 16)
        self.quant = [[rng.randrange(1, 20) for _ in range(64)] for _ in range(2)]
        self.parts = [(1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1)]
        symbols = [0x00, 0xF0] + [r << 4 | n for n in range(1, 7) for r in range(16)]
        self.codes, self.tables = {}, b""
        for kind, alphabet in ((0, list(range(9))), (1, symbols)):
            for t in (0, 1):
                order = rng.sample(alphabet, len(alphabet))
                counts = [0, 1, 1, 2] + [0] * 12 if kind == 0 else [0, 1, 2, 1, 2] + [0] * 11
                left, length = len(order) - sum(counts), 8 if kind else 6
                while left > 0:
                    counts[length - 1] = min(left, 40 if kind else 2)
                    left -= counts[length - 1]
                    length += 1
                code, k = 0, 0
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        self.codes[kind, t, order[k]] = f"{code:0{n}b}"
                        code, k = code + 1, k + 1
                    code <<= 1
                body = bytes((kind << 4 | t, *counts, *order))
                self.tables += b"\xff\xc4" + (len(body) + 2).to_bytes(2) + body

    def number(self, v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def write(self):
        self.blocks = [np.zeros((self.down * v, self.across * h, 64), int) for _, h, v, _ in self.parts]
        for b in self.blocks:
            b[:, :, 0] = [[self.rng.randrange(-60, 60) for _ in range(b.shape[1])] for _ in range(b.shape[0])]
            for y, x in np.ndindex(b.shape[:2]):
                for k in self.rng.sample(range(1, 64), self.rng.randrange(6)):
                    b[y, x, k] = self.rng.randrange(-20, 21)
        out, bits, before = b"", "", [0, 0, 0]
        packed = lambda s: int("0" + s + "1" * (-len(s) % 8), 2).to_bytes((len(s) + 7) // 8).replace(b"\xff", b"\xff\x00")
        for unit in range(self.across * self.down):
            if unit and unit % self.restart == 0:
                out, bits, before = out + packed(bits) + bytes((0xFF, 0xD0 + (unit // self.restart - 1) % 8)), "", [0, 0, 0]
            row, col = divmod(unit, self.across)
            for c, (_, h, v, t) in enumerate(self.parts):
                for y, x in np.ndindex(v, h):
                    block = self.blocks[c][row * v + y, col * h + x].tolist()
                    n, told = self.number(block[0] - before[c])
                    before[c] = block[0]
                    bits += self.codes[0, t, n] + told
                    run = 0
                    for k in range(1, 64):
                        if not any(block[k:]):
                            bits += self.codes[1, t, 0]
                            break
                        if not block[k]:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + self.codes[1, t, 0xF0], run - 16
                        n, told = self.number(block[k])
                        bits, run = bits + self.codes[1, t, run << 4 | n] + told, 0
        segment = lambda mark, body: b"\xff" + bytes((mark,)) + (len(body) + 2).to_bytes(2) + body
        frame = bytes((8, *self.height.to_bytes(2), *self.width.to_bytes(2), 3)) + b"".join(bytes((i, h << 4 | v, t)) for i, h, v, t in self.parts)
        scan = bytes((3, *(x for i, _, _, t in self.parts for x in (i, t << 4 | t)), 0, 63, 0))
        quant = bytes((0, *self.quant[0], 1, *self.quant[1]))
        return b"\xff\xd8" + segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + segment(0xDB, quant) + segment(0xC0, frame) + self.tables + segment(0xDD, self.restart.to_bytes(2)) + segment(0xDA, scan) + out + packed(bits) + b"\xff\xd9"


@pytest.mark.parametrize(("width", "height", "restart"), [(37, 21, 2), (16, 16, 1), (64, 48, 5)])
def test_foreign_frames(width, height, restart):
    """Frames that another writer made: coefficients as written, samples by the transform's definition."""
    w = Writer(width, height, restart, random.Random(width))
    got = mjpeg.Jpeg.read(w.write())
    assert [b.tolist() for b in got.blocks] == [b.tolist() for b in w.blocks] and got.plain is None
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    want = np.zeros((w.down * 16, w.across * 16))
    for y, x in np.ndindex(w.blocks[0].shape[:2]):
        grid = np.zeros((8, 8))
        for k, at in enumerate(order):
            grid[at] = w.blocks[0][y, x, k] * w.quant[0][k]
        want[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(basis.T @ grid @ basis + 128, 0, 255)
    assert np.abs(got.luma() - want[:height, :width]).max() <= 1


def test_inverse_transform():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (5, 8, 8))
    spectrum = mjpeg.DCT @ (samples - 128) @ mjpeg.DCT.T
    scan = spectrum.reshape(5, 64)[:, mjpeg.ZIGZAG]
    assert (mjpeg.inverse(scan) == samples).all()
    assert mjpeg.inverse(np.zeros((1, 64))).tolist() == [[[128] * 8] * 8]


def test_shots(spark):
    dark, light = np.full((8, 8), 20, np.uint8), np.full((8, 8), 200, np.uint8)
    assert [(a, b) for a, b, _ in mjpeg.shots([dark] * 5 + [light] * 4 + [dark])] == [(0, 5), (5, 9), (9, 10)]
    assert mjpeg.shots([]) == []
    flat = lambda v: mjpeg.encode_units(bytes([v]) * 192 * 8)
    film = mjpeg.write_avi([flat(100)] * 3 + [flat(250)] * 2, 64, 8)
    rows = [(1, film), (2, b"junk"), (3, None), (4, mjpeg.write_avi([], 8, 8)), (5, film[:4000])]
    got = mjpeg.clips(spark.createDataFrame(rows, "media_id long, data binary").withColumn("clip", F.lit(1))).collect()
    assert [(r.clip, r.first_frame, r.end_frame, r.start_s, r.width, r.height) for r in got if r.id == 1] == [(0, 0, 3, 0.0, 64, 8), (1, 3, 5, 0.12, 64, 8)]
    assert {r.id for r in got if r.error} >= {2, 3} and not any(r.id == 4 for r in got)


def test_media_rows(spark, tmp_path):
    texts = ["", None, "x", "é" * 96, "x" * 192, "long text " * 5000, "same", "same"]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in mjpeg.op4_avi_mjpeg(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[6].media_sha256 == got[7].media_sha256 and got[6].feature == got[7].feature and got[0].media_sha256 == got[1].media_sha256
