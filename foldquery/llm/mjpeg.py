"""AVI motion-JPEG: RIFF parsing by index, intra-frame decoding, shot detection, timed clip rows.

Reading is general: `frames` follows the idx1 index (or scans the movi list where there is none), `Jpeg` decodes baseline
Huffman JPEG of 8 bits with any tables, subsampling and restart intervals, and `shots` cuts where the luma histogram's
change exceeds an adaptive threshold.

Storing bytes losslessly: a payload byte is one quantised DCT coefficient, so the transform's rounding never touches it.
Every coefficient is coded in size category 8, whose 8 extra bits are the byte itself, and the file's Huffman tables give
that category the one-bit code 0. With a restart after each unit of 3 blocks the prediction of the first coefficient starts
from 0 again, so 192 payload bytes make 192 * 9 bits = 216 bytes of scan (before byte stuffing). Any baseline decoder reads
these frames; this module reads the coefficients back by array operations when it meets such tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldquery.llm.common import table

UNIT = 192  # 3 components of 8 by 8
WIDTH_UNITS, FRAME_UNITS = 8, 64  # a full frame: 64 by 64 pixels, 12,288 bytes
FPS = 25


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order: diagonals, turned at every step."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()
_K = np.arange(8)
DCT = np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
DCT[0] /= np.sqrt(2)


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """Blocks of 64 dequantised coefficients in scan order to 8 by 8 samples of 0 to 255."""
    blocks = np.zeros((len(coefficients), 64), dtype=np.float32)
    blocks[:, ZIGZAG] = coefficients
    d = DCT.astype(np.float32)
    return np.clip(np.rint(d.T @ blocks.reshape(-1, 8, 8) @ d + 128), 0, 255).astype(np.uint8)


# ---- JPEG ---------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code(kind: int, slot: int) -> bytes:
    """A table whose only code is 0, for category 8."""
    return bytes((kind << 4 | slot, 1, *[0] * 15, 8))


def encode_units(payload: bytes) -> bytes:
    """One frame that holds payload (a positive multiple of 192 bytes) as coefficients."""
    units = len(payload) // UNIT
    wide = min(units, WIDTH_UNITS)
    if units % wide:
        raise ValueError("units must fill whole rows")
    bits = np.zeros((units, UNIT, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(np.frombuffer(payload, np.uint8)).reshape(units, UNIT, 8)
    scan = np.packbits(bits.reshape(units, -1), axis=1)
    parts = [row.tobytes().replace(b"\xff", b"\xff\x00") for row in scan]
    data = b"".join(p + (bytes((0xFF, 0xD0 + i % 8)) if i + 1 < units else b"") for i, p in enumerate(parts))
    head = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
    head += _segment(0xC0, struct.pack(">BHHB", 8, 8 * (units // wide), 8 * wide, 3) + b"".join(bytes((c, 0x11, 0)) for c in (1, 2, 3)))
    head += _segment(0xC4, _one_code(0, 0) + _one_code(1, 0)) + _segment(0xDD, struct.pack(">H", 1))
    return head + _segment(0xDA, b"\x03" + b"".join(bytes((c, 0)) for c in (1, 2, 3)) + b"\x00\x3f\x00") + data + b"\xff\xd9"


@dataclass
class Jpeg:
    """A decoded frame: header, and coefficients by component as (blocks down, blocks across, 64) in scan order."""

    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huff: dict[tuple[int, int], dict[tuple[int, int], int]] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    tables: dict[int, tuple[int, int]] = field(default_factory=dict)  # component id: DC and AC table
    restart: int = 0
    blocks: list[np.ndarray] = field(default_factory=list)
    plain: bytes | None = None  # the payload, if the frame was written by encode_units

    @classmethod
    def read(cls, data: bytes) -> Jpeg:
        """ValueError if data isn't a baseline JPEG."""
        self, at = cls(), 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("marker expected")
            marker = data[at + 1]
            if marker == 0xFF or marker in (0x01, *range(0xD0, 0xD9)):
                at += 1 if marker == 0xFF else 2
                continue
            if marker == 0xD9:
                break
            n = int.from_bytes(data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide = 1 + (body[0] >> 4)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts, codes, code, k = body[1:17], {}, 0, 17
                    for length, count in enumerate(counts, 1):
                        for _ in range(count):
                            codes[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.huff[body[0] >> 4, body[0] & 15] = codes
                    body = body[k:]
            elif marker in (0xC0, 0xC1):
                bits, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise ValueError("8-bit samples expected")
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
            elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError("only baseline frames are read")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2])
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                end = data.rfind(b"\xff\xd9")
                self._scan(data[at : end if end >= at else len(data)])
                return self
        raise ValueError("no scan")

    def _scan(self, scan: bytes) -> None:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        across, down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.blocks = [np.zeros((down * p[2], across * p[1], 64), dtype=np.int32) for p in self.parts]
        if self._is_plain() and across * 8 == self.width and down * 8 == self.height:
            units = across * down
            intervals = _intervals(scan)
            if len(intervals) == units and all(len(x) == UNIT * 9 // 8 for x in intervals):
                bits = np.unpackbits(np.frombuffer(b"".join(intervals), np.uint8)).reshape(units, UNIT, 9)
                if not bits[:, :, 0].any():
                    raw = np.packbits(bits[:, :, 1:].reshape(units, -1), axis=1)
                    self.plain = raw.tobytes()
                    values = raw.reshape(down, across, 3, 64).astype(np.int32)
                    values = np.where(values < 128, values - 255, values)
                    for c in range(3):
                        self.blocks[c] = values[:, :, c]
                    return
        unit, before = 0, [0] * len(self.parts)
        for data in _intervals(scan):
            bits, before = _Bits(data), [0] * len(self.parts)
            for _ in range(self.restart or across * down):
                if unit >= across * down:
                    break
                row, col = divmod(unit, across)
                for c, (name, ph, pv, _) in enumerate(self.parts):
                    dc, ac = (self.huff[k, t] for k, t in enumerate(self.tables[name]))
                    for y in range(pv):
                        for x in range(ph):
                            block = self.blocks[c][row * pv + y, col * ph + x]
                            before[c] += bits.signed(bits.symbol(dc))
                            block[0] = before[c]
                            k = 1
                            while k < 64:
                                run, size = divmod(bits.symbol(ac), 16)
                                if not size:
                                    if run < 15:
                                        break
                                    k += 16
                                    continue
                                k += run
                                block[k] = bits.signed(size)
                                k += 1
                unit += 1

    def _is_plain(self) -> bool:
        return self.restart == 1 and [p[1:3] for p in self.parts] == [(1, 1)] * 3 and all(self.huff.get((k, t)) == {(1, 0): 8} for both in self.tables.values() for k, t in enumerate(both))

    def payload(self) -> bytes:
        """The bytes that encode_units stored, from the coefficients; ValueError if some coefficient can't be one."""
        if self.plain is not None:
            return self.plain
        values = np.stack(self.blocks, axis=2).ravel()
        if (np.abs(values) < 128).any() or (np.abs(values) > 255).any():
            raise ValueError("the frame holds no payload")
        return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()

    def luma(self) -> np.ndarray:
        """The first component's samples, height by width."""
        b = self.blocks[0]
        out = inverse(b.reshape(-1, 64) * self.quant[self.parts[0][3]])
        out = out.reshape(b.shape[0], b.shape[1], 8, 8).swapaxes(1, 2).reshape(b.shape[0] * 8, b.shape[1] * 8)
        return out[: self.height, : self.width]


def _intervals(scan: bytes) -> list[bytes]:
    """The entropy-coded pieces between restart markers, without stuffing."""
    out, start, at = [], 0, scan.find(b"\xff")
    while at >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at].replace(b"\xff\x00", b"\xff"))
            start = at + 2
        at = scan.find(b"\xff", at + 2)
    out.append(scan[start:].replace(b"\xff\x00", b"\xff"))
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self) -> int:
        if self.at >= self.end:
            return 1  # a scan that ends early reads as ones
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take()
            if (found := codes.get((length, code))) is not None:
                return found
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = 0
        for _ in range(size):
            v = v << 1 | self.take()
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


# ---- AVI ----------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(pictures: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames with an idx1 index."""
    largest = max(map(len, pictures), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(pictures), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(pictures), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks, index, at = [], [], 4
    for p in pictures:
        c = _chunk(b"00dc", p)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(p)))
        chunks.append(c)
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a span; a cut one ends with it."""
    while at + 8 <= end:
        n = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(end, at + 8 + n)
        at += 8 + n + n % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, the JPEG frames of the first video stream, by idx1 or else in file order). ValueError for other data."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, None
    for name, start, end in _chunks(data, 12, len(data)):
        kind = data[start : start + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n2, s2, e2 in _chunks(data, start + 4, end):
                if n2 == b"avih" and (us := struct.unpack_from("<I", data, s2)[0]):
                    fps = 1_000_000 / us
                elif n2 == b"LIST":
                    for n3, s3, _ in _chunks(data, s2 + 4, e2):
                        if n3 == b"strh" and data[s3 : s3 + 4] == b"vids":
                            scale, rate = struct.unpack_from("<II", data, s3 + 20)
                            fps = rate / scale if scale and rate else fps
        elif name == b"LIST" and kind == b"movi":
            movi = (start, end)
        elif name == b"idx1":
            index = (start, end)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return fps, [data[s:e] for n, s, e in _chunks(data, movi[0] + 4, movi[1]) if n[2:] in (b"dc", b"db")]
    rows = [struct.unpack_from("<4sIII", data, at) for at in range(index[0], index[1] - 15, 16)]
    rows = [r for r in rows if r[0][2:] in (b"dc", b"db")]
    base = movi[0]
    if rows and data[base + rows[0][2] : base + rows[0][2] + 4] != rows[0][0]:
        base = 0  # offsets from the file's start
    return fps, [data[base + at + 8 : base + at + 8 + n] for _, _, at, n in rows]


# ---- shots --------------------------------------------------------------------------------


def shots(pictures: list[np.ndarray], bins: int = 16, window: int = 8, factor: int = 3, least: int = 10) -> list[tuple[int, int, int]]:
    """(first frame, end frame, change at its start in percent) of each shot.

    The change of a frame is half the summed difference of its luma histogram from the one before, in percent of its pixels.
    A shot starts where this is `least` or more and over `factor` times the mean of up to `window` changes before it in the shot.
    """
    if not pictures:
        return []
    hist = [np.bincount((p.ravel().astype(np.int32) * bins) >> 8, minlength=bins) * 10_000 // p.size for p in pictures]
    out, start, strength, recent = [], 0, 0, []
    for i in range(1, len(hist)):
        change = int(np.abs(hist[i] - hist[i - 1]).sum()) // 200
        if change >= least and (not recent or change * len(recent) > factor * sum(recent)):
            out.append((start, i, strength))
            start, strength, recent = i, change, []
        else:
            recent = [*recent, change][-window:]
    return [*out, (start, len(hist), strength)]


def clips(files: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """(id, clip, first_frame, end_frame, start_s, end_s, change, width, height, error) of each shot in AVI files.

    Data that is null, no AVI or holds a frame that isn't baseline JPEG gives one row with an error and no clip; a file
    without frames gives no row. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for batch in batches:
            rows = []
            for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    fps, found = read_avi(data or b"")
                    seen = [Jpeg.read(f).luma() for f in found]
                    rows += [(key, k, a, b, a / fps, b / fps, c, seen[a].shape[1], seen[a].shape[0], None) for k, (a, b, c) in enumerate(shots(seen))]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((key, *[None] * 8, str(e)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[] for _ in names], schema, strict=True)], names)

    schema = pa.schema([("id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("change", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("error", pa.string())])
    told = "id long, clip int, first_frame int, end_frame int, start_s double, end_s double, change int, width int, height int, error string"
    return files.select(F.col(id_col).cast("long"), data_col).mapInArrow(run, told)


def store(payload: bytes) -> bytes:
    """An AVI file that holds payload, a positive multiple of 192 bytes, in frames of up to 64 units."""
    step = UNIT * FRAME_UNITS
    whole = len(payload) // step * step
    rest = len(payload) - whole
    row = UNIT * WIDTH_UNITS
    cuts = [*range(0, whole, step), *([whole] if rest >= row else []), *range(whole + rest // row * row, len(payload), row), len(payload)]
    pictures = [encode_units(payload[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return write_avi(pictures, 8 * WIDTH_UNITS, 8 * FRAME_UNITS // WIDTH_UNITS)


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these with bytes 32 up to a positive multiple of 192)."""
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % UNIT or (UNIT if not data else 0))


def described(media: bytes) -> tuple[bytes, str]:
    """What a stored file holds, from its bytes alone: the payload, and its frames and shots as text."""
    fps, found = read_avi(media)
    seen = [Jpeg.read(f) for f in found]
    payload = b"".join(s.payload() for s in seen)
    luma = [s.luma() for s in seen]
    cut = shots(luma)
    total = sum(int(p.sum(dtype=np.int64)) for p in luma)
    pixels = sum(p.size for p in luma)
    told = " ".join(f"{a / fps:.2f}-{b / fps:.2f}" for a, b, _ in cut)
    return payload, f"frames={len(seen)} luma={total * 100 // max(1, pixels) / 100:.2f} shots={len(cut)} {told}"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            ids, texts = batch.slice(at, 500).columns
            cols: list[list] = [[] for _ in names[1:]]
            for t in texts.to_pylist():
                n, payload = padded(t)
                media = store(payload)
                read, feature = described(media)
                row = (n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as motion-JPEG coefficients in an AVI file, read back and described.

    A null text counts as empty, and an empty one is padded to one unit; texts of any length are stored whole. Equal texts have
    equal rows, repeated rows all stay; ids are passed through, null or not; other columns are ignored; an empty table gives
    no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_media, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
