"""Media columns: AVI files of motion-JPEG frames, their clips, and texts stored as such films.

Reading: the RIFF chunks and the idx1 index give the frames of an AVI file; a frame is a JPEG image of its own, coded
without loss (process SOF3, predictors 1 to 7) or as baseline DCT (SOF0, gray or colour, with sampling and restart
intervals). A shot ends where the histogram of gray values differs from the frame before by more than its surroundings
do: the limit is the mean plus `SPREAD` standard deviations of the differences within `AROUND` frames to either side,
and `FLOOR` at least. Shots are timed by the file's frame rate.

Storing: a payload's bytes are the samples of gray frames of 16 x 12, coded as lossless JPEG with predictor 1 and a
Huffman table in which a code and its extra bits always make 9 bits together, so packing and unpacking are whole-array
operations. Any decoder of lossless JPEG reads the frames.

Nulls: a null text is the empty text. A null or unreadable file has no clips and says so in `error`. Equal contents,
equal values; repeated rows stay. Empty tables give no rows. All columns but the named ones are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclora.llm.common import ship, utf8

WIDE, HIGH, UNIT, RATE = 16, 12, 192, 25
SPREAD, AROUND, FLOOR, BINS = 2.0, 8, 0.25, 16

# --- storing -------------------------------------------------------------------------------------------------------


def _code_of_difference() -> np.ndarray:
    """The 9 bits for each difference -255..255: category 8 has code 0, category 7 code 10, and so on, then the extra
    bits (negative ones less by one, as in all of JPEG)."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code = (1 << (9 - category)) - 2
        extra = d if d >= 0 else d + (1 << category) - 1
        out[d + 255] = code << category | extra
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: One code of each length 1 to 9, for the categories 8 down to 0.
_TABLE = bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))
_FRAME_HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, _TABLE)
    + _segment(0xC3, struct.pack(">BHHBBBB", 8, HIGH, WIDE, 1, 1, 0x11, 0))
    + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
)
_CODES = _code_of_difference()


def encode_frames(payload: bytes) -> list[bytes]:
    """Each 192 bytes as a lossless JPEG image."""
    s = np.frombuffer(payload, np.uint8).reshape(-1, HIGH, WIDE).astype(np.int16)
    d = np.empty_like(s)
    d[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    d[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    d[:, 0, 0] = s[:, 0, 0] - 128
    c = _CODES[d + 255].reshape(len(s), UNIT // 8, 8)
    packed = np.empty((len(s), UNIT // 8, 9), np.uint8)
    packed[..., 0] = c[..., 0] >> 1
    for i in range(1, 8):  # byte i ends code i-1 and begins code i
        packed[..., i] = (c[..., i - 1] << (8 - i) | c[..., i] >> (i + 1)) & 255
    packed[..., 8] = c[..., 7] & 255
    rows = packed.reshape(len(s), -1)
    full = (rows == 255).any(axis=1).tolist()
    n, raw = rows.shape[1], rows.tobytes()
    scans = [raw[i : i + n] for i in range(0, len(raw), n)]
    return [_FRAME_HEAD + (x.replace(b"\xff", b"\xff\0") if f else x) + b"\xff\xd9" for x, f in zip(scans, full)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], wide: int = WIDE, high: int = HIGH, rate: int = RATE) -> bytes:
    """An AVI 1.0 file of one motion-JPEG stream with its idx1 index."""
    n = len(frames)
    sizes = np.fromiter(map(len, frames), np.int64, n)
    movi = b"".join([b"00dc" + struct.pack("<I", len(x)) + (x + b"\0" if len(x) & 1 else x) for x in frames])
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = 0x63643030, 0x10, sizes
    index[1:, 2] = np.cumsum(8 + sizes + (sizes & 1))[:-1]
    index[:, 2] += 4
    largest = int(sizes.max()) if n else 0
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, n, 0, 1, largest, wide, high, 0, 0, 0, 0)
    strh = struct.pack("<4s4sI2H8I4h", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + movi) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


# --- reading -------------------------------------------------------------------------------------------------------


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames of the first video stream, found by the index, or by the chunks if it has none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, movi, index = 0.0, None, None
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a : a + 4]
        if name == b"LIST" and kind == b"hdrl":
            for part, c, _ in _chunks(data, a + 4, b):
                if part == b"avih":
                    rate = 1e6 / max(1, struct.unpack_from("<I", data, c)[0])
        elif name == b"LIST" and kind == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = np.frombuffer(data[a : a + (b - a) // 16 * 16], "<u4").reshape(-1, 4)
    if movi is None:
        raise ValueError("no movi list")
    if index is not None and len(index):
        own = index[np.isin(index[:, 0] >> 16, (0x6364, 0x6264))]  # ..dc, ..db
        offset, size = own[:, 2].astype(np.int64), own[:, 3].astype(np.int64)
        base = movi[0]  # offsets count from the list's kind, or in some files from the start of the file
        if len(own) and data[base + offset[0] : base + offset[0] + 4] != struct.pack("<I", own[0, 0]):
            base = 0
        at = (base + 8 + offset).tolist()
        return rate, [data[x : x + n] for x, n in zip(at, size.tolist())]
    return rate, [data[a:b] for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]


class Jpeg:
    """What a JPEG image's headers say. Equal headers make equal objects, so films parse them once."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[int, tuple[bytes, bytes]] = {}
        self.restart, at = 0, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker where one should be")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huff[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker in (0xC0, 0xC1, 0xC3):
                self.process, self.bits = marker, body[0]
                self.high, self.wide = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"process {marker:#x} isn't read")
            elif marker == 0xDA:
                n = body[0]
                self.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)}
                self.predictor, self.scan = body[1 + 2 * n], at
                return

    def lookup(self, table: int) -> np.ndarray:
        """For each 16 bits ahead: code length << 8 | symbol."""
        lengths, symbols = self.huff[table]
        out, code, k = np.zeros(1 << 16, np.int32), 0, 0
        for n in range(1, 17):
            for _ in range(lengths[n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\0" * 8, "big"), 8 * (len(data) + 8)

    def peek(self) -> int:
        return self.value >> (self.left - 16) & 0xFFFF if self.left >= 16 else 0

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the image ends early")
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        x = table[self.peek()]
        if not x:
            raise ValueError("no such code")
        self.left -= x >> 8
        return x & 255

    def number(self, category: int) -> int:
        if not category:
            return 0
        x = self.take(category)
        return x if x >> (category - 1) else x - (1 << category) + 1


def _zigzag() -> np.ndarray:
    """Where the k-th coefficient stands in its block: diagonals, walked up and down in turn."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


_ZIGZAG = _zigzag()
_WAVE = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _segments(scan: bytes) -> list[bytes]:
    """The scan's bytes between restart markers, without stuffing."""
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        elif scan[at + 1] not in (0x00, 0xFF):
            return [x.replace(b"\xff\0", b"\xff") for x in (*out, scan[start:at])]
        at += 2 if scan[at + 1] != 0xFF else 1
    return [x.replace(b"\xff\0", b"\xff") for x in (*out, scan[start:])]


def _baseline(j: Jpeg, data: bytes) -> np.ndarray:
    """Gray samples of a baseline image: its first component, after the inverse transform."""
    most_h, most_v = max(p[1] for p in j.parts), max(p[2] for p in j.parts)
    if len(j.parts) == 1:
        j.parts = [(j.parts[0][0], 1, 1, j.parts[0][3])]
        most_h = most_v = 1
    across, down = -(-j.wide // (8 * most_h)), -(-j.high // (8 * most_v))
    dc = {t: j.lookup(t).tolist() for t in {a for a, _ in j.tables.values()}}
    ac = {t: j.lookup(0x10 | t).tolist() for t in {b for _, b in j.tables.values()}}
    first = j.parts[0]
    luma = np.zeros((down * first[2], across * first[1], 64), np.int32)
    parts, bits, last = _segments(data[j.scan :]), None, {}
    for mcu in range(across * down):
        if bits is None or j.restart and mcu % j.restart == 0:
            bits, last = _Bits(parts.pop(0)), dict.fromkeys((p[0] for p in j.parts), 0)
        for part, h, v, _ in j.parts:
            for block in range(h * v):
                coded, k = [0] * 64, 1
                last[part] += bits.number(bits.symbol(dc[j.tables[part][0]]))
                coded[0] = last[part]
                while k < 64:
                    s = bits.symbol(ac[j.tables[part][1]])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        coded[k] = bits.number(s & 15)
                    k += 1
                if part == first[0]:
                    luma[mcu // across * v + block // h, mcu % across * h + block % h] = coded
    blocks = np.zeros(luma.shape, np.float64)
    blocks[..., _ZIGZAG] = luma * j.quant[first[3]]
    pixels = np.einsum("xu,rcuv,yv->rcxy", _WAVE, blocks.reshape(*luma.shape[:2], 8, 8), _WAVE)
    whole = pixels.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, -1)
    high, wide = -(-j.high * first[2] // most_v), -(-j.wide * first[1] // most_h)
    return np.clip(np.rint(whole[:high, :wide]) + 128, 0, 255).astype(np.uint8)


def _lossless(j: Jpeg, data: bytes) -> np.ndarray:
    """Samples of a lossless image of one component, for any table and predictor."""
    if len(j.parts) != 1 or j.restart:
        raise ValueError("lossless images of several components or with restarts aren't read")
    table, bits = j.lookup(j.tables[j.parts[0][0]][0]).tolist(), _Bits(_segments(data[j.scan :])[0])
    out = [[0] * j.wide for _ in range(j.high)]
    for y in range(j.high):
        for x in range(j.wide):
            if y == 0:
                guess = out[0][x - 1] if x else 1 << (j.bits - 1)
            elif x == 0:
                guess = out[y - 1][0]
            else:
                a, b, c = out[y][x - 1], out[y - 1][x], out[y - 1][x - 1]
                guess = (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[j.predictor]
            category = bits.symbol(table)
            out[y][x] = (guess + (32768 if category == 16 else bits.number(category))) & 0xFFFF
    return np.array(out).astype(np.uint8 if j.bits <= 8 else np.uint16)


def _even(j: Jpeg) -> tuple[int, np.ndarray] | None:
    """Bits of every code with its extra bits, and the difference for each, if a lossless film can be read at once."""
    if j.process != 0xC3 or len(j.parts) != 1 or j.restart or j.predictor != 1 or j.bits != 8 or (j.wide * j.high) % 8:
        return None
    lengths, symbols = j.huff[j.tables[j.parts[0][0]][0]]
    sizes = [n + 1 for n in range(16) for _ in range(lengths[n])]
    if {n + s for n, s in zip(sizes, symbols)} != {9}:
        return None
    ahead = j.lookup(j.tables[j.parts[0][0]][0])[np.arange(512) << 7]
    category = ahead & 255
    extra = np.arange(512) & ((1 << category) - 1)
    half = np.where(category > 0, 1 << np.maximum(category - 1, 0), 0)
    return 9, np.where((extra >= half), extra, extra - (1 << category) + 1).astype(np.int16)


def decode_frames(frames: list[bytes]) -> np.ndarray | list[np.ndarray]:
    """The gray samples of each frame: one array if all are of the same form, else a list."""
    if not frames:
        return []
    j = Jpeg(frames[0])
    head, even = frames[0][: j.scan], _even(j)
    if even and all([x.startswith(head) for x in frames]):
        n, scan = j.wide * j.high * 9 // 8, j.scan
        raw = b"".join([x[scan : scan + n] if x.find(b"\xff\0", scan) < 0 else x[scan:].replace(b"\xff\0", b"\xff")[:n] for x in frames])
        if len(raw) == n * len(frames):
            p = np.frombuffer(raw, np.uint8).reshape(len(frames), -1, 9).astype(np.uint16)
            c = np.empty((len(frames), p.shape[1], 8), np.uint16)
            for i in range(8):
                c[..., i] = (p[..., i] << (i + 1) | p[..., i + 1] >> (7 - i)) & 511
            d = even[1][c].reshape(len(frames), j.high, j.wide)
            d[:, 0, 0] += 128
            d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
            return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)
    out = []
    for x in frames:
        j = Jpeg(x)
        out.append(_lossless(j, x) if j.process == 0xC3 else _baseline(j, x))
    return out


def cuts(frames: np.ndarray | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The frames at which a shot begins, and the difference of each frame's histogram from the one before (0 to 1)."""
    n = len(frames)
    if isinstance(frames, np.ndarray):
        level = (frames.reshape(n, -1) >> 4).astype(np.int64)
        share = np.bincount((level + BINS * np.arange(n)[:, None]).ravel(), minlength=BINS * n).reshape(n, BINS) / level.shape[1]
    else:
        share = np.array([np.bincount((x.ravel() >> 4).astype(np.int64), minlength=BINS)[:BINS] / max(1, x.size) for x in frames]).reshape(n, BINS)
    if n < 2:
        return np.zeros(min(n, 1), np.int64), np.zeros(n)
    step = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    total, square = (np.concatenate(([0.0], np.cumsum(np.round(x, 12)))) for x in (step, step * step))
    a, b = np.maximum(np.arange(n - 1) - AROUND, 0), np.minimum(np.arange(n - 1) + AROUND + 1, n - 1)
    mean = (total[b] - total[a]) / (b - a)
    spread = np.sqrt(np.maximum((square[b] - square[a]) / (b - a) - mean * mean, 0))
    found = step > np.maximum(mean + SPREAD * spread, FLOOR) + 1e-9
    return np.concatenate(([0], np.flatnonzero(found) + 1)), np.concatenate(([0.0], step))


# --- columns -------------------------------------------------------------------------------------------------------


def padded(text: str | None) -> tuple[int, bytes]:
    raw = utf8(text)
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def film_digest(film: bytes) -> dict:
    """What a stored film's bytes hold: its payload's sums and its shots."""
    _, frames = read_avi(film)
    samples = decode_frames(frames)
    payload = samples.tobytes() if isinstance(samples, np.ndarray) else b"".join(x.tobytes() for x in samples)
    begins, step = cuts(samples)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(film),
        "media_sha256": hashlib.sha256(film).hexdigest(),
        "feature": f"frames={len(frames)};shots={len(begins)};mean={step.mean():.4f};cuts={','.join(map(str, begins[1:]))}",
    }


_DIGEST = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def text_film_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its text stored as a film, read back, and summed up. Films aren't passed on."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n, payload = padded(value.as_py())
                rows.append({"n_bytes": n} | film_digest(write_avi(encode_frames(payload))))
            columns = [pa.array([r[c] for r in rows], k) for c, k in _DIGEST.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_DIGEST])

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(scan, schema)


def text_films(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, film (an AVI file that holds the padded text)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                films = [write_avi(encode_frames(padded(x.as_py())[1])) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(films, pa.binary())], ["doc_id", "film"])

    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(scan, f"doc_id {kind}, film binary")


def clips(media: DataFrame, media_id: str = "media_id", content: str = "content") -> DataFrame:
    """A row per shot of each AVI file: media_id, clip, first_frame, n_frames, start_s, end_s, change (the histogram's
    difference at its start), error. An unreadable file has one row with its error."""
    kind = media.schema[media_id].dataType.simpleString()
    schema = f"media_id {kind}, clip int, first_frame bigint, n_frames bigint, start_s double, end_s double, change double, error string"
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]

    def rows_of(data: bytes | None) -> list[tuple]:
        try:
            rate, frames = read_avi(data or b"")
            begins, step = cuts(decode_frames(frames))
        except (ValueError, IndexError, KeyError, struct.error) as e:
            return [(None, None, None, None, None, None, str(e)[:200] or type(e).__name__)]
        ends = [*begins[1:].tolist(), len(frames)]
        return [(i, a, b - a, a / rate, b / rate, float(step[a]), None) for i, (a, b) in enumerate(zip(begins.tolist(), ends))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = rows_of(batch.column(1)[k].as_py())
                if rows:
                    ids = batch.column(0).take(pa.array([k] * len(rows), pa.int64()))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["media_id", "clip", "first_frame", "n_frames", "start_s", "end_s", "change", "error"])

    return media.select(F.col(media_id).alias("media_id"), content).mapInArrow(scan, schema)


ship(__name__)
