"""Media columns: motion-JPEG in AVI files.

``store`` writes a text's bytes as grey frames of an AVI file, one JPEG per frame in the lossless process (prediction from the left
neighbour, Huffman coded), so that decoding gives the very samples back. ``read`` parses the RIFF tree and its index, decodes the intra
frames, and measures grey histograms; a shot ends where the difference of two histograms stands out from the differences around it.
``clips`` gives one timed row per shot.

Frames are independent, so the frames of many files are coded and decoded together: each step handles one sample of every frame.
Frames of the baseline process (quantised cosine blocks, as cameras write them) are decoded too, one by one.

Defined cases: a null or empty text becomes one frame of spaces; equal texts give equal files; a null file has no clips; a file without
an index is read by walking its chunks; damaged files raise ``ValueError``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.llm.baseline_jpeg import luminance
from planweave.llm.common import slices

WIDTH, HEIGHT, RATE = 16, 12, 25
FRAME = WIDTH * HEIGHT
#: Lengths of the Huffman codes of difference categories 0..8 in the files that ``store`` writes.
CODE_LENGTHS = (4, 4, 4, 3, 3, 3, 2, 3, 5)


class Huffman:
    """A canonical code from its lengths table, with direct look-up by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.code, self.length = np.zeros(256, np.uint32), np.zeros(256, np.int64)
        self.symbol_at, self.length_at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = k = 0
        for bits, n in enumerate(counts, 1):
            for symbol in symbols[k : k + n]:
                self.code[symbol], self.length[symbol] = code, bits
                first = code << (16 - bits)
                self.symbol_at[first : first + (1 << (16 - bits))] = symbol
                self.length_at[first : first + (1 << (16 - bits))] = bits
                code += 1
            k += n
            code <<= 1


def _table() -> tuple[bytes, bytes]:
    counts = bytes(CODE_LENGTHS.count(n) for n in range(1, 17))
    return counts, bytes(sorted(range(len(CODE_LENGTHS)), key=lambda c: (CODE_LENGTHS[c], c)))


def _jpeg_head() -> bytes:
    counts, symbols = _table()
    huffman = b"\xff\xc4" + struct.pack(">HB", 3 + 16 + len(symbols), 0) + counts + symbols
    frame = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    return b"\xff\xd8" + huffman + frame + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


_HEAD, _END = _jpeg_head(), b"\xff\xd9"


def encode(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of grey frames, given as (frames, HEIGHT, WIDTH) bytes."""
    n = len(samples)
    x = samples.astype(np.int16)
    guess = np.empty_like(x)
    guess[:, :, 1:] = x[:, :, :-1]
    guess[:, 1:, 0] = x[:, :-1, 0]
    guess[:, 0, 0] = 128
    difference = (x - guess).reshape(n, -1)
    table = Huffman(*_table())
    category = np.array([int(v).bit_length() for v in range(256)], np.int64)[np.abs(difference)]
    extra = (difference + np.where(difference < 0, (1 << category) - 1, 0)).astype(np.uint32)
    code = (table.code[category] << category.astype(np.uint32)) | extra
    length = table.length[category] + category
    ends = np.cumsum(length, axis=1)
    sizes = (ends[:, -1] + 7) >> 3
    first = np.cumsum(sizes) - sizes
    place = (first * 8)[:, None] + ends - length
    window = (code << (24 - length - (place & 7)).astype(np.uint32)).ravel()
    at, total = (place >> 3).ravel(), int(sizes.sum())
    data = sum(np.bincount(at + k, (window >> np.uint32(16 - 8 * k)) & np.uint32(255), total + 2) for k in range(3))[:total].astype(np.uint8)
    data[first + sizes - 1] |= ((1 << ((-ends[:, -1]) & 7)) - 1).astype(np.uint8)
    full = data == 255
    stuffed = np.repeat(data, 1 + full)
    before = np.concatenate([[0], np.cumsum(1 + full)])
    stuffed[before[1:][full] - 1] = 0
    raw, cuts = stuffed.tobytes(), before[np.concatenate([first, [total]])].tolist()
    return [_HEAD + raw[cuts[k] : cuts[k + 1]] + _END for k in range(n)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, rate: int = RATE) -> bytes:
    """An AVI file with one motion-JPEG stream and an index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    body, index, at = [b"movi"], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        body.append(chunk)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(chunk)
    rest = head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", 4 + len(rest)) + b"AVI " + rest


def _walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, start)
        if start + 8 + size > end:
            raise ValueError("a chunk ends beyond its parent")
        yield name, start + 8, size
        start += 8 + size + (size & 1)


def parse(data: bytes) -> tuple[list[bytes], float]:
    """The video frames of an AVI file in index order, and seconds per frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    period, movi, index = 1.0 / RATE, None, None
    for name, at, size in _walk(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[at : at + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for inner, place, _ in _walk(data, at + 4, at + size):
                if inner == b"avih":
                    period = struct.unpack_from("<I", data, place)[0] / 1e6 or period
        elif kind == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = np.frombuffer(data, np.dtype("S4, <u4, <u4, <u4"), size // 16, at)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return [data[at : at + size] for name, at, size in _walk(data, movi[0] + 4, sum(movi)) if name[2:] in (b"dc", b"db")], period
    index = index[np.isin(index["f0"], [b"00dc", b"00db"])]
    base = movi[0] if len(index) and data[movi[0] + int(index["f2"][0]) :][:4] == index["f0"][0] else 0
    starts = (index["f2"].astype(np.int64) + base + 8).tolist()
    return [data[a : a + n] for a, n in zip(starts, index["f3"].tolist(), strict=True)], period


class Picture:
    """What stands before the coded data of a JPEG file."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, Huffman] = {}
        self.restart = 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            if at + 4 > len(data) or data[at] != 255:
                raise ValueError("a JPEG marker is missing")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = Huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker in (0xC0, 0xC1, 0xC3):
                self.process = marker
                self.bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                self.predictor = body[1 + 2 * body[0]]
                self.size = at
                return


@lru_cache(maxsize=256)
def _picture(head: bytes) -> Picture:
    return Picture(head)


def _lossless(picture: Picture, frames: list[bytes]) -> np.ndarray:
    """Samples of lossless grey frames that share their head, one step for each sample of a frame."""
    if len(picture.scan) != 1 or picture.bits != 8 or picture.predictor != 1 or picture.restart:
        raise ValueError("this lossless coding is not supported")
    table = picture.huffman[next(iter(picture.scan.values()))[0]]
    coded = [f[picture.size : -2] for f in frames]
    data = np.frombuffer(b"".join(coded) + b"\0\0", np.uint8)
    zero = np.zeros(len(data), bool)
    zero[1:] = (data[1:] == 0) & (data[:-1] == 255)
    zero[-2:] = False
    cuts = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    gone = np.concatenate([[0], np.cumsum(zero)])
    first = (cuts - gone[cuts])[:-1]
    plain = np.concatenate([data[:-2][~zero[:-2]], np.zeros(4, np.uint8)]).astype(np.uint32)
    words = (plain[:-3] << np.uint32(24)) | (plain[1:-2] << np.uint32(16)) | (plain[2:-1] << np.uint32(8)) | plain[3:]
    place = first * 8
    half = np.array([0] + [1 << (c - 1) for c in range(1, 17)])
    low = np.array([0] + [1 - (1 << c) for c in range(1, 17)])
    out = np.empty((picture.height * picture.width, len(frames)), np.int64)
    for k in range(len(out)):
        word = words[np.minimum(place >> 3, len(words) - 1)] << (place & 7).astype(np.uint32)
        ahead = word >> np.uint32(16)
        bits, category = table.length_at[ahead], table.symbol_at[ahead]
        extra = (((word << bits.astype(np.uint32)) >> np.uint32(1)) >> (31 - category).astype(np.uint32)).astype(np.int64)
        guess = out[k - 1] if k % picture.width else out[k - picture.width] if k else 128
        out[k] = (guess + extra + np.where(extra < half[category], low[category], 0)) & 255
        place = place + bits + category
    return out.T.astype(np.uint8).reshape(len(frames), picture.height, picture.width)


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """Grey samples (height, width) of each JPEG frame."""
    groups: dict[bytes, list[int]] = {}
    head = b""
    for k, frame in enumerate(frames):
        if not head or not frame.startswith(head):
            head = frame[: Picture(frame).size]
        groups.setdefault(head, []).append(k)
    out: list[np.ndarray] = [np.empty(0)] * len(frames)
    for head, own in groups.items():
        picture = _picture(head)
        if picture.process == 0xC3:
            made = _lossless(picture, [frames[k] for k in own])
        else:
            made = [luminance(picture, frames[k]) for k in own]
        for k, samples in zip(own, made, strict=True):
            out[k] = samples
    return out


def histograms(frames: list[np.ndarray], bins: int = 16) -> np.ndarray:
    """Shares of grey levels, one row per frame."""
    sizes = np.array([f.size for f in frames])
    level = np.concatenate([f.ravel() for f in frames]).astype(np.int64) * bins >> 8
    row = np.repeat(np.arange(len(frames)), sizes)
    return np.bincount(row * bins + level, minlength=len(frames) * bins).reshape(-1, bins) / sizes[:, None]


def shots(rows: np.ndarray, around: int = 8, deviations: float = 2.0, least: float = 0.08) -> list[tuple[int, int]]:
    """Shots as (first frame, frame after the last). A cut is a difference over the mean of those around it by some deviations, and the largest of its neighbours."""
    n = len(rows)
    if n < 3:
        return [(0, n)] if n else []
    step = np.abs(np.diff(rows, axis=0)).sum(axis=1) / 2
    low, high = np.maximum(np.arange(n - 1) - around, 0), np.minimum(np.arange(n - 1) + around + 1, n - 1)
    sums, squares = np.concatenate([[0], np.cumsum(step)]), np.concatenate([[0], np.cumsum(step**2)])
    count = high - low
    mean = (sums[high] - sums[low]) / count
    spread = np.sqrt(np.maximum((squares[high] - squares[low]) / count - mean**2, 0))
    padded = np.concatenate([[-1.0], step, [-1.0]])
    cut = (step >= least) & (step > mean + deviations * spread + 1e-9) & (step > padded[:-2]) & (step >= padded[2:])
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text as UTF-8, filled up with spaces to whole frames, in an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2 << 20):
            payloads = [(t or "").encode() for t in part.column(1).to_pylist()]
            sizes = [max(FRAME, -(-len(p) // FRAME) * FRAME) for p in payloads]
            joined = b"".join(p.ljust(n) for p, n in zip(payloads, sizes, strict=True))
            frames, at, files = encode(np.frombuffer(joined, np.uint8).reshape(-1, HEIGHT, WIDTH)), 0, []
            for n in sizes:
                files.append(avi(frames[at : at + n // FRAME]))
                at += n // FRAME
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, payloads), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _opened(files: list[bytes | None]) -> Iterator[tuple[list[np.ndarray], list[tuple[int, int]], float]]:
    """Frames, shots and seconds per frame of each file; the frames of all files are decoded at once."""
    parsed = [parse(f) if f is not None else ([], 0.0) for f in files]
    frames = decode([frame for own, _ in parsed for frame in own])
    rows, at = histograms(frames) if frames else np.empty((0, 16)), 0
    for own, period in parsed:
        yield frames[at : at + len(own)], shots(rows[at : at + len(own)]), period
        at += len(own)


def clips(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, clip, first_frame, end_frame, start_s, end_s: the timed shots of every file of column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 4 << 20):
            rows = [(k, c, a, b, a * period, b * period) for k, (_, found, period) in zip(part.column(0).to_pylist(), _opened(part.column(1).to_pylist()), strict=True) for c, (a, b) in enumerate(found)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [key, "clip", "first_frame", "end_frame", "start_s", "end_s"])

    return media.select(F.col(key).cast("long"), "media").mapInArrow(run, f"`{key}` long, clip int, first_frame long, end_frame long, start_s double, end_s double")


def digest(media: DataFrame) -> DataFrame:
    """Of each stored file: sizes and digests of the payload read back and of the file, and its timed shots as a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 4 << 20):
            files = part.column(2).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for file, (frames, found, period) in zip(files, _opened(files), strict=True):
                payload = b"".join(f.tobytes() for f in frames)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), ",".join(f"{a * period:.2f}-{b * period:.2f}" for a, b in found))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
