import hashlib
import struct
import zlib

import numpy as np
import pytest

from planweave.llm import media
from planweave.llm.baseline_jpeg import _cosines, _zigzag


def baseline(image, quant=4):
    """A plain baseline JPEG of a grey image, all codes of eight bits."""
    height, width = image.shape
    order, basis, bits = _zigzag(), _cosines(), []
    sizes = bytes(range(12))
    symbols = bytes([0, 0xF0, *(16 * r + s for r in range(16) for s in range(1, 11))])
    put = lambda v, n: bits.extend((v >> (n - 1 - k)) & 1 for k in range(n))
    amount = lambda v: put(v if v >= 0 else v + (1 << abs(v).bit_length()) - 1, abs(v).bit_length())
    before = 0
    for y in range(0, height, 8):
        for x in range(0, width, 8):
            block = np.rint(basis @ (image[y : y + 8, x : x + 8].astype(float) - 128) @ basis.T / quant).astype(int).ravel()[order].tolist()
            put(sizes.index(abs(block[0] - before).bit_length()), 8)
            amount(block[0] - before)
            before, run = block[0], 0
            for v in block[1:]:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    put(symbols.index(0xF0), 8)
                    run -= 16
                put(symbols.index(16 * run + abs(v).bit_length()), 8)
                amount(v)
                run = 0
            if run:
                put(symbols.index(0), 8)
    bits += [1] * (-len(bits) % 8)
    data = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
    table = lambda k, s: b"\xff\xc4" + struct.pack(">HB", 19 + len(s), k) + bytes([0] * 7 + [len(s)] + [0] * 8) + s
    return (b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([quant] * 64) + table(0, sizes) + table(16, symbols)
            + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0) + data + b"\xff\xd9")


def test_lossless_round_trip():
    samples = np.random.default_rng(1).integers(0, 256, (300, media.HEIGHT, media.WIDTH)).astype(np.uint8)
    samples[0], samples[1] = 0, 255
    frames = media.encode(samples)
    assert all((a == b).all() for a, b in zip(samples, media.decode(frames), strict=True))
    assert media.parse(media.avi(frames)) == (frames, 0.04)


def test_file_without_index_and_damaged_files():
    frames = media.encode(np.zeros((3, media.HEIGHT, media.WIDTH), np.uint8))
    file = media.avi(frames)
    cut = file[: file.index(b"idx1")]
    cut = cut[:4] + struct.pack("<I", len(cut) - 8) + cut[8:]
    assert media.parse(cut)[0] == frames
    for broken in (b"", b"RIFF", file[:60], b"x" * 100):
        with pytest.raises(ValueError):
            media.parse(broken)


def test_baseline_frames_are_decoded():
    y, x = np.mgrid[0:24, 0:32]
    image = (90 + 60 * np.sin(x / 9) + 40 * np.cos(y / 5)).astype(np.uint8)
    found = media.decode([baseline(image), baseline(image[::-1])])
    assert np.abs(found[0].astype(int) - image).max() <= 6
    assert np.abs(found[1].astype(int) - image[::-1]).max() <= 6


def test_shots_end_where_the_picture_changes():
    dark, light = np.zeros((12, 16)), np.zeros((12, 16))
    dark[0, 0], light[0, 0] = 1, 1
    rows = np.zeros((30, 16))
    rows[:12, 2] = 1
    rows[12:, 9] = 1
    assert media.shots(rows) == [(0, 12), (12, 30)]
    assert media.shots(np.zeros((0, 16))) == [] and media.shots(rows[:1]) == [(0, 1)]


def test_store_and_digest(spark):
    texts = [None, "", "a", "é" * 96, "x" * 191, "y" * 192, "z" * 193, "a", "word " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'q' AS media", "1 AS n_bytes")
    rows = {r["doc_id"]: r for r in media.digest(media.store(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert rows[2][2:] == rows[7][2:] and rows[0][1:] == rows[1][1:]
    timed = media.clips(media.store(docs)).collect()
    assert {r["doc_id"] for r in timed} == set(range(len(texts)))
    assert media.digest(media.store(docs.limit(0))).count() == 0
