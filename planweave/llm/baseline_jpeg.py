"""Baseline JPEG frames (8-bit, sequential, Huffman coded): the luminance samples, as motion-JPEG cameras write them."""

from __future__ import annotations

from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from planweave.llm.media import Picture


@lru_cache(maxsize=1)
def _zigzag() -> list[int]:
    """Row-major places of the coefficients in coded order: along anti-diagonals, turning at each end."""
    return sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


class _Bits:
    """A reader of one run of coded data between restart markers."""

    def __init__(self, data: bytes):
        plain = data.replace(b"\xff\x00", b"\xff")
        self.value, self.left = int.from_bytes(plain + b"\xff" * 4), 8 * len(plain) + 32

    def peek(self, n: int) -> int:
        if self.left < n:
            raise ValueError("coded data end early")
        return (self.value >> (self.left - n)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        found = self.peek(n) if n else 0
        self.left -= n
        return found

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _runs(data: bytes) -> list[bytes]:
    """Coded data cut at restart markers."""
    out, start, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at = data.find(b"\xff", at + 2)
    return [*out, data[start:]]


def luminance(picture: Picture, frame: bytes) -> np.ndarray:
    """The first component's samples, (height, width)."""
    if picture.process not in (0xC0, 0xC1) or picture.bits != 8:
        raise ValueError("this JPEG process is not supported")
    order, parts = _zigzag(), picture.parts
    first = next(iter(parts))
    alone = len(picture.scan) == 1
    high = 1 if alone else max(h for h, _, _ in parts.values())
    tall = 1 if alone else max(v for _, v, _ in parts.values())
    across, down = -(-picture.width // (8 * high)), -(-picture.height // (8 * tall))
    h0, v0 = (1, 1) if alone else parts[first][:2]
    blocks = np.zeros((down * v0, across * h0, 64))
    runs = _runs(frame[picture.size : -2])
    per_run = picture.restart or across * down
    for r, run in enumerate(runs):
        bits, before = _Bits(run), dict.fromkeys(parts, 0)
        for unit in range(r * per_run, min((r + 1) * per_run, across * down)):
            for part, (dc, ac) in picture.scan.items():
                h, v, quant = parts[part]
                for k in range(1 if alone else h * v):
                    coded = [0] * 64
                    table = picture.huffman[dc]
                    ahead = bits.peek(16)
                    bits.left -= int(table.length_at[ahead])
                    before[part] += bits.signed(int(table.symbol_at[ahead]))
                    coded[0] = before[part]
                    table, at = picture.huffman[16 + ac], 1
                    while at < 64:
                        ahead = bits.peek(16)
                        if not table.length_at[ahead]:
                            raise ValueError("an unknown Huffman code")
                        bits.left -= int(table.length_at[ahead])
                        skip, size = divmod(int(table.symbol_at[ahead]), 16)
                        if not size and skip < 15:
                            break
                        at += skip
                        if at > 63:
                            raise ValueError("a block has too many coefficients")
                        coded[at] = bits.signed(size)
                        at += 1
                    if part == first:
                        row, column = divmod(unit, across)
                        blocks[row * v0 + k // h0, column * h0 + k % h0, order] = np.array(coded) * picture.quant[quant]
    basis = _cosines()
    samples = np.einsum("kx,abkl,ly->abxy", basis, blocks.reshape(*blocks.shape[:2], 8, 8), basis)
    image = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], -1)
    return image[: picture.height, : picture.width]
