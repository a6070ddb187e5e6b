"""Baseline JPEG frames (ITU-T T.81, SOF0 and SOF1, Huffman): their luminance plane.

Motion-JPEG writers often leave out the Huffman tables; the standard's example tables then hold.
"""

from __future__ import annotations

import struct

import numpy as np

_BASIS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Places of the 64 coefficients in the order of the scan: along diagonals, turning at the edges.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _symbols(head: str) -> list[int]:
    """The listed symbols, then all other (run, size) pairs with sizes 1 to 10 in ascending order."""
    first = list(bytes.fromhex(head))
    return first + [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in first]


# The example Huffman tables of the standard, as (number of codes of each length, symbols).
STANDARD = {
    (0, 0): ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))),
    (0, 1): ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12))),
    (1, 0): (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        _symbols("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a"),
    ),
    (1, 1): (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        _symbols("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
    ),
}


def codes(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code += 1
            k += 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value = int.from_bytes(data, "big")
        self.left = 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("scan ends early")
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            found = table.get((length, code))
            if found is not None:
                return found
        raise ValueError("broken Huffman code")

    def number(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def luminance(jpeg: bytes) -> np.ndarray:
    """The first component as 8-bit samples. Other processes than baseline raise ValueError."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quant: dict[int, np.ndarray] = {}
    huffman = {k: codes(*v) for k, v in STANDARD.items()}
    parts: list[tuple[int, int, int, int]] = []
    height = width = restart = 0
    at = 2
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("broken JPEG markers")
        marker, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(float)
                body = body[1 + size :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8:
                raise ValueError("not 8-bit")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                huffman[body[0] >> 4, body[0] & 15] = codes(counts, list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDA:
            break
    if not parts or body[0] != len(parts):
        raise ValueError("not one scan of all components")
    tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    end = jpeg.rfind(b"\xff\xd9")
    pieces = _restarts(jpeg[at : end if end >= at else len(jpeg)])
    across, down = max(h for _, h, _, _ in parts), max(v for _, _, v, _ in parts)
    if len(parts) == 1:
        parts, across, down = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    h0, v0 = parts[0][1], parts[0][2]
    plane = np.zeros((rows * v0 * 8, columns * h0 * 8))
    bits, before = _Bits(pieces[0]), [0] * len(parts)
    for m in range(rows * columns):
        if restart and m and m % restart == 0:
            bits, before = _Bits(pieces[m // restart]), [0] * len(parts)
        for i, (name, h, v, q) in enumerate(parts):
            dc, ac = tables[name]
            for k in range(h * v):
                block = np.zeros(64)
                before[i] += bits.number(bits.symbol(huffman[0, dc]))
                block[0] = before[i]
                j = 1
                while j < 64:
                    symbol = bits.symbol(huffman[1, ac])
                    if symbol == 0:
                        break
                    j += symbol >> 4
                    if symbol & 15:
                        if j > 63:
                            raise ValueError("broken block")
                        block[j] = bits.number(symbol & 15)
                    j += 1
                if i == 0:
                    square = np.zeros(64)
                    square[ZIGZAG] = block * quant[q]
                    y, x = (m // columns * v + k // h) * 8, (m % columns * h + k % h) * 8
                    plane[y : y + 8, x : x + 8] = _BASIS.T @ square.reshape(8, 8) @ _BASIS
    # a first component with fewer samples than others is spread out
    plane = plane.repeat(down // v0, axis=0).repeat(across // h0, axis=1)
    return np.clip(np.rint(plane[:height, :width] + 128), 0, 255).astype(np.uint8)


def _restarts(data: bytes) -> list[bytes]:
    """Entropy-coded bytes between restart markers, without stuffing."""
    out, at, start = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            start = at + 2
        at += 2
    return [*out, data[start:].replace(b"\xff\x00", b"\xff")]
