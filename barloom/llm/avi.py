"""AVI files of motion-JPEG frames: RIFF structure, lossless JPEG intra frames, shots.

Frames that are written here are lossless JPEG (ITU-T T.81, process 14, SOF3): 8-bit grey samples, each coded as
its difference from the sample to the left (from the one above at the start of a line).
Coding is vectorised over frames: all frames of a block are entropy-decoded in step, one
sample of each at a time. Baseline frames of other writers are decoded to their luminance.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from barloom.llm.jpeg import luminance

SIDE = 24
SAMPLES = SIDE * SIDE
FPS = 25
#: Huffman code lengths of the difference categories 0 to 8, made for text (letters differ by 4 to 6 bits).
LENGTHS = (4, 5, 4, 3, 2, 2, 3, 5, 5)
#: Frames decoded in step.
STEP_FRAMES = 4096


def canonical(lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(symbols by code, counts of lengths 1 to 16, code of each symbol) of a canonical Huffman table."""
    order = sorted(range(len(lengths)), key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths) for k in range(1, 17)]
    codes, code, size = [0] * len(lengths), 0, lengths[order[0]]
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s] = code
        code += 1
    return order, counts, codes


ORDER, COUNTS, CODES = canonical(LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0, *COUNTS, *ORDER]))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)
TAIL = b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG bytes of each frame of a (frames, SIDE, SIDE) array of uint8."""
    n = len(samples)
    if n == 0:
        return []
    s = samples.astype(np.int16)
    diff = np.empty_like(s)
    diff[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    diff[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    diff[:, 0, 0] = s[:, 0, 0] - 128
    d = diff.reshape(n, SAMPLES).astype(np.int32)
    category = _CATEGORY[np.abs(d)]
    extra = np.where(d > 0, d, d + (1 << category) - 1)
    value = _CODE[category] << category | extra
    length = _LENGTH[category] + category
    ends = np.cumsum(length, axis=1)
    size = (ends[:, -1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    at = ends - length + 8 * first[:-1, None]
    word = (value << (24 - (at & 7) - length)).ravel()
    byte = (at >> 3).ravel()
    total = int(first[-1])
    data = np.zeros(total + 3)
    for k in range(3):
        data[k : k + total] += np.bincount(byte, (word >> (16 - 8 * k)) & 255, total)[:total]
    data = data[:total].astype(np.uint8)
    spare = (8 * size - ends[:, -1]).astype(np.int64)
    data[first[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # the last byte is filled up with ones
    stuffed = np.flatnonzero(data == 255)
    raw = np.insert(data, stuffed + 1, 0).tobytes()
    cut = first + np.searchsorted(stuffed, first)
    return [HEAD + raw[a:b] + TAIL for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


_CATEGORY = np.array([x.bit_length() for x in range(512)], np.int32)
_CODE, _LENGTH = np.array(CODES, np.int32), np.array(LENGTHS, np.int32)


@dataclass(frozen=True)
class Frame:
    """What decoding needs of a frame: its size, its Huffman table and its entropy-coded bytes."""

    height: int
    width: int
    table: bytes
    data: bytes


def parse_frame(jpeg: bytes) -> Frame | bytes:
    """Read markers up to the scan of a one-component 8-bit lossless frame with left prediction.

    Baseline frames are returned as they are, for their luminance; other kinds raise ValueError.
    """
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, size, table = 2, (0, 0), b""
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("broken JPEG markers")
        marker, length = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("not 8-bit grey")
            size = struct.unpack(">HH", body[1:5])
        elif marker in (0xC0, 0xC1):
            return jpeg
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a lossless JPEG")
        elif marker == 0xC4:
            table = body[1:]
        elif marker == 0xDA:
            if body[0] != 1 or body[3] != 1 or body[5] != 0:
                raise ValueError("not left prediction")
            end = jpeg.rfind(b"\xff\xd9")
            return Frame(*size, table, jpeg[at : end if end >= at else len(jpeg)].replace(b"\xff\x00", b"\xff"))


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: category << 8 | code length; 0 where no code starts so."""
    out = np.zeros(1 << 16, np.int32)
    counts, symbols = table[:16], table[16:]
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k] << 8 | length
            code += 1
            k += 1
        code <<= 1
    return out


def decode_frames(frames: list[Frame | bytes]) -> list[np.ndarray]:
    """Samples of each frame; lossless ones in step over frames of one size and table, baseline ones by themselves."""
    out: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        if isinstance(f, bytes):
            out[i] = luminance(f)
            continue
        groups.setdefault((f.height, f.width, f.table), []).append(i)
    for (height, width, table), members in groups.items():
        lookup = _lookup(table)
        for a in range(0, len(members), STEP_FRAMES):
            part = members[a : a + STEP_FRAMES]
            found = _in_step([frames[i].data for i in part], lookup, height, width)
            for i, samples in zip(part, found):
                out[i] = samples
    return out


def _in_step(data: list[bytes], lookup: np.ndarray, height: int, width: int) -> np.ndarray:
    flat = np.frombuffer(b"\xff\xff\xff\xff".join([*data, b""]) + b"\xff\xff\xff\xff", np.uint8).astype(np.uint32)
    window = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    at = 8 * (np.cumsum(sizes + 4) - sizes - 4)
    limit = at + 8 * sizes
    diff = np.empty((height * width, len(data)), np.int32)
    for k in range(height * width):
        bits = window[at >> 3] << (at & 7).astype(np.uint32)
        entry = lookup[bits >> 16]
        length, category = entry & 255, entry >> 8
        extra = ((bits << length.astype(np.uint32)) >> 1 >> (31 - category).astype(np.uint32)).astype(np.int32)
        diff[k] = np.where(extra >> np.maximum(category - 1, 0) & 1, extra, extra - (1 << category) + 1)
        at += length + category
        if not length.all():
            raise ValueError("broken entropy code")
    if (at > limit).any():
        raise ValueError("frame data end early")
    d = diff.T.reshape(len(data), height, width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file with one motion-JPEG stream and an idx1 index."""
    n, largest = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + strl)
    bodies, entries, at = [], [], 4
    for f in frames:
        bodies.append(_chunk(b"00dc", f))
        entries.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(bodies[-1])
    movi = _chunk(b"LIST", b"movi" + b"".join(bodies))
    return _chunk(b"RIFF", b"AVI " + header + movi + _chunk(b"idx1", b"".join(entries)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, body start, body end) of the chunks in data[at:end]."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            raise ValueError("chunk runs past its parent")
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, JPEG bytes of the video frames), by the index if there is one, else by the chunks of the movie list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = 0.0, None, None
    for name, a, b in _chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, _ in _chunks(data, a + 4, b):
                if inner == b"avih":
                    rate = 1_000_000 / max(1, int.from_bytes(data[c : c + 4], "little"))
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        raise ValueError("no movie list")
    if index is None:
        return rate, [data[a:b] for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    out = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[1] - (index[1] - index[0]) % 16]):
        if name[2:] in (b"dc", b"db"):
            start = movi[0] + offset
            if data[start : start + 4] != name:
                start = offset  # some writers count from the start of the file
            if data[start : start + 4] != name:
                raise ValueError("index points at no frame")
            out.append(data[start + 8 : start + 8 + size])
    return rate, out


#: A histogram has so many bins; a cut needs a difference over LEAST of all samples and over RISE times the mean of up to BEFORE differences in its shot.
BINS, LEAST, RISE, BEFORE = 16, 0.12, 1.6, 8


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, last frame) of each shot, by adaptive histogram differences. No frames: no shots.

    The threshold follows the differences of the shot at hand, so busy and calm passages are
    cut alike. Integers throughout, so equal frames give equal shots on any machine.
    """
    if len(histograms) == 0:
        return []
    diffs = (np.abs(np.diff(histograms.astype(np.int64), axis=0)).sum(axis=1) // 2).tolist()
    floor = int(LEAST * histograms[0].sum())
    rise = int(100 * RISE)
    starts, recent = [0], []
    for i, d in enumerate(diffs, 1):
        if recent and d > floor and 100 * d * len(recent) > rise * sum(recent):
            starts.append(i)
            recent = []
        else:
            recent = [*recent[1 - BEFORE :], d]
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(histograms)])]
