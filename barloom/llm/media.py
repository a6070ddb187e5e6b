"""Media columns: payloads in AVI motion-JPEG files, and timed clips found in them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from barloom.llm.avi import BINS, SAMPLES, SIDE, decode_frames, encode_frames, parse_frame, read_avi, shots, write_avi
from barloom.session import ship_package

#: Payload bytes handled at once; a longer payload is a block of its own.
BLOCK = 2_000_000
FILL = b"\xff"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes filled up with 255 to a positive multiple of a frame's samples."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + FILL * (-len(raw) % SAMPLES if raw else SAMPLES)


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload, one sample a byte."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE)
    frames = encode_frames(samples)
    out, at = [], 0
    for p in payloads:
        n = len(p) // SAMPLES
        out.append(write_avi(frames[at : at + n]))
        at += n
    return out


def read_back(files: list[bytes]) -> list[tuple[float, list[np.ndarray]]]:
    """(frames a second, decoded frames) of each file; frames of all files are decoded together."""
    parsed = [read_avi(f) for f in files]
    frames = decode_frames([parse_frame(j) for _, jpegs in parsed for j in jpegs])
    out, at = [], 0
    for rate, jpegs in parsed:
        out.append((rate, frames[at : at + len(jpegs)]))
        at += len(jpegs)
    return out


def clips_of(rate: float, frames: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
    """(first frame, last frame, start, end in seconds) of each shot."""
    counts = np.array([np.bincount(f.ravel() >> 4, minlength=BINS) for f in frames]).reshape(-1, BINS)
    return [(a, b, a / rate, (b + 1) / rate) for a, b in shots(counts)]


def _blocks(parts: list[bytes]) -> Iterator[slice]:
    start = size = 0
    for i, p in enumerate(parts):
        if i > start and size + len(p) > BLOCK:
            yield slice(start, i)
            start, size = i, 0
        size += len(p)
    if start < len(parts):
        yield slice(start, len(parts))


def with_media(docs: DataFrame, column: str = "media") -> DataFrame:
    """Add the AVI file that holds each row's text; null counts as empty."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(BinaryType())
    def avi(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            payloads = [payload_of(t) for t in part]
            yield pd.Series([f for block in _blocks(payloads) for f in store(payloads[block])], dtype=object)

    return docs.withColumn(column, avi("text"))


def clips(media: DataFrame, column: str = "media") -> DataFrame:
    """One row a clip: the other columns, clip (from 0), first_frame, last_frame, start_s, end_s.

    A null file has no clips. A file that is no AVI, or whose frames are of another kind, has
    one row with a null clip and the reason in ``error``.
    """
    ship_package(media.sparkSession)
    made = ["clip", "first_frame", "last_frame", "start_s", "end_s", "error"]

    @F.pandas_udf("array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,error:string>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for f in part:
                try:
                    rows = [] if f is None else clips_of(*read_back([bytes(f)])[0])
                    out.append([dict(zip(made, (i, *row, None))) for i, row in enumerate(rows)])
                except (ValueError, IndexError) as e:
                    out.append([dict.fromkeys(made) | {"error": str(e)}])
            yield pd.Series(out, dtype=object)

    kept = [c for c in media.columns if c not in {column, *made}]
    return media.select(*kept, F.explode(found(column)).alias("__c")).select(*kept, "__c.*")


def probe(docs: DataFrame) -> DataFrame:
    """Store each text in an AVI file, read it back, and digest both; one row for every row.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature); feature lists the clips found as first-last@seconds, comma-joined.
    """
    ship_package(docs.sparkSession)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    @F.pandas_udf("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            payloads = [payload_of(t) for t in part]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in part]
            rows = []
            for block in _blocks(payloads):
                files = store(payloads[block])
                for n, f, (rate, frames) in zip(sizes[block], files, read_back(files)):
                    back = b"".join(x.tobytes() for x in frames)
                    feature = ",".join(f"{a}-{b}@{t:.2f}" for a, b, t, _ in clips_of(rate, frames))
                    rows.append((n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(f), sha256(f).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
