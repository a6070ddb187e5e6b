"""Hashed n-grams of many texts at once, for the trained classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import ship_package

#: Code points handled at once: bounds a worker's memory whatever the lengths of texts.
BLOCK_CHARS = 1_000_000
#: Bound on the code points of the labelled texts that a fit reads.
CHARS = 40_000_000
_MIX = np.uint32(2654435761)
_STEP = np.uint32(16777619)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of code points, each run of white space one space and one round each text; and where each ends."""
    joined = [" " + " ".join(t.split()) + " " for t in texts]
    ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
    return np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def char_grams(chars: np.ndarray, least: int, most: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each n the hashed bucket of the n-gram that starts at each place (the last n - 1 places left out)."""
    h = chars * _STEP + np.uint32(7)
    for n in range(2, most + 1):
        if len(chars) < n:
            return
        h = h[:-1] * _STEP ^ chars[n - 1 :]
        if n >= least:
            mixed = h * _MIX
            yield n, ((mixed ^ (mixed >> np.uint32(15))) * _MIX) >> np.uint32(32 - bits)


def blocks(texts: list[str]) -> Iterator[list[int]]:
    """Row numbers in blocks of about BLOCK_CHARS code points; a longer text is a block of its own."""
    block: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(i)
        size += len(t)
    if block:
        yield block


def held_out(doc_id) -> object:
    """Column: crc32 of doc_id as text, mod 5, is 0. A null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, chars: int = CHARS) -> DataFrame:
    """(doc_id, text, y): at most ``most`` labelled rows that are not held out, of ``chars`` code points together at most.

    Which rows: the first by a hash of doc_id, drawn from the table of labels before any text
    is read, up to the row at which the texts reach ``chars``; so rows and bytes are bounded
    whatever the size of the corpus, and the one task that orders them has no more. A doc_id
    that repeats counts once; null doc_ids, labels and texts are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    place = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    drawn = usable.orderBy(*place).limit(most)
    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    rows = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    so_far = F.sum(F.char_length("text")).over(Window.orderBy(*place))
    return rows.withColumn("__c", so_far).where(F.col("__c") <= chars).select("doc_id", "text", "y")


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """What ``fit`` makes of the (text, y) pairs of a bounded sample, ordered by doc_id.

    One task of an executor fits (and does so again if the executor is lost); only the model comes
    to the driver.
    """
    ship_package(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        rows.sort(key=lambda row: row[0])
        model = pickle.dumps(fit([row[1:] for row in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    model = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(model[0][0]) if model else fit([])
