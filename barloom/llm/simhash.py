"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits come from 3-word shingles. Two fingerprints link at LIMIT or
fewer differing bits. Of two halves of 32 bits one then differs in at most one bit, so the
ball of radius 1 round a half finds the other's half in the table of halves. Only keys with
one set bit cleared are enumerated: of two keys that differ in one bit, clearing the bit in
the one that has it gives the other.

Texts with one fingerprint are one node throughout, so copies are never paired. A key that
very many different fingerprints share (templates, near copies by the thousand) is refined:
its pairs are looked up by the key and a quarter of the other half, with balls again, which
is exact because the other half has what is left of LIMIT at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from barloom.llm.components import connected_components
from barloom.session import checkpointed, ship_package

LIMIT = 3
SHINGLE = 3
SEED = 42
#: Fingerprints that share a key before the key is refined.
WIDE = 256
#: Hashes whose bits are counted at once, to bound memory on very long texts.
BLOCK = 1 << 15


def simhash(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a text; null, empty and blank texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])), np.uint64, len(words) - SHINGLE + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series(np.array([simhash(t) for t in part], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, column: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long (same bits)."""
    ship_package(docs.sparkSession)
    return docs.withColumn(column, _fingerprints("text"))


def _cleared(value: Column, bits: int) -> Column:
    """``value`` with each of its set bits cleared in turn."""
    one = F.array(*[F.lit(1 << i).cast("long") for i in range(bits)])
    return F.transform(F.filter(one, lambda b: value.bitwiseAND(b) != 0), lambda b: value.bitwiseXOR(b))


def _met(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Pairs whose keys meet and whose fingerprints are near; a is the probe's."""
    met = probe.join(index, "key").where((F.col("ball") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT))
    return met.select("a", "b")


def near_pairs(prints: DataFrame, wide: int = WIDE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` at LIMIT or fewer differing bits."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = prints.select(
        "fp", F.explode(F.array(F.struct(F.lit(0).alias("h"), high.alias("half"), low.alias("rest")), F.struct(F.lit(1).alias("h"), low.alias("half"), high.alias("rest")))).alias("x")
    ).select("fp", "x.h", "x.half", "x.rest")
    key = F.col("half").bitwiseXOR(F.col("h").cast("long") * F.lit(1 << 32))
    index = halves.select(key.alias("key"), F.col("fp").alias("b"), "rest")
    own = F.array(F.struct(F.col("half").alias("half"), F.lit(False).alias("ball")))
    balls = F.transform(_cleared(F.col("half"), 32), lambda x: F.struct(x.alias("half"), F.lit(True).alias("ball")))
    probe = halves.select("fp", "h", "rest", F.explode(F.concat(own, balls)).alias("x")).select(
        F.col("x.half").bitwiseXOR(F.col("h").cast("long") * F.lit(1 << 32)).alias("key"), F.col("fp").alias("a"), "rest", "x.ball"
    )
    crowded = checkpointed(index.groupBy("key").count().where(F.col("count") > wide).select("key"))
    pairs = _met(index.join(crowded, "key", "left_anti").drop("rest"), probe.drop("rest"))
    if crowded.isEmpty():
        return pairs

    def quarters(side: DataFrame, ball: bool) -> DataFrame:
        """Keys of (key, which quarter of the rest, its 16 bits); for probes with the ball of radius 1."""
        wanted = side.join(crowded, "key", "left_semi")
        parts = F.array(*[F.struct(F.lit(q).alias("q"), F.shiftright("rest", 16 * q).bitwiseAND(F.lit(0xFFFF)).alias("v")) for q in (0, 1)])
        out = wanted.withColumn("p", F.explode(parts)).withColumns({"q": F.col("p.q"), "v": F.col("p.v")})
        if ball:
            one = F.transform(F.array(*[F.lit(1 << i).cast("long") for i in range(16)]), lambda b: F.col("v").bitwiseXOR(b))
            out = out.withColumn("v", F.explode(F.concat(F.array("v"), one)))
        return out.withColumn("key", F.struct("key", "q", "v")).drop("p", "q", "v", "rest")

    return pairs.union(_met(quarters(index, False), quarters(probe, True)))


def near_components(prints: DataFrame) -> DataFrame:
    """(fp, c, component_id) for rows of (doc_id, fp).

    component_id is the smallest doc_id that links reach (null if all are null), c the
    smallest fingerprint, which names the component.
    """
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(near_pairs(nodes.select("fp")))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    return labelled.join(least, "c").select("fp", "c", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for every row of ``docs``.

    Needs ``doc_id`` and ``text``. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Repeated rows stay rows. Empty table: no rows.
    """
    prints = checkpointed(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    found = near_components(prints)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` a component, with its columns: that of the smallest doc_id.

    Rows that repeat that doc_id with a fingerprint of the component: one of them stays, by
    text hash. Null doc_ids count as larger than all.
    """
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]
    prints = checkpointed(with_fingerprint(docs.select("doc_id", "text")).select(F.struct(*key).alias("k"), "doc_id", "fp"))
    found = near_components(prints)
    best = prints.groupBy("fp").agg(F.min("k").alias("k")).join(found, "fp").groupBy("c").agg(F.min("k").alias("k"))
    rows = docs.withColumn("__k", F.struct(*key)).join(best.select(F.col("k").alias("__k")), "__k", "left_semi")
    return rows.dropDuplicates(["__k"]).drop("__k")
