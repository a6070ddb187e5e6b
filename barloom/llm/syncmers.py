"""Document fingerprints from closed syncmers (DataFrame functions only).

A text is read as tokens: lower-cased runs without white space, of which those over LONG
code points (unspaced scripts, encoded data) are one token a code point, so that where a token
starts never hangs on what stands far before it. A k-mer is K tokens in a row; its inner
substrings are the S-token runs in it, ordered by their MD5. The k-mer is a closed syncmer,
an anchor, if the smallest inner run is its first or its last. Whether a k-mer is chosen
depends on its own tokens only, so equal passages give equal anchors wherever they stand.
With K = 2 S the first and last run cover the k-mer, and their hashes name it.

The fingerprint is the bottom sketch of the anchors: the SKETCH smallest distinct names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S = 3
K = 2 * S
#: Anchors that a fingerprint keeps: likeness has a standard error of at most 0.5 / 8.
SKETCH = 64
#: Code points of the longest run that is one token.
LONG = 32
_CHAR = r"[^\x20\x09-\x0D]"
TOKEN = rf"(?<!{_CHAR}){_CHAR}{{1,{LONG}}}+(?!{_CHAR})|{_CHAR}"
#: Hex digits of each of the two runs in an anchor's name.
HALF = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once: a plain alias would be inlined into lambdas and evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _runs(t: Column) -> Column:
    """MD5 of every run of S tokens."""
    return F.transform(_steps(F.size(t) - (S - 1)), lambda i: F.md5(F.concat_ws(" ", *[F.get(t, i + j) for j in range(S)])))


def _is_anchor(r: Column, i: Column) -> Column:
    inner = [F.get(r, i + j) for j in range(1, K - S)]
    edge = F.least(F.get(r, i), F.get(r, i + (K - S)))
    return edge <= (F.least(*inner) if len(inner) > 1 else inner[0])


def _name(r: Column, i: Column) -> Column:
    return F.concat(F.substring(F.get(r, i), 1, HALF), F.substring(F.get(r, i + (K - S)), 1, HALF))


def _whole(t: Column) -> Column:
    """Fewer than K tokens: one anchor for all of them; none: no anchor."""
    return F.when(F.size(t) > 0, F.array(F.substring(F.md5(F.concat_ws(" ", t)), 1, 2 * HALF))).otherwise(F.array().cast("array<string>"))


def anchors(text: Column) -> Column:
    """Array of (pos, name): the token position and name of every closed syncmer, in order."""
    empty = F.array().cast("array<struct<pos:int,name:string>>")

    def found(t: Column) -> Column:
        many = let(
            _runs(t),
            lambda r: F.transform(
                F.filter(_steps(F.size(r) - (K - S)), lambda i: _is_anchor(r, i)), lambda i: F.struct(i.alias("pos"), _name(r, i).alias("name"))
            ),
        )
        one = F.transform(_whole(t), lambda x: F.struct(F.lit(0).alias("pos"), x.alias("name")))
        return F.when(F.size(t) >= K, many).when(F.size(t) > 0, one).otherwise(empty)

    return let(tokens(text), found)


def sketch(text: Column) -> Column:
    """The SKETCH smallest distinct anchor names, sorted. Null and empty texts: an empty array."""

    def found(t: Column) -> Column:
        many = let(_runs(t), lambda r: F.transform(F.filter(_steps(F.size(r) - (K - S)), lambda i: _is_anchor(r, i)), lambda i: _name(r, i)))
        return F.when(F.size(t) >= K, many).otherwise(_whole(t))

    return F.slice(F.sort_array(F.array_distinct(let(tokens(text), found))), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches, 0 to 1; two empty ones are alike (1)."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def anchor_rows(docs: DataFrame) -> DataFrame:
    """One row an anchor: (doc_id, pos, name)."""
    return docs.select("doc_id", F.explode(anchors(F.col("text"))).alias("a")).select("doc_id", "a.pos", "a.name")


def positional_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Passages that queries share with documents: anchors of one name on one diagonal.

    Returns (query_id, doc_id, shift, n_anchors, query_from, query_to), tokens counted from 0.
    """
    q, d = anchor_rows(queries), anchor_rows(docs)
    met = q.select(F.col("doc_id").alias("query_id"), F.col("pos").alias("q"), "name").join(d, "name")
    return (
        met.groupBy("query_id", "doc_id", (F.col("pos") - F.col("q")).alias("shift"))
        .agg(F.count("*").alias("n_anchors"), F.min("q").alias("query_from"), (F.max("q") + K - 1).alias("query_to"))
    )


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``next_<c>`` of the next row by descending doc_id (nulls last; after the last, the first).

    Rows fall into ranges of doc_id whose upper bounds are ids that occur (approximate
    percentiles, as many as there are buckets). A row at a bound is also handed to the range
    above as that range's successor, so each range is finished by itself and rows move once.
    Rows of equal doc_id are ordered by ``columns``.
    """
    spark = docs.sparkSession
    n = buckets or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] + [1.0], max(10_000, 20 * n)).alias("p"), F.max("doc_id").alias("m")).first()
    bounds = sorted({*(found["p"] or []), *([] if found["m"] is None else [found["m"]])})
    ids = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bits = max(1, len(bounds)).bit_length()
    below = F.aggregate(
        F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), lambda at, step: F.when(F.get(ids, at + step - 1) < F.col("doc_id"), at + step).otherwise(at)
    )
    at = F.coalesce(below, F.lit(0))
    ends = F.coalesce(F.array_contains(ids, F.col("doc_id")) if bounds else F.col("doc_id").isNull(), F.lit(False))
    own = F.struct(F.col("__at").alias("b"), F.lit(0).alias("ghost"))
    above = F.when(F.col("__at") + 1 >= max(1, len(bounds)), F.lit(0)).otherwise(F.col("__at") + 1)
    ghost = F.struct(above.alias("b"), F.lit(1).alias("ghost"))
    dealt = docs.withColumn("__at", at).withColumn("__x", F.explode(F.when(ends, F.array(own, ghost)).otherwise(F.array(own))))
    dealt = dealt.withColumns({"__b": F.col("__x.b"), "__g": F.col("__x.ghost")}).drop("__at", "__x")
    order = Window.partitionBy("__b").orderBy("__g", F.col("doc_id").desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in columns])
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(F.col("__g") == 0).drop("__b", "__g")


def edit_probe(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, and of its edited text, and how they compare.

    Needs ``doc_id`` and ``text``. The edited text has the last third (floor) of its code
    points replaced by the first as many of the next document's text. Null text: empty.
    Repeated doc_ids: every row is kept, ordered by text. Empty table: no rows.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text")))
    rows = with_next(base, ["text", "sketch"])
    n = F.char_length("text")
    tail = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
