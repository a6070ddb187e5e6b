"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Each source gets a target number of words; its documents, in a seeded hash order, are
laid end to end over repeated passes until the target is met. Every source also has a
weight schedule over training time; the integral of the schedule is the source's
cumulative demand, and inverting it at a document's place gives its training position.

Running sums are two-level: documents fall into hash buckets within their source, bucket
totals are summed first, and windows only ever see one bucket, so that a source with a
third of all rows is spread over the cluster. Only the table of sources (one row a
source) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word of the size: a run of anything but space, tab, newlines, vertical tab, form feed.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that a bucket, which one task orders, has on average at most; and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64


def words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of sources by capped sharing.

    ``sizes``: one row a source with ``source`` and ``source_size``. Sources by code point,
    null last, take ``weights`` in turn and share ``share`` times the sum of sizes by weight.
    A source stops at ``cap`` times its size and the excess is reshared, which has the closed
    form min(cap * size, level * weight); the level is found by ordering sources by the level
    at which each is full. Adds ``rank`` (from 0), ``weight`` and ``target`` (double).
    """
    everything = Window.partitionBy()
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.withColumn("rank", (F.row_number().over(by_code) - 1).cast("long"))
        .withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int")))
        .withColumn("full", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    filling = Window.orderBy(F.col("full") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("full").over(filling), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    level = ranked.withColumn("level", (F.col("total") - spent) / (F.col("all_weight") - used))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "rank", "level")))
    return level.withColumn("level", first.over(everything)["level"]).select(
        "source", "source_size", "rank", "weight", F.coalesce(F.least("full", F.col("level") * F.col("weight")), F.col("full")).alias("target")
    )


def training_time(done: Column, ramp: Column) -> Column:
    """Time in [0, 1] at which a source has met the part ``done`` of its demand.

    The weight at time t is 1 + ramp * (2t - 1), so demand is (1 - ramp) t + ramp t^2;
    this is the inverse of that integral.
    """
    straight = 1 - ramp
    root = F.sqrt(F.greatest(straight * straight + 4 * ramp * done, F.lit(0.0)))
    return F.when(ramp == 0, done).otherwise((root - straight) / (2 * ramp))


def _mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    ramps: tuple[float, ...] = (0.5, 0.0, -0.5),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    buckets: int | None = None,
) -> DataFrame:
    """What ``mix`` says, and ``__times``: the training time of each pass, null if not taken."""
    # the order of the rows does not hang on the number of buckets: a bucket is a range of it
    buckets = buckets or max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    made = ["size", "source_size", "target", "taken", "copies", "position", "position_2"]
    kept = [c for c in docs.columns if c not in made]
    order = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    bucket = F.floor(F.shiftright(order, 30) * buckets / F.lit(1 << 30)).cast("int")
    size = words(F.col("text"))
    rows = docs.select(*kept, size.alias("size"), order.alias("__o"), key.alias("__k"), F.xxhash64("text").alias("__t"), bucket.alias("__b"))
    parts = docs.select("source", size.alias("size"), key.alias("__k"), bucket.alias("__b"))
    parts = parts.groupBy("__k", "source", "__b").agg(F.sum("size").alias("__n"))
    sources = source_targets(parts.groupBy("source").agg(F.sum("__n").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("__k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.drop("source").withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long")).drop("__n")
    offsets = offsets.join(sources, "__k")

    running = Window.partitionBy("__k", "__b").orderBy("__o", "doc_id", "size", "__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(offsets, ["__k", "__b"]).withColumn("__at", F.col("__before") + F.sum("size").over(running) - F.col("size"))
    quota = F.floor(F.col("target") + 0.5).cast("long")
    ramp = F.get(F.array(*[F.lit(float(r)) for r in ramps]), (F.col("rank") % len(ramps)).cast("int"))

    def cut(start: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), quota - start))

    def position(start: Column, part: Column) -> Column:
        done = (start + part / 2) / F.col("target")
        return F.when(part > 0, training_time(F.least(done, F.lit(1.0)), ramp))

    passes = int(-(-cap // 1))
    placed = placed.withColumns({f"__p{i}": cut(F.col("__at") + i * F.col("source_size")) for i in range(passes)})
    taken = sum((F.col(f"__p{i}") for i in range(1, passes)), F.col("__p0"))
    whole = [((F.col(f"__p{i}") > 0) & (2 * F.col(f"__p{i}") >= F.col("size"))).cast("int") for i in range(passes)]
    copies = sum(whole[1:], whole[0])
    times = [position(F.col("__at") + i * F.col("source_size"), F.col(f"__p{i}")) for i in range(passes)]
    second = times[1] if passes > 1 else F.lit(None).cast("double")
    return placed.select(
        *kept, "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), times[0].alias("position"), second.alias("position_2"), F.array(*times).alias("__times")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    ramps: tuple[float, ...] = (0.5, 0.0, -0.5),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    buckets: int | None = None,
) -> DataFrame:
    """Add to each row what the mix takes of it and when training meets it.

    Needs ``doc_id``, ``text`` and ``source``; other columns pass through, and those called
    like an added one are replaced. Adds ``size``, ``source_size``, ``target``, ``taken``
    (long: words taken, repeats counted, at most ``cap`` times the size, summing to the
    rounded target in each source), ``copies`` (passes that take half of it at least: how
    often a mix of whole texts has it) and
    ``position``, ``position_2`` (training time from 0 to 1 at which each pass meets it, null if not taken).

    Null text: size 0, taken 0. Null source: a source of its own, last. Null or repeated
    doc_ids: ordered by size and text hash, every row counted. Empty table: no rows.
    Reruns agree, whatever the partitions.
    """
    return _mixed(docs, weights, ramps, share, cap, seed, buckets).drop("__times")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sort by position over the cluster; rows not taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def mixed_rows(docs: DataFrame, **schedule) -> DataFrame:
    """The mix itself in whole texts: each row as often as the mix takes it, with its columns, whatever their names.

    Each copy stands at the training time of its own pass: the rows are range-sorted by it, then by doc_id.
    """
    mixed = _mixed(docs.select("doc_id", "text", "source", F.struct("*").alias("__row")), **schedule)
    each = mixed.where("copies > 0").select("__row", "doc_id", F.posexplode(F.slice("__times", F.lit(1), F.col("copies"))).alias("__pass", "__time"))
    return each.orderBy(F.col("__time").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "__pass").select("__row.*")
