"""Force and momentum as joins over layers.

Areas are differences of prefix sums joined at both ends of a range, so their cost does not
depend on how long ranges are; the sums are decimals, so neither do their digits. Peaks and extremes join bars that lie in a range through the
bucket both fall in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars a bucket of the range join.
BUCKET = 64


def macd_areas(line: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the histogram over ranges [lo, hi] of bar_idx, clamped to what is there.

    line: stream_id, bar_idx, hist; ranges: stream_id, keys, lo, hi. Adds area_total,
    area_pos, area_neg (rounded to 6 digits) and n_bars; an empty range gives zeros.
    """
    w = Window.partitionBy("stream_id").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    exact = F.col("hist").cast("decimal(38,12)")
    nought = F.lit(0).cast("decimal(38,12)")
    sums = line.select("stream_id", "bar_idx", *[F.sum(x).over(w).alias(n) for x, n in ((exact, "t"), (F.greatest(exact, nought), "p"), (F.least(exact, nought), "m"))])
    ends = line.groupBy("stream_id").agg(F.max("bar_idx").alias("__last"))
    r = ranges.join(ends, "stream_id", "left").withColumns({"__lo": F.greatest("lo", F.lit(0)), "__hi": F.least("hi", "__last")})
    at = lambda side, key: sums.select("stream_id", F.col("bar_idx").alias(key), *[F.col(c).alias(f"{side}{c}") for c in "tpm"])
    r = r.withColumn("__before", F.col("__lo") - 1).join(at("a", "__before"), ["stream_id", "__before"], "left").join(at("b", "__hi"), ["stream_id", "__hi"], "left")
    there = F.col("__lo") <= F.col("__hi")
    area = lambda c: F.when(there, F.round((F.col(f"b{c}") - F.coalesce(F.col(f"a{c}"), nought)).cast("double"), 6)).otherwise(0.0)
    return r.select(
        "stream_id", *keys, "lo", "hi", area("t").alias("area_total"), area("p").alias("area_pos"), area("m").alias("area_neg"),
        F.when(there, F.col("__hi") - F.col("__lo") + 1).otherwise(0).cast("long").alias("n_bars"),
    )


def within(points: DataFrame, at: str, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Points whose ``at`` lies in a range [lo, hi] of their stream, joined through buckets."""
    b = lambda c: F.floor(F.col(c) / BUCKET)
    wide = ranges.select("stream_id", *keys, "lo", "hi", F.explode(F.sequence(b("lo"), b("hi"))).alias("__b"))
    return points.withColumn("__b", b(at)).join(wide, ["stream_id", "__b"]).where((F.col(at) >= F.col("lo")) & (F.col(at) <= F.col("hi"))).drop("__b")


def leg_force(strokes: DataFrame, length: int) -> DataFrame:
    """Price range times duration of every ``length`` strokes in a row."""
    w = Window.partitionBy("stream_id").orderBy("idx").rowsBetween(0, length - 1)
    out = strokes.select(
        "stream_id", "idx", "direction", F.count("*").over(w).alias("n"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"), (F.max("i1").over(w) - F.min("i0").over(w)).alias("bars")
    )
    return out.where(F.col("n") == length).select("stream_id", "idx", "direction", ((F.col("high") - F.col("low")) * F.greatest("bars", F.lit(1))).alias("force"))


def macd_force(parts: DataFrame, merged: DataFrame, line: DataFrame) -> DataFrame:
    """MACD area and peaks of each part (stream_id, idx, direction, i0, i1) over the raw bars it covers."""
    first = merged.select("stream_id", F.col("idx").alias("i0"), F.col("raw_start").alias("lo"))
    last = merged.select("stream_id", F.col("idx").alias("i1"), F.col("raw_end").alias("hi"))
    ranges = parts.select("stream_id", "idx", "direction", "i0", "i1").join(first, ["stream_id", "i0"]).join(last, ["stream_id", "i1"]).select("stream_id", "idx", "direction", "lo", "hi")
    areas = macd_areas(line.select("stream_id", "bar_idx", "hist"), ranges, ["idx", "direction"])
    up = F.col("direction") == "up"
    spans = within(line.select("stream_id", "bar_idx", "macd", "hist"), "bar_idx", ranges, ["idx", "direction"])

    def peak(c: str) -> Column:
        return F.when(F.first("direction") == "up", F.greatest(F.max(c), F.lit(0.0))).otherwise(F.abs(F.least(F.min(c), F.lit(0.0))))

    peaks = spans.groupBy("stream_id", "idx").agg(peak("macd").alias("dif_peak"), peak("hist").alias("hist_peak"))
    force = F.when(up, F.abs("area_pos")).otherwise(F.abs("area_neg"))
    return areas.join(peaks, ["stream_id", "idx"]).select("stream_id", "idx", "direction", force.alias("force"), "dif_peak", "hist_peak")
