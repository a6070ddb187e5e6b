"""Events of several timeframes at once, and reading them by offset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.bars import resample
from barloom.operators.events import event_log
from barloom.operators.invariants import violations
from barloom.operators.layers import Settings


def in_timeframes(bars: DataFrame, tfs: list[str]) -> DataFrame:
    """Bars of every timeframe in one table: stream_id is stream@timeframe, so each is a stream of its own."""
    wide = [resample(bars, tf).withColumns({"symbol": F.col("stream_id"), "tf": F.lit(tf)}).withColumn("stream_id", F.concat_ws("@", "stream_id", F.lit(tf))) for tf in tfs]
    return reduce(DataFrame.unionByName, wide)


def multi_tf_log(bars: DataFrame, tfs: list[str], settings: Settings = Settings(reach=False)) -> DataFrame:
    """Event logs of all timeframes from one fold, on the clock of the first, the base.

    ``step`` is the base bar at which an event is known when higher bars count from their
    start on: the first base bar not before it. ``tag`` is L and the level above 1, else the timeframe.
    """
    every = in_timeframes(bars, tfs)
    log = event_log(every, settings).withColumns({"symbol": F.element_at(F.split("stream_id", "@"), 1), "tf": F.element_at(F.split("stream_id", "@"), 2)})
    base = every.where(F.col("tf") == tfs[0]).select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).alias("step"))
    ahead = Window.partitionBy("symbol").orderBy("us").rangeBetween(0, Window.unboundedFollowing)
    both = log.withColumn("us", F.round(F.col("bar_ts") * 1_000_000).cast("long")).unionByName(base, allowMissingColumns=True)
    out = both.withColumn("step", F.min("step").over(ahead).cast("long")).where("event_type is not null").drop("us")
    return out.withColumn("tag", F.when(F.col("level_id") > 1, F.concat(F.lit("L"), F.col("level_id").cast("string"))).otherwise(F.col("tf")))


def by_level(log: DataFrame) -> DataFrame:
    """Events as a bus of levels takes them: all under the tag L1, and those of level 2 and up once more under their own."""
    above = log.where("level_id > 1").withColumn("tag", F.concat(F.lit("L"), F.col("level_id").cast("string")))
    return log.withColumn("tag", F.lit("L1")).unionByName(above)


def counts(tagged: DataFrame) -> DataFrame:
    """How many events a bus holds, by stream and tag."""
    return tagged.groupBy("stream_id", "tag").agg(F.count("*").alias("n"))


def drained(log: DataFrame, after: int, upto: int, tag: str | None = None, stream: str | None = None) -> DataFrame:
    """Events of steps in (after, upto], of one tag or stream if given, in order."""
    out = log.where((F.col("step") > after) & (F.col("step") <= upto))
    out = out if tag is None else out.where(F.col("tag") == tag)
    out = out if stream is None else out.where(F.col("stream_id") == stream)
    return out.orderBy("step", "stream_id", "bar_idx", "layer", "level_id", "seq")


def metrics(bars: DataFrame, log: DataFrame) -> DataFrame:
    """What was processed, one row a stream: bars, events, violations, last bar."""
    seen = bars.groupBy("stream_id").agg(F.count("*").alias("bars_processed"), F.max("ts").alias("last_bar"))
    said = log.groupBy("stream_id").agg(F.count("*").alias("events_total"))
    broken = violations(log).groupBy("stream_id").agg(F.count("*").alias("violations_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seen.join(said, "stream_id", "left").join(broken, "stream_id", "left").select("stream_id", "bars_processed", "last_bar", zero("events_total"), zero("violations_total"))
