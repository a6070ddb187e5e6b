"""Bars from the event, order and part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.bars import tick_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, tf: str = "1h", stream: str = "event_type") -> DataFrame:
    """Bars of event values in whole cents, one stream an event type (or another column)."""
    ticks = table(spark, sf_dir, "events").select("ts", "event_id", F.col(stream).alias("stream"), F.round(F.col("value") * 100).cast("long").alias("price"))
    return tick_bars(ticks, tf, "stream", "price", ("ts", "event_id"))


def walk_bars(spark: SparkSession, sf_dir: str, tf: str = "1h", stream: str = "event_type") -> DataFrame:
    """Bars of a random walk: 1,000,000 cents plus the running sum of event values, added for even ids, taken off for odd ones.

    The running sum is ordered within a stream, so a stream is summed by one task.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    order = Window.partitionBy("stream").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ticks = table(spark, sf_dir, "events").select("ts", "event_id", F.col(stream).alias("stream"), F.when(F.col("event_id") % 2 == 0, cents).otherwise(-cents).alias("step"))
    ticks = ticks.withColumn("price", F.lit(1_000_000) + F.sum("step").over(order))
    return tick_bars(ticks, tf, "stream", "price", ("ts", "event_id"))


def leg_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 20 streams that turn every five bars, longer up than down for 120 legs and then down than up: many levels in few bars.

    A leg is as long as four line items tell; each of its bars moves by the same step.
    """
    order = Window.partitionBy("k").orderBy("l_orderkey", "l_linenumber", "c")
    lines = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(20)).alias("k"), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    legs = lines.withColumn("leg", F.floor((F.row_number().over(order) - 1) / 4).cast("long")).groupBy("k", "leg").agg((F.lit(1000) + F.pmod(F.sum("c"), F.lit(9001))).alias("size"))
    steps = F.when(F.col("leg") % 2 == 0, F.col("size")).otherwise(-F.col("size")) + F.when(F.floor(F.col("leg") / 120) % 2 == 0, 1200).otherwise(-1200)
    legs = legs.withColumn("d", steps.cast("long"))
    upto = Window.partitionBy("k").orderBy("leg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    legs = legs.withColumn("p", F.lit(10_000_000) + 5 * (F.sum("d").over(upto) - F.col("d"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    a, b = F.col("p") + F.col("d") * F.col("j"), F.col("p") + F.col("d") * (F.col("j") + 1)
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + 60_000_000 * (F.col("leg") * 5 + F.col("j"))).cast("timestamp_ntz")
    return legs.select(F.col("k").cast("string").alias("stream_id"), at.alias("ts"), a.alias("open"), F.greatest(a, b).alias("high"), F.least(a, b).alias("low"), b.alias("close"), F.lit(1.0).alias("volume"))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices in cents, one stream a part brand."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))
    ticks = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ticks = ticks.withColumn("ts", F.col("l_shipdate").cast("timestamp_ntz"))
    return tick_bars(ticks, "1d", "p_brand", "price", ("ts", "l_orderkey", "l_linenumber"))
