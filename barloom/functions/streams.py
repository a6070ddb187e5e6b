"""Names of streams: exchange:symbol/interval@timeframe:Llevel/source, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The instruments that are known by name (symbol, type, exchange, name).
CATALOG = [
    ("CL", "FUT", "NYMEX", "WTI Crude Oil"),
    ("BZ", "FUT", "CME", "Brent Crude Oil (CME)"),
    ("NG", "FUT", "NYMEX", "Natural Gas"),
    ("GC", "FUT", "COMEX", "Gold"),
    ("SI", "FUT", "COMEX", "Silver"),
    ("HG", "FUT", "COMEX", "Copper"),
    ("ES", "FUT", "CME", "E-mini S&P 500"),
    ("NQ", "FUT", "CME", "E-mini Nasdaq 100"),
    ("YM", "FUT", "CBOT", "E-mini Dow"),
    ("RTY", "FUT", "CME", "E-mini Russell 2000"),
    ("ZB", "FUT", "CBOT", "30-Year T-Bond"),
    ("ZN", "FUT", "CBOT", "10-Year T-Note"),
    ("AMD", "STK", "NASDAQ", "AMD"),
    ("NVDA", "STK", "NASDAQ", "NVIDIA"),
    ("AAPL", "STK", "NASDAQ", "Apple"),
    ("MSFT", "STK", "NASDAQ", "Microsoft"),
    ("GOOG", "STK", "NASDAQ", "Alphabet"),
    ("AMZN", "STK", "NASDAQ", "Amazon"),
    ("META", "STK", "NASDAQ", "Meta Platforms"),
    ("TSLA", "STK", "NASDAQ", "Tesla"),
    ("NFLX", "STK", "NASDAQ", "Netflix"),
    ("SPY", "ETF", "NYSE", "S&P 500 ETF"),
    ("QQQ", "ETF", "NASDAQ", "Nasdaq 100 ETF"),
    ("IWM", "ETF", "NYSE", "Russell 2000 ETF"),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "symbol string, type string, exchange string, name string")


def stream_name(exchange: Column, symbol: Column, interval: Column, tf: Column, level: Column, source: Column) -> Column:
    return F.concat(exchange, F.lit(":"), symbol, F.lit("/"), interval, F.lit("@"), tf, F.lit(":L"), level.cast("string"), F.lit("/"), source)


def short_hash(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 12)


def timeframe_of(name: Column) -> Column:
    return F.regexp_extract(name, "@([^:]+):", 1)


def named(symbols: DataFrame, tf: str, interval: str = "1min", source: str = "replay", column: str = "symbol") -> DataFrame:
    """Add ``stream_id`` and ``stream_hash``; a symbol that the catalog lacks is of exchange UNKNOWN, an empty one is called UNKNOWN.

    The catalog has two dozen rows and is broadcast.
    """
    known = catalog(symbols.sparkSession).select(F.col("symbol").alias("__s"), F.col("exchange").alias("__e"))
    upper = F.upper(F.coalesce(F.col(column), F.lit("")))
    met = symbols.join(F.broadcast(known), upper == F.col("__s"), "left")
    name = stream_name(F.coalesce("__e", F.lit("UNKNOWN")), F.when(upper == "", "UNKNOWN").otherwise(upper), F.lit(interval), F.lit(tf), F.lit(0), F.lit(source))
    return met.withColumn("stream_id", name).withColumn("stream_hash", short_hash(F.col("stream_id"))).drop("__s", "__e")
