"""Historical and live bars of brokers and data vendors, without their client libraries.

What to ask for (contract, bar size, dates) is worked out here; a fetch function named in the
options gets each request in a task of its own and yields (time, open, high, low, close, volume)
records, which become bars. Live bars are appended as they come and read from a bounded buffer.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import re
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.operators.bars import PRICES, normalised, records, resample

# Intervals that a broker serves, and its words for their units.
BROKER_INTERVALS = "1s 5s 10s 15s 30s 1min 2min 3min 5min 10min 15min 20min 30min 1hour 2hour 3hour 4hour 8hour 1day 1week 1month".split()
UNITS = {"s": "sec", "min": "min", "hour": "hour", "day": "day", "week": "week", "month": "month"}
# Futures by root, with the exchange where brokers trade them and the multiplier.
FUTURES = {
    "CL": ("NYMEX", 1000), "GC": ("COMEX", 100), "SI": ("COMEX", 5000), "ES": ("CME", 50), "NQ": ("CME", 20), "YM": ("CBOT", 5),
    "RTY": ("CME", 50), "ZB": ("CBOT", 1000), "ZN": ("CBOT", 1000), "NG": ("NYMEX", 10000), "HG": ("COMEX", 25000),
}
# A vendor's data sets, and the futures it has as continuous contracts by calendar roll.
CONTINUOUS = {"BZ", *FUTURES}
DATA_SETS = {"futures": "GLBX.MDP3", "stocks": "XNAS.ITCH"}
SCHEMAS = {"1hour": "ohlcv-1h", "1day": "ohlcv-1d"}
RESAMPLED = {"5min": "5m", "15min": "15m", "30min": "30m"}
#: Bars of a symbol that the live buffer holds, and most matches of a symbol search.
BUFFER, MATCHES = 500, 16


def supported_symbols() -> list[str]:
    return sorted(FUTURES)


def bar_size(interval: str) -> str:
    """A broker's name of an interval: "5min" is "5 mins"; seconds are always plural. Unknown ones raise ValueError."""
    if interval not in BROKER_INTERVALS:
        raise ValueError(f"unknown interval {interval!r}, known: {', '.join(BROKER_INTERVALS)}")
    number, unit = re.fullmatch(r"(\d+)([a-z]+)", interval).groups()
    return f"{number} {UNITS[unit]}{'s' if number != '1' or unit == 's' else ''}"


def contract(symbol: str) -> dict:
    """What a broker calls a symbol: a continuous future if its root is known, else a stock on the best route."""
    symbol = symbol.upper()
    if symbol in FUTURES:
        exchange, multiplier = FUTURES[symbol]
        return {"symbol": symbol, "type": "CONTFUT", "exchange": exchange, "currency": "USD", "multiplier": multiplier}
    return {"symbol": symbol, "type": "STK", "exchange": "SMART", "currency": "USD", "multiplier": 1}


def broker_request(symbol: str, interval: str = "1min", duration: str = "2 D", show: str = "TRADES", regular: bool = False) -> dict:
    return {"symbol": symbol.upper(), "contract": contract(symbol), "bar_size": bar_size(interval), "duration": duration, "show": show, "regular_hours": regular}


def vendor_request(symbol: str, interval: str = "1min", start: str = "2020-01-01", end: str | None = None, today: dt.date | None = None) -> dict:
    """A vendor's data set, symbol and schema: minutes up to 30 are made from 1 minute; the default end is yesterday, for a day is served when it is over."""
    symbol = symbol.upper()
    future = symbol in CONTINUOUS
    until = end or ((today or dt.datetime.now(dt.UTC).date()) - dt.timedelta(days=1)).isoformat()
    return {
        "symbol": symbol, "dataset": DATA_SETS["futures" if future else "stocks"], "vendor_symbol": f"{symbol}.c.0" if future else symbol,
        "symbol_type": "continuous" if future else "raw_symbol", "schema": SCHEMAS.get(interval, "ohlcv-1m"), "start": start, "end": until,
    }


class _Request(InputPartition):
    def __init__(self, request: dict) -> None:
        self.request = request


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.requests, self.fetch = json.loads(options["requests"]), options["fetch"]

    def partitions(self) -> list[InputPartition]:
        return [_Request(r) for r in self.requests]

    def read(self, partition: _Request) -> Iterator[tuple]:
        module, _, name = self.fetch.rpartition(".")
        for n, (at, *prices) in enumerate(getattr(importlib.import_module(module), name)(partition.request)):
            at = at.isoformat(sep=" ") if isinstance(at, dt.date) else str(at)
            yield (partition.request["symbol"], n, at, *[None if p is None else float(p) for p in (*prices, None)[:5]])


class Feed(DataSource):
    """Options: requests (a JSON list, one partition each) and fetch (dotted name of a function of a request that yields records)."""

    @classmethod
    def name(cls) -> str:
        return "bars_feed"

    def schema(self) -> str:
        return "stream_id string, n long, at string, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def times(at: Column) -> Column:
    """Times without zone: ISO texts (any offset, taken to UTC), compact days "20240102" and compact times "20240102 09:30:00" or with a dash."""
    compact = F.regexp_replace(at, r"^(\d{4})(\d{2})(\d{2})(?:[- ]+|$)", "$1-$2-$3 ")
    text = F.trim(compact)
    zoned = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d")
    return F.when(zoned, F.to_utc_timestamp(text.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")).otherwise(text.cast("timestamp_ntz"))


def fetched_bars(spark: SparkSession, requests: list[dict], fetch: str) -> DataFrame:
    """Bars of all requests, each fetched by its own task: one row a time (the last that came), volumes of 0 and less unknown."""
    spark.dataSource.register(Feed)
    raw = spark.read.format("bars_feed").options(requests=json.dumps(requests), fetch=fetch).load()
    return normalised(raw.withColumns({"ts": times(F.col("at")), "volume": F.when(F.col("volume") > 0, F.col("volume"))}), "n")


def broker_history(spark: SparkSession, symbols: list[str], fetch: str, interval: str = "1min", duration: str = "2 D", show: str = "TRADES", regular: bool = False) -> DataFrame:
    return fetched_bars(spark, [broker_request(s, interval, duration, show, regular) for s in symbols], fetch)


def vendor_history(spark: SparkSession, symbols: list[str], fetch: str, interval: str = "1min", start: str = "2020-01-01", end: str | None = None) -> DataFrame:
    """Bars of a vendor in ``interval``; where the vendor has none of it, resampled from 1 minute."""
    found = fetched_bars(spark, [vendor_request(s, interval, start, end) for s in symbols], fetch)
    return resample(found, RESAMPLED[interval]) if interval in RESAMPLED else found


def cache_name(symbol: str, interval: str) -> str:
    return f"{symbol.upper()}_{interval}_raw"


def cache_all(spark: SparkSession, symbols: list[str], folder: str, fetch: str, interval: str = "1min", start: str = "2020-01-01", end: str | None = None) -> DataFrame:
    """Fetch and cache symbols one after the other (vendors count requests): one row a symbol with cache_name, rows, elapsed and error.

    A symbol that fails leaves its error there and the others go on.
    """
    told = []
    for symbol in symbols:
        began, name, error, n = time.time(), cache_name(symbol, interval), None, 0
        path = f"{folder.rstrip('/')}/{name}.parquet"
        try:
            vendor_history(spark, [symbol], fetch, interval, start, end).write.mode("overwrite").parquet(path)
            n = spark.read.parquet(path).count()
        except Exception as e:  # whatever the vendor's client raises
            error = str(e).strip().splitlines()[0][:500] if str(e).strip() else type(e).__name__
        told.append((symbol.upper(), name, n, time.time() - began, error))
    return spark.createDataFrame(told, "symbol string, cache_name string, rows long, elapsed double, error string")


def matches(found: DataFrame, text: str) -> DataFrame:
    """The first MATCHES of a table of contracts (symbol, type, exchange, currency, description) whose symbol or description holds ``text``."""
    low = F.lower(F.concat_ws(" ", "symbol", "description"))
    return found.where(F.contains(low, F.lit(text.strip().lower()))).orderBy("symbol", "exchange").limit(MATCHES)


def buffered(live: DataFrame, size: int = BUFFER) -> DataFrame:
    """The last ``size`` bars of each stream with their place ``buffer_idx`` in the buffer, from 0."""
    w = Window.partitionBy("stream_id").orderBy("ts")
    newest = live.withColumn("__n", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("ts").desc()))).where(F.col("__n") <= size)
    return newest.withColumn("buffer_idx", (F.row_number().over(w) - 1).cast("long")).drop("__n")


def latest(live: DataFrame, stream: str, since: int = 0, size: int = BUFFER) -> tuple[DataFrame, int]:
    """(records of a stream's buffer from place ``since`` on, the place to ask from next time). A stream that is not there keeps ``since``."""
    own = buffered(live.where(F.col("stream_id") == stream.upper()), size)
    held = own.count()
    new = own.where(F.col("buffer_idx") >= since)
    volume = F.coalesce(F.round("volume", 0), F.lit(0.0))
    return records(new.select("stream_id", "ts", *PRICES, volume.alias("volume"))), held or since


def read_rows(request: dict) -> Iterator[tuple]:
    """A fetch function: the records of a file of JSON lists, one a line, in the folder that ``start`` or ``duration`` names."""
    place = request.get("start") or request["duration"]
    with open(f"{place}/{request.get('vendor_symbol', request['symbol'])}.json", encoding="utf-8") as f:
        for line in f:
            yield tuple(json.loads(line))
