"""Vendor payloads as bars, and a data source that fetches them.

Payloads are JSON texts in a column, so a batch of many symbols is parsed by the cluster.
The data source ``bars_json`` reads one payload a symbol with a fetch function named in its
options; there is no network in tests, where the function reads files.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds between two fetches of one reader.
THROTTLE = 12.5
ERRORS = ("Error Message", "Note", "Information")


def _checked(payload: str) -> F.Column:
    said = F.coalesce(*[F.get_json_object(payload, f"$['{e}']") for e in ERRORS])
    return F.when(said.isNotNull(), F.raise_error(F.concat(F.lit("vendor says: "), said))).otherwise(F.col(payload))


def _entries(payloads: DataFrame, payload: str, section: str) -> DataFrame:
    """One row an entry of the object whose key starts with ``section``: columns of payloads, at (text), v (map)."""
    whole = F.from_json(_checked(payload), "map<string,string>")
    body = F.element_at(F.map_values(F.map_filter(whole, lambda k, _: k.startswith(section))), 1)
    kept = [c for c in payloads.columns if c != payload]
    return payloads.select(*kept, F.explode(F.from_json(body, "map<string,map<string,string>>")).alias("at", "v"))


def series_bars(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars of payloads with a ``Time Series`` object of {time: {1. open: ..}}; an error field raises. Needs stream_id."""
    e = _entries(payloads, payload, "Time Series")
    number = lambda k: F.col("v")[k].cast("double")
    return e.select("stream_id", F.col("at").cast("timestamp_ntz").alias("ts"), *[number(f"{i}. {c}").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)])


def series_macd(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """MACD lines of payloads with a ``Technical Analysis`` object."""
    e = _entries(payloads, payload, "Technical Analysis")
    return e.select("stream_id", F.col("at").cast("timestamp_ntz").alias("ts"), *[F.col("v")[k].cast("double").alias(n) for k, n in (("MACD", "macd"), ("MACD_Signal", "signal"), ("MACD_Hist", "hist"))])


def daily_values(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Flat bars of payloads with a ``data`` list of {date, value}; the value ``.`` means none and is left out."""
    rows = F.from_json(F.get_json_object(_checked(payload), "$.data"), "array<struct<date:string,value:string>>")
    e = payloads.select("stream_id", F.explode(rows).alias("r")).where("r.value <> '.'")
    value = F.col("r.value").cast("double")
    return e.select("stream_id", F.col("r.date").cast("timestamp_ntz").alias("ts"), *[value.alias(c) for c in ("open", "high", "low", "close")], F.lit(None).cast("double").alias("volume"))


class _Symbol(InputPartition):
    def __init__(self, symbol: str) -> None:
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.symbols = [s for s in options.get("symbols", "").split(",") if s]
        self.fetch = options["fetch"]
        self.throttle = float(options.get("throttle", THROTTLE))

    def partitions(self) -> list[InputPartition]:
        return [_Symbol(s) for s in self.symbols]

    def read(self, partition: _Symbol) -> Iterator[tuple]:
        module, _, name = self.fetch.rpartition(".")
        text = getattr(importlib.import_module(module), name)(partition.symbol)
        if self.throttle:
            time.sleep(self.throttle)
        yield partition.symbol, text if isinstance(text, str) else json.dumps(text)


class BarsJson(DataSource):
    """Options: symbols (comma-joined), fetch (dotted name of a function of a symbol that gives its payload), throttle (seconds after each fetch). One partition a symbol."""

    @classmethod
    def name(cls) -> str:
        return "bars_json"

    def schema(self) -> str:
        return "stream_id string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetched(spark: SparkSession, symbols: list[str], fetch: str, throttle: float = THROTTLE) -> DataFrame:
    """Payloads of symbols through the data source."""
    spark.dataSource.register(BarsJson)
    return spark.read.format("bars_json").options(symbols=",".join(symbols), fetch=fetch, throttle=str(throttle)).load()


def read_file(path: str) -> str:
    """A fetch function: the symbol is the path of a file with its payload."""
    with open(path, encoding="utf-8") as f:
        return f.read()
