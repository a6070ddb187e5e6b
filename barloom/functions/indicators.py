"""Indicators over streams of bars, and their registry.

Rolling ones are window expressions; recursive ones run in one ordered pass a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.folds import EmaLine, MacdLine, RsiLine
from barloom.operators.fold import fold_streams


def _rolling(period: int) -> Window:
    return Window.partitionBy("stream_id").orderBy("ts").rowsBetween(1 - period, 0)


def _full(value: Column, period: int) -> Column:
    return F.when(F.count("close").over(_rolling(period)) == period, value)


def sma(bars: DataFrame, period: int = 20) -> DataFrame:
    """Add ``sma``, the mean of the last ``period`` closes; null before there are so many."""
    return bars.withColumn("sma", _full(F.avg("close").over(_rolling(period)), period))


def bollinger(bars: DataFrame, period: int = 20, std: float = 2.0) -> DataFrame:
    """Add ``middle``, ``upper`` and ``lower``: the mean and ``std`` sample deviations each way."""
    mean, spread = F.avg("close").over(_rolling(period)), F.stddev_samp("close").over(_rolling(period)) * std
    return bars.withColumns({"middle": _full(mean, period), "upper": _full(mean + spread, period), "lower": _full(mean - spread, period)})


class _LineFold:
    def __init__(self, line) -> None:
        self.line, self.at = line, 0

    def push(self, rows: pd.DataFrame) -> Iterator[tuple]:
        for ts, close in zip(rows["ts_us"].tolist(), rows["close"].tolist()):
            yield (self.at, ts, close, *self.line.next(close))
            self.at += 1

    def finish(self) -> Iterator[tuple]:
        return iter(())


def _line(bars: DataFrame, make: Callable[[], object], schema: str) -> DataFrame:
    thin = bars.select("stream_id", F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"), F.col("close").cast("double").alias("close"))
    out = fold_streams(thin, lambda _: _LineFold(make()), f"bar_idx long, ts_us long, close double, {schema}", ["stream_id"], ["ts_us"])
    return out.withColumn("ts", F.timestamp_micros("ts_us").cast(bars.schema["ts"].dataType)).drop("ts_us")


def ema(bars: DataFrame, period: int = 20) -> DataFrame:
    """(stream_id, bar_idx, close, ema, ts)."""
    return _line(bars, lambda: EmaLine(period), EmaLine.schema)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(stream_id, bar_idx, close, macd, signal, hist, ts)."""
    return _line(bars, lambda: MacdLine(fast, slow, signal), MacdLine.schema)


def rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """(stream_id, bar_idx, close, rsi, ts)."""
    return _line(bars, lambda: RsiLine(period), RsiLine.schema)


@dataclass(frozen=True)
class Indicator:
    apply: Callable[..., DataFrame]
    params: dict[str, type]
    display: str = "overlay"


REGISTRY: dict[str, Indicator] = {
    "sma": Indicator(sma, {"period": int}),
    "ema": Indicator(ema, {"period": int}),
    "macd": Indicator(macd, {"fast": int, "slow": int, "signal": int}, "pane"),
    "rsi": Indicator(rsi, {"period": int}, "pane"),
    "bollinger": Indicator(bollinger, {"period": int, "std": float}),
}


def register(name: str, indicator: Indicator) -> None:
    """Add an indicator of one's own."""
    REGISTRY[name] = indicator


def compute(bars: DataFrame, name: str, params: dict | None = None) -> DataFrame:
    """Run a registered indicator; parameters are cast to their types, unknown ones ignored, an unknown name raises ValueError."""
    found = REGISTRY.get(name.lower())
    if found is None:
        raise ValueError(f"unknown indicator {name!r}; known: {', '.join(sorted(REGISTRY))}")
    own = {k: found.params[k](v) for k, v in (params or {}).items() if k in found.params}
    return found.apply(bars, **own)
