"""Recursive indicators: one value in, one value out, a few numbers of state."""

from __future__ import annotations

import math


class Ema:
    """Exponential mean from the first value on: weight 2 / (span + 1), or ``alpha``."""

    __slots__ = ("alpha", "value")

    def __init__(self, span: int = 0, alpha: float | None = None) -> None:
        self.alpha = 2.0 / (span + 1) if alpha is None else alpha
        self.value: float | None = None

    def next(self, x: float) -> float:
        self.value = x if self.value is None else (1 - self.alpha) * self.value + self.alpha * x
        return self.value


class EmaLine:
    """Column ``ema`` of closes."""

    schema = "ema double"

    def __init__(self, span: int = 20) -> None:
        self.ema = Ema(span)

    def next(self, close: float) -> tuple[float, ...]:
        return (self.ema.next(close),)


class MacdLine:
    """Columns ``macd``, ``signal``, ``hist``."""

    schema = "macd double, signal double, hist double"

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9) -> None:
        self.fast, self.slow, self.mean = Ema(fast), Ema(slow), Ema(signal)

    def next(self, close: float) -> tuple[float, ...]:
        macd = self.fast.next(close) - self.slow.next(close)
        signal = self.mean.next(macd)
        return macd, signal, macd - signal


class RsiLine:
    """Column ``rsi`` by Wilder's means, null until ``period`` changes were seen; 100 without losses, null without any change."""

    schema = "rsi double"

    def __init__(self, period: int = 14) -> None:
        self.period, self.seen, self.before = period, 0, None
        self.gain, self.loss = Ema(alpha=1 / period), Ema(alpha=1 / period)

    def next(self, close: float) -> tuple[float | None, ...]:
        if self.before is None:
            self.before = close
            return (None,)
        change, self.before = close - self.before, close
        gain, loss = self.gain.next(max(change, 0.0)), self.loss.next(max(-change, 0.0))
        self.seen += 1
        if self.seen < self.period or (gain == 0 and loss == 0) or math.isnan(gain + loss):
            return (None,)
        return (100.0 if loss == 0 else 100 - 100 / (1 + gain / loss),)
