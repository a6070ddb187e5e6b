"""Structure and signal layers of many streams, as DataFrames.

One shuffle by stream carries the whole chain: a fold reads a stream's bars in order and
emits the layer that is asked for, or all of them as one tagged table that ``pick`` takes
apart. Bars flow through; a task holds the strokes of the stream at hand, and its MACD line
only where signals use it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.folds import Ema
from barloom.operators import signals as sg
from barloom.operators import structure as st
from barloom.operators.fold import fold_streams

_MOVE = "kind string, direction string, seg_start long, seg_end long, zs_start long, zs_end long, zs_count long, settled boolean, high double, low double, first_s0 long, last_s1 long"
_DIVERGENCE = (
    "kind string, direction string, level_id int, seg_a_start long, seg_a_end long, seg_c_start long, seg_c_end long, center_idx long, force_a double, force_c double, "
    "confirmed boolean, dif_peak_a double, dif_peak_c double, hist_peak_a double, hist_peak_c double"
)
#: Columns of each layer after the keys, ``level`` and ``idx`` (the position in its list).
FIELDS = {
    "merged": "ts_us long, open double, high double, low double, close double, raw_start long, raw_end long",
    "fractals": "m_idx long, kind string, price double, raw_start long, raw_end long",
    "line": "ts_us long, macd double, signal double, hist double",
    "strokes": "i0 long, i1 long, direction string, high double, low double, p0 double, p1 double, confirmed boolean",
    "segments": "s0 long, s1 long, i0 long, i1 long, direction string, high double, low double, confirmed boolean, kind string, p0 double, p1 double, ep0_i long, ep1_i long, trigger_k long, fractal_a long, gap_type string",
    "features": "segment_idx long, first long, last long, high double, low double, fractal string, price double",
    "zhongshus": "zd double, zg double, seg_start long, seg_end long, seg_count long, settled boolean, break_seg long, break_direction string, gg double, dd double, first_s0 long, last_s1 long",
    "moves": _MOVE,
    "centers": "seg0 long, seg1 long, low double, high double, kind string, confirmed boolean, sustain long, direction string, gg double, dd double, g double, d double, zg_dynamic double, zd_dynamic double, terminated boolean, termination_side string, development string, i0 long, i1 long",
    "trends": "kind string, direction string, seg0 long, seg1 long, i0 long, i1 long, high double, low double, center_indices array<int>, confirmed boolean",
    "divergences": _DIVERGENCE,
    "divergences_v0": _DIVERGENCE,
    "points": "kind string, side string, level_id int, seg_idx long, move_seg_start long, center_zd double, center_zg double, center_seg_start long, price double, bar_idx long, confirmed boolean, settled boolean, overlaps_with string, div_center long, div_c_start long, div_c_end long",
    "liveness": "alive boolean, regime string, exit_idx long, exit_side string, exit_extreme double, pullback_seen boolean, pullback_settled boolean, reason string",
    "lstar": "center_idx long, regime string",
    "lstar_v0": "center_idx long, regime string, low double, high double, exit_idx long, exit_side string, exit_extreme double, pullback_seen boolean, pullback_settled boolean",
    "nested": "chain string, bar_start long, bar_end long",
    "turns": "level_id int, side string, move_seg_start long, move_direction string, c_start long, c_end long, sub_c_end long",
}


@dataclass(frozen=True)
class Settings:
    """How structure is built. ``raw_gaps`` lets mode new count raw bars; ``macd`` makes signals use MACD; ``reach`` lets the last move last to the last segment."""

    stroke_mode: str = "wide"
    min_sep: int = 5
    raw_gaps: bool = True
    segments: str = "v1"
    min_strokes: int = 3
    sustain_m: int = 2
    max_levels: int = 6
    macd: bool = False
    reach: bool = True

    def __post_init__(self) -> None:
        st.gap_rule(self.stroke_mode)
        if self.segments not in ("v0", "v1"):
            raise ValueError(f"unknown segment algorithm {self.segments!r}")


class Chain:
    """Layers over a stream's strokes, each computed once when first asked for."""

    def __init__(self, settings: Settings, strokes: list[st.Stroke], last_price: float, force=None) -> None:
        self.settings, self.strokes, self.last_price, self.force = settings, strokes, last_price, force
        self._made: dict[str, list] = {}

    def rows(self, layer: str) -> list[tuple[int, int, tuple]]:
        """(level, idx, fields) of a layer."""
        if layer not in self._made:
            self._made[layer] = list(getattr(self, layer)())
        return self._made[layer]

    def items(self, layer: str, level: int | None = None) -> list:
        return [x for lv, _, x in self.rows(layer) if level is None or lv == level]

    @staticmethod
    def _numbered(items: list, level: int = 1) -> Iterator[tuple[int, int, tuple]]:
        return ((level, i, x) for i, x in enumerate(items))

    def segments(self):
        s = self.settings
        return self._numbered(st.segments_v1(self.strokes, s.min_strokes) if s.segments == "v1" else st.segments_v0(self.strokes), 0)

    def features(self):
        for k, seg in enumerate(self.items("segments")):
            bars = st.feature_sequence(self.strokes, seg)
            merged = st.merged_features(bars)
            tops = {i: (kind, price) for i, kind, price in st.feature_fractals(merged)}
            for i, (a, b, high, low) in enumerate(merged):
                yield 0, i, (k, bars[a][0], bars[b][0], high, low, *tops.get(i, (None, None)))

    def zhongshus(self):
        yield from self._numbered(st.zhongshus(self.items("segments")))
        for level, _, centers, _ in self._levels():
            yield from self._numbered(centers, level)

    def moves(self):
        segments = self.items("segments")
        yield from self._numbered(self._moves1())
        if segments:
            for level, _, _, made in self._levels():
                yield from self._numbered(made, level)

    def _moves1(self) -> list[st.Move]:
        if "_moves1" not in self._made:
            segments = self.items("segments")
            self._made["_moves1"] = st.moves_of(st.zhongshus(segments), len(segments) if self.settings.reach else None)
        return self._made["_moves1"]

    def _levels(self) -> list[tuple]:
        if "_levels" not in self._made:
            self._made["_levels"] = st.recursion(self._moves1(), self.settings.max_levels)
        return self._made["_levels"]

    def _old(self) -> list[tuple]:
        if "_old" not in self._made:
            self._made["_old"] = list(st.recursive_levels(self.items("segments"), self.settings.sustain_m))
        return self._made["_old"]

    def centers(self):
        for level, parts, centers, _ in self._old():
            yield from self._numbered([(*c, parts[c.seg0].i0, parts[c.seg1].i1) for c in centers], level)

    def trends(self):
        for level, _, _, trends in self._old():
            yield from self._numbered(trends, level)

    def divergences_v0(self):
        for level, parts, centers, trends in self._old():
            yield from self._numbered(sg.divergences_v0(parts, centers, trends, level, self.force), level)

    def divergences(self):
        segments = self.items("segments")
        yield from self._numbered(sg.divergences(segments, self.items("zhongshus", 1), self._moves1(), 1, self.force))
        for level, parts, centers, made in self._levels():
            yield from self._numbered(sg.divergences(parts, centers, made, level), level)

    def points(self):
        return self._numbered(sg.points(self.items("segments"), self.items("zhongshus", 1), self._moves1(), self.items("divergences", 1), 1))

    def _views(self) -> list[tuple]:
        views = [(1, self.items("segments"), [sg.as_view(c) for c in self.items("zhongshus", 1)])]
        before = self._moves1()
        for level, _, centers, made in self._levels():
            views.append((level, before, [sg.as_view(c) for c in centers]))
            before = made
        return views

    def liveness(self):
        for level, parts, centers in self._views():
            yield from self._numbered([sg.liveness(c, parts, self.last_price) for c in centers], level)

    def lstar(self):
        found = sg.lstar(self._views(), self.last_price)
        if found:
            yield found.level, 0, (found.center_idx, found.regime)

    def lstar_v0(self):
        views = [(level, parts, centers) for level, parts, centers, _ in self._old()]
        found = sg.lstar(views, self.last_price)
        if found:
            parts, centers = next((p, c) for level, p, c in views if level == found.level)
            c = centers[found.center_idx]
            yield found.level, 0, (found.center_idx, found.regime, c.low, c.high, *sg.liveness(c, parts, self.last_price)[2:7])

    def nested(self):
        found = sg.nested_divergences(self.items("segments"), self.items("zhongshus", 1), self._moves1(), self._levels(), self.force)
        for i, n in enumerate(found):
            yield n.chain[0][0], i, (";".join(f"{lv}:{d.kind}:{d.direction}:{d.seg_c_start}-{d.seg_c_end}" for lv, d in n.chain), n.bar_start, n.bar_end)

    def turns(self):
        own, n = self.items("divergences", 1), self.items("zhongshus", 1)
        sub = self.items("divergences_v0", 1)
        return self._numbered(sg.small_to_big(self.items("segments"), n, self._moves1(), own, sub, 1))


class LayerFold:
    """Bars of one stream in, rows (level, idx, fields...) of one layer out; tagged with the layer's name if there are several."""

    def __init__(self, layers: tuple[str, ...], settings: Settings) -> None:
        self.layers, self.settings = layers, settings
        self.fold = st.StrokeFold(settings.stroke_mode, settings.min_sep, settings.raw_gaps)
        self.raw = self.n_fractals = 0
        self.close = 0.0
        self.raw_of: list[tuple[int, int]] = []
        self.macd: list[float] = []
        self.hist: list[float] = []
        self.emas = Ema(12), Ema(26), Ema(9)
        self.lined = "line" in layers
        self.bars_only = set(layers) <= {"merged", "fractals", "line"}

    def _row(self, layer: str, level: int, idx: int, fields: tuple) -> tuple:
        fields = tuple(list(x) if isinstance(x, tuple) else x for x in fields)
        if len(self.layers) == 1:
            return (level, idx, *fields)
        before = sum(len(_names(k)) for k in self.layers[: self.layers.index(layer)])
        after = sum(len(_names(k)) for k in self.layers) - before - len(fields)
        return (layer, level, idx, *[None] * before, *fields, *[None] * after)

    def _certain(self, bar: st.Merged | None, fractal: st.Fractal | None) -> Iterator[tuple]:
        if bar is not None:
            if self.settings.macd:
                self.raw_of.append((bar.raw_start, bar.raw_end))
            if "merged" in self.layers:
                yield self._row("merged", 0, bar.m_idx, bar[1:])
        if fractal is not None:
            if "fractals" in self.layers:
                yield self._row("fractals", 0, self.n_fractals, fractal)
            self.n_fractals += 1

    def push(self, rows: pd.DataFrame) -> Iterator[tuple]:
        given = zip(rows["macd"].tolist(), rows["hist"].tolist()) if "macd" in rows.columns else None
        for ts, o, h, l, c in zip(*(rows[k].tolist() for k in ("ts_us", "open", "high", "low", "close"))):
            bar, fractal = self.fold.push(self.raw, ts, o, h, l, c)
            if bar is not None:
                yield from self._certain(bar, fractal)
            if given:
                dif, hist = next(given)
                signal = dif - hist
            elif self.settings.macd or self.lined:
                dif = self.emas[0].next(c) - self.emas[1].next(c)
                signal = self.emas[2].next(dif)
            if self.settings.macd or self.lined:
                if self.settings.macd:
                    self.macd.append(dif)
                    self.hist.append(dif - signal)
                if self.lined:
                    yield self._row("line", 0, self.raw, (ts, dif, signal, dif - signal))
            self.raw += 1
            self.close = c
        if self.bars_only:
            self.fold.strokes.clear()

    def finish(self) -> Iterator[tuple]:
        last = self.fold.merger.last
        if last is None:
            return
        strokes = [] if self.bars_only else self.fold.result()
        found = st.fractal_at(*self.fold.tail, last) if len(self.fold.tail) == 2 else None
        yield from self._certain(last, found)
        force = sg.Momentum(np.array(self.macd), np.array(self.hist), self.raw_of) if self.settings.macd else None
        chain = Chain(self.settings, strokes, self.close, force)
        for layer in self.layers:
            if layer == "strokes":
                for i, s in enumerate(strokes):
                    yield self._row(layer, 0, i, s)
            elif layer not in ("merged", "fractals", "line"):
                for level, idx, fields in chain.rows(layer):
                    yield self._row(layer, level, idx, fields)


def _names(layer: str) -> list[str]:
    return [c.split()[0] for c in FIELDS[layer].split(", ")]


def _bars(bars: DataFrame) -> DataFrame:
    own = ("macd", "hist") if {"macd", "hist"} <= set(bars.columns) else ()
    return bars.select(
        "stream_id", F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in own],
    )


def with_line(bars: DataFrame, line: DataFrame) -> DataFrame:
    """Bars with a supplied MACD line (stream_id, ts, macd, hist) laid on their times: signals use it in place of their own. Bars the line has not stay, with unknown values."""
    return bars.drop("macd", "hist").join(line.select("stream_id", "ts", "macd", "hist"), ["stream_id", "ts"], "left")


def layer(bars: DataFrame, name: str, settings: Settings = Settings()) -> DataFrame:
    """One layer of every stream: stream_id, level, idx and the layer's columns.

    ``bars``: stream_id, ts, open, high, low, close, and macd and hist if a line is supplied;
    other columns are not read. Level 0 is
    what bars and strokes give, levels 1 and up are centers and moves. An empty table, or a
    stream too short for a layer, gives no rows.
    """
    out = fold_streams(_bars(bars), lambda _: LayerFold((name,), settings), f"level int, idx long, {FIELDS[name]}", ["stream_id"], ["ts_us"])
    return out.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us") if name == "merged" else out


def layers(bars: DataFrame, names: tuple[str, ...], settings: Settings = Settings()) -> DataFrame:
    """Several layers from one pass as one tagged table; columns are called layer__column. See ``pick``."""
    wide = ", ".join(f"{n}__{c.strip()}" for n in names for c in FIELDS[n].split(", "))
    return fold_streams(_bars(bars), lambda _: LayerFold(tuple(names), settings), f"layer string, level int, idx long, {wide}", ["stream_id"], ["ts_us"])


def pick(tagged: DataFrame, name: str) -> DataFrame:
    """The rows of one layer of a tagged table, under the layer's own column names."""
    return tagged.where(F.col("layer") == name).select("stream_id", "level", "idx", *[F.col(f"{name}__{c}").alias(c) for c in _names(name)])
