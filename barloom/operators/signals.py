"""Signals of one stream: force, divergences, trading points, the level that decides.

Positions are those of operators/structure.py. A divergence compares a later leg C with an
earlier one A in the same direction, by force and, where MACD is at hand, by its peaks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np

from barloom.operators.structure import DOWN, UP, Center, Move, Segment, Trend, Zhongshu


class Divergence(NamedTuple):
    kind: str
    direction: str
    level_id: int
    seg_a_start: int
    seg_a_end: int
    seg_c_start: int
    seg_c_end: int
    center_idx: int
    force_a: float
    force_c: float
    confirmed: bool
    dif_peak_a: float = 0.0
    dif_peak_c: float = 0.0
    hist_peak_a: float = 0.0
    hist_peak_c: float = 0.0


class Point(NamedTuple):
    """A trading point; (seg_idx, kind, side, level_id) names it."""

    kind: str
    side: str
    level_id: int
    seg_idx: int
    move_seg_start: int
    center_zd: float
    center_zg: float
    center_seg_start: int
    price: float
    bar_idx: int
    confirmed: bool
    settled: bool = False
    overlaps_with: str | None = None
    div_center: int | None = None
    div_c_start: int | None = None
    div_c_end: int | None = None


class Turn(NamedTuple):
    """A small-to-big turn."""

    level_id: int
    side: str
    move_seg_start: int
    move_direction: str
    c_start: int
    c_end: int
    sub_c_end: int


# --- force ------------------------------------------------------------------------------


class Amplitude:
    """Price range times duration; duration in merged bars, or in parts where parts have no bars."""

    gates = False

    def strength(self, parts: Sequence, a: int, b: int, direction: str) -> float:
        if a > b or a < 0 or b >= len(parts):
            return 0.0
        own = parts[a : b + 1]
        long = own[-1].i1 - own[0].i0 if hasattr(own[0], "i0") else b - a + 1
        return (max(p.high for p in own) - min(p.low for p in own)) * max(1, long)

    def peaks(self, parts: Sequence, a: int, b: int, direction: str) -> tuple[float, float]:
        return 0.0, 0.0

    def crosses_zero(self, parts: Sequence, a: int, b: int) -> bool:
        return True


class Momentum:
    """MACD areas and peaks over the raw bars that merged positions stand for."""

    gates = True

    def __init__(self, macd: np.ndarray, hist: np.ndarray, raw: Sequence[tuple[int, int]]) -> None:
        self.macd, self.hist, self.raw = np.asarray(macd, float), np.asarray(hist, float), raw

    def _raw(self, parts: Sequence, a: int, b: int) -> tuple[int, int]:
        if a > b or a < 0 or b >= len(parts):
            i0 = i1 = 0
        else:
            i0, i1 = parts[a].i0, parts[b].i1
        return (self.raw[i0][0] if i0 < len(self.raw) else 0), (self.raw[i1][1] if i1 < len(self.raw) else 0)

    def strength(self, parts: Sequence, a: int, b: int, direction: str) -> float:
        if a > b or a < 0 or b >= len(parts):
            return 0.0
        lo, hi = self._raw(parts, a, b)
        return macd_area(self.hist, lo, hi)["area_pos" if direction == UP else "area_neg"].__abs__()

    def peaks(self, parts: Sequence, a: int, b: int, direction: str) -> tuple[float, float]:
        lo, hi = self._raw(parts, a, b)
        return peak(self.macd, lo, hi, direction), peak(self.hist, lo, hi, direction)

    def crosses_zero(self, parts: Sequence, a: int, b: int) -> bool:
        """Whether the MACD line has values on both sides of zero."""
        lo = self.raw[parts[a].i0][0] if a < len(parts) and parts[a].i0 < len(self.raw) else 0
        hi = self.raw[parts[b].i1][1] if b < len(parts) and parts[b].i1 < len(self.raw) else 0
        line = self.macd[max(0, lo) : min(hi, len(self.macd) - 1) + 1]
        return bool((line > 0).any() and (line < 0).any())


def macd_area(hist: np.ndarray, lo: int, hi: int) -> dict[str, float]:
    """Sums of the histogram over a clamped closed range, rounded to 6 digits; an empty range gives zeros."""
    own = hist[max(0, lo) : min(hi, len(hist) - 1) + 1]
    return {
        "area_total": round(float(own.sum()), 6), "area_pos": round(float(own[own > 0].sum()), 6), "area_neg": round(float(own[own < 0].sum()), 6), "n_bars": len(own),
    }


def peak(values: np.ndarray, lo: int, hi: int, direction: str) -> float:
    """Largest value up, or depth down, 0 at least; a range that is not wholly there gives 0, and so does one without known values."""
    if lo > hi or lo < 0 or hi >= len(values):
        return 0.0
    own = values[lo : hi + 1]
    own = own[~np.isnan(own)]
    if not len(own):
        return 0.0
    return max(0.0, float(own.max())) if direction == UP else abs(min(0.0, float(own.min())))


# --- divergences ------------------------------------------------------------------------


class _Leg(NamedTuple):
    """What one move offers to compare: legs A and C, the center between, and where its zero crossing is looked for."""

    kind: str
    direction: str
    a: tuple[int, int]
    c: tuple[int, int]
    center: int
    gate: tuple[int, int] | None


def _trend_legs(bounds: Sequence[tuple[int, int, int]], end: int, direction: str, n: int) -> _Leg | None:
    """Legs of a trend from its last two centers, (index, first part, last part) each."""
    if len(bounds) < 2:
        return None
    (_, _, before_end), (last, start, stop) = bounds[-2:]
    a = (before_end + 1, start - 1) if before_end + 1 <= start - 1 else (before_end, before_end)
    c = (stop + 1, end)
    if c[0] > c[1] or a[0] >= n or c[1] >= n:
        return None
    return _Leg("trend", direction, a, c, last, (start, stop))


def _exit_legs(parts: Sequence, index: int, start: int, stop: int, low: float, high: float, end: int) -> Iterable[_Leg]:
    """For each direction, up first, the last two parts that left a center."""
    n = len(parts)
    left = [k for k in range(start, min(stop + 1, n)) if parts[k].high > high or parts[k].low < low]
    left += range(stop + 1, min(end + 1, n))
    for direction in (UP, DOWN):
        own = [k for k in left if parts[k].direction == direction]
        if len(own) > 1:
            yield _Leg("consolidation", direction, (own[-2],) * 2, (own[-1],) * 2, index, None)


def _judge(parts: Sequence, leg: _Leg, force, level: int, confirmed: bool, peaks: bool) -> Divergence | None:
    if leg.gate and not force.crosses_zero(parts, *leg.gate):
        return None
    fa, fc = force.strength(parts, *leg.a, leg.direction), force.strength(parts, *leg.c, leg.direction)
    if fa <= 0:
        return None
    da, ha = force.peaks(parts, *leg.a, leg.direction) if peaks else (0.0, 0.0)
    dc, hc = force.peaks(parts, *leg.c, leg.direction) if peaks else (0.0, 0.0)
    if not (fc < fa or (da > 0 and dc < da) or (ha > 0 and hc < ha)):
        return None
    return Divergence(leg.kind, "top" if leg.direction == UP else "bottom", level, *leg.a, *leg.c, leg.center, fa, fc, confirmed, da, dc, ha, hc)


def _first(legs: Iterable[_Leg | None], *args) -> Divergence | None:
    return next((d for leg in legs if leg and (d := _judge(args[0], leg, *args[1:]))), None)


def divergences(parts: Sequence, centers: Sequence[Zhongshu], moves: Sequence[Move], level: int, force=None) -> list[Divergence]:
    """At most one divergence a move, over segments (level 1) or over the moves below (levels 2 and up)."""
    force = force or Amplitude()
    out = []
    for m in moves:
        if m.kind == "trend":
            bounds = [(i, centers[i].seg_start, centers[i].seg_end) for i in range(m.zs_start, min(m.zs_end + 1, len(centers))) if centers[i].settled]
            legs: Iterable = [_trend_legs(bounds, m.seg_end, m.direction, len(parts))] if m.zs_count > 1 else []
        elif m.zs_start < len(centers):
            c = centers[m.zs_start]
            legs = _exit_legs(parts, m.zs_start, c.seg_start, c.seg_end, c.zd, c.zg, m.seg_end)
        else:
            legs = []
        if d := _first(legs, parts, force, level, m.settled, True):
            out.append(d)
    return out


class _NoGate:
    """A force without the zero-crossing condition."""

    def __init__(self, force) -> None:
        self.strength, self.peaks = force.strength, force.peaks

    def crosses_zero(self, *_: object) -> bool:
        return True


def divergences_v0(parts: Sequence, centers: Sequence[Center], trends: Sequence[Trend], level: int, force=None) -> list[Divergence]:
    """The older chain's: by force only."""
    force = _NoGate(force or Amplitude())
    out = []
    for t in trends:
        if t.kind == "trend":
            legs: Iterable = [_trend_legs([(i, centers[i].seg0, centers[i].seg1) for i in t.center_indices], t.seg1, t.direction, len(parts))]
        else:
            c = centers[t.center_indices[0]]
            legs = _exit_legs(parts, t.center_indices[0], c.seg0, c.seg1, c.low, c.high, t.seg1)
        if d := _first(legs, parts, force, level, t.confirmed, False):
            out.append(d)
    return out


def bars_of(parts: Sequence, a: int, b: int) -> tuple[int, int]:
    return (parts[a].i0, parts[b].i1) if 0 <= a <= b < len(parts) else (0, 0)


def divergences_within(segments: Sequence[Segment], centers: Sequence[Zhongshu], moves: Sequence[Move], level: int, bars: tuple[int, int], force=None) -> list[Divergence]:
    """Those of moves that lie wholly in a range of merged bars; an inverted range holds none."""
    lo, hi = bars
    inside = []
    for m in moves:
        if lo <= hi and m.seg_start < len(segments) and m.seg_end < len(segments):
            a, b = bars_of(segments, m.seg_start, m.seg_end)
            if a >= lo and b <= hi:
                inside.append(m)
    return divergences(segments, centers, inside, level, force)


class Nested(NamedTuple):
    chain: tuple[tuple[int, Divergence], ...]
    bar_start: int
    bar_end: int


def nested_divergences(segments: Sequence[Segment], centers: Sequence[Zhongshu], moves: Sequence[Move], levels: Sequence[tuple], force=None) -> list[Nested]:
    """Divergences of high levels followed down: at each level the last one within the C part above, at level 1 with ``force``.

    ``levels`` are those of structure.recursion. Parts are mapped to merged bars through the
    settled moves below them, down to segments.
    """
    below = {1: list(moves)} | {level: made for level, _, _, made in levels}
    parts_of = {level: parts for level, parts, _, _ in levels}
    found = {level: divergences(parts, cs, made, level) for level, parts, cs, made in levels}

    def bars(move: Move, level: int) -> tuple[int, int]:
        if level == 1:
            return bars_of(segments, move.seg_start, move.seg_end)
        under = [m for m in below.get(level - 1, []) if m.settled]
        if move.seg_start >= len(under) or move.seg_end >= len(under):
            return 0, 0
        return bars(under[move.seg_start], level - 1)[0], bars(under[move.seg_end], level - 1)[1]

    def c_bars(d: Divergence, level: int) -> tuple[int, int] | None:
        parts = parts_of[level]
        return bars(parts[d.seg_c_end], level - 1) if d.seg_c_end < len(parts) else None

    out = []
    for top in sorted(found, reverse=True):
        for d in found[top]:
            span = c_bars(d, top)
            if span is None or span[0] >= span[1]:
                continue
            chain = [(top, d)]
            for level in range(top - 1, 1, -1):
                inside = [x for x in found[level] if (r := c_bars(x, level)) and r[0] >= span[0] and r[1] <= span[1]]
                if not inside:
                    break
                chain.append((level, inside[-1]))
                span = c_bars(inside[-1], level)
                if span[0] >= span[1]:
                    break
            if last := divergences_within(segments, centers, moves, 1, span, force):
                chain.append((1, last[-1]))
                span = bars_of(segments, last[-1].seg_c_start, last[-1].seg_c_end)
            out.append(Nested(tuple(chain), *span))
    return out


def small_to_big(segments: Sequence[Segment], centers: Sequence[Zhongshu], moves: Sequence[Move], own: Sequence[Divergence], sub: Sequence[Divergence], level: int) -> list[Turn]:
    """Unsettled trends without a divergence of their own whose last leg holds the end of one a level below."""
    out, n = [], len(segments)
    for m in moves:
        if m.kind != "trend" or m.zs_count < 2 or m.settled or any(d.seg_c_start >= m.seg_start and d.seg_c_end <= m.seg_end for d in own):
            continue
        settled = [c for c in centers[m.zs_start : m.zs_end + 1] if c.settled]
        if not settled:
            continue
        a, b = settled[-1].seg_end + 1, m.seg_end
        if a > b or a >= n or b >= n:
            continue
        lo, hi = segments[a].i0, segments[b].i1
        hit = next((d for d in sub if d.seg_c_end < n and lo <= segments[d.seg_c_end].i1 <= hi), None)
        if hit:
            out.append(Turn(level, "sell" if m.direction == UP else "buy", m.seg_start, m.direction, a, b, hit.seg_c_end))
    return out


# --- trading points ---------------------------------------------------------------------


def _next(segments: Sequence[Segment], at: int, direction: str) -> int | None:
    return next((k for k in range(at, len(segments)) if segments[k].direction == direction), None)


def points(segments: Sequence[Segment], centers: Sequence[Zhongshu], moves: Sequence[Move], divs: Sequence[Divergence], level: int) -> list[Point]:
    """The three kinds of points, by segment (kinds in order where segments are equal).

    type1: where a trend diverges. type2: the first pullback after it. type3: the first
    pullback after a center broke, if it stays outside the core.
    """

    def confirmed(k: int) -> bool:
        return next((m.settled for m in moves if m.seg_start <= k <= m.seg_end), False)

    def price(k: int, side: str) -> float:
        return segments[k].low if side == "buy" else segments[k].high

    one, two, three = [], [], []
    for d in divs:
        if d.kind != "trend" or d.center_idx >= len(centers):
            continue
        move = next((m for m in moves if m.kind == "trend" and m.zs_start <= d.center_idx <= m.zs_end), None)
        if move is None:
            continue
        c, k, side = centers[d.center_idx], d.seg_c_end, "buy" if d.direction == "bottom" else "sell"
        there = k < len(segments)
        key = {"div_center": d.center_idx, "div_c_start": d.seg_c_start, "div_c_end": d.seg_c_end}
        one.append(Point("type1", side, level, k, move.seg_start, c.zd, c.zg, c.seg_start, price(k, side) if there else 0.0, segments[k].i1 if there else 0, d.confirmed, **key))
        away, back = (UP, DOWN) if side == "buy" else (DOWN, UP)
        first = _next(segments, k + 1, away)
        j = None if first is None else _next(segments, first + 1, back)
        if j is not None:
            two.append(Point("type2", side, level, j, move.seg_start, c.zd, c.zg, c.seg_start, price(j, side), segments[j].i1, confirmed(j), **key))
    for c in centers:
        if not c.settled or not c.break_direction or not 0 <= c.break_seg < len(segments):
            continue
        rising = c.break_direction == UP
        j = _next(segments, c.break_seg + 1, DOWN if rising else UP)
        if j is not None and (segments[j].low > c.zg if rising else segments[j].high < c.zd):
            side = "buy" if rising else "sell"
            three.append(Point("type3", side, level, j, c.seg_start, c.zd, c.zg, c.seg_start, price(j, side), segments[j].i1, confirmed(j)))
    place = {(p.seg_idx, p.side): i for i, p in enumerate(three)}
    for i, p in enumerate(two):
        if (j := place.get((p.seg_idx, p.side))) is not None:
            two[i] = p._replace(overlaps_with="type3")
            three[j] = three[j]._replace(overlaps_with="type2")
    return sorted([*one, *two, *three], key=lambda p: p.seg_idx)


# --- the deciding level -----------------------------------------------------------------


class Liveness(NamedTuple):
    alive: bool
    regime: str
    exit_idx: int | None = None
    exit_side: str | None = None
    exit_extreme: float | None = None
    pullback_seen: bool = False
    pullback_settled: bool = False
    reason: str | None = None


class LStar(NamedTuple):
    level: int
    center_idx: int
    regime: str


def liveness(center, parts: Sequence, last_price: float) -> Liveness:
    """Whether a center still decides.

    ``center`` has low, high, seg1 and kind. In its core (by price, or by the current part
    while that belongs to it): alive. After a part has left: alive until, after a pullback, a
    part in the direction of leaving goes beyond the extreme reached before.
    """
    if center.kind != "settled":
        return Liveness(False, "dead_not_settled", reason="not_settled")
    low, high, n = center.low, center.high, len(parts)

    def cuts(p) -> bool:
        return max(p.low, low) < min(p.high, high)

    if low <= last_price <= high or (0 < n <= center.seg1 + 1 and cuts(parts[n - 1])):
        return Liveness(True, "settle_anchor_in_core")
    at = center.seg1 + 1
    if at >= n:
        return Liveness(False, "dead_negation_settled", reason="no_exit_segment")
    left = parts[at]
    if cuts(left):
        return Liveness(True, "settle_anchor_in_core", at)
    if left.low >= high:
        side, sign = "above", 1.0
        extreme = left.high
    elif left.high <= low:
        side, sign = "below", -1.0
        extreme = left.low
    else:
        return Liveness(False, "dead_negation_settled", reason="invalid_exit_side")
    seen = settled = False
    for p in parts[at + 1 :]:
        reach = p.high if side == "above" else p.low
        same = p.direction == left.direction
        if not seen:
            if same and sign * reach > sign * extreme:
                extreme = reach
            seen = not same or cuts(p)
        if seen and not settled and same and sign * reach > sign * extreme:
            settled = True
    if settled:
        return Liveness(False, "dead_negation_settled", at, side, extreme, seen, True, "pullback_settled")
    return Liveness(True, "event_anchor_first_pullback" if seen else "run_anchor_post_exit", at, side, extreme, seen)


def lstar(views: Sequence[tuple[int, Sequence, Sequence]], last_price: float) -> LStar | None:
    """Highest level with a live center, and its latest one; views are (level, parts, centers)."""
    for level, parts, centers in sorted(views, key=lambda v: -v[0]):
        alive = [(c.seg1, c.seg0, -i, state.regime) for i, c in enumerate(centers) if (state := liveness(c, parts, last_price)).alive]
        if alive:
            best = max(alive, key=lambda x: x[:3])
            return LStar(level, -best[2], best[3])
    return None


class View(NamedTuple):
    """A center as liveness wants it."""

    seg0: int
    seg1: int
    low: float
    high: float
    kind: str


def as_view(c: Zhongshu) -> View:
    return View(c.seg_start, c.seg_end, c.zd, c.zg, "settled" if c.settled else "candidate")
