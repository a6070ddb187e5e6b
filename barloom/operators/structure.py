"""Market structure of one stream: merged bars, fractals, strokes, segments, centers, moves.

Plain state machines over rows in order; operators/layers.py runs them over many streams.
All positions count from 0 in the list of the layer below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

UP, DOWN = "up", "down"


class Merged(NamedTuple):
    m_idx: int
    ts: object
    open: float
    high: float
    low: float
    close: float
    raw_start: int
    raw_end: int


class Fractal(NamedTuple):
    m_idx: int
    kind: str
    price: float
    raw_start: int
    raw_end: int


class Stroke(NamedTuple):
    i0: int
    i1: int
    direction: str
    high: float
    low: float
    p0: float
    p1: float
    confirmed: bool


class Segment(NamedTuple):
    s0: int
    s1: int
    i0: int
    i1: int
    direction: str
    high: float
    low: float
    confirmed: bool
    kind: str
    p0: float
    p1: float
    ep0_i: int
    ep1_i: int
    trigger_k: int | None = None
    fractal_a: int | None = None
    gap_type: str | None = None


class Zhongshu(NamedTuple):
    """A center of three or more overlapping components; positions are among the confirmed components."""

    zd: float
    zg: float
    seg_start: int
    seg_end: int
    seg_count: int
    settled: bool
    break_seg: int
    break_direction: str
    gg: float
    dd: float
    first_s0: int
    last_s1: int


class Move(NamedTuple):
    kind: str
    direction: str
    seg_start: int
    seg_end: int
    zs_start: int
    zs_end: int
    zs_count: int
    settled: bool
    high: float
    low: float
    first_s0: int
    last_s1: int


class Center(NamedTuple):
    """A center of the older chain, bounded by its first and third segments."""

    seg0: int
    seg1: int
    low: float
    high: float
    kind: str
    confirmed: bool
    sustain: int
    direction: str
    gg: float
    dd: float
    g: float
    d: float
    zg_dynamic: float
    zd_dynamic: float
    terminated: bool
    termination_side: str
    development: str = ""


class Trend(NamedTuple):
    kind: str
    direction: str
    seg0: int
    seg1: int
    i0: int
    i1: int
    high: float
    low: float
    center_indices: tuple[int, ...]
    confirmed: bool


# --- bars -------------------------------------------------------------------------------


class Merger:
    """Inclusion: a bar whose range holds the last one's, or is held by it, is merged into it.

    Rising (or no direction yet) takes the higher high and low, falling the lower ones. Only
    the last merged bar can still change; ``push`` returns the one that no longer can.
    """

    __slots__ = ("count", "falling", "last")

    def __init__(self) -> None:
        self.last: Merged | None = None
        self.falling = False
        self.count = 0

    def push(self, raw: int, ts: object, o: float, h: float, l: float, c: float) -> Merged | None:
        last = self.last
        if last is not None:
            if (last.high >= h and last.low <= l) or (h >= last.high and l <= last.low):
                pick = min if self.falling else max
                self.last = Merged(last.m_idx, ts, last.open, pick(last.high, h), pick(last.low, l), c, last.raw_start, raw)
                return None
            self.falling = h < last.high
        self.last = Merged(self.count, ts, o, h, l, c, raw, raw)
        self.count += 1
        return last


def fractal_at(a: Merged, b: Merged, c: Merged) -> Fractal | None:
    """The middle bar as a top (high and low above both neighbours') or bottom (both below)."""
    if b.high > max(a.high, c.high) and b.low > max(a.low, c.low):
        return Fractal(b.m_idx, "top", b.high, b.raw_start, b.raw_end)
    if b.low < min(a.low, c.low) and b.high < min(a.high, c.high):
        return Fractal(b.m_idx, "bottom", b.low, b.raw_start, b.raw_end)
    return None


def _beyond(x: Fractal, y: Fractal) -> bool:
    """Whether x is more extreme than y of the same kind."""
    return x.price > y.price if x.kind == "top" else x.price < y.price


class GapRule(NamedTuple):
    """Whether two fractals stand far enough apart for a stroke: in merged bars, and in raw bars strictly between them."""

    merged: int
    raw: int = -1

    def __call__(self, a: Fractal, b: Fractal) -> bool:
        return b.m_idx - a.m_idx >= self.merged and (self.raw < 0 or b.raw_start - a.raw_end - 1 >= self.raw)


def gap_rule(mode: str, min_sep: int = 5, raw_gaps: bool = True) -> GapRule:
    """wide: 4 merged bars; strict: ``min_sep``; new: 2 merged bars and 3 raw ones between, or as wide when raw positions are not to be used."""
    if mode not in ("wide", "new", "strict"):
        raise ValueError(f"unknown stroke mode {mode!r}")
    if mode == "new" and raw_gaps:
        return GapRule(2, 3)
    return GapRule(min_sep if mode == "strict" else 4)


class StrokeFold:
    """Strokes from bars in order; besides the strokes it holds the bars from the anchor on.

    Fractals of a kind in a row count as their most extreme (of equals the first); that one is
    ``pending`` until the kind changes. ``anchor`` is the fractal the next stroke starts from.
    """

    def __init__(self, mode: str = "wide", min_sep: int = 5, raw_gaps: bool = True) -> None:
        self.far = gap_rule(mode, min_sep, raw_gaps)
        self.merger = Merger()
        self.tail: list[Merged] = []  # the last two bars that no longer change
        self.bars: list[tuple[float, float]] = []  # high and low of bars from m_idx ``base`` on
        self.base = 0
        self.anchor: Fractal | None = None
        self.pending: Fractal | None = None
        self.strokes: list[Stroke] = []

    def push(self, raw: int, ts: object, o: float, h: float, l: float, c: float) -> tuple[Merged | None, Fractal | None]:
        """Take a bar; return the merged bar and the fractal that became certain by it."""
        done = self.merger.push(raw, ts, o, h, l, c)
        return (done, self.certain(done)) if done else (None, None)

    def certain(self, bar: Merged) -> Fractal | None:
        found = fractal_at(*self.tail, bar) if len(self.tail) == 2 else None
        self.tail = [*self.tail[-1:], bar]
        self.bars.append((bar.high, bar.low))
        if found:
            closed, self.pending = _joined(self.pending, found)
            if closed:
                self.anchor, stroke, replaces = self.step(self.anchor, self.strokes[-1] if self.strokes else None, closed)
                if replaces:
                    self.strokes.pop()
                if stroke:
                    self.strokes.append(stroke)
            needed = (self.anchor or self.pending).m_idx
            del self.bars[: needed - self.base]
            self.base = needed
        return found

    def step(self, anchor: Fractal | None, last: Stroke | None, cand: Fractal) -> tuple[Fractal, Stroke | None, bool]:
        """(new anchor, stroke made, whether it replaces the last one) for the next fractal."""
        if anchor is None:
            return cand, None, False
        rising = cand.kind == "top"
        same = cand.kind == anchor.kind
        if same and not _beyond(cand, anchor):
            return anchor, None, False
        if same and last is None:
            return cand, None, False
        if not same and not (self.far(anchor, cand) and (cand.price > anchor.price if rising else cand.price < anchor.price)):
            return anchor, None, False
        span = self.bars[anchor.m_idx - self.base : cand.m_idx - self.base + 1]
        high, low = max(h for h, _ in span), min(l for _, l in span)
        if same:
            return cand, last._replace(i1=cand.m_idx, p1=cand.price, high=max(last.high, high), low=min(last.low, low)), True
        return cand, Stroke(anchor.m_idx, cand.m_idx, UP if rising else DOWN, high, low, anchor.price, cand.price, True), False

    def now(self) -> tuple[int, list[Stroke]]:
        """(number of certain strokes that still stand, strokes after them) if the stream ended here."""
        anchor, pending, keep, after = self.anchor, self.pending, len(self.strokes), []
        last = self.merger.last
        found = fractal_at(*self.tail, last) if last is not None and len(self.tail) == 2 else None
        closed = None
        if found:
            closed, pending = _joined(pending, found)
        for cand in filter(None, (closed, pending)):
            newest = after[-1] if after else self.strokes[keep - 1] if keep else None
            anchor, stroke, replaces = self.step(anchor, newest, cand)
            if replaces:
                if after:
                    after.pop()
                else:
                    keep -= 1
            if stroke:
                after.append(stroke)
        if not after and keep:
            keep -= 1
            after = [self.strokes[keep]]
        if after:
            after[-1] = after[-1]._replace(confirmed=False)
        return keep, after

    def result(self) -> list[Stroke]:
        keep, after = self.now()
        return [*self.strokes[:keep], *after]


def _joined(pending: Fractal | None, found: Fractal) -> tuple[Fractal | None, Fractal]:
    """(fractal whose run of one kind ended, new pending one)."""
    if pending is None or pending.kind != found.kind:
        return pending, found
    return None, (found if _beyond(found, pending) else pending)


# --- segments ---------------------------------------------------------------------------


def three_overlap(a, b, c) -> bool:
    return max(a.low, b.low, c.low) < min(a.high, b.high, c.high)


def first_overlap(strokes: Sequence[Stroke], at: int) -> int | None:
    return next((j for j in range(at, len(strokes) - 2) if three_overlap(*strokes[j : j + 3])), None)


def _segment(strokes: Sequence[Stroke], s0: int, s1: int, direction: str, confirmed: bool, kind: str = "settled", **evidence) -> Segment:
    """A segment over strokes s0..s1; its ends are those points of the boundary strokes that fit its direction."""
    own = strokes[s0 : s1 + 1]
    first, last = strokes[s0], strokes[s1]
    e0 = (first.i0, first.p0) if first.direction == direction else (first.i1, first.p1)
    e1 = (last.i1, last.p1) if last.direction == direction else (last.i0, last.p0)
    return Segment(s0, s1, first.i0, last.i1, direction, max(s.high for s in own), min(s.low for s in own), confirmed, kind, e0[1], e1[1], e0[0], e1[0], **evidence)


def segments_v0(strokes: Sequence[Stroke]) -> list[Segment]:
    """Three overlapping strokes make a segment, which shares its last stroke with the next."""
    out, j = [], 0
    while j + 2 < len(strokes):
        if three_overlap(*strokes[j : j + 3]):
            out.append(_segment(strokes, j, j + 2, strokes[j].direction, True))
            j += 2
        else:
            j += 1
    if out:
        out[-1] = out[-1]._replace(confirmed=False)
    return out


#: Feature elements at the end that are looked at for a turn.
TURN_WINDOW = 7


class _Ranges:
    """Ranges joined by inclusion, always in the sense of a rising segment: falling ones come mirrored."""

    __slots__ = ("high", "low", "rising")

    def __init__(self, rising: bool) -> None:
        self.high: list[float] = []
        self.low: list[float] = []
        self.rising = rising

    def add(self, high: float, low: float) -> bool:
        """Whether the range became an element of its own."""
        if self.high:
            h, l = self.high[-1], self.low[-1]
            if (h >= high and l <= low) or (high >= h and low <= l):
                pick = max if self.rising else min
                self.high[-1], self.low[-1] = pick(h, high), pick(l, low)
                return False
            self.rising = high > h
        self.high.append(high)
        self.low.append(low)
        return True

    def top(self, j: int) -> bool:
        h, l = self.high, self.low
        return h[j] > max(h[j - 1], h[j + 1]) and l[j] > max(l[j - 1], l[j + 1])

    def bottom(self, j: int) -> bool:
        h, l = self.high, self.low
        return l[j] < min(l[j - 1], l[j + 1]) and h[j] < min(h[j - 1], h[j + 1])


class _Turn:
    """Looks for the end of one segment in its feature sequence, the strokes against it."""

    def __init__(self, strokes: Sequence[Stroke], direction: str) -> None:
        self.strokes, self.direction = strokes, direction
        self.ranges = _Ranges(True)
        self.stroke: list[int] = []  # of each element, the last stroke in it
        self.looked = 0
        self.refused = -1

    def _mirrored(self, s: Stroke) -> tuple[float, float]:
        return (s.high, s.low) if self.direction == UP else (-s.low, -s.high)

    def feed(self, k: int) -> None:
        if self.ranges.add(*self._mirrored(self.strokes[k])):
            self.stroke.append(k)
        else:
            self.stroke[-1] = k
            self.looked = max(0, len(self.stroke) - 3)

    def find(self) -> tuple[int, int, str] | None:
        """(stroke that turns, its element, gap type): the first top among the last elements, past refused ones."""
        r, n = self.ranges, len(self.stroke)
        for j in range(max(1, self.looked, n - TURN_WINDOW), n - 1):
            if self.stroke[j] <= self.refused or not r.top(j):
                continue
            gap = r.low[j] >= r.high[j - 1]
            if gap and not self._answered(self.stroke[j]):
                continue
            self.looked = max(0, j - 1)
            return self.stroke[j], j, "second" if gap else "none"
        return None

    def _answered(self, after: int) -> bool:
        """A gap needs any fractal in the second sequence: the segment's own strokes after the turn, to the end."""
        second = _Ranges(False)
        for s in self.strokes[after + 1 :]:
            if s.direction == self.direction and second.add(*self._mirrored(s)):
                j = len(second.high) - 3  # its right neighbour no longer changes
                if j > 0 and (second.top(j) or second.bottom(j)):
                    return True
        j = len(second.high) - 2
        return j > 0 and (second.top(j) or second.bottom(j))


def segments_v1(strokes: Sequence[Stroke], min_strokes: int = 3) -> list[Segment]:
    """Segments that end where their feature sequence turns and three strokes of the next overlap."""
    n = len(strokes)
    start = first_overlap(strokes, 0)
    if start is None:
        return []
    out: list[Segment] = []
    direction = strokes[start].direction
    turn, k = _Turn(strokes, direction), start
    while k < n:
        found = None
        if strokes[k].direction != direction:
            turn.feed(k)
            found = turn.find()
        if found is None:
            k += 1
            continue
        at, element, gap = found
        if at - start < min_strokes or at + 2 >= n or not three_overlap(*strokes[at : at + 3]):
            turn.refused = at
            k += 1
            continue
        out.append(_segment(strokes, start, at - 1, direction, True, trigger_k=at, fractal_a=element - 1, gap_type=gap))
        start, direction, k = at, DOWN if direction == UP else UP, at
        turn = _Turn(strokes, direction)
    if n - start >= min_strokes:
        settled = start + 2 < n and three_overlap(*strokes[start : start + 3])
        out.append(_segment(strokes, start, n - 1, direction, False, "settled" if settled else "candidate"))
    elif out:
        last = out[-1]
        out[-1] = _segment(strokes, last.s0, n - 1, last.direction, False, last.kind)
    elif start < n:
        out.append(_segment(strokes, start, n - 1, direction, False, "candidate"))
    return out


def feature_sequence(strokes: Sequence[Stroke], segment: Segment) -> list[tuple[int, float, float]]:
    """(stroke, high, low) of the strokes against a segment."""
    return [(k, strokes[k].high, strokes[k].low) for k in range(segment.s0, segment.s1 + 1) if strokes[k].direction != segment.direction]


def merged_features(bars: Sequence[tuple[int, float, float]]) -> list[tuple[int, int, float, float]]:
    """(first position, last position, high, low) after inclusion in order; positions are in ``bars``."""
    merger, out = Merger(), []
    for i, (_, high, low) in enumerate(bars):
        done = merger.push(i, None, 0.0, high, low, 0.0)
        if done:
            out.append(done)
    if merger.last:
        out.append(merger.last)
    return [(m.raw_start, m.raw_end, m.high, m.low) for m in out]


def feature_fractals(merged: Sequence[tuple[int, int, float, float]]) -> list[tuple[int, str, float]]:
    """(position, kind, price) of tops and bottoms among merged features."""
    bars = [Merged(i, None, 0.0, h, l, 0.0, i, i) for i, (_, _, h, l) in enumerate(merged)]
    found = (fractal_at(*bars[i - 1 : i + 2]) for i in range(1, len(bars) - 1))
    return [(f.m_idx, f.kind, f.price) for f in found if f]


# --- centers and moves ------------------------------------------------------------------


def centers_of(parts: Sequence, label: Callable[[int], int] = int) -> list[Zhongshu]:
    """Centers over components that all count: three in a row overlap, further ones touch.

    The core [zd, zg] stays as the first three set it. The first component outside settles
    the center; the search goes on from the last one inside. An unsettled center is the last.
    ``label`` turns a position into the index that is reported.
    """
    out, i, n = [], 0, len(parts)
    while i + 2 < n:
        core = parts[i : i + 3]
        zd, zg = max(p.low for p in core), min(p.high for p in core)
        if zg <= zd:
            i += 1
            continue
        end = next((j for j in range(i + 3, n) if parts[j].high < zd or parts[j].low > zg), n)
        inside = parts[i:end]
        settled = end < n
        way = (UP if parts[end].low > zg else DOWN) if settled else ""
        out.append(
            Zhongshu(
                zd, zg, label(i), label(end - 1), end - i, settled, label(end) if settled else -1, way,
                max(p.high for p in inside), min(p.low for p in inside), getattr(parts[i], "s0", label(i)), getattr(parts[end - 1], "s1", label(end - 1)),
            )
        )
        if not settled:
            break
        i = end - 1
    return out


def zhongshus(segments: Sequence[Segment]) -> list[Zhongshu]:
    """Centers over confirmed segments; positions are among those."""
    return centers_of([s for s in segments if s.confirmed])


def moves_of(centers: Sequence[Zhongshu], num_segments: int | None = None, reach: bool = True) -> list[Move]:
    """Settled centers grouped while each stands wholly above (or below) the one before.

    Two or more make a trend, one a consolidation that goes where its center broke. With
    ``reach`` a move lasts until the next one's first segment, the last until
    ``num_segments`` if given; without it, until its last center ends.
    """
    settled = [(i, c) for i, c in enumerate(centers) if c.settled]
    groups: list[tuple[str, list[tuple[int, Zhongshu]]]] = []
    for item in settled:
        if groups:
            way, group = groups[-1]
            before, c = group[-1][1], item[1]
            step = UP if c.dd > before.gg else DOWN if c.gg < before.dd else ""
            if step and way in ("", step):
                groups[-1] = (step, [*group, item])
                continue
        groups.append(("", [item]))
    out = []
    for g, (way, group) in enumerate(groups):
        first, last = group[0][1], group[-1][1]
        end = last.seg_end
        if reach and g + 1 < len(groups):
            end = groups[g + 1][1][0][1].seg_start - 1
        elif reach and num_segments:
            end = num_segments - 1
        out.append(
            Move(
                "trend" if len(group) > 1 else "consolidation", way if len(group) > 1 else first.break_direction, first.seg_start, end, group[0][0], group[-1][0], len(group),
                g + 1 < len(groups), max(c.gg for _, c in group), min(c.dd for _, c in group), first.first_s0, last.last_s1,
            )
        )
    return out


class Component(NamedTuple):
    """Common shape of what a level is built from."""

    component_idx: int
    high: float
    low: float
    direction: str
    completed: bool
    level_id: int


def segment_components(segments: Sequence[Segment]) -> list[Component]:
    return [Component(i, s.high, s.low, s.direction, s.confirmed and s.kind == "settled", 0) for i, s in enumerate(segments)]


def move_components(moves: Sequence[Move], level: int) -> list[Component]:
    return [Component(i, m.high, m.low, m.direction, m.settled, level) for i, m in enumerate(moves)]


def component_centers(parts: Sequence[Component]) -> list[Zhongshu]:
    """Centers over completed components, reported by component index."""
    done = [p for p in parts if p.completed]
    return centers_of(done, lambda i: done[i].component_idx)


def recursion(moves: Sequence[Move], max_levels: int = 6) -> list[tuple[int, list[Move], list[Zhongshu], list[Move]]]:
    """(level, components, centers, moves) of levels 2 and up; level 2 always, then while three moves are there."""
    out, below = [], list(moves)
    for level in range(2, max_levels + 1):
        settled = [m for m in below if m.settled]
        centers = component_centers(move_components(settled, level - 1))
        made = moves_of(centers, reach=False)
        out.append((level, settled, centers, made))
        below = made
        if len(made) < 3:
            break
    return out


# --- the older chain --------------------------------------------------------------------


def centers_v0(segments: Sequence, sustain_m: int = 2) -> list[Center]:
    """Centers whose core is that of their first and third segments, which go one way.

    Later segments belong while they cut the core; one that leaves and a next one that cuts
    it again belong both. Settled from ``sustain_m`` later segments on.
    """
    out, i, n = [], 0, len(segments)
    while i + 2 < n:
        a, b, c = segments[i : i + 3]
        if not three_overlap(a, b, c) or (a.direction and c.direction and a.direction != c.direction):
            i += 1
            continue
        zd, zg = max(a.low, c.low), min(a.high, c.high)

        def cuts(j: int, zd: float = zd, zg: float = zg) -> bool:
            return j < n and max(zd, segments[j].low) < min(zg, segments[j].high)

        end = i + 3
        while end < n and (cuts(end) or cuts(end + 1)):
            end += 1 if cuts(end) else 2
        sustain, side = end - i - 3, ""
        terminated = end + 1 < n
        if terminated:
            side = "above" if segments[end].low >= zg else "below" if segments[end].high <= zd else ""
        inside = segments[i:end]
        way = [s for s in (a, c, *segments[i + 3 : end]) if s is a or s is c or s.direction == a.direction]
        out.append(
            Center(
                i, end - 1, zd, zg, "settled" if sustain >= sustain_m else "candidate", True, sustain, a.direction,
                max(s.high for s in way), min(s.low for s in way), min(s.high for s in way), max(s.low for s in way),
                min(s.high for s in inside), max(s.low for s in inside), terminated, side,
            )
        )
        i = end
    if out:
        out[-1] = out[-1]._replace(confirmed=False)
    return out


def center_relation(a: Center, b: Center) -> str:
    """up, down, higher_center or none, of a center and a later one.

    By whole ranges [dd, gg], unless any of these is 0.0, which stands for unknown: then by cores.
    """
    if a.gg and a.dd and b.gg and b.dd:
        if b.gg < a.dd:
            return DOWN
        if b.dd > a.gg:
            return UP
        return "higher_center" if b.high < a.low or b.low > a.high else "none"
    if b.high > a.high and b.low > a.low:
        return UP
    return DOWN if b.high < a.high and b.low < a.low else "none"


def trends_v0(segments: Sequence, centers: Sequence[Center]) -> list[Trend]:
    """Settled centers grouped by one-way relation; neighbours share their boundary segment."""
    if not segments:
        return []
    last = len(segments) - 1
    groups: list[tuple[str, list[int]]] = []
    for i in (i for i, c in enumerate(centers) if c.kind == "settled"):
        if groups:
            way, group = groups[-1]
            step = center_relation(centers[group[-1]], centers[i])
            if step in (UP, DOWN) and way in ("", step):
                groups[-1] = (step, [*group, i])
                continue
        groups.append(("", [i]))
    out: list[Trend] = []
    for g, (way, group) in enumerate(groups):
        seg0 = min(centers[group[0]].seg0, last) if g else 0
        seg1 = last if g + 1 == len(groups) else min(centers[groups[g + 1][1][0]].seg0, last)
        seg1 = max(seg0, seg1)
        if seg1 - seg0 < 2:
            seg1 = min(seg0 + 2, last)
        own = segments[seg0 : seg1 + 1]
        made = Trend(
            "trend" if len(group) > 1 else "consolidation", way or segments[centers[group[0]].seg0].direction, seg0, seg1, segments[seg0].i0, segments[seg1].i1,
            max(s.high for s in own), min(s.low for s in own), tuple(group), True,
        )
        before = out[-1] if out else None
        if before and before.kind == made.kind == "trend" and before.direction == made.direction and before.seg1 == made.seg0:
            out[-1] = before._replace(
                seg1=made.seg1, i1=made.i1, high=max(before.high, made.high), low=min(before.low, made.low), center_indices=tuple(dict.fromkeys(before.center_indices + made.center_indices))
            )
        else:
            out.append(made)
    if out:
        out[-1] = out[-1]._replace(confirmed=False)
    return out


def with_development(centers: Sequence[Center]) -> list[Center]:
    """Label settled centers by what the next settled one says: newborn, expansion or extension."""
    out = list(centers)
    settled = [i for i, c in enumerate(centers) if c.kind == "settled"]
    for i, nxt in zip(settled, [*settled[1:], None]):
        c = centers[i]
        if nxt is None:
            label = "newborn" if c.terminated else "extension" if c.sustain > 0 else ""
        else:
            label = {UP: "newborn", DOWN: "newborn", "higher_center": "expansion"}.get(center_relation(c, centers[nxt]), "extension")
        out[i] = c._replace(development=label)
    return out


def recursive_levels(segments: Sequence, sustain_m: int = 2, max_levels: int = 10) -> Iterator[tuple[int, Sequence, list[Center], list[Trend]]]:
    """(level, components, centers, trends) of the older chain; confirmed trends are the next level's components."""
    parts = segments
    for level in range(1, max_levels + 1):
        if len(parts) < 3:
            return
        centers = centers_v0(parts, sustain_m)
        if not centers:
            return
        trends = trends_v0(parts, centers)
        if not trends:
            return
        yield level, parts, with_development(centers), trends
        parts = [t for t in trends if t.confirmed]
