"""Properties that hold for any bars."""

from hypothesis import given, settings
from hypothesis import strategies as s

from barloom.functions.folds import Ema, MacdLine, RsiLine
from barloom.operators import structure as st
from tests import plain


@s.composite
def bars(draw):
    rows = []
    for _ in range(draw(s.integers(0, 60))):
        low = draw(s.integers(0, 40))
        high = low + draw(s.integers(0, 12))
        rows.append((draw(s.integers(low, high)), high, low, draw(s.integers(low, high))))
    return rows


def folded(rows, mode):
    f = st.StrokeFold(mode)
    merged = [m for i, (o, h, l, c) in enumerate(rows) if (m := f.push(i, i, o, h, l, c)[0])]
    return merged + ([f.merger.last] if f.merger.last else []), f


@settings(max_examples=300, deadline=None)
@given(bars(), s.sampled_from(["wide", "new", "strict"]))
def test_folds_are_the_plain_rules(rows, mode):
    merged, f = folded(rows, mode)
    assert [[m.high, m.low, m.raw_start, m.raw_end] for m in merged] == plain.merge(rows)
    assert [list(x[:7]) for x in f.result()] == plain.strokes(rows, mode)
    for a, b in zip(merged, merged[1:]):
        assert not (a.high >= b.high and a.low <= b.low) and not (a.high <= b.high and a.low >= b.low) and b.raw_start == a.raw_end + 1


@settings(max_examples=200, deadline=None)
@given(bars())
def test_layers_above_are_well_formed(rows):
    _, f = folded(rows, "new")
    strokes = f.result()
    for make in (st.segments_v0, st.segments_v1):
        segments = make(strokes)
        for g in segments:
            own = strokes[g.s0 : g.s1 + 1]
            assert len(own) >= 3 and g.high == max(x.high for x in own) and g.low == min(x.low for x in own)
        for z in st.zhongshus(segments):
            assert z.zg > z.zd and z.seg_count >= 3 and z.gg >= z.zg and z.dd <= z.zd
        centers = st.centers_v0(segments)
        for c in centers:
            assert c.high > c.low and c.seg1 - c.seg0 >= 2 and (c.kind == "settled") == (c.sustain >= 2)
        trends = st.trends_v0(segments, centers)
        assert all(a.seg1 == b.seg0 or a.seg1 >= b.seg0 for a, b in zip(trends, trends[1:]))


@settings(max_examples=200, deadline=None)
@given(s.lists(s.floats(1, 1000), min_size=1, max_size=80))
def test_lines_stay_in_range(closes):
    e, m, r = Ema(5), MacdLine(), RsiLine(3)
    for i, c in enumerate(closes):
        v = e.next(c)
        assert min(closes[: i + 1]) - 1e-9 <= v <= max(closes[: i + 1]) + 1e-9
        macd, signal, hist = m.next(c)
        assert hist == macd - signal
        (x,) = r.next(c)
        assert x is None or -1e-9 <= x <= 100 + 1e-9
        assert x is None or i >= 3
