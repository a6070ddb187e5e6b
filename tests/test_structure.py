"""Folds against plain restatements, goldens, and prefix by prefix."""

import json

import pandas as pd
import pytest

from barloom.operators import events as ev
from barloom.operators import signals as sg
from barloom.operators import structure as st
from barloom.operators.layers import Settings
from tests import plain


def folded(bars, mode="wide", sep=5):
    f = st.StrokeFold(mode, sep)
    merged, found = [], []
    for i, (o, h, l, c) in enumerate(bars):
        m, x = f.push(i, i, o, h, l, c)
        merged += [m] if m else []
        found += [x] if x else []
    if f.merger.last:
        merged.append(f.merger.last)
        if len(f.tail) == 2 and (x := st.fractal_at(*f.tail, f.merger.last)):
            found.append(x)
    return merged, found, f.result()


def test_inclusion_golden():
    high, low = [10, 12, 11, 15, 13, 11, 10, 12, 14, 13], [5, 7, 8, 10, 9, 7, 8, 9, 8, 10]
    opens, closes = [6, 8, 9, 11, 10, 8, 9, 10, 9, 11], [9, 11, 10, 14, 12, 9, 9, 11, 13, 12]
    merged, _, _ = folded(list(zip(opens, high, low, closes)))
    assert [m.high for m in merged] == [10, 12, 15, 13, 10, 14]
    assert [m.low for m in merged] == [5, 8, 10, 9, 7, 10]
    assert [(m.raw_start, m.raw_end) for m in merged] == [(0, 0), (1, 2), (3, 3), (4, 4), (5, 6), (7, 9)]
    assert [m.open for m in merged] == [6, 8, 11, 10, 8, 10] and [m.close for m in merged] == [9, 10, 14, 12, 9, 12]


@pytest.mark.parametrize("mode", ["wide", "new", "strict"])
def test_strokes_are_the_plain_ones(mode):
    for seed in range(120):
        bars = plain.walk(150, seed, 3 + seed % 5)
        merged, found, strokes = folded(bars, mode)
        assert [[m.high, m.low, m.raw_start, m.raw_end] for m in merged] == plain.merge(bars)
        assert [(f.m_idx, f.kind, f.price) for f in found] == plain.fractals(plain.merge(bars))
        assert [list(s[:7]) for s in strokes] == plain.strokes(bars, mode)
        assert [s.confirmed for s in strokes] == [True] * (len(strokes) - 1) + [False] * bool(strokes)


def test_events_are_those_of_whole_lists():
    for seed in range(25):
        bars = plain.walk(140, seed, 5)
        fold = ev.EventFold(Settings(), False)
        rows = list(fold.push(pd.DataFrame({"ts_us": range(len(bars)), **{k: [b[i] for b in bars] for i, k in enumerate(("open", "high", "low", "close"))}})))
        before, want = [], []
        for k in range(len(bars)):
            now = folded(bars[: k + 1])[2]
            want += [(k, kind, payload) for kind, payload in ev.stroke_changes(before, now)]
            before = now
        assert [(r[1], r[4], json.loads(r[8])) for r in rows] == want
        assert [r[3] for r in rows] == list(range(len(rows)))


def stroke(i0, i1, d, high, low):
    return st.Stroke(i0, i1, d, high, low, *((low, high) if d == "up" else (high, low)), True)


def test_five_strokes_make_one_open_segment():
    s = [stroke(0, 5, "up", 15, 5), stroke(5, 10, "down", 14, 8), stroke(10, 15, "up", 18, 7), stroke(15, 20, "down", 13, 6), stroke(20, 25, "up", 20, 9)]
    out = st.segments_v1(s)
    assert [(x.s0, x.s1, x.direction, x.high, x.low, x.confirmed, x.kind) for x in out] == [(0, 4, "up", 20, 5, False, "settled")]
    assert [(x.s0, x.s1, x.confirmed) for x in st.segments_v0(s)] == [(0, 2, True), (2, 4, False)]


def zigzag(points, step=5):
    """Strokes through turning prices."""
    return [stroke(i * step, (i + 1) * step, "up" if b > a else "down", max(a, b), min(a, b)) for i, (a, b) in enumerate(zip(points, points[1:]))]


def test_segment_breaks_without_gap():
    # rising segment whose feature elements turn down without a gap
    s = zigzag([10, 20, 14, 26, 18, 24, 12, 17, 8, 15, 5])
    out = st.segments_v1(s)
    assert out[0].direction == "up" and out[0].confirmed and out[0].gap_type == "none" and out[0].trigger_k == out[0].s1 + 1 == out[1].s0
    assert out[1].direction == "down" and not out[-1].confirmed


def test_mirrored_strokes_give_mirrored_segments():
    for seed in range(60):
        points = [1000]
        import random

        rng = random.Random(seed)
        for i in range(40):
            points.append(points[-1] + (1 if i % 2 == 0 else -1) * rng.randint(3, 30))
        a, b = st.segments_v1(zigzag(points)), st.segments_v1(zigzag([2000 - p for p in points]))
        assert [(x.s0, x.s1, x.direction, x.confirmed, x.gap_type) for x in a] == [(x.s0, x.s1, "down" if x.direction == "up" else "up", x.confirmed, x.gap_type) for x in b]
        for x, y in zip(a, a[1:]):
            assert y.s0 == x.s1 + 1 and x.direction != y.direction and x.confirmed


class Part:
    def __init__(self, low, high, direction="up", i=0):
        self.low, self.high, self.direction, self.confirmed, self.kind = low, high, direction, True, "settled"
        self.s0, self.s1, self.i0, self.i1 = i, i + 2, i * 5, i * 5 + 5


def parts(*ranges):
    return [Part(lo, hi, "up" if i % 2 == 0 else "down", i) for i, (lo, hi) in enumerate(ranges)]


def test_center_golden():
    (z,) = st.zhongshus(parts((10, 20), (8, 18), (12, 22)))
    assert (z.zd, z.zg, z.settled, z.seg_count, z.gg, z.dd) == (12, 18, False, 3, 22, 8)
    z = st.zhongshus(parts((10, 20), (8, 18), (12, 22), (18, 25), (30, 40)))
    assert (z[0].seg_end, z[0].settled, z[0].break_seg, z[0].break_direction, z[0].gg) == (3, True, 4, "up", 25)


def test_moves_group_one_way_centers():
    def center(dd, gg, a, b, way="up"):
        return st.Zhongshu(dd, gg, a, b, b - a + 1, True, b + 1, way, gg, dd, a, b)

    cs = [center(10, 20, 0, 2), center(25, 30, 4, 6), center(22, 28, 8, 10, "down"), center(1, 5, 12, 14)]
    moves = st.moves_of(cs, 20)
    assert [(m.kind, m.direction, m.seg_start, m.seg_end, m.zs_start, m.zs_end, m.settled) for m in moves] == [
        ("trend", "up", 0, 7, 0, 1, True), ("trend", "down", 8, 19, 2, 3, False)
    ]
    assert [m.seg_end for m in st.moves_of(cs, None)] == [7, 14]
    assert [m.seg_end for m in st.moves_of(cs, reach=False)] == [6, 14]


def test_old_centers_take_back_one_that_returns():
    c = st.centers_v0(parts((10, 20), (8, 18), (12, 22), (25, 30), (15, 21), (26, 40), (27, 35)))
    assert (c[0].seg0, c[0].seg1, c[0].low, c[0].high, c[0].sustain, c[0].kind, c[0].terminated, c[0].termination_side) == (0, 4, 12, 20, 2, "settled", True, "above")
    assert c[0].gg == 22 and c[0].dd == 10
    t = st.trends_v0(parts((10, 20), (8, 18), (12, 22), (25, 30), (15, 21), (26, 40), (27, 35)), c)
    assert (t[0].seg0, t[0].seg1, t[0].kind, t[0].direction, t[0].confirmed) == (0, 6, "consolidation", "up", False)


def test_relation_falls_back_to_cores_at_zero():
    base = st.centers_v0(parts((10, 20), (8, 18), (12, 22)))[0]
    a, b = base._replace(gg=0.0), base._replace(low=base.low + 1, high=base.high + 1)
    assert st.center_relation(a, b) == "up" and st.center_relation(base, b) == "none"


def test_liveness():
    p = parts((10, 20), (8, 18), (12, 22))
    v = sg.View(0, 2, 12, 18, "settled")
    assert sg.liveness(v._replace(kind="candidate"), p, 15).reason == "not_settled"
    assert sg.liveness(v, p, 15).regime == "settle_anchor_in_core"
    out = [*p, Part(20, 30, "up", 3)]
    assert sg.liveness(v, out, 25).regime == "run_anchor_post_exit"
    out.append(Part(22, 29, "down", 4))
    assert sg.liveness(v, out, 25).regime == "event_anchor_first_pullback"
    out.append(Part(23, 40, "up", 5))
    assert sg.liveness(v, out, 25).reason == "pullback_settled"
    assert sg.lstar([(1, out[:5], [v])], 25).center_idx == 0 and sg.lstar([(1, out, [v])], 25) is None


def test_points_of_a_falling_trend():
    ranges = [(82, 100), (84, 95), (80, 93), (84, 94), (60, 86), (52, 70), (55, 72), (50, 68), (54, 69), (40, 58), (41, 50), (38, 45), (39, 60), (45, 58), (20, 50)]
    segs = [Part(lo, hi, "down" if i % 2 == 0 else "up", i) for i, (lo, hi) in enumerate(ranges)]
    for s in segs:
        s.confirmed = True
    cs = st.zhongshus(segs)
    moves = st.moves_of(cs, len(segs))
    ds = sg.divergences(segs, cs, moves, 1)
    for p in sg.points(segs, cs, moves, ds, 1):
        assert p.side in ("buy", "sell") and 0 <= p.seg_idx < len(segs)
        if p.kind == "type3":
            c = next(c for c in cs if c.seg_start == p.center_seg_start)
            assert segs[p.seg_idx].low > c.zg if p.side == "buy" else segs[p.seg_idx].high < c.zd


def test_event_ids_are_canonical():
    assert ev.event_id(1, 2.0, "x", 3, {"b": 1, "a": 2.5}) == ev.event_id(1, 2.0, "x", 3, {"a": 2.5, "b": 1})
    assert len(ev.stream_fingerprint(["a", "b"])) == 32 and ev.envelope_id("a", "s", ("q", "p")) == ev.envelope_id("a", "s", ("p", "q"))
    assert 0 <= ev.point_id((1, "type1", "buy", 1)) < 1 << 31


def move(kind, d, a, b, zs=(0, 0), settled=True, high=0.0, low=0.0):
    return st.Move(kind, d, a, b, *zs, zs[1] - zs[0] + 1, settled, high, low, a, b)


def test_nested_chain_maps_parts_to_bars():
    segs = [Part(0, 10, "up" if i % 2 == 0 else "down", i) for i in range(12)]
    ranges = [(5, 25, "down"), (0, 40, "up"), (8, 22, "down"), (12, 30, "up"), (10, 20, "down")]
    parts = [move("consolidation", d, 2 * k, 2 * k + 1, high=hi, low=lo) for k, (lo, hi, d) in enumerate(ranges)]
    center = st.Zhongshu(10, 20, 0, 2, 3, True, 3, "up", 40, 0, 0, 2)
    made = [move("consolidation", "up", 0, 3, settled=False)]
    below = [*parts, move("consolidation", "up", 10, 11, settled=False)]
    (got,) = sg.nested_divergences(segs, [], below, [(2, parts, [center], made)])
    assert [lv for lv, _ in got.chain] == [2] and (got.bar_start, got.bar_end) == (segs[6].i0, segs[7].i1)
    d = got.chain[0][1]
    assert (d.kind, d.direction, d.seg_a_start, d.seg_c_start, d.force_a, d.force_c, d.confirmed) == ("consolidation", "top", 1, 3, 40, 18, False)


def test_ranges_hold_only_whole_moves():
    segs = [Part(lo, hi, d, i) for i, (lo, hi, d) in enumerate([(0, 30, "up"), (10, 30, "down"), (10, 28, "up"), (9, 28, "down"), (9, 20, "up"), (5, 8, "down")])]
    center = st.Zhongshu(10, 20, 0, 2, 3, True, 5, "down", 30, 0, 0, 2)
    m = [move("consolidation", "down", 0, 4)]
    whole = sg.divergences(segs, [center], m, 1)
    assert [(d.direction, d.seg_a_start, d.seg_c_start) for d in whole] == [("top", 2, 4)]
    assert sg.divergences_within(segs, [center], m, 1, (0, 25)) == whole
    assert sg.divergences_within(segs, [center], m, 1, (1, 25)) == sg.divergences_within(segs, [center], m, 1, (25, 0)) == []


def test_macd_peaks_make_a_divergence_that_area_does_not():
    import numpy as np

    segs = [Part(0, 30, "up", 0), Part(10, 30, "down", 1), Part(10, 28, "up", 2), Part(9, 29, "up", 3)]
    for i, s in enumerate(segs):
        s.i0, s.i1 = i, i
    center = st.Zhongshu(10, 20, 0, 1, 2, True, 2, "up", 30, 0, 0, 1)
    m = [move("consolidation", "up", 0, 3)]
    raw = [(0, 1), (2, 3), (4, 5), (6, 7)]
    hist = np.array([0, 0, 0, 0, 5.0, 1.0, 4.0, 4.0])
    force = sg.Momentum(np.zeros(8), hist, raw)
    (d,) = sg.divergences(segs, [center], m, 1, force)
    assert (d.force_a, d.force_c, d.hist_peak_a, d.hist_peak_c) == (6.0, 8.0, 5.0, 4.0)
    assert sg.peak(hist, 5, 99, "up") == 0.0 and sg.macd_area(hist, -5, 99)["n_bars"] == 8 and sg.macd_area(hist, 7, 3)["area_pos"] == 0


def test_small_to_big_needs_a_turn_below():
    segs = [Part(0, 10, "up" if i % 2 == 0 else "down", i) for i in range(10)]
    cs = [st.Zhongshu(1, 2, 0, 2, 3, True, 3, "up", 3, 0, 0, 2), st.Zhongshu(5, 6, 3, 5, 3, True, 6, "up", 8, 4, 3, 5)]
    trend = move("trend", "up", 0, 9, (0, 1), settled=False)
    sub = sg.Divergence("trend", "top", 0, 0, 1, 6, 8, 0, 2.0, 1.0, True)
    (turn,) = sg.small_to_big(segs, cs, [trend], [], [sub], 1)
    assert (turn.side, turn.c_start, turn.c_end, turn.sub_c_end) == ("sell", 6, 9, 8)
    assert sg.small_to_big(segs, cs, [trend], [sub], [sub], 1) == [] == sg.small_to_big(segs, cs, [trend._replace(settled=True)], [], [sub], 1)
    assert sg.small_to_big(segs, cs, [trend], [], [sub._replace(seg_c_end=3)], 1) == []


def test_points_two_and_three_can_fall_together():
    segs = [Part(lo, hi, d, i) for i, (lo, hi, d) in enumerate([(50, 60, "down"), (50, 58, "up"), (48, 57, "down"), (20, 30, "down"), (20, 70, "up"), (61, 70, "down"), (61, 80, "up")])]
    z = st.Zhongshu(50, 57, 0, 2, 3, True, 4, "up", 60, 48, 0, 2)
    m = [move("trend", "down", 0, 3, (0, 0))]
    d = sg.Divergence("trend", "bottom", 1, 0, 1, 3, 3, 0, 2.0, 1.0, True)
    got = sg.points(segs, [z], m, [d], 1)
    assert [(p.kind, p.side, p.seg_idx, p.overlaps_with) for p in got] == [("type1", "buy", 3, None), ("type2", "buy", 5, "type3"), ("type3", "buy", 5, "type2")]
    assert got[0].price == 20 and got[1].price == 61 and got[0].confirmed and not got[1].confirmed


def test_points_change_by_key():
    p = sg.Point("type3", "buy", 1, 5, 0, 1.0, 2.0, 0, 10.0, 30, False)
    kinds = lambda a, b: [k for k, _ in ev.point_changes(a, b)]
    assert kinds([], [p]) == ["bsp_candidate"] and kinds([], [p._replace(confirmed=True)]) == ["bsp_candidate", "bsp_confirm"]
    assert kinds([p], [p._replace(confirmed=True, price=11.0)]) == ["bsp_confirm"] and kinds([p], [p._replace(price=11.0)]) == ["bsp_candidate"]
    assert kinds([p], []) == ["bsp_invalidate"] and kinds([p], [p]) == []


def test_centers_change_by_identity():
    z = st.Zhongshu(1.0, 2.0, 0, 2, 3, False, -1, "", 3.0, 0.0, 0, 2)
    kinds = lambda a, b: [k for k, _ in ev.CENTERS.changes(a, b)]
    assert kinds([], [z]) == ["zhongshu_candidate"] and kinds([z], [z._replace(seg_end=3)]) == ["zhongshu_candidate"]
    assert kinds([z], [z._replace(settled=True, seg_end=4, break_seg=5)]) == ["zhongshu_settle"]
    assert kinds([z], [z._replace(zd=1.5)]) == ["zhongshu_invalidate", "zhongshu_candidate"] and kinds([z], []) == ["zhongshu_invalidate"]
