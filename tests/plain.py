"""Plain restatements of the structure rules, for comparison with the engine's folds."""

from __future__ import annotations

import random


def walk(n: int, seed: int, step: int = 4) -> list[tuple[int, int, int, int]]:
    """(open, high, low, close) bars of a random walk in whole numbers."""
    rng, price, out = random.Random(seed), 1000, []
    for _ in range(n):
        o = price
        ticks = [o + rng.randint(-step, step) for _ in range(4)]
        price = ticks[-1]
        out.append((o, max(o, *ticks), min(o, *ticks), price))
    return out


def merge(bars):
    """[high, low, raw start, raw end] by inclusion."""
    out, way = [], "up"
    for i, (_, h, l, _) in enumerate(bars):
        if out:
            a = out[-1]
            if (a[0] >= h and a[1] <= l) or (a[0] <= h and a[1] >= l):
                f = max if way == "up" else min
                a[0], a[1], a[3] = f(a[0], h), f(a[1], l), i
                continue
            way = "up" if h > a[0] else "down"
        out.append([h, l, i, i])
    return out


def fractals(m):
    out = []
    for i in range(1, len(m) - 1):
        (ah, al, *_), (bh, bl, *_), (ch, cl, *_) = m[i - 1 : i + 2]
        if bh > ah and bh > ch and bl > al and bl > cl:
            out.append((i, "top", bh))
        if bl < al and bl < cl and bh < ah and bh < ch:
            out.append((i, "bottom", bl))
    return out


def alternating(fx):
    out = []
    for f in fx:
        if out and out[-1][1] == f[1]:
            if (f[2] > out[-1][2]) if f[1] == "top" else (f[2] < out[-1][2]):
                out[-1] = f
        else:
            out.append(f)
    return out


def strokes(bars, mode="wide", sep=5):
    """[i0, i1, direction, high, low, p0, p1] by trying fractals one after the other."""
    m = merge(bars)
    fx = alternating(fractals(m))
    out, at = [], None
    for f in fx:
        if at is None:
            at = f
            continue
        if f[1] == at[1]:
            if (f[2] > at[2]) if f[1] == "top" else (f[2] < at[2]):
                if out:
                    out[-1][1], out[-1][6] = f[0], f[2]
                at = f
            continue
        d = f[0] - at[0]
        ok = (d >= 2 and m[f[0]][2] - m[at[0]][3] - 1 >= 3) if mode == "new" else d >= (sep if mode == "strict" else 4)
        if ok and ((f[2] > at[2]) if f[1] == "top" else (f[2] < at[2])):
            out.append([at[0], f[0], "up" if f[1] == "top" else "down", 0, 0, at[2], f[2]])
            at = f
    for s in out:
        span = m[s[0] : s[1] + 1]
        s[3], s[4] = max(x[0] for x in span), min(x[1] for x in span)
    return out
