"""The event log: what changed in a stream's structure at each bar.

At every bar each layer's list is compared with the list before it. Entries that fall away
are invalidated, unless the entry now at their place is the same thing grown; new entries
are candidates, and settle when they become certain. Ids are content-addressed, so reruns
give the same log. Bars fold in one pass: only the last strokes are compared, and the layers
above are built anew only when a stroke changed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import signals as sg
from barloom.operators import structure as st
from barloom.operators.fold import fold_streams
from barloom.operators.layers import Settings, _bars

#: A change: (event type, payload).
Change = tuple[str, dict]
SAME = 1e-9


def event_id(bar_idx: int, bar_ts: float, event_type: str, seq: int, payload: dict) -> str:
    """16 hex digits of SHA-256 over the canonical JSON (sorted keys) of an event."""
    return sha256(json.dumps({"bar_idx": bar_idx, "bar_ts": bar_ts, "event_type": event_type, "seq": seq, **payload}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def stream_fingerprint(ids: Sequence[str]) -> str:
    """32 hex digits over event ids in order."""
    return sha256(":".join(ids).encode()).hexdigest()[:32]


def envelope_id(event: str, stream: str, parents: Sequence[str] = ()) -> str:
    return sha256(json.dumps({"event_id": event, "stream_id": stream, "parents": sorted(parents)}, sort_keys=True).encode()).hexdigest()[:16]


def point_id(key: tuple[int, str, str, int]) -> int:
    """A stable positive number for a point's key (seg_idx, kind, side, level_id)."""
    return int.from_bytes(sha256("|".join(map(str, key)).encode()).digest()[:4], "big") & 0x7FFFFFFF


def _some(x: object, *names: str) -> dict:
    return {n: getattr(x, n) for n in names}


# --- comparing two lists ----------------------------------------------------------------


def stroke_changes(before: Sequence[st.Stroke], now: Sequence[st.Stroke], offset: int = 0) -> list[Change]:
    """Changes between stroke lists whose first ``offset`` entries are known to agree and are left out."""

    def same(a: st.Stroke, b: st.Stroke) -> bool:
        return (a.i0, a.i1, a.direction, a.confirmed) == (b.i0, b.i1, b.direction, b.confirmed) and abs(a.p0 - b.p0) < SAME and abs(a.p1 - b.p1) < SAME

    k = _agree(before, now, same)
    out: list[Change] = []
    whole = ("direction", "i0", "i1", "p0", "p1")
    for i, s in enumerate(before[k:], k):
        out.append(("stroke_invalidated", {"stroke_id": offset + i, **_some(s, *whole)}))
    for i, s in enumerate(now[k:], k):
        old = before[i] if i < len(before) else None
        if s.confirmed:
            out.append(("stroke_settled", {"stroke_id": offset + i, **_some(s, *whole)}))
        elif old is not None and old.i0 == s.i0 and old.direction == s.direction and not old.confirmed:
            if old.i1 != s.i1 or abs(old.p1 - s.p1) > SAME:
                out.append(("stroke_extended", {"stroke_id": offset + i, "direction": s.direction, "old_i1": old.i1, "new_i1": s.i1, "old_p1": old.p1, "new_p1": s.p1}))
        else:
            out.append(("stroke_candidate", {"stroke_id": offset + i, **_some(s, *whole)}))
    return out


def _agree(a: Sequence, b: Sequence, same: Callable[[object, object], bool]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if not same(x, y)), min(len(a), len(b)))


class _Layer:
    """How a layer's entries are compared: equality, identity, and what they say."""

    def __init__(self, equal: Callable, identity: Callable, gone: Callable, grown: Callable, new: Callable) -> None:
        self.equal, self.identity, self.gone, self.grown, self.new = equal, identity, gone, grown, new

    def changes(self, before: Sequence, now: Sequence) -> list[Change]:
        k = _agree(before, now, lambda a, b: self.equal(a) == self.equal(b))
        stays = {i for i in range(k, min(len(before), len(now))) if self.identity(before[i]) == self.identity(now[i])}
        out = [self.gone(i, x) for i, x in enumerate(before[k:], k) if i not in stays]
        for i, x in enumerate(now[k:], k):
            out += self.grown(i, before[i], x) if i in stays else self.new(i, x)
        return out


def _segment_end(i: int, s: st.Segment) -> list[Change]:
    gap = "gap" if s.gap_type == "second" else "none"
    pending = {"segment_id": i, "direction": s.direction, "break_at_stroke": s.trigger_k, "gap_class": gap, "fractal_type": "top" if s.direction == st.UP else "bottom", "s0": s.s0, "s1": s.s1}
    settle = {
        "segment_id": i, "direction": s.direction, "s0": s.s0, "s1": s.s1, "ep0_price": s.p0, "ep1_price": s.p1, "gap_class": gap, "new_segment_s0": s.trigger_k,
        "new_segment_direction": st.DOWN if s.direction == st.UP else st.UP,
    }
    return [("segment_break_pending", pending), ("segment_settle", settle)]


SEGMENTS = _Layer(
    lambda s: (s.s0, s.s1, s.direction, s.confirmed, s.kind),
    lambda s: (s.s0, s.direction),
    lambda i, s: ("segment_invalidate", {"segment_id": i, **_some(s, "direction", "s0", "s1")}),
    lambda i, old, s: _segment_end(i, s) if s.confirmed and not old.confirmed and s.kind == "settled" and s.trigger_k is not None else [],
    lambda i, s: _segment_end(i, s) if s.confirmed and s.kind == "settled" and s.trigger_k is not None else [],
)


def _center_changes(level: int | None) -> _Layer:
    extra = {} if level is None else {"level_id": level}
    core = ("zd", "zg", "seg_start", "seg_end")

    def candidate(i: int, z: st.Zhongshu) -> Change:
        return "zhongshu_candidate", {"zhongshu_id": i, **_some(z, *core, "seg_count"), **extra}

    def settle(i: int, z: st.Zhongshu) -> Change:
        return "zhongshu_settle", {"zhongshu_id": i, **_some(z, *core, "seg_count"), "break_seg_id": z.break_seg, "break_direction": z.break_direction, **extra}

    def grown(i: int, old: st.Zhongshu, z: st.Zhongshu) -> list[Change]:
        if z.settled and not old.settled:
            return [settle(i, z)]
        return [candidate(i, z)] if z.seg_end != old.seg_end else []

    return _Layer(
        lambda z: (*(getattr(z, c) for c in core), z.settled),
        lambda z: (z.zd, z.zg, z.seg_start),
        lambda i, z: ("zhongshu_invalidate", {"zhongshu_id": i, **_some(z, *core), **extra}),
        grown,
        lambda i, z: [candidate(i, z), *([settle(i, z)] if z.settled else [])],
    )


def _move_changes(level: int | None) -> _Layer:
    extra = {} if level is None else {"level_id": level}
    short = ("kind", "direction", "seg_start", "seg_end")

    def said(what: str, i: int, m: st.Move) -> Change:
        return f"move_{what}", {"move_id": i, **_some(m, *short, "zs_start", "zs_end", "zs_count"), **extra}

    def grown(i: int, old: st.Move, m: st.Move) -> list[Change]:
        if m.settled and not old.settled:
            return [said("settle", i, m)]
        return [said("candidate", i, m)] if m.zs_end != old.zs_end or m.kind != old.kind else []

    return _Layer(
        lambda m: (m.kind, m.direction, m.seg_start, m.zs_end, m.settled),
        lambda m: m.seg_start,
        lambda i, m: ("move_invalidate", {"move_id": i, **_some(m, *short), **extra}),
        grown,
        lambda i, m: [said("candidate", i, m), *([said("settle", i, m)] if m.settled else [])],
    )


CENTERS, MOVES = _center_changes(None), _move_changes(None)


def point_changes(before: Sequence[sg.Point], now: Sequence[sg.Point]) -> list[Change]:
    """Points are compared by key, not by place; at most one change of state a point and bar."""

    def keyed(points: Sequence[sg.Point]) -> dict[tuple, sg.Point]:
        return {(p.seg_idx, p.kind, p.side, p.level_id): p for p in points}

    def short(key: tuple, p: sg.Point) -> dict:
        return {"bsp_id": point_id(key), **_some(p, "kind", "side", "level_id", "seg_idx", "price")}

    def candidate(key: tuple, p: sg.Point) -> Change:
        return "bsp_candidate", {**short(key, p), **_some(p, "move_seg_start", "center_seg_start"), "overlaps_with": p.overlaps_with or ""}

    old, new = keyed(before), keyed(now)
    out: list[Change] = []
    for key in sorted(set(old) - set(new)):
        out.append(("bsp_invalidate", {k: v for k, v in short(key, old[key]).items() if k != "price"}))
    for key in sorted(new):
        p, q = new[key], old.get(key)
        if q is None:
            out += [candidate(key, p), *([("bsp_confirm", short(key, p))] if p.confirmed else [])]
        elif p.confirmed and not q.confirmed:
            out.append(("bsp_confirm", short(key, p)))
        elif p.settled and not q.settled:
            out.append(("bsp_settle", short(key, p)))
        elif p.price != q.price or p.overlaps_with != q.overlaps_with:
            out.append(candidate(key, p))
    return out


# --- the log ----------------------------------------------------------------------------

SCHEMA = "layer string, bar_idx long, bar_ts double, seq long, event_type string, event_id string, level_id int, subject_id long, payload string"


def _each(rows: pd.DataFrame) -> Iterator[tuple]:
    return zip(*(rows[k].tolist() for k in ("ts_us", "open", "high", "low", "close")))


class EventFold:
    """Bars of one stream in, events out. ``upper`` adds the layers above strokes."""

    def __init__(self, settings: Settings, upper: bool) -> None:
        self.settings, self.upper = settings, upper
        self.fold = st.StrokeFold(settings.stroke_mode, settings.min_sep, settings.raw_gaps)
        self.keep, self.tail = 0, []
        self.raw = 0
        self.seq: dict[str, int] = {}
        self.lists: dict[tuple, list] = {}
        self.levels: list[int] = []

    def _said(self, engine: str, layer: str, bar_ts: float, changes: list[Change], level: int = 1) -> Iterator[tuple]:
        for kind, payload in changes:
            seq = self.seq.get(engine, 0)
            self.seq[engine] = seq + 1
            subject = next(iter(payload.values()))
            yield (layer, self.raw, bar_ts, seq, kind, event_id(self.raw, bar_ts, kind, seq, payload), payload.get("level_id", level), subject, json.dumps(payload, sort_keys=True))

    def _next(self, key: tuple, now: list) -> list:
        before, self.lists[key] = self.lists.get(key, []), now
        return before

    def _above(self, strokes: list[st.Stroke], ts: float) -> Iterator[tuple]:
        s = self.settings
        segments = st.segments_v1(strokes, s.min_strokes) if s.segments == "v1" else st.segments_v0(strokes)
        yield from self._said("segment", "segment", ts, SEGMENTS.changes(self._next(("segment",), segments), segments))
        centers = st.zhongshus(segments)
        yield from self._said("zhongshu", "zhongshu", ts, CENTERS.changes(self._next(("zhongshu",), centers), centers))
        moves = st.moves_of(centers, len(segments) if s.reach else None)
        yield from self._said("move", "move", ts, MOVES.changes(self._next(("move",), moves), moves))
        points = sg.points(segments, centers, moves, sg.divergences(segments, centers, moves, 1), 1)
        yield from self._said("bsp", "bsp", ts, point_changes(self._next(("bsp",), points), points))
        reached = st.recursion(moves, s.max_levels)
        self.levels = [level for level, *_ in reached]
        for level, _, own, made in reached:
            engine = f"level{level}"
            yield from self._said(engine, "zhongshu", ts, _center_changes(level).changes(self._next(("zhongshu", level), own), own), level)
            yield from self._said(engine, "move", ts, _move_changes(level).changes(self._next(("move", level), made), made), level)

    def push(self, rows: pd.DataFrame) -> Iterator[tuple]:
        for bar in _each(rows):
            yield from self.bar(*bar)

    def bar(self, ts_us: int, o: float, h: float, l: float, c: float) -> Iterator[tuple]:
        self.fold.push(self.raw, ts_us, o, h, l, c)
        keep, tail = self.fold.now()
        common = max(0, min(self.keep, keep) - 1)
        certain = self.fold.strokes
        # strokes before ``common`` are certain in both and cannot have changed since
        before = [*self.older[common - self.older_from : self.keep - self.older_from], *self.tail] if self.keep else list(self.tail)
        now = [*certain[common:keep], *tail]
        ts = ts_us / 1e6
        changes = stroke_changes(before, now, common)
        yield from self._said("stroke", "stroke", ts, changes)
        if self.upper and (changes or before != now):
            yield from self._above([*certain[:keep], *tail], ts)
        self.keep, self.tail = keep, tail
        self.older_from = max(0, keep - 3)
        self.older = certain[self.older_from : keep]
        self.raw += 1

    older_from, older = 0, ()

    def finish(self) -> Iterator[tuple]:
        return iter(())


def event_log(bars: DataFrame, settings: Settings = Settings(), upper: bool = True) -> DataFrame:
    """All events of every stream: stream_id and SCHEMA. seq counts per stream and engine."""
    return fold_streams(_bars(bars), lambda _: EventFold(settings, upper), SCHEMA, ["stream_id"], ["ts_us"])


class LStarFold(EventFold):
    """Bars of one stream in, the deciding level at every bar out."""

    def push(self, rows: pd.DataFrame) -> Iterator[tuple]:
        for bar in _each(rows):
            for _ in self.bar(*bar):
                pass
            views = [(1, self.lists.get(("segment",), []), [sg.as_view(c) for c in self.lists.get(("zhongshu",), [])])]
            below = self.lists.get(("move",), [])
            for level in self.levels:
                views.append((level, below, [sg.as_view(c) for c in self.lists["zhongshu", level]]))
                below = self.lists["move", level]
            found = sg.lstar(views, bar[-1])
            yield self.raw - 1, bar[0] / 1e6, *((found.level, found.center_idx, found.regime) if found else (None, None, None))


def lstar_by_bar(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(stream_id, bar_idx, bar_ts, level, center_idx, regime): the level that decides as seen at each bar; nulls while there is none."""
    return fold_streams(_bars(bars), lambda _: LStarFold(settings, True), "bar_idx long, bar_ts double, level int, center_idx long, regime string", ["stream_id"], ["ts_us"])


class Replay(NamedTuple):
    """Where a replay of a log stands. ``current`` bars are done of ``total``; modes are idle, playing, paused and done."""

    total: int
    current: int = 0
    mode: str = "idle"
    speed: float = 1.0

    def step(self, log: DataFrame, count: int = 1) -> tuple[DataFrame, Replay]:
        """(events of the next ``count`` bars, the state after them); past the last bar there are none and the mode is done."""
        upto = min(self.total, self.current + max(0, count))
        events = log.where((F.col("bar_idx") >= self.current) & (F.col("bar_idx") < upto))
        return events, self._replace(current=upto, mode="done" if upto >= self.total else self.mode)

    def seek(self, log: DataFrame, target: int) -> tuple[DataFrame, Replay]:
        """(all events up to bar ``target`` with it, the state there); targets are held within the bars."""
        at = max(0, min(target, self.total - 1))
        done = at + 1 >= self.total
        return replayed(log, F.lit(at)), self._replace(current=min(at + 1, self.total), mode="done" if done else "paused" if self.mode == "done" else self.mode)

    def play(self, speed: float | None = None) -> Replay:
        return self._replace(mode="playing" if self.current < self.total else "done", speed=speed or self.speed)

    def pause(self) -> Replay:
        return self._replace(mode="paused") if self.mode == "playing" else self


def replayed(log: DataFrame, upto: Column) -> DataFrame:
    """The log as it stood after bar ``upto`` (inclusive): seeking is filtering."""
    return log.where(F.col("bar_idx") <= upto)


def current(log: DataFrame) -> DataFrame:
    """What stands after all events: the last event of each subject, unless that took it back."""
    latest = Window.partitionBy("stream_id", "layer", "level_id", "subject_id").orderBy(F.col("bar_idx").desc(), F.col("seq").desc())
    return log.withColumn("__n", F.row_number().over(latest)).where((F.col("__n") == 1) & ~F.col("event_type").rlike("invalidate")).drop("__n")


#: Characters that JSON text escapes by a letter, as UTF-16 units.
SHORT_ESCAPES = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}


def json_text(text: Column) -> Column:
    """What stands between the quotes when ``text`` is written as ASCII JSON."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    short = F.create_map(*[F.lit(x) for pair in SHORT_ESCAPES.items() for x in pair])
    plain = lambda u: (u >= "0020") & (u <= "007E")
    return F.array_join(
        F.transform(units, lambda u: F.coalesce(F.try_element_at(short, u), F.when(plain(u), F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\u"), F.lower(u))))), ""
    )


def enveloped(log: DataFrame) -> DataFrame:
    """Add ``subject`` (layer:level:id) and ``envelope_id`` (hash of event, stream and no parents), as SQL expressions."""
    text = F.concat(F.lit('{"event_id": "'), "event_id", F.lit('", "parents": [], "stream_id": "'), json_text(F.col("stream_id")), F.lit('"}'))
    return log.withColumns({"subject": F.concat_ws(":", "layer", F.col("level_id").cast("string"), F.col("subject_id").cast("string")), "envelope_id": F.substring(F.sha2(text, 256), 1, 16)})


def fingerprints(log: DataFrame) -> DataFrame:
    """One fingerprint a stream and layer over its event ids in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("bar_idx", "seq", "event_id"))), lambda x: x["event_id"])
    return log.groupBy("stream_id", "layer", "level_id").agg(F.substring(F.sha2(F.array_join(ids, ":"), 256), 1, 32).alias("fingerprint"), F.count("*").alias("n_events"))
