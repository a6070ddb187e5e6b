"""Invariants of event logs and layers, as queries that find what breaks them (no rows: all is well)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes and what they ask for.
CATALOGUE = {
    "I1": "a stroke settles again only after it was taken back",
    "I2": "bar times never go back",
    "I4": "seq grows within an engine",
    "I6": "a segment settles only after its break was pending",
    "I7": "a settled segment ends one stroke before the next starts",
    "I9": "nothing is taken back twice unless it settled between",
    "I11": "a center's core is not empty",
    "I12": "a center settles only after it was a candidate",
    "I13": "a center has three parts at least",
    "I17": "what was taken back does not return",
    "I18": "a move has one center at least",
    "I19": "a move settles only after it was a candidate",
    "I20": "a move's centers are in order",
    "I23": "a point of type 3 has a center",
    "I24": "a point is confirmed only after it was a candidate",
    "I25": "a point settles only after it was confirmed",
    "I26": "a point of type 1 shares its segment with no other kind",
}


def _field(name: str, kind: str) -> Column:
    return F.get_json_object("payload", f"$.{name}").cast(kind)


def violations(log: DataFrame, terminal: bool = False) -> DataFrame:
    """(stream_id, code, bar_idx, seq, event_type, reason) for every event that breaks an invariant.

    ``terminal`` adds I17, which logs of changing structure need not keep: a segment that new
    strokes undo may come back with later ones.
    """
    # subjects: strokes by id; segments by id; centers and moves by place and identity; points by id
    identity = (
        F.when(F.col("layer") == "stroke", F.concat_ws("|", "subject_id", _field("i0", "string"), _field("direction", "string"), _field("i1", "string")))
        .when(F.col("layer") == "segment", F.concat_ws("|", _field("s0", "string"), _field("direction", "string")))
        .when(F.col("layer") == "zhongshu", F.concat_ws("|", _field("zd", "string"), _field("zg", "string"), _field("seg_start", "string")))
        .when(F.col("layer") == "move", _field("seg_start", "string"))
        .otherwise(F.col("subject_id").cast("string"))
    )
    ends = F.when(F.col("layer") == "segment", _field("s1", "string")).when(F.col("layer") == "zhongshu", _field("seg_end", "string")).otherwise("")
    of_one = Window.partitionBy("stream_id", "layer", "level_id", "identity").orderBy("bar_idx", "seq")
    of_whole = Window.partitionBy("stream_id", "layer", "level_id", "identity", "ends").orderBy("bar_idx", "seq").rowsBetween(Window.unboundedPreceding, -1)
    engine = Window.partitionBy("stream_id", "engine").orderBy("bar_idx", "seq")
    arrival = Window.partitionBy("stream_id").orderBy("bar_idx", "layer", "level_id", "seq")
    what = F.regexp_extract("event_type", "[a-z]+$", 0)
    e = log.withColumns({"identity": identity, "ends": ends}).withColumn("engine", F.when(F.col("level_id") > 1, F.concat(F.lit("level"), "level_id")).otherwise(F.col("layer")))
    e = e.withColumns({"what": what, "last": F.lag(what).over(of_one), "seq_before": F.lag("seq").over(engine), "ts_before": F.lag("bar_ts").over(arrival)})
    decided = F.when(F.col("what").isin("settle", "settled", "invalidate", "invalidated"), F.col("what"))
    e = e.withColumn("decided", F.last(decided, ignorenulls=True).over(of_whole))
    before = of_one.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumns({"was_pending": F.max(F.col("what") == "pending").over(before), "was_candidate": F.max(F.col("what") == "candidate").over(before), "was_confirmed": F.max(F.col("what") == "confirm").over(before)})
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    is_ = lambda layer, *kinds: (F.col("layer") == layer) & F.col("what").isin(*kinds)
    broken = {
        "I1": is_("stroke", "settled") & (F.col("last") == "settled"),
        "I2": F.col("bar_ts") < F.col("ts_before"),
        "I4": F.col("seq") <= F.col("seq_before"),
        "I6": is_("segment", "settle") & no("was_pending"),
        "I7": is_("segment", "settle") & (_field("s1", "long") != _field("new_segment_s0", "long") - 1),
        "I9": F.col("what").isin("invalidate", "invalidated") & F.coalesce(F.col("decided").isin("invalidate", "invalidated"), F.lit(False)) & (F.col("layer") != "stroke"),
        "I11": is_("zhongshu", "candidate", "settle") & (_field("zg", "double") <= _field("zd", "double")),
        "I12": is_("zhongshu", "settle") & no("was_candidate"),
        "I13": is_("zhongshu", "candidate", "settle") & (_field("seg_count", "long") < 3),
        "I18": is_("move", "candidate", "settle") & (_field("zs_count", "long") < 1),
        "I19": is_("move", "settle") & no("was_candidate"),
        "I20": is_("move", "candidate", "settle") & (_field("zs_end", "long") < _field("zs_start", "long")),
        "I23": is_("bsp", "candidate") & (_field("kind", "string") == "type3") & _field("center_seg_start", "long").isNull(),
        "I24": is_("bsp", "confirm") & no("was_candidate"),
        "I25": is_("bsp", "settle") & no("was_confirmed"),
    }
    if terminal:
        broken["I17"] = ~F.col("what").isin("invalidate", "invalidated") & F.coalesce(F.col("last").isin("invalidate", "invalidated"), F.lit(False)) & F.col("layer").isin("segment", "zhongshu", "move", "bsp")
    codes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in broken.items()]))
    found = e.select("stream_id", "bar_idx", "seq", "event_type", F.explode(codes).alias("code"))
    lone = log.where("layer = 'bsp' and event_type = 'bsp_candidate'").select("stream_id", "bar_idx", "seq", "event_type", _field("seg_idx", "long").alias("seg"), _field("kind", "string").alias("kind"), "level_id")
    same = Window.partitionBy("stream_id", "bar_idx", "level_id", "seg")
    mixed = lone.withColumn("k", F.size(F.collect_set("kind").over(same))).where((F.col("k") > 1) & (F.col("kind") == "type1"))
    found = found.unionByName(mixed.select("stream_id", "bar_idx", "seq", "event_type", F.lit("I26").alias("code")))
    reasons = F.create_map(*[F.lit(x) for pair in CATALOGUE.items() for x in pair])
    return found.select("stream_id", "code", "bar_idx", "seq", "event_type", reasons[F.col("code")].alias("reason"))


def inclusion_left(merged: DataFrame) -> DataFrame:
    """Merged bars that hold, or are held by, the one before."""
    w = Window.partitionBy("stream_id").orderBy("idx")
    m = merged.withColumns({"h": F.lag("high").over(w), "l": F.lag("low").over(w)})
    return m.where(((F.col("h") >= F.col("high")) & (F.col("l") <= F.col("low"))) | ((F.col("high") >= F.col("h")) & (F.col("low") <= F.col("l")))).drop("h", "l")


def wrong_fractals(fractals: DataFrame, merged: DataFrame) -> DataFrame:
    """Fractals whose merged bar does not stand out on both sides as their kind says, or is no inner bar."""
    w = Window.partitionBy("stream_id").orderBy("idx")
    m = merged.withColumns({"ph": F.lag("high").over(w), "pl": F.lag("low").over(w), "nh": F.lead("high").over(w), "nl": F.lead("low").over(w)})
    m = m.select("stream_id", F.col("idx").alias("m_idx"), "high", "low", "ph", "pl", "nh", "nl")
    top = (F.col("high") > F.greatest("ph", "nh")) & (F.col("low") > F.greatest("pl", "nl"))
    bottom = (F.col("low") < F.least("pl", "nl")) & (F.col("high") < F.least("ph", "nh"))
    fits = F.when(F.col("kind") == "top", top & (F.col("price") == F.col("high"))).otherwise(bottom & (F.col("price") == F.col("low")))
    met = fractals.join(m, ["stream_id", "m_idx"], "left")
    return met.where(F.col("ph").isNull() | F.col("nh").isNull() | ~F.coalesce(fits, F.lit(False))).select(*[fractals[c] for c in fractals.columns])


def wrong_strokes(strokes: DataFrame, mode: str = "wide", min_sep: int = 5) -> DataFrame:
    """Strokes that are too short for their mode, do not alternate, do not join the one before, or are unconfirmed before the end."""
    w = Window.partitionBy("stream_id").orderBy("idx")
    least = 4 if mode == "wide" else min_sep
    s = strokes.withColumns({"d": F.lag("direction").over(w), "e": F.lag("i1").over(w), "n": F.lead("idx").over(w)})
    bad = (F.col("i1") - F.col("i0") < F.greatest(F.lit(least), F.lit(1))) | (F.col("d") == F.col("direction")) | (F.col("e") != F.col("i0")) | (F.col("confirmed") == F.col("n").isNull())
    return s.where(F.coalesce(bad, F.lit(False))).drop("d", "e", "n")


def wrong_merges(merged: DataFrame, bars: DataFrame) -> DataFrame:
    """Merged bars that inclusion, told anew from the raw bars, does not give.

    A merged bar's sense is falling if its first raw high is under the high of the merged bar
    before. Every further raw bar must hold, or be held by, what was merged until then, and the
    first one must not with the merged bar before; open and close are the first and last raw
    ones, high and low the highest of both, or the lowest when falling.
    """
    order = Window.partitionBy("stream_id").orderBy("i")
    one = Window.partitionBy("stream_id", "idx").orderBy("i")
    upto, rest = order.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(Window.unboundedPreceding, -1)
    raw = bars.select("stream_id", "open", "high", "low", "close", (F.row_number().over(Window.partitionBy("stream_id").orderBy("ts")) - 1).cast("long").alias("i"))
    w = Window.partitionBy("stream_id").orderBy("idx")
    starts = merged.select("stream_id", F.col("raw_start").alias("i"), F.struct("idx", F.lag("high").over(w).alias("ph"), F.lag("low").over(w).alias("pl")).alias("m"))
    told = raw.join(starts, ["stream_id", "i"], "left").withColumn("first", F.col("m").isNotNull()).withColumn("m", F.last("m", ignorenulls=True).over(upto)).select("*", "m.*").drop("m")
    falling = F.coalesce(F.first("high").over(one.rowsBetween(Window.unboundedPreceding, 0)) < F.col("ph"), F.lit(False))
    told = told.withColumn("falling", falling)
    told = told.withColumns({f"r_{c}": F.when(F.col("first"), F.col(f"p{c[0]}")).when(F.col("falling"), F.min(c).over(rest)).otherwise(F.max(c).over(rest)) for c in ("high", "low")})
    held = ((F.col("r_high") >= F.col("high")) & (F.col("r_low") <= F.col("low"))) | ((F.col("high") >= F.col("r_high")) & (F.col("low") <= F.col("r_low")))
    pick = lambda c: F.when(F.first("falling"), F.min(c)).otherwise(F.max(c))
    made = told.groupBy("stream_id", "idx").agg(
        F.min_by("open", "i").alias("o"), pick("high").alias("h"), pick("low").alias("l"), F.max_by("close", "i").alias("c"), F.max("i").alias("e"), F.max(F.coalesce(F.col("first") == held, F.lit(False))).alias("odd")
    )
    met = merged.join(made, ["stream_id", "idx"], "left")
    agree = ~F.col("odd") & (F.col("open") == F.col("o")) & (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("close") == F.col("c")) & (F.col("raw_end") == F.col("e"))
    return met.where(~F.coalesce(agree, F.lit(False))).select(*[merged[c] for c in merged.columns])


def wrong_segments(segments: DataFrame, strokes: DataFrame, algorithm: str = "v1") -> DataFrame:
    """Segments that break the rules of their algorithm.

    Both: three strokes at least; bars of their boundary strokes; all but the last confirmed.
    v0: the first three strokes overlap. v1: next to the one before and against it; not ending
    behind where it began; only the last a candidate; a confirmed one has a turn whose three strokes overlap.
    """
    w, of_stroke = Window.partitionBy("stream_id").orderBy("idx"), Window.partitionBy("stream_id").orderBy("idx")
    low = F.greatest("low", F.lead("low", 1).over(of_stroke), F.lead("low", 2).over(of_stroke))
    high = F.least("high", F.lead("high", 1).over(of_stroke), F.lead("high", 2).over(of_stroke))
    meets = F.when(F.lead("idx", 2).over(of_stroke).isNotNull(), low < high)
    three = strokes.select("stream_id", "idx", "i0", "i1", meets.alias("meets"))
    first = three.select("stream_id", F.col("idx").alias("s0"), F.col("i0").alias("b0"), F.col("meets").alias("m0"))
    last = three.select("stream_id", F.col("idx").alias("s1"), F.col("i1").alias("b1"))
    s = segments.withColumns({"e": F.lag("s1").over(w), "d": F.lag("direction").over(w), "end": F.lead("idx").over(w).isNull()})
    s = s.join(first, ["stream_id", "s0"], "left").join(last, ["stream_id", "s1"], "left")
    bad = [F.col("s1") - F.col("s0") < 2, F.col("i0") != F.col("b0"), F.col("i1") != F.col("b1"), F.col("b0").isNull(), F.col("b1").isNull(), F.col("confirmed") == F.col("end")]
    if algorithm == "v0":
        bad.append(~F.coalesce("m0", F.lit(False)))
    else:
        turns = three.select("stream_id", F.col("idx").alias("trigger_k"), F.col("meets").alias("mk"))
        s = s.join(turns, ["stream_id", "trigger_k"], "left")
        way = F.when(F.col("direction") == "up", 1).otherwise(-1)
        bad += [
            ~F.col("s0").isin(F.col("e"), F.col("e") + 1), F.col("d") == F.col("direction"), (F.col("p0") != 0) & (F.col("p1") != 0) & (way * (F.col("p1") - F.col("p0")) < -1e-9),
            (F.col("kind") == "candidate") & ~F.col("end"), (F.col("kind") == "settled") & F.col("confirmed") & F.col("trigger_k").isNull(), F.col("confirmed") & (F.col("mk") == False),  # noqa: E712
        ]
    broken = F.lit(False)
    for b in bad:
        broken = broken | F.coalesce(b, F.lit(False))
    return s.where(broken).select(*[segments[c] for c in segments.columns])


def wrong_centers(centers: DataFrame, sustain_m: int = 2) -> DataFrame:
    """Centers of the older chain with fewer than three parts, an empty core, a kind that does not fit how long they lasted, or confirmed as the last (or not, before)."""
    w = Window.partitionBy("stream_id", "level").orderBy("idx")
    bad = (F.col("seg1") - F.col("seg0") < 2) | (F.col("high") <= F.col("low")) | ((F.col("kind") == "settled") != (F.col("sustain") >= sustain_m)) | (F.col("confirmed") == F.col("end"))
    return centers.withColumn("end", F.lead("idx").over(w).isNull()).where(bad).drop("end")


def _over_parts(rows: DataFrame, segments: DataFrame, trends: DataFrame) -> DataFrame:
    """``rows`` (level, seg0, seg1, i0, i1) with the bars (b0, b1) of the parts they name: segments at level 1, confirmed trends of the level below above it."""
    below = Window.partitionBy("stream_id", "level").orderBy("idx")
    ones = segments.select("stream_id", F.lit(1).alias("level"), F.col("idx").alias("k"), "i0", "i1")
    above = trends.where("confirmed").select("stream_id", (F.col("level") + 1).alias("level"), (F.row_number().over(below) - 1).cast("long").alias("k"), "i0", "i1")
    parts = ones.unionByName(above)
    first, last = parts.select("stream_id", "level", F.col("k").alias("seg0"), F.col("i0").alias("b0")), parts.select("stream_id", "level", F.col("k").alias("seg1"), F.col("i1").alias("b1"))
    return rows.join(first, ["stream_id", "level", "seg0"], "left").join(last, ["stream_id", "level", "seg1"], "left")


def parts_out_of_range(centers: DataFrame, segments: DataFrame, trends: DataFrame) -> DataFrame:
    """Centers that reach past the parts of their level."""
    met = _over_parts(centers, segments, trends)
    return met.where((F.col("seg1") < F.col("seg0")) | F.col("b0").isNull() | F.col("b1").isNull()).select(*[centers[c] for c in centers.columns])


def pen_centers(centers: DataFrame, segments: DataFrame, trends: DataFrame) -> DataFrame:
    """Centers whose bars are not those of the parts they name, as if built over strokes or over another level."""
    met = _over_parts(centers, segments, trends)
    return met.where((F.col("i0") != F.col("b0")) | (F.col("i1") != F.col("b1"))).select(*[centers[c] for c in centers.columns])


def mixed_ledgers(segments: DataFrame, trends: DataFrame) -> DataFrame:
    """Trends of levels above the first that do not stand on confirmed trends of the level below."""
    met = _over_parts(trends.where("level > 1"), segments, trends)
    return met.where(~F.coalesce((F.col("i0") == F.col("b0")) & (F.col("i1") == F.col("b1")), F.lit(False))).select(*[trends[c] for c in trends.columns])


def doubled_live_centers(liveness: DataFrame, zhongshus: DataFrame) -> DataFrame:
    """(stream_id, level, seg_start, seg_end) that two live centers of a level share."""
    met = liveness.where("alive").select("stream_id", "level", "idx").join(zhongshus, ["stream_id", "level", "idx"])
    return met.groupBy("stream_id", "level", "seg_start", "seg_end").count().where("count > 1").drop("count")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n_broken, ok) of several of the above."""
    one = [df.agg(F.count("*").alias("n_broken")).select(F.lit(name).alias("check"), "n_broken", (F.col("n_broken") == 0).alias("ok")) for name, df in checks.items()]
    out = one[0]
    for df in one[1:]:
        out = out.unionByName(df)
    return out
