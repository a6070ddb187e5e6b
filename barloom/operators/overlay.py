"""Overlays: everything a chart shows of a stream, as one JSON document a stream.

Layers and MACD come from one pass over the bars, written once; times and areas are joined on.
Both ends of an entry are placed at the last raw bar of their merged bar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.bars import page
from barloom.operators.layers import Settings, layers, pick
from barloom.operators.signals_df import macd_areas
from barloom.session import checkpointed

VERSION = "overlay_v2"


AREA = ("area_total", "area_pos", "area_neg", "n_bars")


def _places(entries: DataFrame, merged: DataFrame, line: DataFrame) -> DataFrame:
    """t0 and t1 (epoch seconds) and the MACD area between, of entries (stream_id, layer, level, idx, i0, i1)."""
    ends = merged.select("stream_id", F.col("idx"), F.col("raw_end"), F.floor(F.col("ts_us") / 1_000_000).alias("t"))
    at = lambda i, raw, t: ends.select("stream_id", F.col("idx").alias(i), F.col("raw_end").alias(raw), F.col("t").alias(t))
    keys = ["layer", "level", "idx"]
    out = entries.join(at("i0", "lo", "t0"), ["stream_id", "i0"]).join(at("i1", "hi", "t1"), ["stream_id", "i1"]).select("stream_id", *keys, "lo", "hi", "t0", "t1")
    areas = macd_areas(line, out, keys).select("stream_id", *keys, *[F.col(c).alias(f"macd_{c}") for c in AREA])
    return out.drop("lo", "hi").join(areas, ["stream_id", *keys])


def _listed(entries: DataFrame, name: str, fields: list, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a stream (and key): entries in order as an array called ``name``."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("idx").alias("id"), *fields)))
    return entries.groupBy("stream_id", *keys).agg(rows.alias(name))


def overlays(bars: DataFrame, settings: Settings = Settings(), limit: int | None = None) -> DataFrame:
    """(stream_id, overlay): the JSON document of every stream, over its last ``limit`` bars if given.

    Streams under three bars have empty lists.
    """
    own = page(bars, count_back=limit).select("stream_id", "ts", "open", "high", "low", "close")
    tagged = checkpointed(layers(own, ("merged", "line", "strokes", "segments", "centers", "trends", "lstar_v0"), settings))
    line = pick(tagged, "line")
    merged = pick(tagged, "merged")
    area = [f"macd_{c}" for c in AREA]
    of = {name: pick(tagged, name) for name in ("strokes", "segments", "centers", "trends")}
    every = reduce(DataFrame.unionByName, (df.select("stream_id", F.lit(name).alias("layer"), "level", "idx", "i0", "i1") for name, df in of.items()))
    places = checkpointed(_places(every, merged, line.select("stream_id", F.col("idx").alias("bar_idx"), "hist")))
    placed = {name: df.join(places.where(F.col("layer") == name).drop("layer"), ["stream_id", "level", "idx"]) for name, df in of.items()}
    strokes = _listed(placed["strokes"], "strokes", ["t0", "t1", F.col("direction").alias("dir"), "confirmed", "high", "low", "p0", "p1", *area])

    # a segment's turning points: where its strokes start and end
    ends = merged.select("stream_id", F.col("idx").alias("i"), F.floor(F.col("ts_us") / 1_000_000).alias("time"))
    corners = of["strokes"].select("stream_id", F.col("idx").alias("s"), F.explode(F.array(F.struct(F.col("i0").alias("i"), F.col("p0").alias("value")), F.struct(F.col("i1").alias("i"), F.col("p1").alias("value")))).alias("c"))
    corners = corners.select("stream_id", "s", "c.*").join(ends, ["stream_id", "i"])
    spans = of["segments"].select("stream_id", "idx", F.explode(F.sequence("s0", "s1")).alias("s"))
    points = spans.join(corners, ["stream_id", "s"]).groupBy("stream_id", "idx").agg(F.sort_array(F.collect_set(F.struct("time", "value"))).alias("stroke_points"))
    cornered = placed["segments"].join(points, ["stream_id", "idx"], "left")
    tops = F.when(F.col("direction") == "up", "bottom").otherwise("top"), F.when(F.col("direction") == "up", "top").otherwise("bottom")
    corner = lambda i, t, p, kind: F.struct(F.col(i).alias("merged_i"), F.col(t).alias("time"), F.col(p).alias("price"), kind.alias("type"))
    segments = _listed(
        cornered, "segments",
        ["t0", "t1", "s0", "s1", F.col("direction").alias("dir"), "confirmed", "kind", F.greatest("high", "p0", "p1").alias("high"), F.least("low", "p0", "p1").alias("low"), "p0", "p1",
         corner("ep0_i", "t0", "p0", tops[0]).alias("ep0"), corner("ep1_i", "t1", "p1", tops[1]).alias("ep1"), "stroke_points", *area],
    )

    core = [F.col("low").alias("ZD"), F.col("high").alias("ZG"), "kind", "confirmed", "sustain", "direction", F.col("gg").alias("GG"), F.col("dd").alias("DD"), F.col("g").alias("G"), F.col("d").alias("D")]
    centers_at = placed["centers"]
    centers = _listed(centers_at.where("level = 1"), "centers", ["t0", "t1", *core, "development", F.col("level").alias("level_id"), "terminated", "termination_side", *area])
    trends_at = placed["trends"]
    way = ["t0", "t1", "kind", F.col("direction").alias("dir"), "confirmed", "high", "low"]
    trends = _listed(trends_at.where("level = 1"), "trends", [*way, F.col("level").alias("level_id"), *area])
    per_level = _listed(centers_at, "centers", ["t0", "t1", *core], ("level",)).join(_listed(trends_at, "trends", way, ("level",)), ["stream_id", "level"], "left")
    levels = per_level.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("level", "centers", "trends"))).alias("levels"))
    star = pick(tagged, "lstar_v0").select(
        "stream_id",
        F.struct(
            "level", F.col("center_idx").alias("center_id"), "regime", F.lit(True).alias("is_alive"),
            F.struct(F.col("low").alias("settle_core_low"), F.col("high").alias("settle_core_high"), F.col("exit_idx").alias("run_exit_idx"), F.col("exit_side").alias("run_exit_side"),
                     F.col("exit_extreme").alias("run_exit_extreme"), F.col("pullback_seen").alias("event_seen_pullback"), F.col("pullback_settled").alias("event_pullback_settled")).alias("anchors"),
        ).alias("lstar"),
    )
    value = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0)).alias(c)
    series = line.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct(F.floor(F.col("ts_us") / 1_000_000).alias("time"), value("macd"), value("signal"), value("hist")))).alias("series"))
    whole = reduce(lambda a, b: a.join(b, "stream_id", "left"), (strokes, segments, centers, trends, levels, star), series)
    listed = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), whole.schema[c].dataType)).alias(c)
    body = F.struct(
        F.lit(VERSION).alias("schema_version"), F.col("stream_id").alias("symbol"), "lstar", *[listed(c) for c in ("strokes", "segments", "centers", "trends", "levels")],
        F.struct(F.lit(12).alias("fast"), F.lit(26).alias("slow"), F.lit(9).alias("signal"), "series").alias("macd"),
    )
    return whole.select("stream_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("overlay"))
