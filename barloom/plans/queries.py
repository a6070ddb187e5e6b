"""Registered queries over the driver's tables. Prices are whole cents, so sums are exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import indicators, streams
from barloom.operators import bars as bar
from barloom.operators import bus, events, flows, invariants, overlay, routing, signals_df, structure_df
from barloom.operators.layers import Settings, layer, layers, pick
from barloom.session import checkpointed
from barloom.sources.fixtures import brand_bars, event_bars, leg_bars, table, walk_bars

Query = Callable[[SparkSession, str], DataFrame]
#: Which event type stands for which asset class.
CLASSES = {"EQUITY": "view", "REAL_ESTATE": "signup", "COMMODITY": "click", "CASH": "purchase"}
BAR = ["stream_id", "ts", "open", "high", "low", "close", "volume"]


def _resampled(tf: str) -> Query:
    return lambda s, d: bar.resample(event_bars(s, d, "1m"), tf).select(*BAR)


def _layer(name: str, tf: str = "1h", settings: Settings = Settings(), *drop: str) -> Query:
    return lambda s, d: layer(walk_bars(s, d, tf), name, settings).drop(*drop)


def tail_n(s: SparkSession, d: str) -> DataFrame:
    return bar.page(event_bars(s, d), count_back=20).select(*BAR)


def range_page(s: SparkSession, d: str) -> DataFrame:
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return bar.page(event_bars(s, d), to=at("2024-01-12 00:00:00"), after=at("2024-01-05 06:00:00"), count_back=50).select(*BAR)


def client_records(s: SparkSession, d: str) -> DataFrame:
    return bar.records(event_bars(s, d, "1d"))


def upsert_keep_last(s: SparkSession, d: str) -> DataFrame:
    every = event_bars(s, d, "4h")
    old = every.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    new = every.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
    return bar.upsert(old, new).select(*BAR)


def catalog_search(s: SparkSession, d: str) -> DataFrame:
    return structure_df.search(table(s, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("id")), "1", ["symbol"])


def regular_hours(s: SparkSession, d: str) -> DataFrame:
    return bar.regular_hours(event_bars(s, d, "15m")).select(*BAR)


def spread_bars(s: SparkSession, d: str) -> DataFrame:
    b = event_bars(s, d)
    return bar.spread(b.where("stream_id = 'view'"), b.where("stream_id = 'click'"), "view-click").select(*BAR)


def _scaled_round(c: str, digits: int) -> Column:
    """Rounded as DuckDB rounds doubles: the scaled double to a whole number, halves away from 0, and back; zeros keep their sign.

    ``F.round`` rounds the shortest decimal instead, which differs where the scaled double falls just off a half (41 / 5120).
    """
    scale = 10.0**digits
    whole = F.round(F.col(c) * scale)
    return F.when(whole == 0, F.col(c) * 0.0).otherwise(whole / scale)


def ratio_bars(s: SparkSession, d: str) -> DataFrame:
    b = event_bars(s, d)
    out = bar.ratio(b.where("stream_id = 'view'"), b.where("stream_id = 'click'"), "view/click")
    return out.select("stream_id", "ts", *[_scaled_round(c, 9).alias(c) for c in bar.PRICES], "volume")


def ratio_cv(s: SparkSession, d: str) -> DataFrame:
    p = bar.pairs(walk_bars(s, d))
    r = F.col("close") / F.col("b_close")
    return p.groupBy("pair_id").agg(F.count("*").alias("n_bars"), F.round(F.stddev_pop(r) / F.avg(r), 9).alias("cv"))


def as_of_start(s: SparkSession, d: str) -> DataFrame:
    return bar.as_of(walk_bars(s, d, "1h"), walk_bars(s, d, "4h"), "4h", "start").select("stream_id", "ts", "close", "wide_ts", "wide_close")


def as_of_close(s: SparkSession, d: str) -> DataFrame:
    return bar.as_of(walk_bars(s, d, "1h"), walk_bars(s, d, "4h"), "4h", "close").select("stream_id", "ts", "close", "wide_ts", "wide_close")


def _rounded(name: str, columns: list[str], params: dict | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return indicators.compute(walk_bars(s, d), name, params).select("stream_id", "ts", *[F.round(c, 6).alias(c) for c in columns])

    return run


def macd_area(s: SparkSession, d: str) -> DataFrame:
    """Areas of every run of 50 bars."""
    line = indicators.macd(walk_bars(s, d)).select("stream_id", F.col("bar_idx"), "hist")
    ranges = line.groupBy("stream_id", F.floor(F.col("bar_idx") / 50).cast("long").alias("part")).agg(F.min("bar_idx").alias("lo"), F.max("bar_idx").alias("hi"))
    out = signals_df.macd_areas(line, ranges, ["part"])
    return out.select("stream_id", "part", "lo", "hi", "area_total", "area_pos", "area_neg", "n_bars")


def inclusion(s: SparkSession, d: str) -> DataFrame:
    return layer(walk_bars(s, d), "merged").select("stream_id", "idx", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "raw_start", "raw_end")


def fractals(s: SparkSession, d: str) -> DataFrame:
    return structure_df.fractals(layer(walk_bars(s, d), "merged")).select("stream_id", "m_idx", "kind", "price")


def fractals_dedup(s: SparkSession, d: str) -> DataFrame:
    return structure_df.alternating(structure_df.fractals(layer(walk_bars(s, d), "merged"))).select("stream_id", "m_idx", "kind", "price")


def _strokes(mode: str) -> Query:
    return lambda s, d: layer(walk_bars(s, d), "strokes", Settings(stroke_mode=mode)).drop("level")


V0 = Settings(segments="v0")


def segments_v0(s: SparkSession, d: str) -> DataFrame:
    return layer(walk_bars(s, d), "segments", V0).select("stream_id", "idx", "s0", "s1", "i0", "i1", "direction", "high", "low", "confirmed")


def zhongshu_over_v0(s: SparkSession, d: str) -> DataFrame:
    return layer(walk_bars(s, d, "5m"), "zhongshus", V0).where("level = 1").drop("level", "first_s0", "last_s1")


def stroke_metrics(s: SparkSession, d: str) -> DataFrame:
    x = layer(walk_bars(s, d), "strokes")
    return x.groupBy("stream_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("direction") == "up").alias("n_up"), F.max(F.col("high") - F.col("low")).alias("widest"), F.max(F.col("i1") - F.col("i0")).alias("longest")
    )


def layer_counts(s: SparkSession, d: str) -> DataFrame:
    return structure_df.counts(walk_bars(s, d, "5m"))


def force_amplitude(s: SparkSession, d: str) -> DataFrame:
    """Amplitude times duration of every stroke leg of three."""
    return signals_df.leg_force(layer(walk_bars(s, d), "strokes"), 3)


def force_macd(s: SparkSession, d: str) -> DataFrame:
    b = walk_bars(s, d)
    out = signals_df.macd_force(layer(b, "strokes"), layer(b, "merged"), indicators.macd(b))
    return out.select("stream_id", "idx", "direction", F.round("force", 6).alias("force"), F.round("dif_peak", 6).alias("dif_peak"), F.round("hist_peak", 6).alias("hist_peak"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return flows.edge_directions(walk_bars(s, d), CLASSES)


def vertex_net_flow(s: SparkSession, d: str) -> DataFrame:
    return flows.vertex_flows(_edges(s, d), ["ts"])


def resonance(s: SparkSession, d: str) -> DataFrame:
    return flows.resonance(vertex_net_flow(s, d))


def cash_signal(s: SparkSession, d: str) -> DataFrame:
    out = flows.cash_signal(_edges(s, d), ["ts"])
    return out.select("ts", "cash_net", F.round("variance", 9).alias("variance"), "signal", F.round("confidence", 9).alias("confidence"))


def conservation_check(s: SparkSession, d: str) -> DataFrame:
    return flows.imbalance(vertex_net_flow(s, d), ["ts"])


def flow_timeline(s: SparkSession, d: str) -> DataFrame:
    return flows.flow_timeline(_edges(s, d).where("direction <> 'EQUILIBRIUM'"), ["ts", "vertex_a", "vertex_b"])


def stroke_flows(s: SparkSession, d: str) -> DataFrame:
    x = flows.stroke_flows(layer(walk_bars(s, d), "strokes"))
    return x.groupBy("stream_id", "flow").agg(F.count("*").alias("n"), F.round(F.avg("magnitude"), 9).alias("mean_magnitude"), F.round(F.max("magnitude"), 9).alias("max_magnitude"))


def pair_validation(s: SparkSession, d: str) -> DataFrame:
    b = walk_bars(s, d)
    out = flows.validate_pairs(bar.pairs(b), flows.zero_streams(b))
    return out.select("pair_id", "valid", "reason", "n_bars", F.round("cv", 9).alias("cv"), "n_strokes", F.round("stroke_mean", 9).alias("stroke_mean"), F.round("macd_norm", 9).alias("macd_norm"))


def ratio_structure(s: SparkSession, d: str) -> DataFrame:
    b = walk_bars(s, d)
    return flows.ratio_structure(bar.pairs(b), flows.zero_streams(b))


#: What divergences measure in sums of floats.
MEASURES = ("force_a", "force_c", "dif_peak_a", "dif_peak_c", "hist_peak_a", "hist_peak_c")


def _divergences(name: str, bars: Query | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return layer(bars(s, d) if bars else walk_bars(s, d, "5m"), name, MACD).withColumns({c: F.round(c, 6) for c in MEASURES})

    return run


def trends_v0(s: SparkSession, d: str) -> DataFrame:
    return layer(walk_bars(s, d, "5m"), "trends").withColumn("center_indices", F.array_join("center_indices", ","))


def event_counts(s: SparkSession, d: str) -> DataFrame:
    return events.event_log(walk_bars(s, d, "15m")).groupBy("stream_id", "layer", "level_id", "event_type").agg(F.count("*").alias("n"))


def stroke_event_log(s: SparkSession, d: str) -> DataFrame:
    return events.enveloped(events.event_log(walk_bars(s, d), upper=False))


def replay_seek(s: SparkSession, d: str) -> DataFrame:
    return events.current(events.replayed(events.event_log(walk_bars(s, d), upper=False), F.lit(300)))


def stream_fingerprints(s: SparkSession, d: str) -> DataFrame:
    return events.fingerprints(events.event_log(walk_bars(s, d)))


def planted_log(s: SparkSession, d: str) -> DataFrame:
    """A log made of the events table, in which every invariant is broken now and then."""
    e, n, a = F.col("event_id"), F.col("n"), F.col("a")
    rows = table(s, d, "events").select("event_id", F.col("event_type").alias("stream_id"), F.pmod("user_id", F.lit(6)).alias("a"), F.pmod("user_id", F.lit(3)).alias("b"), "ts")
    rows = rows.withColumn("n", (F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")) - 1).cast("long"))
    at = lambda every, column=e: F.when(F.pmod(column, F.lit(every)) == 0, 1).otherwise(0)
    layer_of = F.element_at(F.array(*[F.lit(x) for x in ("stroke", "segment", "zhongshu", "move", "bsp")]), (F.pmod(e, F.lit(5)) + 1).cast("int"))
    turn = F.floor(e / 5).cast("long")
    word = lambda *words: F.element_at(F.array(*[F.lit(x) for x in words]), (F.pmod(turn, F.lit(len(words))) + 1).cast("int"))
    what = (
        F.when(F.col("layer") == "stroke", word("candidate", "settled", "invalidated")).when(F.col("layer") == "segment", word("break_pending", "settle", "invalidate"))
        .when(F.col("layer") == "bsp", word("candidate", "confirm", "settle", "invalidate")).otherwise(word("candidate", "settle", "invalidate"))
    )
    bar_idx = F.floor(n / 4).cast("long")
    payload = F.struct(
        (a * 10).alias("i0"), (a * 10 + 5).alias("i1"), F.when(F.pmod(a, F.lit(2)) == 0, "up").otherwise("down").alias("direction"), (a * 3).alias("s0"), (a * 3 + 2).alias("s1"),
        (a * 3 + 3 + at(11)).alias("new_segment_s0"), (a + 10).alias("zd"), (a + 15 - 9 * at(13)).alias("zg"), (a * 4).alias("seg_start"), (a * 4 + 3).alias("seg_end"), (3 - at(17)).alias("seg_count"),
        (1 - at(19)).alias("zs_count"), a.alias("zs_start"), (a - at(23)).alias("zs_end"), F.concat(F.lit("type"), (F.col("b") + 1).cast("string")).alias("kind"), F.floor(n / 8).alias("seg_idx"),
        F.when(at(29) == 0, a).alias("center_seg_start"),
    )
    rows = rows.withColumn("layer", layer_of)
    return rows.select(
        "stream_id", "layer", bar_idx.alias("bar_idx"), (300.0 * bar_idx - 10_000.0 * at(97, bar_idx)).alias("bar_ts"), (n - 200 * at(53, n)).alias("seq"), F.concat_ws("_", "layer", what).alias("event_type"),
        F.lit(1).alias("level_id"), a.alias("subject_id"), F.to_json(payload).alias("payload"),
    )


def invariant_violations(s: SparkSession, d: str) -> DataFrame:
    """What breaks invariants in the event log (nothing) and in one that is made to."""
    logs = {"log": checkpointed(events.event_log(walk_bars(s, d, "15m"))), "planted": planted_log(s, d)}
    found = [invariants.violations(log).withColumn("source", F.lit(name)) for name, log in logs.items()]
    return found[0].unionByName(found[1])




def _wrong(idx: str, every: int, at: int) -> Column:
    """Rows that a check's query spoils, so that there is something to find."""
    return F.pmod(F.col(idx), F.lit(every)) == at


def inclusion_residual(s: SparkSession, d: str) -> DataFrame:
    """Inclusions left after merging (none), and those among the raw bars."""
    b = walk_bars(s, d)
    raw = bar.numbered(b).withColumnRenamed("bar_idx", "idx")
    left = [invariants.inclusion_left(x).select(F.lit(name).alias("source"), "stream_id", "idx") for name, x in (("merged", layer(b, "merged")), ("raw", raw))]
    return left[0].unionByName(left[1])


def _spoilt_merged(merged: DataFrame) -> DataFrame:
    return merged.withColumns({"high": F.when(_wrong("idx", 9, 4), F.col("high") + 1).otherwise(F.col("high")), "raw_end": F.when(_wrong("idx", 31, 7), F.col("raw_end") + 1).otherwise(F.col("raw_end"))})


def direction_check(s: SparkSession, d: str) -> DataFrame:
    b = walk_bars(s, d)
    return invariants.wrong_merges(_spoilt_merged(layer(b, "merged")), b).select("stream_id", "idx")


def _spoilt_fractals(fractals: DataFrame) -> DataFrame:
    other = F.when(F.col("kind") == "top", "bottom").otherwise("top")
    return fractals.withColumns(
        {"price": F.when(_wrong("m_idx", 11, 0), F.col("price") + 1).otherwise(F.col("price")), "kind": F.when(_wrong("m_idx", 13, 0), other).otherwise(F.col("kind")), "m_idx": F.when(_wrong("m_idx", 17, 0), F.col("m_idx") + 1).otherwise(F.col("m_idx"))}
    )


def fractal_check(s: SparkSession, d: str) -> DataFrame:
    b = walk_bars(s, d)
    return invariants.wrong_fractals(_spoilt_fractals(layer(b, "fractals")), layer(b, "merged")).select("stream_id", "m_idx", "kind", "price")


def _turned(column: str) -> Column:
    return F.when(F.col(column) == "up", "down").otherwise("up")


def _spoilt_strokes(strokes: DataFrame) -> DataFrame:
    return strokes.withColumns(
        {
            "i1": F.when(_wrong("idx", 10, 3), F.col("i0") + 3).otherwise(F.col("i1")), "direction": F.when(_wrong("idx", 10, 6), _turned("direction")).otherwise(F.col("direction")),
            "confirmed": F.when(_wrong("idx", 10, 8), ~F.col("confirmed")).otherwise(F.col("confirmed")),
        }
    )


def stroke_check(s: SparkSession, d: str) -> DataFrame:
    return invariants.wrong_strokes(_spoilt_strokes(layer(walk_bars(s, d), "strokes"))).select("stream_id", "idx")


def _spoilt_segments(segments: DataFrame) -> DataFrame:
    return segments.withColumns(
        {
            "s1": F.when(_wrong("idx", 7, 2), F.col("s0") + 1).otherwise(F.col("s1")), "direction": F.when(_wrong("idx", 7, 4), _turned("direction")).otherwise(F.col("direction")),
            "kind": F.when(_wrong("idx", 7, 5), F.lit("candidate")).otherwise(F.col("kind")), "trigger_k": F.when(_wrong("idx", 7, 6), F.lit(None)).otherwise(F.col("trigger_k")),
        }
    )


def segment_check(s: SparkSession, d: str) -> DataFrame:
    b = walk_bars(s, d, "5m")
    return invariants.wrong_segments(_spoilt_segments(layer(b, "segments")), layer(b, "strokes")).select("stream_id", "idx")


def segment_check_v0(s: SparkSession, d: str) -> DataFrame:
    """Of the older rule, with every fifth segment moved on by one stroke."""
    b = walk_bars(s, d, "5m")
    moved = layer(b, "segments", V0).withColumns({c: F.when(_wrong("idx", 5, 2), F.col(c) + 1).otherwise(F.col(c)) for c in ("s0", "s1")})
    return invariants.wrong_segments(moved, layer(b, "strokes"), "v0").select("stream_id", "idx")


def _spoilt_centers(centers: DataFrame) -> DataFrame:
    return centers.withColumns(
        {
            "high": F.when(_wrong("seg0", 4, 1), F.col("low")).otherwise(F.col("high")), "kind": F.when(_wrong("seg0", 4, 2), F.lit("candidate")).otherwise(F.col("kind")),
            "confirmed": F.when(_wrong("seg0", 4, 3), ~F.col("confirmed")).otherwise(F.col("confirmed")),
        }
    )


def center_check(s: SparkSession, d: str) -> DataFrame:
    return invariants.wrong_centers(_spoilt_centers(layer(walk_bars(s, d, "5m"), "centers"))).select("stream_id", "level", "idx")


def assertion_report(s: SparkSession, d: str) -> DataFrame:
    """Every structural check over one pass of all layers, as they are and spoilt."""
    names = ("merged", "fractals", "strokes", "segments", "zhongshus", "centers", "trends", "liveness")
    b = walk_bars(s, d, "5m")
    every = checkpointed(layers(b, names))
    of = {name: pick(every, name) for name in names}
    spoilt = of | {k: f(of[k]) for k, f in (("merged", _spoilt_merged), ("fractals", _spoilt_fractals), ("strokes", _spoilt_strokes), ("segments", _spoilt_segments), ("centers", _spoilt_centers))}
    moved = of["centers"].withColumns({"seg1": F.col("seg1") + F.when(_wrong("seg0", 2, 0), 1000).otherwise(0), "i0": F.col("i0") + F.when(_wrong("seg0", 2, 1), 1).otherwise(0)})
    out = []
    for state, x in (("as it is", of), ("spoilt", spoilt)):
        centers = of["centers"] if x is of else moved
        live = of["liveness"] if x is of else of["liveness"].unionByName(of["liveness"])
        found = {
            "A1 inclusion left": invariants.inclusion_left(x["merged"]),
            "A2 merges": invariants.wrong_merges(x["merged"], b),
            "A3 fractals": invariants.wrong_fractals(x["fractals"], of["merged"]),
            "A4 strokes": invariants.wrong_strokes(x["strokes"]),
            "A5 centers of segments": invariants.pen_centers(centers, of["segments"], of["trends"]),
            "A6 segments": invariants.wrong_segments(x["segments"], of["strokes"]),
            "A7 centers": invariants.wrong_centers(x["centers"]),
            "A8 parts": invariants.parts_out_of_range(centers, of["segments"], of["trends"]),
            "A9 live centers": invariants.doubled_live_centers(live, of["zhongshus"]),
            "A10 ledgers": invariants.mixed_ledgers(of["segments"], of["trends"]),
        }
        out.append(invariants.report(found).withColumn("state", F.lit(state)))
    return out[0].unionByName(out[1])


def routed_events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.col("event_type"), F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit(".json")).alias("path"), F.floor("value").cast("long").alias("value"))
    rules = routing.rules(s, [("purchase", "users/1*.json", "value >= 100", "desk", "review", "high"), ("purchase", "", "", "ledger", "book", "medium"), ("error", "*/7*", "", "ops", "page", "high"), ("click", "", "value < 5", "noise", "drop", "low")])
    return routing.routed(e, rules, "event_id")


def overlay_json(s: SparkSession, d: str) -> DataFrame:
    return overlay.overlays(walk_bars(s, d, "15m"))


def brand_daily(s: SparkSession, d: str) -> DataFrame:
    return brand_bars(s, d).select(*BAR)


def brand_strokes(s: SparkSession, d: str) -> DataFrame:
    return layer(brand_bars(s, d), "strokes").groupBy("stream_id").agg(F.count("*").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"))


def user_stroke_counts(s: SparkSession, d: str) -> DataFrame:
    """Many small streams: strokes of every user's own walk."""
    return layer(walk_bars(s, d, "1h", "user_id"), "strokes").groupBy("stream_id").agg(F.count("*").alias("n"))


def current_bars(s: SparkSession, d: str) -> DataFrame:
    """Of repeated bars the last one stays: the same bar from two tables."""
    b = event_bars(s, d, "1d")
    twice = b.withColumn("seq", F.lit(1)).unionByName(b.withColumn("seq", F.lit(2)).withColumn("volume", F.col("volume") * 2))
    return bar.normalised(twice, "seq").select(*BAR)


def daily_rank(s: SparkSession, d: str) -> DataFrame:
    """Streams by how far they moved each day."""
    b = walk_bars(s, d, "1d")
    move = F.abs(F.col("close") - F.col("open"))
    return b.select("stream_id", "ts", move.alias("moved"), F.row_number().over(Window.partitionBy("ts").orderBy(move.desc(), "stream_id")).cast("long").alias("place")).where("place <= 2")


def stream_names(s: SparkSession, d: str) -> DataFrame:
    symbols = streams.catalog(s).select("symbol").unionByName(table(s, d, "nation").select(F.col("n_name").alias("symbol")))
    return streams.named(symbols, "5m").withColumn("tf", streams.timeframe_of(F.col("stream_id")))


def multi_tf_events(s: SparkSession, d: str) -> DataFrame:
    log = bus.multi_tf_log(walk_bars(s, d, "15m"), ["15m", "1h", "4h"])
    return log.groupBy("symbol", "tag", "event_type").agg(F.count("*").alias("n"), F.max("step").alias("last_step"))


def drained_events(s: SparkSession, d: str) -> DataFrame:
    return bus.drained(bus.multi_tf_log(walk_bars(s, d, "15m"), ["15m", "1h"]), 400, 600, "1h").select("stream_id", "step", "event_type", "event_id")


def engine_metrics(s: SparkSession, d: str) -> DataFrame:
    b = walk_bars(s, d)
    return bus.metrics(b, checkpointed(events.event_log(b)))


MACD = Settings(macd=True)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"bars_hourly": lambda s, d: event_bars(s, d).select(*BAR)}
    out |= {f"resample_{tf}": _resampled(tf) for tf in ("5m", "15m", "30m", "1h", "4h", "1d", "1w")}
    for f in (
        tail_n, range_page, client_records, upsert_keep_last, current_bars, catalog_search, regular_hours, brand_daily, daily_rank, spread_bars, ratio_bars, ratio_cv, as_of_start, as_of_close,
        macd_area, inclusion, fractals, fractals_dedup, segments_v0, zhongshu_over_v0, stroke_metrics, layer_counts, brand_strokes, user_stroke_counts, force_amplitude, force_macd,
        vertex_net_flow, resonance, cash_signal, conservation_check, flow_timeline, stroke_flows, pair_validation, ratio_structure,
        event_counts, stroke_event_log, replay_seek, stream_fingerprints, invariant_violations, inclusion_residual, direction_check, fractal_check, stroke_check, segment_check, segment_check_v0, center_check, assertion_report, routed_events, overlay_json, stream_names, multi_tf_events, drained_events, engine_metrics,
    ):
        out[f.__name__] = f
    out |= {
        "sma20": _rounded("sma", ["sma"], {"period": 20}),
        "bollinger20": _rounded("bollinger", ["middle", "upper", "lower"], {"period": 20, "std": 2.0}),
        "ema20": _rounded("ema", ["ema"], {"period": 20}),
        "macd": _rounded("macd", ["macd", "signal", "hist"]),
        "rsi14": _rounded("rsi", ["rsi"], {"period": 14}),
    }
    out |= {f"strokes_{mode}": _strokes(mode) for mode in ("wide", "strict", "new")}
    out |= {
        "segments_v1": _layer("segments", "5m"),
        "feature_fractals": _layer("features", "5m"),
        "zhongshu_v1": _layer("zhongshus", "5m"),
        "moves_v1": _layer("moves", "5m"),
        "centers_v0": _layer("centers", "5m"),
        "trends_v0": trends_v0,
        "divergences_v0": _divergences("divergences_v0"),
        "divergences_v1": _divergences("divergences"),
        "trading_points": _layer("points", "5m"),
        "center_liveness": _layer("liveness", "5m"),
        "lstar": _layer("lstar", "5m"),
        "nested_divergence": lambda s, d: layer(leg_bars(s, d), "nested", MACD),
        "small_to_big": lambda s, d: layer(leg_bars(s, d), "turns"),
        "deep_zhongshus": lambda s, d: layer(leg_bars(s, d), "zhongshus"),
        "deep_moves": lambda s, d: layer(leg_bars(s, d), "moves"),
        "deep_divergences": _divergences("divergences", leg_bars),
        "deep_points": lambda s, d: layer(leg_bars(s, d), "points"),
        "deep_liveness": lambda s, d: layer(leg_bars(s, d), "liveness"),
        "deep_lstar": lambda s, d: layer(leg_bars(s, d), "lstar"),
    }
    return out
