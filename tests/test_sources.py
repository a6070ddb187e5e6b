"""Sources, sinks, payloads, commands and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom import cli
from barloom.functions import indicators
from barloom.operators import bars as bar
from barloom.operators import bus, events, flows, routing
from barloom.operators import invariants as inv
from barloom.operators.layers import FIELDS, Settings, layer, layers, pick, with_line
from barloom.sources import feeds, tables, vendor
from barloom.sources.fixtures import walk_bars
from barloom.streaming import engine
from tests import plain

T0 = dt.datetime(2024, 1, 1)


def make(spark, n=40, streams=("a", "b"), seed=0):
    rows = [(s, T0 + dt.timedelta(minutes=5 * i), *map(float, x), 1.0) for k, s in enumerate(streams) for i, x in enumerate(plain.walk(n, seed + k))]
    return spark.createDataFrame(rows, "stream_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_parquet_round_trip_and_absence(spark, tmp_path):
    b = make(spark)
    assert tables.read_bars(spark, str(tmp_path / "none")) is None
    tables.write_bars(b, str(tmp_path / "x"))
    assert rows(tables.read_bars(spark, str(tmp_path / "x")).select(b.columns)) == rows(b)


def test_upserts_keep_the_last(spark, tmp_path):
    b, path = make(spark), str(tmp_path / "u")
    tables.append_bars(b, path, 0)
    tables.append_bars(b.where("stream_id = 'a'").withColumn("close", F.lit(-1.0)), path, 1)
    tables.append_bars(b.where("stream_id = 'a'").withColumn("close", F.lit(-2.0)), path, 1)  # the batch again
    out = tables.read_upserted(spark, path)
    assert out.count() == b.count() and out.where("close = -2").count() == 40 and out.where("stream_id = 'b'").select(b.columns).exceptAll(b).isEmpty()
    both = bar.upsert(b, b.limit(3).withColumn("close", F.lit(0.5)))
    assert both.count() == b.count() and both.where("close = 0.5").count() == 3


def test_csv_round_trip(spark, tmp_path):
    b = make(spark, streams=("AAA",))
    tables.write_csv(b.drop("stream_id").coalesce(1), str(tmp_path / "c"))
    assert rows(tables.read_csv(spark, str(tmp_path / "c"), "AAA")) == rows(b)


def test_csv_goes_by_its_header(spark, tmp_path):
    (tmp_path / "AAPL.csv").write_text("Timestamp,high,open,low,volume,close,note\n2024-01-01T00:00:00,4,2,1,7,3,x\n")
    (tmp_path / "BRK.B_1min.csv").write_text("close,low,high,open,ts\n3,1,4,2,2024-01-01 00:05:00\n")
    got = [tuple(tables.read_csv(spark, str(tmp_path / name)).first()) for name in ("AAPL.csv", "BRK.B_1min.csv")]
    assert got == [("AAPL", T0, 2.0, 4.0, 1.0, 3.0, 7.0), ("BRK.B", T0 + dt.timedelta(minutes=5), 2.0, 4.0, 1.0, 3.0, None)]
    (tmp_path / "bad.csv").write_text("ts,open,high,low\n2024-01-01,1,1,1\n")
    with pytest.raises(ValueError, match="close"):
        tables.read_csv(spark, str(tmp_path / "bad.csv"))
    both = tmp_path / "both"
    both.mkdir()
    (both / "a.csv").write_text("ts,open,high,low,close\n2024-01-01,1,4,1,2\n")
    (both / "b.csv").write_text("ts,high,open,low,close\n2024-01-01,4,1,1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, str(both)).collect()


def test_requests():
    assert [feeds.bar_size(x) for x in ("1s", "5s", "1min", "2min", "1hour", "8hour", "1month")] == ["1 secs", "5 secs", "1 min", "2 mins", "1 hour", "8 hours", "1 month"]
    with pytest.raises(ValueError, match="7min"):
        feeds.bar_size("7min")
    assert feeds.contract("es")["exchange"] == "CME" and feeds.contract("es")["type"] == "CONTFUT" and feeds.contract("amd") == {"symbol": "AMD", "type": "STK", "exchange": "SMART", "currency": "USD", "multiplier": 1}
    a, b = feeds.vendor_request("cl", "15min", today=dt.date(2024, 3, 1)), feeds.vendor_request("AMD", "1day", "2023-01-01", "2023-02-01")
    assert (a["dataset"], a["vendor_symbol"], a["symbol_type"], a["schema"], a["end"]) == ("GLBX.MDP3", "CL.c.0", "continuous", "ohlcv-1m", "2024-02-29")
    assert (b["dataset"], b["vendor_symbol"], b["symbol_type"], b["schema"], b["end"]) == ("XNAS.ITCH", "AMD", "raw_symbol", "ohlcv-1d", "2023-02-01")
    assert len(feeds.BROKER_INTERVALS) == 21 and "CL" in feeds.supported_symbols()


def test_fetched_bars(spark, tmp_path):
    minutes = [["20240102 09:%02d:00" % i, i, i + 2, i - 1, i + 1, 0 if i == 3 else 10] for i in range(7)]
    (tmp_path / "ES.json").write_text("\n".join(map(json.dumps, [*minutes, ["2024-01-02T09:06:00+00:00", 6, 9, 5, 8, 4], ["20240103", 1, 1, 1, 1]])))
    got = feeds.broker_history(spark, ["es"], "barloom.sources.feeds.read_rows", duration=str(tmp_path)).orderBy("ts").collect()
    assert len(got) == 8 and got[3].volume is None and got[6].close == 8.0 and got[7].ts == dt.datetime(2024, 1, 3) and got[0].stream_id == "ES"
    (tmp_path / "ES.c.0.json").write_text((tmp_path / "ES.json").read_text())
    five = feeds.vendor_history(spark, ["ES"], "barloom.sources.feeds.read_rows", "5min", str(tmp_path)).orderBy("ts").collect()
    assert [(r.ts.minute, r.open, r.high, r.close, r.volume) for r in five[:2]] == [(0, 0.0, 6.0, 5.0, 40.0), (5, 5.0, 9.0, 8.0, 14.0)]
    told = {r.symbol: r for r in feeds.cache_all(spark, ["ES", "NONE"], str(tmp_path / "cache"), "barloom.sources.feeds.read_rows", "1min", str(tmp_path)).collect()}
    assert told["ES"].rows == 8 and told["ES"].error is None and told["NONE"].rows == 0 and told["NONE"].error and told["NONE"].cache_name == "NONE_1min_raw"
    assert [r.symbol for r in tables.listing(spark, str(tmp_path / "cache")).collect()] == ["ES"]
    assert tables.load_bars(spark, str(tmp_path / "cache"), "ES", "1min", "1m").count() == 8


def test_live_buffer(spark):
    live = make(spark, 30, ("AAA", "BBB"))
    first, at = feeds.latest(live.where("ts < '2024-01-01 01:00:00'"), "aaa", 0, 20)
    assert first.count() == at == 12
    new, at = feeds.latest(live.where("ts < '2024-01-01 01:15:00'"), "aaa", at, 20)
    assert (new.count(), at) == (3, 15) and new.first().time == "2024-01-01 01:00:00"
    new, at = feeds.latest(live, "aaa", 15, 20)
    assert (new.count(), at) == (5, 20) and feeds.latest(live, "none", 7)[1] == 7
    table = spark.createDataFrame([("CL", "FUT", "NYMEX", "USD", "crude oil"), ("ES", "FUT", "CME", "USD", "index")], "symbol string, type string, exchange string, currency string, description string")
    assert [r.symbol for r in feeds.matches(table, " CRUDE ").collect()] == ["CL"]


def test_supplied_lines(spark):
    b = make(spark, 1500, ("a", "b"))
    line = indicators.macd(b)
    own, given = (rows(layer(x, "divergences", Settings(macd=True))) for x in (b, with_line(b, line)))
    assert own == given and own
    some = rows(layer(with_line(b, line.where("bar_idx % 3 = 0")), "divergences", Settings(macd=True)))
    assert some != own
    assert with_line(b, line.where("stream_id = 'a'")).where("macd is null").count() == 1500
    assert rows(layer(with_line(b, line), "line").select("stream_id", "idx", F.round("hist", 6).alias("h"))) == rows(line.select("stream_id", F.col("bar_idx").alias("idx"), F.round("hist", 6).alias("h")))


def test_replay_steps(spark):
    b = make(spark, 400, ("a",))
    log = events.event_log(b).cache()
    at, seen = events.Replay(400), []
    while at.mode != "done":
        some, at = at.step(log, 150)
        seen += rows(some)
    assert sorted(seen) == rows(log) and at == events.Replay(400, 400, "done")
    there, back = at.seek(log, 99)
    assert rows(there) == rows(log.where("bar_idx <= 99")) and back == events.Replay(400, 100, "paused")
    assert back.play(2.0) == events.Replay(400, 100, "playing", 2.0) and back.play().pause().mode == "paused" and at.play().mode == "done"
    assert at.seek(log, 9999)[1].mode == "done" and at.seek(log, -5)[1].current == 1 and at.step(log)[0].isEmpty()


def test_json_lines():
    import io
    import logging

    from barloom.functions.logs import event_logger

    out = io.StringIO()
    log = event_logger("barloom.test", logging.StreamHandler(out))
    log.info("bar processed", bar_idx=42, tf="5m")
    event_logger("barloom.test").warning("späte %s")
    one, two = map(json.loads, out.getvalue().splitlines())
    assert (one["msg"], one["bar_idx"], one["tf"], one["level"], one["logger"]) == ("bar processed", 42, "5m", "INFO", "barloom.test") and two["msg"] == "späte %s"


def test_levels_on_the_bus(spark):
    log = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("s", 3, "z"), ("s", 2, "w")], "stream_id string, level_id int, event_id string")
    assert {r.tag: r.n for r in bus.counts(bus.by_level(log)).collect()} == {"L1": 4, "L2": 2, "L3": 1}


def test_deciding_level_at_each_bar(spark):
    b = make(spark, 2500, ("a", "b"))
    per = events.lstar_by_bar(b).cache()
    assert per.count() == 5000 and per.where("level is not null").count() > 0
    last = {r.stream_id: (r.level, r.center_idx, r.regime) for r in per.where("bar_idx = 2499").collect()}
    now = {r.stream_id: (r.level, r.center_idx, r.regime) for r in layer(b, "lstar").collect()}
    assert {s: v for s, v in last.items() if v[0] is not None} == now


def test_weeks_as_of(spark):
    days = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(16)]
    b = spark.createDataFrame([("a", t, c, c, c, c, 1.0) for t, c in days], "stream_id string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    weeks = bar.resample(b, "1w")
    for align, want in (("start", [6.0] * 7 + [13.0] * 7 + [15.0] * 2), ("close", [None] * 7 + [6.0] * 7 + [13.0] * 2)):
        assert [r.wide_close for r in bar.as_of(b, weeks, "1w", align).orderBy("ts").collect()] == want


def test_envelopes_of_any_stream_name(spark):
    names = ["plain", 'a"b', "back\\slash", "tab\tline\n\x01\x7f", "Ümläut 日本 🙂", ""]
    log = spark.createDataFrame([("0123456789abcdef", n, "stroke", 1, 2) for n in names], "event_id string, stream_id string, layer string, level_id int, subject_id long")
    assert {r.stream_id: r.envelope_id for r in events.enveloped(log).collect()} == {n: events.envelope_id("0123456789abcdef", n) for n in names}


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from barloom import session

    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()
        sparkContext = type("Context", (), {"master": "spark://far:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Far())


def test_the_rest_stands_without_corpus_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "barloom.llm.queries", None)
    monkeypatch.setitem(sys.modules, "barloom.llm", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)
    try:
        bare = importlib.reload(entry)
        assert "segments_v1" in bare.queries() and "segments_v1" in bare.oracle_sql() and not [q for q in bare.queries() if q.startswith("op") or q == "pipeline"]
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_catalog(spark, tmp_path):
    b = make(spark, streams=("ES",))
    for name in ("ES_1min_raw", "A_B_15min_raw", "CL_5min_raw", "junk"):
        tables.write_bars(b.coalesce(1), str(tmp_path / f"{name}.parquet"), by_stream=False)
    assert [(r.symbol, r.interval) for r in tables.listing(spark, str(tmp_path)).orderBy("symbol").collect()] == [("A_B", "15min"), ("CL", "5min"), ("ES", "1min")]
    assert tables.listing(spark, str(tmp_path / "none")).isEmpty()
    assert tables.load_bars(spark, str(tmp_path), "ES", "1min", "1h").count() == 4
    assert tables.load_bars(spark, str(tmp_path), "ES", "1min", "7h").count() == 40
    assert tables.load_bars(spark, str(tmp_path), "NO", "1min", "1h") is None


def test_weeks_end_on_sunday(spark):
    got = make(spark, 1, ("a",)).select(bar.bucket(F.lit("2024-01-07 10:00:00").cast("timestamp_ntz"), "1w").alias("w"), bar.bucket(F.lit("2024-01-08 00:00:00").cast("timestamp_ntz"), "1w").alias("v")).first()
    assert (got.w, got.v) == (dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 14))
    with pytest.raises(ValueError, match="unknown timeframe"):
        bar.resample(make(spark), "7m")


def test_payloads(spark, tmp_path):
    series = {"Meta Data": {"a": "b"}, "Time Series (5min)": {"2024-01-02 10:05:00": {"1. open": "1", "2. high": "3", "3. low": "0.5", "4. close": "2", "5. volume": "10"}}}
    values = {"name": "x", "data": [{"date": "2024-01-02", "value": "81.5"}, {"date": "2024-01-03", "value": "."}]}
    (tmp_path / "s.json").write_text(json.dumps(series))
    got = vendor.series_bars(vendor.fetched(spark, [str(tmp_path / "s.json")], "barloom.sources.vendor.read_file", 0)).first()
    assert (got.ts, got.open, got.high, got.low, got.close, got.volume) == (dt.datetime(2024, 1, 2, 10, 5), 1, 3, 0.5, 2, 10)
    df = spark.createDataFrame([("x", json.dumps(values))], "stream_id string, payload string")
    assert [(r.ts, r.close) for r in vendor.daily_values(df).collect()] == [(dt.datetime(2024, 1, 2), 81.5)]
    lines = spark.createDataFrame([("x", json.dumps({"Technical Analysis: MACD": {"2024-01-02": {"MACD": "1", "MACD_Signal": "2", "MACD_Hist": "-1"}}}))], "stream_id string, payload string")
    assert vendor.series_macd(lines).first().hist == -1
    bad = spark.createDataFrame([("x", json.dumps({"Error Message": "no such symbol"}))], "stream_id string, payload string")
    with pytest.raises(Exception, match="no such symbol"):
        vendor.series_bars(bad).collect()


def test_commands(spark, tmp_path):
    tables.write_bars(make(spark, 120), str(tmp_path / "b"))
    parse = cli.parser().parse_args
    src, out = str(tmp_path / "b"), str(tmp_path / "o")
    assert cli.run(spark, parse(["resample", src, out, "--tf", "1h"])).count() == 20
    assert cli.run(spark, parse(["structure", src, out, "--layer", "merged"])).count() > 20
    assert cli.run(spark, parse(["synthetic", src, out, "a", "b", "--kind", "ratio"])).count() == 120
    assert cli.run(spark, parse(["indicator", src, out, "sma", "--param", "period=5", "--param", "odd=1"])).where("sma is not null").count() == 232
    docs = [json.loads(r.overlay) for r in cli.run(spark, parse(["overlay", src, out, "--limit", "100"])).collect()]
    assert [len(d["macd"]["series"]) for d in docs] == [100, 100] and all(d["strokes"] for d in docs)
    assert all(e["t0"] <= e["t1"] for d in docs for k in ("strokes", "segments", "centers") for e in d[k])
    with pytest.raises(FileNotFoundError):
        cli.run(spark, parse(["resample", str(tmp_path / "none"), out, "--tf", "1h"]))
    with pytest.raises(ValueError, match="unknown indicator"):
        indicators.compute(make(spark), "nope")


def test_tagged_layers_are_the_single_ones(spark, sf):
    b = walk_bars(spark, sf, "5m")
    tagged = layers(b, ("strokes", "segments", "zhongshus", "trends")).cache()
    for name in ("strokes", "segments", "zhongshus", "trends"):
        assert rows(pick(tagged, name)) == rows(layer(b, name))


@pytest.mark.parametrize("name", sorted(FIELDS))
def test_layers_of_odd_tables(spark, name):
    b = make(spark, 60)
    assert layer(b.limit(0), name).isEmpty()
    assert layer(b.where("ts < '2024-01-01 00:05:00'"), name, Settings(macd=True)).where("level > 0").isEmpty()
    odd = b.withColumn("stream_id", F.when(F.col("stream_id") == "a", F.col("stream_id"))).withColumn("level", F.lit("x")).withColumn("idx", F.lit(None))
    assert layer(odd, name).where("stream_id is null").count() == layer(b.where("stream_id = 'b'"), name).count()


def test_streams_end_where_batches_do(spark, tmp_path):
    b = make(spark, 200, ("a", "b", "c"))
    for k in range(4):
        lo, hi = T0 + dt.timedelta(minutes=250 * k), T0 + dt.timedelta(minutes=250 * (k + 1))
        b.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).write.parquet(str(tmp_path / f"in/{k}"))
    b.where(F.col("ts") == F.lit(T0)).write.parquet(str(tmp_path / "in/late"))
    (tmp_path / "stage").mkdir()
    for k in (*range(4), "late"):
        one = spark.readStream.schema(b.schema).parquet(str(tmp_path / "stage"))
        spark.read.parquet(str(tmp_path / f"in/{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "stage"))
        q = engine.to_log(engine.stream_events(one), str(tmp_path / "log"), str(tmp_path / "check"))
        q.awaitTermination(120)
        assert engine.progress(q)["last_process_duration_ms"] > 0 and engine.progress(q)["batches"] >= 1
        assert q.exception() is None
    want = events.event_log(b)
    assert rows(engine.read_log(spark, str(tmp_path / "log")).select(want.columns)) == rows(want)
    assert spark.read.parquet(str(tmp_path / "log")).where("event_type = 'late_bar'").count() == 3
    assert rows(engine.standing(spark, str(tmp_path / "log")).select(want.columns)) == rows(events.current(want))


def test_flow_errors(spark):
    five = [(0, a, b, "A_TO_B") for i, a in enumerate(flows.VERTICES) for b in flows.VERTICES[i + 1 :]][:5]
    df = spark.createDataFrame(five, "k int, vertex_a string, vertex_b string, direction string")
    with pytest.raises(Exception, match="six different edges"):
        flows.vertex_flows(df, ["k"]).collect()
    loop = spark.createDataFrame([(0, "CASH", "CASH", "A_TO_B")], df.schema)
    with pytest.raises(Exception, match="to itself"):
        flows.vertex_flows(loop, ["k"]).collect()
    assert flows.matrix(spark, {"CASH": "X"}).count() == 6
    with pytest.raises(ValueError, match="unknown classes"):
        flows.matrix(spark, {"GOLD": "X"})


def test_reversed_edges_are_turned(spark):
    rows_ = [(1, "EQUITY", "CASH", "A_TO_B"), (2, "CASH", "EQUITY", "A_TO_B"), (3, "X", "Y", "A_TO_B")]
    out = flows.flow_timeline(spark.createDataFrame(rows_, "ts int, vertex_a string, vertex_b string, direction string"), ["ts"])
    net = {(r.ts, r.vertex): r.net for r in out.collect()}
    assert (net[1, "CASH"], net[1, "EQUITY"], net[2, "CASH"], net[2, "EQUITY"]) == (1, -1, -1, 1) and len(net) == 12 and net[3, "CASH"] == -1


def test_pair_validation_reasons(spark):
    b = make(spark, 120, ("a", "b"))
    flat = b.where("stream_id = 'a'").withColumns({"stream_id": F.lit("flat"), **{c: F.col(c) * 2 for c in bar.PRICES}})
    zero = b.where("stream_id = 'b'").withColumns({"stream_id": F.lit("zero"), "open": F.lit(0.0)})
    few = b.where("stream_id = 'b' and ts < '2024-01-01 00:20:00'").withColumn("stream_id", F.lit("few"))
    got = {r.pair_id: (r.valid, r.reason) for r in flows.validate_pairs(bar.pairs(b.unionByName(flat).unionByName(zero).unionByName(few)), cv=1e-6, stroke=1e-6, dynamics=1e-9).collect()}
    assert got["a/flat"] == (False, "degenerate ratio") and got["a/zero"] == (False, "zero price in b") and got["a/few"] == (False, "insufficient overlap") and got["a/b"][0]


def test_cash_signal_by_hand(spark):
    def case(k, cash, asset):
        names = [(a, b) for i, a in enumerate(flows.VERTICES) for b in flows.VERTICES[i + 1 :]]
        it, ic = iter(asset), iter(cash)
        return [(k, a, b, next(ic if "CASH" in (a, b) else it)) for a, b in names]

    x, y, z = "A_TO_B", "B_TO_A", "EQUILIBRIUM"
    rows_ = case(1, (x, y, z), (x, x, y)) + case(2, (x, x, x), (x, x, x)) + case(3, (x, x, y), (x, x, y)) + case(4, (y, y, y), (x, z, z))
    got = {r.k: (r.cash_net, round(r.variance, 4), r.signal, r.confidence) for r in flows.cash_signal(spark.createDataFrame(rows_, "k int, vertex_a string, vertex_b string, direction string"), ["k"]).collect()}
    assert got == {1: (0, 0.0, "neutral", 1.0), 2: (3, 0.0, "metric_shift", 1.0), 3: (1, 0.8889, "genuine_flow", 1.0), 4: (-3, 0.2222, "mixed", 0.5)}


def test_routes(spark):
    events_ = spark.createDataFrame(
        [(1, "file_change", "src/a.py", None, None, 3), (2, "annotation", None, None, "please review this", 1), (3, "tool_error", "", "grep", None, 9), (4, "file_change", "doc/a.md", None, None, None)],
        "id long, event_type string, path string, tool_name string, annotation string, n long",
    )
    table = routing.rules(
        spark,
        [("file_change", "src/*.py", "", "t", "low one", "low_async"), ("file_change", "src/*", "n >= 3", "t", "urgent", "critical"), ("annotation", "review", "", "t", "look", "odd"), ("tool_error", "gr*", "n < 9", "t", "no", "high"),
         ("tool_error", "gr*", "n > 8", "t", "yes", "high"), ("file_change", "", "sometimes", "t", "never", "high"), ("file_change", "*", "n == 0", "t", "no", "high")],
    )
    got = [(r.id, r.action, r.place) for r in routing.routed(events_, table, "id").orderBy("id", "place").collect()]
    assert got == [(1, "urgent", 1), (1, "low one", 2), (2, "look", 1), (3, "yes", 1)]


def test_broken_layers_are_found(spark, sf):
    b = walk_bars(spark, sf, "5m")
    t = layers(b, ("merged", "fractals", "strokes", "segments", "centers", "trends")).cache()
    of = {n: pick(t, n) for n in ("merged", "fractals", "strokes", "segments", "centers", "trends")}
    odd = (F.col("idx") == 3) & (F.col("stream_id") == "view")
    assert inv.wrong_fractals(of["fractals"].withColumn("price", F.when(odd, 0.0).otherwise(F.col("price"))), of["merged"]).count() == 1
    assert inv.wrong_strokes(of["strokes"].withColumn("i1", F.when(odd, F.col("i1") + 1).otherwise(F.col("i1")))).count() >= 1
    assert inv.wrong_strokes(of["strokes"].withColumn("confirmed", F.lit(True))).count() == of["strokes"].select("stream_id").distinct().count()
    assert inv.inclusion_left(of["merged"].withColumn("high", F.when(odd, 1e12).otherwise(F.col("high")))).count() >= 1
    assert inv.wrong_segments(of["segments"].withColumn("s0", F.col("s0") + F.when(F.col("idx") == 1, 2).otherwise(0)), of["strokes"]).count() >= 1
    assert inv.wrong_centers(of["centers"].withColumn("kind", F.lit("candidate")).where("sustain >= 2")).count() == of["centers"].where("sustain >= 2").count()
    assert inv.parts_out_of_range(of["centers"], of["segments"].limit(0), of["trends"]).count() == of["centers"].where("level = 1").count()


def test_broken_logs_are_found(spark):
    log = events.event_log(make(spark, 2500, ("a", "b"))).cache()
    assert not log.where("event_type = 'zhongshu_settle'").isEmpty()
    assert inv.violations(log).isEmpty()
    codes = lambda df: {r.code for r in inv.violations(df).select("code").distinct().collect()}
    twice = log.unionByName(log.where("event_type = 'stroke_settled'").withColumn("bar_idx", F.col("bar_idx") + 100_000).withColumn("seq", F.col("seq") + 100_000))
    assert "I1" in codes(twice)
    assert "I2" in codes(log.withColumn("bar_ts", -F.col("bar_ts"))) and "I4" in codes(log.withColumn("seq", -F.col("seq")))
    assert codes(log.where("event_type <> 'segment_break_pending'")) == {"I6"} and "I12" in codes(log.where("event_type <> 'zhongshu_candidate'"))
    assert "I7" in codes(log.withColumn("payload", F.regexp_replace("payload", '"s1": ', '"s1": 9')))


def test_graphs_are_apart(spark, sf):
    of = {"EQUITY": "view", "REAL_ESTATE": "signup", "COMMODITY": "click", "CASH": "purchase"}
    b = walk_bars(spark, sf)
    two = b.withColumn("g", F.lit(1)).unionByName(b.withColumns({"g": F.lit(2), "close": -F.col("close") + 3_000_000}))
    edges = flows.edge_directions(two, of, ("g",))
    assert rows(edges.where("g = 1").drop("g")) == rows(flows.edge_directions(b, of))
    order = ["ts", "vertex_a", "vertex_b"]
    assert rows(flows.flow_timeline(edges, order, ("g",)).where("g = 1").drop("g")) == rows(flows.flow_timeline(edges.where("g = 1").drop("g"), order))
