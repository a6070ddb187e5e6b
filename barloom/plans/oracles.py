"""SQL with the rows of the queries of the same name, for DuckDB over the same tables.

Sequential rules are recursive queries that step through positions, one row a stream and step.
"""

from __future__ import annotations

from barloom.functions.streams import CATALOG
from barloom.plans import chain_sql as chain
from barloom.plans import check_sql as check

_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}


def _bucket(tf: str) -> str:
    if tf == "1w":
        return "CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS TIMESTAMP)"
    return f"make_timestamp(epoch_us(ts) - epoch_us(ts) % {_SECONDS[tf] * 1_000_000})"


def _bars(ticks: str, tf: str) -> str:
    """Bars of (stream_id, ts, event_id, price) rows."""
    return f"""SELECT stream_id, {_bucket(tf)} AS ts, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS rn FROM ({ticks})) GROUP BY 1, 2"""


EVENTS = "SELECT event_type AS stream_id, ts, event_id, CAST(round(value * 100) AS BIGINT) AS price FROM events"
WALK = """SELECT event_type AS stream_id, ts, event_id, CAST(1000000 + sum(CASE WHEN event_id % 2 = 0 THEN c ELSE -c END)
      OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS price FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)"""
BAR = "stream_id, ts, open, high, low, close, volume"


def event_bars(tf: str = "1h") -> str:
    return _bars(EVENTS, tf)


def walk_bars(tf: str = "1h") -> str:
    return _bars(WALK, tf)


def numbered(bars: str) -> str:
    """Bars with their position, as a CTE body."""
    return f"SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts) - 1 AS i FROM ({bars})"


def walk(tf: str = "1h") -> str:
    return numbered(walk_bars(tf))


#: Streams that turn every five bars (sources/fixtures.py, leg_bars).
LEGS = """SELECT stream_id, make_timestamp(1704067200000000 + 60000000 * (leg * 5 + j)) AS ts, p + d * j AS open, greatest(p + d * j, p + d * (j + 1)) AS high, least(p + d * j, p + d * (j + 1)) AS low, p + d * (j + 1) AS close FROM (
      SELECT CAST(k AS VARCHAR) AS stream_id, leg, d, CAST(10000000 + 5 * (sum(d) OVER (PARTITION BY k ORDER BY leg ROWS UNBOUNDED PRECEDING) - d) AS BIGINT) AS p FROM (
        SELECT k, r // 4 AS leg, CAST(CASE WHEN r // 4 % 2 = 0 THEN 1000 + sum(c) % 9001 ELSE -(1000 + sum(c) % 9001) END + CASE WHEN r // 480 % 2 = 0 THEN 1200 ELSE -1200 END AS BIGINT) AS d
        FROM (SELECT l_partkey % 20 AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY l_partkey % 20 ORDER BY l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) - 1 AS r FROM lineitem) GROUP BY k, r // 4, r // 480)), range(5) t(j)"""


def merged(tf: str = "1h", bars: str = "") -> str:
    """CTEs bars, steps and merged, of walk bars or of ``bars``."""
    return f"""bars AS MATERIALIZED ({numbered(bars) if bars else walk(tf)}),
    steps AS (
      SELECT stream_id, i, ts, open, high, low, close, false AS falling, CAST(0 AS BIGINT) AS idx, i AS raw_start FROM bars WHERE i = 0
      UNION ALL
      SELECT b.stream_id, b.i, b.ts,
        CASE WHEN x.inside THEN s.open ELSE b.open END,
        CASE WHEN NOT x.inside THEN b.high WHEN s.falling THEN least(s.high, b.high) ELSE greatest(s.high, b.high) END,
        CASE WHEN NOT x.inside THEN b.low WHEN s.falling THEN least(s.low, b.low) ELSE greatest(s.low, b.low) END,
        b.close, CASE WHEN x.inside THEN s.falling ELSE b.high < s.high END,
        s.idx + CASE WHEN x.inside THEN 0 ELSE 1 END, CASE WHEN x.inside THEN s.raw_start ELSE b.i END
      FROM steps s JOIN bars b ON b.stream_id = s.stream_id AND b.i = s.i + 1
      CROSS JOIN LATERAL (SELECT (s.high >= b.high AND s.low <= b.low) OR (b.high >= s.high AND b.low <= s.low) AS inside) x
    ),
    merged AS MATERIALIZED (
      SELECT stream_id, idx, arg_max(ts, i) AS ts, CAST(arg_max(open, i) AS DOUBLE) AS open, CAST(arg_max(high, i) AS DOUBLE) AS high, CAST(arg_max(low, i) AS DOUBLE) AS low,
        CAST(arg_max(close, i) AS DOUBLE) AS close, min(raw_start) AS raw_start, max(i) AS raw_end FROM steps GROUP BY 1, 2
    )"""


FRACTALS = """fractals AS MATERIALIZED (
      SELECT stream_id, m_idx, kind, CASE WHEN kind = 'top' THEN high ELSE low END AS price, raw_start, raw_end FROM (
        SELECT *, CASE WHEN high > ph AND high > nh AND low > pl AND low > nl THEN 'top' WHEN low < pl AND low < nl AND high < ph AND high < nh THEN 'bottom' END AS kind FROM (
          SELECT stream_id, idx AS m_idx, high, low, raw_start, raw_end, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lead(high) OVER w AS nh, lead(low) OVER w AS nl
          FROM merged WINDOW w AS (PARTITION BY stream_id ORDER BY idx))) WHERE kind IS NOT NULL
    )"""
TURNS = """turns AS MATERIALIZED (
      SELECT stream_id, m_idx, kind, price, raw_start, raw_end, row_number() OVER (PARTITION BY stream_id ORDER BY m_idx) AS r FROM (
        SELECT *, row_number() OVER (PARTITION BY stream_id, run ORDER BY CASE WHEN kind = 'top' THEN -price ELSE price END, m_idx) AS n FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY m_idx ROWS UNBOUNDED PRECEDING) AS run FROM (
            SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY stream_id ORDER BY m_idx) <> kind THEN 1 ELSE 0 END AS fresh FROM fractals))) WHERE n = 1
    )"""
_GAP = {"wide": "t.m_idx - s.a >= 4", "strict": "t.m_idx - s.a >= 5", "new": "t.m_idx - s.a >= 2 AND t.raw_start - s.a_end - 1 >= 3"}


def strokes(mode: str = "wide", tf: str = "1h", bars: str = "") -> str:
    """CTEs up to strokes: anchor a, number n of the last stroke, and that stroke's ends after every turn."""
    return f"""{merged(tf, bars)}, {FRACTALS}, {TURNS},
    tries AS (
      SELECT stream_id, r, m_idx AS a, kind AS a_kind, price AS a_price, raw_end AS a_end, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS i0, CAST(NULL AS DOUBLE) AS p0, CAST(NULL AS BIGINT) AS i1, CAST(NULL AS DOUBLE) AS p1
      FROM turns WHERE r = 1
      UNION ALL
      SELECT s.stream_id, t.r,
        CASE WHEN x.act > 0 THEN t.m_idx ELSE s.a END, CASE WHEN x.act > 0 THEN t.kind ELSE s.a_kind END, CASE WHEN x.act > 0 THEN t.price ELSE s.a_price END, CASE WHEN x.act > 0 THEN t.raw_end ELSE s.a_end END,
        CASE WHEN x.act = 2 THEN s.n + 1 ELSE s.n END,
        CASE WHEN x.act = 2 THEN s.a ELSE s.i0 END, CASE WHEN x.act = 2 THEN s.a_price ELSE s.p0 END,
        CASE WHEN x.act = 2 OR (x.act = 1 AND s.n > 0) THEN t.m_idx ELSE s.i1 END, CASE WHEN x.act = 2 OR (x.act = 1 AND s.n > 0) THEN t.price ELSE s.p1 END
      FROM tries s JOIN turns t ON t.stream_id = s.stream_id AND t.r = s.r + 1
      CROSS JOIN LATERAL (SELECT CASE
        WHEN t.kind = s.a_kind AND ((t.kind = 'top' AND t.price > s.a_price) OR (t.kind = 'bottom' AND t.price < s.a_price)) THEN 1
        WHEN t.kind <> s.a_kind AND {_GAP[mode]} AND ((t.kind = 'top' AND t.price > s.a_price) OR (t.kind = 'bottom' AND t.price < s.a_price)) THEN 2 ELSE 0 END AS act) x
    ),
    made AS (SELECT stream_id, n, arg_max(i0, r) AS i0, arg_max(i1, r) AS i1, arg_max(p0, r) AS p0, arg_max(p1, r) AS p1 FROM tries WHERE n > 0 GROUP BY 1, 2),
    strokes AS MATERIALIZED (
      SELECT m.stream_id, m.n - 1 AS idx, m.i0, m.i1, CASE WHEN m.p1 > m.p0 THEN 'up' ELSE 'down' END AS direction, max(b.high) AS high, min(b.low) AS low, m.p0, m.p1,
        m.n < max(m.n) OVER (PARTITION BY m.stream_id) AS confirmed
      FROM made m JOIN merged b ON b.stream_id = m.stream_id AND b.idx BETWEEN m.i0 AND m.i1 GROUP BY m.stream_id, m.n, m.i0, m.i1, m.p0, m.p1
    )"""


SEGMENTS_V0 = """threes AS MATERIALIZED (
      SELECT *, greatest(low, l1, l2) < least(high, h1, h2) AS meets FROM (
        SELECT *, lead(low) OVER w AS l1, lead(low, 2) OVER w AS l2, lead(high) OVER w AS h1, lead(high, 2) OVER w AS h2, lead(i1, 2) OVER w AS e FROM strokes WINDOW w AS (PARTITION BY stream_id ORDER BY idx)) WHERE l2 IS NOT NULL
    ),
    hops AS (
      SELECT stream_id, idx, meets FROM threes WHERE idx = 0
      UNION ALL
      SELECT t.stream_id, t.idx, t.meets FROM hops h JOIN threes t ON t.stream_id = h.stream_id AND t.idx = h.idx + CASE WHEN h.meets THEN 2 ELSE 1 END
    ),
    segments AS MATERIALIZED (
      SELECT h.stream_id, row_number() OVER (PARTITION BY h.stream_id ORDER BY h.idx) - 1 AS idx, t.idx AS s0, t.idx + 2 AS s1, t.i0, t.e AS i1, t.direction, greatest(t.high, t.h1, t.h2) AS high, least(t.low, t.l1, t.l2) AS low,
        lead(h.idx) OVER (PARTITION BY h.stream_id ORDER BY h.idx) IS NOT NULL AS confirmed
      FROM hops h JOIN threes t ON t.stream_id = h.stream_id AND t.idx = h.idx WHERE h.meets
    )"""
#: One step a segment: looking for a core at i (seg NULL), or growing the center that starts at seg.
CENTERS = """sure AS MATERIALIZED (
      SELECT *, greatest(low, l1, l2) AS tzd, least(high, h1, h2) AS tzg FROM (
        SELECT stream_id, idx AS i, low, high, lead(low) OVER w AS l1, lead(low, 2) OVER w AS l2, lead(high) OVER w AS h1, lead(high, 2) OVER w AS h2 FROM segments WHERE confirmed WINDOW w AS (PARTITION BY stream_id ORDER BY idx))
    ),
    looks AS (
      SELECT stream_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seg, CAST(NULL AS DOUBLE) AS zd, CAST(NULL AS DOUBLE) AS zg, CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS done_end, CAST(NULL AS DOUBLE) AS dzd, CAST(NULL AS DOUBLE) AS dzg
      FROM sure WHERE i = 0
      UNION ALL
      SELECT k.stream_id,
        CASE WHEN k.seg IS NULL THEN CASE WHEN s.tzg > s.tzd THEN k.i + 3 ELSE k.i + 1 END WHEN s.high >= k.zd AND s.low <= k.zg THEN k.i + 1 ELSE k.i - 1 END,
        CASE WHEN k.seg IS NULL THEN CASE WHEN s.tzg > s.tzd THEN k.i END WHEN s.high >= k.zd AND s.low <= k.zg THEN k.seg END,
        CASE WHEN k.seg IS NULL THEN s.tzd ELSE k.zd END, CASE WHEN k.seg IS NULL THEN s.tzg ELSE k.zg END,
        CASE WHEN k.seg IS NOT NULL AND NOT (s.high >= k.zd AND s.low <= k.zg) THEN k.seg END, CASE WHEN k.seg IS NOT NULL AND NOT (s.high >= k.zd AND s.low <= k.zg) THEN k.i - 1 END, k.zd, k.zg
      FROM looks k JOIN sure s ON s.stream_id = k.stream_id AND s.i = k.i
    ),
    closed AS (SELECT stream_id, done AS seg_start, done_end AS seg_end, dzd AS zd, dzg AS zg, true AS settled FROM looks WHERE done IS NOT NULL),
    last_i AS (SELECT stream_id, max(i) AS n FROM sure GROUP BY 1),
    open_ AS (SELECT k.stream_id, k.seg AS seg_start, l.n AS seg_end, k.zd, k.zg, false AS settled FROM looks k JOIN last_i l USING (stream_id) WHERE k.seg IS NOT NULL AND k.i = l.n + 1),
    centers AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seg_start) - 1 AS idx FROM (SELECT * FROM closed UNION ALL SELECT * FROM open_))"""

_EDGES = """wide AS (
      SELECT ts, max(close) FILTER (stream_id = 'view') AS EQUITY, max(close) FILTER (stream_id = 'signup') AS REAL_ESTATE, max(close) FILTER (stream_id = 'click') AS COMMODITY, max(close) FILTER (stream_id = 'purchase') AS CASH
      FROM bars GROUP BY ts HAVING count(DISTINCT stream_id) FILTER (stream_id IN ('view', 'signup', 'click', 'purchase')) = 4),
    moved AS (SELECT *, lag(EQUITY) OVER w AS pe, lag(REAL_ESTATE) OVER w AS pr, lag(COMMODITY) OVER w AS pc, lag(CASH) OVER w AS pk FROM wide WINDOW w AS (ORDER BY ts)),
    edges AS MATERIALIZED (
      SELECT ts, vertex_a, vertex_b, CASE WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END AS s FROM (
        SELECT ts, 'EQUITY' AS vertex_a, 'REAL_ESTATE' AS vertex_b, EQUITY * pr AS x, pe * REAL_ESTATE AS y FROM moved WHERE pe IS NOT NULL
        UNION ALL SELECT ts, 'EQUITY', 'COMMODITY', EQUITY * pc, pe * COMMODITY FROM moved WHERE pe IS NOT NULL
        UNION ALL SELECT ts, 'EQUITY', 'CASH', EQUITY * pk, pe * CASH FROM moved WHERE pe IS NOT NULL
        UNION ALL SELECT ts, 'REAL_ESTATE', 'COMMODITY', REAL_ESTATE * pc, pr * COMMODITY FROM moved WHERE pe IS NOT NULL
        UNION ALL SELECT ts, 'REAL_ESTATE', 'CASH', REAL_ESTATE * pk, pr * CASH FROM moved WHERE pe IS NOT NULL
        UNION ALL SELECT ts, 'COMMODITY', 'CASH', COMMODITY * pk, pc * CASH FROM moved WHERE pe IS NOT NULL)),
    nets AS (SELECT ts, vertex, CAST(sum(s) AS BIGINT) AS net FROM (SELECT ts, vertex_a AS vertex, s FROM edges UNION ALL SELECT ts, vertex_b, -s FROM edges) GROUP BY 1, 2)"""
_STRENGTH = "CASE WHEN abs(net) >= 3 THEN 'strong' WHEN abs(net) = 2 THEN 'weak' ELSE 'none' END AS strength"
_FLOWS = f"SELECT ts, vertex, net, {_STRENGTH}, CASE WHEN net > 0 THEN 'sink' WHEN net < 0 THEN 'source' ELSE 'neutral' END AS role FROM nets"

_LINE = """line AS (
      SELECT stream_id, i, ts, CAST(close AS DOUBLE) AS f, CAST(close AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS g FROM bars WHERE i = 0
      UNION ALL
      SELECT b.stream_id, b.i, b.ts, x.f, x.s, (1 - CAST(2 AS DOUBLE) / 10) * l.g + (CAST(2 AS DOUBLE) / 10) * (x.f - x.s) FROM line l JOIN bars b ON b.stream_id = l.stream_id AND b.i = l.i + 1
      CROSS JOIN LATERAL (SELECT (1 - CAST(2 AS DOUBLE) / 13) * l.f + (CAST(2 AS DOUBLE) / 13) * b.close AS f, (1 - CAST(2 AS DOUBLE) / 27) * l.s + (CAST(2 AS DOUBLE) / 27) * b.close AS s) x
    ),
    macd AS MATERIALIZED (SELECT stream_id, i, ts, f - s AS macd, g AS signal, f - s - g AS hist FROM line)"""


def _macd(tf: str = "1h") -> str:
    return f"bars AS MATERIALIZED ({walk(tf)}), {_LINE}"


_NAMES = ("EQUITY", "REAL_ESTATE", "COMMODITY", "CASH")


def _timeline() -> str:
    """Last direction of every edge, carried forward over the sequence of events; then nets."""
    pairs = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]
    held = ", ".join(f"coalesce(last_value(CASE WHEN vertex_a = '{a}' AND vertex_b = '{b}' THEN s END IGNORE NULLS) OVER w, 0) AS {a}__{b}" for a, b in pairs)
    nets = " UNION ALL ".join(
        f"SELECT ts, vertex_a, vertex_b, '{v}' AS vertex, CAST({' + '.join(('-' if b == v else '') + f'{a}__{b}' for a, b in pairs if v in (a, b))} AS BIGINT) AS net FROM held" for v in _NAMES
    )
    return f"""WITH bars AS ({walk_bars()}), {_EDGES},
    held AS (SELECT ts, vertex_a, vertex_b, {held} FROM edges WHERE s <> 0 WINDOW w AS (ORDER BY ts, vertex_a, vertex_b ROWS UNBOUNDED PRECEDING))
    SELECT *, {_STRENGTH} FROM ({nets})"""


def oracle_sql() -> dict[str, str]:
    hourly = event_bars()
    sql = {"bars_hourly": f"SELECT {BAR} FROM ({hourly})"}
    sql |= {f"resample_{tf}": f"SELECT {BAR} FROM ({event_bars(tf)})" for tf in ("5m", "15m", "30m", "1h", "4h", "1d", "1w")}
    sql["tail_n"] = f"SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC) AS n FROM ({hourly})) WHERE n <= 20"
    sql["range_page"] = f"""SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts DESC) AS n FROM ({hourly})
      WHERE ts <= TIMESTAMP '2024-01-12 00:00:00' AND ts > TIMESTAMP '2024-01-05 06:00:00') WHERE n <= 50"""
    sql["client_records"] = f"SELECT stream_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, volume FROM ({event_bars('1d')})"
    sql["upsert_keep_last"] = f"SELECT stream_id, ts, open, high, low, CASE WHEN ts >= TIMESTAMP '2024-01-10 00:00:00' THEN close + 1 ELSE close END AS close, volume FROM ({event_bars('4h')})"
    sql["current_bars"] = f"SELECT stream_id, ts, open, high, low, close, volume * 2 AS volume FROM ({event_bars('1d')})"
    sql["catalog_search"] = "SELECT n_name AS symbol, n_nationkey AS id FROM nation WHERE contains(upper(n_name), '1')"
    sql["regular_hours"] = f"SELECT {BAR} FROM ({event_bars('15m')}) WHERE hour(ts) * 60 + minute(ts) >= 870 AND hour(ts) * 60 + minute(ts) < 1260"
    sql["brand_daily"] = """SELECT p_brand AS stream_id, CAST(l_shipdate AS TIMESTAMP) AS ts, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM (SELECT p_brand, l_shipdate, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2"""
    sql["daily_rank"] = f"SELECT * FROM (SELECT stream_id, ts, abs(close - open) AS moved, row_number() OVER (PARTITION BY ts ORDER BY abs(close - open) DESC, stream_id) AS place FROM ({walk_bars('1d')})) WHERE place <= 2"
    sides = f"(SELECT * FROM ({hourly}) WHERE stream_id = 'view') a JOIN (SELECT * FROM ({hourly}) WHERE stream_id = 'click') b ON a.ts = b.ts"
    columns = ("open", "high", "low", "close")
    sql["spread_bars"] = f"SELECT 'view-click' AS stream_id, a.ts, {', '.join(f'a.{c} - b.{c} AS {c}' for c in columns)}, a.volume FROM {sides}"
    sql["ratio_bars"] = f"SELECT 'view/click' AS stream_id, a.ts, {', '.join(f'round(CAST(a.{c} AS DOUBLE) / b.{c}, 9) AS {c}' for c in columns)}, a.volume FROM {sides}"
    sql["ratio_cv"] = f"""WITH b AS ({walk_bars()}) SELECT x.stream_id || '/' || y.stream_id AS pair_id, count(*) AS n_bars, round(stddev_pop(CAST(x.close AS DOUBLE) / y.close) / avg(CAST(x.close AS DOUBLE) / y.close), 9) AS cv
      FROM b x JOIN b y ON x.ts = y.ts AND x.stream_id < y.stream_id GROUP BY 1"""
    for name, known in (("as_of_start", "ts"), ("as_of_close", "ts + INTERVAL 4 HOUR")):
        sql[name] = f"""WITH b AS ({walk_bars()}), w AS (SELECT stream_id, {known} AS known, ts, close FROM ({walk_bars('4h')}))
          SELECT b.stream_id, b.ts, b.close, w.ts AS wide_ts, w.close AS wide_close FROM b ASOF LEFT JOIN w ON b.stream_id = w.stream_id AND b.ts >= w.known"""
    frame = "OVER (PARTITION BY stream_id ORDER BY ts ROWS 19 PRECEDING)"
    sql["sma20"] = f"SELECT stream_id, ts, round(CASE WHEN count(*) {frame} = 20 THEN avg(close) {frame} END, 6) AS sma FROM ({walk_bars()})"
    sql["bollinger20"] = f"""SELECT stream_id, ts, round(CASE WHEN n = 20 THEN m END, 6) AS middle, round(CASE WHEN n = 20 THEN m + 2 * s END, 6) AS upper, round(CASE WHEN n = 20 THEN m - 2 * s END, 6) AS lower
      FROM (SELECT stream_id, ts, count(*) {frame} AS n, avg(close) {frame} AS m, stddev_samp(close) {frame} AS s FROM ({walk_bars()}))"""
    sql["ema20"] = f"""WITH RECURSIVE bars AS MATERIALIZED ({walk()}), e AS (SELECT stream_id, i, ts, CAST(close AS DOUBLE) AS v FROM bars WHERE i = 0
      UNION ALL SELECT b.stream_id, b.i, b.ts, (1 - CAST(2 AS DOUBLE) / 21) * e.v + (CAST(2 AS DOUBLE) / 21) * b.close FROM e JOIN bars b ON b.stream_id = e.stream_id AND b.i = e.i + 1) SELECT stream_id, ts, round(v, 6) AS ema FROM e"""
    sql["macd"] = f"WITH RECURSIVE {_macd()} SELECT stream_id, ts, round(macd, 6) AS macd, round(signal, 6) AS signal, round(hist, 6) AS hist FROM macd"
    sql["rsi14"] = f"""WITH RECURSIVE bars AS MATERIALIZED (SELECT *, close - lag(close) OVER (PARTITION BY stream_id ORDER BY i) AS d FROM ({walk()})),
      r AS (SELECT stream_id, i, ts, CAST(greatest(d, 0) AS DOUBLE) AS g, CAST(greatest(-d, 0) AS DOUBLE) AS l FROM bars WHERE i = 1
        UNION ALL SELECT b.stream_id, b.i, b.ts, (1 - CAST(1 AS DOUBLE) / 14) * r.g + (CAST(1 AS DOUBLE) / 14) * greatest(b.d, 0), (1 - CAST(1 AS DOUBLE) / 14) * r.l + (CAST(1 AS DOUBLE) / 14) * greatest(-b.d, 0)
        FROM r JOIN bars b ON b.stream_id = r.stream_id AND b.i = r.i + 1)
      SELECT b.stream_id, b.ts, round(CASE WHEN r.i < 14 OR (r.g = 0 AND r.l = 0) THEN NULL WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END, 6) AS rsi FROM bars b LEFT JOIN r ON r.stream_id = b.stream_id AND r.i = b.i"""
    sql["macd_area"] = f"""WITH RECURSIVE {_macd()} SELECT stream_id, i // 50 AS part, min(i) AS lo, max(i) AS hi, round(fsum(hist), 6) AS area_total, round(fsum(greatest(hist, 0)), 6) AS area_pos, round(fsum(least(hist, 0)), 6) AS area_neg, count(*) AS n_bars FROM macd GROUP BY 1, 2"""
    sql["inclusion"] = f"WITH RECURSIVE {merged()} SELECT stream_id, idx, ts, open, high, low, close, raw_start, raw_end FROM merged"
    sql["fractals"] = f"WITH RECURSIVE {merged()}, {FRACTALS} SELECT stream_id, m_idx, kind, price FROM fractals"
    sql["fractals_dedup"] = f"WITH RECURSIVE {merged()}, {FRACTALS}, {TURNS} SELECT stream_id, m_idx, kind, price FROM turns"
    sql |= {f"strokes_{mode}": f"WITH RECURSIVE {strokes(mode)} SELECT * FROM strokes" for mode in _GAP}
    sql["stroke_metrics"] = f"WITH RECURSIVE {strokes()} SELECT stream_id, count(*) AS n, count(*) FILTER (direction = 'up') AS n_up, max(high - low) AS widest, max(i1 - i0) AS longest FROM strokes GROUP BY 1"
    sql["segments_v0"] = f"WITH RECURSIVE {strokes()}, {SEGMENTS_V0} SELECT * FROM segments"
    sql["zhongshu_over_v0"] = f"""WITH RECURSIVE {strokes(tf='5m')}, {SEGMENTS_V0}, {CENTERS}
      SELECT c.stream_id, c.idx, c.zd, c.zg, c.seg_start, c.seg_end, c.seg_end - c.seg_start + 1 AS seg_count, c.settled, CASE WHEN c.settled THEN c.seg_end + 1 ELSE -1 END AS break_seg,
        CASE WHEN NOT c.settled THEN '' WHEN b.low > c.zg THEN 'up' ELSE 'down' END AS break_direction, max(s.high) AS gg, min(s.low) AS dd
      FROM centers c JOIN sure s ON s.stream_id = c.stream_id AND s.i BETWEEN c.seg_start AND c.seg_end LEFT JOIN sure b ON b.stream_id = c.stream_id AND b.i = c.seg_end + 1
      GROUP BY c.stream_id, c.idx, c.zd, c.zg, c.seg_start, c.seg_end, c.settled, b.low"""
    leg = "OVER (PARTITION BY stream_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
    sql["force_amplitude"] = f"""WITH RECURSIVE {strokes()} SELECT stream_id, idx, direction, (h - l) * greatest(b, 1) AS force FROM (
      SELECT stream_id, idx, direction, count(*) {leg} AS n, max(high) {leg} AS h, min(low) {leg} AS l, max(i1) {leg} - min(i0) {leg} AS b FROM strokes) WHERE n = 3"""
    sql["force_macd"] = f"""WITH RECURSIVE {strokes()}, {_LINE},
      starts AS MATERIALIZED (SELECT s.*, m.raw_start AS lo FROM strokes s JOIN merged m ON m.stream_id = s.stream_id AND m.idx = s.i0),
      placed AS MATERIALIZED (SELECT s.*, m.raw_end AS hi FROM starts s JOIN merged m ON m.stream_id = s.stream_id AND m.idx = s.i1)
      SELECT s.stream_id, s.idx, s.direction, abs(round(fsum(CASE WHEN s.direction = 'up' THEN greatest(m.hist, 0) ELSE least(m.hist, 0) END), 6)) AS force,
        round(CASE WHEN s.direction = 'up' THEN greatest(max(m.macd), 0) ELSE abs(least(min(m.macd), 0)) END, 6) AS dif_peak, round(CASE WHEN s.direction = 'up' THEN greatest(max(m.hist), 0) ELSE abs(least(min(m.hist), 0)) END, 6) AS hist_peak
      FROM placed s JOIN macd m ON m.stream_id = s.stream_id AND m.i BETWEEN s.lo AND s.hi
      GROUP BY s.stream_id, s.idx, s.direction"""
    sql["stroke_flows"] = f"""WITH RECURSIVE {strokes()} SELECT stream_id, CASE WHEN direction = 'up' THEN 'B_TO_A' ELSE 'A_TO_B' END AS flow, count(*) AS n, round(avg(abs(p1 - p0) / abs(p0)), 9) AS mean_magnitude, round(max(abs(p1 - p0) / abs(p0)), 9) AS max_magnitude
      FROM strokes GROUP BY 1, 2"""
    base = f"WITH RECURSIVE {strokes(tf='5m')}, {chain.SEGMENTS_V1}"
    sql["segments_v1"] = f"{base} SELECT stream_id, CAST(0 AS INTEGER) AS level, * EXCLUDE (stream_id) FROM segments"
    sql["feature_fractals"] = f"{base}, {chain.FEATURES} SELECT stream_id, CAST(0 AS INTEGER) AS level, * EXCLUDE (stream_id) FROM features"
    sql["zhongshu_v1"] = f"{base}, {chain.chain()} {chain.ZHONGSHUS}"
    sql["moves_v1"] = f"{base}, {chain.chain()} {chain.MOVES}"
    sql["divergences_v1"] = f"{base}, {_LINE}, {chain.chain()}, {chain.divergences()} {chain.DIVERGENCES}"
    sql["trading_points"] = f"{base}, {chain.chain()}, {chain.divergences('bars')}, {chain.POINTS}"
    sql["center_liveness"] = f"{base}, {chain.chain()}, {chain.liveness()} {chain.LIVENESS}"
    sql["lstar"] = f"{base}, {chain.chain()}, {chain.liveness()} {chain.LSTAR}"
    deep = f"WITH RECURSIVE {strokes(bars=LEGS)}, {chain.SEGMENTS_V1}"
    sql["deep_zhongshus"] = f"{deep}, {chain.chain()} {chain.ZHONGSHUS}"
    sql["deep_moves"] = f"{deep}, {chain.chain()} {chain.MOVES}"
    sql["deep_divergences"] = f"{deep}, {_LINE}, {chain.chain()}, {chain.divergences()} {chain.DIVERGENCES}"
    sql["deep_points"] = f"{deep}, {chain.chain()}, {chain.divergences('bars')}, {chain.POINTS}"
    sql["deep_liveness"] = f"{deep}, {chain.chain()}, {chain.liveness()} {chain.LIVENESS}"
    sql["deep_lstar"] = f"{deep}, {chain.chain()}, {chain.liveness()} {chain.LSTAR}"
    sql["nested_divergence"] = f"{deep}, {_LINE}, {chain.chain()}, {chain.divergences()}, {chain.NESTED}"
    sql["small_to_big"] = f"{deep}, {chain.chain()}, {chain.divergences('bars')}, {chain.older_chain()}, {chain.divergences_v0('bars')} {chain.TURNS}"
    sql["centers_v0"] = f"{base}, {chain.older_chain()} {chain.CENTERS_V0}"
    sql["trends_v0"] = f"{base}, {chain.older_chain()} {chain.TRENDS_V0}"
    sql["divergences_v0"] = f"{base}, {_LINE}, {chain.older_chain()}, {chain.divergences_v0()} {chain.DIVERGENCES_V0}"
    levels = " UNION ALL ".join(f"SELECT stream_id, '{layer}' AS layer, CAST({level} AS INTEGER) AS level FROM {name}" for layer, level, name in chain.LAYERS)
    sql["layer_counts"] = f"{base}, {chain.chain()}, {chain.older_chain()} SELECT stream_id, layer, level, count(*) AS n FROM ({levels}) GROUP BY 1, 2, 3"
    sql["brand_strokes"] = f"WITH RECURSIVE {strokes(bars=sql['brand_daily'])} SELECT stream_id, count(*) AS n, max(high) AS high, min(low) AS low FROM strokes GROUP BY 1"
    users = WALK.replace("event_type AS stream_id", "CAST(user_id AS VARCHAR) AS stream_id").replace("PARTITION BY event_type", "PARTITION BY user_id")
    sql["user_stroke_counts"] = f"WITH RECURSIVE {strokes(bars=_bars(users, '1h'))} SELECT stream_id, count(*) AS n FROM strokes GROUP BY 1"
    pairs = f"""WITH RECURSIVE each AS MATERIALIZED ({walk_bars()}),
    ratios AS MATERIALIZED (SELECT x.stream_id || '/' || y.stream_id AS stream_id, x.ts, y.open = 0 OR y.close = 0 AS nought, {', '.join(f'CAST(x.{c} AS DOUBLE) / y.{c} AS {c}' for c in columns)} FROM each x JOIN each y ON x.ts = y.ts AND x.stream_id < y.stream_id),
    told AS MATERIALIZED (
      SELECT *, early IS NULL AND n_bars >= 30 AS still FROM (
        SELECT *, CASE WHEN nought THEN 'zero price in b' WHEN n_bars < 5 THEN 'insufficient overlap' WHEN cv < 0.01 THEN 'degenerate ratio' END AS early FROM (
          SELECT stream_id AS pair_id, count(*) AS n_bars, bool_or(nought) AS nought, avg(close) AS mean, CASE WHEN avg(close) <> 0 THEN stddev_pop(close) / avg(close) ELSE 0 END AS cv FROM ratios GROUP BY 1))),
    {strokes(bars='SELECT * FROM ratios WHERE stream_id IN (SELECT pair_id FROM told WHERE still)')}, {_LINE},
    judged AS MATERIALIZED (
      SELECT t.*, CASE WHEN t.still THEN coalesce(s.n, 0) END AS n_strokes, s.mean_move, h.h / t.mean AS norm FROM told t LEFT JOIN (SELECT stream_id, count(*) AS n, avg(abs(p1 / p0 - 1)) AS mean_move FROM strokes GROUP BY 1) s ON s.stream_id = t.pair_id
      LEFT JOIN (SELECT stream_id, avg(abs(hist)) AS h FROM macd GROUP BY 1) h ON h.stream_id = t.pair_id),
    reasons AS MATERIALIZED (SELECT *, coalesce(early, CASE WHEN still AND n_strokes > 0 THEN CASE WHEN mean_move < 0.005 THEN 'structure degenerate' WHEN norm < 0.0001 THEN 'dynamics degenerate' END END) AS reason FROM judged)"""
    sql["pair_validation"] = f"""{pairs} SELECT pair_id, reason IS NULL AS valid, reason, n_bars, round(CASE WHEN early IS NULL OR early = 'degenerate ratio' THEN cv END, 9) AS cv, n_strokes,
      round(CASE WHEN n_strokes > 0 THEN mean_move END, 9) AS stroke_mean, round(CASE WHEN n_strokes > 0 AND mean_move >= 0.005 THEN norm END, 9) AS macd_norm FROM reasons"""
    sql["ratio_structure"] = f"""{pairs}, {chain.SEGMENTS_V1} SELECT r.pair_id, r.reason IS NULL AS valid, r.reason AS error, r.n_bars, r.n_strokes, CASE WHEN r.reason IS NULL THEN coalesce(g.n, 0) END AS n_segments
      FROM reasons r LEFT JOIN (SELECT stream_id, count(*) AS n FROM segments GROUP BY 1) g ON g.stream_id = r.pair_id"""
    flows = f"WITH bars AS ({walk_bars()}), {_EDGES}"
    sql["vertex_net_flow"] = f"{flows} {_FLOWS}"
    sql["resonance"] = f"{flows} SELECT *, abs(net) >= 2 AS resonates FROM ({_FLOWS})"
    sql["conservation_check"] = f"{flows} SELECT ts, CAST(sum(net) AS BIGINT) AS total FROM nets GROUP BY ts HAVING sum(net) <> 0"
    sql["cash_signal"] = f"""{flows} SELECT ts, cash_net, round(CASE WHEN cash_net = 0 THEN 0 ELSE v END, 9) AS variance,
      CASE WHEN cash_net = 0 THEN 'neutral' WHEN v = 0 THEN 'metric_shift' WHEN v / (8.0 / 9.0) > 0.5 THEN 'genuine_flow' ELSE 'mixed' END AS signal,
      CAST(round(CASE WHEN cash_net = 0 OR v = 0 THEN 1.0 WHEN v / (8.0 / 9.0) > 0.5 THEN least(v / (8.0 / 9.0), 1.0) ELSE 0.5 END, 9) AS DOUBLE) AS confidence
      FROM (SELECT ts, net AS cash_net FROM nets WHERE vertex = 'CASH') JOIN (SELECT ts, var_pop(-s) AS v FROM edges WHERE vertex_a <> 'CASH' AND vertex_b <> 'CASH' GROUP BY ts) USING (ts)"""
    sql["flow_timeline"] = _timeline()
    sql["invariant_violations"] = check.violations()
    sql["inclusion_residual"] = f"WITH RECURSIVE {merged()} SELECT 'merged' AS source, * FROM ({check.included('SELECT * FROM merged')}) UNION ALL SELECT 'raw', * FROM ({check.included('SELECT *, i AS idx FROM bars')})"
    sql["direction_check"] = f"WITH RECURSIVE {merged()}, {check.retold('told', check.SPOILT['merged'])} SELECT * FROM told"
    sql["fractal_check"] = f"WITH RECURSIVE {merged()}, {FRACTALS} {check.fractals(check.SPOILT['fractals'])}"
    sql["stroke_check"] = f"WITH RECURSIVE {strokes()} {check.strokes(check.SPOILT['strokes'])}"
    sql["segment_check"] = f"{base} {check.segments(check.SPOILT['segments'])}"
    moved = "SELECT * REPLACE (s0 + CASE WHEN idx % 5 = 2 THEN 1 ELSE 0 END AS s0, s1 + CASE WHEN idx % 5 = 2 THEN 1 ELSE 0 END AS s1) FROM segments"
    sql["segment_check_v0"] = f"WITH RECURSIVE {strokes(tf='5m')}, {SEGMENTS_V0} {check.segments(moved, True)}"
    sql["center_check"] = f"{base}, {chain.older_chain()}, older AS MATERIALIZED ({chain.CENTERS_V0}) {check.centers(check.SPOILT['centers'])}"
    sql["assertion_report"] = check.report(base, "")
    known = ", ".join(f"('{symbol}', '{exchange}')" for symbol, _, exchange, _ in CATALOG)
    sql["stream_names"] = f"""SELECT symbol, stream_id, substr(sha256(stream_id), 1, 12) AS stream_hash, '5m' AS tf FROM (SELECT s.symbol, coalesce(k.exchange, 'UNKNOWN') || ':' || upper(s.symbol) || '/1min@5m:L0/replay' AS stream_id
      FROM (SELECT symbol FROM (VALUES {known}) v(symbol, exchange) UNION ALL SELECT n_name FROM nation) s LEFT JOIN (VALUES {known}) k(symbol, exchange) ON k.symbol = upper(s.symbol))"""
    sql["routed_events"] = """WITH hits AS (
        SELECT event_id, CAST(0 AS BIGINT) AS rule, 'desk' AS target, 'review' AS action, 1 AS rank FROM events WHERE event_type = 'purchase' AND CAST(user_id AS VARCHAR) LIKE '1%' AND floor(value) >= 100
        UNION ALL SELECT event_id, 1, 'ledger', 'book', 2 FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT event_id, 2, 'ops', 'page', 1 FROM events WHERE event_type = 'error' AND CAST(user_id AS VARCHAR) LIKE '7%'
        UNION ALL SELECT event_id, 3, 'noise', 'drop', 3 FROM events WHERE event_type = 'click' AND floor(value) < 5)
      SELECT event_id, rule, target, action, row_number() OVER (PARTITION BY event_id ORDER BY rank, rule) AS place FROM hits"""
    return sql
