"""SQL of the structural checks over layers, some rows of which are spoilt so that there is something to find."""

from __future__ import annotations

from barloom.operators.invariants import CATALOGUE
from barloom.plans import chain_sql as chain


def _spoil(table: str, **columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{expr} AS {name}' for name, expr in columns.items())}) FROM {table}"


_TURNED = "CASE direction WHEN 'up' THEN 'down' ELSE 'up' END"
SPOILT = {
    "merged": _spoil("merged", high="CASE WHEN idx % 9 = 4 THEN high + 1 ELSE high END", raw_end="CASE WHEN idx % 31 = 7 THEN raw_end + 1 ELSE raw_end END"),
    "fractals": _spoil(
        "fractals", price="CASE WHEN m_idx % 11 = 0 THEN price + 1 ELSE price END", kind="CASE WHEN m_idx % 13 <> 0 THEN kind WHEN kind = 'top' THEN 'bottom' ELSE 'top' END", m_idx="CASE WHEN m_idx % 17 = 0 THEN m_idx + 1 ELSE m_idx END"
    ),
    "strokes": _spoil(
        "strokes", i1="CASE WHEN idx % 10 = 3 THEN i0 + 3 ELSE i1 END", direction=f"CASE WHEN idx % 10 = 6 THEN {_TURNED} ELSE direction END", confirmed="CASE WHEN idx % 10 = 8 THEN NOT confirmed ELSE confirmed END"
    ),
    "segments": _spoil(
        "segments", s1="CASE WHEN idx % 7 = 2 THEN s0 + 1 ELSE s1 END", direction=f"CASE WHEN idx % 7 = 4 THEN {_TURNED} ELSE direction END", kind="CASE WHEN idx % 7 = 5 THEN 'candidate' ELSE kind END", trigger_k="CASE WHEN idx % 7 <> 6 THEN trigger_k END"
    ),
    "centers": _spoil("older", high="CASE WHEN seg0 % 4 = 1 THEN low ELSE high END", kind="CASE WHEN seg0 % 4 = 2 THEN 'candidate' ELSE kind END", confirmed="CASE WHEN seg0 % 4 = 3 THEN NOT confirmed ELSE confirmed END"),
    "moved": _spoil("older", seg1="seg1 + CASE WHEN seg0 % 2 = 0 THEN 1000 ELSE 0 END", i0="i0 + CASE WHEN seg0 % 2 = 1 THEN 1 ELSE 0 END"),
}


def included(table: str) -> str:
    return f"""SELECT stream_id, idx FROM (SELECT stream_id, idx, high, low, lag(high) OVER w AS h, lag(low) OVER w AS l FROM ({table}) WINDOW w AS (PARTITION BY stream_id ORDER BY idx))
      WHERE (h >= high AND l <= low) OR (high >= h AND low <= l)"""


def retold(name: str, table: str) -> str:
    """CTEs up to ``name``: merged bars of ``table`` that folding their raw bars anew does not give."""
    return f"""{name}_m AS MATERIALIZED (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, coalesce(lead(raw_start) OVER w, 9223372036854775807) AS stop FROM ({table}) WINDOW w AS (PARTITION BY stream_id ORDER BY idx)),
    {name}_f AS (
      SELECT m.stream_id, m.idx, m.stop, b.i, b.open, b.high, b.low, b.close, coalesce(b.high < m.ph, false) AS falling, coalesce((m.ph >= b.high AND m.pl <= b.low) OR (b.high >= m.ph AND b.low <= m.pl), false) AS odd
      FROM {name}_m m JOIN bars b ON b.stream_id = m.stream_id AND b.i = m.raw_start
      UNION ALL
      SELECT f.stream_id, f.idx, f.stop, b.i, f.open, CASE WHEN f.falling THEN least(f.high, b.high) ELSE greatest(f.high, b.high) END, CASE WHEN f.falling THEN least(f.low, b.low) ELSE greatest(f.low, b.low) END, b.close, f.falling,
        f.odd OR NOT ((f.high >= b.high AND f.low <= b.low) OR (b.high >= f.high AND b.low <= f.low))
      FROM {name}_f f JOIN bars b ON b.stream_id = f.stream_id AND b.i = f.i + 1 WHERE b.i < f.stop
    ),
    {name} AS (
      SELECT m.stream_id, m.idx FROM {name}_m m LEFT JOIN (SELECT stream_id, idx, max(i) AS e, arg_max(open, i) AS o, arg_max(high, i) AS h, arg_max(low, i) AS l, arg_max(close, i) AS c, bool_or(odd) AS odd FROM {name}_f GROUP BY 1, 2) f ON f.stream_id = m.stream_id AND f.idx = m.idx
      WHERE NOT coalesce(NOT f.odd AND m.open = f.o AND m.high = f.h AND m.low = f.l AND m.close = f.c AND m.raw_end = f.e, false)
    )"""


def fractals(table: str) -> str:
    return f"""SELECT f.stream_id, f.m_idx, f.kind, f.price FROM ({table}) f LEFT JOIN (SELECT stream_id, idx, high, low, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lead(high) OVER w AS nh, lead(low) OVER w AS nl FROM merged WINDOW w AS (PARTITION BY stream_id ORDER BY idx)) m
      ON m.stream_id = f.stream_id AND m.idx = f.m_idx
      WHERE NOT coalesce(m.ph IS NOT NULL AND m.nh IS NOT NULL AND CASE f.kind WHEN 'top' THEN m.high > m.ph AND m.high > m.nh AND m.low > m.pl AND m.low > m.nl AND f.price = m.high ELSE m.low < m.pl AND m.low < m.nl AND m.high < m.ph AND m.high < m.nh AND f.price = m.low END, false)"""


def strokes(table: str) -> str:
    return f"""SELECT stream_id, idx FROM (SELECT *, lag(direction) OVER w AS d, lag(i1) OVER w AS e, lead(idx) OVER w IS NULL AS fin FROM ({table}) WINDOW w AS (PARTITION BY stream_id ORDER BY idx))
      WHERE i1 - i0 < 4 OR coalesce(d = direction, false) OR coalesce(e <> i0, false) OR confirmed = fin"""


_MEETS = """(SELECT *, CASE WHEN lead(idx, 2) OVER w IS NOT NULL THEN greatest(low, lead(low) OVER w, lead(low, 2) OVER w) < least(high, lead(high) OVER w, lead(high, 2) OVER w) END AS meets FROM strokes WINDOW w AS (PARTITION BY stream_id ORDER BY idx))"""


def segments(table: str, v0: bool = False) -> str:
    rules = (
        "NOT coalesce(a.meets, false)"
        if v0
        else """coalesce(s.s0 NOT IN (s.e, s.e + 1), false) OR coalesce(s.d = s.direction, false) OR (s.p0 <> 0 AND s.p1 <> 0 AND CASE s.direction WHEN 'up' THEN s.p1 - s.p0 ELSE s.p0 - s.p1 END < -1e-9)
        OR (s.kind = 'candidate' AND NOT s.fin) OR (s.kind = 'settled' AND s.confirmed AND s.trigger_k IS NULL) OR (s.confirmed AND coalesce(NOT k.meets, false))"""
    )
    turn = "" if v0 else f"LEFT JOIN {_MEETS} k ON k.stream_id = s.stream_id AND k.idx = s.trigger_k"
    return f"""SELECT s.stream_id, s.idx FROM (SELECT *, lag(s1) OVER w AS e, lag(direction) OVER w AS d, lead(idx) OVER w IS NULL AS fin FROM ({table}) WINDOW w AS (PARTITION BY stream_id ORDER BY idx)) s
      LEFT JOIN {_MEETS} a ON a.stream_id = s.stream_id AND a.idx = s.s0 LEFT JOIN strokes z ON z.stream_id = s.stream_id AND z.idx = s.s1 {turn}
      WHERE s.s1 - s.s0 < 2 OR a.i0 IS NULL OR z.i1 IS NULL OR s.i0 <> a.i0 OR s.i1 <> z.i1 OR s.confirmed = s.fin OR {rules}"""


def centers(table: str) -> str:
    return f"""SELECT stream_id, level, idx FROM (SELECT *, lead(idx) OVER (PARTITION BY stream_id, level ORDER BY idx) IS NULL AS fin FROM ({table}))
      WHERE seg1 - seg0 < 2 OR high <= low OR (kind = 'settled') <> (sustain >= 2) OR confirmed = fin"""


PARTS = """below AS MATERIALIZED (SELECT stream_id, 1 AS level, idx AS k, i0, i1 FROM segments UNION ALL SELECT stream_id, level + 1, row_number() OVER (PARTITION BY stream_id, level ORDER BY idx) - 1, i0, i1 FROM trends WHERE confirmed)"""


def _over(table: str, where: str) -> str:
    return f"SELECT c.stream_id, c.level, c.idx FROM ({table}) c LEFT JOIN below a ON a.stream_id = c.stream_id AND a.level = c.level AND a.k = c.seg0 LEFT JOIN below z ON z.stream_id = c.stream_id AND z.level = c.level AND z.k = c.seg1 WHERE {where}"


def report(base: str, leading: str) -> str:
    """``base``: CTEs up to strokes and the segments above them; ``leading``: CTEs of fractals."""
    ctes = f"""{base}, {leading}{chain.chain()}, {chain.liveness()}, {chain.older_chain()}, older AS MATERIALIZED ({chain.CENTERS_V0}), trends AS MATERIALIZED ({chain.TRENDS_V0}), {PARTS}, {retold('told', 'SELECT * FROM merged')}, {retold('twisted', SPOILT['merged'])}"""
    away, past = "c.i0 <> a.i0 OR c.i1 <> z.i1", "c.seg1 < c.seg0 OR a.k IS NULL OR z.k IS NULL"
    ledger = _over("SELECT * FROM trends WHERE level > 1", "NOT coalesce(c.i0 = a.i0 AND c.i1 = z.i1, false)")
    found = {
        "A1 inclusion left": (included("SELECT * FROM merged"), included(SPOILT["merged"])), "A2 merges": ("SELECT * FROM told", "SELECT * FROM twisted"), "A3 fractals": (fractals("SELECT * FROM fractals"), fractals(SPOILT["fractals"])),
        "A4 strokes": (strokes("SELECT * FROM strokes"), strokes(SPOILT["strokes"])), "A5 centers of segments": (_over("SELECT * FROM older", away), _over(SPOILT["moved"], away)), "A6 segments": (segments("SELECT * FROM segments"), segments(SPOILT["segments"])),
        "A7 centers": (centers("SELECT * FROM older"), centers(SPOILT["centers"])), "A8 parts": (_over("SELECT * FROM older", past), _over(SPOILT["moved"], past)),
        "A9 live centers": ("SELECT 1 FROM alive WHERE alive GROUP BY stream_id, level, seg_start, seg_end HAVING count(*) > 1", "SELECT DISTINCT stream_id, level, seg_start, seg_end FROM alive WHERE alive"), "A10 ledgers": (ledger, ledger),
    }
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", n AS n_broken, n = 0 AS ok, '{state}' AS state FROM (SELECT count(*) AS n FROM ({q}))""" for name, both in found.items() for state, q in zip(("as it is", "spoilt"), both)
    )
    return f"{ctes} {rows}"


def violations() -> str:
    """Broken invariants of the log that plans/queries.py plants."""
    broken = {
        "I1": "layer = 'stroke' AND what = 'settled' AND last = 'settled'", "I2": "bar_ts < ts_before", "I4": "seq <= seq_before", "I6": "layer = 'segment' AND what = 'settle' AND NOT coalesce(pending, false)",
        "I7": "layer = 'segment' AND what = 'settle' AND s1 <> new_s0 - 1", "I9": "what IN ('invalidate', 'invalidated') AND decided IN ('invalidate', 'invalidated') AND layer <> 'stroke'",
        "I11": "layer = 'zhongshu' AND what IN ('candidate', 'settle') AND zg <= zd", "I12": "layer = 'zhongshu' AND what = 'settle' AND NOT coalesce(candidate, false)", "I13": "layer = 'zhongshu' AND what IN ('candidate', 'settle') AND seg_count < 3",
        "I18": "layer = 'move' AND what IN ('candidate', 'settle') AND zs_count < 1", "I19": "layer = 'move' AND what = 'settle' AND NOT coalesce(candidate, false)", "I20": "layer = 'move' AND what IN ('candidate', 'settle') AND zs_end < a",
        "I23": "layer = 'bsp' AND what = 'candidate' AND kind = 'type3' AND event_id % 29 = 0", "I24": "layer = 'bsp' AND what = 'confirm' AND NOT coalesce(candidate, false)", "I25": "layer = 'bsp' AND what = 'settle' AND NOT coalesce(confirmed, false)",
        "I26": "layer = 'bsp' AND what = 'candidate' AND kind = 'type1' AND mixed",
    }
    rows = " UNION ALL ".join(f"SELECT stream_id, '{code}' AS code, bar_idx, seq, event_type, '{CATALOGUE[code].replace(chr(39), chr(39) * 2)}' AS reason, 'planted' AS source FROM w WHERE {test}" for code, test in broken.items())
    return f"""WITH n AS (SELECT event_id, event_type AS stream_id, user_id % 6 AS a, user_id % 3 AS b, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events),
    l AS (SELECT *, ['stroke', 'segment', 'zhongshu', 'move', 'bsp'][event_id % 5 + 1] AS layer, event_id // 5 AS turn, n // 4 AS bar_idx, n - CASE WHEN n % 53 = 0 THEN 200 ELSE 0 END AS seq FROM n),
    e AS (SELECT *, 300.0 * bar_idx - CASE WHEN bar_idx % 97 = 0 THEN 10000.0 ELSE 0 END AS bar_ts,
        CASE layer WHEN 'stroke' THEN ['candidate', 'settled', 'invalidated'][turn % 3 + 1] WHEN 'segment' THEN ['pending', 'settle', 'invalidate'][turn % 3 + 1] WHEN 'bsp' THEN ['candidate', 'confirm', 'settle', 'invalidate'][turn % 4 + 1] ELSE ['candidate', 'settle', 'invalidate'][turn % 3 + 1] END AS what,
        a * 3 + 2 AS s1, a * 3 + 3 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS new_s0, a + 10 AS zd, a + 15 - CASE WHEN event_id % 13 = 0 THEN 9 ELSE 0 END AS zg, 3 - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS seg_count,
        1 - CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS zs_count, a - CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS zs_end, 'type' || (b + 1) AS kind, n // 8 AS seg_idx FROM l),
    k AS (SELECT *, layer || '_' || CASE WHEN layer = 'segment' AND what = 'pending' THEN 'break_pending' ELSE what END AS event_type, CASE WHEN layer = 'zhongshu' THEN a || '|' || zg ELSE CAST(a AS VARCHAR) END AS identity FROM e),
    w AS MATERIALIZED (SELECT *, lag(what) OVER one AS last, lag(seq) OVER engine AS seq_before, lag(bar_ts) OVER (PARTITION BY stream_id ORDER BY bar_idx, layer, seq) AS ts_before,
        last_value(CASE WHEN what IN ('settle', 'settled', 'invalidate', 'invalidated') THEN what END IGNORE NULLS) OVER past AS decided, bool_or(what = 'pending') OVER past AS pending, bool_or(what = 'candidate') OVER past AS candidate, bool_or(what = 'confirm') OVER past AS confirmed,
        layer = 'bsp' AND what = 'candidate' AND count(DISTINCT CASE WHEN layer = 'bsp' AND what = 'candidate' THEN kind END) OVER (PARTITION BY stream_id, bar_idx, seg_idx) > 1 AS mixed
      FROM k WINDOW one AS (PARTITION BY stream_id, layer, identity ORDER BY bar_idx, seq), past AS (PARTITION BY stream_id, layer, identity ORDER BY bar_idx, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), engine AS (PARTITION BY stream_id, layer ORDER BY bar_idx, seq))
    {rows}"""
