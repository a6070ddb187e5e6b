"""SQL of the layers above strokes: both segment rules' chains, divergences, points, liveness.

Common table expressions over ``strokes`` and ``merged`` (plans/oracles.py), written from the
rules alone: sequential ones are recursive queries with one row a stream and step, the
others are ranges and windows. Levels are unrolled; a level without rows costs nothing.
"""

from __future__ import annotations

#: Levels of the newer chain that the SQL unrolls.
LEVELS = 3

SEGMENTS_V1 = """parts AS MATERIALIZED (
      SELECT *, CASE direction WHEN 'down' THEN high ELSE -low END AS fh, CASE direction WHEN 'down' THEN low ELSE -high END AS fl, CASE direction WHEN 'up' THEN high ELSE -low END AS gh, CASE direction WHEN 'up' THEN low ELSE -high END AS gl,
        l2 IS NOT NULL AND greatest(low, l1, l2) < least(high, h1, h2) AS meets
      FROM (SELECT *, lead(low) OVER w AS l1, lead(low, 2) OVER w AS l2, lead(high) OVER w AS h1, lead(high, 2) OVER w AS h2 FROM strokes WINDOW w AS (PARTITION BY stream_id ORDER BY idx))
    ),
    later AS (
      SELECT a.stream_id, a.idx AS a, b.idx AS k, b.gh AS h, b.gl AS l, false AS rising, CAST(0 AS BIGINT) AS e FROM parts a JOIN parts b ON b.stream_id = a.stream_id AND b.idx = a.idx + 1
      UNION ALL
      SELECT s.stream_id, s.a, p.idx,
        CASE WHEN NOT x.inside THEN p.gh WHEN s.rising THEN greatest(s.h, p.gh) ELSE least(s.h, p.gh) END, CASE WHEN NOT x.inside THEN p.gl WHEN s.rising THEN greatest(s.l, p.gl) ELSE least(s.l, p.gl) END,
        CASE WHEN x.inside THEN s.rising ELSE p.gh > s.h END, s.e + CASE WHEN x.inside THEN 0 ELSE 1 END
      FROM later s JOIN parts p ON p.stream_id = s.stream_id AND p.idx = s.k + 2
      CROSS JOIN LATERAL (SELECT (s.h >= p.gh AND s.l <= p.gl) OR (p.gh >= s.h AND p.gl <= s.l) AS inside) x
    ),
    answers AS (
      SELECT DISTINCT stream_id, a FROM (
        SELECT *, lag(h) OVER w AS ph, lead(h) OVER w AS nh, lag(l) OVER w AS pl, lead(l) OVER w AS nl
        FROM (SELECT stream_id, a, e, arg_max(h, k) AS h, arg_max(l, k) AS l FROM later GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY stream_id, a ORDER BY e))
      WHERE (h > ph AND h > nh AND l > pl AND l > nl) OR (h < ph AND h < nh AND l < pl AND l < nl)
    ),
    known AS MATERIALIZED (
      SELECT p.stream_id, count(*) AS n, list(p.idx) FILTER (p.meets) AS meet, list(p.idx) FILTER (a.a IS NOT NULL) AS answered, min(p.idx) FILTER (p.meets) AS first
      FROM parts p LEFT JOIN answers a ON a.stream_id = p.stream_id AND a.a = p.idx GROUP BY 1
    ),
    walked AS (
      SELECT k.stream_id, k.first AS k, k.first AS s0, p.direction AS way, CAST(-1 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS looked, CAST([] AS DOUBLE[]) AS hs, CAST([] AS DOUBLE[]) AS ls, CAST([] AS BIGINT[]) AS ks, true AS rising,
        CAST(NULL AS BIGINT) AS done, CAST(NULL AS BIGINT) AS done_end, CAST(NULL AS VARCHAR) AS done_way, CAST(NULL AS BIGINT) AS fractal_a, CAST(NULL AS VARCHAR) AS gap_type
      FROM known k JOIN parts p ON p.stream_id = k.stream_id AND p.idx = k.first
      UNION ALL
      SELECT f.stream_id, CASE WHEN f.good THEN f.at ELSE f.k + 1 END, CASE WHEN f.good THEN f.at ELSE f.s0 END, CASE WHEN NOT f.good THEN f.way WHEN f.way = 'up' THEN 'down' ELSE 'up' END,
        CASE WHEN f.good THEN -1 WHEN f.j IS NOT NULL THEN f.at ELSE f.refused END, CASE WHEN f.good THEN 0 WHEN f.j IS NOT NULL THEN greatest(0, f.j - 1) ELSE f.looked END,
        CASE WHEN f.good THEN [] ELSE f.hs END, CASE WHEN f.good THEN [] ELSE f.ls END, CASE WHEN f.good THEN [] ELSE f.ks END, f.good OR f.rising,
        CASE WHEN f.good THEN f.s0 END, CASE WHEN f.good THEN f.at - 1 END, CASE WHEN f.good THEN f.way END, CASE WHEN f.good THEN f.j - 1 END, CASE WHEN f.good THEN CASE WHEN f.ls[f.j + 1] >= f.hs[f.j] THEN 'second' ELSE 'none' END END
      FROM (
        SELECT g.*, ks[j + 1] AS at, j IS NOT NULL AND ks[j + 1] - s0 >= 3 AND ks[j + 1] + 2 < n AND list_contains(meet, ks[j + 1]) AS good FROM (
          SELECT t.*, CASE WHEN fed THEN list_filter(range(greatest(1, looked, len(ks) - 7), len(ks) - 1), lambda x: ks[x + 1] > refused AND hs[x + 1] > greatest(hs[x], hs[x + 2]) AND ls[x + 1] > greatest(ls[x], ls[x + 2])
            AND (ls[x + 1] < hs[x] OR list_contains(coalesce(answered, []), ks[x + 1])))[1] END AS j
          FROM (
            SELECT w.stream_id, w.k, w.s0, w.way, w.refused, n.n, n.meet, n.answered, p.direction <> w.way AS fed,
              CASE WHEN p.direction <> w.way AND x.inside THEN greatest(0, len(w.ks) - 3) ELSE w.looked END AS looked,
              CASE WHEN p.direction = w.way THEN w.hs WHEN x.inside THEN list_append(w.hs[:-2], CASE WHEN w.rising THEN greatest(w.hs[-1], p.fh) ELSE least(w.hs[-1], p.fh) END) ELSE list_append(w.hs, p.fh) END AS hs,
              CASE WHEN p.direction = w.way THEN w.ls WHEN x.inside THEN list_append(w.ls[:-2], CASE WHEN w.rising THEN greatest(w.ls[-1], p.fl) ELSE least(w.ls[-1], p.fl) END) ELSE list_append(w.ls, p.fl) END AS ls,
              CASE WHEN p.direction = w.way THEN w.ks WHEN x.inside THEN list_append(w.ks[:-2], p.idx) ELSE list_append(w.ks, p.idx) END AS ks,
              CASE WHEN p.direction = w.way OR x.inside OR len(w.ks) = 0 THEN w.rising ELSE p.fh > w.hs[-1] END AS rising
            FROM walked w JOIN parts p ON p.stream_id = w.stream_id AND p.idx = w.k JOIN known n ON n.stream_id = w.stream_id
            CROSS JOIN LATERAL (SELECT len(w.ks) > 0 AND coalesce((w.hs[-1] >= p.fh AND w.ls[-1] <= p.fl) OR (p.fh >= w.hs[-1] AND p.fl <= w.ls[-1]), false) AS inside) x) t) g) f
    ),
    closed_v1 AS (SELECT stream_id, done AS s0, done_end AS s1, done_way AS direction, done_end + 1 AS trigger_k, fractal_a, gap_type FROM walked WHERE done IS NOT NULL),
    ends_v1 AS (SELECT w.stream_id, w.s0, k.n, w.way, list_contains(coalesce(k.meet, []), w.s0) AS meets FROM walked w JOIN known k ON k.stream_id = w.stream_id AND w.k = k.n),
    spans_v1 AS (
      SELECT c.stream_id, c.s0, CASE WHEN x.swallows THEN e.n - 1 ELSE c.s1 END AS s1, c.direction, NOT x.swallows AS confirmed, 'settled' AS kind, CASE WHEN NOT x.swallows THEN c.trigger_k END AS trigger_k,
        CASE WHEN NOT x.swallows THEN c.fractal_a END AS fractal_a, CASE WHEN NOT x.swallows THEN c.gap_type END AS gap_type
      FROM closed_v1 c JOIN ends_v1 e ON e.stream_id = c.stream_id CROSS JOIN LATERAL (SELECT e.n - e.s0 < 3 AND c.s1 + 1 = e.s0 AS swallows) x
      UNION ALL
      SELECT e.stream_id, e.s0, e.n - 1, e.way, false, CASE WHEN e.meets THEN 'settled' ELSE 'candidate' END, NULL, NULL, NULL FROM ends_v1 e
      WHERE e.n - e.s0 >= 3 OR NOT EXISTS (SELECT 1 FROM closed_v1 c WHERE c.stream_id = e.stream_id)
    ),
    segments AS MATERIALIZED (
      SELECT v.stream_id, row_number() OVER (PARTITION BY v.stream_id ORDER BY v.s0) - 1 AS idx, v.s0, v.s1, f.i0, t.i1, v.direction, r.high, r.low, v.confirmed, v.kind,
        CASE WHEN f.direction = v.direction THEN f.p0 ELSE f.p1 END AS p0, CASE WHEN t.direction = v.direction THEN t.p1 ELSE t.p0 END AS p1,
        CASE WHEN f.direction = v.direction THEN f.i0 ELSE f.i1 END AS ep0_i, CASE WHEN t.direction = v.direction THEN t.i1 ELSE t.i0 END AS ep1_i, v.trigger_k, v.fractal_a, v.gap_type
      FROM spans_v1 v JOIN strokes f ON f.stream_id = v.stream_id AND f.idx = v.s0 JOIN strokes t ON t.stream_id = v.stream_id AND t.idx = v.s1
      JOIN (SELECT v.stream_id, v.s0, max(s.high) AS high, min(s.low) AS low FROM spans_v1 v JOIN strokes s ON s.stream_id = v.stream_id AND s.idx BETWEEN v.s0 AND v.s1 GROUP BY 1, 2) r ON r.stream_id = v.stream_id AND r.s0 = v.s0
    )"""

FEATURES = """fed AS (
      SELECT g.stream_id, g.idx AS segment_idx, s.idx AS stroke, s.high, s.low, row_number() OVER (PARTITION BY g.stream_id, g.idx ORDER BY s.idx) - 1 AS r
      FROM segments g JOIN strokes s ON s.stream_id = g.stream_id AND s.idx BETWEEN g.s0 AND g.s1 AND s.direction <> g.direction
    ),
    joined AS (
      SELECT stream_id, segment_idx, r, stroke, high, low, false AS falling, CAST(0 AS BIGINT) AS e FROM fed WHERE r = 0
      UNION ALL
      SELECT f.stream_id, f.segment_idx, f.r, f.stroke,
        CASE WHEN NOT x.inside THEN f.high WHEN j.falling THEN least(j.high, f.high) ELSE greatest(j.high, f.high) END, CASE WHEN NOT x.inside THEN f.low WHEN j.falling THEN least(j.low, f.low) ELSE greatest(j.low, f.low) END,
        CASE WHEN x.inside THEN j.falling ELSE f.high < j.high END, j.e + CASE WHEN x.inside THEN 0 ELSE 1 END
      FROM joined j JOIN fed f ON f.stream_id = j.stream_id AND f.segment_idx = j.segment_idx AND f.r = j.r + 1
      CROSS JOIN LATERAL (SELECT (j.high >= f.high AND j.low <= f.low) OR (f.high >= j.high AND f.low <= j.low) AS inside) x
    ),
    features AS (
      SELECT stream_id, e AS idx, segment_idx, first, last, high, low, fractal, CASE fractal WHEN 'top' THEN high WHEN 'bottom' THEN low END AS price FROM (
        SELECT *, CASE WHEN high > lag(high) OVER w AND high > lead(high) OVER w AND low > lag(low) OVER w AND low > lead(low) OVER w THEN 'top'
          WHEN high < lag(high) OVER w AND high < lead(high) OVER w AND low < lag(low) OVER w AND low < lead(low) OVER w THEN 'bottom' END AS fractal
        FROM (SELECT stream_id, segment_idx, e, min(stroke) AS first, max(stroke) AS last, arg_max(high, r) AS high, arg_max(low, r) AS low FROM joined GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY stream_id, segment_idx ORDER BY e))
    )"""


def centers(c: str, parts: str) -> str:
    """CTEs up to ``c``: centers over ``parts`` (stream_id, i, low, high, s0, s1), i dense from 0."""
    return f"""{c}_t AS MATERIALIZED (
      SELECT stream_id, i, low, high, l2 IS NOT NULL AND least(high, h1, h2) > greatest(low, l1, l2) AS core, greatest(low, l1, l2) AS zd, least(high, h1, h2) AS zg
      FROM (SELECT *, lead(low) OVER w AS l1, lead(low, 2) OVER w AS l2, lead(high) OVER w AS h1, lead(high, 2) OVER w AS h2 FROM {parts} WINDOW w AS (PARTITION BY stream_id ORDER BY i))
    ),
    {c}_w AS (
      SELECT stream_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS DOUBLE) AS zd, CAST(NULL AS DOUBLE) AS zg, CAST(NULL AS BIGINT) AS done FROM {c}_t WHERE i = 0
      UNION ALL
      SELECT w.stream_id, CASE WHEN w.a IS NULL OR w.done IS NOT NULL THEN CASE WHEN t.core THEN w.i + 3 ELSE w.i + 1 END WHEN x.inside THEN w.i + 1 ELSE w.i - 1 END,
        CASE WHEN w.a IS NULL OR w.done IS NOT NULL THEN CASE WHEN t.core THEN w.i END ELSE w.a END, CASE WHEN w.a IS NULL OR w.done IS NOT NULL THEN t.zd ELSE w.zd END, CASE WHEN w.a IS NULL OR w.done IS NOT NULL THEN t.zg ELSE w.zg END,
        CASE WHEN w.a IS NOT NULL AND w.done IS NULL AND NOT x.inside THEN w.i - 1 END
      FROM {c}_w w JOIN {c}_t t ON t.stream_id = w.stream_id AND t.i = w.i CROSS JOIN LATERAL (SELECT t.high >= w.zd AND t.low <= w.zg AS inside) x
    ),
    {c} AS MATERIALIZED (
      SELECT b.stream_id, row_number() OVER (PARTITION BY b.stream_id ORDER BY b.a) - 1 AS idx, b.zd, b.zg, b.a AS seg_start, b.z AS seg_end, b.z - b.a + 1 AS seg_count, b.settled,
        CASE WHEN b.settled THEN b.z + 1 ELSE -1 END AS break_seg, CASE WHEN NOT b.settled THEN '' WHEN max(n.low) > b.zg THEN 'up' ELSE 'down' END AS break_direction,
        max(p.high) AS gg, min(p.low) AS dd, min(p.s0) AS first_s0, max(p.s1) AS last_s1
      FROM (
        SELECT stream_id, a, done AS z, zd, zg, true AS settled FROM {c}_w WHERE done IS NOT NULL
        UNION ALL SELECT w.stream_id, w.a, w.i - 1, w.zd, w.zg, false FROM {c}_w w JOIN (SELECT stream_id, max(i) AS m FROM {c}_t GROUP BY 1) t ON t.stream_id = w.stream_id AND w.i = t.m + 1 WHERE w.a IS NOT NULL AND w.done IS NULL) b
      JOIN {parts} p ON p.stream_id = b.stream_id AND p.i BETWEEN b.a AND b.z LEFT JOIN {parts} n ON n.stream_id = b.stream_id AND n.i = b.z + 1
      GROUP BY b.stream_id, b.a, b.z, b.zd, b.zg, b.settled
    )"""


def _grouped(m: str, steps: str) -> str:
    """CTE ``m``_g: rows of ``steps`` (stream_id, r, step) in groups g whose steps all go one way."""
    return f"""{m}_g AS (
      SELECT stream_id, r, '' AS way, CAST(0 AS BIGINT) AS g FROM {steps} WHERE r = 0
      UNION ALL
      SELECT s.stream_id, s.r, CASE WHEN s.step <> '' AND g.way IN ('', s.step) THEN s.step ELSE '' END, g.g + CASE WHEN s.step <> '' AND g.way IN ('', s.step) THEN 0 ELSE 1 END
      FROM {m}_g g JOIN {steps} s ON s.stream_id = g.stream_id AND s.r = g.r + 1
    )"""


def moves(m: str, c: str, last: str) -> str:
    """CTEs up to ``m``: moves over centers ``c``; ``last`` is the SQL of the last move's end, with n.n the number of segments."""
    inner = f"coalesce(lead(min(s.seg_start)) OVER (PARTITION BY s.stream_id ORDER BY s.g) - 1, {last})" if "n.n" in last else last
    return f"""{m}_s AS MATERIALIZED (
      SELECT *, CASE WHEN dd > lag(gg) OVER w THEN 'up' WHEN gg < lag(dd) OVER w THEN 'down' ELSE '' END AS step, row_number() OVER w - 1 AS r FROM {c} WHERE settled WINDOW w AS (PARTITION BY stream_id ORDER BY idx)
    ),
    {_grouped(m, f"{m}_s")},
    {m} AS MATERIALIZED (
      SELECT s.stream_id, s.g AS idx, CASE WHEN count(*) > 1 THEN 'trend' ELSE 'consolidation' END AS kind, CASE WHEN count(*) > 1 THEN max(s.way) ELSE max(s.break_direction) END AS direction,
        min(s.seg_start) AS seg_start, {inner} AS seg_end, min(s.idx) AS zs_start, max(s.idx) AS zs_end, count(*) AS zs_count, s.g < max(s.g) OVER (PARTITION BY s.stream_id) AS settled,
        max(s.gg) AS high, min(s.dd) AS low, arg_min(s.first_s0, s.r) AS first_s0, arg_max(s.last_s1, s.r) AS last_s1
      FROM (SELECT s.*, g.g, g.way FROM {m}_s s JOIN {m}_g g ON g.stream_id = s.stream_id AND g.r = s.r) s JOIN (SELECT stream_id, count(*) AS n FROM segments GROUP BY 1) n ON n.stream_id = s.stream_id
      GROUP BY s.stream_id, s.g, n.n
    )"""


def _union(columns: str, pieces: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(f"SELECT stream_id, CAST({level} AS INTEGER) AS level, {columns} FROM {name}" for level, name in pieces)


def chain() -> str:
    """CTEs of centers c1.. and moves m1.. of all levels over ``segments``; p1.. are what centers are built from, q1.. what lies below."""
    out = [
        "p1 AS MATERIALIZED (SELECT stream_id, idx AS i, low, high, direction, s0, s1 FROM segments WHERE confirmed)",
        "q1 AS MATERIALIZED (SELECT stream_id, idx AS i, low, high, direction, i0, i1 FROM segments)", centers("c1", "p1"), moves("m1", "c1", "n.n - 1"),
    ]
    for k in range(2, LEVELS + 1):
        enough = "" if k == 2 else f" AND stream_id IN (SELECT stream_id FROM m{k - 1} GROUP BY 1 HAVING count(*) >= 3)"
        out += [
            f"p{k} AS MATERIALIZED (SELECT stream_id, i, low, high, direction, i AS s0, i AS s1 FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS i FROM m{k - 1} WHERE settled{enough}))",
            f"q{k} AS MATERIALIZED (SELECT stream_id, idx AS i, low, high, direction FROM m{k - 1})", centers(f"c{k}", f"p{k}"), moves(f"m{k}", f"c{k}", "max(s.seg_end)"),
        ]
    return ",\n    ".join(out)


_OF_CENTER = "idx, zd, zg, seg_start, seg_end, seg_count, settled, break_seg, break_direction, gg, dd, first_s0, last_s1"
_OF_MOVE = "idx, kind, direction, seg_start, seg_end, zs_start, zs_end, zs_count, settled, high, low, first_s0, last_s1"
ZHONGSHUS = _union(_OF_CENTER, [(k, f"c{k}") for k in range(1, LEVELS + 1)])
MOVES = _union(_OF_MOVE, [(k, f"m{k}") for k in range(1, LEVELS + 1)])


# --- divergences ------------------------------------------------------------------------


def _exits(parts: str, found: str) -> str:
    """Legs of consolidations: of ``found`` (stream_id, m, center, a, z, low, high, last), for each direction the last two parts that left the center."""
    return f"""SELECT stream_id, m, CASE direction WHEN 'up' THEN 0 ELSE 1 END AS turn, 'consolidation' AS kind, direction, max(i) FILTER (n = 2) AS a0, max(i) FILTER (n = 2) AS a1, max(i) FILTER (n = 1) AS c0, max(i) FILTER (n = 1) AS c1, max(center) AS center, CAST(NULL AS BIGINT) AS g0, CAST(NULL AS BIGINT) AS g1
      FROM (SELECT f.stream_id, f.m, f.center, p.i, p.direction, row_number() OVER (PARTITION BY f.stream_id, f.m, p.direction ORDER BY p.i DESC) AS n FROM ({found}) f JOIN {parts} p ON p.stream_id = f.stream_id
        AND ((p.i BETWEEN f.a AND f.z AND (p.high > f.high OR p.low < f.low)) OR (p.i > f.z AND p.i <= f.last)))
      GROUP BY stream_id, m, direction HAVING count(*) > 1"""


def _trends(parts: str, found: str) -> str:
    """Legs of trends, of ``found`` (stream_id, m, direction, last, center, a, z, before): the last center's bounds and the end of the one before."""
    return f"""SELECT f.stream_id, f.m, 0 AS turn, 'trend' AS kind, f.direction, CASE WHEN f.before + 1 <= f.a - 1 THEN f.before + 1 ELSE f.before END AS a0, CASE WHEN f.before + 1 <= f.a - 1 THEN f.a - 1 ELSE f.before END AS a1, f.z + 1 AS c0, f.last AS c1, f.center, f.a AS g0, f.z AS g1
      FROM ({found}) f JOIN (SELECT stream_id, count(*) AS n FROM {parts} GROUP BY 1) n ON n.stream_id = f.stream_id WHERE f.z + 1 <= f.last AND f.last < n.n AND (CASE WHEN f.before + 1 <= f.a - 1 THEN f.before + 1 ELSE f.before END) < n.n"""


def _legs_v1(k: int) -> str:
    last_two = f"""SELECT m.stream_id, m.idx AS m, m.direction, m.seg_end AS last, z.idx AS center, z.seg_start AS a, z.seg_end AS z, y.seg_end AS before FROM m{k} m JOIN c{k} z ON z.stream_id = m.stream_id AND z.idx = m.zs_end
      JOIN c{k} y ON y.stream_id = m.stream_id AND y.idx = (SELECT max(x.idx) FROM c{k} x WHERE x.stream_id = m.stream_id AND x.settled AND x.idx < m.zs_end AND x.idx >= m.zs_start) WHERE m.kind = 'trend' AND m.zs_count > 1"""
    one = f"SELECT m.stream_id, m.idx AS m, c.idx AS center, c.seg_start AS a, c.seg_end AS z, c.zd AS low, c.zg AS high, m.seg_end AS last FROM m{k} m JOIN c{k} c ON c.stream_id = m.stream_id AND c.idx = m.zs_start WHERE m.kind <> 'trend'"
    # above level 1 the parts that legs count are the settled moves below
    return f"{_trends(_parts(k), last_two)} UNION ALL {_exits(_parts(k), one)}"


def _parts(k: int) -> str:
    return "q1" if k == 1 else f"p{k}"


def judged(d: str, legs: str, parts: str, confirmed: str, force: str, gate: bool, peaks: bool) -> str:
    """CTEs up to ``d``: the first diverging leg of each move. ``confirmed`` is a table (stream_id, m, ok); ``force`` is bars, parts or macd."""
    if force == "macd":
        measures = f"""SELECT r.stream_id, r.m, r.turn, r.which, CASE WHEN r.direction = 'up' THEN round(coalesce(fsum(x.hist) FILTER (x.hist > 0), 0), 6) ELSE abs(round(coalesce(fsum(x.hist) FILTER (x.hist < 0), 0), 6)) END AS f,
          CASE WHEN r.direction = 'up' THEN greatest(0, max(x.macd)) ELSE abs(least(0, min(x.macd))) END AS dif, CASE WHEN r.direction = 'up' THEN greatest(0, max(x.hist)) ELSE abs(least(0, min(x.hist))) END AS his, max(x.macd) > 0 AND min(x.macd) < 0 AS both
        FROM {d}_x r JOIN macd x ON x.stream_id = r.stream_id AND x.i >= r.lo AND x.i <= r.hi GROUP BY r.stream_id, r.m, r.turn, r.which, r.direction"""
        bounds = f"""{d}_a AS MATERIALIZED (SELECT p.stream_id, p.i, p.i1, m.raw_start AS lo FROM {parts} p JOIN merged m ON m.stream_id = p.stream_id AND m.idx = p.i0),
    {d}_z AS MATERIALIZED (SELECT p.*, m.raw_end AS hi FROM {d}_a p JOIN merged m ON m.stream_id = p.stream_id AND m.idx = p.i1),
    {d}_x AS MATERIALIZED (SELECT r.*, a.lo, z.hi FROM {d}_r r JOIN {d}_z a ON a.stream_id = r.stream_id AND a.i = r.a JOIN {d}_z z ON z.stream_id = r.stream_id AND z.i = r.z),
    """
    else:
        bounds = ""
        long = "arg_max(p.i1, p.i) - arg_min(p.i0, p.i)" if force == "bars" else "count(*)"
        measures = f"SELECT r.stream_id, r.m, r.turn, r.which, (max(p.high) - min(p.low)) * greatest(1, {long}) AS f, 0.0 AS dif, 0.0 AS his, true AS both FROM {d}_r r JOIN {parts} p ON p.stream_id = r.stream_id AND p.i BETWEEN r.a AND r.z GROUP BY r.stream_id, r.m, r.turn, r.which"
    peak = lambda side, what: f"CAST(coalesce({side}.{what}, 0) AS DOUBLE)" if peaks and force == "macd" else "CAST(0 AS DOUBLE)"
    return f"""{d}_l AS MATERIALIZED ({legs}),
    {d}_r AS MATERIALIZED (SELECT stream_id, m, turn, direction, 'a' AS which, a0 AS a, a1 AS z FROM {d}_l UNION ALL SELECT stream_id, m, turn, direction, 'c', c0, c1 FROM {d}_l UNION ALL SELECT stream_id, m, turn, direction, 'g', g0, g1 FROM {d}_l WHERE g0 IS NOT NULL),
    {bounds}{d}_m AS MATERIALIZED ({measures}),
    {d} AS MATERIALIZED (
      SELECT stream_id, m, row_number() OVER (PARTITION BY stream_id ORDER BY m) - 1 AS idx, kind, CASE direction WHEN 'up' THEN 'top' ELSE 'bottom' END AS direction, a0 AS seg_a_start, a1 AS seg_a_end, c0 AS seg_c_start, c1 AS seg_c_end, center AS center_idx, CAST(fa AS DOUBLE) AS force_a, CAST(fc AS DOUBLE) AS force_c,
        ok AS confirmed, da AS dif_peak_a, dc AS dif_peak_c, ha AS hist_peak_a, hc AS hist_peak_c
      FROM (
        SELECT l.*, o.ok, a.f AS fa, c.f AS fc, {peak('a', 'dif')} AS da, {peak('c', 'dif')} AS dc, {peak('a', 'his')} AS ha, {peak('c', 'his')} AS hc, row_number() OVER (PARTITION BY l.stream_id, l.m ORDER BY l.turn) AS place
        FROM {d}_l l JOIN ({confirmed}) o ON o.stream_id = l.stream_id AND o.m = l.m JOIN {d}_m a ON a.stream_id = l.stream_id AND a.m = l.m AND a.turn = l.turn AND a.which = 'a' LEFT JOIN {d}_m c ON c.stream_id = l.stream_id AND c.m = l.m AND c.turn = l.turn AND c.which = 'c'
        LEFT JOIN {d}_m g ON g.stream_id = l.stream_id AND g.m = l.m AND g.turn = l.turn AND g.which = 'g'
        WHERE a.f > 0 AND (coalesce(c.f, 0) < a.f OR ({peak('a', 'dif')} > 0 AND {peak('c', 'dif')} < {peak('a', 'dif')}) OR ({peak('a', 'his')} > 0 AND {peak('c', 'his')} < {peak('a', 'his')})) AND {'(l.g0 IS NULL OR g.both)' if gate else 'true'}) WHERE place = 1
    )"""


def divergences(force: str = "macd") -> str:
    """CTEs d1..: divergences of all levels; ``force`` is that of level 1."""
    return ",\n    ".join(judged(f"d{k}", _legs_v1(k), _parts(k), f"SELECT stream_id, idx AS m, settled AS ok FROM m{k}", force if k == 1 else "parts", k == 1 and force == "macd", k == 1) for k in range(1, LEVELS + 1))


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("force_a", "force_c", "dif_peak_a", "dif_peak_c", "hist_peak_a", "hist_peak_c"))


def divergence_rows(names: list[tuple[int, str]]) -> str:
    of = "CAST({} AS INTEGER) AS level_id, idx, kind, direction, seg_a_start, seg_a_end, seg_c_start, seg_c_end, center_idx, confirmed, " + _ROUNDED
    return " UNION ALL ".join(f"SELECT stream_id, CAST({k} AS INTEGER) AS level, {of.format(k)} FROM {name}" for k, name in names)


DIVERGENCES = divergence_rows([(k, f"d{k}") for k in range(1, LEVELS + 1)])

POINTS = """next_of AS MATERIALIZED (SELECT a.stream_id, a.i, w.way, min(b.i) AS k FROM q1 a CROSS JOIN (VALUES ('up'), ('down')) w(way) JOIN q1 b ON b.stream_id = a.stream_id AND b.i > a.i AND b.direction = w.way GROUP BY 1, 2, 3),
    sure_of AS MATERIALIZED (SELECT p.stream_id, p.i, arg_min(m.settled, m.idx) AS settled FROM q1 p JOIN m1 m ON m.stream_id = p.stream_id AND p.i BETWEEN m.seg_start AND m.seg_end GROUP BY 1, 2),
    turned AS MATERIALIZED (
      SELECT d.* EXCLUDE (m), CASE d.direction WHEN 'bottom' THEN 'buy' ELSE 'sell' END AS side, c.zd, c.zg, c.seg_start AS c_start, m.seg_start AS m_start
      FROM d1 d JOIN c1 c ON c.stream_id = d.stream_id AND c.idx = d.center_idx
      JOIN m1 m ON m.stream_id = d.stream_id AND m.idx = (SELECT min(x.idx) FROM m1 x WHERE x.stream_id = d.stream_id AND x.kind = 'trend' AND d.center_idx BETWEEN x.zs_start AND x.zs_end) WHERE d.kind = 'trend'
    ),
    found_points AS MATERIALIZED (
      SELECT t.stream_id, 1 AS typ, t.idx AS nth, 'type1' AS kind, t.side, t.seg_c_end AS seg_idx, t.m_start AS move_seg_start, t.zd AS center_zd, t.zg AS center_zg, t.c_start AS center_seg_start, coalesce(CASE t.side WHEN 'buy' THEN p.low ELSE p.high END, 0) AS price, coalesce(p.i1, 0) AS bar_idx, t.confirmed,
        t.center_idx AS div_center, t.seg_c_start AS div_c_start, t.seg_c_end AS div_c_end
      FROM turned t LEFT JOIN q1 p ON p.stream_id = t.stream_id AND p.i = t.seg_c_end
      UNION ALL
      SELECT t.stream_id, 2, t.idx, 'type2', t.side, p.i, t.m_start, t.zd, t.zg, t.c_start, CASE t.side WHEN 'buy' THEN p.low ELSE p.high END, p.i1, coalesce(s.settled, false), t.center_idx, t.seg_c_start, t.seg_c_end
      FROM turned t JOIN next_of a ON a.stream_id = t.stream_id AND a.i = t.seg_c_end AND a.way = CASE t.side WHEN 'buy' THEN 'up' ELSE 'down' END JOIN next_of b ON b.stream_id = t.stream_id AND b.i = a.k AND b.way = CASE t.side WHEN 'buy' THEN 'down' ELSE 'up' END
      JOIN q1 p ON p.stream_id = t.stream_id AND p.i = b.k LEFT JOIN sure_of s ON s.stream_id = t.stream_id AND s.i = p.i
      UNION ALL
      SELECT c.stream_id, 3, c.idx, 'type3', CASE c.break_direction WHEN 'up' THEN 'buy' ELSE 'sell' END, p.i, c.seg_start, c.zd, c.zg, c.seg_start, CASE c.break_direction WHEN 'up' THEN p.low ELSE p.high END, p.i1, coalesce(s.settled, false), NULL, NULL, NULL
      FROM c1 c JOIN next_of a ON a.stream_id = c.stream_id AND a.i = c.break_seg AND a.way = CASE c.break_direction WHEN 'up' THEN 'down' ELSE 'up' END JOIN q1 p ON p.stream_id = c.stream_id AND p.i = a.k LEFT JOIN sure_of s ON s.stream_id = c.stream_id AND s.i = p.i
      WHERE c.settled AND c.break_direction <> '' AND CASE c.break_direction WHEN 'up' THEN p.low > c.zg ELSE p.high < c.zd END
    )
    SELECT stream_id, CAST(1 AS INTEGER) AS level, row_number() OVER (PARTITION BY stream_id ORDER BY seg_idx, typ, nth) - 1 AS idx, kind, side, CAST(1 AS INTEGER) AS level_id, seg_idx, move_seg_start, center_zd, center_zg, center_seg_start, price, bar_idx, confirmed, false AS settled,
      CASE WHEN typ = 2 AND EXISTS (SELECT 1 FROM found_points t WHERE t.typ = 3 AND t.stream_id = p.stream_id AND t.seg_idx = p.seg_idx AND t.side = p.side) THEN 'type3'
        WHEN typ = 3 AND nth = (SELECT max(t.nth) FROM found_points t WHERE t.typ = 3 AND t.stream_id = p.stream_id AND t.seg_idx = p.seg_idx AND t.side = p.side) AND EXISTS (SELECT 1 FROM found_points t WHERE t.typ = 2 AND t.stream_id = p.stream_id AND t.seg_idx = p.seg_idx AND t.side = p.side) THEN 'type2' END AS overlaps_with,
      div_center, div_c_start, div_c_end FROM found_points p"""


# --- liveness ---------------------------------------------------------------------------


def liveness() -> str:
    """CTEs up to ``alive``: every center of every level, and whether it still decides."""
    seen = " UNION ALL ".join(f"SELECT {k} AS level, stream_id, idx, zd AS low, zg AS high, seg_start, seg_end, settled FROM c{k}" for k in range(1, LEVELS + 1))
    parts = " UNION ALL ".join(f"SELECT {k} AS level, stream_id, i, low, high, direction FROM q{k}" for k in range(1, LEVELS + 1))
    return f"""every_c AS MATERIALIZED ({seen}), every_p AS MATERIALIZED ({parts}),
    prices AS (SELECT stream_id, arg_max(close, ts) AS price FROM bars GROUP BY 1), sizes AS (SELECT level, stream_id, max(i) + 1 AS n FROM every_p GROUP BY 1, 2),
    looks_at AS MATERIALIZED (
      SELECT c.*, t.price, coalesce(n.n, 0) AS n, coalesce(greatest(z.low, c.low) < least(z.high, c.high), false) AS last_cuts, x.i AS out_i, x.direction AS way, greatest(x.low, c.low) < least(x.high, c.high) AS cuts,
        CASE WHEN x.low >= c.high THEN 'above' WHEN x.high <= c.low THEN 'below' END AS side, x.high AS xh, x.low AS xl
      FROM every_c c JOIN prices t USING (stream_id) LEFT JOIN sizes n ON n.stream_id = c.stream_id AND n.level = c.level LEFT JOIN every_p z ON z.stream_id = c.stream_id AND z.level = c.level AND z.i = n.n - 1
      LEFT JOIN every_p x ON x.stream_id = c.stream_id AND x.level = c.level AND x.i = c.seg_end + 1
    ),
    pullback AS (
      SELECT l.level, l.stream_id, l.idx, min(p.i) AS f FROM looks_at l JOIN every_p p ON p.stream_id = l.stream_id AND p.level = l.level AND p.i > l.out_i WHERE p.direction <> l.way OR greatest(p.low, l.low) < least(p.high, l.high) GROUP BY 1, 2, 3
    ),
    extremes AS (
      SELECT l.level, l.stream_id, l.idx, b.f, CASE l.side WHEN 'above' THEN max(p.high) ELSE min(p.low) END AS extreme
      FROM looks_at l LEFT JOIN pullback b ON b.stream_id = l.stream_id AND b.level = l.level AND b.idx = l.idx JOIN every_p p ON p.stream_id = l.stream_id AND p.level = l.level AND p.direction = l.way AND p.i >= l.out_i AND (b.f IS NULL OR p.i <= b.f) GROUP BY 1, 2, 3, 4, l.side
    ),
    again AS (
      SELECT DISTINCT l.level, l.stream_id, l.idx FROM looks_at l JOIN extremes e ON e.stream_id = l.stream_id AND e.level = l.level AND e.idx = l.idx JOIN every_p p ON p.stream_id = l.stream_id AND p.level = l.level AND p.i > e.f AND p.direction = l.way
      WHERE CASE l.side WHEN 'above' THEN p.high > e.extreme ELSE p.low < e.extreme END
    ),
    alive AS MATERIALIZED (
      SELECT stream_id, level, idx, seg_start, seg_end, state IN ('core', 'exit core', 'run', 'back') AS alive,
        CASE state WHEN 'unsettled' THEN 'dead_not_settled' WHEN 'core' THEN 'settle_anchor_in_core' WHEN 'exit core' THEN 'settle_anchor_in_core' WHEN 'run' THEN 'run_anchor_post_exit' WHEN 'back' THEN 'event_anchor_first_pullback' ELSE 'dead_negation_settled' END AS regime,
        CASE WHEN state IN ('exit core', 'run', 'back', 'over') THEN out_i END AS exit_idx, CASE WHEN state IN ('run', 'back', 'over') THEN side END AS exit_side, CASE WHEN state IN ('run', 'back', 'over') THEN extreme END AS exit_extreme,
        state IN ('back', 'over') AS pullback_seen, state = 'over' AS pullback_settled, CASE state WHEN 'unsettled' THEN 'not_settled' WHEN 'no exit' THEN 'no_exit_segment' WHEN 'odd' THEN 'invalid_exit_side' WHEN 'over' THEN 'pullback_settled' END AS reason
      FROM (
        SELECT l.*, e.extreme, CASE WHEN NOT l.settled THEN 'unsettled' WHEN l.price BETWEEN l.low AND l.high OR (l.n > 0 AND l.n <= l.seg_end + 1 AND l.last_cuts) THEN 'core' WHEN l.out_i IS NULL THEN 'no exit' WHEN l.cuts THEN 'exit core' WHEN l.side IS NULL THEN 'odd'
          WHEN a.idx IS NOT NULL THEN 'over' WHEN e.f IS NOT NULL THEN 'back' ELSE 'run' END AS state
        FROM looks_at l LEFT JOIN extremes e ON e.stream_id = l.stream_id AND e.level = l.level AND e.idx = l.idx LEFT JOIN again a ON a.stream_id = l.stream_id AND a.level = l.level AND a.idx = l.idx)
    )"""


LIVENESS = "SELECT stream_id, CAST(level AS INTEGER) AS level, idx, alive, regime, exit_idx, exit_side, exit_extreme, pullback_seen, pullback_settled, reason FROM alive"
LSTAR = """SELECT stream_id, CAST(level AS INTEGER) AS level, CAST(0 AS BIGINT) AS idx, center AS center_idx, regime
    FROM (SELECT stream_id, level, idx AS center, regime, row_number() OVER (PARTITION BY stream_id ORDER BY level DESC, seg_end DESC, seg_start DESC, idx) AS n FROM alive WHERE alive) WHERE n = 1"""


# --- the older chain --------------------------------------------------------------------


def _relation(a: str, b: str) -> str:
    return f"""CASE WHEN {a}.gg <> 0 AND {a}.dd <> 0 AND {b}.gg <> 0 AND {b}.dd <> 0 THEN CASE WHEN {b}.gg < {a}.dd THEN 'down' WHEN {b}.dd > {a}.gg THEN 'up' WHEN {b}.high < {a}.low OR {b}.low > {a}.high THEN 'higher_center' ELSE 'none' END
      WHEN {b}.high > {a}.high AND {b}.low > {a}.low THEN 'up' WHEN {b}.high < {a}.high AND {b}.low < {a}.low THEN 'down' ELSE 'none' END"""


def older(k: int, parts: str) -> str:
    """CTEs v{k} (centers) and t{k} (trends) of one level over ``parts`` (stream_id, i, low, high, direction, i0, i1)."""
    v, t = f"v{k}", f"t{k}"
    return f"""{v}_p AS MATERIALIZED (
      SELECT *, l2 IS NOT NULL AND greatest(low, l1, l2) < least(high, h1, h2) AND direction = d2 AS core, greatest(low, l2) AS zd, least(high, h2) AS zg, count(*) OVER (PARTITION BY stream_id) AS n
      FROM (SELECT *, lead(low) OVER w AS l1, lead(low, 2) OVER w AS l2, lead(high) OVER w AS h1, lead(high, 2) OVER w AS h2, lead(direction, 2) OVER w AS d2 FROM {parts} WINDOW w AS (PARTITION BY stream_id ORDER BY i))
    ),
    {v}_w AS (
      SELECT stream_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS DOUBLE) AS zd, CAST(NULL AS DOUBLE) AS zg, CAST(NULL AS BIGINT) AS done FROM {v}_p WHERE i = 0 AND n >= 3
      UNION ALL
      SELECT w.stream_id, CASE WHEN x.free THEN CASE WHEN p.core THEN w.i + 3 ELSE w.i + 1 END WHEN x.cuts THEN w.i + 1 WHEN x.next_cuts THEN w.i + 2 ELSE w.i END, CASE WHEN x.free THEN CASE WHEN p.core THEN w.i END ELSE w.a END,
        CASE WHEN x.free THEN p.zd ELSE w.zd END, CASE WHEN x.free THEN p.zg ELSE w.zg END, CASE WHEN NOT x.free AND NOT x.cuts AND NOT x.next_cuts THEN w.i END
      FROM {v}_w w JOIN {v}_p p ON p.stream_id = w.stream_id AND p.i = w.i
      CROSS JOIN LATERAL (SELECT w.a IS NULL OR w.done IS NOT NULL AS free, coalesce(greatest(w.zd, p.low) < least(w.zg, p.high), false) AS cuts, p.l1 IS NOT NULL AND coalesce(greatest(w.zd, p.l1) < least(w.zg, p.h1), false) AS next_cuts) x
    ),
    {v}_b AS (
      SELECT stream_id, a, done AS z, zd, zg FROM {v}_w WHERE done IS NOT NULL
      UNION ALL SELECT w.stream_id, w.a, w.i, w.zd, w.zg FROM {v}_w w JOIN (SELECT stream_id, max(n) AS n FROM {v}_p GROUP BY 1) p ON p.stream_id = w.stream_id AND w.i = p.n WHERE w.a IS NOT NULL AND w.done IS NULL
    ),
    {v}_c AS MATERIALIZED (
      SELECT b.stream_id, row_number() OVER (PARTITION BY b.stream_id ORDER BY b.a) - 1 AS idx, b.a AS seg0, b.z - 1 AS seg1, b.zd AS low, b.zg AS high, CASE WHEN b.z - b.a - 3 >= 2 THEN 'settled' ELSE 'candidate' END AS kind,
        lead(b.a) OVER (PARTITION BY b.stream_id ORDER BY b.a) IS NOT NULL AS confirmed, b.z - b.a - 3 AS sustain, f.direction,
        max(p.high) FILTER (x.own) AS gg, min(p.low) FILTER (x.own) AS dd, min(p.high) FILTER (x.own) AS g, max(p.low) FILTER (x.own) AS d, min(p.high) AS zg_dynamic, max(p.low) AS zd_dynamic,
        b.z + 1 < f.n AS terminated, CASE WHEN NOT b.z + 1 < f.n THEN '' WHEN max(e.low) >= b.zg THEN 'above' WHEN max(e.high) <= b.zd THEN 'below' ELSE '' END AS termination_side, f.i0, max(y.i1) AS i1
      FROM {v}_b b JOIN {v}_p f ON f.stream_id = b.stream_id AND f.i = b.a JOIN {v}_p p ON p.stream_id = b.stream_id AND p.i >= b.a AND p.i < b.z JOIN {v}_p y ON y.stream_id = b.stream_id AND y.i = b.z - 1 LEFT JOIN {v}_p e ON e.stream_id = b.stream_id AND e.i = b.z
      CROSS JOIN LATERAL (SELECT p.i IN (b.a, b.a + 2) OR (p.i >= b.a + 3 AND p.direction = f.direction) AS own) x GROUP BY b.stream_id, b.a, b.z, b.zd, b.zg, f.direction, f.n, f.i0
    ),
    {t}_s AS MATERIALIZED (
      SELECT b.*, coalesce({_relation('a', 'b')}, '') AS relation, CASE WHEN a.idx IS NULL THEN '' WHEN {_relation('a', 'b')} IN ('up', 'down') THEN {_relation('a', 'b')} ELSE '' END AS step
      FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS r FROM {v}_c WHERE kind = 'settled') b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS r FROM {v}_c WHERE kind = 'settled') a ON a.stream_id = b.stream_id AND a.r = b.r - 1
    ),
    {_grouped(t, f"{t}_s")},
    {v} AS MATERIALIZED (
      SELECT c.*, CASE WHEN c.kind <> 'settled' THEN '' WHEN n.idx IS NULL THEN CASE WHEN c.terminated THEN 'newborn' WHEN c.sustain > 0 THEN 'extension' ELSE '' END WHEN n.relation IN ('up', 'down') THEN 'newborn' WHEN n.relation = 'higher_center' THEN 'expansion' ELSE 'extension' END AS development
      FROM {v}_c c LEFT JOIN {t}_s o ON o.stream_id = c.stream_id AND o.idx = c.idx LEFT JOIN {t}_s n ON n.stream_id = c.stream_id AND n.r = o.r + 1 WHERE c.stream_id IN (SELECT stream_id FROM {t}_s)
    ),
    {t}_raw AS (
      SELECT stream_id, g, kind, way, first_seg, list, greatest(a, CASE WHEN z - a < 2 THEN least(a + 2, last) ELSE z END) AS z, a FROM (
        SELECT stream_id, g, kind, way, first_seg, list, last, a, greatest(a, z) AS z FROM (
          SELECT s.stream_id, g.g, CASE WHEN count(*) > 1 THEN 'trend' ELSE 'consolidation' END AS kind, max(g.way) AS way, min(s.seg0) AS first_seg, list(s.idx ORDER BY s.idx) AS list, n.n - 1 AS last,
            CASE WHEN g.g > 0 THEN least(min(s.seg0), n.n - 1) ELSE 0 END AS a, coalesce(least(lead(min(s.seg0)) OVER (PARTITION BY s.stream_id ORDER BY g.g), n.n - 1), n.n - 1) AS z
          FROM {t}_s s JOIN {t}_g g ON g.stream_id = s.stream_id AND g.r = s.r JOIN (SELECT stream_id, max(n) AS n FROM {v}_p GROUP BY 1) n ON n.stream_id = s.stream_id GROUP BY s.stream_id, g.g, n.n))
    ),
    {t}_one AS MATERIALIZED (
      SELECT r.stream_id, r.g, r.kind, CASE WHEN r.way = '' THEN max(f.direction) ELSE r.way END AS direction, r.a AS seg0, r.z AS seg1, max(p.high) AS high, min(p.low) AS low, any_value(r.list) AS list
      FROM {t}_raw r JOIN {v}_p f ON f.stream_id = r.stream_id AND f.i = r.first_seg JOIN {v}_p p ON p.stream_id = r.stream_id AND p.i BETWEEN r.a AND r.z GROUP BY r.stream_id, r.g, r.kind, r.way, r.a, r.z
    ),
    {t}_run AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id ORDER BY g ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN kind = 'trend' AND lag(kind) OVER w = 'trend' AND lag(direction) OVER w = direction AND lag(seg1) OVER w = seg0 THEN 0 ELSE 1 END AS fresh FROM {t}_one WINDOW w AS (PARTITION BY stream_id ORDER BY g))),
    {t} AS MATERIALIZED (
      SELECT r.stream_id, row_number() OVER (PARTITION BY r.stream_id ORDER BY r.run) - 1 AS idx, r.kind, r.direction, r.seg0, r.seg1, a.i0, z.i1, r.high, r.low, r.list, lead(r.run) OVER (PARTITION BY r.stream_id ORDER BY r.run) IS NOT NULL AS confirmed
      FROM (SELECT stream_id, run, min(kind) AS kind, min(direction) AS direction, min(seg0) AS seg0, arg_max(seg1, g) AS seg1, max(high) AS high, min(low) AS low, flatten(list(list ORDER BY g)) AS list FROM {t}_run GROUP BY 1, 2) r
      JOIN {v}_p a ON a.stream_id = r.stream_id AND a.i = r.seg0 JOIN {v}_p z ON z.stream_id = r.stream_id AND z.i = r.seg1
    )"""


#: Levels of the older chain that the SQL unrolls.
UNROLLED = 3


def older_chain() -> str:
    out = ["o1 AS MATERIALIZED (SELECT stream_id, idx AS i, low, high, direction, i0, i1 FROM segments)", older(1, "o1")]
    for k in range(2, UNROLLED + 1):
        out += [f"o{k} AS MATERIALIZED (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS i, low, high, direction, i0, i1 FROM t{k - 1} WHERE confirmed)", older(k, f"o{k}")]
    return ",\n    ".join(out)


CENTERS_V0 = _union(
    "idx, seg0, seg1, low, high, kind, confirmed, sustain, direction, gg, dd, g, d, zg_dynamic, zd_dynamic, terminated, termination_side, development, i0, i1", [(k, f"v{k}") for k in range(1, UNROLLED + 1)]
)
TRENDS_V0 = _union("idx, kind, direction, seg0, seg1, i0, i1, high, low, array_to_string(list, ',') AS center_indices, confirmed", [(k, f"t{k}") for k in range(1, UNROLLED + 1)])


def divergences_v0(force: str = "macd") -> str:
    """CTEs e1..: divergences of the older chain by force alone, without zero crossing or peaks."""
    out = []
    for k in range(1, UNROLLED + 1):
        last_two = f"""SELECT t.stream_id, t.idx AS m, t.direction, t.seg1 AS last, z.idx AS center, z.seg0 AS a, z.seg1 AS z, y.seg1 AS before FROM t{k} t JOIN v{k} z ON z.stream_id = t.stream_id AND z.idx = t.list[-1] JOIN v{k} y ON y.stream_id = t.stream_id AND y.idx = t.list[-2] WHERE t.kind = 'trend'"""
        one = f"SELECT t.stream_id, t.idx AS m, c.idx AS center, c.seg0 AS a, c.seg1 AS z, c.low, c.high, t.seg1 AS last FROM t{k} t JOIN v{k} c ON c.stream_id = t.stream_id AND c.idx = t.list[1] WHERE t.kind <> 'trend'"
        out.append(judged(f"e{k}", f"{_trends(f'o{k}', last_two)} UNION ALL {_exits(f'o{k}', one)}", f"o{k}", f"SELECT stream_id, idx AS m, confirmed AS ok FROM t{k}", force, False, False))
    return ",\n    ".join(out)


DIVERGENCES_V0 = divergence_rows([(k, f"e{k}") for k in range(1, UNROLLED + 1)])

#: Divergences of levels 3 and 2 followed down to level 1, through the bars of the settled moves below.
NESTED = """b1 AS MATERIALIZED (SELECT m.stream_id, m.idx, m.settled, coalesce(a.i0, 0) AS lo, coalesce(z.i1, 0) AS hi, a.i IS NOT NULL AND z.i IS NOT NULL AS there
      FROM m1 m LEFT JOIN q1 a ON a.stream_id = m.stream_id AND a.i = m.seg_start AND m.seg_start <= m.seg_end LEFT JOIN q1 z ON z.stream_id = m.stream_id AND z.i = m.seg_end AND m.seg_start <= m.seg_end),
    s1 AS MATERIALIZED (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY idx) - 1 AS i, CASE WHEN there THEN lo ELSE 0 END AS lo, CASE WHEN there THEN hi ELSE 0 END AS hi FROM b1 WHERE settled),
    s2 AS MATERIALIZED (SELECT m.stream_id, row_number() OVER (PARTITION BY m.stream_id ORDER BY m.idx) - 1 AS i, CASE WHEN z.i IS NULL THEN 0 ELSE coalesce(a.lo, 0) END AS lo, CASE WHEN a.i IS NULL THEN 0 ELSE coalesce(z.hi, 0) END AS hi
      FROM m2 m LEFT JOIN s1 a ON a.stream_id = m.stream_id AND a.i = m.seg_start LEFT JOIN s1 z ON z.stream_id = m.stream_id AND z.i = m.seg_end WHERE m.settled),
    said AS MATERIALIZED (
      SELECT d.stream_id, 3 AS top, d.idx, '3:' || d.kind || ':' || d.direction || ':' || d.seg_c_start || '-' || d.seg_c_end AS text, s.lo, s.hi FROM d3 d JOIN s2 s ON s.stream_id = d.stream_id AND s.i = d.seg_c_end WHERE s.lo < s.hi
      UNION ALL SELECT d.stream_id, 2, d.idx, '2:' || d.kind || ':' || d.direction || ':' || d.seg_c_start || '-' || d.seg_c_end, s.lo, s.hi FROM d2 d JOIN s1 s ON s.stream_id = d.stream_id AND s.i = d.seg_c_end WHERE s.lo < s.hi
    ),
    between AS MATERIALIZED (
      SELECT a.stream_id, a.top, a.idx, a.text || coalesce(';' || arg_max('2:' || d.kind || ':' || d.direction || ':' || d.seg_c_start || '-' || d.seg_c_end, d.idx) FILTER (s.i IS NOT NULL), '') AS text,
        coalesce(arg_max(s.lo, d.idx) FILTER (s.i IS NOT NULL), a.lo) AS lo, coalesce(arg_max(s.hi, d.idx) FILTER (s.i IS NOT NULL), a.hi) AS hi
      FROM said a LEFT JOIN d2 d ON a.top = 3 AND d.stream_id = a.stream_id LEFT JOIN s1 s ON s.stream_id = d.stream_id AND s.i = d.seg_c_end AND s.lo >= a.lo AND s.hi <= a.hi GROUP BY a.stream_id, a.top, a.idx, a.text, a.lo, a.hi
    ),
    lowest AS (
      SELECT b.stream_id, b.top, b.idx, arg_max(d.idx, d.idx) AS d FROM between b JOIN d1 d ON d.stream_id = b.stream_id JOIN b1 m ON m.stream_id = d.stream_id AND m.idx = d.m AND m.there AND m.lo >= b.lo AND m.hi <= b.hi WHERE b.lo <= b.hi GROUP BY 1, 2, 3
    )
    SELECT b.stream_id, CAST(b.top AS INTEGER) AS level, row_number() OVER (PARTITION BY b.stream_id ORDER BY b.top DESC, b.idx) - 1 AS idx,
      b.text || coalesce(';1:' || d.kind || ':' || d.direction || ':' || d.seg_c_start || '-' || d.seg_c_end, '') AS chain, coalesce(a.i0, b.lo) AS bar_start, coalesce(z.i1, b.hi) AS bar_end
    FROM between b LEFT JOIN lowest l ON l.stream_id = b.stream_id AND l.top = b.top AND l.idx = b.idx LEFT JOIN d1 d ON d.stream_id = l.stream_id AND d.idx = l.d
    LEFT JOIN q1 a ON a.stream_id = d.stream_id AND a.i = d.seg_c_start LEFT JOIN q1 z ON z.stream_id = d.stream_id AND z.i = d.seg_c_end"""

#: Unsettled trends without a divergence of their own, whose last leg holds the end of one of the older chain.
TURNS = """SELECT stream_id, CAST(1 AS INTEGER) AS level, row_number() OVER (PARTITION BY stream_id ORDER BY m) - 1 AS idx, CAST(1 AS INTEGER) AS level_id, CASE direction WHEN 'up' THEN 'sell' ELSE 'buy' END AS side, seg_start AS move_seg_start, direction AS move_direction, a AS c_start, b AS c_end, sub_c_end FROM (
      SELECT m.stream_id, m.idx AS m, m.direction, m.seg_start, m.a, m.seg_end AS b, arg_min(e.seg_c_end, e.idx) AS sub_c_end
      FROM (SELECT x.*, (SELECT max(c.seg_end) + 1 FROM c1 c WHERE c.stream_id = x.stream_id AND c.settled AND c.idx BETWEEN x.zs_start AND x.zs_end) AS a FROM m1 x WHERE x.kind = 'trend' AND x.zs_count > 1 AND NOT x.settled) m
      JOIN q1 f ON f.stream_id = m.stream_id AND f.i = m.a JOIN q1 l ON l.stream_id = m.stream_id AND l.i = m.seg_end AND m.a <= m.seg_end
      JOIN e1 e ON e.stream_id = m.stream_id JOIN q1 s ON s.stream_id = e.stream_id AND s.i = e.seg_c_end AND s.i1 BETWEEN f.i0 AND l.i1
      WHERE NOT EXISTS (SELECT 1 FROM d1 d WHERE d.stream_id = m.stream_id AND d.seg_c_start >= m.seg_start AND d.seg_c_end <= m.seg_end) GROUP BY ALL)"""

#: (layer, level, its table) of what is counted.
LAYERS = [("fractals", 0, "fractals"), ("strokes", 0, "strokes"), ("segments", 0, "segments")]
LAYERS += [(layer, k, f"{letter}{k}") for layer, letter, top in (("zhongshus", "c", LEVELS), ("moves", "m", LEVELS), ("centers", "v", UNROLLED), ("trends", "t", UNROLLED)) for k in range(1, top + 1)]
