"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from barloom.llm import mixing, secret_scan, syncmers

WORD = r"[^\x20\x09-\x0D]"


def op10() -> str:
    return rf"""WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS o FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
    w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[rank % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS full_ FROM s),
    a AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w),
    l AS (SELECT *, (total - coalesce(sum(full_) OVER f, 0)) / (all_weight - coalesce(sum(weight) OVER f, 0)) AS level FROM a WINDOW f AS (ORDER BY full_ / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, rank, coalesce(least(full_, weight * (SELECT level FROM l WHERE level * weight <= full_ ORDER BY full_ / weight, rank LIMIT 1)), full_) AS target FROM l),
    p AS (SELECT d.doc_id, d.size, t.source_size, t.target, ([0.5, 0.0, -0.5]::DOUBLE[])[t.rank % 3 + 1] AS ramp, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS at_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, greatest(0, least(size, quota - at_)) AS p0, greatest(0, least(size, quota - at_ - source_size)) AS p1 FROM p),
    q AS (SELECT *, least((at_ + p0 / 2) / target, 1.0::DOUBLE) AS d0, least((at_ + source_size + p1 / 2) / target, 1.0::DOUBLE) AS d1 FROM c)
    SELECT doc_id, size, source_size, target, p0 + p1 AS taken,
      CASE WHEN p0 > 0 THEN CASE WHEN ramp = 0 THEN d0 ELSE (sqrt(greatest((1 - ramp) * (1 - ramp) + 4 * ramp * d0, 0)) - (1 - ramp)) / (2 * ramp) END END AS position,
      CASE WHEN p1 > 0 THEN CASE WHEN ramp = 0 THEN d1 ELSE (sqrt(greatest((1 - ramp) * (1 - ramp) + 4 * ramp * d1, 0)) - (1 - ramp)) / (2 * ramp) END END AS position_2 FROM q"""


def _tokens(text: str) -> str:
    runs = f"regexp_extract_all(lower({text}), '{WORD}+')"
    return f"flatten(list_transform({runs}, lambda w: CASE WHEN length(w) <= {syncmers.LONG} THEN [w] ELSE regexp_extract_all(w, '(?s).') END))"


def _runs(t: str) -> str:
    return f"list_transform(generate_series(1, len({t}) - 2), lambda i: md5({t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]))"


def _sketch(t: str, r: str) -> str:
    h = syncmers.HALF
    found = f"list_transform(list_filter(generate_series(1, len({r}) - 3), lambda i: least({r}[i], {r}[i + 3]) <= least({r}[i + 1], {r}[i + 2])), lambda i: substr({r}[i], 1, {h}) || substr({r}[i + 3], 1, {h}))"
    few = f"CASE WHEN len({t}) > 0 THEN [substr(md5(array_to_string({t}, ' ')), 1, {2 * h})] ELSE CAST([] AS VARCHAR[]) END"
    return f"list_sort(list_distinct(CASE WHEN len({t}) >= {syncmers.K} THEN {found} ELSE {few} END))[1:{syncmers.SKETCH}]"


def _likeness(a: str, b: str) -> str:
    union = f"list_sort(list_distinct(list_concat({a}, {b})))[1:{syncmers.SKETCH}]"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({union}, lambda x: list_contains({a}, x) AND list_contains({b}, x)))::DOUBLE / len({union}) END"


def op1() -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM n),
    t AS (SELECT *, {_tokens('text')} AS t, {_tokens('edited')} AS te, {_tokens('next_text')} AS tn FROM e),
    r AS (SELECT *, {_runs('t')} AS r, {_runs('te')} AS re, {_runs('tn')} AS rn FROM t),
    k AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_sketch('t', 'r')} AS a, {_sketch('te', 're')} AS b, {_sketch('tn', 'rn')} AS c FROM r)
    SELECT doc_id, n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint, {_likeness('a', 'b')} AS near_edited, {_likeness('a', 'c')} AS near_next FROM k"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def op2() -> str:
    """Positions are running lengths of what lies between matches and of the matches themselves."""
    keys = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {r.kind: r.pattern for r in secret_scan.RULES}
    patterns["assign"] = rf"""(?:{keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    lists = []
    for number, rule in enumerate(secret_scan.RULES):
        pattern = ("(?s)(.*?)(" + patterns[rule.kind] + ")").replace("'", "''")
        part = lambda g: f"regexp_extract_all(text, '{pattern}', {g})"  # noqa: B023, E731
        value = part(3) if rule.kind == "assign" else part(2)
        lists.append(f"SELECT doc_id, row_, {number} AS k, '{rule.kind}' AS kind, {rule.least} AS least_, unnest({part(1)}) AS gap, unnest({part(2)}) AS hit, unnest({value}) AS value, unnest(generate_series(1, len({part(1)}))) AS j FROM d")
    every = " UNION ALL ".join(lists)
    joined = "coalesce(string_agg(kind || ':' || start_ || ':' || stop_, ',' ORDER BY start_, k) {f}, '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_ FROM documents),
    m AS MATERIALIZED (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row_, k ORDER BY j) AS BIGINT) AS stop_ FROM ({every})),
    s AS (SELECT row_, k, kind, stop_ - length(hit) AS start_, stop_ FROM m WHERE length(value) >= least_),
    g AS (SELECT row_, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {joined.format(f='FILTER (k < 3)')} AS base, {joined.format(f='')} AS spans FROM s GROUP BY row_)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row_)"""


def oracle_sql() -> dict[str, str]:
    assert mixing.WORD == WORD + "+"
    return {"op1_syncmer_fingerprints": op1(), "op2_secret_scan": op2(), "op10_curriculum_mix": op10()}
