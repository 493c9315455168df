"""SQL twins of the registered queries, for a plain engine that reads the same tables."""

from __future__ import annotations

W = 5_400_000
D = 86_400_000

#: Bars of a width from events, on a grid of whole days.
_BARS = """
{p}found AS (
  SELECT event_type AS series, ((epoch_us(ts) // 1000) // {w}) * {w} AS t0, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l,
         arg_max(value, ts) AS c, count(*) AS ticks FROM events GROUP BY 1, 2),
{p}span AS (SELECT event_type AS series, (min((epoch_us(ts) // 1000)) // {d}) * {d} AS lo, (max((epoch_us(ts) // 1000)) // {d}) * {d} + {d} AS hi FROM events GROUP BY 1),
{p}grid AS (SELECT series, unnest(generate_series(lo, hi - {w}, {w})) AS t0 FROM {p}span),
{p}bars AS (
  SELECT g.series, g.t0, g.t0 + {w} AS t1, CASE WHEN f.ticks >= 1 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status,
         coalesce(f.ticks, 0) AS ticks, f.o, f.h, f.l, f.c, CAST(f.ticks AS DOUBLE) AS v
  FROM {p}grid g LEFT JOIN {p}found f ON g.series = f.series AND g.t0 = f.t0),
{p}opened AS (
  SELECT *, CASE WHEN status = 'COMPLETE' AND coalesce(lag(status) OVER (PARTITION BY series ORDER BY t0), 'INCOMPLETE') <> 'COMPLETE' THEN 1 ELSE 0 END AS op
  FROM {p}bars),
{p}numbered AS (SELECT * EXCLUDE (op), CASE WHEN status = 'COMPLETE' THEN sum(op) OVER (PARTITION BY series ORDER BY t0) END AS segment FROM {p}opened),
{p}seg AS (SELECT *, CASE WHEN status = 'COMPLETE' THEN row_number() OVER (PARTITION BY series, segment ORDER BY t0) END AS pos FROM {p}numbered)
"""

_VOL = """
tr0 AS (SELECT *, lag(c) OVER s AS pc FROM seg WINDOW s AS (PARTITION BY series, segment ORDER BY t0)),
tr1 AS (SELECT *, CASE WHEN status = 'COMPLETE' AND pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr FROM tr0),
vol AS (
  SELECT *, CASE WHEN pos >= 21 THEN avg(tr) OVER (PARTITION BY series, segment ORDER BY t0 ROWS 19 PRECEDING) END AS a,
    CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN pos < 2 THEN 'INSUFFICIENT_HISTORY' END AS tr_r,
    CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN pos < 21 THEN 'INSUFFICIENT_HISTORY' END AS a_r
  FROM tr1)
"""

_OVER = """CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN pos < {n} THEN 'INSUFFICIENT_HISTORY' WHEN a IS NULL THEN a_r
      WHEN a = 0 THEN 'ZERO_DENOMINATOR' END AS {name}_r"""

_AVG = f"""
m0 AS (
  SELECT *, CASE WHEN pos >= 20 THEN avg(c) OVER (PARTITION BY series, segment ORDER BY t0 ROWS 19 PRECEDING) END AS sma_fast,
    CASE WHEN pos >= 50 THEN avg(c) OVER (PARTITION BY series, segment ORDER BY t0 ROWS 49 PRECEDING) END AS sma_slow FROM vol),
m1 AS (
  SELECT *, lag(sma_fast, 4) OVER (PARTITION BY series, segment ORDER BY t0) AS fast4,
    CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN pos < 20 THEN 'INSUFFICIENT_HISTORY' END AS sma_fast_r,
    CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN pos < 50 THEN 'INSUFFICIENT_HISTORY' END AS sma_slow_r,
    {_OVER.format(n=50, name="dist")}, {_OVER.format(n=24, name="slope")}, {_OVER.format(n=21, name="place")} FROM m0),
m2 AS (
  SELECT *, CASE WHEN dist_r IS NULL THEN (sma_fast - sma_slow) / a END AS dist, CASE WHEN slope_r IS NULL THEN (sma_fast - fast4) / a END AS slope,
    CASE WHEN place_r IS NULL THEN (c - sma_fast) / a END AS place FROM m1),
m3 AS (SELECT *, lag(dist) OVER s AS pd, lag(dist_r) OVER s AS pdr FROM m2 WINDOW s AS (PARTITION BY series, segment ORDER BY t0)),
m4 AS (
  SELECT *, CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN pos < 51 THEN 'INSUFFICIENT_HISTORY'
    WHEN dist IS NULL OR pd IS NULL THEN coalesce(dist_r, pdr, 'INSUFFICIENT_HISTORY') END AS cross_r FROM m3),
m5 AS (SELECT *, CASE WHEN cross_r IS NULL THEN CASE WHEN pd <= 0 AND dist > 0 THEN 'UP' WHEN pd >= 0 AND dist < 0 THEN 'DOWN' ELSE 'NONE' END END AS "cross" FROM m4),
avgs AS (
  SELECT * EXCLUDE (vm), CASE WHEN pos >= 21 THEN vm END AS v_median,
    CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN pos < 21 THEN 'INSUFFICIENT_HISTORY' WHEN vm = 0 THEN 'ZERO_DENOMINATOR' END AS v_ratio_r,
    CASE WHEN pos >= 21 AND vm <> 0 THEN v / vm END AS v_ratio
  FROM (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY series, segment ORDER BY t0 ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vm FROM m5))
"""

#: Pivots of {src} into {p}piv, structure into {p}st.
_PIV = """
{p}k0 AS (
  SELECT *, lag(h, 2) OVER s AS ch, lag(l, 2) OVER s AS cl, lag(t0, 2) OVER s AS x0, lag(t1, 2) OVER s AS x1,
    greatest(lag(h, 4) OVER s, lag(h, 3) OVER s, lag(h, 1) OVER s, h) AS oh, least(lag(l, 4) OVER s, lag(l, 3) OVER s, lag(l, 1) OVER s, l) AS ol
  FROM {src} WINDOW s AS (PARTITION BY series, segment ORDER BY t0)),
{p}k1 AS (
  SELECT *, CASE WHEN pos >= 5 THEN CASE WHEN ch > oh THEN 'PIVOT' WHEN ch = oh THEN 'TIE' ELSE 'NOT_EXTREME' END END AS hc,
    CASE WHEN pos >= 5 THEN CASE WHEN cl < ol THEN 'PIVOT' WHEN cl = ol THEN 'TIE' ELSE 'NOT_EXTREME' END END AS lc FROM {p}k0),
{p}k2 AS (SELECT *, coalesce(hc = 'PIVOT' AND lc = 'PIVOT', false) AS dual FROM {p}k1),
{p}piv AS (
  SELECT *, CASE WHEN dual THEN 'DUAL_AMBIGUOUS' ELSE hc END AS high_check, CASE WHEN dual THEN 'DUAL_AMBIGUOUS' ELSE lc END AS low_check,
    CASE WHEN pos >= 5 THEN x0 END AS candidate_t0, CASE WHEN pos >= 5 THEN x1 END AS candidate_t1,
    CASE WHEN dual THEN NULL WHEN hc = 'PIVOT' THEN 'HIGH' WHEN lc = 'PIVOT' THEN 'LOW' END AS pivot_kind,
    CASE WHEN dual THEN NULL WHEN hc = 'PIVOT' THEN ch WHEN lc = 'PIVOT' THEN cl END AS pivot_price FROM {p}k2),
{p}s0 AS (SELECT *, CASE WHEN pivot_kind = 'HIGH' THEN pivot_price END AS ph, CASE WHEN pivot_kind = 'LOW' THEN pivot_price END AS pl FROM {p}piv),
{p}s1 AS (
  SELECT *, CASE WHEN ph IS NOT NULL THEN last_value(ph IGNORE NULLS) OVER b END AS bh, CASE WHEN pl IS NOT NULL THEN last_value(pl IGNORE NULLS) OVER b END AS bl
  FROM {p}s0 WINDOW b AS (PARTITION BY series, segment ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}s2 AS (
  SELECT *, last_value(ph IGNORE NULLS) OVER s AS high_last, last_value(bh IGNORE NULLS) OVER s AS high_before,
    last_value(pl IGNORE NULLS) OVER s AS low_last, last_value(bl IGNORE NULLS) OVER s AS low_before
  FROM {p}s1 WINDOW s AS (PARTITION BY series, segment ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}st AS (
  SELECT *, CASE WHEN status = 'COMPLETE' AND high_before IS NOT NULL AND low_before IS NOT NULL THEN
      CASE WHEN high_last > high_before AND low_last > low_before THEN 'UP' WHEN high_last < high_before AND low_last < low_before THEN 'DOWN' ELSE 'MIXED' END END AS structure,
    CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN high_before IS NULL OR low_before IS NULL THEN 'NO_CONFIRMED_PIVOTS' END AS structure_r FROM {p}s2)
"""

_ALT = """
a0 AS (SELECT series, segment, t0, t1, pivot_kind AS kind, pivot_price AS price, candidate_t0 AS c0, candidate_t1 AS c1 FROM st WHERE pivot_kind IS NOT NULL),
a1 AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY series, segment ORDER BY t0) THEN 0 ELSE 1 END AS turn FROM a0),
a2 AS (SELECT *, sum(turn) OVER (PARTITION BY series, segment ORDER BY t0) AS island FROM a1),
a3 AS (
  SELECT *, row_number() OVER i AS rn, max(price) OVER p AS mx, min(price) OVER p AS mn FROM a2
  WINDOW i AS (PARTITION BY series, segment, island ORDER BY t0), p AS (PARTITION BY series, segment, island ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a4 AS (SELECT *, CASE WHEN rn = 1 THEN 'APPEND' WHEN (kind = 'HIGH' AND price > mx) OR (kind = 'LOW' AND price < mn) THEN 'REPLACE' ELSE 'KEEP' END AS action FROM a3),
a5 AS (
  SELECT *, last_value(CASE WHEN action <> 'KEEP' THEN price END IGNORE NULLS) OVER i AS p1_price, last_value(CASE WHEN action <> 'KEEP' THEN c0 END IGNORE NULLS) OVER i AS p1_t0,
    sum(CASE WHEN action <> 'KEEP' THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t0) AS version
  FROM a4 WINDOW i AS (PARTITION BY series, segment, island ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a6 AS (SELECT *, lag(p1_price) OVER s AS bp, lag(p1_t0) OVER s AS bt FROM a5 WINDOW s AS (PARTITION BY series, segment ORDER BY t0)),
alt AS (SELECT *, first_value(bp) OVER i AS p0_price, first_value(bt) OVER i AS p0_t0 FROM a6 WINDOW i AS (PARTITION BY series, segment, island ORDER BY t0)),
f0 AS (
  SELECT o.*, x.version AS nv, x.p0_price AS np0, x.p1_price AS np1, x.kind AS nk FROM st o
  LEFT JOIN (SELECT * FROM alt WHERE action <> 'KEEP') x ON o.series = x.series AND o.t0 = x.t0),
f1 AS (
  SELECT * EXCLUDE (nv, np0, np1, nk), last_value(nk IGNORE NULLS) OVER s AS p1_kind, coalesce(last_value(nv IGNORE NULLS) OVER (PARTITION BY series ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS version,
    CASE WHEN status = 'COMPLETE' THEN last_value(np0 IGNORE NULLS) OVER s END AS p0, CASE WHEN status = 'COMPLETE' THEN last_value(np1 IGNORE NULLS) OVER s END AS p1
  FROM f0 WINDOW s AS (PARTITION BY series, segment ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
obs AS (
  SELECT *, CASE WHEN status <> 'COMPLETE' THEN 'INCOMPLETE_INPUT' WHEN p0 IS NULL THEN 'NO_CONFIRMED_PIVOTS' WHEN p1 = p0 THEN 'ANCHORS_EQUAL' END AS anchors_r,
    CASE WHEN p0 IS NOT NULL AND p1 <> p0 THEN (c - p0) / (p1 - p0) END AS u FROM f1)
"""

_LEV = """
dayb AS (SELECT series, t1 AS day_end, h AS day_high, l AS day_low, status AS day_status FROM d_bars),
lev AS (SELECT o.*, y.day_high, y.day_low, y.day_status FROM obs o LEFT JOIN dayb y ON o.series = y.series AND (o.t1 // 86400000) * 86400000 = y.day_end),
lv0 AS (SELECT *, lag(c) OVER s AS pc2, lag(high_last) OVER s AS g1, lag(low_last) OVER s AS g2, lag(day_high) OVER s AS g3, lag(day_low) OVER s AS g4
  FROM lev WINDOW s AS (PARTITION BY series, segment ORDER BY t0)),
lv1 AS (
  SELECT series, t1, c, pc2, k.kind, k.price FROM lv0, LATERAL (VALUES ('PIVOT_HIGH', g1), ('PIVOT_LOW', g2), ('DAY_HIGH', g3), ('DAY_LOW', g4)) k(kind, price)
  WHERE status = 'COMPLETE' AND pc2 IS NOT NULL),
crossings AS (SELECT *, CASE WHEN pc2 <= price AND price < c THEN 'UP' WHEN pc2 >= price AND price > c THEN 'DOWN' END AS direction FROM lv1)
"""

_FUT = """
g0 AS (
  SELECT *, count(*) FILTER (status = 'COMPLETE') OVER f AS valid, count(*) OVER f AS in_range, max(h) OVER f AS mh, min(l) OVER f AS ml,
    lead(c, 16) OVER (PARTITION BY series ORDER BY t0) AS ca, max(t1) OVER (PARTITION BY series) AS last_t1
  FROM obs WINDOW f AS (PARTITION BY series ORDER BY t0 ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING)),
g1 AS (SELECT *, t1 + 86400000 > last_t1 AS censored, valid < in_range AS gap FROM g0),
g2 AS (SELECT *, NOT censored AND NOT gap AS future_complete,
    CASE WHEN a IS NULL THEN coalesce(a_r, 'A_UNAVAILABLE') WHEN a <= 0 THEN 'A_NOT_POSITIVE' ELSE 'VALID' END AS a_status FROM g1),
fut AS (
  SELECT *, CASE WHEN future_complete THEN mh END AS max_high, CASE WHEN future_complete THEN ml END AS min_low, CASE WHEN future_complete THEN ca END AS close_after,
    CASE WHEN future_complete AND status = 'COMPLETE' AND a > 0 THEN (ca - c) / a END AS final,
    CASE WHEN future_complete AND status = 'COMPLETE' AND a > 0 THEN greatest(0, mh - c) / a END AS up,
    CASE WHEN future_complete AND status = 'COMPLETE' AND a > 0 THEN greatest(0, c - ml) / a END AS down,
    concat_ws('+', CASE WHEN censored THEN 'RIGHT_CENSORED' END, CASE WHEN gap THEN 'GAP' END) AS flags FROM g2)
"""

_VER = """
v0 AS (
  SELECT *, CASE WHEN kind = 'HIGH' THEN 1 ELSE -1 END AS d FROM alt WHERE action <> 'KEEP' AND p0_price IS NOT NULL),
v1 AS (SELECT *, d * (p1_price - p0_price) AS length FROM v0 WHERE d * (p1_price - p0_price) > 0),
sg AS (SELECT series, segment, max(t1) AS seg_last FROM obs WHERE status = 'COMPLETE' GROUP BY 1, 2),
sy AS (SELECT series, max(t1) AS study_end FROM obs GROUP BY 1),
v2 AS (
  SELECT v1.*, study_end, lead(v1.t1) OVER (PARTITION BY v1.series, d ORDER BY v1.t1) AS next_t1, CASE WHEN seg_last < study_end THEN seg_last + 5400000 END AS reset_at
  FROM v1 JOIN sg ON v1.series = sg.series AND v1.segment = sg.segment JOIN sy ON v1.series = sy.series),
ver AS (
  SELECT *, least(coalesce(next_t1, study_end), coalesce(reset_at, study_end), study_end) AS retired_at, t1 AS active_from,
    CASE WHEN d = 1 THEN 'LONG' ELSE 'SHORT' END || ':' || p0_t0 AS group_id FROM v2),
vers AS (
  SELECT *, group_id || ':' || p1_t0 || ':' || t1 AS version_id,
    CASE WHEN retired_at = reset_at THEN 'SEGMENT_RESET' WHEN retired_at = next_t1 THEN 'NEW_VERSION_SAME_DIRECTION' ELSE 'END_OF_STUDY' END AS retire_reason FROM ver)
"""

_ATT = """
b0 AS (SELECT *, lag(c) OVER s AS cb, lag(h) OVER s AS hp, lag(l) OVER s AS lp FROM obs WHERE status = 'COMPLETE' WINDOW s AS (PARTITION BY series, segment ORDER BY t0)),
b1 AS (
  SELECT *, sum(CASE WHEN c < cb THEN 1 ELSE 0 END) OVER s AS falls, sum(CASE WHEN c > cb THEN 1 ELSE 0 END) OVER s AS rises
  FROM b0 WINDOW s AS (PARTITION BY series, segment ORDER BY t0)),
t0s AS (
  SELECT v.series, v.segment, v.group_id, v.version_id, v.d, v.length, v.p1_price, v.p0_price, v.p1_t0, b.t0, b.t1, b.c, b.pos - x.pos AS bars_since_p1,
    CASE WHEN v.d = 1 THEN b.falls ELSE b.rises END AS n, CASE WHEN v.d = 1 THEN x.falls ELSE x.rises END AS n0
  FROM vers v JOIN b1 x ON x.series = v.series AND x.t0 = v.p1_t0
  JOIN b1 b ON b.series = v.series AND b.segment = v.segment AND b.t1 >= v.active_from AND b.t1 < v.retired_at AND b.pos > x.pos + 1
  WHERE CASE WHEN v.d = 1 THEN b.c > b.hp AND b.c > b.o ELSE b.c < b.lp AND b.c < b.o END),
t1s AS (SELECT * FROM t0s WHERE n > n0 QUALIFY row_number() OVER (PARTITION BY series, group_id, segment, n ORDER BY t1) = 1),
att AS (SELECT *, row_number() OVER (PARTITION BY series, group_id ORDER BY t1) AS ordinal, n - n0 AS counter_closes FROM t1s)
"""

_LEGS = """
l0 AS (
  SELECT x.*, o.a AS a0, o.structure AS st0, CASE WHEN x.kind = 'HIGH' THEN 1 ELSE -1 END AS d, (x.p1_t0 - x.p0_t0) // 5400000 AS leg_bars
  FROM alt x JOIN obs o ON o.series = x.series AND o.t0 = x.t0 WHERE x.action <> 'KEEP' AND x.p0_price IS NOT NULL),
l1 AS (SELECT *, d * (p1_price - p0_price) AS length, CASE WHEN d = 1 THEN 'LONG' ELSE 'SHORT' END || ':' || p0_t0 || ':' || p1_t0 || ':' || t1 AS leg_id FROM l0),
legs AS (
  SELECT *, CASE WHEN coalesce(st0, '') <> CASE WHEN d = 1 THEN 'UP' ELSE 'DOWN' END THEN 'ABSTAIN_STRUCTURE' WHEN leg_bars NOT BETWEEN 1 AND 32 THEN 'ABSTAIN_DURATION'
    WHEN NOT coalesce(a0 > 0, false) THEN 'ABSTAIN_VOLATILITY_UNAVAILABLE' WHEN NOT length >= 0.2 * a0 THEN 'ABSTAIN_AMPLITUDE' END AS against FROM l1),
w0 AS (
  SELECT g.series, g.leg_id, g.d, g.length, g.a0, g.p0_price, g.p1_price, g.t1 AS leg_t1, g.segment AS leg_segment, (b.t0 - g.p1_t0) // 5400000 AS since, b.t0, b.t1, b.status, b.segment, b.o, b.h, b.l, b.c, b.structure
  FROM legs g JOIN obs b ON b.series = g.series AND b.t0 BETWEEN g.p1_t0 AND g.p1_t0 + 13 * 5400000 WHERE against IS NULL),
w1 AS (SELECT *, CASE WHEN since > 0 AND d * (c - lag(c) OVER s) < 0 THEN 1 ELSE 0 END AS ag, lag(h) OVER s AS hp, lag(l) OVER s AS lp,
    CASE WHEN since > 0 THEN l END AS l1, CASE WHEN since > 0 THEN h END AS h1 FROM w0 WINDOW s AS (PARTITION BY series, leg_id ORDER BY t0)),
w2 AS (SELECT *, sum(ag) OVER s AS counter, CASE WHEN d = 1 THEN min(l1) OVER s ELSE max(h1) OVER s END AS extreme,
    CASE WHEN d = 1 THEN max(h1) OVER s >= p1_price ELSE min(l1) OVER s <= p1_price END AS reached FROM w1 WINDOW s AS (PARTITION BY series, leg_id ORDER BY t0)),
w3 AS (SELECT *, d * (p1_price - extreme) / length AS depth FROM w2 WHERE t1 >= leg_t1),
w4 AS (
  SELECT *, CASE WHEN status <> 'COMPLETE' OR segment IS DISTINCT FROM leg_segment THEN 'INVALIDATED_DATA' WHEN structure = CASE WHEN d = 1 THEN 'DOWN' ELSE 'UP' END THEN 'INVALIDATED_STRUCTURE'
    WHEN depth > 1.4 OR d * (c - p0_price) <= 0 THEN 'INVALIDATED_DEPTH' WHEN reached THEN 'INVALIDATED_TARGET_REACHED' WHEN since > 12 THEN 'EXPIRED'
    WHEN depth < 0.1 OR counter < 1 OR NOT (t1 > leg_t1 AND CASE WHEN d = 1 THEN c > hp AND c > o ELSE c < lp AND c < o END) THEN 'WAIT' ELSE 'CALL' END AS state FROM w3),
w5 AS (SELECT * FROM w4 WHERE state <> 'WAIT' QUALIFY row_number() OVER (PARTITION BY series, leg_id ORDER BY t1) = 1),
w6 AS (
  SELECT g.series, g.leg_id, g.t1 AS leg_t1, g.d, g.leg_bars, g.against, g.a0, g.p1_price, e.t1 AS ended_at, e.counter, e.depth, e.state,
    e.extreme - g.d * CAST(0.1 AS DOUBLE) * g.a0 AS sp, e.c * (1 + g.d * CAST(0.0003 AS DOUBLE)) AS es FROM legs g LEFT JOIN w5 e ON e.series = g.series AND e.leg_id = g.leg_id),
w7 AS (SELECT *, d * (es - sp) AS rk, d * (p1_price - es) AS gn FROM w6),
dec AS (
  SELECT *, CASE WHEN against IS NOT NULL THEN against WHEN state IS NULL THEN 'OPEN_AT_END'
    WHEN state = 'CALL' AND NOT coalesce(sp > 0 AND rk > 0 AND gn > 0 AND gn / rk >= 0.05, false) THEN 'ABSTAIN_REWARD_RISK' ELSE state END AS outcome FROM w7)
"""

_ENTRY = """
n0 AS (
  SELECT x.*, b.status, b.o AS ref, z.last_t0, b.o * (1 + x.d * CAST(0.0003 AS DOUBLE)) AS entry FROM dec x LEFT JOIN obs b ON b.series = x.series AND b.t0 = x.ended_at
  JOIN (SELECT series, max(t0) AS last_t0 FROM obs GROUP BY 1) z ON z.series = x.series WHERE x.outcome = 'CALL'),
ent AS (
  SELECT *, d * (entry - sp) AS risk0, 1000.0 / entry AS qty, CASE WHEN ended_at >= last_t0 THEN 'CANCELLED_END_OF_WINDOW' WHEN coalesce(status, '') <> 'COMPLETE' THEN 'CANCELLED_NO_QUOTE'
    WHEN d * (entry - sp) > 0 AND d * (p1_price - entry) > 0 AND (p1_price - entry) / (entry - sp) >= 0.05 THEN 'FILLED' ELSE 'REJECTED_PRICE' END AS entry_outcome FROM n0)
"""

_EXIT = """
e0 AS (
  SELECT x.series, x.leg_id, x.d, x.sp, x.p1_price AS tgt, x.a0, x.ended_at, x.last_t0, (b.t0 - x.ended_at) // 5400000 AS held, b.t0, b.t1, b.status, b.o, b.h, b.l, b.c,
    coalesce(b.structure = CASE WHEN x.d = 1 THEN 'DOWN' ELSE 'UP' END, false) AS opp, b.pivot_kind, b.pivot_price - x.d * CAST(0.1 AS DOUBLE) * x.a0 AS pr, b.candidate_t0
  FROM ent x JOIN obs b ON b.series = x.series AND b.t0 BETWEEN x.ended_at AND x.ended_at + 16 * 5400000 WHERE x.entry_outcome = 'FILLED'),
e1 AS (
  SELECT *, CASE WHEN pivot_kind = CASE WHEN d = 1 THEN 'LOW' ELSE 'HIGH' END AND candidate_t0 >= ended_at AND d * (c - pr) > 0 AND d * (tgt - pr) > 0 AND pr > 0 AND NOT opp THEN pr END AS prop FROM e0),
e2 AS (
  SELECT *, CASE WHEN d = 1 THEN greatest(sp, coalesce(max(prop) OVER a, sp)) ELSE least(sp, coalesce(min(prop) OVER a, sp)) END AS s2,
    CASE WHEN d = 1 THEN greatest(sp, coalesce(max(prop) OVER b, sp)) ELSE least(sp, coalesce(min(prop) OVER b, sp)) END AS s1, coalesce(lag(opp) OVER w, false) AS due
  FROM e1 WINDOW w AS (PARTITION BY series, leg_id ORDER BY t0), a AS (PARTITION BY series, leg_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING),
    b AS (PARTITION BY series, leg_id ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e3 AS (SELECT *, d * (CASE WHEN d = 1 THEN l ELSE h END - s1) <= 0 AS sh, d * (CASE WHEN d = 1 THEN h ELSE l END - tgt) >= 0 AS th FROM e2),
e4 AS (
  SELECT *, CASE WHEN held > 0 AND status <> 'COMPLETE' THEN 'UNRESOLVED_DATA_GAP' WHEN held > 0 AND d * (o - s2) <= 0 THEN 'STOP' WHEN held > 0 AND d * (o - tgt) >= 0 THEN 'TARGET'
      WHEN held > 0 AND due THEN 'EXIT_STRUCTURE' WHEN held >= 16 THEN 'TIME_EXIT' WHEN held > 0 AND t0 >= last_t0 THEN 'END_OF_SEGMENT' WHEN held > 0 AND d * (o - s1) <= 0 THEN 'STOP' END AS atopen FROM e3),
e5 AS (SELECT *, coalesce(atopen, CASE WHEN sh THEN 'STOP' WHEN th THEN 'TARGET' END) AS reason FROM e4),
e6 AS (SELECT * FROM e5 WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series, leg_id ORDER BY t0) = 1),
e7 AS (
  SELECT x.series, x.leg_id, x.d, x.qty, x.entry, x.ref, x.risk0, x.p1_price AS tgt, x.ended_at AS entry_at, y.reason, y.s1 AS final_stop, CASE WHEN y.atopen IS NULL THEN y.t1 ELSE y.t0 END AS exit_at,
    CASE WHEN y.reason = 'UNRESOLVED_DATA_GAP' THEN NULL WHEN y.atopen IS NOT NULL THEN y.o WHEN y.sh THEN y.s1 ELSE y.tgt END AS xr, CASE WHEN y.reason IS NOT NULL THEN coalesce(y.atopen IS NULL AND y.sh AND y.th, false) END AS "both"
  FROM ent x LEFT JOIN e6 y ON y.series = x.series AND y.leg_id = x.leg_id WHERE x.entry_outcome = 'FILLED'),
e8 AS (SELECT *, xr * (1 - d * CAST(0.0003 AS DOUBLE)) AS "exit", tgt * (1 - d * CAST(0.0003 AS DOUBLE)) AS xt, xr * (1 - d * CAST(0.001 AS DOUBLE)) AS xs, ref * (1 + d * CAST(0.001 AS DOUBLE)) AS es FROM e7),
trd AS (
  SELECT *, d * qty * ("exit" - entry) AS price_pnl, CAST(0.0005 AS DOUBLE) * qty * (entry + "exit") AS fees, d * qty * ("exit" - entry) - CAST(0.0005 AS DOUBLE) * qty * (entry + "exit") AS net,
    CASE WHEN "both" THEN d * qty * (xt - entry) - CAST(0.0005 AS DOUBLE) * qty * (entry + xt) END AS net_target_first, d * qty * (xs - es) - CAST(0.001 AS DOUBLE) * qty * (es + xs) AS stress_net FROM e8)
"""

#: Movements: candidates, what would befall each, who follows whom, and the log.
_LIFE = """
lq0 AS (SELECT *, lag(p0_price) OVER (PARTITION BY series, segment ORDER BY t0) AS before_q FROM alt),
lq AS (SELECT *, first_value(before_q) OVER (PARTITION BY series, segment, island ORDER BY t0) AS q FROM lq0),
tri AS (
  SELECT series, segment, version, CASE WHEN kind = 'LOW' THEN 1 ELSE -1 END AS d, price AS base, c0 AS base_t0, p0_price AS extreme, p0_t0 AS extreme_t0
  FROM lq WHERE action <> 'KEEP' AND q IS NOT NULL),
cb AS (SELECT series, segment, version, pos, t0, t1, h, l, c, structure, after, lag(c) OVER w AS pc, lag(structure) OVER w AS was, pos = max(pos) OVER (PARTITION BY series, segment) AS last
  FROM (SELECT *, lead(t1) OVER (PARTITION BY series ORDER BY t0) AS after FROM obs) WHERE status = 'COMPLETE' WINDOW w AS (PARTITION BY series, segment ORDER BY t0)),
live AS (
  SELECT b.*, t.d, t.base, t.base_t0, t.extreme, t.extreme_t0, (t.d * (pc - extreme) <= 0 AND t.d * (c - extreme) > 0) AS crossed, t.d * (CASE WHEN t.d = 1 THEN l ELSE h END - base) <= 0 AS tested
  FROM cb b JOIN (SELECT tri.* FROM tri JOIN lq ON lq.series = tri.series AND lq.version = tri.version AND lq.action <> 'KEEP' WHERE tri.d * (tri.base - lq.q) > 0 AND tri.d * (tri.extreme - tri.base) > 0) t
  ON t.series = b.series AND t.segment = b.segment AND t.version = b.version),
cd0 AS (
  SELECT series, segment, version, d, base, base_t0, extreme, extreme_t0, min(pos) FILTER (crossed) AS k, min(t0) FILTER (crossed) AS k_t0, min(t1) FILTER (crossed) AS k_t1, min(pos) FILTER (tested) AS broken
  FROM live GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY series, segment ORDER BY k) AS idx, CASE WHEN d = 1 THEN 'LONG' ELSE 'SHORT' END AS side,
    CASE WHEN d = 1 THEN 'LONG' ELSE 'SHORT' END || ':' || extreme_t0 || ':' || base_t0 || ':' || k_t1 AS ref_id
  FROM cd0 WHERE k IS NOT NULL AND (broken IS NULL OR broken > k)),
lf0 AS (
  SELECT x.series, x.segment, x.idx, min(b.pos) FILTER (b.pos > k AND x.d * (b.c - base) <= 0) AS lost, min(b.pos) FILTER (b.pos > k AND x.d * (CASE WHEN x.d = 1 THEN b.l ELSE b.h END - base) <= 0) AS tested,
    min(b.pos) FILTER (b.structure = CASE WHEN x.d = 1 THEN 'DOWN' ELSE 'UP' END) AS opposite
  FROM cand x JOIN cb b ON b.series = x.series AND b.segment = x.segment AND b.pos >= x.k GROUP BY 1, 2, 3),
pv AS (SELECT a.series, a.segment, a.kind, a.price, a.c0, b.pos FROM alt a JOIN cb b ON b.series = a.series AND b.t0 = a.t0 WHERE a.action <> 'KEEP'),
lf1 AS (
  SELECT x.*, l.lost, l.tested, l.opposite, p.known, p.anchor FROM cand x JOIN lf0 l USING (series, segment, idx) LEFT JOIN (
    SELECT x.series, x.segment, x.idx, min(p.pos) AS known, arg_min(p.price, p.pos) AS anchor FROM cand x JOIN pv p ON p.series = x.series AND p.segment = x.segment
      AND p.kind = CASE WHEN x.d = 1 THEN 'HIGH' ELSE 'LOW' END AND p.c0 >= x.k_t0 AND x.d * (p.price - x.extreme) > 0 GROUP BY 1, 2, 3) p USING (series, segment, idx)),
lf2 AS (
  SELECT x.*, r.reached FROM lf1 x LEFT JOIN (
    SELECT x.series, x.segment, x.idx, min(b.pos) AS reached FROM lf1 x JOIN cb b ON b.series = x.series AND b.segment = x.segment AND b.pos > x.known AND x.d * (CASE WHEN x.d = 1 THEN b.h ELSE b.l END - anchor) >= 0 GROUP BY 1, 2, 3) r USING (series, segment, idx)),
lf3 AS (
  SELECT *, coalesce(reached < coalesce(tested, 1e18) AND reached <= coalesce(opposite, 1e18) AND coalesce(opposite, 1e18) > k, false) AS completed FROM lf2),
lf AS (
  SELECT *, CASE WHEN completed THEN reached ELSE lost END AS over_at,
    CASE WHEN NOT completed AND least(coalesce(tested, 1e18), coalesce(opposite, 1e18)) < coalesce(lost, 1e18) THEN least(tested, opposite) END AS suspended FROM lf3),
lft AS (SELECT f.*, o.t0 AS over_t0, s.t0 AS suspended_t0 FROM lf f LEFT JOIN cb o ON o.series = f.series AND o.segment = f.segment AND o.pos = f.over_at LEFT JOIN cb s ON s.series = f.series AND s.segment = f.segment AND s.pos = f.suspended),
nx AS (
  SELECT i.series, i.segment, i.idx, min(j.idx) AS next_idx FROM lft i JOIN lft j ON j.series = i.series AND j.segment = i.segment AND (
    (j.k >= i.over_at AND j.base_t0 > CASE WHEN i.completed THEN i.base_t0 ELSE i.over_t0 END) OR (j.k >= i.suspended AND (i.over_at IS NULL OR j.k < i.over_at) AND j.base_t0 > i.suspended_t0)) GROUP BY 1, 2, 3),
took AS (SELECT series, segment, CAST(1 AS BIGINT) AS idx FROM cand WHERE idx = 1 UNION ALL SELECT t.series, t.segment, CAST(n.next_idx AS BIGINT) FROM took t JOIN nx n ON n.series = t.series AND n.segment = t.segment AND n.idx = t.idx),
mv0 AS (SELECT f.*, lead(f.k) OVER (PARTITION BY f.series, f.segment ORDER BY f.k) AS next_k FROM lft f JOIN took t ON t.series = f.series AND t.segment = f.segment AND t.idx = f.idx),
mv AS (SELECT *, CASE WHEN over_at IS NULL OR next_k < over_at THEN next_k END AS replaced FROM mv0),
held AS (SELECT b.*, m.* EXCLUDE (series, segment, version) FROM cb b JOIN mv m ON m.series = b.series AND m.segment = b.segment AND b.pos > m.k AND b.pos <= coalesce(m.replaced, m.over_at, b.pos)),
hf AS (
  SELECT *, coalesce(pos = over_at AND NOT completed, false) AS is_lost, coalesce(pos = over_at AND completed, false) AS is_done, d * (CASE WHEN d = 1 THEN l ELSE h END - base) <= 0 AS low_test,
    coalesce(known < pos AND d * (CASE WHEN d = 1 THEN h ELSE l END - anchor) >= 0, false) AS touch, coalesce(structure = CASE WHEN d = 1 THEN 'DOWN' ELSE 'UP' END, false) AS opp, coalesce(was = CASE WHEN d = 1 THEN 'DOWN' ELSE 'UP' END, false) AS opp_before,
    coalesce(suspended = pos, false) AS now_held, coalesce(suspended < pos, false) AS was_held, coalesce(known <= pos, false) AS kn FROM held),
fact AS (
  SELECT *, 1 AS seq, 'P1_PUBLISHED' AS type, '' AS reason, was_held AS hold FROM hf WHERE known = pos
  UNION ALL SELECT *, 2, 'ARCHIVE', 'BASE_LOST', was_held FROM hf WHERE is_lost
  UNION ALL SELECT *, 3, CASE WHEN now_held THEN 'SUSPENSION' ELSE 'FACT' END, 'BASE_TESTED', true FROM hf WHERE low_test AND NOT is_lost
  UNION ALL SELECT *, 4, 'ARCHIVE', 'EXTREME_REACHED', was_held FROM hf WHERE is_done
  UNION ALL SELECT *, 4, 'FACT', 'P1_TOUCHED_WHILE_SUSPENDED', true FROM hf WHERE touch AND NOT low_test AND NOT is_done
  UNION ALL SELECT *, 5, CASE WHEN now_held AND NOT low_test THEN 'SUSPENSION' ELSE 'FACT' END, 'OPPOSITE_STRUCTURE', true FROM hf WHERE opp AND NOT is_lost AND NOT is_done AND ((now_held AND NOT low_test) OR NOT opp_before)
  UNION ALL SELECT *, 6, 'USABLE', '', false FROM hf WHERE known = pos AND NOT now_held AND NOT was_held AND NOT is_lost AND NOT is_done
  UNION ALL SELECT *, 7, 'ARCHIVE', 'REPLACED', true FROM hf WHERE replaced = pos),
stay AS (
  SELECT series, segment, pos, ref_id, side, base, extreme, CASE WHEN kn THEN anchor END AS anchor, base_t0, kn, now_held OR was_held AS hold, replaced = pos AS goes FROM hf WHERE NOT is_lost AND NOT is_done
  ),
now AS (
  SELECT series, segment, pos, ref_id, side, base, extreme, anchor, base_t0, kn, hold FROM stay WHERE goes IS NOT TRUE
  UNION ALL SELECT series, segment, k, ref_id, side, base, extreme, NULL, base_t0, false, coalesce(suspended = k, false) FROM mv),
cond AS (
  SELECT series, t1 AS t, seq, type, ref_id, side, reason, kn, hold, base, extreme, CASE WHEN kn THEN anchor END AS anchor, base_t0 FROM fact
  UNION ALL SELECT x.series, b.t1, 7, 'REJECTED', s.ref_id, s.side, CASE WHEN s.ref_id IS NULL OR s.hold THEN 'NOT_FRESH' WHEN s.kn THEN 'OCCUPIED_USABLE' ELSE 'OCCUPIED_FORMING' END, s.kn, s.hold, x.base, s.extreme, s.anchor, x.base_t0
    FROM cand x JOIN cb b ON b.series = x.series AND b.segment = x.segment AND b.pos = x.k LEFT JOIN stay s ON s.series = x.series AND s.segment = x.segment AND s.pos = x.k
    WHERE NOT EXISTS (SELECT 1 FROM took t WHERE t.series = x.series AND t.segment = x.segment AND t.idx = x.idx)
  UNION ALL SELECT series, k_t1, 8, 'BIRTH', ref_id, side, '', false, coalesce(suspended = k, false), base, extreme, NULL, base_t0 FROM mv
  UNION ALL SELECT series, k_t1, 9, 'SUSPENSION', ref_id, side, 'OPPOSITE_STRUCTURE_AT_BIRTH', false, true, base, extreme, NULL, base_t0 FROM mv WHERE suspended = k
  UNION ALL SELECT b.series, b.t1, 10, 'CLOSE', n.ref_id, n.side, '', n.kn, n.hold, n.base, n.extreme, n.anchor, n.base_t0 FROM cb b LEFT JOIN now n ON n.series = b.series AND n.segment = b.segment AND n.pos = b.pos
  UNION ALL SELECT b.series, coalesce(b.after, b.t1), 11, CASE WHEN b.after IS NULL THEN 'OPEN_AT_END' ELSE 'ARCHIVE' END, n.ref_id, n.side, CASE WHEN b.after IS NULL THEN '' ELSE 'CONTINUITY_INTERRUPTED' END, n.kn, n.hold, n.base, n.extreme, n.anchor, n.base_t0
    FROM cb b JOIN now n ON n.series = b.series AND n.segment = b.segment AND n.pos = b.pos WHERE b.last),
log AS (
  SELECT series, t, seq, type, ref_id, side, reason, CASE WHEN ref_id IS NULL THEN 'ABSENT' WHEN hold THEN CASE WHEN kn THEN 'SUSPENDED_WITH_P1' ELSE 'SUSPENDED_WITHOUT_P1' END WHEN kn THEN 'USABLE' ELSE 'FORMING' END AS condition,
    base, extreme, anchor, base_t0 FROM cond),
moved AS (
  SELECT series, ref_id, side, min(t) FILTER (type = 'BIRTH') AS born, min(t) FILTER (type = 'P1_PUBLISHED') AS known, min(t) FILTER (type = 'USABLE') AS usable, min(t) FILTER (type = 'SUSPENSION') AS suspended,
    min(t) FILTER (type = 'ARCHIVE') AS ended, max(reason) FILTER (type = 'ARCHIVE') AS reason, count(*) FILTER (type = 'CLOSE') AS closes FROM log WHERE ref_id IS NOT NULL GROUP BY 1, 2, 3)
"""

_BASE = _BARS.format(p="", w=W, d=D)
_DAYS = _BARS.format(p="d_", w=D, d=D)
_OBS = [_BASE, _VOL, _AVG, _PIV.format(p="", src="avgs"), _ALT]
_PROFILE = """CASE WHEN structure IS NULL OR dist IS NULL OR slope IS NULL THEN 'UNAVAILABLE'
  WHEN structure = CASE WHEN d = 1 THEN 'UP' ELSE 'DOWN' END AND d * dist > 0 AND d * slope > 0 THEN 'CONCORDANT'
  WHEN structure = CASE WHEN d = 1 THEN 'DOWN' ELSE 'UP' END AND d * dist < 0 AND d * slope < 0 THEN 'OPPOSITE' ELSE 'DISCORDANT' END"""


def _with(parts: list[str], select: str) -> str:
    """``select`` may begin with a comma and more common table expressions."""
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n" + select


def observed_sql(select: str) -> str:
    """``select`` over obs, the observations of all bars."""
    return _with(_OBS, select)


def decided_sql(parts: list[str], select: str) -> str:
    """``select`` over dec, the decisions on all legs, and what ``parts`` make of them."""
    return _with([*_OBS, _LEGS, *parts], select)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_RELATED = [
    *_OBS,
    _DAYS,
    _PIV.format(p="d_", src="d_seg"),
    """rel0 AS (SELECT o.*, coalesce(o.structure, 'UNAVAILABLE') AS s_bar, coalesce(y.structure, 'UNAVAILABLE') AS s_day
  FROM obs o LEFT JOIN d_st y ON o.series = y.series AND (o.t1 // 86400000) * 86400000 = y.t1),
rel AS (SELECT *, CASE WHEN s_bar NOT IN ('UP', 'DOWN') THEN 'NOT_APPLICABLE' WHEN s_day = s_bar THEN 'CONCORDANT' WHEN s_day IN ('UP', 'DOWN') THEN 'OPPOSITE' ELSE s_day END AS relation FROM rel0)""",
]

_MEASURES = ("tr", "a", "sma_fast", "sma_slow", "dist", "slope", "place", "cross", "v_ratio", "structure")

_TOUCH = """
h0 AS (SELECT series, t1, CASE WHEN structure = 'UP' THEN 1 ELSE -1 END AS d, c, a FROM obs WHERE structure IN ('UP', 'DOWN') AND a > 0),
h1 AS (SELECT *, c + d * a AS f, c - d * a AS g, unnest(generate_series(0, 15)) AS i FROM h0),
h2 AS (
  SELECT h1.*, b.status, b.o, b.h, b.l, b.c AS cl, min(CASE WHEN coalesce(b.status, '') <> 'COMPLETE' THEN i END) OVER (PARTITION BY h1.series, h1.t1) AS first_gap
  FROM h1 LEFT JOIN bars b ON b.series = h1.series AND b.t0 = h1.t1 + i * 5400000),
h3 AS (
  SELECT *, first_gap IS NULL OR i < first_gap AS known, CASE WHEN d = 1 THEN h >= f ELSE l <= f END AS hf, CASE WHEN d = 1 THEN l <= g ELSE h >= g END AS hg,
    CASE WHEN d = 1 THEN o >= f ELSE o <= f END AS opf, CASE WHEN d = 1 THEN o <= g ELSE o >= g END AS opg FROM h2),
h4 AS (
  SELECT series, t1, d, c, a, min(first_gap) AS first_gap, count(*) FILTER (known) AS bars, min(i) FILTER (known AND hf) AS f_bar, arg_min(opf, i) FILTER (known AND hf) AS f_open,
    min(i) FILTER (known AND hg) AS g_bar, arg_min(opg, i) FILTER (known AND hg) AS g_open, max(h) FILTER (known) AS max_high, min(l) FILTER (known) AS min_low, arg_max(cl, i) FILTER (known) AS last_c
  FROM h3 GROUP BY ALL),
h5 AS (
  SELECT h4.*, (SELECT min(x.i) FROM h3 x WHERE x.series = h4.series AND x.t1 = h4.t1 AND x.known AND x.h = h4.max_high) AS max_high_bar,
    (SELECT min(x.i) FROM h3 x WHERE x.series = h4.series AND x.t1 = h4.t1 AND x.known AND x.l = h4.min_low) AS min_low_bar FROM h4),
touch AS (
  SELECT *, CASE WHEN first_gap IS NULL THEN CASE WHEN f_bar IS NULL AND g_bar IS NULL THEN 'NEITHER' WHEN g_bar IS NULL THEN 'F_ONLY' WHEN f_bar IS NULL THEN 'A_ONLY'
      WHEN f_bar < g_bar THEN 'F_BEFORE_A' WHEN g_bar < f_bar THEN 'A_BEFORE_F' WHEN f_open THEN 'F_BEFORE_A' WHEN g_open THEN 'A_BEFORE_F' ELSE 'BOTH_UNORDERED' END END AS class,
    CASE WHEN bars > 0 THEN d * (last_c - c) / a END AS final,
    CASE WHEN bars > 0 THEN CASE WHEN d = 1 THEN greatest(0, max_high - c) ELSE greatest(0, c - min_low) END / a END AS favourable,
    CASE WHEN bars > 0 THEN CASE WHEN d = 1 THEN greatest(0, c - min_low) ELSE greatest(0, max_high - c) END / a END AS adverse FROM h5)
"""

_FACTS = "facts AS (SELECT series, t1 AS known_at, pivot_kind AS kind, round(pivot_price, 6) AS price FROM piv WHERE pivot_kind IS NOT NULL)"
_PIVOTS = [_BASE, _PIV.format(p="", src="seg")]
_NETS = """nets AS (SELECT l_returnflag AS book, ((epoch_us(l_shipdate) // 1000) // 86400000) * 86400000 AS day,
  round(sum(l_extendedprice * (l_discount - l_tax)), 4) AS net FROM lineitem GROUP BY 1, 2)"""
_PATH = """pth AS (SELECT *, sum(net) OVER (PARTITION BY book ORDER BY day) AS equity FROM nets),
pk AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY book ORDER BY day)) AS peak FROM pth)"""

ALL = {
    "bars_ohlcv_45m": """SELECT 'ALL' AS series, ((epoch_us(ts) // 1000) // 2700000) * 2700000 AS t0, count(*) AS ticks, round(arg_min(value, ts), 6) AS o,
      round(max(value), 6) AS h, round(min(value), 6) AS l, round(arg_max(value, ts), 6) AS c, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2""",
    "bars_dense_grid": _with([_BASE], f"SELECT series, t0, t1, status, ticks, {r6('o', 'h', 'l', 'c')} FROM bars"),
    "bars_regrouped_daily": _with(
        [_BASE],
        """SELECT series, day AS t0, CASE WHEN ok THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status, ticks, CASE WHEN ok THEN round(o, 6) END AS o, CASE WHEN ok THEN round(h, 6) END AS h,
      CASE WHEN ok THEN round(l, 6) END AS l, CASE WHEN ok THEN round(c, 6) END AS c, CASE WHEN ok THEN v END AS v FROM (
      SELECT series, (t0 // 86400000) * 86400000 AS day, bool_and(status = 'COMPLETE') AS ok, sum(ticks) AS ticks, arg_min(o, t0) AS o, max(h) AS h, min(l) AS l, arg_max(c, t0) AS c, sum(v) AS v
      FROM bars GROUP BY 1, 2)""",
    ),
    "daily_partial_candles": _with(
        [_BASE],
        """SELECT series, (t0 // 86400000) * 86400000 AS t0, round(arg_min(o, t0) FILTER (o IS NOT NULL), 6) AS o, round(max(h), 6) AS h, round(min(l), 6) AS l,
      round(arg_max(c, t0) FILTER (c IS NOT NULL), 6) AS c, bool_or(status <> 'COMPLETE') AS partial FROM bars GROUP BY 1, 2""",
    ),
    "bar_segments": _with([_BASE], "SELECT series, t0, segment, pos FROM seg"),
    "tr_mean_range": _with([_BASE, _VOL], f"SELECT series, t0, {r6('tr', 'a')}, round(a / c, 6) AS a_over_c, tr_r, a_r FROM vol"),
    "sma_pair": _with(
        [_BASE, _VOL, _AVG],
        f"SELECT series, t0, {r6('sma_fast', 'sma_slow', 'dist', 'slope', 'place')}, sma_fast_r, sma_slow_r, dist_r, slope_r, place_r FROM avgs",
    ),
    "average_crosses": _with([_BASE, _VOL, _AVG], 'SELECT series, t0, "cross", cross_r FROM avgs'),
    "volume_ratio_median": _with([_BASE, _VOL, _AVG], f"SELECT series, t0, {r6('v_median', 'v_ratio')}, v_ratio_r FROM avgs"),
    "pivots_2_2": _with(_PIVOTS, f"SELECT series, t0, high_check, low_check, pivot_kind, {r6('pivot_price')}, candidate_t0 FROM piv"),
    "structure_state": _with(
        _PIVOTS,
        f"SELECT series, t0, structure, structure_r, {r6('high_last', 'high_before', 'low_last', 'low_before')} FROM st WHERE status = 'COMPLETE'",
    ),
    "alternating_sequence": _with(_OBS, f"SELECT series, t1, kind, action, version, p0_t0, p1_t0, {r6('price', 'p0_price', 'p1_price')} FROM alt"),
    "anchor_position": _with(_OBS, "SELECT series, t1, version, anchors_r, round(u, 6) AS u, round(1 - u, 6) AS r FROM obs"),
    "anchor_geometry": _with(
        _OBS,
        """SELECT series, t1, version, kind, ratio, round(price, 6) AS price, CASE WHEN a <> 0 THEN round((c - price) / a, 6) END AS dist FROM (
      SELECT *, CASE WHEN k.kind = 'RETRACEMENT' THEN p1 - k.ratio * (p1 - p0) ELSE p0 + k.ratio * (p1 - p0) END AS price FROM obs,
      (VALUES ('RETRACEMENT', CAST(0.236 AS DOUBLE)), ('RETRACEMENT', 0.382), ('RETRACEMENT', 0.5), ('RETRACEMENT', 0.618), ('RETRACEMENT', 0.786), ('PROJECTION', 1.272), ('PROJECTION', 1.618)) k(kind, ratio)
      WHERE anchors_r IS NULL)""",
    ),
    "levels_and_crossings": _with(
        [*_OBS, _DAYS, _LEV],
        "SELECT series, t1, kind, direction, round(price, 6) AS price, round(pc2, 6) AS previous, round(c, 6) AS c FROM crossings WHERE direction IS NOT NULL",
    ),
    "observation_events": _with(
        [*_OBS, _DAYS, _LEV],
        """SELECT series, type, count(*) AS n, min(k) AS first_known, max(k) AS last_known, max(k - e) AS longest_wait FROM (
      SELECT series, 'PIVOT_CONFIRMED' AS type, candidate_t1 AS e, t1 AS k FROM obs WHERE pivot_kind IS NOT NULL
      UNION ALL SELECT series, 'PIVOT_REJECTED', candidate_t1, t1 FROM obs WHERE high_check = 'TIE'
      UNION ALL SELECT series, 'PIVOT_REJECTED', candidate_t1, t1 FROM obs WHERE low_check = 'TIE'
      UNION ALL SELECT series, 'PIVOT_DUAL_AMBIGUOUS', candidate_t1, t1 FROM obs WHERE dual
      UNION ALL SELECT series, 'SEQUENCE', c1, t1 FROM alt
      UNION ALL SELECT series, 'AVERAGE_CROSS', t1, t1 FROM obs WHERE "cross" IN ('UP', 'DOWN')
      UNION ALL SELECT series, 'LEVEL_CROSS', t1, t1 FROM crossings WHERE direction IS NOT NULL
      UNION ALL SELECT series, 'SEGMENT_RESET', t1, t1 FROM (SELECT *, lag(status) OVER (PARTITION BY series ORDER BY t0) AS was FROM obs) WHERE status <> 'COMPLETE' AND was = 'COMPLETE')
      GROUP BY 1, 2""",
    ),
    "measure_availability": _with(
        _OBS,
        "SELECT measure, coalesce(reason, 'AVAILABLE') AS reason, count(*) AS n FROM ("
        + " UNION ALL ".join(f"SELECT '{m}' AS measure, {m}_r AS reason FROM obs" for m in _MEASURES)
        + ") GROUP BY 1, 2",
    ),
    "flatten_measures": _with(
        _OBS, f"SELECT series, t1, {r6('a', 'dist', 'slope')}, a_r AS a_reason, dist_r AS dist_reason, slope_r AS slope_reason FROM obs"
    ),
    "daily_relation_matrix": _with(
        _RELATED,
        """SELECT s_bar, count(*) FILTER (s_day = 'UP') AS up, count(*) FILTER (s_day = 'DOWN') AS down, count(*) FILTER (s_day = 'MIXED') AS mixed,
      count(*) FILTER (s_day = 'UNAVAILABLE') AS unavailable FROM rel GROUP BY 1""",
    ),
    "relation_counts": _with(_RELATED, "SELECT series, s_bar, relation, count(*) AS n FROM rel GROUP BY 1, 2, 3"),
    "forward_outcomes_24h": _with(
        [*_OBS, _FUT],
        f"SELECT series, t1, valid, in_range, future_complete, a_status, {r6('max_high', 'min_low', 'close_after', 'final', 'up', 'down')} FROM fut",
    ),
    "right_censoring": _with([*_OBS, _FUT], "SELECT series, flags, count(*) AS n FROM fut GROUP BY 1, 2"),
    "first_touch_class": _with(
        [*_OBS, _TOUCH],
        f"SELECT series, t1, d, class, bars, f_bar, g_bar, max_high_bar, min_low_bar, {r6('max_high', 'min_low', 'final', 'favourable', 'adverse')} FROM touch",
    ),
    "outcome_groups": _with(
        [*_OBS, _FUT],
        """SELECT CASE WHEN grouping(month) = 1 THEN 'TOTAL' ELSE month END AS month, CASE WHEN grouping(state) = 1 THEN 'TOTAL' ELSE state END AS state, count(*) AS rows, count(final) AS n,
      round(avg(final), 6) AS mean, round(min(final), 6) AS min, round(max(final), 6) AS max, round(quantile_cont(final, 0.1), 6) AS p10, round(quantile_cont(final, 0.5), 6) AS p50, round(quantile_cont(final, 0.9), 6) AS p90
      FROM (SELECT strftime(make_timestamp(t1 * 1000), '%Y-%m') AS month, coalesce(structure, 'UNAVAILABLE') AS state, final FROM fut)
      GROUP BY GROUPING SETS ((month, state), (state), (month), ())""",
    ),
    "outcome_examples": _with(
        [*_OBS, _FUT],
        """SELECT series, structure, arg_min(t1, x) AS contrary, min(t1) AS first FROM (
      SELECT *, row_number() OVER (PARTITION BY series, structure ORDER BY CASE WHEN structure = 'UP' THEN final ELSE -final END, t1) AS x FROM fut WHERE structure IN ('UP', 'DOWN') AND final IS NOT NULL)
      GROUP BY 1, 2""",
    ),
    "movement_versions": _with(
        [*_OBS, _VER], "SELECT series, version_id, group_id, d, active_from, retired_at, retire_reason, action, round(length, 6) AS length FROM vers"
    ),
    "attempts_rearm": _with(
        [*_OBS, _VER, _ATT], "SELECT series, group_id, version_id, ordinal, d, t1, bars_since_p1, counter_closes, round(c, 6) AS c FROM att"
    ),
    "attempt_reactions": _with(
        [*_OBS, _VER, _ATT],
        """SELECT series, group_id, ordinal, t1, CASE WHEN d = 1 THEN hi >= p1_price ELSE lo <= p1_price END AS p1_touched, round(x, 6) AS extreme, round(d * (p1_price - x) / length, 6) AS depth FROM (
      SELECT *, CASE WHEN d = 1 THEN lo ELSE hi END AS x FROM (
      SELECT a.series, a.group_id, a.ordinal, a.t1, a.d, a.p1_price, a.length, min(b.l) AS lo, max(b.h) AS hi FROM att a JOIN b1 b ON b.series = a.series AND b.t0 > a.p1_t0 AND b.t0 <= a.t0 GROUP BY ALL))""",
    ),
    "attempt_count_histogram": _with(
        [*_OBS, _VER, _ATT], "SELECT attempts, count(*) AS groups FROM (SELECT series, group_id, count(*) AS attempts FROM att GROUP BY 1, 2) GROUP BY 1"
    ),
    "attempt_profiles": _with(
        [*_OBS, _VER, _ATT],
        f"""SELECT d, profile, CAST(grouping(profile) AS INT) AS pooled, count(*) AS attempts, count(DISTINCT series || group_id) AS groups FROM (
      SELECT x.series, x.group_id, x.d, {_PROFILE} AS profile FROM att x JOIN obs o ON o.series = x.series AND o.t1 = x.t1) GROUP BY GROUPING SETS ((d), (d, profile))""",
    ),
    "joint_profile": _with(
        _OBS, f"SELECT series, d, {_PROFILE} AS profile, count(*) AS n FROM obs, (VALUES (1), (-1)) k(d) GROUP BY 1, 2, 3"
    ),
    "nearest_levels": _with(
        [*_OBS, _DAYS, _LEV],
        """, near AS (SELECT series, t1, k.kind, k.price - c AS raw FROM lev, LATERAL (VALUES ('PIVOT_HIGH', high_last), ('PIVOT_LOW', low_last), ('DAY_HIGH', day_high), ('DAY_LOW', day_low)) k(kind, price) WHERE c IS NOT NULL)
      SELECT lev.series, lev.t1, a.kind AS ahead_kind, round(a.gap, 6) AS ahead_gap, b.kind AS behind_kind, round(b.gap, 6) AS behind_gap FROM lev
      LEFT JOIN (SELECT series, t1, kind, raw AS gap FROM near WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY series, t1 ORDER BY raw, kind) = 1) a ON a.series = lev.series AND a.t1 = lev.t1
      LEFT JOIN (SELECT series, t1, kind, -raw AS gap FROM near WHERE raw < 0 QUALIFY row_number() OVER (PARTITION BY series, t1 ORDER BY -raw, kind) = 1) b ON b.series = lev.series AND b.t1 = lev.t1
      WHERE lev.c IS NOT NULL""",
    ),
    "version_overlap_peak": _with(
        [*_OBS, _VER],
        """SELECT p.series, spans, overlapping, peak FROM (
      SELECT series, max(open) AS peak FROM (SELECT series, sum(step) OVER (PARTITION BY series ORDER BY t, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM (
        SELECT series, active_from AS t, 1 AS step FROM vers UNION ALL SELECT series, retired_at, -1 FROM vers)) GROUP BY 1) p
      JOIN (SELECT series, count(*) AS spans, count(*) FILTER (EXISTS (SELECT 1 FROM vers y WHERE y.series = x.series AND y.version_id <> x.version_id AND y.active_from < x.retired_at AND x.active_from < y.retired_at)) AS overlapping FROM vers x GROUP BY 1) q
      ON p.series = q.series""",
    ),
    "asof_snapshot": _with(
        [*_PIVOTS, _FACTS, "asked AS (SELECT event_type AS series, (epoch_us(ts) // 1000) AS t, round(value, 6) AS paid FROM events)"],
        "SELECT a.series, a.t, a.paid, f.known_at AS pivot_known_at, f.kind AS pivot_kind, f.price AS pivot_price FROM asked a ASOF LEFT JOIN facts f ON a.series = f.series AND a.t >= f.known_at",
    ),
    "visible_at": _with([*_PIVOTS, _FACTS], "SELECT series, known_at, kind, price FROM facts WHERE known_at <= 1705320000000 QUALIFY row_number() OVER (PARTITION BY series ORDER BY known_at DESC) = 1"),
    "last_known_close": _with(
        [_BASE], "SELECT series, t0, round(last_value(c IGNORE NULLS) OVER (PARTITION BY series ORDER BY t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS known FROM bars"
    ),
    "rate_interval_join": _with(
        [*_OBS, _VER, "rates AS (SELECT event_type AS series, ((epoch_us(ts) // 1000) // 3600000) * 3600000 AS tau, avg(value) AS rate FROM events GROUP BY 1, 2)"],
        "SELECT v.series, v.version_id, count(*) AS n, round(sum(rate), 6) AS total FROM vers v JOIN rates r ON r.series = v.series AND r.tau > v.active_from AND r.tau <= v.retired_at GROUP BY 1, 2",
    ),
    "series_certification": """SELECT series, count(*) FILTER (gap > 3600000) AS long_gaps, count(*) FILTER (gap < 60000) AS within_a_minute, max(gap) AS longest, count(*) FILTER (gap > 43200000) = 0 AS certified FROM (
      SELECT event_type AS series, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) GROUP BY 1""",
    "first_per_category": _with(
        [*_OBS, _FUT],
        """, hits AS (SELECT t1, series, unnest([CASE WHEN structure = 'UP' AND future_complete THEN 'UP_COMPLETE' END, CASE WHEN structure = 'DOWN' AND future_complete THEN 'DOWN_COMPLETE' END,
        CASE WHEN censored THEN 'CENSORED' END, CASE WHEN gap THEN 'GAP' END, CASE WHEN a < 0 THEN 'NEVER' END]) AS category FROM fut)
      SELECT k.category, h.t1, h.series FROM (VALUES ('UP_COMPLETE'), ('DOWN_COMPLETE'), ('CENSORED'), ('GAP'), ('NEVER')) k(category)
      LEFT JOIN (SELECT * FROM hits WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY t1, series) = 1) h ON h.category = k.category""",
    ),
    "describe_by_group": """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(min(l_extendedprice), 6) AS min, round(max(l_extendedprice), 6) AS max,
      round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75,
      round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1, 2""",
    "grouping_sets_domain_fill": """WITH x AS (SELECT strftime(o_orderdate, '%Y') AS year, o_orderstatus AS state, o_totalprice FROM orders),
      cells AS (SELECT year, state, count(*) AS n, sum(o_totalprice) AS total FROM x GROUP BY 1, 2 UNION ALL SELECT 'TOTAL', state, count(*), sum(o_totalprice) FROM x GROUP BY 2)
      SELECT p.year, s.state, coalesce(c.n, 0) AS n, round(coalesce(c.total, 0), 2) AS total FROM (SELECT DISTINCT year FROM x UNION ALL SELECT 'TOTAL') p, (VALUES ('F'), ('O'), ('P'), ('X')) s(state)
      LEFT JOIN cells c ON c.year = p.year AND c.state = s.state""",
    "trade_stats": """SELECT book, n, wins, losses, round(net, 2) AS net, round(best, 4) AS best, round(worst, 4) AS worst, round(wins / n, 6) AS positive_share, round((gains / wins) / (lost / losses), 6) AS payoff,
      round(gains / lost, 6) AS profit_factor FROM (SELECT l_returnflag AS book, count(*) AS n, count(*) FILTER (x > 0) AS wins, count(*) FILTER (x < 0) AS losses, sum(x) AS net, sum(x) FILTER (x > 0) AS gains,
      sum(-x) FILTER (x < 0) AS lost, max(x) AS best, min(x) AS worst FROM (SELECT *, l_extendedprice * (l_discount - l_tax) AS x FROM lineitem) GROUP BY 1)""",
    "drawdown_curve": _with(
        [_NETS, _PATH],
        """SELECT book, round(least(0, min(equity - peak)), 4) AS max_drawdown, round(least(0, min(equity - peak)) / 1000 * 10000, 4) AS max_drawdown_bps, round(arg_max(equity, day), 4) AS end, count(*) AS points
      FROM pk GROUP BY 1""".replace(" AS end,", ' AS "end",'),
    ),
    "losing_streak": _with(
        [_NETS, "isl AS (SELECT *, count(*) FILTER (NOT net < 0) OVER (PARTITION BY book ORDER BY day) AS i FROM nets)"],
        "SELECT book, coalesce(max(n) , 0) AS longest FROM (SELECT book, i, count(*) FILTER (net < 0) AS n FROM isl GROUP BY 1, 2) GROUP BY 1",
    ),
    "concentration_top5": _with(
        [_NETS],
        """SELECT book, round(sum(abs(net)) FILTER (r <= 5) / sum(abs(net)), 6) AS top_share, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY book ORDER BY abs(net) DESC, day) AS r FROM nets) GROUP BY 1""",
    ),
    "cashflow_by_month": """SELECT month, kind, round(sum(amount), 2) AS amount, count(*) AS n FROM (
      SELECT strftime(o_orderdate, '%Y-%m') AS month, 'FEE' AS kind, -0.001 * l_extendedprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), 'RESULT', l_extendedprice * l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), 'TAX', -l_extendedprice * l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2""",
    "null_poisoning_sum": """SELECT month, o_orderpriority, CASE WHEN count(*) FILTER (x IS NULL) = 0 THEN round(sum(x), 2) END AS total, count(*) FILTER (x IS NULL) AS withheld FROM (
      SELECT *, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN NOT (o_orderpriority = '1-URGENT' AND o_custkey % 7 = 0) THEN o_totalprice END AS x FROM orders) GROUP BY 1, 2""",
    "stock_flow_periods": _with(
        [*_OBS, _VER],
        """SELECT series, period_end, CAST(s - births + ends AS BIGINT) AS stock_start, CAST(births AS BIGINT) AS births, CAST(ends AS BIGINT) AS ends, CAST(s AS BIGINT) AS stock_end FROM (
      SELECT *, sum(births - ends) OVER (PARTITION BY series ORDER BY period_end) AS s FROM (
      SELECT series, period_end, sum(b) AS births, sum(e) AS ends FROM (
        SELECT series, CAST(ceil(active_from / 86400000) AS BIGINT) * 86400000 AS period_end, 1 AS b, 0 AS e FROM vers
        UNION ALL SELECT series, CAST(ceil(retired_at / 86400000) AS BIGINT) * 86400000, 0, 1 FROM vers) GROUP BY 1, 2))""",
    ),
    "duration_status": """WITH f AS (SELECT l_orderkey, min((epoch_us(l_shipdate) // 1000)) AS shipped FROM lineitem GROUP BY 1), m AS (SELECT o_orderstatus, (epoch_us(o_orderdate) // 1000) AS born, shipped FROM orders LEFT JOIN f ON o_orderkey = l_orderkey),
      e AS (SELECT max(greatest(born, coalesce(shipped, born))) AS last FROM m), v AS (SELECT o_orderstatus, CASE WHEN shipped IS NOT NULL THEN 'AVAILABLE' ELSE 'CENSORED' END AS kind, (coalesce(shipped, last) - born) / 86400000.0 AS x FROM m, e)
      SELECT o_orderstatus, kind, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90 FROM v GROUP BY 1, 2""",
    "duplicate_policy": """SELECT state, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT n, CASE WHEN n = 1 THEN 'SINGLE' WHEN k = 1 THEN 'IDENTICAL' ELSE 'DISCORDANT' END AS state FROM (
      SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)) AS k FROM lineitem GROUP BY 1, 2)) GROUP BY 1""",
    "partition_pruned_month": """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
      WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-01' GROUP BY 1""",
    "step_rounding": """SELECT l_returnflag, CAST(sum(floor(u) * 0.25) AS DOUBLE) AS down, CAST(sum(ceil(u) * 0.25) AS DOUBLE) AS up, count(*) FILTER (floor(u) = u) AS exact FROM (
      SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18, 2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 4 AS u FROM lineitem) GROUP BY 1""",
    "interval_bounds": """SELECT event_type AS series, (epoch_us(ts) // 1000) - ((((epoch_us(ts) // 1000) - 1705000020000) % 3000000) + 3000000) % 3000000 AS start, count(*) AS n FROM events GROUP BY 1, 2""",
    "iso_times": """SELECT strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS text, strftime(ts, '%Y-%m') AS month, true AS same, count(*) AS n FROM events GROUP BY 1, 2, 3""",
    "semi_anti_activity": _with(
        [*_OBS, _VER, _ATT],
        """SELECT series, tried, count(*) AS groups FROM (SELECT DISTINCT v.series, v.group_id, EXISTS (SELECT 1 FROM att a WHERE a.series = v.series AND a.group_id = v.group_id) AS tried FROM vers v) GROUP BY 1, 2""",
    ),
    "changed_rows": """WITH b AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0), a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN 'CHANGED' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)
      SELECT CASE WHEN a.o_orderkey IS NULL THEN 'GONE' WHEN b.o_orderkey IS NULL THEN 'ADDED' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'CHANGED' ELSE 'SAME' END AS state,
      count(*) AS n, count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS o_orderstatus_changed,
      count(*) FILTER (a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_orderpriority IS DISTINCT FROM b.o_orderpriority) AS o_orderpriority_changed FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey GROUP BY 1""",
    "reconcile_partitions": _with(_OBS, "SELECT series, count(*) AS expected, count(*) - 1 AS found FROM obs GROUP BY 1 HAVING count(*) FILTER (structure = 'UP') > 0"),
    "leg_decisions": _with(
        [*_OBS, _LEGS],
        """SELECT series, leg_id, leg_t1, d, leg_bars, outcome, ended_at, counter, round(depth, 6) AS depth, CASE WHEN outcome = 'CALL' THEN round(sp, 6) END AS stop, CASE WHEN outcome = 'CALL' THEN round(rk, 6) END AS risk,
      CASE WHEN outcome = 'CALL' THEN round(gn, 6) END AS gain, CASE WHEN outcome = 'CALL' THEN round((p1_price + CAST(0.05 AS DOUBLE) * sp) / CAST(1.05 AS DOUBLE), 6) END AS entry_bound FROM dec""",
    ),
    "slot_greedy": _with(
        [*_OBS, _LEGS],
        """, ord AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY leg_t1, leg_id) AS rn FROM dec),
      walk AS (SELECT series, rn, leg_id, true AS free, CASE WHEN against IS NULL THEN coalesce(ended_at, 4611686018427387904) ELSE -4611686018427387904 END AS busy FROM ord WHERE rn = 1
        UNION ALL SELECT o.series, o.rn, o.leg_id, o.leg_t1 > w.busy, CASE WHEN o.leg_t1 > w.busy AND o.against IS NULL THEN coalesce(o.ended_at, 4611686018427387904) ELSE w.busy END FROM walk w JOIN ord o ON o.series = w.series AND o.rn = w.rn + 1)
      SELECT o.series, o.leg_id, o.leg_t1, o.outcome, CASE WHEN w.free THEN 'TAKEN' ELSE 'SKIPPED_BUSY' END AS slot FROM ord o JOIN walk w ON w.series = o.series AND w.rn = o.rn""",
    ),
    "gated_ledger": _with(
        [*_OBS, _LEGS, _ENTRY, _EXIT],
        """, hold AS (
        SELECT d.*, t.entry_at, t.exit_at, t.reason, t.net, t.leg_id IS NOT NULL AND (t.exit_at IS NULL OR t.reason = 'UNRESOLVED_DATA_GAP') AS halts,
          CASE WHEN t.leg_id IS NULL THEN d.ended_at WHEN t.reason <> 'UNRESOLVED_DATA_GAP' THEN t.exit_at END AS until, row_number() OVER (PARTITION BY d.series ORDER BY d.leg_t1, d.leg_id) AS rn
        FROM dec d LEFT JOIN trd t ON t.series = d.series AND t.leg_id = d.leg_id),
      walk AS (SELECT series, rn, true AS free, CASE WHEN against IS NULL THEN coalesce(until, 4611686018427387904) ELSE -4611686018427387904 END AS busy FROM hold WHERE rn = 1
        UNION ALL SELECT o.series, o.rn, o.leg_t1 > w.busy, CASE WHEN o.leg_t1 > w.busy AND o.against IS NULL THEN coalesce(o.until, 4611686018427387904) ELSE w.busy END FROM walk w JOIN hold o ON o.series = w.series AND o.rn = w.rn + 1),
      gap AS (SELECT h.series, min(h.exit_at) AS at FROM hold h JOIN walk w ON w.series = h.series AND w.rn = h.rn WHERE w.free AND h.halts GROUP BY 1)
      SELECT h.series, h.leg_id, h.leg_t1, h.outcome, CASE WHEN w.free THEN 'TAKEN' WHEN h.leg_t1 > g.at THEN 'NOT_EVALUATED' ELSE 'SKIPPED_BUSY' END AS slot, CASE WHEN w.free THEN h.entry_at END AS taken_entry_at,
        CASE WHEN w.free THEN h.exit_at END AS taken_exit_at, CASE WHEN w.free THEN h.reason END AS taken_reason, CASE WHEN w.free THEN round(h.net, 6) END AS taken_net
      FROM hold h JOIN walk w ON w.series = h.series AND w.rn = h.rn LEFT JOIN gap g ON g.series = h.series""",
    ),
    "exit_groups": _with(
        [*_OBS, _LEGS, _ENTRY, _EXIT],
        """SELECT reason, CASE WHEN final_stop = sp THEN 'INITIAL' WHEN final_stop IS NOT NULL THEN 'TRAILED' END AS stop_origin, count(*) AS n, count(net) AS resolved,
      round(CASE WHEN count(net) = count(*) THEN sum(net) END, 6) AS net, round(avg(net / (qty * risk0)), 6) AS mean_over_risk FROM (SELECT t.*, x.sp FROM trd t JOIN dec x ON x.series = t.series AND x.leg_id = t.leg_id) GROUP BY 1, 2""",
    ),
    "entry_outcomes": _with([*_OBS, _LEGS, _ENTRY], "SELECT series, entry_outcome, count(*) AS n FROM ent GROUP BY 1, 2"),
    "ledger_exits": _with(
        [*_OBS, _LEGS, _ENTRY, _EXIT],
        f"""SELECT series, leg_id, entry_at, exit_at, reason, "both", {r6('entry', 'final_stop', 'price_pnl', 'fees', 'net', 'net_target_first', 'stress_net')}, round("exit", 6) AS "exit",
      round(net / (qty * risk0), 6) AS net_over_risk FROM trd""",
    ),
    "average_cost_accounting": """WITH RECURSIVE f AS (
      SELECT l_partkey AS part, row_number() OVER (PARTITION BY l_partkey ORDER BY (epoch_us(l_shipdate) // 1000), l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END, l_quantity, l_extendedprice / l_quantity) AS rn,
        CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS s, l_extendedprice / l_quantity AS price, l_extendedprice * CAST(0.001 AS DOUBLE) AS fee FROM lineitem),
      w AS (SELECT part, 1 AS rn, s AS qty, price AS avg, CAST(0 AS DOUBLE) AS realized, fee AS fees, 0 AS closes FROM f WHERE rn = 1
        UNION ALL SELECT f.part, w.rn + 1, w.qty + f.s,
          CASE WHEN w.qty + f.s = 0 THEN 0 WHEN w.qty = 0 OR sign(w.qty) = sign(f.s) THEN (abs(w.qty) * w.avg + abs(f.s) * f.price) / abs(w.qty + f.s) WHEN abs(f.s) > abs(w.qty) THEN f.price ELSE w.avg END,
          CASE WHEN w.qty = 0 OR sign(w.qty) = sign(f.s) THEN w.realized ELSE w.realized + least(abs(f.s), abs(w.qty)) * (f.price - w.avg) * sign(w.qty) END, w.fees + f.fee,
          w.closes + CASE WHEN w.qty = 0 OR sign(w.qty) = sign(f.s) THEN 0 ELSE 1 END FROM w JOIN f ON f.part = w.part AND f.rn = w.rn + 1)
      SELECT part, closes, round(qty, 2) AS qty, round(avg, 2) AS avg_price, round(realized, 2) AS realized, round(fees, 2) AS fees, round(realized - fees, 2) AS net FROM w QUALIFY row_number() OVER (PARTITION BY part ORDER BY rn DESC) = 1""",
    "bar_violations": _with(
        [_BASE],
        """, f0 AS (SELECT series, t0, CASE WHEN (t0 // 5400000) % 101 = 0 THEN t0 ELSE t1 END AS t1, CASE WHEN (t0 // 5400000) % 103 = 0 THEN 'UNKNOWN' ELSE status END AS status,
        ticks, o, CASE WHEN (t0 // 5400000) % 97 = 0 THEN l - 1 ELSE h END AS h, l, c FROM bars),
      f1 AS (SELECT *, lag(t1) OVER (PARTITION BY series ORDER BY t0) AS bt FROM f0)
      SELECT series, t0, 'status' AS rule FROM f1 WHERE status NOT IN ('COMPLETE', 'INCOMPLETE') UNION ALL SELECT series, t0, 'width' FROM f1 WHERE t1 <= t0 UNION ALL SELECT series, t0, 'grid' FROM f1 WHERE bt <> t0
      UNION ALL SELECT series, t0, 'prices' FROM f1 WHERE CASE WHEN status = 'COMPLETE' THEN h < greatest(o, c) OR l > least(o, c) OR ticks = 0 ELSE coalesce(o, h, l, c) IS NOT NULL END""",
    ),
    "observation_violations": _with(
        _OBS,
        """SELECT series, t0, 'tr' AS rule FROM obs WHERE (t0 // 5400000) % 89 = 0 AND tr IS NOT NULL UNION ALL SELECT series, t0, 'dist' FROM obs WHERE (t0 // 5400000) % 83 = 0 AND dist IS NOT NULL
      UNION ALL SELECT series, t0, 'pivot time' FROM obs WHERE (t0 // 5400000) % 7 = 0 AND pivot_kind IS NOT NULL UNION ALL SELECT series, t0, 'segment' FROM obs WHERE (t0 // 5400000) % 79 = 0 AND status = 'COMPLETE'""",
    ),
    "outcome_cross_check": _with([*_OBS, _FUT], "SELECT series, t1, 'max_high' AS rule FROM fut WHERE future_complete AND c IS NOT NULL AND (t0 // 5400000) % 53 = 0"),
    "version_projection": _with(
        [*_OBS, _VER],
        """SELECT series, version_id, d, active_from, CASE WHEN retired_at <= 1705320000000 THEN retired_at END AS retired_at, CASE WHEN retired_at <= 1705320000000 THEN retire_reason END AS retire_reason
      FROM vers WHERE active_from <= 1705320000000""",
    ),
    "attempt_flow": _with(
        [*_OBS, _VER, _ATT],
        """SELECT 0 AS place, 'SEQUENCE' AS step, count(*) AS n FROM alt UNION ALL SELECT 1, 'ACCEPTED', count(*) FROM alt WHERE action <> 'KEEP' UNION ALL SELECT 2, 'VERSIONS', count(*) FROM vers
      UNION ALL SELECT 3, 'GROUPS', count(*) FROM (SELECT DISTINCT series, group_id FROM vers) UNION ALL SELECT 4, 'ATTEMPTS', count(*) FROM att
      UNION ALL SELECT 5, 'GROUPS_TRIED', count(*) FROM (SELECT DISTINCT series, group_id FROM att)""",
    ),
    "attempt_snapshots": _with(
        [*_RELATED, _LEV, _VER, _ATT],
        f""", rea AS (SELECT a.series, a.group_id, a.ordinal, CASE WHEN a.d = 1 THEN min(b.l) ELSE max(b.h) END AS x FROM att a JOIN b1 b ON b.series = a.series AND b.t0 > a.p1_t0 AND b.t0 <= a.t0 GROUP BY a.series, a.group_id, a.ordinal, a.d),
      snap AS (SELECT a.group_id, a.ordinal, a.d, a.length, a.p1_price, r.x, e.s_day, l.* FROM att a JOIN rea r ON r.series = a.series AND r.group_id = a.group_id AND r.ordinal = a.ordinal
        JOIN lev l ON l.series = a.series AND l.t1 = a.t1 JOIN rel e ON e.series = a.series AND e.t1 = a.t1),
      lvls AS (SELECT series, group_id, ordinal, k.kind, d * (k.price - c) AS raw FROM snap, LATERAL (VALUES ('PIVOT_HIGH', high_last), ('PIVOT_LOW', low_last), ('DAY_HIGH', day_high), ('DAY_LOW', day_low)) k(kind, price)),
      ah AS (SELECT * FROM lvls WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY series, group_id, ordinal ORDER BY raw, kind) = 1),
      be AS (SELECT * FROM lvls WHERE raw < 0 QUALIFY row_number() OVER (PARTITION BY series, group_id, ordinal ORDER BY -raw, kind) = 1)
      SELECT s.series, s.group_id, s.ordinal, s.t1, s.d, {_PROFILE} AS profile, s.s_day,
        CASE WHEN "cross" = 'NONE' THEN 'NONE' WHEN "cross" = CASE WHEN d = 1 THEN 'UP' ELSE 'DOWN' END THEN 'IN_DIRECTION' WHEN "cross" IS NOT NULL THEN 'AGAINST' END AS cross_side,
        CASE WHEN anchors_r IS NULL THEN CASE WHEN (p1_kind = 'HIGH') = (d = 1) THEN 'CONCORDANT' ELSE 'OPPOSITE' END END AS anchors_side, ah.kind AS ahead_kind, be.kind AS behind_kind,
        round(d * dist, 6) AS d_dist, round(d * slope, 6) AS d_slope, round(d * place, 6) AS d_place, round(v_ratio, 6) AS v_ratio, CASE WHEN a <> 0 THEN round(length / a, 6) END AS length_over_a,
        CASE WHEN a <> 0 THEN round(d * (p1_price - c) / a, 6) END AS to_p1, CASE WHEN a <> 0 THEN round(d * (x - c) / a, 6) END AS to_extreme, CASE WHEN a <> 0 THEN round(ah.raw / a, 6) END AS ahead_gap,
        CASE WHEN a <> 0 THEN round(-be.raw / a, 6) END AS behind_gap, round(d * (p1_price - x) / length, 6) AS depth
      FROM snap s LEFT JOIN ah ON ah.series = s.series AND ah.group_id = s.group_id AND ah.ordinal = s.ordinal LEFT JOIN be ON be.series = s.series AND be.group_id = s.group_id AND be.ordinal = s.ordinal""",
    ),
    "attempt_cells": _with(
        [*_OBS, _VER, _ATT, _TOUCH.replace(
            "SELECT series, t1, CASE WHEN structure = 'UP' THEN 1 ELSE -1 END AS d, c, a FROM obs WHERE structure IN ('UP', 'DOWN') AND a > 0",
            "SELECT DISTINCT x.series, x.t1, x.d, o.c, o.a FROM att x JOIN obs o ON o.series = x.series AND o.t1 = x.t1 WHERE o.a > 0",
        ).replace("OVER (PARTITION BY h1.series, h1.t1)", "OVER (PARTITION BY h1.series, h1.t1, h1.d)")],
        """, cell AS (SELECT x.series, x.group_id, x.d, t.class, CASE WHEN t.class IS NOT NULL THEN t.final END AS z FROM att x JOIN touch t ON t.series = x.series AND t.t1 = x.t1 AND t.d = x.d)
      SELECT d, class, attempts, groups, n, round(attempts / sum(attempts) OVER (PARTITION BY d), 6) AS share, mean, min, max, p10, p50, p90 FROM (
      SELECT d, coalesce(class, 'INCOMPLETE') AS class, count(*) AS attempts, count(DISTINCT series || group_id) AS groups, count(z) AS n, round(avg(z), 6) AS mean, round(min(z), 6) AS min, round(max(z), 6) AS max,
        round(quantile_cont(z, 0.1), 6) AS p10, round(quantile_cont(z, 0.5), 6) AS p50, round(quantile_cont(z, 0.9), 6) AS p90 FROM cell GROUP BY 1, 2)""",
    ),
    "value_paths": _with(
        [*_OBS, _LEGS, _ENTRY, _EXIT],
        """SELECT series, leg_id, count(*) AS bars, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, round(min(z), 6) AS z_lowest, round(max(z), 6) AS z_highest FROM (
      SELECT t.series, t.leg_id, t.d * t.qty * (b.c - t.entry) - CAST(0.0005 AS DOUBLE) * t.qty * t.entry AS v, t.d * (b.c - t.entry) / t.risk0 AS z FROM trd t
      JOIN e0 b ON b.series = t.series AND b.leg_id = t.leg_id AND b.t1 < coalesce(t.exit_at, 4611686018427387904)) GROUP BY 1, 2""",
    ),
    "holding_costs": _with(
        [*_OBS, _LEGS, _ENTRY, _EXIT],
        """SELECT t.series, t.leg_id, count(*) FILTER (k) AS funding_events, round(CASE WHEN count(*) FILTER (k AND cash IS NULL) > 0 THEN NULL ELSE coalesce(sum(cash) FILTER (k), 0) END, 6) AS funding,
        round(coalesce(sum(least(0, CASE WHEN k THEN -cash ELSE cash END)) FILTER (near), 0), 6) AS funding_low, round(coalesce(sum(greatest(0, CASE WHEN k THEN -cash ELSE cash END)) FILTER (near), 0), 6) AS funding_high
      FROM (SELECT * FROM trd WHERE exit_at IS NOT NULL) t LEFT JOIN (
        SELECT t.leg_id, t.series, coalesce(r.t1 > t.entry_at AND r.t1 <= t.exit_at, false) AS k, abs(r.t1 - t.entry_at) < 60000 OR abs(r.t1 - t.exit_at) < 60000 AS near, -t.d * t.qty * r.c * CAST(0.0001 AS DOUBLE) AS cash
        FROM trd t JOIN bars r ON r.series = t.series AND r.t1 % 28800000 = 0 AND r.t1 >= t.entry_at - 59999 AND r.t1 <= t.exit_at + 59999) f ON f.series = t.series AND f.leg_id = t.leg_id GROUP BY 1, 2""",
    ),
    "period_table": _with(
        [*_OBS, _LEGS],
        """SELECT month, CAST(grouping(month) AS INT) AS pooled, count(covered) AS closes, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(legs) AS BIGINT) AS legs, CAST(sum(calls) AS BIGINT) AS calls FROM (
      SELECT strftime(make_timestamp(t0 * 1000), '%Y-%m') AS month, (status = 'COMPLETE')::INT AS covered, 0 AS legs, 0 AS calls FROM obs
      UNION ALL SELECT strftime(make_timestamp(leg_t1 * 1000), '%Y-%m'), NULL, 1, (outcome = 'CALL')::INT FROM dec) GROUP BY GROUPING SETS ((month), ())""",
    ),
    "longest_movements": _with([*_OBS, _VER], "SELECT series, version_id, retired_at - active_from AS life FROM vers ORDER BY life DESC, series, version_id LIMIT 5"),
    "lifecycle_ledger": _with([*_OBS, _LIFE], "SELECT series, t, seq, type, ref_id, side, reason, condition, round(base, 6) AS base, round(extreme, 6) AS extreme, round(anchor, 6) AS anchor FROM log"),
    "lifecycle_movements": _with([*_OBS, _LIFE], "SELECT * FROM moved"),
    "lifecycle_periods": _with(
        [*_OBS, _LIFE],
        """SELECT series, period_end, CAST(s - births + ends AS BIGINT) AS stock_start, CAST(births AS BIGINT) AS births, CAST(ends AS BIGINT) AS ends, CAST(s AS BIGINT) AS stock_end FROM (
      SELECT *, sum(births - ends) OVER (PARTITION BY series ORDER BY period_end) AS s FROM (
      SELECT series, period_end, sum(b) AS births, sum(e) AS ends FROM (
        SELECT series, CAST(ceil(born / 604800000) AS BIGINT) * 604800000 AS period_end, 1 AS b, 0 AS e FROM moved
        UNION ALL SELECT series, CAST(ceil(coalesce(ended, 1706745600000) / 604800000) AS BIGINT) * 604800000, 0, 1 FROM moved) GROUP BY 1, 2))""",
    ),
    "lifecycle_judgements": _with([*_OBS, _LIFE], "SELECT series, ref_id, arg_max(type, t * 100 + seq) AS type, arg_max(condition, t * 100 + seq) AS condition, max(t) AS since FROM log WHERE t <= 1705320000000 AND ref_id IS NOT NULL GROUP BY 1, 2"),
    "lifecycle_violations": _with(
        [*_OBS, _LIFE],
        """, lg AS (SELECT *, (base_t0 // 5400000) % 3 = 0 AS third FROM log WHERE ref_id IS NOT NULL)
      SELECT ref_id, 'loss without a close beyond the base' AS rule FROM lg WHERE reason = 'BASE_LOST' UNION ALL SELECT ref_id, 'close beyond the base not recorded' FROM lg WHERE type = 'CLOSE' AND third
      UNION ALL SELECT ref_id, 'not one birth and one end' FROM lg GROUP BY series, ref_id HAVING count(*) FILTER (type IN ('ARCHIVE', 'OPEN_AT_END') AND (reason = 'BASE_LOST' OR NOT third)) <> 1""",
    ),
    "downsampled_curve": _with(
        [_NETS, _PATH],
        "SELECT book, day, round(equity, 6) AS equity FROM (SELECT *, min(equity) OVER (PARTITION BY book) AS low FROM pk) WHERE day % 2419200000 = 0 OR equity = low",
    ),
}

#: Sums of whole numbers are wider in SQL, and ranks are; these columns are cast to the queries' types.
_KINDS = {
    "alternating_sequence": {"version": "BIGINT"},
    "anchor_geometry": {"version": "BIGINT"},
    "anchor_position": {"version": "BIGINT"},
    "attempt_reactions": {"ordinal": "INTEGER"},
    "attempt_snapshots": {"ordinal": "INTEGER"},
    "attempts_rearm": {"ordinal": "INTEGER", "bars_since_p1": "INTEGER", "counter_closes": "BIGINT"},
    "bar_segments": {"segment": "BIGINT", "pos": "INTEGER"},
    "bars_regrouped_daily": {"ticks": "BIGINT"},
    "first_touch_class": {"f_bar": "INTEGER", "g_bar": "INTEGER", "max_high_bar": "INTEGER", "min_low_bar": "INTEGER"},
    "leg_decisions": {"counter": "BIGINT"},
    "version_overlap_peak": {"peak": "BIGINT"},
}
for _name, _kinds in _KINDS.items():
    _casts = ", ".join(f"CAST({column} AS {kind}) AS {column}" for column, kind in _kinds.items())
    ALL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ALL[_name]})"
