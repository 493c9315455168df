"""Queries of two grains: decisions on bars, executed on the minutes of the ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import MINUTE, interval_start
from tidemark.operators import execution, ledger
from tidemark.plans import oracle
from tidemark.plans.queries import LOOSE, WIDTH, _decided, r6, ticks, typed_bars
from tidemark.sources.shared import materialize


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ticks(spark, sf_dir).groupBy("series", interval_start(F.col("t"), MINUTE).alias("t0")).agg(
        F.min_by("price", "at").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "at").alias("c")
    )
    return materialize(execution.quiet_minutes(found, typed_bars(spark, sf_dir), WIDTH))


def _executed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, seen = _decided(spark, sf_dir)
    minutes = _minutes(spark, sf_dir)
    return execution.minute_trades(materialize(ledger.entries(found, minutes, LOOSE)), seen, minutes, WIDTH, LOOSE)


def minute_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled calls with the minute, reason and result of their exit."""
    done, _ = _executed(spark, sf_dir)
    names = ("entry", "exit", "final_stop", "price_pnl", "fees", "net", "net_target_first", "stress_net", "net_over_risk")
    return done.select("series", "leg_id", "entry_at", "exit_at", "reason", "intrabar", "both", "at_activation", *r6(*names))


def stop_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of filled calls as they were in force: from when, until when, and where they came from."""
    _, stops = _executed(spark, sf_dir)
    return stops.select("series", "leg_id", "valid_from", "valid_to", "origin", *r6("stop"))


ALL = {"minute_ledger": minute_ledger, "stop_history": stop_history}

_MINUTES = """
mt AS (SELECT event_type AS series, (epoch_us(ts) // 60000000) * 60000 AS t0, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c FROM events GROUP BY 1, 2),
mg AS (SELECT series, status = 'COMPLETE' AS ok, unnest(generate_series(t0, t1 - 60000, 60000)) AS t0 FROM bars),
mk AS (SELECT mg.*, o, h, l, c, last_value(c IGNORE NULLS) OVER (PARTITION BY mg.series ORDER BY mg.t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc
  FROM mg LEFT JOIN mt ON mt.series = mg.series AND mt.t0 = mg.t0),
mins AS (SELECT series, t0, ok AND coalesce(c, lc) IS NOT NULL AS good, CASE WHEN ok THEN coalesce(o, lc) END AS o, CASE WHEN ok THEN coalesce(h, lc) END AS h, CASE WHEN ok THEN coalesce(l, lc) END AS l FROM mk)
"""
_FILLED = """
mn0 AS (
  SELECT x.*, m.good, m.o AS ref, z.last_t0, m.o * (1 + x.d * CAST(0.0003 AS DOUBLE)) AS entry FROM dec x LEFT JOIN mins m ON m.series = x.series AND m.t0 = x.ended_at
  JOIN (SELECT series, max(t0) AS last_t0 FROM mins GROUP BY 1) z ON z.series = x.series WHERE x.outcome = 'CALL'),
ent AS (
  SELECT *, d * (entry - sp) AS risk0, 1000.0 / entry AS qty, ended_at + 16 * 5400000 AS over FROM mn0
  WHERE ended_at < last_t0 AND coalesce(good, false) AND d * (entry - sp) > 0 AND d * (p1_price - entry) > 0 AND (p1_price - entry) / (entry - sp) >= 0.05),
bs AS (
  SELECT x.series, x.leg_id, x.d, b.t1, coalesce(b.structure = CASE WHEN x.d = 1 THEN 'DOWN' ELSE 'UP' END, false) AS opp,
    b.pivot_kind = CASE WHEN x.d = 1 THEN 'LOW' ELSE 'HIGH' END AND b.candidate_t0 >= x.ended_at AND b.t1 < x.over AS fits, b.c, x.p1_price, b.pivot_price - x.d * CAST(0.1 AS DOUBLE) * x.a0 AS pr
  FROM ent x JOIN obs b ON b.series = x.series AND b.t0 >= x.ended_at),
props AS (SELECT series, leg_id, d, t1, d * pr AS v FROM bs WHERE fits AND NOT opp AND d * (c - pr) > 0 AND d * (p1_price - pr) > 0 AND pr > 0),
dues AS (SELECT series, leg_id, min(t1) AS exit_due FROM bs WHERE opp GROUP BY 1, 2),
hist AS (
  SELECT *, max(v) OVER (PARTITION BY series, leg_id ORDER BY t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM (SELECT series, leg_id, d, ended_at AS t1, d * sp AS v, 'INITIAL' AS origin FROM ent UNION ALL SELECT series, leg_id, d, t1, v, 'TRAILED' FROM props)),
stp AS (SELECT *, d * v AS stop, lead(t1) OVER (PARTITION BY series, leg_id ORDER BY t1) AS until FROM hist WHERE best IS NULL OR v > best)
"""
#: Every minute of every trade, in the order of precedence.
_WALK = """
mw0 AS (
  SELECT x.*, u.exit_due, m.t0 AS minute, m.good AS fine, m.o, m.h, m.l, now.stop AS s1, coalesce(bef.stop, now.stop) AS s0
  FROM ent x LEFT JOIN dues u ON u.series = x.series AND u.leg_id = x.leg_id
  JOIN mins m ON m.series = x.series AND m.t0 >= x.ended_at AND m.t0 <= least(coalesce(u.exit_due, x.over), x.over, x.last_t0)
  JOIN stp now ON now.series = x.series AND now.leg_id = x.leg_id AND now.t1 <= m.t0 AND (now.until IS NULL OR now.until > m.t0)
  LEFT JOIN stp bef ON bef.series = x.series AND bef.leg_id = x.leg_id AND bef.t1 < m.t0 AND (bef.until IS NULL OR bef.until >= m.t0)),
mw1 AS (SELECT *, minute > ended_at AS later, d * (CASE WHEN d = 1 THEN l ELSE h END - s1) <= 0 AS sh, d * (CASE WHEN d = 1 THEN h ELSE l END - p1_price) >= 0 AS th FROM mw0),
mw2 AS (
  SELECT *, CASE WHEN later AND NOT fine THEN 1 WHEN later AND d * (o - s0) <= 0 THEN 2 WHEN later AND d * (o - p1_price) >= 0 THEN 3 WHEN later AND minute >= exit_due THEN 4
    WHEN later AND minute >= over THEN 5 WHEN later AND minute >= last_t0 THEN 6 WHEN later AND d * (o - s1) <= 0 THEN 7 WHEN sh THEN 8 WHEN th THEN 9 END AS e FROM mw1),
mw3 AS (SELECT * FROM mw2 WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series, leg_id ORDER BY minute) = 1),
mw4 AS (
  SELECT x.series, x.leg_id, x.d, x.qty, x.entry, x.ref, x.risk0, x.p1_price AS tgt, x.ended_at AS entry_at, CASE WHEN e IN (8, 9) THEN minute + 60000 ELSE minute END AS exit_at,
    ['UNRESOLVED_DATA_GAP', 'STOP', 'TARGET', 'EXIT_STRUCTURE', 'TIME_EXIT', 'END_OF_SEGMENT', 'STOP', 'STOP', 'TARGET'][e] AS reason, e IN (8, 9) AS intrabar, e = 8 AND th AS "both", e = 7 AS at_activation,
    CASE WHEN e < 7 THEN s0 ELSE s1 END AS final_stop, CASE WHEN e = 1 THEN NULL WHEN e < 8 THEN o WHEN e = 8 THEN s1 ELSE x.p1_price END AS xr
  FROM ent x LEFT JOIN mw3 y ON y.series = x.series AND y.leg_id = x.leg_id),
mw5 AS (SELECT *, xr * (1 - d * CAST(0.0003 AS DOUBLE)) AS "exit", tgt * (1 - d * CAST(0.0003 AS DOUBLE)) AS xt, xr * (1 - d * CAST(0.001 AS DOUBLE)) AS xs, ref * (1 + d * CAST(0.001 AS DOUBLE)) AS es FROM mw4),
trd AS (
  SELECT *, d * qty * ("exit" - entry) AS price_pnl, CAST(0.0005 AS DOUBLE) * qty * (entry + "exit") AS fees, d * qty * ("exit" - entry) - CAST(0.0005 AS DOUBLE) * qty * (entry + "exit") AS net,
    CASE WHEN "both" THEN d * qty * (xt - entry) - CAST(0.0005 AS DOUBLE) * qty * (entry + xt) END AS net_target_first, d * qty * (xs - es) - CAST(0.001 AS DOUBLE) * qty * (es + xs) AS stress_net FROM mw5)
"""
ORACLE = {
    "minute_ledger": oracle.decided_sql(
        [_MINUTES, _FILLED, _WALK],
        f"""SELECT series, leg_id, entry_at, exit_at, reason, intrabar, "both", at_activation, {oracle.r6("entry")}, round("exit", 6) AS "exit",
      {oracle.r6("final_stop", "price_pnl", "fees", "net", "net_target_first", "stress_net")}, round(CASE WHEN qty * risk0 > 0 THEN net / (qty * risk0) END, 6) AS net_over_risk FROM trd""",
    ),
    "stop_history": oracle.decided_sql([_MINUTES, _FILLED], f"SELECT series, leg_id, t1 AS valid_from, until AS valid_to, origin, {oracle.r6('stop')} FROM stp"),
}
