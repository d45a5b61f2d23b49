"""Registered queries of fill policies, change points and clocks on the stand-in series, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions.time import HOUR
from gaugeflow.operators import grid, policies, rolling
from gaugeflow.plans.catalogue import E_SQL, hourly, query, r6

POLICIES = {"observed": [], "hours": [(2.0, "linear")], "days": [(3.0, "linear"), (48.0, "seasonal")], "careful": [(1.0, None), (6.0, "linear")]}
POLICY_SQL = E_SQL + """, fn AS (SELECT key, t, value, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w AS bt, last_value(value IGNORE NULLS) OVER w AS bv,
  first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(value IGNORE NULLS) OVER f AS fv, lag(value, 24) OVER w AS seasonal, count(value) OVER w AS run
  FROM e WINDOW w AS (PARTITION BY key ORDER BY t), f AS (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS (SELECT key, t, value, seasonal, run, CASE WHEN value IS NOT NULL THEN value ELSE bv + (fv - bv) * (t - bt) / (ft - bt) END AS linear FROM fn),
fg AS (SELECT *, count(*) OVER g AS h, count(linear) OVER g AS nl, count(seasonal) OVER g AS ns FROM fl WINDOW g AS (PARTITION BY key, run, value IS NULL)),
fm AS (SELECT *, CASE WHEN policy = 'hours' AND h <= 2 THEN 'linear' WHEN policy = 'days' AND h <= 3 THEN 'linear' WHEN policy = 'days' AND h <= 48 THEN 'seasonal' WHEN policy = 'careful' AND h > 1 AND h < 7 THEN 'linear' END AS m
  FROM fg, (VALUES ('observed'), ('hours'), ('days'), ('careful')) p(policy)),
fp AS (SELECT policy, key, t, CASE WHEN value IS NOT NULL THEN value WHEN m = 'linear' AND nl = h THEN linear WHEN m = 'seasonal' AND ns = h THEN seasonal END AS value,
  CASE WHEN value IS NOT NULL THEN 'observed' WHEN m = 'linear' AND nl = h OR m = 'seasonal' AND ns = h THEN m END AS method FROM fm)"""


def candidates(spark, sf_dir):
    """The hourly series beside two ways to fill it: a straight line, and the value of the day before."""
    rows = grid.interpolate(hourly(spark, sf_dir), ["key"], "value", out="linear")
    return rows.withColumn("seasonal", F.lag("value", 24).over(rolling.order(["key"])))


def policy_rows(spark, sf_dir):
    return policies.apply_policy(candidates(spark, sf_dir), ["key"], "value", POLICIES, HOUR)


@query(POLICY_SQL + " SELECT policy, key, t, round(value, 6) AS value, method FROM fp")
def fill_by_policy(spark, sf_dir):
    return policy_rows(spark, sf_dir).withColumn("value", r6(F.col("value")))


@query(
    POLICY_SQL + """, fb AS (SELECT *, sum(fresh) OVER (PARTITION BY policy, key ORDER BY t) AS b FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY policy, key ORDER BY t) > 3600 THEN 1 ELSE 0 END AS fresh FROM fp WHERE value IS NOT NULL)),
fs AS (SELECT policy, key, min(t) AS start_t, max(t) AS end_t, count(*) AS n, count(*) FILTER (method <> 'observed') AS f FROM fb GROUP BY policy, key, b),
fo AS (SELECT key, max(n) AS plain FROM fs WHERE policy = 'observed' GROUP BY key), ft AS (SELECT policy, key, count(*) FILTER (method <> 'observed') AS total FROM fp GROUP BY policy, key),
fx AS (SELECT *, row_number() OVER (PARTITION BY policy, key ORDER BY n DESC, start_t) AS k FROM fs)
SELECT policy, key, start_t, end_t, round(n / 24.0::DOUBLE, 6) AS days, round((n - plain) / 24.0::DOUBLE, 6) AS gain_days, f::DOUBLE AS filled_h, round(f / n::DOUBLE, 6) AS fabricated, total::DOUBLE AS filled_total_h
FROM fx JOIN fo USING (key) JOIN ft USING (policy, key) WHERE k = 1"""
)
def stretch_frontier(spark, sf_dir):
    out = policies.stretch_frontier(policy_rows(spark, sf_dir), ["key"], "value", HOUR)
    return out.withColumns({c: r6(F.col(c)) for c in ("days", "gain_days", "fabricated")})


@query(
    E_SQL + """, cp AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM e WHERE value IS NOT NULL),
cw AS (SELECT DISTINCT key, round_even(k / (least(12, n) + 1)::DOUBLE * (n - 1), 0)::BIGINT AS place FROM (SELECT DISTINCT key, n FROM cp), range(1, 13) r(k) WHERE k <= least(12, n))
SELECT cp.key, cp.t FROM cp JOIN cw ON cp.key = cw.key AND cp.place = cw.place"""
)
def covered_changepoints(spark, sf_dir):
    return policies.covered_changepoints(hourly(spark, sf_dir), ["key"], "value", 12, 5 * 86400)


NOON_SQL = E_SQL + """, nd AS (SELECT key, t // 86400 AS day, max(value) AS peak, count(*) FILTER (value > 40) AS n, min(t) FILTER (value > 40) AS a, max(t) FILTER (value > 40) AS b FROM e GROUP BY 1, 2),
ng AS (SELECT *, 2 * 3.141592653589793::DOUBLE / 365.0::DOUBLE * (dayofyear(make_timestamp(day * 86400000000)) - 1) AS g FROM nd WHERE peak >= 60 AND n >= 3),
no AS (SELECT key, day, (a + b - 2 * day * 86400) / 7200.0::DOUBLE - (720 - 4 * 12.58::DOUBLE - 229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g))) / 60 AS o FROM ng)"""


@query(NOON_SQL + " SELECT key, day, round(o, 6) AS offset_h FROM no")
def noon_offsets(spark, sf_dir):
    return policies.noon_offsets(hourly(spark, sf_dir), ["key"], "value", 12.58, 40.0, 60.0).withColumn("offset_h", r6(F.col("offset_h")))


@query(
    NOON_SQL + """, ns AS (SELECT key, day, CASE WHEN count(*) OVER w >= 3 THEN median(o) OVER w END AS s FROM no WINDOW w AS (PARTITION BY key ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
nl AS (SELECT key, day, s, lag(s) OVER w AS b, lag(day) OVER w AS d FROM ns WINDOW w AS (PARTITION BY key ORDER BY day)),
nx AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s - b DESC, day) AS k FROM nl WHERE s - b IS NOT NULL)
SELECT key, d AS before_day, round(b, 6) AS before_h, day AS after_day, round(s, 6) AS after_h FROM nx WHERE k = 1"""
)
def clock_step(spark, sf_dir):
    days = policies.noon_offsets(hourly(spark, sf_dir), ["key"], "value", 12.58, 40.0, 60.0)
    return policies.clock_step(days, ["key"]).withColumns({c: r6(F.col(c)) for c in ("before_h", "after_h")})


@query()
def clock_check(spark, sf_dir):
    """The clocks of three event types against the sun and against a fourth."""
    wide = hourly(spark, sf_dir).groupBy("t").pivot("key", ["view", "click", "purchase", "error"]).agg(F.first("value"))
    return policies.clock_check(wide, ["view", "click", "purchase", "error"], "view", 12.58, 40.0, 60.0, 6)
