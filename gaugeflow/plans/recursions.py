"""Registered queries of operators that run along series: charts with memory, filters, state-space smoothing, splines, with SQL where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions.time import HOUR
from gaugeflow.operators import imputation, kalman, monitoring, scans, spectra
from gaugeflow.plans.catalogue import E_SQL, P_SQL, REF_SQL, hourly, pair, query, r6, referenced
from gaugeflow.plans.evidence import with_sql

Z_SQL = REF_SQL.replace("WITH eb", "WITH RECURSIVE eb", 1) + """, z0 AS (SELECT e.key, e.t, (value - mu) / nullif(sigma, 0) AS z, row_number() OVER (PARTITION BY e.key ORDER BY e.t) AS i FROM e JOIN rf USING (key))"""
EW_SQL = """, ec AS (SELECT key, t, z, i, CASE WHEN z IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE * z END AS s, CASE WHEN z IS NULL THEN 0 ELSE 1 END AS n FROM z0 WHERE i = 1
UNION ALL SELECT z0.key, z0.t, z0.z, z0.i, CASE WHEN z0.z IS NULL THEN s ELSE 0.2::DOUBLE * z0.z + 0.8::DOUBLE * s END, n + CASE WHEN z0.z IS NULL THEN 0 ELSE 1 END FROM ec JOIN z0 ON z0.key = ec.key AND z0.i = ec.i + 1),
ew AS (SELECT key, t, z, CASE WHEN n > 0 THEN s END AS ewma, CASE WHEN n > 0 THEN 3 * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - power(0.8::DOUBLE, 2 * n))) END AS ucl FROM ec)"""
CU_SQL = """, cc AS (SELECT key, t, i, greatest(coalesce(z - 0.5::DOUBLE, 0), 0) AS hi, greatest(coalesce(-z - 0.5::DOUBLE, 0), 0) AS lo FROM z0 WHERE i = 1
UNION ALL SELECT z0.key, z0.t, z0.i, greatest(hi + coalesce(z0.z - 0.5::DOUBLE, 0), 0), greatest(lo + coalesce(-z0.z - 0.5::DOUBLE, 0), 0) FROM cc JOIN z0 ON z0.key = cc.key AND z0.i = cc.i + 1)"""


@query(Z_SQL + EW_SQL + " SELECT key, t, round(ewma, 6) AS ewma, round(ucl, 6) AS ucl, coalesce(abs(ewma) > ucl, false) AS alarm_ewma FROM ew")
def ewma_widening_limits(spark, sf_dir):
    out = monitoring.ewma_chart(referenced(spark, sf_dir), ["key"], "value")
    return out.select("key", "t", r6(F.col("ewma")).alias("ewma"), r6(F.col("ucl")).alias("ucl"), "alarm_ewma")


@query(Z_SQL + CU_SQL + " SELECT key, t, round(hi, 6) AS cusum_high, round(lo, 6) AS cusum_low, hi > 5 OR lo > 5 AS alarm_cusum FROM cc")
def cusum_holding_gaps(spark, sf_dir):
    out = monitoring.cusum_chart(referenced(spark, sf_dir), ["key"], "value", width=7 * 86400)
    return out.select("key", "t", r6(F.col("cusum_high")).alias("cusum_high"), r6(F.col("cusum_low")).alias("cusum_low"), "alarm_cusum")


@query(
    Z_SQL + EW_SQL + CU_SQL + """, bo AS (SELECT ew.key, ew.t, coalesce(abs(ewma) > 0.5 * ucl, false) AS a, hi > 3 OR lo > 3 AS b FROM ew JOIN cc ON ew.key = cc.key AND ew.t = cc.t),
nb AS (SELECT *, bool_or(a) OVER w AS na, bool_or(b) OVER w AS nb FROM bo WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN 43199 PRECEDING AND 43200 FOLLOWING))
SELECT key, t, (a AND nb) OR (b AND na) AS alarm FROM nb"""
)
def coincident_alarms(spark, sf_dir):
    out = monitoring.cusum_chart(monitoring.ewma_chart(referenced(spark, sf_dir), ["key"], "value", width=1.5).drop("z"), ["key"], "value", h=3.0, width=7 * 86400)
    return monitoring.coincident_alarm(out, ["key"], "alarm_ewma", "alarm_cusum").select("key", "t", "alarm")


@query(
    REF_SQL.replace("WITH eb", "WITH RECURSIVE eb", 1) + """, pz AS (SELECT e.key || '|' || size || '|' || hours AS key, e.key AS name, size, hours, e.t,
  (value + CASE WHEN e.t >= 1705276800 AND e.t < 1705276800 + hours * 3600 THEN size ELSE 0 END - mu) / nullif(sigma, 0) AS z FROM e JOIN rf USING (key), (VALUES (10.0::DOUBLE), (40.0)) a(size), (VALUES (6.0::DOUBLE), (72.0)) b(hours)),
z0 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM pz)""" + EW_SQL + CU_SQL + """, fa AS (SELECT key, min(t) AS t FROM ew JOIN cc USING (key, t) WHERE abs(ewma) > ucl AND (hi > 5 OR lo > 5) AND t >= 1705276800 GROUP BY key)
SELECT DISTINCT pz.name AS key, size, hours, fa.t IS NOT NULL AS detected, (fa.t - 1705276800) / 3600.0::DOUBLE AS delay_h FROM pz LEFT JOIN fa ON pz.key = fa.key"""
)
def detectability_by_duration(spark, sf_dir):
    return monitoring.detectability(referenced(spark, sf_dir), ["key"], "value", [10.0, 40.0], [6.0, 72.0], 1705276800)


with_sql(
    "thermal_lag_scan",
    P_SQL.replace("WITH eb", "WITH RECURSIVE eb", 1) + """, tn AS (SELECT t, x, y, row_number() OVER (ORDER BY t) AS i, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t) AS bt, last_value(x IGNORE NULLS) OVER (ORDER BY t) AS bv,
  first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(x IGNORE NULLS) OVER f AS av FROM p WINDOW f AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
tf AS (SELECT t, x, y, i, CASE WHEN bt IS NULL THEN av WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (av - bv) * (t - bt) / (ft - bt) END AS full_x FROM tn),
tr AS (SELECT i, tau, t, x, y, full_x AS s FROM tf, (VALUES (0.0::DOUBLE), (4.0), (8.0)) v(tau) WHERE i = 1
  UNION ALL SELECT f.i, r.tau, f.t, f.x, f.y, CASE WHEN r.tau = 0 THEN f.full_x ELSE r.s + (f.full_x - r.s) / (r.tau + 1) END FROM tr r JOIN tf f ON f.i = r.i + 1),
ts AS (SELECT tau, t, y, CASE WHEN x IS NOT NULL THEN s END AS s FROM tr),
tl AS (SELECT tau, lag, y, CASE WHEN lag = 0 THEN s WHEN lag = 1 THEN lag(s) OVER w WHEN lag = 2 THEN lag(s, 2) OVER w ELSE lag(s, 3) OVER w END AS s FROM ts, (VALUES (0), (1), (2), (3)) l(lag) WINDOW w AS (PARTITION BY tau, lag ORDER BY t))
SELECT 'p' AS key, tau, lag, CASE WHEN count(*) FILTER (s IS NOT NULL AND y IS NOT NULL) >= 24 THEN round(corr(s, y), 6) END AS r, count(*) FILTER (s IS NOT NULL AND y IS NOT NULL) AS n FROM tl GROUP BY tau, lag""",
)


@query(
    E_SQL.replace("WITH eb", "WITH RECURSIVE eb", 1) + """, k0 AS (SELECT key, t, value, row_number() OVER (PARTITION BY key ORDER BY t) AS i, avg(value) OVER (PARTITION BY key) AS m0, 100 * var_pop(value) OVER (PARTITION BY key) AS p0 FROM e),
kf AS (SELECT key, 0::BIGINT AS i, any_value(m0) AS m, any_value(p0) AS p FROM k0 GROUP BY key
  UNION ALL SELECT k0.key, k0.i, CASE WHEN value IS NULL THEN m ELSE m + (p + 4.0::DOUBLE) / (p + 104.0::DOUBLE) * (value - m) END, CASE WHEN value IS NULL THEN p + 4.0::DOUBLE ELSE (p + 4.0::DOUBLE) * 100 / (p + 104.0::DOUBLE) END FROM kf JOIN k0 ON k0.key = kf.key AND k0.i = kf.i + 1),
kb AS (SELECT key, i, m, p FROM (SELECT *, max(i) OVER (PARTITION BY key) AS top FROM kf) WHERE i = top
  UNION ALL SELECT kf.key, kf.i, kf.m + kf.p / (kf.p + 4.0::DOUBLE) * (kb.m - kf.m), kf.p + power(kf.p / (kf.p + 4.0::DOUBLE), 2) * (kb.p - kf.p - 4.0::DOUBLE) FROM kb JOIN kf ON kf.key = kb.key AND kf.i = kb.i - 1)
SELECT k0.key, k0.t, k0.value, round(kb.m, 6) AS signal, round(sqrt(kb.p), 6) AS sd FROM k0 JOIN kb ON k0.key = kb.key AND k0.i = kb.i"""
)
def local_level_smoothing(spark, sf_dir):
    out = kalman.smooth(hourly(spark, sf_dir), ["key"], "value", HOUR, (100.0, 4.0, 0.0, 0.0), kalman.Model(False, 24, 0), slots=128)
    return out.select("key", "t", "value", r6(F.col("signal")).alias("signal"), r6(F.col("sd")).alias("sd"))


@query()
def kalman_fill(spark, sf_dir):
    """Level, slope and two daily harmonics, variances fitted per key."""
    return kalman.kalman_fill(hourly(spark, sf_dir), ["key"], "value", HOUR).select("key", "t", "value", "filled", "sd")


@query()
def imputation_uncertainty(spark, sf_dir):
    """Gaps of one series filled from its driver and its own past by 50 resampled models, deviations calibrated on a synthetic gap."""
    return imputation.calibrated_impute(pair(spark, sf_dir), ["key"], "y", ["x"], HOUR, 6, (1, 2), 50)


@query(
    E_SQL.replace("WITH eb", "WITH RECURSIVE eb", 1) + """, s0 AS (SELECT key, t, value AS v, row_number() OVER w AS i, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, value - lag(value) OVER w AS d0, lead(value) OVER w - value AS d1 FROM e WHERE value IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY t)),
s1 AS (SELECT key, t, v, i, CASE WHEN h0 * h1 IS NULL THEN 0 ELSE h0 END::DOUBLE AS a, CASE WHEN h0 * h1 IS NULL THEN 1 ELSE 2 * (h0 + h1) END::DOUBLE AS b, CASE WHEN h0 * h1 IS NULL THEN 0 ELSE h1 END::DOUBLE AS c, CASE WHEN h0 * h1 IS NULL THEN 0 ELSE 6 * (d1 / h1 - d0 / h0) END AS d FROM s0),
sf AS (SELECT key, i, t, v, c / b AS cp, d / b AS dp FROM s1 WHERE i = 1 UNION ALL SELECT s1.key, s1.i, s1.t, s1.v, s1.c / (s1.b - s1.a * sf.cp), (s1.d - s1.a * sf.dp) / (s1.b - s1.a * sf.cp) FROM sf JOIN s1 ON s1.key = sf.key AND s1.i = sf.i + 1),
sb AS (SELECT key, i, t, v, dp AS m FROM (SELECT *, max(i) OVER (PARTITION BY key) AS top FROM sf) WHERE i = top UNION ALL SELECT sf.key, sf.i, sf.t, sf.v, sf.dp - sf.cp * sb.m FROM sb JOIN sf ON sf.key = sb.key AND sf.i = sb.i - 1),
sk AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, lead(m) OVER w AS m1 FROM sb WINDOW w AS (PARTITION BY key ORDER BY t)),
se AS (SELECT e.key, e.t, e.value, v, v1, m, m1, (t1 - sk.t)::DOUBLE AS h, (e.t - sk.t)::DOUBLE AS x FROM e ASOF LEFT JOIN sk ON e.key = sk.key AND e.t >= sk.t)
SELECT key, t, round(coalesce(value, (m * power(h - x, 3) + m1 * power(x, 3)) / (6 * h) + (v / h - m * h / 6) * (h - x) + (v1 / h - m1 * h / 6) * x), 6) AS filled FROM se"""
)
def spline_resampling(spark, sf_dir):
    return scans.spline(hourly(spark, sf_dir), ["key"], "value", 5 * 86400).select("key", "t", r6(F.col("filled")).alias("filled"))


@query(
    E_SQL + """, fn AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, value, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w AS bt, last_value(value IGNORE NULLS) OVER w AS bv,
  first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(value IGNORE NULLS) OVER f AS fv FROM e WINDOW w AS (PARTITION BY key ORDER BY t), f AS (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fi AS (SELECT key, i, n, CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft = bt THEN bv ELSE bv + (fv - bv) * (t - bt) / (ft - bt) END AS y FROM fn),
fs AS (SELECT key, s, i - 24 * s AS k, y FROM fi, range(200) r(s) WHERE i >= 24 * s AND i < 24 * s + 48 AND 24 * s + 48 <= n),
fd AS (SELECT key, s, k, (y - avg(y) OVER (PARTITION BY key, s)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / 48)) AS z FROM fs),
fp AS (SELECT key, s, q, (power(sum(z * cos(2 * pi() * k * q / 48)), 2) + power(sum(z * sin(2 * pi() * k * q / 48)), 2)) * CASE WHEN q = 24 THEN 1 ELSE 2 END / 18.0::DOUBLE AS p FROM fd, range(1, 25) g(q) GROUP BY key, s, q)
SELECT key, 48.0::DOUBLE / q AS period_h, round(avg(p), 6) AS psd, count(*) AS segments FROM fp GROUP BY key, q"""
)
def welch_spectrum(spark, sf_dir):
    return spectra.welch_psd(hourly(spark, sf_dir), ["key"], "value", HOUR, 48).withColumn("psd", r6(F.col("psd")))


@query(
    E_SQL + """, x0 AS (SELECT key, t, (value IS NOT NULL)::INTEGER AS there FROM e), lm AS (SELECT key, avg(there) AS m, var_pop(there) AS vp FROM x0 GROUP BY key),
lw AS (SELECT x0.key, p::DOUBLE AS period_h, vp, there - m AS d, 2 * pi() * t / (p * 3600.0::DOUBLE) AS wt FROM x0 JOIN lm ON x0.key = lm.key, (VALUES (8), (12), (24), (168)) v(p) WHERE vp > 0),
lt AS (SELECT key, period_h, atan2(sum(sin(2 * wt)), sum(cos(2 * wt))) / 2 AS ph FROM lw GROUP BY ALL)
SELECT lw.key, lw.period_h, round((power(sum(d * cos(wt - ph)), 2) / sum(power(cos(wt - ph), 2)) + power(sum(d * sin(wt - ph)), 2) / sum(power(sin(wt - ph), 2))) / (2 * any_value(vp)), 6) AS power
FROM lw JOIN lt ON lw.key = lt.key AND lw.period_h = lt.period_h GROUP BY 1, 2"""
)
def sampling_spectrum(spark, sf_dir):
    return spectra.window_spectrum(hourly(spark, sf_dir), ["key"], "value", [8, 12, 24, 168]).withColumn("power", r6(F.col("power")))


@query()
def sliding_harmonics(spark, sf_dir):
    """Weekly and half-weekly components of the hourly series in windows of two weeks."""
    return spectra.sliding_harmonics(hourly(spark, sf_dir), ["key"], "value", HOUR, {"week": 7.0, "half": 3.5}, 14 * 86400, 2 * 86400, 1704067200)


@query()
def phase_lock(spark, sf_dir):
    return spectra.phase_lock(sliding_harmonics(spark, sf_dir), ["key"], ("week", 7.0), ("half", 3.5))
