"""Further registered queries of the series operators, on the stand-in series of the catalogue, each with its SQL where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.functions import circular
from gaugeflow.functions.time import HOUR
from gaugeflow.operators import evidence, islands, monitoring, studies
from gaugeflow.plans.catalogue import CUSUM_SQL, E_SQL, GAPS_SQL, NUDGE, ORACLE, P_SQL, U_SQL, by_user, hourly, pair, query, r6, read, referenced


def with_sql(name: str, sql: str) -> None:
    """SQL for a query of the catalogue that had none."""
    ORACLE[name] = sql.replace(", 6)", f" + {NUDGE!r}, 6)")


with_sql(
    "cadence_evidence",
    "WITH ev AS (SELECT event_type AS key, epoch_us(ts) // 1000000 AS t, value FROM events), cb AS (SELECT key, step, t // step * step AS t, avg(value) AS v FROM ev, (VALUES (3600), (21600)) s(step) GROUP BY ALL), "
    "cn AS (SELECT *, CASE WHEN t - lag(t) OVER w = step THEN lag(v) OVER w END AS b FROM cb WINDOW w AS (PARTITION BY key, step ORDER BY t)) "
    "SELECT key, step::INTEGER AS step, count(b) AS n, round(CASE WHEN count(b) >= 3 THEN corr(v, b) END, 6) AS r1, round(stddev_samp(v - b), 6) AS change_sd FROM cn GROUP BY key, step",
)
with_sql(
    "lomb_scargle",
    E_SQL + """, lm AS (SELECT key, avg(value) AS m, var_pop(value) AS vp FROM e GROUP BY key),
lw AS (SELECT e.key, p::DOUBLE AS period_h, vp, value - m AS d, 2 * pi() * t / (p * 3600.0::DOUBLE) AS wt FROM e JOIN lm ON e.key = lm.key, (VALUES (6), (8), (12), (24), (48), (168)) v(p) WHERE value IS NOT NULL AND vp > 0),
lt AS (SELECT key, period_h, atan2(sum(sin(2 * wt)), sum(cos(2 * wt))) / 2 AS ph FROM lw GROUP BY ALL)
SELECT lw.key, lw.period_h, round((power(sum(d * cos(wt - ph)), 2) / sum(power(cos(wt - ph), 2)) + power(sum(d * sin(wt - ph)), 2) / sum(power(sin(wt - ph), 2))) / (2 * any_value(vp)), 6) AS power
FROM lw JOIN lt ON lw.key = lt.key AND lw.period_h = lt.period_h GROUP BY 1, 2""",
)
with_sql(
    "detectability",
    CUSUM_SQL.split(", cz AS")[0] + """, dz AS (SELECT e.key, size, t, row_number() OVER (PARTITION BY e.key, size ORDER BY t) AS i, coalesce((value + size - mu) / sigma, 0) AS z FROM e JOIN rf USING (key), (VALUES (0.0::DOUBLE), (20.0), (60.0)) v(size) WHERE t >= 1705276800),
di AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE z - 0.5 END AS up, CASE WHEN i = 1 THEN 0 ELSE -z - 0.5 END AS dn FROM dz),
ds AS (SELECT *, sum(up) OVER w AS su, sum(dn) OVER w AS sd FROM di WINDOW w AS (PARTITION BY key, size ORDER BY t ROWS UNBOUNDED PRECEDING)),
dc AS (SELECT *, su - least(0, min(su) OVER w) > 5 OR sd - least(0, min(sd) OVER w) > 5 AS alarm FROM ds WINDOW w AS (PARTITION BY key, size ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT key, size, (min(i) FILTER (alarm))::INTEGER AS delay_rows FROM dc GROUP BY key, size""",
)


@query(E_SQL + ", dd AS (SELECT DISTINCT t // 86400 AS day FROM e WHERE value > 90) SELECT key, t, value FROM e WHERE t // 86400 IN (SELECT day FROM dd)")
def days_chosen(spark, sf_dir):
    e = hourly(spark, sf_dir)
    return evidence.restrict_to_days(e, e.where(F.col("value") > 90).select(F.floor(F.col("t") / 86400).alias("day"))).select("key", "t", "value")


@query(P_SQL + " SELECT 'x' AS driver, count(x) AS n, round(avg((y IS NULL)::INTEGER) FILTER (x IS NOT NULL), 6) AS share_missing, round(CASE WHEN min((y IS NULL)::INTEGER) FILTER (x IS NOT NULL) < max((y IS NULL)::INTEGER) FILTER (x IS NOT NULL) THEN corr((y IS NULL)::INTEGER, x) END, 6) AS r FROM p")
def missingness(spark, sf_dir):
    return evidence.missingness(pair(spark, sf_dir), "y", ["x"]).withColumns({c: r6(F.col(c)) for c in ("share_missing", "r")})


@query(P_SQL + " SELECT 'x' AS driver, count(y) AS n_response, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(y)::DOUBLE, 6) AS coverage FROM p")
def driver_coverage(spark, sf_dir):
    return evidence.driver_coverage(pair(spark, sf_dir), "y", ["x"]).withColumn("coverage", r6(F.col("coverage")))


@query(U_SQL + GAPS_SQL.format("u", 21600) + " SELECT CASE WHEN hours <= 6 THEN 'short' WHEN hours <= 48 THEN 'medium' ELSE 'longer' END AS class, count(*) AS gaps, sum(hours)::DOUBLE AS hours, max(hours)::DOUBLE AS longest FROM gaps GROUP BY 1")
def gaps_by_class(spark, sf_dir):
    return evidence.gaps_by_class(islands.gap_table(by_user(spark, sf_dir), ["key"], "value", 6 * HOUR), "hours", [("short", 6.0), ("medium", 48.0)])


@query(E_SQL + """, nf AS (SELECT key, t, value, min(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt FROM e)
SELECT nf.key, nf.t, CASE WHEN nt - nf.t <= 21600 THEN nt - nf.t END AS wait, CASE WHEN nt - nf.t <= 21600 THEN e.value END AS next_value FROM nf LEFT JOIN e ON nf.key = e.key AND nf.nt = e.t""")
def nearest_ahead(spark, sf_dir):
    return evidence.nearest_ahead(hourly(spark, sf_dir), ["key"], "value", 6 * HOUR).select("key", "t", "wait", "next_value")


ERA_SQL = E_SQL + """, er AS (SELECT key, count(value) FILTER (t >= 1705276800 - 604800 AND t < 1705276800) AS n_before, count(value) FILTER (t >= 1705276800 AND t < 1705276800 + 604800) AS n_after,
quantile_cont(value, 0.5) FILTER (t >= 1705276800 AND t < 1705276800 + 604800) - quantile_cont(value, 0.5) FILTER (t >= 1705276800 - 604800 AND t < 1705276800) AS off FROM e GROUP BY key)"""


@query(ERA_SQL + ' SELECT key, n_before, n_after, round(off, 6) AS "offset" FROM er')
def era_offset(spark, sf_dir):
    return evidence.era_offset(hourly(spark, sf_dir), ["key"], "value", 1705276800, 7 * 86400).withColumn("offset", r6(F.col("offset")))


@query(ERA_SQL + " SELECT e.key, t, round(value - CASE WHEN t >= 1705276800 THEN coalesce(off, 0) ELSE 0 END, 6) AS joined FROM e JOIN er ON e.key = er.key")
def join_eras(spark, sf_dir):
    return evidence.join_eras(hourly(spark, sf_dir), ["key"], "value", 1705276800, 7 * 86400).select("key", "t", r6(F.col("joined")).alias("joined"))


@query()
def cointegration(spark, sf_dir):
    return evidence.cointegration(pair(spark, sf_dir), ["key"], "y", "x")


W_SQL = "WITH wd AS (SELECT event_type AS key, event_id, radians((event_id * 37 % 360)::DOUBLE) AS a, value AS speed FROM events)"


def winds(spark, sf_dir):
    """A wind per event: direction from the event's number, speed its value."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", (F.col("event_id") * 37 % 360).cast("double").alias("direction"), F.col("value").alias("speed"))


@query(W_SQL + " SELECT event_id, round(sin(a) * speed, 6) AS u, round(cos(a) * speed, 6) AS v FROM wd")
def wind_components(spark, sf_dir):
    u, v = circular.wind_components(F.col("direction"), F.col("speed"))
    return winds(spark, sf_dir).select("event_id", r6(u).alias("u"), r6(v).alias("v"))


@query(W_SQL + " SELECT key, round(degrees(sqrt(-2 * ln(sqrt(power(avg(sin(a)), 2) + power(avg(cos(a)), 2))))), 5) AS spread FROM wd WHERE speed > 50 AND degrees(a) < 200 GROUP BY key")
def circular_spread(spark, sf_dir):
    rows = winds(spark, sf_dir).where((F.col("speed") > 50) & (F.col("direction") < 200))
    return rows.groupBy("key").agg(F.round(circular.circular_std(F.col("direction")), 5).alias("spread"))


@query("WITH s AS (SELECT event_id, (event_id % 20)::INTEGER AS k FROM events) SELECT event_id, CASE WHEN k < 16 THEN 22.5::DOUBLE * k END AS degrees FROM s")
def compass_degrees(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (*circular.SECTORS, "calm", "", " ?", "NNNE")])
    token = F.element_at(names, (F.col("event_id") % 20 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", circular.compass_degrees(F.concat(F.lit(" "), F.lower(token))).alias("degrees"))


RANK_SQL = "WITH rk AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS q, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS p FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)"


@query(RANK_SQL + " SELECT 'l_quantity' AS a, 'l_quantity' AS b, round(corr(q, q), 6) AS r, count(*) AS n FROM rk UNION ALL SELECT 'l_quantity', 'l_extendedprice', round(corr(q, p), 6), count(*) FROM rk UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', round(corr(p, p), 6), count(*) FROM rk")
def spearman_matrix(spark, sf_dir):
    return studies.correlation_matrix(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman").withColumn("r", r6(F.col("r")))


@query("SELECT 'l_tax' AS component, round(var_samp(l_tax) / var_samp(l_quantity), 6) AS share FROM lineitem UNION ALL SELECT 'l_discount', round(var_samp(l_discount) / var_samp(l_quantity), 6) FROM lineitem")
def variance_shares(spark, sf_dir):
    return studies.variance_shares(read(spark, sf_dir, "lineitem"), "l_quantity", ["l_tax", "l_discount"]).withColumn("share", r6(F.col("share")))


@query(P_SQL + " SELECT 'x' AS feature, round(2 * 0.25::DOUBLE * var_pop(x) + 2 * 0.5::DOUBLE * covar_pop(x, y - 20.0::DOUBLE - 0.5::DOUBLE * x), 4) AS increase FROM p WHERE x IS NOT NULL AND y IS NOT NULL")
def permutation_importance(spark, sf_dir):
    return studies.permutation_importance(pair(spark, sf_dir), "y", ["x"], [20.0, 0.5]).withColumn("increase", F.round("increase", 4))


@query(E_SQL + " SELECT key, t, round(value + CASE WHEN t >= 1705276800 THEN 30.0::DOUBLE * least((t - 1705276800) / 86400.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END, 6) AS injected FROM e")
def injected_ramp(spark, sf_dir):
    out = monitoring.inject(hourly(spark, sf_dir), "value", "ramp", 1705276800, 1705276800 + 86400, 30.0)
    return out.select("key", "t", r6(F.col("injected")).alias("injected"))
