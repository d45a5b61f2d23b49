"""Registered queries that regress a series on others over folds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeflow.operators import regression
from gaugeflow.plans.catalogue import E_SQL, P_SQL, hourly, query, r6
from gaugeflow.plans.evidence import with_sql

WIDE_SQL = E_SQL + """, wd AS (SELECT 'v' AS key, a.t, a.value AS y, b.value AS a, c.value AS b FROM (SELECT * FROM e WHERE key = 'view') a
  LEFT JOIN (SELECT * FROM e WHERE key = 'click') b ON a.t = b.t LEFT JOIN (SELECT * FROM e WHERE key = 'purchase') c ON a.t = c.t)"""


def wide(spark, sf_dir):
    """One response and two drivers side by side: (key, t, y, a, b)."""
    e = hourly(spark, sf_dir).select("key", "t", "value")
    out = e.where(F.col("key") == "view").select(F.lit("v").alias("key"), "t", F.col("value").alias("y"))
    for name, key in (("a", "click"), ("b", "purchase")):
        out = out.join(e.where(F.col("key") == key).select("t", F.col("value").alias(name)), "t", "left")
    return out.select("key", "t", "y", "a", "b")


def _fit_sql(source: str, by: str, penalty: float) -> str:
    """Standardised ridge of y on a and b in closed form, per ``by``; a column that doesn't vary gets 0."""
    return f"""SELECT {by}, n, my - b1 * ma - b2 * mb AS b0, b1, b2 FROM (SELECT *, ((n + {penalty}) * g1 - n * r * g2) / (power(n + {penalty}, 2) - power(n * r, 2)) / coalesce(nullif(sa, 0), 1) AS b1,
  ((n + {penalty}) * g2 - n * r * g1) / (power(n + {penalty}, 2) - power(n * r, 2)) / coalesce(nullif(sb, 0), 1) AS b2
  FROM (SELECT {by}, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, coalesce(count(*) * covar_pop(a, y) / nullif(stddev_pop(a), 0), 0) AS g1,
    coalesce(count(*) * covar_pop(b, y) / nullif(stddev_pop(b), 0), 0) AS g2, coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0) AS r FROM {source} GROUP BY {by}))"""


@query(
    WIDE_SQL + f""", s0 AS (SELECT subset, k, t, y, CASE WHEN ua THEN a ELSE 0 END AS a, CASE WHEN ub THEN b ELSE 0 END AS b FROM wd, (VALUES ('a', 1, true, false), ('b', 1, false, true), ('a + b', 2, true, true)) v(subset, k, ua, ub)),
sv AS (SELECT subset, k, avg((a IS NOT NULL AND b IS NOT NULL)::INTEGER) AS availability FROM s0 GROUP BY ALL),
s1 AS (SELECT *, count(*) OVER (PARTITION BY subset) AS n, row_number() OVER (PARTITION BY subset ORDER BY t) - 1 AS place FROM s0 WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
s2 AS (SELECT subset, k, t, y, a, b, CASE WHEN place < n // 2 THEN 0 ELSE least((place - n // 2) // greatest((n - n // 2) // 5, 1) + 1, 5) END AS fold FROM s1 WHERE n >= 100),
tr AS (SELECT f AS fold, subset, y, a, b FROM s2, generate_series(1, 5) g(f) WHERE s2.fold < f),
ft AS ({_fit_sql("tr", "subset, fold", 1.0)}),
pr AS (SELECT s2.*, b0 + b1 * a + b2 * b - y AS e FROM s2 JOIN ft ON s2.subset = ft.subset AND s2.fold = ft.fold WHERE ft.n >= 50),
pf AS (SELECT subset, fold, avg(abs(e)) AS m FROM pr GROUP BY ALL), sd AS (SELECT subset, stddev_pop(m) AS mae_sd FROM pf GROUP BY subset),
al AS ({_fit_sql("s2", "subset", 0.0)}),
bi AS (SELECT s2.subset, count(*) * (ln(2 * pi() * sum(power(y - b0 - b1 * a - b2 * b, 2)) / count(*)) + 1) + (any_value(k) + 1) * ln(count(*)) AS bic FROM s2 JOIN al ON s2.subset = al.subset GROUP BY s2.subset),
ag AS (SELECT subset, k, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / nullif(var_pop(y) * count(*), 0) AS r2, count(*) AS n_test FROM pr GROUP BY ALL)
SELECT 'v' AS key, ag.subset, ag.k, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(mae_sd, 6) AS mae_sd, n_test, round(bic, 4) AS bic, round(availability, 6) AS availability,
       round(min(mae) OVER () / mae * availability, 6) AS utility
FROM ag JOIN sd ON ag.subset = sd.subset JOIN bi ON ag.subset = bi.subset JOIN sv ON ag.subset = sv.subset"""
)
def subset_search(spark, sf_dir):
    out = regression.subset_search(wide(spark, sf_dir), ["key"], "y", ["a", "b"], least=100)
    return out.withColumns({c: r6(F.col(c)) for c in ("mae", "rmse", "r2", "mae_sd", "availability", "utility")} | {"bic": F.round("bic", 4)})


def _folds_sql(train: str) -> str:
    return WIDE_SQL + f""", s2 AS (SELECT t, y, a, b, least(greatest(floor((t - 1705276800) / 259200.0) + 1, 0), 5)::INTEGER AS fold FROM wd WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
tr AS (SELECT f AS fold, y, a, b FROM s2, generate_series(1, 5) g(f) WHERE {train}), ft AS ({_fit_sql("tr", "fold", 1.0)})
SELECT 'v' AS key, s2.fold, t, y, round(b0 + b1 * a + b2 * b, 6) AS yhat FROM s2 JOIN ft ON s2.fold = ft.fold WHERE n >= 50"""


def _predicted(spark, sf_dir, frozen):
    fold = F.least(F.greatest(F.floor((F.col("t") - 1705276800) / 259200) + 1, F.lit(0)), F.lit(5)).cast("int")
    out = regression.fold_predictions(wide(spark, sf_dir).withColumn("fold", fold), ["key"], "fold", "y", ["a", "b"], frozen=frozen)
    return out.select("key", "fold", "t", "y", r6(F.col("yhat")).alias("yhat"))


@query(_folds_sql("s2.fold < f"))
def refitted_folds(spark, sf_dir):
    return _predicted(spark, sf_dir, False)


@query(_folds_sql("s2.fold = 0"))
def frozen_folds(spark, sf_dir):
    return _predicted(spark, sf_dir, True)


@query(
    """WITH li AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS ed FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
dt AS (SELECT *, 1 + 2 * qe * qd * ed - qe * qe - qd * qd - ed * ed AS d FROM li)
SELECT 'l_quantity' AS "column", round((1 - ed * ed) / d, 6) AS vif, round(greatest(abs(qe), abs(qd)), 6) AS max_r, CASE WHEN abs(qe) >= abs(qd) THEN 'l_extendedprice' ELSE 'l_discount' END AS closest FROM dt
UNION ALL SELECT 'l_extendedprice', round((1 - qd * qd) / d, 6), round(greatest(abs(qe), abs(ed)), 6), CASE WHEN abs(qe) >= abs(ed) THEN 'l_quantity' ELSE 'l_discount' END FROM dt
UNION ALL SELECT 'l_discount', round((1 - qe * qe) / d, 6), round(greatest(abs(qd), abs(ed)), 6), CASE WHEN abs(qd) >= abs(ed) THEN 'l_quantity' ELSE 'l_extendedprice' END FROM dt"""
)
def variance_inflation(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return regression.vif(items, ["l_quantity", "l_extendedprice", "l_discount"]).withColumns({c: r6(F.col(c)) for c in ("vif", "max_r")})


def _hac_sql(by: str) -> str:
    """Newey-West gain with 24 lags per ``by``: lag products by a join of row numbers."""
    names = ", ".join(f"a.{c}" for c in by.split(", "))
    same = " AND ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    return P_SQL + f""", hc AS (SELECT key, strftime(make_timestamp(t * 1000000), '%Y-%m') AS "window", t, x, y FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
hf AS (SELECT {by}, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, covar_pop(x, y) AS cxy, var_pop(y) AS vy, covar_pop(x, y) / nullif(var_pop(x), 0) AS slope FROM hc GROUP BY {by} HAVING count(*) >= 3 AND var_pop(x) > 0),
hu AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY t) AS i, (x - mx) * (y - my - slope * (x - mx)) AS g FROM hc JOIN hf USING ({by})),
hm AS (SELECT {names}, sum(a.g * b.g * CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / 25.0::DOUBLE) END) AS meat FROM hu a JOIN hu b ON {same} AND b.i BETWEEN a.i - 24 AND a.i GROUP BY {names}),
hs AS (SELECT *, sqrt(greatest(meat, 0)) / (n * vx) AS se FROM hf JOIN hm USING ({by}))
SELECT {by}, n, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept, round(se, 6) AS se, round(slope - 1.959963984540054::DOUBLE * se, 6) AS low, round(slope + 1.959963984540054::DOUBLE * se, 6) AS high,
  round(CASE WHEN vx * vy > 0 THEN cxy / sqrt(vx * vy) END, 6) AS r FROM hs"""


with_sql("hac_gain", _hac_sql("key"))
with_sql("gain_stability", _hac_sql('key, "window"'))
with_sql(
    "seasonal_fill",
    E_SQL + ", sn AS (SELECT key, t, coalesce(value" + "".join(f", lag(value, {24 * k}) OVER w, lead(value, {24 * k}) OVER w" for k in range(1, 15)) + """) AS s FROM e WINDOW w AS (PARTITION BY key ORDER BY t)),
sb AS (SELECT key, t, s, last_value(CASE WHEN s IS NOT NULL THEN t END IGNORE NULLS) OVER w AS bt, last_value(s IGNORE NULLS) OVER w AS bv, first_value(CASE WHEN s IS NOT NULL THEN t END IGNORE NULLS) OVER f AS ft, first_value(s IGNORE NULLS) OVER f AS fv
  FROM sn WINDOW w AS (PARTITION BY key ORDER BY t), f AS (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT key, t, round(coalesce(s, bv + (fv - bv) * (t - bt) / (ft - bt), bv, fv), 6) AS filled FROM sb""",
)


def _robust_z(c: str, source: str, out: str) -> str:
    frame = "PARTITION BY key ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING"
    return f"""{out}m AS (SELECT *, {c} - CASE WHEN count({c}) OVER w >= 5 THEN median({c}) OVER w END AS e_{c} FROM {source} WINDOW w AS ({frame})),
{out}s AS (SELECT *, CASE WHEN count(e_{c}) OVER w >= 5 THEN 1.4826::DOUBLE * median(abs(e_{c})) OVER w END AS s_{c}, stddev_samp(abs(e_{c})) OVER (PARTITION BY key) AS g_{c} FROM {out}m WINDOW w AS ({frame})),
{out} AS (SELECT *, e_{c} / nullif(CASE WHEN coalesce(s_{c}, 0) > 0 THEN s_{c} ELSE g_{c} END, 0) AS z_{c} FROM {out}s)"""


with_sql(
    "fault_register",
    P_SQL + ", " + _robust_z("y", "p", "fy") + ", " + _robust_z("x", "fy", "fx") + """, fr AS (SELECT *, y - lag(y) OVER w AS step, lead(y) OVER w - y AS back FROM fx WINDOW w AS (PARTITION BY key ORDER BY t))
SELECT key, t, round(z_y, 6) AS z, round(step, 6) AS step, coalesce(abs(z_x) > 4, false)::INTEGER AS corroborating, coalesce(sign(step) <> sign(back) AND abs(back) >= abs(step) / 2, false) AS reverts FROM fr WHERE abs(z_y) > 4""",
)
