"""Registered queries of the series operators on the driver's tables, each with its SQL.

Stand-in series: E is ``events`` averaged per event type and hour (two samples at least, 6 decimals), U per user
and six hours, O the orders per status and day, L the line items per return flag and day. Times are epoch seconds;
what is computed in floating point is rounded to 6 decimals in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions import circular, solar, stats
from gaugeflow.functions.time import DAY, HOUR, epoch, floor_to, month_day_between, season_of
from gaugeflow.operators import compare, coupling, grid, imputation, islands, monitoring, prediction, quality, rolling, studies, tests_of_series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
LATITUDE, LONGITUDE = 43.35, 12.58
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11)}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.replace(", 6)", f" + {NUDGE!r}, 6)")
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Added before rounding in both engines, so that halves, which sums in another order can tip, don't sit on a rounding edge.
NUDGE = 1.23e-8


def r6(c: Column) -> Column:
    return F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", epoch(F.col("ts")).alias("t"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: (key, t, value, n) on the complete hourly grid."""
    out = grid.on_grid(events(spark, sf_dir).select(F.col("event_type").alias("key"), "t", "value"), ["key"], HOUR, least=2)
    return out.select("key", "t", r6(F.col("value")).alias("value"), "n")


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: (key, t, value, n) on the complete six-hour grid of each user."""
    out = grid.on_grid(events(spark, sf_dir).select(F.col("user_id").alias("key"), "t", "value"), ["key"], 6 * HOUR)
    return out.select("key", "t", r6(F.col("value")).alias("value"), "n")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: (key, t, value) mean order price per status and day."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), floor_to(epoch(F.col("o_orderdate")), DAY).alias("t"), "o_totalprice")
    return rows.groupBy("key", "t").agg(r6(F.avg("o_totalprice")).alias("value"))


def daily_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: (key, t, value) mean price of the items shipped per return flag and day."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), floor_to(epoch(F.col("l_shipdate")), DAY).alias("t"), "l_extendedprice")
    return rows.groupBy("key", "t").agg(r6(F.avg("l_extendedprice")).alias("value"))


def pair(spark: SparkSession, sf_dir: str, a: str = "view", b: str = "click") -> DataFrame:
    """Two E series side by side: (key, t, x, y) on the grid of the first."""
    e = hourly(spark, sf_dir)
    left = e.where(F.col("key") == a).select(F.lit("p").alias("key"), "t", F.col("value").alias("y"))
    return left.join(e.where(F.col("key") == b).select("t", F.col("value").alias("x")), "t", "left").select("key", "t", "y", "x")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean prices of orders (x) and of line items (y), all keys together, with season and month."""
    o = daily_orders(spark, sf_dir).groupBy("t").agg(r6(F.avg("value")).alias("x"))
    i = daily_items(spark, sf_dir).groupBy("t").agg(r6(F.avg("value")).alias("y"))
    both = o.join(i, "t", "full_outer").withColumn("month", F.month(F.timestamp_seconds("t")))
    return both.withColumn("season", season_of(F.col("month"), SEASONS)).withColumn("window", F.date_format(F.timestamp_seconds("t"), "yyyy"))


E_SQL = """WITH eb AS (SELECT event_type AS key, (epoch_us(ts) // 1000000) // 3600 * 3600 AS t, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2),
eg AS (SELECT key, unnest(generate_series(lo, hi, 3600)) AS t FROM (SELECT key, min(t) AS lo, max(t) AS hi FROM eb GROUP BY key)),
e AS (SELECT eg.key, eg.t, CASE WHEN n >= 2 THEN round(m, 6) END AS value, coalesce(n, 0) AS n FROM eg LEFT JOIN eb ON eg.key = eb.key AND eg.t = eb.t)"""
U_SQL = """WITH ub AS (SELECT user_id AS key, (epoch_us(ts) // 1000000) // 21600 * 21600 AS t, count(*) AS n, avg(value) AS m FROM events GROUP BY 1, 2),
ug AS (SELECT key, unnest(generate_series(lo, hi, 21600)) AS t FROM (SELECT key, min(t) AS lo, max(t) AS hi FROM ub GROUP BY key)),
u AS (SELECT ug.key, ug.t, round(m, 6) AS value, coalesce(n, 0) AS n FROM ug LEFT JOIN ub ON ug.key = ub.key AND ug.t = ub.t)"""
O_SQL = """WITH o AS (SELECT o_orderstatus AS key, (epoch_us(o_orderdate) // 1000000) // 86400 * 86400 AS t, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1, 2)"""
P_SQL = E_SQL + """, p AS (SELECT 'p' AS key, a.t, a.value AS y, b.value AS x FROM (SELECT * FROM e WHERE key = 'view') a LEFT JOIN (SELECT * FROM e WHERE key = 'click') b ON a.t = b.t)"""
S_SQL = O_SQL + """, l AS (SELECT l_returnflag AS key, (epoch_us(l_shipdate) // 1000000) // 86400 * 86400 AS t, round(avg(l_extendedprice), 6) AS value FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season
  FROM (SELECT coalesce(a.t, b.t) AS t, x, y, month(make_timestamp(coalesce(a.t, b.t) * 1000000)) AS month, strftime(make_timestamp(coalesce(a.t, b.t) * 1000000), '%Y') AS "window"
    FROM (SELECT t, round(avg(value), 6) AS x FROM o GROUP BY t) a FULL JOIN (SELECT t, round(avg(value), 6) AS y FROM l GROUP BY t) b ON a.t = b.t))"""


@query(E_SQL + " SELECT key, t, value, n FROM e")
def resample_min_count(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(E_SQL + " SELECT a.t, a.value AS value, b.value AS click_value FROM e a JOIN e b ON a.t = b.t AND a.key = 'view' AND b.key = 'click'")
def align_inner(spark, sf_dir):
    e = hourly(spark, sf_dir).select("key", "t", "value")
    return grid.align(e.where(F.col("key") == "view").drop("key"), e.where(F.col("key") == "click").drop("key"), ["t"], "click", "inner")


@query(P_SQL + " SELECT key, t, y, x FROM p")
def grid_align_left(spark, sf_dir):
    return pair(spark, sf_dir)


@query(E_SQL + """ SELECT coalesce(a.t, b.t) AS t, coalesce(a.value, b.value) AS value, a.n AS n_a, b.n AS n_b
FROM (SELECT * FROM e WHERE key = 'purchase') a FULL JOIN (SELECT * FROM e WHERE key = 'error') b ON a.t = b.t""")
def combine_first_sources(spark, sf_dir):
    e = hourly(spark, sf_dir)
    a = e.where(F.col("key") == "purchase").select("t", "value", F.col("n").alias("n_a"))
    return grid.combine_first(a, e.where(F.col("key") == "error").select("t", "value", F.col("n").alias("n_b")), ["t"])


DEDUPE_SQL = "WITH d AS (SELECT event_type AS key, (epoch_us(ts) // 1000000) // 60 * 60 AS t, event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS value FROM events) "


def minutes(spark, sf_dir):
    value = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value"))
    return events(spark, sf_dir).select(F.col("event_type").alias("key"), floor_to(F.col("t"), 60).alias("t"), "event_id", value.alias("value"))


@query(DEDUPE_SQL + "SELECT key, t, arg_min(value, event_id) FILTER (value IS NOT NULL) AS value FROM d GROUP BY 1, 2")
def dedupe_first_nonnull(spark, sf_dir):
    return quality.merge_duplicates(minutes(spark, sf_dir), ["key", "t"], ["value"], "event_id")


@query(DEDUPE_SQL + """SELECT key, t, CASE WHEN count(DISTINCT value) > 1 THEN coalesce(arg_min(value, event_id) FILTER (value <> 0), 0.0) ELSE max(CASE WHEN r = 1 THEN value END) END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY key, t ORDER BY event_id) AS r FROM d) GROUP BY 1, 2""")
def dedupe_first_nonzero(spark, sf_dir):
    return quality.merge_duplicates(minutes(spark, sf_dir), ["key", "t"], ["value"], "event_id", "first_non_zero")


@query(DEDUPE_SQL + "SELECT key, t, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY key, t ORDER BY event_id DESC) AS r FROM d) WHERE r = 1")
def dedupe_keep_last(spark, sf_dir):
    return quality.merge_duplicates(minutes(spark, sf_dir), ["key", "t"], ["value"], "event_id", "keep_last")


@query("SELECT event_id, CASE WHEN value = 0.05 THEN 'sentinel' WHEN NOT value BETWEEN 1 AND 200 THEN 'unphysical' ELSE '' END AS flag, CASE WHEN value BETWEEN 1 AND 200 THEN value END AS ok FROM events")
def flag_and_mask(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", quality.flag_sample(v, [0.05], 1, 200).alias("flag"), quality.mask_outside(v, 1, 200).alias("ok"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, CASE WHEN NOT (b > a AND NOT value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) THEN value END AS kept FROM events JOIN q USING (event_type)""")
def iqr_fence(spark, sf_dir):
    return quality.iqr_fence(events(spark, sf_dir), ["event_type"], "value", 1.5).select("event_id", "kept")


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, strftime(o_orderdate, '%m-%d') BETWEEN '03-15' AND '09-20' AS inside FROM orders")
def season_and_month_day(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", season_of(F.month("o_orderdate"), SEASONS).alias("season"), month_day_between(F.col("o_orderdate"), "03-15", "09-20").alias("inside"))


GAPS_SQL = """, gm AS (SELECT *, value IS NULL AS m, min(t) FILTER (value IS NOT NULL) OVER (PARTITION BY key) AS lo, max(t) FILTER (value IS NOT NULL) OVER (PARTITION BY key) AS hi FROM {0}),
gf AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER (PARTITION BY key ORDER BY t), false) THEN 1 ELSE 0 END AS f FROM gm),
gr AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t)::BIGINT AS gap FROM gf),
gaps AS (SELECT key, gap, min(t) AS start_t, max(t) AS end_t, count(*) AS n, (max(t) - min(t) + {1}) / 3600.0::DOUBLE AS hours, coalesce(any_value(lo) < min(t) AND any_value(hi) > max(t), false) AS bracketed FROM gr WHERE m GROUP BY key, gap)"""


@query(E_SQL + GAPS_SQL.format("e", 3600) + " SELECT * FROM gaps")
def gap_table(spark, sf_dir):
    return islands.gap_table(hourly(spark, sf_dir), ["key"], "value", HOUR)


@query(U_SQL + GAPS_SQL.format("u", 21600) + " SELECT CASE WHEN hours > 0 AND hours <= 6 THEN '(0,6]' WHEN hours <= 24 THEN '(6,24]' WHEN hours <= 72 THEN '(24,72]' ELSE '>72' END AS band, count(*) AS gaps, sum(n)::BIGINT AS missing FROM gaps GROUP BY 1")
def gap_bands(spark, sf_dir):
    g = islands.gap_table(by_user(spark, sf_dir), ["key"], "value", 6 * HOUR)
    return g.groupBy(islands.banded(F.col("hours"), [6, 24, 72]).alias("band")).agg(F.count("*").alias("gaps"), F.sum("n").alias("missing"))


@query(U_SQL + GAPS_SQL.format("u", 21600) + """ SELECT key, count(*) AS gaps, sum(n)::BIGINT AS missing, round(avg(hours), 6) AS mean_hours, round(stddev_samp(hours), 6) AS std_hours, min(hours) AS min_hours,
quantile_cont(hours, 0.25) AS q25, quantile_cont(hours, 0.5) AS q50, quantile_cont(hours, 0.75) AS q75, max(hours) AS max_hours FROM gaps GROUP BY key""")
def gap_stats(spark, sf_dir):
    g = islands.gap_statistics(islands.gap_table(by_user(spark, sf_dir), ["key"], "value", 6 * HOUR), ["key"])
    return g.withColumns({c: r6(F.col(c)) for c in ("mean_hours", "std_hours")})


SEG_SQL = """, sf AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) = {1} THEN 0 ELSE 1 END AS f FROM {0} WHERE value IS NOT NULL),
sr AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t) AS run FROM sf),
sl AS (SELECT *, count(*) OVER (PARTITION BY key, run) AS length FROM sr),
seg AS (SELECT key, t, value, n, length, 'S' || lpad((dense_rank() OVER (PARTITION BY key ORDER BY run))::VARCHAR, 3, '0') AS segment FROM sl WHERE length >= {2})"""


@query(U_SQL + SEG_SQL.format("u", 21600, 2) + " SELECT key, t, value, n, length, segment FROM seg")
def contiguous_segments(spark, sf_dir):
    return islands.contiguous_segments(by_user(spark, sf_dir), ["key"], ["value"], 6 * HOUR, 2).select("key", "t", "value", "n", "length", "segment")


BLOCK_SQL = U_SQL + """, bf AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) > 32400 THEN 1 WHEN lag(t) OVER (PARTITION BY key ORDER BY t) IS NULL THEN 1 ELSE 0 END AS f FROM u WHERE value IS NOT NULL),
br AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t) AS b FROM bf),
bb AS (SELECT key, b, min(t) AS start_t, max(t) AS last_t, count(*) AS n FROM br GROUP BY key, b),
be AS (SELECT *, {0} AS end_t FROM bb)
SELECT key, start_t, end_t, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY end_t - start_t DESC, start_t) AS r FROM be) WHERE r = 1"""


@query(BLOCK_SQL.format("last_t"))
def longest_block(spark, sf_dir):
    return islands.longest_block(by_user(spark, sf_dir), ["key"], "value", 6 * HOUR)


@query(BLOCK_SQL.format("coalesce(lead(start_t) OVER (PARTITION BY key ORDER BY start_t) - 21600, last_t)"))
def longest_block_with_gap(spark, sf_dir):
    return islands.longest_block(by_user(spark, sf_dir), ["key"], "value", 6 * HOUR, "before_next")


@query(U_SQL + """, c AS (SELECT key, t // 86400 AS day, count(value) AS n FROM u GROUP BY 1, 2), d AS (SELECT key, day FROM c WHERE n >= 2),
f AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY key ORDER BY day) = 1 THEN 0 ELSE 1 END AS f FROM d), r AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY day)::BIGINT AS run FROM f)
SELECT key, run, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM r GROUP BY key, run""")
def certified_runs(spark, sf_dir):
    census = quality.day_census(by_user(spark, sf_dir), ["key"], "value", 2)
    return islands.certified_runs(census.where(F.col("state") == "certified"), ["key"])


@query(U_SQL + " SELECT key, t // 86400 AS day, count(value) AS n, CASE WHEN count(value) >= 3 THEN 'certified' WHEN count(value) > 0 THEN 'partial' ELSE 'no record' END AS state FROM u GROUP BY 1, 2")
def day_census(spark, sf_dir):
    return quality.day_census(by_user(spark, sf_dir), ["key"], "value", 3)


@query(E_SQL + " SELECT key, t, " + ", ".join(f"round(avg(value) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS value_ma_{n}" for n in (6, 12, 24)) + " FROM e")
def moving_averages(spark, sf_dir):
    out = rolling.moving_averages(hourly(spark, sf_dir), ["key"], "value", [6, 12, 24])
    return out.select("key", "t", *[r6(F.col(f"value_ma_{n}")).alias(f"value_ma_{n}") for n in (6, 12, 24)])


@query(E_SQL + " SELECT key, t, round(value - CASE WHEN count(value) OVER w >= 18 THEN avg(value) OVER w END, 6) AS band FROM e WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)")
def centred_band(spark, sf_dir):
    return rolling.diurnal_band(hourly(spark, sf_dir), ["key"], "value").select("key", "t", r6(F.col("band")).alias("band"))


@query(E_SQL + """, m AS (SELECT *, CASE WHEN count(value) OVER w >= 1 THEN quantile_cont(value, 0.5) OVER w END AS med FROM e WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
d AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mad FROM m)
SELECT key, t, round(med, 6) AS med, round(mad, 6) AS mad, coalesce(abs(value - med) > 3.0 * greatest(1.4826 * mad, 5.0), false) AS spike FROM d""")
def hampel_flags(spark, sf_dir):
    out = quality.hampel(hourly(spark, sf_dir), ["key"], "value", 7, 3.0, 5.0)
    return out.select("key", "t", r6(F.col("med")).alias("med"), r6(F.col("mad")).alias("mad"), "spike")


@query(E_SQL + """, m AS (SELECT key, quantile_cont(value, 0.5) AS med FROM e GROUP BY key), d AS (SELECT key, quantile_cont(abs(value - med), 0.5) AS mad FROM e JOIN m USING (key) GROUP BY key)
SELECT key, t, round((value - med) / (1.4826::DOUBLE * mad), 6) AS z FROM e JOIN m USING (key) JOIN d USING (key)""")
def robust_z(spark, sf_dir):
    return quality.robust_z(hourly(spark, sf_dir), ["key"], "value").select("key", "t", r6(F.col("z")).alias("z"))


@query(E_SQL + """, v AS (SELECT * FROM e WHERE value IS NOT NULL), w AS (SELECT *, count(value) OVER w AS k, quantile_cont(value, 0.5) OVER w AS med FROM v
WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING EXCLUDE CURRENT ROW))
SELECT key, t, round(CASE WHEN k >= 3 THEN med END, 6) AS neighbours, coalesce(CASE WHEN k >= 3 THEN abs(value - med) > 60 END, false) AS spike FROM w""")
def neighbour_spikes(spark, sf_dir):
    return quality.neighbour_spikes(hourly(spark, sf_dir), ["key"], "value", 60.0).select("key", "t", r6(F.col("neighbours")).alias("neighbours"), "spike")


def _r_sql(x: str, y: str, least: int) -> str:
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    a, b = f"CASE WHEN {ok} THEN {x} END", f"CASE WHEN {ok} THEN {y} END"
    return f"CASE WHEN count({a}) >= {least} AND max({a}) > min({a}) AND max({b}) > min({b}) THEN round(corr({a}, {b}), 6) END"


LAGS = [-6, -3, -2, -1, 0, 1, 2, 3, 6, 12, 24]
LAG_SQL = P_SQL + ", g AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, y, {'lag' if k >= 0 else 'lead'}(x, {abs(k)}) OVER (PARTITION BY key ORDER BY t) AS x FROM p" for k in LAGS) + f"), sc AS (SELECT 'p' AS key, lag::INTEGER AS lag, {_r_sql('y', 'x', 24)} AS r, count(CASE WHEN x IS NOT NULL THEN y END) AS n FROM g GROUP BY lag)"


def rounded_scan(spark, sf_dir):
    return coupling.lag_scan(pair(spark, sf_dir), ["key"], "y", "x", LAGS).withColumn("r", r6(F.col("r")))


@query(LAG_SQL + " SELECT key, lag, r, n FROM sc")
def lag_scan(spark, sf_dir):
    return rounded_scan(spark, sf_dir)


@query(LAG_SQL + " SELECT key, lag, r, n FROM sc WHERE r IS NOT NULL ORDER BY abs(r) DESC, lag LIMIT 1")
def best_lag(spark, sf_dir):
    return coupling.best_lag(rounded_scan(spark, sf_dir), ["key"])


@query(P_SQL + ", c AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), g AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, y, lag(x, {k}) OVER (PARTITION BY key ORDER BY t) AS x FROM c" for k in range(0, 13, 3)) + f") SELECT 'p' AS key, lag::INTEGER AS lag, {_r_sql('y', 'x', 100)} AS r, count(x) AS n FROM g GROUP BY lag")
def shift_and_correlate(spark, sf_dir):
    return coupling.lag_scan(pair(spark, sf_dir), ["key"], "y", "x", list(range(0, 13, 3)), 100, compact=True).withColumn("r", r6(F.col("r")))


@query(E_SQL + " SELECT key, t, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3, lead(value, 2) OVER w AS \"value_lag_-2\" FROM e WINDOW w AS (PARTITION BY key ORDER BY t)")
def lag_feature_matrix(spark, sf_dir):
    return rolling.lagged(hourly(spark, sf_dir), ["key"], "value", [1, 3, -2]).select("key", "t", "value_lag_1", "value_lag_3", "value_lag_-2")


@query(P_SQL + ", f AS (SELECT key, t, y, lag(x, 2) OVER (PARTITION BY key ORDER BY t) AS x FROM p) SELECT key, t, y, x FROM f WHERE x IS NOT NULL AND y IS NOT NULL")
def feature_matrix(spark, sf_dir):
    return rolling.feature_matrix(pair(spark, sf_dir), ["key"], "y", {"x": 2})


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr(l_extendedprice, {c})), 6) AS abs_r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")")
def rank_features(spark, sf_dir):
    return coupling.rank_features(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).withColumn("abs_r", r6(F.col("abs_r")))


@query(S_SQL + f""" SELECT season, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(avg(y - x), 3) END AS bias, CASE WHEN count(*) >= 2 THEN round(avg(abs(y - x)), 3) END AS mae, CASE WHEN count(*) >= 2 THEN round(sqrt(avg((y - x) * (y - x))), 3) END AS rmse,
{_r_sql('x', 'y', 2)} AS r FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY GROUPING SETS ((), (season))""")
def pairwise_agreement(spark, sf_dir):
    out = compare.agreement(sources(spark, sf_dir), "x", "y", [(), ("season",)])
    return out.withColumns({"r": r6(F.col("r"))} | {c: F.round(c, 3) for c in ("bias", "mae", "rmse")})


@query(S_SQL + """ SELECT "window", count(*) AS n, round(avg(y - x), 6) AS bias, round(quantile_cont(y - x, 0.25), 6) AS q25, round(quantile_cont(y - x, 0.75), 6) AS q75 FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) >= 100""")
def agreement_stability(spark, sf_dir):
    out = compare.stability(sources(spark, sf_dir), "x", "y", "window", 100)
    return out.withColumns({c: r6(F.col(c)) for c in ("bias", "q25", "q75")})


@query(S_SQL + """ SELECT season, count(*) AS n, round(regr_slope(x, y), 6) AS slope, round(regr_intercept(x, y), 4) AS intercept, round(regr_r2(x, y), 6) AS r2 FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY season""")
def ols_calibration(spark, sf_dir):
    out = compare.calibration(sources(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()), "x", "y", ["season"])
    return out.withColumns({"slope": r6(F.col("slope")), "intercept": F.round("intercept", 4), "r2": r6(F.col("r2"))})


@query(E_SQL + " SELECT key, (t % 86400) / 3600.0::DOUBLE AS hour, count(DISTINCT t // 86400) AS days, CASE WHEN count(DISTINCT t // 86400) >= 3 THEN round(avg(value), 6) END AS mean FROM e WHERE value IS NOT NULL GROUP BY 1, 2")
def diurnal_profile(spark, sf_dir):
    return compare.diurnal_profile(hourly(spark, sf_dir), ["key"], "value", min_days=3).withColumn("mean", r6(F.col("mean")))


@query(E_SQL + """, d AS (SELECT key, t // 86400 AS day, max(value) - min(value) AS rng, arg_max((t % 86400) / 3600.0::DOUBLE, (value, -t)) AS h, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT key, count(*) AS days, round(quantile_cont(rng, 0.5), 6) AS amplitude, round(((degrees(atan2(avg(sin(radians(h * 15))), avg(cos(radians(h * 15))))) + 360) % 360) / 15, 6) AS phase_h FROM d GROUP BY key""")
def daily_amplitude_phase(spark, sf_dir):
    return compare.amplitude_phase(hourly(spark, sf_dir), ["key"], "value", 10).withColumns({c: r6(F.col(c)) for c in ("amplitude", "phase_h")})


@query("""SELECT event_type, round((degrees(atan2(avg(sin(a)), avg(cos(a)))) + 360) % 360, 5) AS mean_deg, round(degrees(sqrt(-2 * ln(greatest(sqrt(power(avg(sin(a)), 2) + power(avg(cos(a)), 2)), 2.220446049250313e-16)))), 5) AS std_deg
FROM (SELECT event_type, radians(((epoch_us(ts) // 1000000) % 86400) / 240.0::DOUBLE) AS a FROM events) GROUP BY 1""")
def circular_mean_hour(spark, sf_dir):
    a = F.pmod(F.col("t"), F.lit(DAY)) / F.lit(240.0)
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(circular.circular_mean(a), 5).alias("mean_deg"), F.round(circular.circular_std(a), 5).alias("std_deg"))


@query("SELECT event_id, round(180 - ((180 - (value - 90)) % 360 + 360) % 360, 6) AS diff, round(sin(radians(value)) * 2, 6) AS u, round(cos(radians(value)) * 2, 6) AS v FROM events")
def circular_difference(spark, sf_dir):
    u, v = circular.wind_components(F.col("value"), F.lit(2.0))
    return events(spark, sf_dir).select("event_id", r6(circular.circular_difference(F.col("value"), F.lit(90.0))).alias("diff"), r6(u).alias("u"), r6(v).alias("v"))


_EOT = "229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g))"
_DEC = "(0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g))"


@query(E_SQL + f""", a AS (SELECT DISTINCT t, 2 * pi() / 365.0 * (dayofyear(make_timestamp(t * 1000000)) - 1 + ((t % 86400) / 3600.0::DOUBLE - 12) / 24) AS g, 2 * pi() / 365.0 * (dayofyear(make_timestamp(t * 1000000)) - 1) AS g0 FROM e),
b AS (SELECT t, (720 - 4 * {LONGITUDE} - {_EOT.replace('(g)', '(g0)').replace('* g)', '* g0)')}) / 60 AS noon, {_DEC} AS d, radians(((t % 86400) / 60.0::DOUBLE + {_EOT} + 4 * {LONGITUDE}) / 4 - 180) AS h FROM a),
c AS (SELECT t, noon, 90 - degrees(acos(greatest(least(sin(radians({LATITUDE})) * sin(d) + cos(radians({LATITUDE})) * cos(d) * cos(h), 1), -1))) AS el FROM b)
SELECT t, round(noon, 5) AS noon, round(el, 5) AS elevation, el > 0 AS daylight FROM c""")
def solar_position(spark, sf_dir):
    t = F.col("t")
    return hourly(spark, sf_dir).select("t").distinct().select("t", F.round(solar.solar_noon(t, LONGITUDE), 5).alias("noon"), F.round(solar.solar_elevation(t, LATITUDE, LONGITUDE), 5).alias("elevation"), solar.is_daylight(t, LATITUDE, LONGITUDE).alias("daylight"))


@query(U_SQL + """ SELECT key, t, round(CASE WHEN t - lag(t) OVER w = 21600 AND (t // 864000) = lag(t // 864000) OVER w AND NOT coalesce(n > 3, true) AND NOT coalesce(lag(n > 3) OVER w, true)
THEN value - lag(value) OVER w END, 6) AS change FROM u WINDOW w AS (PARTITION BY key ORDER BY t)""")
def hourly_change(spark, sf_dir):
    u = by_user(spark, sf_dir).withColumns({"era": F.floor(F.col("t") / 864000), "bad": F.col("n") > 3})
    return u.select("key", "t", r6(rolling.change(["key"], "value", 6 * HOUR, "era", "bad")).alias("change"))


BASE_SQL = U_SQL + SEG_SQL.format("u", 21600, 2) + """, bl AS (
SELECT key, segment, t, value AS y, 'zero' AS model, h AS horizon, 0.0::DOUBLE AS yhat FROM seg, (VALUES (1), (2)) v(h) UNION ALL
SELECT key, segment, t, value, 'persistence', 1, lag(value, 1) OVER w FROM seg WINDOW w AS (PARTITION BY key, segment ORDER BY t) UNION ALL
SELECT key, segment, t, value, 'persistence', 2, lag(value, 2) OVER w FROM seg WINDOW w AS (PARTITION BY key, segment ORDER BY t) UNION ALL
SELECT key, segment, t, value, 'seasonal', h, lag(value, 4) OVER (PARTITION BY key, segment, h ORDER BY t) FROM seg, (VALUES (1), (2)) v(h))"""


def baseline_rows(spark, sf_dir):
    seg = islands.contiguous_segments(by_user(spark, sf_dir), ["key"], ["value"], 6 * HOUR, 2)
    return prediction.baselines(seg, ["key", "segment"], "value", [1, 2], 4)


@query(BASE_SQL + " SELECT key, segment, t, y, model, horizon, yhat FROM bl")
def segment_baselines(spark, sf_dir):
    return baseline_rows(spark, sf_dir)


@query(BASE_SQL + """, z AS (SELECT model, horizon, yhat - y AS e, CASE WHEN yhat IS NOT NULL THEN y END AS v FROM bl)
SELECT model, horizon, count(e) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, CASE WHEN count(e) > 1 AND max(v) > min(v) THEN round(1 - sum(e * e) / (var_pop(v) * count(v)), 6) END AS r2 FROM z GROUP BY 1, 2""")
def score_predictions(spark, sf_dir):
    out = prediction.score(baseline_rows(spark, sf_dir), ["model", "horizon"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mae", "rmse", "bias", "r2")})


@query(U_SQL + SEG_SQL.format("u", 21600, 2) + """, d AS (SELECT DISTINCT key, segment FROM seg), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY segment) AS k FROM d)
SELECT key, segment, CASE WHEN k <= 2 THEN 0 ELSE ntile(3) OVER (PARTITION BY key, k > 2 ORDER BY segment) END::INTEGER AS fold FROM r""")
def segment_folds(spark, sf_dir):
    seg = islands.contiguous_segments(by_user(spark, sf_dir), ["key"], ["value"], 6 * HOUR, 2)
    return prediction.segment_folds(seg, 2, 3, ["key"])


@query(P_SQL + " SELECT t, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 'rich' WHEN y IS NOT NULL THEN 'core' WHEN lag(y) OVER (ORDER BY t) IS NOT NULL THEN 'ar_only' ELSE 'unavailable' END AS route FROM p")
def availability_route(spark, sf_dir):
    p = pair(spark, sf_dir)
    before = rolling.lagged(p, ["key"], "y", [1])
    return before.select("t", prediction.route(F.col("y").isNotNull(), F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("y_lag_1").isNotNull(), "forecast", 6).alias("route"))


@query(E_SQL + """, a AS (SELECT *, CASE WHEN n > 0 THEN round(n * 0.5, 6) END AS change, CASE WHEN t < 1705500000 THEN 'A' ELSE 'B' END AS era, value IS NULL AS m FROM e),
b AS (SELECT *, CASE WHEN m AND NOT coalesce(lag(m) OVER w, false) THEN 1 ELSE 0 END AS f, NOT m AND coalesce(lag(m) OVER w, false) AS r, last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor,
  last_value(CASE WHEN NOT m THEN era END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS era0 FROM a WINDOW w AS (PARTITION BY key ORDER BY t)),
c AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t)::BIGINT AS gap FROM b),
d AS (SELECT key, gap, min(t) FILTER (m) AS start_t, max(t) FILTER (m) AS end_t, count(*) FILTER (m) AS n, (list(anchor ORDER BY t))[1] AS anchor, max(value) FILTER (r) AS rec, count(*) FILTER (change IS NULL) AS unk, sum(change) AS tot, (list(era0 ORDER BY t))[1] AS era0, max(era) FILTER (r) AS era1 FROM c WHERE m OR r GROUP BY key, gap),
s AS (SELECT *, CASE WHEN anchor IS NULL OR rec IS NULL THEN 'unbracketed' WHEN coalesce(era0 <> era1, false) THEN 'cross_era' WHEN unk > 0 THEN 'incomplete_estimates' ELSE 'available' END AS status FROM d)
SELECT key, gap, start_t, end_t, n, status, CASE WHEN status = 'available' THEN round(rec - anchor, 6) END AS observed, CASE WHEN status = 'available' THEN round(tot, 6) END AS predicted, CASE WHEN status = 'available' THEN round(tot - (rec - anchor), 6) END AS error FROM s""")
def gap_closure(spark, sf_dir):
    e = hourly(spark, sf_dir).withColumns({"change": F.when(F.col("n") > 0, F.round(F.col("n") * 0.5, 6)), "era": F.when(F.col("t") < 1705500000, "A").otherwise("B")})
    out = islands.gap_closure(e, ["key"], "value", "change", "era")
    return out.withColumns({c: r6(F.col(c)) for c in ("observed", "predicted", "error")})


REF_SQL = E_SQL + ", rf AS (SELECT key, avg(value) AS mu, stddev_samp(value) AS sigma FROM e WHERE t BETWEEN 1704067200 AND 1705276799 GROUP BY key)"


def referenced(spark, sf_dir):
    e = hourly(spark, sf_dir)
    ref = monitoring.reference_stats(e, ["key"], "value", 1704067200, 1705276799)
    return e.join(ref, "key")


@query(REF_SQL + " SELECT key, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM rf")
def reference_stats(spark, sf_dir):
    ref = monitoring.reference_stats(hourly(spark, sf_dir), ["key"], "value", 1704067200, 1705276799)
    return ref.select("key", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"))


CUSUM_SQL = REF_SQL + """, cz AS (SELECT e.*, mu, sigma, row_number() OVER (PARTITION BY e.key ORDER BY t) AS i, coalesce((value - mu) / sigma, 0) AS z FROM e JOIN rf USING (key)),
ci AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE z - 0.5 END AS up, CASE WHEN i = 1 THEN 0 ELSE -z - 0.5 END AS dn FROM cz),
cs AS (SELECT *, sum(up) OVER w AS su, sum(dn) OVER w AS sd FROM ci WINDOW w AS (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING)),
cc AS (SELECT *, su - least(0, min(su) OVER w) AS c_plus, sd - least(0, min(sd) OVER w) AS c_minus FROM cs WINDOW w AS (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING)),
cu AS (SELECT key, t, value, mu, sigma, i, c_plus, c_minus, c_plus > 5 OR c_minus > 5 AS alarm_cusum FROM cc)"""


@query(CUSUM_SQL + " SELECT key, t, round(c_plus, 6) AS c_plus, round(c_minus, 6) AS c_minus, alarm_cusum FROM cu")
def cusum(spark, sf_dir):
    out = monitoring.cusum(referenced(spark, sf_dir), ["key"], "value")
    return out.select("key", "t", r6(F.col("c_plus")).alias("c_plus"), r6(F.col("c_minus")).alias("c_minus"), "alarm_cusum")


EWMA_SQL = CUSUM_SQL.replace("WITH eb", "WITH RECURSIVE eb", 1) + """, ew AS (SELECT key, t, i, mu, sigma, mu AS z FROM cu WHERE i = 1 UNION ALL
SELECT c.key, c.t, c.i, c.mu, c.sigma, CASE WHEN c.value IS NULL THEN w.z ELSE 0.2 * c.value + 0.8 * w.z END FROM ew w JOIN cu c ON c.key = w.key AND c.i = w.i + 1),
ea AS (SELECT key, t, z, mu - 3 * sigma * sqrt(0.2::DOUBLE / 1.8::DOUBLE) AS lcl, mu + 3 * sigma * sqrt(0.2::DOUBLE / 1.8::DOUBLE) AS ucl FROM ew)"""


@query(EWMA_SQL + " SELECT key, t, round(z, 6) AS z, round(lcl, 6) AS lcl, round(ucl, 6) AS ucl, z < lcl OR z > ucl AS alarm_ewma FROM ea")
def ewma(spark, sf_dir):
    out = monitoring.ewma(referenced(spark, sf_dir), ["key"], "value")
    return out.select("key", "t", *[r6(F.col(c)).alias(c) for c in ("z", "lcl", "ucl")], "alarm_ewma")


def alarms(spark, sf_dir):
    c = monitoring.cusum(referenced(spark, sf_dir), ["key"], "value", h=2.0)
    both = c.withColumn("high", F.coalesce(F.col("value") > F.col("mu"), F.lit(False)))
    return monitoring.joint_alarm(both, ["key"], "alarm_cusum", "high", 2)


JOINT_SQL = CUSUM_SQL + """, ja AS (SELECT key, t, value, sum(CASE WHEN (c_plus > 2 OR c_minus > 2) AND coalesce(value > mu, false) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS alarm FROM cu)"""


@query(JOINT_SQL + " SELECT key, t, alarm FROM ja")
def joint_alarm(spark, sf_dir):
    return alarms(spark, sf_dir).select("key", "t", "alarm")


@query(JOINT_SQL + """, jf AS (SELECT *, CASE WHEN alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY key ORDER BY t), false) THEN 1 ELSE 0 END AS f FROM ja), jr AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t)::BIGINT AS episode FROM jf)
SELECT key, episode, min(t) AS start_t, max(t) AS end_t, count(*) AS rows, round(avg(value), 6) AS mean_value, max(abs(value)) AS max_abs FROM jr WHERE alarm GROUP BY 1, 2""")
def alarm_episodes(spark, sf_dir):
    return islands.episodes(alarms(spark, sf_dir), ["key"], "alarm", "value").withColumn("mean_value", r6(F.col("mean_value")))


FILL_SQL = E_SQL + """, ia AS (SELECT *, count(value) OVER (PARTITION BY key ORDER BY t) AS run,
last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS bt, last_value(value IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt, first_value(value IGNORE NULLS) OVER f AS av FROM e
WINDOW b AS (PARTITION BY key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ib AS (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY key, run) AS length, CASE WHEN value IS NOT NULL THEN value WHEN bt IS NOT NULL AND nt IS NOT NULL THEN bv + (av - bv) * (t - bt) / (nt - bt) END AS full_ FROM ia)"""


@query(FILL_SQL + " SELECT key, t, round(full_, 6) AS filled FROM ib")
def interpolate_time(spark, sf_dir):
    return grid.interpolate(hourly(spark, sf_dir), ["key"]).select("key", "t", r6(F.col("filled")).alias("filled"))


@query(FILL_SQL + " SELECT key, t, round(CASE WHEN value IS NOT NULL OR length <= 2 THEN full_ END, 6) AS filled FROM ib")
def short_gap_fill(spark, sf_dir):
    return grid.interpolate(hourly(spark, sf_dir), ["key"], most=2).select("key", "t", r6(F.col("filled")).alias("filled"))


@query(E_SQL + " SELECT key, t, last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 7200 PRECEDING AND 3600 PRECEDING) AS seed FROM e")
def backward_lookup(spark, sf_dir):
    return hourly(spark, sf_dir).select("key", "t", grid.last_before(["key"], "value", 7200).alias("seed"))


@query(E_SQL + " SELECT key, t, coalesce(CASE WHEN value IS NULL THEN NULL WHEN max(value) OVER w > min(value) OVER w THEN round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) ELSE 0 END, NULL) AS scaled FROM e WINDOW w AS (PARTITION BY key)")
def min_max_scaled(spark, sf_dir):
    return hourly(spark, sf_dir).select("key", "t", r6(rolling.min_max(["key"], "value")).alias("scaled"))


@query(P_SQL + """, rr AS (SELECT arg_min(x, t) FILTER (x IS NOT NULL AND y IS NOT NULL) AS ref FROM p), cp AS (SELECT t, y - (x - ref) * 5.0::DOUBLE AS c FROM p, rr), f AS (SELECT arg_min(c, t) FILTER (c IS NOT NULL) AS f FROM cp)
SELECT t, round(c - f, 6) AS compensated FROM cp, f""")
def compensation(spark, sf_dir):
    return rolling.compensate(pair(spark, sf_dir), ["key"], "y", "x").select("t", r6(F.col("compensated")).alias("compensated"))


@query(U_SQL + " SELECT key, 'value' AS channel, round(avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM u GROUP BY key")
def completeness(spark, sf_dir):
    return quality.completeness(by_user(spark, sf_dir), ["key"], ["value"]).withColumn("share", r6(F.col("share")))


@query(P_SQL + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, t, {c} AS v, min(CASE WHEN {c} IS NOT NULL THEN t END) OVER () AS first_t, max(CASE WHEN {c} IS NOT NULL THEN t END) OVER () AS last_t FROM p" for c in "xy") + """)
SELECT channel, first_t, last_t, count(v) AS n, round(avg(CASE WHEN v IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, min(v) AS low, round(quantile_cont(v, 0.5), 6) AS median, max(v) AS high, count(*) FILTER (NOT v BETWEEN 1 AND 100) AS implausible FROM c WHERE t BETWEEN first_t AND last_t GROUP BY 1, 2, 3""")
def channel_inventory(spark, sf_dir):
    return quality.channel_inventory(pair(spark, sf_dir), {"x": (1.0, 100.0), "y": (1.0, 100.0)}).withColumns({c: r6(F.col(c)) for c in ("coverage", "median")})


@query(P_SQL + " SELECT floor(x / 10)::BIGINT AS bx, floor(y / 10)::BIGINT AS by_, count(*) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2")
def two_d_histogram(spark, sf_dir):
    p = pair(spark, sf_dir).where(stats.both(F.col("x"), F.col("y")))
    return p.groupBy(F.floor(F.col("x") / 10).alias("bx"), F.floor(F.col("y") / 10).alias("by_")).agg(F.count("*").alias("n"))


@query(O_SQL + " SELECT key, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS low, round(quantile_cont(value, 0.5), 4) AS median, max(value) AS high FROM o GROUP BY key")
def describe_orders(spark, sf_dir):
    v = "value"
    return daily_orders(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("low"), F.round(stats.quantile(F.col(v), 0.5), 4).alias("median"), F.max(v).alias("high"))


@query(E_SQL + """, m AS (SELECT key, avg(value) AS m, count(value) AS n FROM e GROUP BY key), d AS (SELECT e.key, t, value - m AS x, n_ AS n FROM e JOIN (SELECT key, m, n AS n_ FROM m) USING (key) WHERE value IS NOT NULL),
g AS (SELECT key, n, x, """ + ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, 6)) + " FROM d WINDOW w AS (PARTITION BY key ORDER BY t)), q AS (SELECT key, n, " + ", ".join(f"sum(x * l{k}) / sum(x * x) AS r{k}" for k in range(1, 6)) + " FROM g GROUP BY 1, 2) SELECT key, n, round(n * (n + 2) * (" + " + ".join(f"r{k} * r{k} / (n - {k})" for k in range(1, 6)) + "), 5) AS q FROM q")
def ljung_box(spark, sf_dir):
    return tests_of_series.ljung_box(hourly(spark, sf_dir), ["key"], "value", 5).withColumn("q", F.round("q", 5))


@query(E_SQL + """, z AS (SELECT avg(value) FILTER (key = 'view') AS a, avg(value) FILTER (key = 'click') AS b, var_samp(value) FILTER (key = 'view') / count(value) FILTER (key = 'view') AS va, var_samp(value) FILTER (key = 'click') / count(value) FILTER (key = 'click') AS vb,
count(value) FILTER (key = 'view') AS na, count(value) FILTER (key = 'click') AS nb FROM e)
SELECT round(a, 6) AS mean_a, round(b, 6) AS mean_b, round((a - b) / sqrt(va + vb), 6) AS t, round(power(va + vb, 2) / (power(va, 2) / (na - 1) + power(vb, 2) / (nb - 1)), 4) AS dof FROM z""")
def welch_t(spark, sf_dir):
    out = tests_of_series.welch_t(hourly(spark, sf_dir), "value", "key", "view", "click")
    return out.select(r6(F.col("mean_a")).alias("mean_a"), r6(F.col("mean_b")).alias("mean_b"), r6(F.col("t")).alias("t"), F.round("dof", 4).alias("dof"))


@query(BASE_SQL + """, z AS (SELECT abs(y - yhat) AS e, count(*) OVER () AS n, row_number() OVER (ORDER BY abs(y - yhat)) AS k FROM bl WHERE model = 'persistence' AND horizon = 1 AND y IS NOT NULL AND yhat IS NOT NULL)
SELECT 'persistence' AS model, any_value(n) AS n, max(CASE WHEN k = ceil((n + 1) * 0.9::DOUBLE) THEN e END) AS half_width FROM z""")
def conformal_band(spark, sf_dir):
    rows = baseline_rows(spark, sf_dir).where((F.col("model") == "persistence") & (F.col("horizon") == 1))
    return prediction.conformal_scale(rows, ["model"], "y", "yhat")


@query()
def thermal_lag_scan(spark, sf_dir):
    return coupling.operator_scan(pair(spark, sf_dir), ["key"], "y", "x", [0, 1, 2, 3], [0.0, 4.0, 8.0]).withColumn("r", r6(F.col("r")))


@query()
def hac_gain(spark, sf_dir):
    out = coupling.hac_gain(pair(spark, sf_dir), ["key"], "y", "x")
    return out.withColumns({c: r6(F.col(c)) for c in ("slope", "intercept", "se", "low", "high", "r")})


@query()
def adf_test(spark, sf_dir):
    return tests_of_series.adf(hourly(spark, sf_dir), ["key"], "value")


@query()
def lomb_scargle(spark, sf_dir):
    return tests_of_series.lomb_scargle(hourly(spark, sf_dir), ["key"], "value", [6, 8, 12, 24, 48, 168]).withColumn("power", r6(F.col("power")))


@query()
def iterative_impute(spark, sf_dir):
    return imputation.iterative_impute(pair(spark, sf_dir), ["key"], "y", [], own_lags=(1, 2))


@query()
def block_bootstrap_skill(spark, sf_dir):
    seg = islands.contiguous_segments(by_user(spark, sf_dir), ["key"], ["value"], 6 * HOUR, 2)
    w = prediction.baselines(seg, ["key", "segment"], "value", [1], 4).where(F.col("model") != "seasonal")
    wide = w.groupBy("key", "segment", "t").agg(*[F.max(F.when(F.col("model") == m, F.col("y") - F.col("yhat"))).alias(a) for m, a in (("zero", "parent"), ("persistence", "child"))])
    return prediction.bootstrap_skill(wide, "parent", "child", DAY)


@query(E_SQL + SEG_SQL.format("e", 3600, 6) + """, k AS (SELECT key, min(t) AS start_t, count(*) AS n, segment FROM seg GROUP BY key, segment), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, start_t) AS r FROM k)
SELECT key, (start_t + floor((n - 6) / 2)::BIGINT * 3600)::BIGINT AS start_t, (start_t + floor((n - 6) / 2)::BIGINT * 3600 + 18000)::BIGINT AS end_t FROM b WHERE r = 1""")
def synthetic_gap(spark, sf_dir):
    return imputation.synthetic_gap(hourly(spark, sf_dir), ["key"], "value", 6, HOUR)


# study operators


@query(U_SQL + """, tf AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) > 64800 OR lag(t) OVER (PARTITION BY key ORDER BY t) IS NULL OR era IS DISTINCT FROM lag(era) OVER (PARTITION BY key ORDER BY t) THEN 1 ELSE 0 END AS f FROM (SELECT *, t // 864000 AS era FROM u) WHERE value IS NOT NULL),
tb AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t) AS b FROM tf), tg AS (SELECT key, b, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM tb GROUP BY key, b HAVING max(t) - min(t) + 21600 >= 43200)
SELECT key, start_t, end_t, n, round(n / ((end_t - start_t) / 21600.0::DOUBLE + 1), 6) AS coverage, row_number() OVER (PARTITION BY key ORDER BY start_t)::INTEGER AS block FROM tg""")
def tolerant_blocks(spark, sf_dir):
    u = by_user(spark, sf_dir).withColumn("era", F.floor(F.col("t") / 864000))
    return studies.tolerant_blocks(u, ["key"], ["value"], 6 * HOUR, 2, 12 * HOUR, "era").withColumn("coverage", r6(F.col("coverage")))


@query(E_SQL + " SELECT key, strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS period, round(avg(CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, count(*) AS slots FROM e GROUP BY 1, 2")
def coverage_by_period(spark, sf_dir):
    return studies.coverage_by_period(hourly(spark, sf_dir), ["key"], "value", "yyyy-MM-dd").withColumn("share", r6(F.col("share")))


@query("""SELECT l_returnflag, channel, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS low, round(quantile_cont(v, 0.5), 6) AS median, max(v) AS high
FROM (SELECT l_returnflag, 'l_quantity' AS channel, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem) GROUP BY 1, 2""")
def summary_by_group(spark, sf_dir):
    out = studies.summary_by_group(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), ["l_returnflag"], ["l_quantity", "l_discount"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "sd", "median")})


ANOMALY_SQL = O_SQL + """, oa AS (SELECT *, month(make_timestamp(t * 1000000)) AS m, day(make_timestamp(t * 1000000)) AS d FROM o), ob AS (SELECT key, m, d, avg(value) AS reference FROM oa WHERE t <= 883612799 GROUP BY 1, 2, 3)
SELECT oa.key, t, value, round(reference, 6) AS reference, round(value - reference, 6) AS anomaly FROM oa LEFT JOIN ob ON oa.key = ob.key AND oa.m = ob.m AND oa.d = ob.d WHERE t BETWEEN 890000000 AND 900000000"""


@query(ANOMALY_SQL)
def climatology_anomaly(spark, sf_dir):
    out = studies.climatology_anomaly(daily_orders(spark, sf_dir), ["key"], "value", 890000000, 900000000, 883612799)
    return out.withColumns({c: r6(F.col(c)) for c in ("reference", "anomaly")})


@query(E_SQL + " SELECT key, strftime(make_timestamp(t * 1000000), '%Y-%m') AS month, count(*) AS n, min(value) AS low, count(DISTINCT t // 86400) AS days FROM e WHERE value < 20 GROUP BY 1, 2")
def excursions_by_month(spark, sf_dir):
    return studies.excursions_by_month(hourly(spark, sf_dir), ["key"], "value", 20.0)


@query(E_SQL + " SELECT key, t // 86400 AS day, max(value) AS peak, round((min(t) FILTER (value > 50) + max(t) FILTER (value > 50) - 2 * (t // 86400) * 86400) / 7200.0::DOUBLE, 6) AS midpoint_h FROM e GROUP BY key, t // 86400 HAVING max(value) >= 100")
def lit_midpoint(spark, sf_dir):
    return studies.lit_midpoint(hourly(spark, sf_dir), ["key"], "value", 50.0, 100.0).withColumn("midpoint_h", r6(F.col("midpoint_h")))


@query(P_SQL + """, mm AS (SELECT var_samp(y) AS va, var_samp(x) AS vb, covar_samp(y, x) AS cab FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT c::DOUBLE AS coefficient, round(va - 2 * c * cab + c * c * vb, 5) AS variance, round(abs((cab - c * vb) / sqrt((va - 2 * c * cab + c * c * vb) * vb)), 6) AS abs_r FROM mm, (VALUES (-1.0::DOUBLE), (-0.5), (0.0), (0.5), (1.0)) v(c)""")
def coefficient_sweep(spark, sf_dir):
    out = studies.coefficient_sweep(pair(spark, sf_dir), "y", "x", [-1.0, -0.5, 0.0, 0.5, 1.0])
    return out.withColumns({"variance": F.round("variance", 5), "abs_r": r6(F.col("abs_r"))})


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for i, a in enumerate(("l_quantity", "l_extendedprice", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_tax")[i:]))
def correlation_matrix(spark, sf_dir):
    return studies.correlation_matrix(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).withColumn("r", r6(F.col("r")))


@query(S_SQL + " SELECT season, count(*) AS n, round(avg(y - x), 3) AS bias, round(stddev_samp(y - x), 3) AS sd, round(avg(y - x) - 1.96 * stddev_samp(y - x), 3) AS low, round(avg(y - x) + 1.96 * stddev_samp(y - x), 3) AS high FROM s WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY season")
def bland_altman(spark, sf_dir):
    out = studies.bland_altman(sources(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull()), "x", "y", ["season"])
    return out.withColumns({c: F.round(c, 3) for c in ("bias", "sd", "low", "high")})


@query(U_SQL + SEG_SQL.format("u", 21600, 1) + """, n AS (SELECT DISTINCT key, segment, length FROM seg)
SELECT p::INTEGER AS lag, h::INTEGER AS horizon, sum(greatest(length - (p + h) + 1, 0))::BIGINT AS windows FROM n, (VALUES (1), (2)) a(p), (VALUES (1), (3)) b(h) GROUP BY 1, 2""")
def segment_survival(spark, sf_dir):
    seg = islands.contiguous_segments(by_user(spark, sf_dir), ["key"], ["value"], 6 * HOUR, 1).select("key", "segment", "length").distinct()
    return studies.segment_survival(seg, [1, 2], [1, 3])


@query()
def couple_strata(spark, sf_dir):
    strata = {"all": F.lit(True), "first_half": F.col("t") < 1705400000}
    return studies.couple(pair(spark, sf_dir).drop("key"), "y", ["x"], [0, 1, 2], [0.0, 4.0], strata)


@query()
def gain_stability(spark, sf_dir):
    out = studies.gain_stability(pair(spark, sf_dir), ["key"], "y", "x", "yyyy-MM")
    return out.withColumns({c: r6(F.col(c)) for c in ("slope", "intercept", "se", "low", "high", "r")})


@query()
def fault_register(spark, sf_dir):
    return studies.fault_register(pair(spark, sf_dir), ["key"], "y", ["x"], 4.0).withColumns({c: r6(F.col(c)) for c in ("z", "step")})


@query()
def fill_benchmark(spark, sf_dir):
    return studies.fill_benchmark(hourly(spark, sf_dir), ["key"], "value", [1, 3], 10)


@query()
def harmonic_fit(spark, sf_dir):
    return studies.harmonic_fit(hourly(spark, sf_dir), ["key"], "value", [12.0, 24.0])


@query()
def detectability(spark, sf_dir):
    return studies.detectability(referenced(spark, sf_dir), ["key"], "value", [0.0, 20.0, 60.0], 1705276800)


@query()
def cadence_evidence(spark, sf_dir):
    return studies.cadence_evidence(events(spark, sf_dir).select(F.col("event_type").alias("key"), "t", "value"), ["key"], "value", [HOUR, 6 * HOUR]).withColumns({c: r6(F.col(c)) for c in ("r1", "change_sd")})


@query()
def seasonal_fill(spark, sf_dir):
    return studies.seasonal_fill(hourly(spark, sf_dir), ["key"], "value").select("key", "t", r6(F.col("filled")).alias("filled"))
