"""Known answers and differential checks of the series operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import circular, solar
from gaugeflow.functions.time import civil_to_utc, seconds
from gaugeflow.operators import compare, coupling, grid, imputation, islands, monitoring, prediction, quality, rolling, studies, tests_of_series
from gaugeflow.sources import logger, tables

H = 3600


def series(spark, values, step=H, key="k", start=0, extra=None):
    rows = [(key, start + i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, t long, value double")


def column(df, name):
    return [r[name] for r in df.orderBy("key", "t").collect()]


def gapped(seed, n=400):
    rng = random.Random(seed)
    return [None if rng.random() < 0.1 else rng.gauss(0, 1) for _ in range(n)]


def test_change_stops_at_gaps_eras_and_invalid_rows(spark):
    rows = [("k", t * H, v, e, b) for t, v, e, b in ((0, 10.0, "a", False), (1, 12.0, "a", False), (3, 20.0, "a", False), (4, 23.0, "b", False), (5, 30.0, "b", True), (6, 31.0, "b", False))]
    df = spark.createDataFrame(rows, "key string, t long, value double, era string, bad boolean")
    assert column(df.withColumn("c", rolling.change(["key"], "value", H, "era", "bad")), "c") == [None, 2.0, None, None, None, None]


def test_segments_and_longest_block(spark):
    df = spark.createDataFrame([("k", t * H, v) for t, v in ((0, 1.0), (1, 2.0), (2, None), (3, 3.0), (4, 4.0), (5, 5.0), (9, 1.0))], "key string, t long, value double")
    out = islands.contiguous_segments(df, ["key"], ["value"], H, 2).groupBy("segment").count()
    assert {r["segment"]: r["count"] for r in out.collect()} == {"S001": 2, "S002": 3}
    best = islands.longest_block(df, ["key"], "value", H).first()
    assert (best.start_t, best.end_t, best.n) == (3 * H, 5 * H, 3)
    assert islands.longest_block(df, ["key"], "value", H, "before_next").first().end_t == 8 * H


def test_gap_closure_statuses(spark):
    rows = [("k", i * H, v, c, e) for i, (v, c, e) in enumerate([(1.0, 1.0, "A"), (None, 2.0, "A"), (None, 2.0, "A"), (7.0, 2.0, "A"), (None, None, "A"), (8.0, 1.0, "A"), (None, 1.0, "B"), (9.0, 1.0, "B"), (None, 1.0, "B")])]
    out = islands.gap_closure(spark.createDataFrame(rows, "key string, t long, value double, change double, era string"), ["key"], "value", "change", "era").orderBy("gap").collect()
    assert [r.status for r in out] == ["available", "incomplete_estimates", "cross_era", "unbracketed"]
    assert (out[0].observed, out[0].predicted, out[0].error) == (6.0, 6.0, 0.0)


def test_grid_edges(spark):
    empty = spark.createDataFrame([], "key string, t long, value double")
    assert grid.on_grid(empty, ["key"], H).count() == 0 and islands.gap_table(empty, ["key"], "value", H).count() == 0
    one = series(spark, [None])
    assert islands.gap_table(one, ["key"], "value", H).first().bracketed is False
    filled = grid.interpolate(series(spark, [None, 1, None, None, 4, None]), ["key"])
    assert column(filled, "filled") == [None, 1.0, 2.0, 3.0, 4.0, None]
    assert column(grid.interpolate(series(spark, [None, 1, None, None, 4, None]), ["key"], ends="hold"), "filled") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert seconds("20min") == 1200 and seconds("h") == 3600 and seconds("1D") == 86400
    with pytest.raises(ValueError):
        seconds("3 fortnights")


def test_combine_first_is_idempotent(spark):
    a = spark.createDataFrame([(0, 1.0, None), (1, None, 2.0)], "t long, x double, y double")
    b = spark.createDataFrame([(1, 5.0, 6.0), (2, 7.0, 8.0)], "t long, x double, z double")
    out = grid.combine_first(a, b, ["t"])
    assert sorted(map(tuple, out.collect())) == [(0, 1.0, None, None), (1, 5.0, 2.0, 6.0), (2, 7.0, None, 8.0)]
    assert sorted(map(tuple, grid.combine_first(out, out, ["t"]).collect())) == sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_charts_equal_their_recursions(spark, partitions):
    x = gapped(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = series(spark, x).withColumns({"mu": F.lit(0.1), "sigma": F.lit(1.2)})
    z, up, down, want = 0.1, 0.0, 0.0, []
    for i, v in enumerate(x):
        if i:
            z = z if v is None else 0.2 * v + 0.8 * z
            d = 0.0 if v is None else (v - 0.1) / 1.2
            up, down = max(0.0, up + d - 0.5), max(0.0, down - d - 0.5)
        want.append((z, up, down))
    c = monitoring.cusum(df, ["key"], "value")
    assert np.allclose(column(c, "c_plus"), [w[1] for w in want]) and np.allclose(column(c, "c_minus"), [w[2] for w in want])
    assert np.allclose(column(monitoring.ewma(df, ["key"], "value"), "z"), [w[0] for w in want])
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_joint_alarm_modes(spark):
    df = spark.createDataFrame([("k", i, a, b) for i, (a, b) in enumerate([(True, False), (False, True), (True, True), (True, True)])], "key string, t long, a boolean, b boolean")
    assert column(monitoring.joint_alarm(df, ["key"], "a", "b", 2), "alarm") == [False, False, False, True]
    assert column(monitoring.joint_alarm(df, ["key"], "a", "b", 2, "coincidence"), "alarm") == [False, True, True, True]


def test_neighbour_spikes_as_by_hand(spark):
    x = gapped(5)
    kept = [(i, v) for i, v in enumerate(x) if v is not None]
    want = []
    for p, (_, v) in enumerate(kept):
        near = sorted([w for _, w in kept[max(0, p - 7) : p]] + [w for _, w in kept[p + 1 : p + 8]])
        want.append(len(near) >= 3 and abs(v - float(np.median(near))) > 1.5)
    assert column(quality.neighbour_spikes(series(spark, x), ["key"], "value", 1.5), "spike") == want


def test_even_window_has_its_extra_row_before(spark):
    out = series(spark, range(8)).withColumn("m", rolling.centred_mean(["key"], "value", 4, 4))
    assert column(out, "m") == [None, None, 1.5, 2.5, 3.5, 4.5, 5.5, None]


def test_circular(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "a double")
    assert abs(math.sin(math.radians(df.agg(circular.circular_mean(F.col("a"))).first()[0]))) < 1e-9
    d = spark.createDataFrame([(350.0, 10.0), (190.0, 10.0), (10.0, 190.0)], "a double, b double")
    assert [r[0] for r in d.select(circular.circular_difference(F.col("a"), F.col("b"))).collect()] == [-20.0, 180.0, 180.0]
    assert [r[0] for r in spark.createDataFrame([(" nne ",), ("x",), (None,)], "c string").select(circular.compass_degrees(F.col("c"))).collect()] == [22.5, None, None]


def test_civil_time(spark):
    stamps = ["2025-01-15 12:00:00", "2025-07-15 12:00:00", "2025-10-26 02:30:00", "2025-03-30 02:30:00"]
    out = spark.createDataFrame([(s,) for s in stamps], "s string").select(civil_to_utc(F.to_timestamp("s"), "Europe/Rome").cast("string")).collect()
    assert [r[0] for r in out] == ["2025-01-15 11:00:00", "2025-07-15 10:00:00", None, "2025-03-30 01:00:00"]


def test_solar_geometry(spark):
    noon, midnight = 1718971200 - 4600 // 2, 1718928000
    df = spark.createDataFrame([(noon,), (midnight,)], "t long").select(solar.solar_elevation(F.col("t"), 43.35, 12.58).alias("e"), solar.solar_noon(F.col("t"), 12.58).alias("n")).collect()
    assert 65 < df[0].e < 72 and df[1].e < 0 and 10.9 < df[0].n < 11.4


def test_lag_and_filter_are_recovered(spark):
    t = np.arange(24 * 40)
    x = np.sin(2 * np.pi * t / 24) + np.random.default_rng(1).normal(0, 0.5, len(t))
    slow = [x[0]]
    for v in x[1:]:
        slow.append(slow[-1] + (v - slow[-1]) / 9)
    y = -2 * np.concatenate([[np.nan] * 3, slow[:-3]])
    df = spark.createDataFrame([("k", int(i) * H, float(a), None if math.isnan(b) else float(b)) for i, a, b in zip(t, x, y)], "key string, t long, x double, y double")
    scan = coupling.operator_scan(df, ["key"], "y", "x", range(0, 7), [0.0, 4.0, 8.0])
    best = coupling.best_lag(scan, ["key"]).first()
    assert (best.lag, best.tau) == (3, 8.0) and best.r < -0.999
    moved = coupling.thermal_lag(df, ["key"], "x", [8.0]).join(df.select("key", "t", "y"), ["key", "t"]).withColumn("x", F.lag("x", 3).over(rolling.order(["key"])))
    gain = coupling.hac_gain(moved, ["key"], "y", "x").first()
    assert abs(gain.slope + 2) < 1e-6


def test_hac_error_as_by_numpy(spark):
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=300), np.zeros(300)
    for i in range(1, 300):
        e[i] = 0.7 * e[i - 1] + rng.normal()
    y = 1 + 0.5 * x + e
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "key string, t long, x double, y double")
    a = np.column_stack([np.ones(300), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    u = a * (y - a @ beta)[:, None]
    meat = u.T @ u
    for k in range(1, 7):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / 7) * (g + g.T)
    bread = np.linalg.inv(a.T @ a)
    got = coupling.hac_gain(df, ["key"], "y", "x", 6).first()
    assert abs(got.slope - beta[1]) < 1e-9 and abs(got.se - math.sqrt((bread @ meat @ bread)[1, 1])) < 1e-9


def test_scores_and_constant_series(spark):
    df = spark.createDataFrame([(1.0, 1.5, 1.0, 2.0), (2.0, 1.0, 1.5, 2.5), (3.0, 3.0, None, 4.0), (None, 1.0, 0.0, 1.0)], "y double, yhat double, q05 double, q95 double")
    s = prediction.score(df, [], low="q05", high="q95").first()
    assert s.n == 3 and s.mae == 0.5 and abs(s.bias + 0.5 / 3) < 1e-12 and s.r2 == 0.375 and s.coverage == 1.0 and s.width == 1.0
    flat = series(spark, [2.0] * 50).withColumn("x", F.lit(1.0))
    assert coupling.lag_scan(flat, ["key"], "value", "x", [0, 1]).where(F.col("r").isNotNull()).count() == 0


def test_folds_and_baselines(spark):
    seg = spark.createDataFrame([(f"S{i:03d}",) for i in range(1, 8)], "segment string")
    folds = {r.segment: r.fold for r in prediction.segment_folds(seg, 2, 3).collect()}
    assert folds == {"S001": 0, "S002": 0, "S003": 1, "S004": 1, "S005": 2, "S006": 2, "S007": 3}
    df = series(spark, range(56)).withColumn("segment", F.when(F.col("t") < 28 * H, "S001").otherwise("S002"))
    out = prediction.baselines(df, ["segment"], "value", [1, 25])
    at = lambda m, h, i: out.where((F.col("model") == m) & (F.col("horizon") == h) & (F.col("t") == i * H)).first().yhat
    assert at("persistence", 1, 28) is None and at("persistence", 1, 29) == 28.0 and at("seasonal", 1, 52) == 28.0
    assert out.where((F.col("model") == "seasonal") & (F.col("horizon") == 25) & F.col("yhat").isNotNull()).count() == 0


def test_bootstrap_brackets_the_skill(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(i) * H, float(abs(a)), float(abs(a) / 2)) for i, a in enumerate(rng.normal(size=500))], "t long, p double, c double")
    r = prediction.bootstrap_skill(df, "p", "c", 24 * H, 160).first()
    assert abs(r.skill - 0.5) < 1e-12 and abs(r.q05 - 0.5) < 1e-9 and abs(r.q95 - 0.5) < 1e-9
    assert prediction.bootstrap_skill(df, "p", "c", 24 * H, 160).first() == r


def test_unit_root_and_whiteness(spark):
    rng = np.random.default_rng(7)
    white, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    df = series(spark, white, key="a").unionByName(series(spark, walk, key="b")).unionByName(series(spark, [1.0] * 30, key="c"))
    got = {r.key: r.stationary for r in tests_of_series.adf(df, ["key"], "value").collect()}
    assert got == {"a": True, "b": False, "c": None}
    q = {r.key: r.q for r in tests_of_series.ljung_box(df, ["key"], "value", 10).collect()}
    assert tests_of_series.chi2_tail(q["a"], 10) > 0.01 and tests_of_series.chi2_tail(q["b"], 10) < 1e-6
    assert abs(tests_of_series.chi2_tail(18.307, 10) - 0.05) < 1e-4 and abs(tests_of_series.chi2_tail(3.94, 10) - 0.95) < 1e-3


def test_lomb_scargle_finds_the_day(spark):
    rng = random.Random(1)
    rows = [("k", t, math.sin(2 * math.pi * t / 86400)) for t in sorted(rng.sample(range(0, 40 * 86400), 600))]
    p = tests_of_series.lomb_scargle(spark.createDataFrame(rows, "key string, t long, value double"), ["key"], "value", [6, 12, 24, 48]).orderBy(F.col("power").desc()).first()
    assert p.period_h == 24.0


def test_iterative_imputation_follows_the_driver(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=600)
    y = np.cumsum(d)
    rows = [("k", i * H, None if 300 <= i < 320 else float(v), float(x)) for i, (v, x) in enumerate(zip(y, d))]
    out = imputation.iterative_impute(spark.createDataFrame(rows, "key string, t long, y double, d double"), ["key"], "y", ["d"], (1, 2), penalty=1e-6).orderBy("t").collect()
    assert sum(r.imputed for r in out) == 20 and max(abs(out[i].filled - y[i]) for i in range(300, 320)) < 0.05


def test_iterative_imputation_leaves_rows_without_features_null(spark):
    rng = np.random.default_rng(4)
    d = rng.normal(size=400)
    y = np.cumsum(d)
    rows = [("k", i * H, None if 200 <= i < 210 else float(v), None if i == 204 else float(x)) for i, (v, x) in enumerate(zip(y, d))]
    df = spark.createDataFrame(rows, "key string, t long, y double, d double")
    out = imputation.iterative_impute(df, ["key"], "y", ["d"], (), penalty=1e-6).orderBy("t").collect()
    assert out[204].filled is None and not out[204].imputed and sum(r.imputed for r in out) == 9
    missed = y[204] - y[203]  # the change of the hour without a driver isn't made up
    assert max(abs(out[i].filled - (y[i] - (missed if i > 204 else 0))) for i in range(200, 210) if i != 204) < 0.05
    late = df.where("t < 200 * 3600 or t >= 260 * 3600").unionByName(df.where(f"t = {260 * H}").selectExpr("key", f"{255 * H}L AS t", "null AS y", "d"))
    assert imputation.iterative_impute(late, ["key"], "y", ["d"], (), penalty=1e-6).where(f"t = {255 * H}").first().filled is None


def test_solar_noon_is_one_hour_per_day(spark):
    days = spark.range(0, 24).select((F.lit(1718928000) + F.col("id") * H).alias("t")).select(F.round(solar.solar_noon(F.col("t"), 12.58), 9).alias("n")).distinct().collect()
    gamma = 2 * np.pi / 365 * (173 - 1)
    eot = 229.18 * (0.000075 + 0.001868 * np.cos(gamma) - 0.032077 * np.sin(gamma) - 0.014615 * np.cos(2 * gamma) - 0.040849 * np.sin(2 * gamma))
    assert len(days) == 1 and abs(days[0].n - (720 - 4 * 12.58 - eot) / 60) < 1e-8


def test_rolling_robust_z_is_that_of_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    v = pd.Series(np.where(rng.random(300) < 0.6, np.nan, rng.normal(size=300).round(1)))
    m = v.rolling(25, center=True, min_periods=5).median()
    e = v - m
    s = 1.4826 * e.abs().rolling(25, center=True, min_periods=5).median()
    want = e / s.replace(0.0, np.nan).fillna(e.abs().std())
    rows = [("k", i * H, None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    got = [r.z for r in studies.rolling_robust_z(spark.createDataFrame(rows, "key string, t long, v double"), ["key"], "v").orderBy("t").collect()]
    assert np.allclose([np.nan if z is None else z for z in got], want, equal_nan=True)


def test_conformal_width_is_the_order_statistic(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") > 20, "b").alias("m"), F.lit(0.0).alias("y"), F.round(F.pow(F.rand(7), F.lit(2)), 4).alias("p"))
    rows = rows.unionByName(spark.createDataFrame([("few", 0.0, float(i)) for i in range(8)] + [("few", None, 99.0)], "m string, y double, p double"))
    groups = {}
    for r in rows.collect():
        if r.y is not None:
            groups.setdefault(r.m, []).append(abs(r.y - r.p))
    want = {m: (len(e), sorted(e)[math.ceil((len(e) + 1) * 0.9) - 1] if math.ceil((len(e) + 1) * 0.9) <= len(e) else None) for m, e in groups.items()}
    assert {r.m: (r.n, r.half_width) for r in prediction.conformal_scale(rows, ["m"], "y", "p").collect()} == want and len(want) == 4 and want["few"][1] is None


def test_ranks_over_many_values_are_those_of_one_sort(spark):
    counts = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 4 + 1).alias("__n"))
    got = {r.v: r["__r"] for r in studies._mean_ranks(counts, "v").collect()}
    seen, want = 0, {}
    for r in sorted(counts.collect()):
        seen += r["__n"]
        want[r.v] = seen - (r["__n"] - 1) / 2
    assert got == want


def test_duplicate_policies(spark):
    df = spark.createDataFrame([(0, 0, None), (0, 1, 0.0), (0, 2, 3.0), (1, 0, None), (1, 1, 0.0), (2, 0, None)], "t long, o int, v double")
    get = lambda p: {r.t: r.v for r in quality.merge_duplicates(df, ["t"], ["v"], "o", p).collect()}
    assert get("first_non_null") == {0: 0.0, 1: 0.0, 2: None} and get("first_non_zero") == {0: 3.0, 1: None, 2: None}
    assert get("keep_last") == {0: 3.0, 1: 0.0, 2: None} and get("keep_none") == {2: None}


def test_logger_records(spark):
    current = "21/02/25\t10:20:00" + "\t0" * 12 + "\t12,5\t8.1\t70,2\t1.5\t180,5\t9.4"
    legacy = "05/08/18\t00:20:00" + "\t".join(["", *map(str, range(1, 13))])
    lines = spark.createDataFrame([(current,), (legacy,), ("short\tline",), (current.replace("21/02/25", "xx"),)], "value string")
    rows = logger.parse_records(lines).orderBy("t").collect()
    assert [r.era for r in rows] == ["legacy", "current"] and str(rows[1].ts) == "2025-02-21 10:20:00" and rows[1].sr == 180.5 and rows[1].twall == 9.4 and rows[0].i_3 == 12.0 and rows[0].sr is None


def test_exports_and_stations(spark, tmp_path):
    (tmp_path / "e.csv").write_text("datetime,temperature (degC),relative_humidity (0-1)\n2024-01-01 00:00:00,1.5,0.5\n2024-01-01 00:00:00,9,0.9\n2024-01-01 02:00:00,x,0.7\nbad,1,1\n")
    out = tables.read_export(spark, str(tmp_path / "e.csv"), tables.REANALYSIS).orderBy("t").collect()
    assert [(r.t, r.temp, r.rh) for r in out] == [(1704067200, 1.5, 50.0), (1704074400, None, 70.0)]
    wide = spark.createDataFrame([(0, 1.0, 2.0)], "t long, a double, b double")
    assert sorted(map(tuple, tables.stations(wide, {"s1": {"temp": "a"}, "s2": {"temp": "b", "inc": "a"}}).collect())) == [("s1", 0, 1.0, None), ("s2", 0, 2.0, 1.0)]


def test_agreement_recovers_offset(spark):
    df = spark.createDataFrame([(i * H, float(i % 7), float(i % 7) + 2.5) for i in range(50)], "t long, x double, y double")
    r = compare.agreement(df, "x", "y").first()
    assert (r.n, r.bias, round(r.r, 12)) == (50, 2.5, 1.0)
    cal = compare.calibration(df, "x", "y").first()
    assert abs(cal.slope - 1) < 1e-12 and abs(cal.intercept + 2.5) < 1e-12
