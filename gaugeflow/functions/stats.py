"""Guarded aggregates: null instead of NaN or an error where a statistic isn't defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def n_paired(x: Column, y: Column) -> Column:
    return F.count(F.when(both(x, y), 1))


def correlation(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson's r of complete pairs; null with fewer than ``least`` pairs or a constant side."""
    a, b = F.when(both(x, y), x), F.when(both(x, y), y)
    spread = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when((n_paired(x, y) >= least) & spread, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def slope(y: Column, x: Column) -> Column:
    a, b = F.when(both(x, y), x), F.when(both(x, y), y)
    return F.when(F.max(a) > F.min(a), F.try_divide(F.covar_pop(b, a), F.var_pop(a)))


def quantile(x: Column, p: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(x, F.lit(p))


def error_scores(y: Column, yhat: Column) -> dict[str, Column]:
    """n, mae, rmse, bias and r2 of complete pairs."""
    ok = both(y, yhat)
    e, v = F.when(ok, yhat - y), F.when(ok, y)
    total = F.var_pop(v) * F.count(v)
    return {
        "n": F.count(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "bias": F.avg(e),
        "r2": F.when((F.count(e) > 1) & (F.max(v) > F.min(v)), 1 - F.try_divide(F.sum(e * e), total)),
    }
