"""Recursions along series by blocks of time.

A block of each key is scanned on its own, by window sums; a row per block says how the block changes
the state that enters it, these rows are folded in order, and each block's rows take in what enters.
So a series of any length is spread over tasks: windows are partitioned by (key, block), and only the
rows of blocks, a few hundred times fewer than the series has, meet by key.

All functions want one row per key and time, and blocks long enough in ``step`` to hold several rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Within a block a weight falls to exp(-REACH) at most: far from the ends of doubles, far below their precision.
REACH = 200.0


def _within(keys: Sequence[str]):
    return Window.partitionBy(*keys, "__block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)


def _block(width: int) -> Column:
    return F.floor(F.col("t") / width)


def decayed(df: DataFrame, keys: Sequence[str], states: Mapping[str, tuple[float, Column]], counted: Column, step: int, start: Column, count: str | None = None, slots: int | None = None) -> DataFrame:
    """Adds the states of the recursions ``state = keep * state + amount``, one for each name -> (keep, amount) of ``states``.

    A row where ``counted`` doesn't hold keeps the state. ``start`` (constant within a key) is the state before the first row.
    ``count``: also the number of rows counted so far. ``keep`` lies between 0 and 1, both left out. ``slots``: rows per block.
    """
    if not all(0 < keep < 1 for keep, _ in states.values()):
        raise ValueError("each share that is kept must lie between 0 and 1")
    most = max(1, min(int(REACH / -log(keep)) for keep, _ in states.values()))
    width = step * max(1, min(most, slots or 1 << 16))
    w = _within(keys)
    rows = df.withColumns({"__block": _block(width), "__start": start.cast("double"), "__on": F.coalesce(counted, F.lit(False))})
    rows = rows.withColumns({f"__amount_{name}": F.when(F.col("__on"), amount) for name, (_, amount) in states.items()})
    rows = rows.withColumn("__count", F.sum(F.col("__on").cast("long")).over(w))
    own = {}
    for name, (keep, _) in states.items():
        weighed = F.sum(F.col(f"__amount_{name}") * F.pow(F.lit(keep), -F.col("__count"))).over(w)
        state = F.coalesce(F.pow(F.lit(keep), F.col("__count")) * weighed, F.lit(0.0))
        too_many = F.raise_error(F.lit(f"rows closer together than {step} s: more than a block can hold"))
        own[f"__own_{name}"] = F.when(F.col("__count") <= int(3 * REACH / -log(keep)), state).otherwise(too_many.cast("double"))
    rows = rows.withColumns(own).drop(*[f"__amount_{name}" for name in states])
    ends = rows.groupBy(*keys, "__block").agg(F.max_by(F.struct("__count", *own), "t").alias("__end"), F.any_value("__start").alias("__start"))
    ends = ends.select(*keys, "__block", "__start", "__end.*")
    names, keeps = list(states), [keep for keep, _ in states.values()]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        seen, state, out = 0, {n: pdf["__start"].iloc[0] for n in names}, []
        for block, n, *ownly in zip(pdf["__block"], pdf["__count"], *[pdf[f"__own_{n}"] for n in names]):
            out.append([block, seen, *state.values()])
            seen += n
            state = {k: keep**n * state[k] + x for k, keep, x in zip(names, keeps, ownly)}
        here = pd.DataFrame(out, columns=["__block", "__seen", *[f"__in_{n}" for n in names]])
        for k in keys:
            here[k] = pdf[k].iloc[0]
        return here

    types = dict(df.dtypes)
    schema = ["__block long", "__seen long", *[f"__in_{n} double" for n in names], *[f"`{k}` {types[k]}" for k in keys]]
    carried = ends.groupBy(*keys).applyInPandas(fold, ", ".join(schema))
    joined = rows.join(carried, [*keys, "__block"])
    added = {n: F.pow(F.lit(states[n][0]), F.col("__count")) * F.col(f"__in_{n}") + F.col(f"__own_{n}") for n in names}
    if count is not None:
        added[count] = F.col("__count") + F.col("__seen")
    return joined.withColumns(added).drop("__block", "__start", "__on", "__count", "__seen", *own, *[f"__in_{n}" for n in names])


def reflected(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], width: int) -> DataFrame:
    """Adds the sums ``s = max(0, s + change)`` from 0 on, one for each name -> change of ``sums``; blocks are ``width`` seconds long.

    Within a block the sum is the running total less its running minimum, or what enters plus the total; the same rule folds the blocks.
    """
    w = _within(keys)
    rows = df.withColumns({"__block": _block(width)} | {f"__change_{n}": F.coalesce(change, F.lit(0.0)) for n, change in sums.items()})
    rows = rows.withColumns({f"__total_{n}": F.sum(f"__change_{n}").over(w) for n in sums}).drop(*[f"__change_{n}" for n in sums])
    rows = rows.withColumns({f"__own_{n}": F.col(f"__total_{n}") - F.min(f"__total_{n}").over(w) for n in sums})
    parts = [f"__{what}_{n}" for n in sums for what in ("total", "own")]
    ends = rows.groupBy(*keys, "__block").agg(F.max_by(F.struct(*parts), "t").alias("__end")).select(*keys, "__block", "__end.*")
    order = Window.partitionBy(*keys).orderBy("__block")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({f"__all_{n}": F.sum(f"__total_{n}").over(so_far) for n in sums})
    ends = ends.withColumns({f"__high_{n}": F.col(f"__all_{n}") + F.greatest(F.lit(0.0), F.max(F.col(f"__own_{n}") - F.col(f"__all_{n}")).over(so_far)) for n in sums})
    carried = ends.select(*keys, "__block", *[F.coalesce(F.lag(f"__high_{n}").over(order), F.lit(0.0)).alias(f"__in_{n}") for n in sums])
    joined = rows.join(carried, [*keys, "__block"])
    return joined.withColumns({n: F.greatest(F.col(f"__own_{n}"), F.col(f"__in_{n}") + F.col(f"__total_{n}")) for n in sums}).drop("__block", *parts, *[f"__in_{n}" for n in sums])


def neighbours(df: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """Adds ``__before`` and ``__after``: time and value (t, v) of the nearest row with a value at or before, and at or after, each row."""
    w = Window.partitionBy(*keys, "__block").orderBy("t")
    seen = F.when(F.col(value).isNotNull(), F.struct("t", F.col(value).alias("v")))
    rows = df.withColumn("__block", _block(width))
    rows = rows.withColumn("__before", F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__after", F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    ends = rows.groupBy(*keys, "__block").agg(F.max_by("__before", "t").alias("__last"), F.min_by("__after", "t").alias("__first"))
    order = Window.partitionBy(*keys).orderBy("__block")
    carried = ends.select(
        *keys, "__block",
        F.last("__last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__left"),
        F.first("__first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__right"),
    )
    joined = rows.join(carried, [*keys, "__block"])
    return joined.withColumns({"__before": F.coalesce("__before", "__left"), "__after": F.coalesce("__after", "__right")}).drop("__block", "__left", "__right")


def interpolated(df: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """``value`` linear in time where it is null, the nearest value beyond the first and last one; by blocks of ``width`` seconds. Adds ``filled``."""
    b, a = "__before", "__after"
    share = (F.col("t") - F.col(f"{b}.t")) / (F.col(f"{a}.t") - F.col(f"{b}.t"))
    between = F.col(f"{b}.v") + (F.col(f"{a}.v") - F.col(f"{b}.v")) * share
    filled = F.coalesce(F.col(value), between, F.col(f"{b}.v"), F.col(f"{a}.v"))
    return neighbours(df, keys, value, width).withColumn("filled", filled).drop(b, a)


def tridiagonal(df: DataFrame, keys: Sequence[str], lower: str, diagonal: str, upper: str, right: str, out: str, width: int) -> DataFrame:
    """Adds the solution x of lower[i] x[i-1] + diagonal[i] x[i] + upper[i] x[i+1] = right[i] over each key's rows in order of t.

    Each block of ``width`` seconds is solved for itself as y + l * (last x of the block before) + r * (first x of the block after);
    the first and last rows of blocks give a system of two unknowns a block, which is swept by key. For diagonally dominant rows.
    """
    types = dict(df.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    rows = df.withColumn("__block", _block(width))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        a, b, c, d = (pdf[x].tolist() for x in (lower, diagonal, upper, right))
        n = len(b)
        sides = [[v, 0.0, 0.0] for v in d]
        sides[0][1] -= a[0]
        sides[-1][2] -= c[-1]
        b = list(b)
        for i in range(1, n):
            m = a[i] / b[i - 1]
            b[i] -= m * c[i - 1]
            sides[i] = [v - m * u for v, u in zip(sides[i], sides[i - 1])]
        sides[-1] = [v / b[-1] for v in sides[-1]]
        for i in range(n - 2, -1, -1):
            sides[i] = [(v - c[i] * u) / b[i] for v, u in zip(sides[i], sides[i + 1])]
        y, left, after = zip(*sides)
        return pdf[[*keys, "t", "__block"]].assign(__y=y, __l=left, __r=after)

    own = rows.select(*keys, "t", "__block", *[F.col(x).cast("double").alias(x) for x in (lower, diagonal, upper, right)])
    own = own.groupBy(*keys, "__block").applyInPandas(solve, f"{named}, t long, __block long, __y double, __l double, __r double")
    part = F.struct("__y", "__l", "__r")
    ends = own.groupBy(*keys, "__block").agg(F.min_by(part, "t").alias("__f"), F.max_by(part, "t").alias("__e"))
    ends = ends.select(*keys, "__block", *[F.col(f"__{end}.__{x}").alias(f"__{end}{x}") for end in "fe" for x in "ylr"])

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        alpha = beta = 0.0  # last x of the block before = alpha + beta * first x of this one
        steps = []
        for fy, fl, fr, ey, el, er in zip(*[pdf[f"__{end}{x}"] for end in "fe" for x in "ylr"]):
            scale = 1 / (1 - fl * beta)
            first = ((fy + fl * alpha) * scale, fr * scale)
            steps.append((alpha, beta, first))
            alpha, beta = ey + el * (alpha + beta * first[0]), el * beta * first[1] + er
        after, out_rows = 0.0, []
        for alpha, beta, (p, q) in reversed(steps):
            here = p + q * after
            out_rows.append((alpha + beta * here, after))
            after = here
        return pdf[[*keys, "__block"]].assign(__left=[x for x, _ in out_rows[::-1]], __right=[x for _, x in out_rows[::-1]])

    swept = ends.groupBy(*keys).applyInPandas(sweep, f"{named}, __block long, __left double, __right double")
    solved = own.join(swept, [*keys, "__block"]).select(*keys, "t", (F.col("__y") + F.col("__l") * F.col("__left") + F.col("__r") * F.col("__right")).alias(out))
    return df.join(solved, [*keys, "t"])


def spline(df: DataFrame, keys: Sequence[str], value: str, width: int) -> DataFrame:
    """``value`` by the natural cubic spline through the rows that have one; null beyond the first and the last. Adds ``filled``.

    The second derivatives at the knots solve a tridiagonal system (``tridiagonal``, by blocks of ``width`` seconds).
    """
    w = Window.partitionBy(*keys).orderBy("t")
    knots = df.where(F.col(value).isNotNull()).select(*keys, "t", F.col(value).cast("double").alias("v"))
    knots = knots.withColumns({"__h0": F.col("t") - F.lag("t").over(w), "__h1": F.lead("t").over(w) - F.col("t"), "__d0": F.col("v") - F.lag("v").over(w), "__d1": F.lead("v").over(w) - F.col("v")})
    inner = F.col("__h0").isNotNull() & F.col("__h1").isNotNull()
    knots = knots.select(
        *keys, "t", "v", F.when(inner, F.col("__h0").cast("double")).otherwise(0.0).alias("__a"), F.when(inner, 2.0 * (F.col("__h0") + F.col("__h1"))).otherwise(1.0).alias("__b"),
        F.when(inner, F.col("__h1").cast("double")).otherwise(0.0).alias("__c"), F.when(inner, 6 * (F.col("__d1") / F.col("__h1") - F.col("__d0") / F.col("__h0"))).otherwise(0.0).alias("__d"),
    )
    bent = tridiagonal(knots, keys, "__a", "__b", "__c", "__d", "m", width).select(*keys, "t", F.struct("v", "m").alias("__knot"))
    near = neighbours(df.join(bent, [*keys, "t"], "left"), keys, "__knot", width)
    lo, hi = F.col("__before"), F.col("__after")
    h, x = (hi["t"] - lo["t"]).cast("double"), (F.col("t") - lo["t"]).cast("double")
    y = h - x
    curve = (lo["v"]["m"] * y * y * y + hi["v"]["m"] * x * x * x) / (6 * h) + (lo["v"]["v"] / h - lo["v"]["m"] * h / 6) * y + (hi["v"]["v"] / h - hi["v"]["m"] * h / 6) * x
    return near.withColumn("filled", F.coalesce(F.col(value).cast("double"), F.when(h > 0, curve))).drop("__before", "__after", "__knot")
