"""State-space smoothing of gapped series: level, slope and daily harmonics, with the spread of what is filled.

Series are cut into blocks of slots. What a block does to the state that enters it is a Gaussian
element: a linear map with noise, and what the block's values say of the entering state (Särkkä and
García-Fernández, 2021). Elements are made block by block, folded in order by key (a row per block), and
each block then filters its slots from its own start. Smoothing is the same backwards. So the rows of a
series are spread over tasks however long it is, and blocks of any size give the same result.

A slot without a row, or with a null value, is missing: the state moves on without it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import cos, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators import scans
from gaugeflow.sources.scratch import stored

#: Blocks that one numpy call takes together.
TOGETHER = 64


class Model:
    """Level, slope where ``trend``, and harmonics of a cycle of ``period`` slots. Variances: irregular, level, slope, seasonal."""

    def __init__(self, trend: bool = True, period: int = 24, harmonics: int = 2) -> None:
        turns = [[[cos(a), sin(a)], [-sin(a), cos(a)]] for a in (2 * pi * j / period for j in range(1, harmonics + 1))]
        base = [[1.0, 1.0], [0.0, 1.0]] if trend else [[1.0]]
        self.size = len(base) + 2 * harmonics
        self.move = np.zeros((self.size, self.size))
        self.move[: len(base), : len(base)] = base
        for j, turn in enumerate(turns):
            at = len(base) + 2 * j
            self.move[at : at + 2, at : at + 2] = turn
        self.kinds = [1, 2][: len(base)] + [3] * (2 * harmonics)
        self.seen = np.array([1.0, 0.0][: len(base)] + [1.0, 0.0] * harmonics)

    def noise(self, variances: np.ndarray) -> np.ndarray:
        """(blocks, size, size) of (blocks, 4) variances."""
        return np.eye(self.size) * variances[:, self.kinds][:, None, :]

    def prior(self, mean: float, variance: float) -> tuple[np.ndarray, np.ndarray]:
        """A weak prior before the first slot: the level about the mean of the values, ten of their deviations wide."""
        m = np.zeros(self.size)
        m[0] = mean
        return m, np.diag([100.0, *[1.0] * (self.size - 1)]) * max(variance, 1e-12)


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def _step(model: Model, m: np.ndarray, p: np.ndarray, q: np.ndarray, r: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """One slot: state moved on, then corrected where y is known. Also the gain and the scaled surprise (0 where y is missing)."""
    m, p = m @ model.move.T, model.move @ p @ model.move.T + q
    known = ~np.isnan(y)
    pz = p @ model.seen
    s = pz @ model.seen + r
    gain = np.where(known[:, None], pz / s[:, None], 0.0)
    surprise = np.where(known, y - m @ model.seen, 0.0)
    return m + gain * surprise[:, None], p - gain[:, :, None] * pz[:, None, :], gain, surprise, s


def elements(model: Model, y: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A, b, C, eta, J) of blocks y (blocks, slots): the end is N(A x + b, C) of the entering state x, whose likelihood is exp(eta x - x J x / 2)."""
    n, d = len(y), model.size
    q, r = model.noise(variances), variances[:, 0]
    a, b, c = np.tile(np.eye(d), (n, 1, 1)), np.zeros((n, d)), np.zeros((n, d, d))
    eta, info = np.zeros((n, d)), np.zeros((n, d, d))
    for k in range(y.shape[1]):
        a = model.move @ a
        b, c, gain, surprise, s = _step(model, b, c, q, r, y[:, k])
        za = np.where(np.isnan(y[:, k])[:, None], 0.0, model.seen @ a)
        eta += za * (surprise / s)[:, None]
        info += za[:, :, None] * za[:, None, :] / s[:, None, None]
        a = a - gain[:, :, None] * za[:, None, :]
    return a, b, c, eta, info


def _filtered(model: Model, y: np.ndarray, variances: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = model.noise(variances), variances[:, 0]
    ms, ps = [], []
    for k in range(y.shape[1]):
        m, p, *_ = _step(model, m, p, q, r, y[:, k])
        ms.append(m)
        ps.append(p)
    return np.stack(ms, 1), np.stack(ps, 1)


def _back(model: Model, q: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(E, g, L): the smoothed state of a slot is E x + g with noise L, x that of the next slot."""
    ahead = model.move @ p @ model.move.T + q
    e = _t(np.linalg.solve(ahead, model.move @ p))
    return e, m - (e @ (m @ model.move.T)[..., None])[..., 0], p - e @ ahead @ _t(e)


def backward_elements(model: Model, y: np.ndarray, variances: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """(E, g, L) of whole blocks: from the first slot of the next block to the first of this."""
    q = model.noise(variances)
    ms, ps = _filtered(model, y, variances, m, p)
    e, g, noise = _back(model, q, ms[:, -1], ps[:, -1])
    for k in range(y.shape[1] - 2, -1, -1):
        e1, g1, l1 = _back(model, q, ms[:, k], ps[:, k])
        g, noise, e = (e1 @ g[..., None])[..., 0] + g1, e1 @ noise @ _t(e1) + l1, e1 @ e
    return e, g, noise


def smoothed(model: Model, y: np.ndarray, variances: np.ndarray, m: np.ndarray, p: np.ndarray, next_m: np.ndarray, next_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signal and its deviation (blocks, slots), from the state before each block and the smoothed one after it."""
    q = model.noise(variances)
    ms, ps = _filtered(model, y, variances, m, p)
    signal, spread = np.empty(y.shape), np.empty(y.shape)
    for k in range(y.shape[1] - 1, -1, -1):
        e, g, noise = _back(model, q, ms[:, k], ps[:, k])
        next_m, next_p = (e @ next_m[..., None])[..., 0] + g, e @ next_p @ _t(e) + noise
        signal[:, k], spread[:, k] = next_m @ model.seen, np.sqrt(np.maximum(model.seen @ next_p @ model.seen, 0.0))
    return signal, spread


def likelihoods(model: Model, y: np.ndarray, variances: np.ndarray, m: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one series y for each row of ``variances``: log likelihood with the best common scale of the variances, and that scale."""
    n = len(variances)
    q, r = model.noise(variances), variances[:, 0]
    m, p = np.tile(m, (n, 1)), np.tile(p, (n, 1, 1))
    squares, logs, count = np.zeros(n), np.zeros(n), 0
    for k, v in enumerate(y):
        m, p, _, surprise, s = _step(model, m, p, q, r, np.full(n, v))
        if v == v and k >= model.size:  # the first slots tell of the prior
            squares, logs, count = squares + surprise**2 / s, logs + np.log(s), count + 1
    scale = squares / max(count, 1)
    return -0.5 * (count * np.log(np.maximum(scale, 1e-300)) + logs), scale


def best_variances(model: Model, y: np.ndarray, rounds: int = 6) -> list[float] | None:
    """Variances of greatest likelihood: ratios to the irregular one on a grid of powers of ten, then on ever finer grids around the best."""
    known = y[~np.isnan(y)]
    if len(known) < 3 * model.size or known.var() == 0:
        return None
    kinds = sorted(set(model.kinds))
    m, p = model.prior(known.mean(), known.var())
    centre, width = np.zeros(len(kinds)), 2.0
    tried = np.array([(-1.0, -4.0, -4.0)[k - 1] for k in kinds])
    centre = tried
    for _ in range(rounds):
        steps = np.stack(np.meshgrid(*[[-width, 0.0, width]] * len(kinds)), -1).reshape(-1, len(kinds))
        logs = np.clip(centre + steps, -9, 4)
        variances = np.zeros((len(logs), 4))
        variances[:, 0] = 1.0
        variances[:, kinds] = 10.0**logs
        # the prior is that of the values, in units of the irregular variance of each try
        fit, scale = likelihoods(model, y / np.sqrt(known.var()), variances, m / np.sqrt(known.var()), p / known.var())
        best = int(np.argmax(fit))
        found = variances[best] * scale[best] * known.var()
        moved = not np.allclose(logs[best], centre)
        centre = logs[best]
        width = width if moved else width / 2
    return [float(v) for v in found]


def fit(df: DataFrame, keys: Sequence[str], value: str, step: int, model: Model, context: int = 4000) -> DataFrame:
    """(keys, variances) of greatest likelihood per key, from its stretch of ``context`` slots with most values (the first of equals); null where these are too few.

    Variances say how a series moves from slot to slot, so a bounded stretch tells them; smoothing uses every row.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__part", F.floor(F.col("t") / (step * context)))
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("__n", (-F.col("__part")).alias("__part"))).alias("__b")).select(*keys, (-F.col("__b.__part")).alias("__part"))
    chosen = rows.join(best, [*keys, "__part"]).select(*keys, "t", value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = ((pdf["t"] - pdf["t"].min()) // step).to_numpy()
        y = np.full(at.max() + 1, np.nan)
        y[at] = pdf[value].to_numpy(float)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], best_variances(model, y)]], columns=[*keys, "variances"])

    types = dict(df.dtypes)
    return chosen.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", variances array<double>")


def smooth(df: DataFrame, keys: Sequence[str], value: str, step: int, variances: Sequence[float] | DataFrame, model: Model | None = None, slots: int = 512) -> DataFrame:
    """Rows of ``df`` with ``signal`` (what the model makes of all values of the key) and ``sd``, its deviation, which widens inside gaps.

    ``variances``: irregular, level, slope, seasonal, for all keys or as a table (keys, variances); keys without any stay null.
    One row per key and slot of ``step`` seconds; ``slots``: how many make a block. Blocks and what enters them are written to
    the shared folder, so every step reads them instead of making them again.
    """
    model = model or Model()
    d, types = model.size, dict(df.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    stats = df.groupBy(*keys).agg(F.min("t").alias("__first"), F.max("t").alias("__last"), F.avg(value).alias("__mean"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("__var"))
    if isinstance(variances, DataFrame):
        stats = stats.join(variances.select(*keys, F.col("variances").alias("__v")), list(keys))
    else:
        stats = stats.withColumn("__v", F.array(*[F.lit(float(v)) for v in variances]))
    stats = stored(stats.where(F.col("__v").isNotNull() & F.col("__mean").isNotNull()), "kalman-keys")
    slot = F.floor((F.col("t") - F.col("__first")) / step)
    rows = df.where(F.col(value).isNotNull()).join(stats.select(*keys, "__first"), list(keys))
    packed = rows.groupBy(*keys, F.floor(slot / slots).alias("__block")).agg(F.collect_list(F.struct((slot % slots).cast("int").alias("at"), F.col(value).cast("double").alias("v"))).alias("__y"))
    frame = stats.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__last") - F.col("__first")) / (step * slots)))))
    blocks = frame.join(packed, [*keys, "__block"], "left").select(*keys, "__block", "__first", "__mean", "__var", "__v", F.col("__y.at").alias("__at"), F.col("__y.v").alias("__y"))
    blocks = stored(blocks, "kalman-blocks")

    def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        y = np.full((len(pdf), slots), np.nan)
        for i, (at, v) in enumerate(zip(pdf["__at"], pdf["__y"])):
            if at is not None:
                y[i, np.asarray(at, int)] = v
        return y, np.stack(pdf["__v"])

    def many(batches: Iterator[pd.DataFrame], work) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[low : low + TOGETHER]
                yield part[[*keys, "__block"]].assign(**work(part, *dense(part)))

    def lists(**arrays: np.ndarray) -> dict[str, list]:
        return {f"__{name}": list(x.reshape(len(x), -1)) for name, x in arrays.items()}

    def square(column: pd.Series) -> np.ndarray:
        return np.stack(column).reshape(-1, d, d)

    def make(pdf: pd.DataFrame, y: np.ndarray, v: np.ndarray) -> dict[str, list]:
        return lists(**dict(zip("abcej", elements(model, y, v))))

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        m, p = model.prior(pdf["__mean"].iloc[0], pdf["__var"].iloc[0])
        starts = []
        for a, b, c, e, j in zip(square(pdf["__a"]), pdf["__b"], square(pdf["__c"]), pdf["__e"], square(pdf["__j"])):
            starts.append((m, p.ravel()))
            told = np.linalg.inv(np.eye(d) + p @ j)
            m, p = a @ told @ (m + p @ e) + b, a @ told @ p @ a.T + c
            p = (p + p.T) / 2
            starts[-1] += (m, p.ravel())
        return pdf[[*keys, "__block"]].assign(**{f"__{n}": list(x) for n, x in zip(("m", "p", "em", "ep"), zip(*starts))})

    def turn(pdf: pd.DataFrame, y: np.ndarray, v: np.ndarray) -> dict[str, list]:
        return lists(**dict(zip("egl", backward_elements(model, y, v, np.stack(pdf["__m"]), square(pdf["__p"])))))

    def backward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block", ascending=False)
        m = pdf["__em"].iloc[0] @ model.move.T
        p = model.move @ pdf["__ep"].iloc[0].reshape(d, d) @ model.move.T + model.noise(pdf["__v"].iloc[0][None])[0]
        after = []
        for e, g, noise in zip(square(pdf["__e"]), pdf["__g"], square(pdf["__l"])):
            after.append((m, p.ravel()))
            m, p = e @ m + g, e @ p @ e.T + noise
        return pdf[[*keys, "__block"]].assign(__nm=[x for x, _ in after], __np=[x for _, x in after])

    def finish(pdf: pd.DataFrame, y: np.ndarray, v: np.ndarray) -> dict[str, list]:
        signal, spread = smoothed(model, y, v, np.stack(pdf["__m"]), square(pdf["__p"]), np.stack(pdf["__nm"]), square(pdf["__np"]))
        return lists(signal=signal, sd=spread)

    def schema(names: str) -> str:
        return f"{named}, __block long, " + ", ".join(f"__{n} array<double>" for n in names.split())

    at = [*keys, "__block"]
    made = blocks.mapInPandas(lambda batches: many(batches, make), schema("a b c e j"))
    starts = stored(made.join(stats.select(*keys, "__mean", "__var"), list(keys)).groupBy(*keys).applyInPandas(forward, schema("m p em ep")), "kalman-starts")
    started = blocks.join(starts, at)
    turned = started.mapInPandas(lambda batches: many(batches, turn), schema("e g l"))
    ends = turned.join(starts.select(*at, "__em", "__ep"), at).join(stats.select(*keys, "__v"), list(keys)).groupBy(*keys).applyInPandas(backward, schema("nm np"))
    done = started.join(ends, at).mapInPandas(lambda batches: many(batches, finish), schema("signal sd"))
    one = done.select(*at, F.posexplode(F.arrays_zip("__signal", "__sd")).alias("__k", "__x")).join(stats.select(*keys, "__first"), list(keys))
    out = one.select(*keys, (F.col("__first") + (F.col("__block") * slots + F.col("__k")) * step).alias("t"), F.col("__x.__signal").alias("signal"), F.col("__x.__sd").alias("sd"))
    return df.join(out, [*keys, "t"], "left")


def kalman_fill(df: DataFrame, keys: Sequence[str], value: str, step: int, period: int = 24, harmonics: int = 2, context: int = 4000, slots: int = 512) -> DataFrame:
    """Adds ``filled``, the value or else the smoothed signal, and ``sd`` of what was filled.

    Keys with fewer values than three periods are interpolated in time instead and have no sd.
    """
    model = Model(True, period, harmonics)
    counts = df.groupBy(*keys).agg((F.count(value) >= 3 * period).alias("__enough"))
    rows = scans.interpolated(df, keys, value, step * 4096).withColumnRenamed("filled", "__line").join(counts, list(keys))
    table = fit(df, keys, value, step, model, context).join(counts.where("__enough").select(*keys), list(keys))
    out = smooth(rows, keys, value, step, table, model, slots)
    filled = F.coalesce(F.col(value), F.col("signal"), F.col("__line"))
    return out.withColumns({"filled": filled, "sd": F.when(F.col(value).isNull(), F.col("sd"))}).drop("signal", "__line", "__enough")
