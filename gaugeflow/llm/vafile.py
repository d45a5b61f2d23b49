"""Exact top-k inner-product search with a vector-approximation file.

Components become integers floor(256 * x). The approximation of a vector keeps one byte per component: the cell
that it falls in, ``step`` integers wide, where step is the vector's own, so that its largest component has the last cell. A cell
bounds a component from both sides, and so does a vector's row of cells every inner product. Blocks of approximations are scanned
against blocks of queries; a candidate goes where ``k`` others of its block, later of all blocks, have lower bounds beyond its
upper bound. Exact vectors are then read in order of their bounds: first the best few per query, then every further one whose upper
bound still reaches the k-th exact score, after which the result is certain.

Equal vectors score alike, so of each vector the ``k + 1`` smallest ids (the query's own may be one) decide for all; the
others can't be among the best, however many there are.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with
a null id; vectors of unequal length are not compared. Rows that repeat an id are candidates each, told apart by
a row number, but no row with the query's own id is. An id that asks with several vectors has the best pairs of all of them; a
repeated query row asks once. Ties go to the smaller vec_id. Components may be any finite number: bounds are widened by what
floating point can lose, exact scores are whole numbers, and those beyond 64 bits count as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import stash

SCALE = 256
#: Cells on either side of zero: a byte holds -LEVELS - 1 to LEVELS.
LEVELS = 127
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 4096
#: Queries of a block that are bounded at once.
AT_ONCE = 256
LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, ints): whole numbers, as doubles."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    most = F.lit(1.7976931348623157e308)
    ints = F.transform("embedding", lambda x: (lambda y: F.when(F.abs(y) > 4.5e15, F.greatest(F.least(y, most), -most)).otherwise(F.floor(y).cast("double")))(x.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("ints"))


def candidates_of(vectors: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k best of any query: of equal vectors those of the k + 1 smallest ids, of equal rows k."""
    same = Window.partitionBy("ints")
    rows = vectors.withColumn("n", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("n") <= k + 1)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("ints", "vec_id").orderBy("vec_id"))).where(F.col("n") <= k)
    return rows.drop("n").withColumn("row", F.monotonically_increasing_id())


def _approximate(levels: int):
    """Rows (row, vec_id, ints) to rows with a step and cells of one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, cells = [], []
            for v in batch.column(2):
                v = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                step = max(1.0, float(np.ceil(np.abs(v).max() / levels)))
                steps.append(step)
                cells.append(np.floor(v / step).clip(-levels - 1, levels).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(c) for c in cells], pa.int32()), pa.array(steps, pa.float64()), pa.array(cells, pa.binary())], names=["row", "vec_id", "dim", "step", "cells"])

    return run


def bounds(q: np.ndarray, cells: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and approximated vectors."""
    with np.errstate(over="ignore", invalid="ignore"):
        low = cells.astype(np.float64) * step[:, None]
        low -= np.where(step > 2.0**40, np.abs(low).max(axis=1, initial=0) * 2.0**-50, 0)[:, None]  # what dividing by the step may have rounded
        high = low + np.where(step > 2.0**40, step * (1 + 2.0**-40) + np.abs(low).max(axis=1, initial=0) * 2.0**-49, step - 1)[:, None]
        pos, neg = np.maximum(q, 0), np.minimum(q, 0)
        lower, upper = pos @ low.T + neg @ high.T, pos @ high.T + neg @ low.T
        size = np.abs(q).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * q.shape[1]
        if not size < 2.0**52:  # beyond that sums of whole numbers are rounded
            slack = (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * ((q.shape[1] + 4) * 2.0**-52)
            lower, upper = lower - slack, upper + slack
            lower[np.isnan(lower)], upper[np.isnan(upper)] = -np.inf, np.inf
    return lower.clip(*map(float, LONG)), upper.clip(*map(float, LONG))


def _scan(k: int):
    """Bounds of a block of candidates against a block of queries; keeps what can be among the k best of the block."""

    def scan(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "upper": np.zeros(0), "lower": np.zeros(0)})]
        if left.empty or right.empty:
            return parts[0]
        right = right.sort_values(["vec_id", "row"], kind="stable")
        cells = np.frombuffer(b"".join(right["cells"]), np.int8).reshape(len(right), -1)
        step, vid, row = (right[c].to_numpy() for c in ("step", "vec_id", "row"))
        for at in range(0, len(left), AT_ONCE):
            some = left.iloc[at : at + AT_ONCE]
            qid, query = some["query_id"].to_numpy(), some["query"].to_numpy()
            lower, upper = bounds(np.stack(some["ints"].to_numpy()), cells, step)
            own = qid[:, None] == vid[None, :]
            lower[own] = -np.inf
            if k < lower.shape[1]:
                # the k-th best in order of (lower bound, smaller vec_id): columns are in order of vec_id
                kth = np.argsort(-lower, axis=1, kind="stable")[:, k - 1]
                least = lower[np.arange(len(some)), kth][:, None]
                keep = ~own & ((upper > least) | ((upper == least) & (vid[None, :] <= vid[kth][:, None])))
            else:
                keep = ~own
            i, j = np.nonzero(keep)
            parts.append(pd.DataFrame({"query": query[i], "query_id": qid[i], "row": row[j], "vec_id": vid[j], "upper": upper[i, j], "lower": lower[i, j]}))
        return pd.concat(parts)

    return scan


def exact_score(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of whole numbers, within the range of a long."""
    with np.errstate(over="ignore"):
        if np.abs(a).max() * np.abs(b).max() * len(a) < 2.0**52:
            return int(a @ b)
    return min(max(sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist())), LONG[0]), LONG[1])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, v = (batch.column(i) for i in (3, 4))
        scores = [exact_score(np.asarray(a.values.to_numpy(zero_copy_only=False)), np.asarray(b.values.to_numpy(zero_copy_only=False))) for a, b in zip(q, v)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.int64())], names=["query_id", "row", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, levels: int = LEVELS, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query row of ``vectors``."""
    whole = integer_vectors(vectors)
    exact = stash(candidates_of(whole, k), "exact-vectors")
    asked = whole.where(is_query).select(F.col("vec_id").alias("query_id"), "ints").dropDuplicates(["query_id", "ints"])
    queries = stash(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    n, n_queries = exact.count(), queries.count()
    blocks, q_blocks = max(1, -(-n // candidate_block)), max(1, -(-n_queries // query_block))
    cells = exact.select("row", "vec_id", "ints").mapInArrow(_approximate(levels), "row long, vec_id long, dim int, step double, cells binary")
    cells = cells.withColumn("i", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    left = queries.withColumn("dim", F.size("ints")).withColumn("j", F.pmod(F.xxhash64("query"), F.lit(q_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = left.groupBy("dim", "i", "j").cogroup(cells.groupBy("dim", "i", "j")).applyInPandas(_scan(k), "query long, query_id long, row long, vec_id long, upper double, lower double")
    found = stash(found, "bounds")

    def best(rows: DataFrame, n: int, *order: Column) -> DataFrame:
        """The first ``n`` rows of each query; Spark cuts each map task's rows to as many before it shuffles them."""
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("n") <= n)

    least = best(found, k, F.col("lower").desc(), F.col("vec_id")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("lower").alias("least"))
    left_over = stash(found.join(least, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("least"))).select("query", "query_id", "row", "vec_id", "upper"), "survivors")
    ids = exact.select("row", F.col("ints").alias("v"))

    def read(rows: DataFrame) -> DataFrame:
        """The exact scores, by reading the vectors of ``rows`` only."""
        pairs = rows.select("query", "query_id", "row", "vec_id").join(ids, "row").join(queries.select("query", F.col("ints").alias("q")), "query")
        return pairs.select("query_id", "row", "vec_id", "q", "v").mapInArrow(_score, "query_id long, row long, vec_id long, score long")

    first_rows = stash(best(left_over, 2 * k, F.col("upper").desc(), F.col("vec_id"), F.col("row"), F.col("query")).drop("n"), "first-rows")
    first = stash(read(first_rows), "first-scores")
    by_score = (F.col("score").desc(), F.col("vec_id"), F.col("row"))
    kth = best(first, k, *by_score).where(F.col("n") == k).select("query_id", F.col("score").alias("kth"))
    rest = left_over.join(first_rows.select("query", "row"), ["query", "row"], "left_anti").join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    ranked = best(first.unionByName(read(rest)), k, *by_score)
    return ranked.select("query_id", F.col("n").cast("int").alias("rank"), "vec_id", "score")
