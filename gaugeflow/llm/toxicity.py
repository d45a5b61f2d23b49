"""Toxicity scores from a factorization machine over hashed terms.

Terms are hashed into ``BUCKETS`` buckets, all of which are inputs of the machine. What a text puts into a bucket it has a term of
is the bucket's weight between 0 and 1: how strongly the training sample says that the bucket tells the labels apart, by itself or
beside another (in standard errors from what the share of label 1, or the two buckets by themselves, let expect). Noise is damped
that way, and a pair of buckets that matter only together is heard. All pairs of buckets that ``LEAST_ROWS`` rows of the sample hold together are
looked at, however rare; Spark deals the buckets to tasks in blocks, each beside all others. Spark's factorization machine learns a
coefficient for each bucket and, through its factors, one for each pair of buckets that meet in a text,
so that an insult beside a group mention can weigh more than the sum of both. Every text is scored
whole; doc_id only joins labels and splits the folds.

The sample is bounded (``SAMPLE_ROWS``); buckets that fewer than ``LEAST_ROWS`` of its rows hold say nothing and weigh 0.

Null and empty texts have no terms and get the score of an empty vector. Repeated rows are scored
each; a null doc_id has no label and is in no fold (held_out is null). With no usable label (none, or all alike) every row gets the share of label 1, 0.0 if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import n_partitions, release_memory, stash

BUCKETS = 1 << 16
#: Rows of the training sample at most.
SAMPLE_ROWS = 20_000
LEAST_ROWS = 5
#: Cells of the table of pairs (buckets of a block x buckets from there on) that a task counts at once.
PAIR_CELLS = 1 << 25
#: Standard errors at which a bucket weighs a half, and what the best of many pairs reaches by chance.
HALF, BY_CHANCE = 5.0, 4.0
FACTORS = 4


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def terms(text: Column, buckets: int = BUCKETS) -> Column:
    """Distinct hashed terms: lower-cased runs of letters of a text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))))


@dataclass(frozen=True)
class Machine:
    """Weights of the buckets, and what the factorization machine learnt; without coefficients every score is ``share``."""

    share: float
    weight: np.ndarray | None = None
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None
    intercept: float = 0.0

    def scores(self, terms_: pd.Series) -> np.ndarray:
        lengths = np.array([0 if t is None else len(t) for t in terms_], np.int64)
        if self.weight is None:
            return np.full(len(lengths), self.share)
        at = np.concatenate([np.zeros(0, np.int64), *(t for t in terms_ if t is not None and len(t))]).astype(np.int64)
        row, x = np.repeat(np.arange(len(lengths)), lengths), self.weight[at]
        sums = lambda v: np.bincount(row, v, len(lengths))
        total = self.intercept + sums(x * self.linear[at])
        for v in self.factors.T:
            total += (sums(x * v[at]) ** 2 - sums((x * v[at]) ** 2)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _errors(k: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far ``k`` of ``m`` is from a share ``p``, in standard errors: the signed root of the deviance, which holds for few rows too."""
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(k > 0, k * np.log(k / (m * p)), 0.0)
        miss = np.where(k < m, (m - k) * np.log((m - k) / (m * (1 - p))), 0.0)
    return np.sqrt(np.maximum(2 * (hit + miss), 0.0))


def _dealt(known: np.ndarray, width: int):
    """Rows (terms, label) to a row (block, ranks, label) for each block of ``width`` buckets that a text has one of; ``ranks`` are its buckets from that block on."""
    rank = np.full(BUCKETS, -1, np.int32)
    rank[known] = np.arange(len(known), dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, ranks, labels = [], [], []
            for cells, label in zip(batch.column(0), batch.column(1).to_pylist()):
                own = rank[cells.values.to_numpy()]
                own = np.sort(own[own >= 0])
                for block, at in zip(*np.unique(own // width, return_index=True)):
                    blocks.append(block)
                    ranks.append(own[at:])
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(ranks, pa.list_(pa.int32())), pa.array(labels, pa.float64())], names=["block", "ranks", "label"])

    return run


def _pair_errors(known: np.ndarray, alone: np.ndarray, share: float, width: int, kind: type):
    """From rows (block, ranks, label) in order of block: (bucket, errors), how far the label of any pair of a bucket is from what both let expect."""
    n, least = len(known), min(share, 1 - share) / 4

    def found(start: int, both: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
        errors = np.zeros(n - start)
        for i in range(min(width, n - start)):
            at = i + 1 + np.flatnonzero(both[i, i + 1 :] >= LEAST_ROWS)
            if len(at):
                expected = np.clip(alone[start + i] + alone[start + at] - share, least, 1 - least)
                far = _errors(toxic[i, at].astype(float), both[i, at].astype(float), expected)
                errors[i] = max(errors[i], far.max())
                errors[at] = np.maximum(errors[at], far)
        return pa.RecordBatch.from_arrays([pa.array(known[start:].astype(np.int32)), pa.array(errors)], names=["bucket", "errors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, both, toxic = -1, None, None
        for batch in batches:
            for block, ranks, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if block * width != start:
                    if both is not None:
                        yield found(start, both, toxic)
                    both = toxic = None
                    start = block * width
                    both, toxic = (np.zeros((min(width, n - start), n - start), kind) for _ in range(2))
                at = ranks.values.to_numpy() - start
                # the terms of a text are distinct and in order of rank, so that no cell comes twice
                cell = np.ix_(at[: np.searchsorted(at, width)], at)
                both[cell] += 1
                if label > 0:
                    toxic[cell] += 1
        if both is not None:
            yield found(start, both, toxic)
        del both, toxic
        release_memory()

    return run


def pair_errors(sample: DataFrame, known: np.ndarray, alone: np.ndarray, share: float, n: int) -> pd.DataFrame:
    """(bucket, errors) of the buckets ``known``, most frequent first, from all their pairs in the ``n`` rows of ``sample``.

    A text goes to each block of buckets that it has one of, with its rarer buckets only, which are few for most blocks.
    """
    width = max(1, PAIR_CELLS // len(known))
    blocks = sample.select("terms", "label").mapInArrow(_dealt(known, width), "block int, ranks array<int>, label double")
    in_order = blocks.repartition(min(-(-len(known) // width), 4 * n_partitions(sample.sparkSession)), "block").sortWithinPartitions("block")
    kind = np.uint16 if n < 1 << 16 else np.int32
    errors = in_order.mapInArrow(_pair_errors(known, alone, share, width, kind), "bucket int, errors double")
    return errors.groupBy("bucket").agg(F.max("errors").alias("errors")).toPandas()


def weights(sample: DataFrame, n: int, n_toxic: float) -> np.ndarray:
    """The weight of each bucket, from a bounded sample (terms, label)."""
    share = n_toxic / n
    counts = sample.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("label").alias("toxic")).toPandas()
    rows, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rows[counts["bucket"]], toxic[counts["bucket"]] = counts["rows"], counts["toxic"]
    errors = np.abs(toxic - rows * share) / np.sqrt(np.maximum(rows, 1) * share * (1 - share))
    known = np.flatnonzero(rows >= LEAST_ROWS)
    known = known[np.argsort(-rows[known], kind="stable")]
    if len(known) > 1:
        pairs = pair_errors(sample, known, toxic[known] / rows[known], share, n)
        errors[pairs["bucket"]] = np.maximum(errors[pairs["bucket"]], pairs["errors"] - BY_CHANCE)
    return np.where(rows < LEAST_ROWS, 0.0, errors**2 / (errors**2 + HALF**2))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, factors: int = FACTORS) -> Machine:
    """The machine, learnt outside the held-out fold.

    The sample is the ``sample_rows`` labels of smallest hashed doc_id: bounded (so it can be
    broadcast) and alike at every size. Of a repeated label the largest counts, of texts with the same doc_id
    the one whose terms come first.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    each = labelled.select("doc_id", terms(F.col("text")).alias("terms"), F.col("toxic").cast("double").alias("label"))
    sample = stash(each.groupBy("doc_id").agg(F.min("terms").alias("terms"), F.max("label").alias("label")).select("terms", "label"), "toxic-sample")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < n_toxic < n:
        return Machine(float(n_toxic / n) if n else 0.0)
    weight = weights(sample, n, n_toxic)

    def vector(found):
        at = [t for t in found if weight[t]]
        return Vectors.sparse(BUCKETS, at, weight[at])

    rows = sample.select("label", F.udf(vector, VectorUDT())("terms").alias("features")).coalesce(4).cache()
    model = FMClassifier(factorSize=factors, stepSize=0.1, maxIter=80, regParam=1e-4, initStd=0.05, seed=7).fit(rows)
    rows.unpersist()
    release_memory()
    return Machine(float(n_toxic / n), weight, model.linear.toArray(), model.factors.toArray(), model.intercept)


def score(text: Column, machine: Machine, spark) -> Column:
    """The score of a text, 0 to 1."""
    held = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def scores(found: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores(found))

    return scores(terms(text))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    machine = train(docs, labels, **options)
    out = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("text"), machine, docs.sparkSession).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not scored as toxic, with all their columns."""
    machine = train(docs, labels, **options)
    scored = docs.withColumn("__toxicity", score(F.col("text"), machine, docs.sparkSession))
    return scored.where(F.col("__toxicity") < 0.5).drop("__toxicity")
