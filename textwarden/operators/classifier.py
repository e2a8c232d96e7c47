"""A learned layer for detectors: logistic weights over hashed words and word pairs, fitted by gradients that Spark sums.

A model is a table of one row (weights array<double>), whose length is a parameter and does not grow with the data; it meets texts by a broadcast
of that row. Texts are scored whole, in one projection. Each step of the fit reads the features once, sums gradients by feature in each task and after one
shuffle, and brings one number a feature to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import kept, scoped, spread

#: Length of a model: features share a weight where their hashes do.
BUCKETS = 1 << 14
#: Steps of the fit, and the weight of the penalty on absolute weights, as a share of the one that leaves none.
STEPS, PENALTY = 30, 0.2


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """array<int>: 0, which every text has, and the buckets of a text's words and pairs of neighbouring words, each once. A null text has 0 alone."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    at = lambda term: (1 + F.pmod(F.xxhash64(term), F.lit(buckets - 1))).cast("int")

    def both(w: Column) -> Column:
        after = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
        pairs = F.filter(F.zip_with(w, after, lambda x, y: F.concat(x, F.lit(" "), y)), lambda p: p.isNotNull())
        return F.array_distinct(F.transform(F.concat(w, pairs), at))

    return F.concat(F.array(F.lit(0)), F.get(F.transform(F.array(words), both), 0))


def share(at: Column) -> Column:
    """The value of each feature but the first, which counts 1: with it, texts of all lengths have equal norms."""
    return F.lit(1.0) / F.sqrt(F.greatest(F.size(at) - 1, F.lit(1)))


def probability(at: Column, weights: Column) -> Column:
    """The model's probability for features, 0 to 1."""
    rest = F.aggregate(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + F.get(weights, i))
    return F.lit(1.0) / (1 + F.exp(-(F.get(weights, F.lit(0)) + rest * share(at))))


def as_model(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(weights.tolist(),)], "weights array<double>")


def _sums(weights: np.ndarray | None, yes: float, no: float):
    """Rows (b, x): a task's gradient of the loss by feature at weights, or, without weights, what bounds its curvature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            at, y = batch.column(0), batch.column(1).to_numpy()
            if not len(y):
                continue
            b, n = at.flatten().to_numpy(), np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(len(y)), n)
            value = np.where(b == 0, 1.0, 1 / np.sqrt(np.maximum(n - 1, 1))[row])
            heft = np.where(y == 1, yes, no)
            if weights is None:
                part = heft * 0.25 * np.bincount(row, value)
            else:
                part = heft * (1 / (1 + np.exp(-np.bincount(row, value * weights[b]))) - y)
            sums = np.bincount(b, value * part[row])
            if total is None:
                total = sums
            else:
                longer, shorter = (total, sums) if len(total) >= len(sums) else (sums, total)
                longer[: len(shorter)] += shorter
                total = longer
        if total is not None:
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["b", "x"])

    return run


@scoped
def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, penalty: float = PENALTY) -> DataFrame:
    """A model (weights) of labelled (text, label): label is a boolean, and both of its values weigh the same in total. Rows without one take no part.

    Accelerated gradient steps on the mean loss, each feature's of the length that a bound of its own curvature allows: a quarter of the sum, over its rows, of
    its value times all values. After each step weights shrink towards 0, all but the first, so that pairs of one text only, which could tell it from all
    others, get none. With rows of one label only, the model leans to it; an empty table gives one that says 1/2 to everything.
    """
    spark = labelled.sparkSession
    told = kept(spread(labelled.where("label is not null")).select(features(F.col("text"), buckets).alias("at"), F.col("label").cast("double").alias("y")))
    n = told.agg(F.sum("y").alias("yes"), F.count("*").alias("n")).first()
    yes = n["yes"] or 0.0
    hefts = 0.5 / max(yes, 1.0), 0.5 / max(n["n"] - yes, 1.0)

    def summed(weights: np.ndarray | None) -> np.ndarray:
        sums = told.mapInArrow(_sums(weights, *hefts), "b int, x double").groupBy("b").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(buckets)
        out[sums["b"].to_numpy()] = sums["x"].to_numpy()
        return out

    weights = before = np.zeros(buckets)
    if n["n"]:
        curve, least = np.maximum(summed(None), 1e-300), penalty * np.abs(summed(weights)[1:]).max()
        shrink = np.concatenate([[0.0], least / curve[1:]])
    for step in range(steps if n["n"] else 0):
        ahead = weights + (step / (step + 3)) * (weights - before)
        there = ahead - summed(ahead) / curve
        weights, before = np.sign(there) * np.maximum(np.abs(there) - shrink, 0), weights
    return as_model(spark, weights)


def layer(learned: Column, least: float = 0.5) -> Column:
    """A model's probability as a detector's layer: 0 below `least`, where the model does not hold with the label."""
    return F.when(learned >= least, learned).otherwise(F.lit(0.0))


def scored(texts: DataFrame, model: DataFrame, text: str = "text", name: str = "learned") -> DataFrame:
    """texts with the model's probability of each as the column `name`."""
    told = texts.withColumn("__at", features(F.col(text), len(model.first()["weights"])))
    return told.crossJoin(F.broadcast(model.select(F.col("weights").alias("__weights")))).withColumn(name, probability(F.col("__at"), F.col("__weights"))).drop("__at", "__weights")
