"""Bounded samples of labelled documents, and the held-out rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal doc_id is divisible by ``FOLDS``; such rows never teach. Null: False."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """``(doc_id, y)``: of each label value up to ``most[value]`` rows that may teach.

    Rows are taken by a hash of the doc_id, so the sample is the same on every run. Rows with a null id or
    label are left out, and an id with several rows counts once, with its greatest label.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    rows = rows.filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    parts = [
        rows.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for value, n in most.items()
    ]
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.unionByName(part)
    return sample


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``(doc_id, text, y)`` for a sample, which is bounded and so may be broadcast: one row an id, whole texts of any length.

    Of several texts of an id the one with the least hash teaches, so that repeated rows add nothing to the sample;
    they are reduced where they are read, before they are dealt by id.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.struct(F.xxhash64("text").alias("h"), "text").alias("least"))
    once = met.groupBy("doc_id", "y").agg(F.min("least").alias("least"))
    return once.select("doc_id", "least.text", "y")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept with equal weight for both labels and a light ridge."""
    if not len(x) or y.min() == y.max():
        return 0.0, -30.0 if len(x) and not y.max() else 0.0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    design = np.column_stack((x, np.ones_like(x)))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-2 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])
