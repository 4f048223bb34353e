"""Quality scores by logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

The features of a text are its words and word pairs as written (case and punctuation count), hashed to
2^18 places, with weights log(1 + count) scaled to unit length. A pair of equal words also counts under one
common feature, so that repetition is seen whatever the word. The model is fitted by one task on a bounded
sample of labelled rows; texts are scored as sparse dot products inside the partitions. Scores are calibrated
with equal weight for both labels: a logistic curve is fitted to the sums that rows get from models fitted
without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import textvec
from jobloom.llm.labelled import held_out, labelled_texts, logistic, training_sample
from jobloom.llm.scratch import materialize

BITS = 18
#: At most this many rows of each label teach.
TRAINING_ROWS = {0: 2000, 1: 6000}
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 1e-3, 1e-3, 3
#: Parts of the sample that take turns in being left out of a model.
PARTS = 4
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, weights) of each text; a text without words has none."""
    for _, w in textvec.words(column, lower=False):
        one, two = w.hash[:-1], w.hash[1:]
        pair = textvec.mix(one * np.uint64(3) + two * np.uint64(7))
        repeat = one == two
        for a, b in zip(w.doc[:-1], w.doc[1:], strict=True):
            end = max(a, b - 1)
            again = np.full(int(repeat[a:end].sum()), _REPEAT)
            hashed = np.concatenate((w.hash[a:b], pair[a:end], again)) >> np.uint64(64 - BITS)
            place, count = np.unique(hashed.astype(np.int64), return_counts=True)
            weight = np.log1p(count)
            yield place, weight / max(1e-9, float(np.sqrt(weight @ weight)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``EPOCHS`` passes of per-coordinate FTRL-proximal updates."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = bias = 0.0

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            place, value = rows[k]
            zs, ns = z[place], n[place]
            w = weights(zs, ns)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            error = 1 / (1 + np.exp(-np.clip(w @ value + bias, -30, 30))) - labels[k]
            g = error * value
            z[place] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[place] = ns + g * g
            bias_z += error - (np.sqrt(bias_n + error * error) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += error * error
    return weights(z, n), float(bias)


def calibrated(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """``fit_ftrl`` on all rows, scaled so that the logistic of a sum is a calibrated score."""
    weights, bias = fit_ftrl(rows, labels)
    sums = np.zeros(len(rows))
    for part in range(PARTS):
        mine = np.arange(len(rows)) % PARTS == part
        w, b = fit_ftrl([row for row, out in zip(rows, mine, strict=True) if not out], labels[~mine])
        for k in np.flatnonzero(mine):
            place, value = rows[k]
            sums[k] = w[place] @ value + b
    slope, intercept = logistic(sums, labels)
    if slope <= 0:  # too few rows to tell
        return weights, bias
    return weights * slope, bias * slope + intercept


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, labels, rows = [], [], []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        for place, weight in zip(batch.column(2), batch.column(3), strict=True):
            rows.append((place.values.to_numpy(), weight.values.to_numpy(zero_copy_only=False)))  # 8 bytes a feature
    order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
    w, bias = calibrated([rows[k] for k in order], np.array(labels, dtype=float)[order])
    packed = np.append(w, bias).astype("<f4").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["model"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.slice(at, 200)
            rows = list(features(part.column(1)))
            places = pa.array([p for p, _ in rows], pa.list_(pa.int32()))
            weights = pa.array([w.astype(np.float32) for _, w in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), places, weights], names=["doc_id", "y", "place", "weight"]
            )


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: dict[int, int] | None = None) -> bytes:
    """The model, 1 MB, from at most ``most`` rows of each label (``TRAINING_ROWS``), one row an id, that are not held out."""
    sample = training_sample(labels, label, most or TRAINING_ROWS)
    rows = labelled_texts(docs, sample).mapInArrow(
        _featurise, "doc_id long, y int, place array<int>, weight array<float>"
    )
    rows = materialize(rows, "features")
    return bytes(rows.coalesce(1).mapInArrow(_fit, "model binary").first()[0])


def _score(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(model, dtype="<f4").astype(float)
        bias = weights[-1]
        for batch in batches:
            sums = np.array([weights[p] @ v + bias for p, v in features(batch.column(1))])
            score = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Quality of each document: ``doc_id, held_out, score, predicted``.

    ``score`` lies between 0 and 1 and is higher where label 1 is likelier; ``predicted`` is 1 from the
    threshold on. Null and wordless texts get the score of the intercept. Repeated rows and null ids are
    scored like any other row, equal texts alike; an id teaches once, however often it is repeated; texts of any
    length count whole. With no labelled row that
    may teach, every score is 0.5, and an empty table gives no rows. Other columns of the documents are never
    read, whatever their names.
    """
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _score(train_quality(docs, labels)), "doc_id long, score double"
    )
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
