"""Language by sparse multinomial logistic regression on TF-IDF weights of character n-grams.

The features of a text are its 1- to 4-grams of lower-cased letters, with one blank for whatever stands between
words, hashed to 2^17 places, with weights log(1 + count) times the inverse document frequency, scaled to unit length.
Document frequencies are counted over all rows that may teach. The model is fitted by one task on a bounded sample
of these rows, with FTRL-proximal updates under an elastic net; a temperature fitted to sums that rows get from
models taught without them then calibrates the probabilities.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.scratch import materialize
from jobloom.llm.textvec import mix

BITS, ORDERS = 17, 4
FOLDS, HELD_OUT = 3, 1
#: At most this many rows of each language teach, and this many of all languages, common ranks first.
ROWS_A_LANGUAGE, TRAINING_ROWS = 1000, 20_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3e-4, 1e-3, 3
#: Parts of the sample that take turns in being left out for the temperature.
PARTS = 4
#: A longer text is read in pieces of so many characters; it is counted whole.
PIECE = 1 << 18
UNKNOWN = "und"

_PLACE = np.random.default_rng(20250611).integers(1, 2**63, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal doc_id leaves ``HELD_OUT``; such rows never teach. Null: False."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@cache
def _kinds() -> np.ndarray:
    """For each code point 2 for letters, 1 for the marks that stand on them, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(code))[0], 0) for code in range(0x110000)], dtype=np.uint8)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's n-grams, ascending, and their counts; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _kinds()[codes]
    if not (kinds == 2).any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    inside = np.concatenate(([False], kinds > 0, [False]))
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one blank after each word,
    keep[0] = True  # and one before the first
    chars = np.where(inside, np.concatenate(([32], codes, [32])), 32)[keep].astype(np.uint64)
    dense = np.zeros(1 << BITS, np.int64) if len(chars) > PIECE else None
    for at in range(0, len(chars), PIECE):
        hashed = []
        for order in range(1, ORDERS + 1):
            piece = chars[at : at + PIECE + order - 1]
            n = len(piece) - order + 1
            if n > 0:
                total = np.full(n, order, np.uint64)
                for k in range(order):
                    total += piece[k : k + n] * _PLACE[k]
                hashed.append((mix(total) >> np.uint64(64 - BITS)).astype(np.int32))
        if dense is None:
            return np.unique(np.concatenate(hashed), return_counts=True)
        dense += np.bincount(np.concatenate(hashed), minlength=1 << BITS)
    place = np.flatnonzero(dense)
    return place.astype(np.int32), dense[place]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, texts that hold it) of a task; place -1 counts the texts with a letter."""
    texts, total = 0, np.zeros(1 << BITS, np.int64)
    for batch in _slices(batches):
        for text in batch.column(0).to_pylist():
            place, _ = ngrams(text)
            total[place] += 1
            texts += len(place) > 0
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(found, -1).astype(np.int32)), pa.array(np.append(total[found], texts))], names=["place", "n"]
    )


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        rows = [ngrams(text) for text in batch.column(2).to_pylist()]
        places = pa.array([p for p, _ in rows], pa.list_(pa.int32()))
        counts = pa.array([c for _, c in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places, counts], names=["h", "lang", "place", "count"])


def weigh(place: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = np.log1p(count) * idf[place]
    return weight / max(1e-9, float(np.sqrt(weight @ weight)))


def softmax(sums: np.ndarray) -> np.ndarray:
    raised = np.exp(sums - sums.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    """``weights`` has a row for each place and a column for each language."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, place: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        """The likeliest language and its probability; of equal ones the first by name."""
        if not len(place) or not self.languages:
            return UNKNOWN, 0.0
        sums = weigh(place, count, self.idf) @ self.weights[place] + self.bias
        p = softmax(sums / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``(size, classes)`` and intercepts after ``EPOCHS`` passes of FTRL-proximal updates under L1 and L2 penalties."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    bias_z, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            place, value = rows[k]
            zs, ns = z[place], n[place]
            w = weights(zs, ns)
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            error = softmax(value @ w + bias)
            error[labels[k]] -= 1
            g = value[:, None] * error
            z[place] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[place] = ns + g * g
            bias_z += error - (np.sqrt(bias_n + error * error) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += error * error
    return weights(z, n), -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)


def fit_temperature(sums: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least mean negative log-likelihood, by golden section between 1/50 and 50."""

    def loss(log_t: float) -> float:
        p = softmax(sums / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, golden = -np.log(50), np.log(50), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _fit(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught = []
        for batch in batches:
            for h, lang, place, count in zip(*batch.columns, strict=True):
                if len(place.values):
                    at = place.values.to_numpy()
                    taught.append((h.as_py(), lang.as_py(), at, weigh(at, count.values.to_numpy(), idf)))
        taught.sort(key=lambda row: row[:2])
        languages = sorted({lang for _, lang, _, _ in taught})
        labels = np.array([languages.index(lang) for _, lang, _, _ in taught], dtype=np.int64)
        # Only places that the sample holds can get a weight.
        used = np.unique(np.concatenate([place for _, _, place, _ in taught])) if taught else np.zeros(0, np.int32)
        rows = [(np.searchsorted(used, place), value) for _, _, place, value in taught]
        w, bias = fit_ftrl(rows, labels, len(languages), len(used)) if taught else (np.zeros((0, 0)), np.zeros(0))
        sums = np.zeros((len(rows), len(languages)))
        for part in range(PARTS if len(rows) >= 2 * PARTS and len(languages) > 1 else 0):
            mine = np.arange(len(rows)) % PARTS == part
            v, b = fit_ftrl([row for row, out in zip(rows, mine, strict=True) if not out], labels[~mine], len(languages), len(used))
            for k in np.flatnonzero(mine):
                sums[k] = rows[k][1] @ v[rows[k][0]] + b
        temperature = fit_temperature(sums, labels) if sums.any() else 1.0
        packed = io.BytesIO()
        np.savez(packed, used=used, w=w.astype(np.float32), bias=bias, temperature=temperature)
        yield pa.RecordBatch.from_arrays(
            [pa.array([languages], pa.list_(pa.string())), pa.array([packed.getvalue()], pa.binary())], names=["languages", "model"]
        )

    return run


def teaching_rows(docs: DataFrame) -> DataFrame:
    """``h, lang, text`` of all rows that may teach: those not held out, with id, text and lang; h tells ids and texts apart."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = texts.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    return known.select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")


def training_sample(teach: DataFrame, rows_a_language: int, most: int) -> DataFrame:
    """Of each language the rows with the least hashes, repeated rows once; of all of them ``most``, lower ranks first."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = teach.select("lang", "h").withColumn("rank", rank).filter(F.col("rank") <= rows_a_language)
    chosen = materialize(chosen.orderBy("rank", "lang", "h").limit(most).select("lang", "h").distinct(), "chosen")
    return teach.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("h", "lang", "text")


def train_languages(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, most: int = TRAINING_ROWS) -> LanguageModel:
    """The model of the ``lang`` values of rows that may teach, fitted on a sample of at most ``most`` of them.

    Document frequencies are those of all rows that may teach.
    """
    teach = teaching_rows(docs)
    met = teach.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    counts = {r["place"]: r["n"] for r in met.collect()}  # at most 2^BITS + 1 rows
    found = np.zeros(1 << BITS)
    total = counts.pop(-1, 0)
    found[list(counts.keys())] = list(counts.values())
    idf = (np.log((1 + total) / (1 + found)) + 1).astype(np.float32)
    sample = training_sample(teach, rows_a_language, most)
    features = materialize(sample.mapInArrow(_featurise, "h long, lang string, place array<int>, count array<long>"), "features")
    fitted = features.coalesce(1).mapInArrow(_fit(idf), "languages array<string>, model binary").first()
    if fitted is None:
        return LanguageModel([], idf, np.zeros((0, 0), np.float32), np.zeros(0))
    stored = np.load(io.BytesIO(bytes(fitted["model"])))
    weights = np.zeros((1 << BITS, len(fitted["languages"])), np.float32)
    if len(stored["used"]):
        weights[stored["used"]] = stored["w"]
    return LanguageModel(list(fitted["languages"]), idf, weights, stored["bias"], float(stored["temperature"]))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shared.value.predict(*ngrams(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """The language of each document: ``doc_id, held_out, lang_pred, score``.

    ``lang_pred`` is a learned value of ``lang``, or ``und`` (score 0) if the text is null or has no letter, or nothing
    could be learned; ``score`` is its calibrated probability. Repeated rows and null ids are predicted like any
    other row, equal texts alike; whole texts of any length count; an empty table gives no rows. The columns ``lang`` and
    ``doc_id`` only choose what teaches; others are never read, whatever their names.
    """
    found = predict_languages(docs, train_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
