"""Toxicity: a linear classifier over character n-grams.

Each distinct n-gram of a text is one binary feature, hashed into a fixed
number of bins and scaled by its naive Bayes log-count ratio; a logistic
regression is fitted on the scaled features. N-gram counts come from a Spark
aggregation over the training rows; only the strongest bins, a fixed number,
reach the driver, where the regression is fitted.

Defined results: a null or empty text has no n-grams and gets the score of
the intercept; a null doc_id is not held out and is scored like any other;
repeated rows each get a row; extra columns are ignored; an empty table gives
no rows. Texts of any length are read whole. A labelled doc_id counts once,
with the smallest of its texts; one that is labelled both ways counts for
both. Ties in the choice of the sample or of bins go to the smaller id or bin.
With no labelled rows, or one class only, every score is the smoothed share of
label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, remove, stored, table

SIZES = (3, 4, 5)
BITS = 18
#: Bound of the training sample: labelled rows, chosen by a hash of their id.
SAMPLE_ROWS = 6_000
#: Bins kept for the regression.
FEATURES = 2_000
#: Ridge penalty; both chosen by four-fold cross-validation within the training rows.
DECAY = 0.2
THRESHOLD = 0.3
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def ngram_bins(text: str | None, bits: int = BITS) -> np.ndarray:
    """The bin of every n-gram of the lower-cased text, in order, with repeats."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, shift = [], np.uint32(32 - bits)
    for n in SIZES:
        if len(points) < n:
            continue
        mixed = np.full(len(points) - n + 1, n * 0x51ED270B & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            mixed += points[k : len(points) - n + 1 + k] * _MULTIPLIERS[k]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
        out.append(mixed >> shift)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


@dataclass(frozen=True)
class Model:
    """Intercept and one weight per bin."""

    intercept: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        bins = ngram_bins(text)
        bins = np.unique(bins[self.weights[bins] != 0])
        margin = self.intercept + float(self.weights[bins].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never trained on: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic, np.unique(ngram_bins(text))] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_pydict({"bin": used, "negative": counts[0, used], "positive": counts[1, used]})


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model:
    """Fit on the labelled rows that are not held out, at most sample_rows of them."""
    text = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1)).where(~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows))
    texts = text.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample, path = stored(texts.join(chosen, "doc_id").select("text", "toxic"), "sample")
    model = _fitted(sample, features)
    remove(documents.sparkSession, path)
    return model


def _fitted(sample: DataFrame, features: int) -> Model:
    """The model of a sample of text, toxic."""
    bins = in_arrow(sample, _class_counts, "bin long, negative long, positive long")
    bins = bins.groupBy("bin").agg(F.sum("negative").alias("q"), F.sum("positive").alias("p"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_neg, n_pos = totals.get(0, 0), totals.get(1, 0)
    prior = float(np.log((n_pos + 1) / (n_neg + 1)))
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not n_neg or not n_pos:
        return Model(prior, weights)
    ratio = F.log(((F.col("p") + 1) / (n_pos + 2)) / ((F.col("q") + 1) / (n_neg + 2)))
    strength = F.abs(ratio) * F.sqrt(F.least("p", F.lit(n_pos) - F.col("p") + 1) + F.col("q") * (n_pos / n_neg))
    kept = bins.where(F.col("p") + F.col("q") >= 3).select("bin", ratio.alias("ratio"), strength.alias("strength"))
    rows = kept.orderBy(F.desc("strength"), "bin").limit(features).toPandas()
    if rows.empty:
        return Model(prior, weights)
    slot = np.full(1 << BITS, -1, dtype=np.int32)
    slot[rows["bin"].to_numpy()] = np.arange(len(rows), dtype=np.int32)

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                slots = slot[ngram_bins(text)]
                found.append(np.unique(slots[slots >= 0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict({"slots": pa.array(found, pa.binary()), "toxic": batch.column(1)})

    drawn = in_arrow(sample, active, "slots binary, toxic int").toPandas()
    order = sorted(range(len(drawn)), key=lambda i: (drawn["slots"].iat[i], drawn["toxic"].iat[i]))
    fitted, intercept = _logistic([np.frombuffer(drawn["slots"].iat[i], "<i4") for i in order], drawn["toxic"].to_numpy()[order].astype(float), rows["ratio"].to_numpy(), prior)
    weights[rows["bin"].to_numpy()] = fitted
    return Model(intercept, weights)


def _logistic(active: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float, steps: int = 150, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features times ratio, by Adam over all rows."""
    lengths = np.array([len(a) for a in active])
    cols = np.concatenate(active) if len(active) else np.empty(0, dtype=np.int32)
    at = np.repeat(np.arange(len(active)), lengths)
    values = ratio[cols]
    w, b = np.zeros(len(ratio)), prior
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        margin = b + np.bincount(at, weights=w[cols] * values, minlength=len(active))
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / len(y)
        grad = np.bincount(cols, weights=error[at] * values, minlength=len(w)) + decay * w / len(y) * 50
        grad_b = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.999 * vb + 0.001 * grad_b**2
        scale = 0.02 * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        w -= scale * m / (np.sqrt(v) + 1e-9)
        b -= scale * mb / (np.sqrt(vb) + 1e-9)
    return w * ratio, float(b)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    ready = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    out = in_arrow(ready, scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, all columns unchanged, that score below threshold."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [model.score(text.as_py()) < threshold for text in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return in_arrow(documents, kept, documents.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))
