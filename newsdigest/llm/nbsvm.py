"""Operator 8, quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams (pairs exact, triples hashed) of the whole text and of word pairs that
repeat a word, by their share.  Each indicator is scaled by its class log-count ratio, the vector is brought to
about unit length (less for short texts, which then lean on the bias), and a linear hinge-loss model is fitted by dual
coordinate descent.  The fit uses a bounded sample of labelled rows (``sample_rows``, chosen by a hash of the
id); scoring reads every text whole and needs no shuffle.  Model arrays have a fixed size and are broadcast.

Defined results: a null or empty text scores by the bias alone; without labels of both classes every text gets the
class that was seen (none: 1, score 0.5); repeated rows repeat their result; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written

PAIRS = 1 << 16
TRIPLE_BITS = 17
REPEATS = PAIRS + (1 << TRIPLE_BITS)
#: Shares of the word pairs that repeat a word; each that is reached is an indicator.
SHARES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
SIZE = REPEATS + len(SHARES)


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mark(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of a text, ascending; ``seen`` is a cleared work array of SIZE flags."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, dtype=np.int32)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    seen[(b[:-1] << np.uint32(8)) | b[1:]] = True
    triple = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    seen[PAIRS + ((triple * np.uint32(2654435761)) >> np.uint32(32 - TRIPLE_BITS))] = True
    words = text.split()
    again = sum(map(str.__eq__, words, words[1:]))
    if again:
        seen[REPEATS:REPEATS + sum(again >= s * len(words) for s in SHARES)] = True
    out = np.flatnonzero(seen).astype(np.int32)
    seen[out] = False
    return out


@dataclass
class Model:
    ratio: np.ndarray           # class log-count ratios
    weight: np.ndarray          # of the scaled indicators
    bias: float
    room: float = 1.0           # added to the squared length of a scaled vector
    steepness: float = 4.0

    def score(self, features: np.ndarray) -> float:
        r = self.ratio[features]
        margin = float(r @ self.weight[features]) / float(np.sqrt(r @ r + self.room)) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.steepness * margin, -60, 60))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, SIZE), smooth)
    for x, y in zip(rows, labels):
        counts[y, x] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], scaled: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 30,
                 tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimize 0.5 |w|^2 + sum cost * max(0, 1 - y (w x + b)); the bias is a feature of value 1."""
    weight, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in scaled])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], scaled[i]
            gradient = y[i] * (weight[x] @ v + bias) - 1.0
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= cost[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
                step, alpha[i] = (new - alpha[i]) * y[i], new
                weight[x] += step * v
                bias += step
        if worst < tolerance:
            break
    return weight, bias


def fit_model(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0 if not n0 and not n1 else 1.0 if n1 else -1.0)
    ratio = log_count_ratios(rows, labels)
    squares = np.array([ratio[x] @ ratio[x] for x in rows])
    room = max(0.25 * float(np.median(squares)), 1e-9)
    scaled = [ratio[x] / np.sqrt(q + room) for x, q in zip(rows, squares)]
    y = np.where(labels == 1, 1.0, -1.0)
    weight, bias = dual_descent(rows, scaled, y, np.where(labels == 1, cost, cost * min(4.0, max(0.25, n1 / n0))))
    return Model(ratio, weight, bias, room)


#: Bytes of the features that the driver fits a model on.
SAMPLE_BYTES = 1 << 28


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str = "doc_id",
                  text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``sample_rows`` labelled rows outside the held-out fold, with at most ``sample_bytes`` of
    features.  They are the first by a hash of id and features, so the same ones in every run, also where ids repeat."""
    marks = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = rows.join(F.broadcast(marks), "doc_id").select("doc_id", "quality", "text")      # at most sample_rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SIZE, dtype=bool)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [mark(t, seen).tobytes() for t in batch["text"]]})

    schema = T.StructType([rows.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("x", T.BinaryType())])
    made = written(picked.mapInPandas(run, schema), "training-rows")
    named = made.withColumn("h", F.xxhash64("doc_id", "x"))
    first = named.select("h", F.octet_length("x").alias("bytes")).orderBy("h", "bytes").limit(sample_rows).collect()
    most = int(np.searchsorted(np.cumsum([r["bytes"] for r in first]), sample_bytes, side="right"))
    found = []
    if most:
        last = first[most - 1]["h"]
        found = named.filter(F.col("h") < last).collect()
        found += named.filter(F.col("h") == last).limit(most - len(found)).collect()          # equal rows share a hash
    found.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return [np.frombuffer(r["x"], dtype=np.int32) for r in found], np.array([r["quality"] for r in found], dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return fit_model(*training_rows(docs, labels, sample_rows, id_col, text_col))


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score of a text as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weight, model.bias, model.room, model.steepness))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        own, seen = Model(*shared.value), np.zeros(SIZE, dtype=bool)
        return pd.Series([own.score(mark(t, seen)) for t in texts], dtype="float64")

    return score(F.col(text_col).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0) of every row."""
    model = train(docs, labels, sample_rows, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(rows, model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
