"""Quality classifier: a linear support-vector machine on n-gram indicators scaled by naive Bayes.

A text's indicators are its byte 3-grams, n-grams of its collapsed shape (runs of lower case, upper
case, digits and of each other byte become one symbol) and how often, by powers of two, a word follows
itself; all are hashed to 2^BITS places. An indicator weighs the log of the ratio of its smoothed
shares in the two classes, vectors are scaled to length one, and a hinge-loss model with weights
balanced between the classes is fitted by dual coordinate descent. A logistic curve through
cross-fitted margins turns margins into scores.

The fit sees at most `most_labelled` labelled documents (those with the least hashes of their ids), and of these the first
whose indicators fit into `most_bytes`, so the driver's memory has a bound whatever the lengths of texts;
scoring is one narrow pass over whole texts with a model of fixed size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, tidied

BITS, MOST_LABELLED, MOST_BYTES, EPOCHS, COST = 18, 8_000, 64 << 20, 20, 1.0
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[97:123] = SHAPES[128:] = 97
SHAPES[65:91] = 65
SHAPES[48:58] = 48
U64 = np.uint64


def indicators(text: str | None, at_once: int = 1 << 20) -> np.ndarray:
    """The places of a text's indicators, in order; a null text is an empty one."""
    raw = (text or "").encode()
    data, there = np.frombuffer(b" " + raw + b" ", np.uint8), np.zeros(1 << BITS, bool)
    shape = SHAPES[data]
    shape = shape[np.append(True, shape[1:] != shape[:-1])]
    for source, lengths in ((data, (3,)), (shape, (2, 3, 4, 6))):
        for n in lengths:
            for a in range(0, len(source) - n + 1, at_once):
                part = source[a : a + at_once + n - 1].astype(U64)
                h = np.full(len(part) - n + 1, n + 8 * (source is shape), U64)
                for k in range(n):
                    h = h * U64(0x100000001B3) + part[k : len(part) - n + 1 + k]
                there[(h * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)] = True
    words = raw.split()
    again = sum(map(bytes.__eq__, words, words[1:]))
    there[[k * 0x9E3779B1 + 17 & (1 << BITS) - 1 for k in range(1, again.bit_length() + 1)]] = True
    return np.flatnonzero(there).astype(np.int32)


def packed(at: np.ndarray) -> bytes:
    """Places as numbers, or as one bit per place where that is shorter."""
    if 32 * len(at) < 1 << BITS:
        return at.astype("<i4").tobytes()
    there = np.zeros(1 << BITS, bool)
    there[at] = True
    return np.packbits(there).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if 8 * len(raw) < 1 << BITS:
        return np.frombuffer(raw, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


@dataclass
class Model:
    """score = logistic(slope * margin + offset), margin = <weight, ratio of the indicators / their length> + bias."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, at: np.ndarray) -> float:
        v = self.ratio[at]
        size = math.sqrt(float(v @ v))
        return float(self.weight[at] @ v) / size + self.bias if size else self.bias

    def score(self, at: np.ndarray) -> float:
        z = max(-700.0, min(700.0, self.slope * self.margin(at) + self.offset))
        return 1 / (1 + math.exp(-z))


def fit_margin(rows: list[bytes], label: np.ndarray, seed: int = 5) -> Model:
    """Log-count ratios and a balanced hinge-loss model by dual coordinate descent; rows are packed places, and both classes must be there."""
    counts = np.ones((2, 1 << BITS))
    for raw, y in zip(rows, label):
        counts[y, unpacked(raw)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    shrink = [1 / max(float(np.sqrt(v @ v)), 1e-12) for v in (ratio[unpacked(raw)] for raw in rows)]
    sign = np.where(label == 1, 1.0, -1.0)
    limit = COST * np.where(label == 1, len(label) / 2 / max(1, (label == 1).sum()), len(label) / 2 / max(1, (label == 0).sum()))
    weight, bias, dual, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at = unpacked(rows[i])
            v = ratio[at] * shrink[i]
            gradient = sign[i] * (weight[at] @ v + bias) - 1
            new = min(max(dual[i] - gradient / 2, 0.0), limit[i])  # a vector with its bias has squared length 2
            if step := (new - dual[i]) * sign[i]:
                weight[at] += step * v
                bias += step
                dual[i] = new
    return Model(ratio, weight, bias)


def fit(rows: list[bytes], label: np.ndarray, folds: int = 3) -> Model:
    """The calibrated model. With one class, or none, scores are the smoothed share of label 1."""
    if len(set(label.tolist())) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, math.log(share / (1 - share)))
    model = fit_margin(rows, label)
    margin = np.array([model.margin(unpacked(raw)) for raw in rows])
    fold = np.arange(len(rows)) % folds
    if min(np.bincount(label[fold != k], minlength=2).min() for k in range(folds)):
        for k in range(folds):
            part = fit_margin([raw for raw, f in zip(rows, fold) if f != k], label[fold != k])
            margin[fold == k] = [part.margin(unpacked(raw)) for raw, f in zip(rows, fold) if f == k]
    # logistic curve by Newton steps towards Platt's softened targets, classes balanced as in the fit
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0) * len(label)
    x, theta = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (p - target)) + 1e-3 * (theta - [1, 0]))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(theta[0], 1e-3)), float(theta[1])
    return model


def third(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; rows where it is 1 are held out. A null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labelled: int = MOST_LABELLED, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the `most_labelled` labelled documents, not held out, whose hashed ids are least.

    Null labels and ids don't count, repeated labels and ids do once; with no labelled row, or one class, every score is the same.
    Of the indicators, most_bytes at most come to the driver, row by row in the order of the hashes. Other columns are not read, whatever their names.
    """
    chosen = labels.where(third(id_col) != 1).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("label")).where("i IS NOT NULL").distinct()
    chosen = chosen.orderBy(F.xxhash64("i"), "i", "label").limit(most_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [packed(indicators(t)) for t in batch.column("text").to_pylist()]
            digest = pa.array([zlib.crc32((t or "").encode()) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("label"), pa.array(found, pa.binary()), digest], ["i", "label", "at", "digest"])

    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = text.join(F.broadcast(chosen), F.expr("doc = i")).select("i", "label", "text")  # most_labelled rows at most
    found = found.mapInArrow(tidied(run), f"i {labels.schema[id_col].dataType.simpleString()}, label int, at binary, digest long")
    found = found.groupBy("i", "label").agg(F.min_by("at", F.struct("digest", "at")).alias("at"))  # of rows with one id, one
    rows, label, total = [], [], 0
    for r in found.orderBy(F.xxhash64("i"), "i", "label").toLocalIterator():
        total += len(r["at"])
        if total > most_bytes:
            break
        rows.append(bytes(r["at"]))
        label.append(r["label"])
    return fit(rows, np.array(label, np.int64))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id_col, *keep, score, predicted) for every document; empty and null texts get a score as well.

    Repeated rows stay, an empty table gives an empty one; columns not in `keep` go, whatever their names.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of 2^BITS numbers
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    source = text_col if text_col in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, source):
            found = [fitted.value.score(indicators(t)) for t in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (id_col, *keep)], pa.array(found, pa.float64())], [id_col, *keep, "score"])

    rows = docs.select(id_col, *keep, *([F.col(text_col).alias("_text")] if source == "_text" else []))
    return rows.mapInArrow(tidied(run), f"{kinds}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
