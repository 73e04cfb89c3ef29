"""Quality classifier: naive Bayes support vectors.

Features are indicators of word n-grams and of n-grams of word shapes (case,
letters, digits and signs of a word, and whether it repeats the word before).
Each indicator is scaled by its class log-count ratio; a linear hinge-loss model
is fitted to the scaled, normalised rows by dual coordinate descent; a logistic
curve, fitted to margins of rows left out of a first fit, turns margins into
scores from 0 to 1.

The fit takes at most ``most_rows`` labelled rows, chosen by a hash of their
id; the model has at most 2**SLOT_BITS features, so the driver holds bounded
data. Scoring reads every whole text where it lies, without a shuffle.

Defined results: a null or empty text scores by the bias alone; without labelled
rows of both classes the score is the share of class 1, or 0.5 without any; a
labelled id whose labels differ is left out, repeated rows of one id train once;
texts of any length are read whole, and equal texts score alike; an empty table gives
an empty table; other columns pass through, and a column that has the result's name
gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: The slots of the feature table, as a power of two.
SLOT_BITS = 19

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")


def shape(word: bytes) -> bytes:
    """Runs of small letters, capitals and digits become one sign each; others stay, thrice at most."""
    word = _DIGITS.sub(b"0", _LETTERS.sub(b"a", _CAPITALS.sub(b"A", word)))
    return re.sub(rb"(.)\1{3,}", rb"\1\1\1", word, flags=re.S)


def _shape_hashes(words: list[bytes]) -> list[bytes]:
    return [xxhash.xxh64_digest(shape(w), seed=1) for w in words]


def _pairs(h: np.ndarray, seed: int) -> np.ndarray:
    return common.mixed(h[:-1] * np.uint64(0xA24BAED4963EE407) + (h[1:] ^ np.uint64(seed)) * np.uint64(0x9FB21C651E98DF25))


class Features:
    """A text's n-grams as 64-bit hashes, repeats included."""

    def __init__(self):
        self.shapes = common.WordTable(_shape_hashes)

    def admit(self, texts: list[list[bytes]]) -> None:
        self.shapes.admit(texts)

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        names = common.word_hashes(words)
        shapes = np.frombuffer(b"".join(map(self.shapes.__getitem__, words)), np.uint64)
        if len(words) == 1:
            return np.concatenate([names, shapes])
        again = (names[1:] == names[:-1]).astype(np.uint64)
        return np.concatenate([names, shapes, _pairs(names, 1), common.mixed(_pairs(shapes, 2) + again)])


def _slots(keys: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The slots of those features that the table holds, each once."""
    slots = (features >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    return np.unique(slots[keys[slots] == features])


@dataclass(frozen=True)
class Model:
    """keys[slot] is a feature, weights[slot] what it adds, ratios[slot] its log-count ratio."""

    keys: np.ndarray
    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float
    default: float | None

    def margin(self, features: np.ndarray) -> float:
        return self.margin_of(_slots(self.keys, features))

    def margin_of(self, slots: np.ndarray) -> float:
        norm = float(np.sqrt((self.ratios[slots] ** 2).sum()))
        return (float(self.weights[slots].sum()) / norm if norm else 0.0) + self.bias

    def score(self, features: np.ndarray) -> float:
        if self.default is not None:
            return self.default
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -60.0, 60.0))))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, costs: np.ndarray, size: int, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights of min w.w/2 + sum costs * hinge, by coordinate descent on the dual.

    rows: (indices, values); the last weight is the bias, a feature of value 1.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            gradient = signs[i] * (float(w[index] @ value) + w[-1]) - 1.0
            before = alpha[i]
            after = min(max(before - gradient / squares[i], 0.0), costs[i])
            if after != before:
                step = (after - before) * signs[i]
                w[index] += step * value
                w[-1] += step
                alpha[i] = after
                most = max(most, abs(after - before))
        if most < 1e-3:
            break
    return w


def logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with smoothed targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    beta = np.array([1.0, float(np.log((ones + 1) / (len(labels) - ones + 1)))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * np.array([beta[0] - 1.0, 0.0]))
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 0.05), float(beta[1])


def train(documents: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, smoothing: float = 1.0, least: int = 3, epochs: int = 20) -> Model:
    """Fit to the distinct features of each document and its label, 0 or 1; the list of documents is emptied."""
    slots = 1 << SLOT_BITS
    empty = np.zeros(slots), np.zeros(slots)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(slots, np.uint64), *empty, 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    found, counts = np.unique(np.concatenate(documents), return_counts=True)
    found, counts = found[counts >= least], counts[counts >= least]
    order = np.argsort(counts, kind="stable")
    keys = np.zeros(slots, np.uint64)
    keys[(found[order] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = found[order]  # of a slot's features the commonest stays
    del found, counts, order
    index = [_slots(keys, d) for d in documents]
    documents.clear()

    def fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = {c: np.bincount(np.concatenate([index[i] for i in rows if labels[i] == c] or [np.empty(0, np.int64)]), minlength=slots) + smoothing for c in (0, 1)}
        ratios = np.log((of[1] / of[1].sum()) / (of[0] / of[0].sum()))
        ratios[keys == 0] = 0.0
        scaled = [(index[i], ratios[index[i]]) for i in rows]
        scaled = [(k, v / (np.sqrt(v @ v) or 1.0)) for k, v in scaled]
        share = labels[rows].mean()
        costs = np.where(labels[rows] == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * cost
        return dual_descent(scaled, np.where(labels[rows] == 1, 1.0, -1.0), costs, slots, epochs), ratios

    def model(w: np.ndarray, ratios: np.ndarray, slope: float = 1.0, offset: float = 0.0) -> Model:
        return Model(keys, w[:-1] * ratios, ratios, float(w[-1]), slope, offset, None)

    everything = np.arange(len(labels))
    margins = np.full(len(labels), np.nan)
    for k in range(3):
        inside, outside = everything[everything % 3 != k], everything[everything % 3 == k]
        if labels[inside].min() != labels[inside].max():
            part = model(*fit(inside))
            margins[outside] = [part.margin_of(index[i]) for i in outside]
    seen = ~np.isnan(margins)
    slope, offset = logistic(margins[seen], labels[seen]) if seen.any() and labels[seen].min() != labels[seen].max() else (1.0, 0.0)
    return model(*fit(everything), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", most_rows: int = 8000, **options) -> Model:
    """Fit to labelled rows: those of labels whose label is 0 or 1, at most most_rows by a hash of the id.

    The chosen ids are bounded by most_rows, so they may be broadcast, and the
    corpus itself is not shuffled.
    """
    common.small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(id_column)
        .agg(F.min(label).alias("__label"), F.max(label).alias("__other"))
        .where("__label = __other")
        .orderBy(F.xxhash64(id_column), id_column)
        .limit(most_rows)
        .select(F.col(id_column).alias("__id"), "__label")
    )
    rows = (
        docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
        .join(F.broadcast(chosen), "__id")
        .groupBy("__id", "__label")
        .agg(F.min("__text").alias("__text"))
        .select("__id", "__label", F.col("__text").cast("binary").alias("__text"))
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        maker = Features()
        for batch in batches:
            for i, text_bytes in enumerate(common.binaries(batch.column(2))):
                words = text_bytes.split()
                maker.admit([words])
                packed = np.unique(maker.of(words)).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).cast(pa.string()), batch.column(1).slice(i, 1).cast(pa.int32()), pa.array([packed], pa.binary())], ["id", "label", "features"])

    found = rows.mapInArrow(features, "id string, label int, features binary").toArrow().sort_by("id")
    labels_found = np.array(found["label"].to_pylist(), np.int64)
    documents = [np.frombuffer(b, np.uint64) for b in found["features"].to_pylist()]
    del found
    return train(documents, labels_found, **options)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with one double column more, named out: how likely class 1 is, by the text alone."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.lean_worker()
        maker, fitted = Features(), shared.value
        for texts in batches:
            scores = []
            for portion in common.portions(common.binaries(texts)):
                words = [t.split() for t in portion]
                maker.admit(words)
                scores += [fitted.score(maker.of(ws)) for ws in words]
            yield pa.array(scores, pa.float64())

    return docs.withColumn(out, F.arrow_udf(run, "double")(common.as_bytes(text)))
