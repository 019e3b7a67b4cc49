"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a document are its hashed words (weight 1 + log count, scaled to length 1), and one indicator
each for the binned statistics of its characters, words and lines and for its n_chars. The score is
logistic(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise part is computed in linear time as
half of the sum over factors of (sum v x)^2 - sum (v x)^2.

The model is fitted in numpy on at most `sample` labelled rows, the first in hash order of doc_id among
those that are not held out; doc_id, lang, source and labels are never features. Scoring is one pass.

Defined cases: a null text counts as empty and gets a score from its statistics; a null or missing n_chars
is a feature of its own; a null doc_id is not held out; labels that are null or without document are not
used; without any usable label every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelgauge.llm.common import encoded, ship

WORDS = 1 << 16
BINS = 24
STATISTICS = 14
SIZE = WORDS + BINS * (STATISTICS + 1)
FACTORS = 8
SAMPLE = 12_000
EPOCHS = 6
THRESHOLD = 0.3
FOLDS = 5
REMEMBERED = 300_000

LETTER, DIGIT, BLANK, MARK, HIGH = range(5)
KIND = np.full(256, MARK, np.uint8)
KIND[128:] = HIGH
for span, kind in ((b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER), (b"0123456789", DIGIT), (b" \t\n\x0b\x0c\r", BLANK)):
    KIND[list(span)] = kind


class Words(dict):
    """Feature number of each word; what does not fit the memory is computed anew."""

    def __missing__(self, word: bytes) -> int:
        number = xxhash.xxh3_64_intdigest(word) % WORDS
        if len(self) < REMEMBERED:
            self[word] = number
        return number


def statistics(text: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Ratios and sizes, each mapped to 0..1 before it is binned."""
    data = np.frombuffer(text, np.uint8)
    n = max(len(data), 1)
    kinds = np.bincount(KIND[data], minlength=5) / n
    upper = np.count_nonzero((data >= 65) & (data <= 90)) / n
    lines = text.split(b"\n")
    counted: dict[bytes, int] = {}
    for word in words:
        counted[word] = counted.get(word, 0) + 1
    total = max(len(words), 1)
    same = np.count_nonzero(data[1:] == data[:-1]) / n
    log = lambda v, top: math.log1p(v) / math.log1p(top)
    return [
        log(len(text), 1 << 20),
        log(len(words), 1 << 18),
        log(len(lines), 1 << 14),
        len(set(lines)) / len(lines),
        len(counted) / total,
        max(counted.values(), default=0) / total,
        log(sum(map(len, words)) / total, 60),
        log(max(map(len, words), default=0), 1000),
        kinds[DIGIT] ** 0.5,
        kinds[MARK] ** 0.5,
        kinds[BLANK] ** 0.5,
        upper**0.5,
        same,
        log(len(text) / len(lines), 1 << 16),
    ] + ([] if n_chars is None else [log(max(n_chars, 0), 1 << 20)])


def features(text: bytes, n_chars: int | None, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, weights) of one document."""
    words = text.lower().split()
    index, count = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
    weight = 1.0 + np.log(count)
    weight /= max(float(np.sqrt((weight * weight).sum())), 1e-9)
    stats = statistics(text, words, n_chars)
    bins = [WORDS + k * BINS + min(int(v * (BINS - 2)) + 1, BINS - 1) for k, v in enumerate(stats)]
    if n_chars is None:
        bins.append(WORDS + STATISTICS * BINS)
    extra = np.full(len(bins), 0.5)
    return np.concatenate([index, np.array(bins, np.int32)]).astype(np.int32), np.concatenate([weight, extra]).astype(np.float32)


@dataclass
class Machine:
    """w0, linear weights and factors, the two last in one matrix (SIZE x (1 + FACTORS))."""

    bias: float
    table: np.ndarray

    def raw(self, index: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the factor sums; every row has at least one feature."""
        part = self.table[index] * weight[:, None]
        sums = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat(part[:, 1:] ** 2, starts, axis=0)
        return self.bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1), sums[:, 1:]

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        index, weight, starts, _ = stacked(docs)
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(index, weight, starts)[0].astype(np.float64), -30, 30)))


def stacked(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(i) for i, _ in docs])
    return np.concatenate([i for i, _ in docs]), np.concatenate([w for _, w in docs]), np.cumsum(lengths) - lengths, lengths


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.15, seed: int = 11) -> Machine:
    """Logistic loss with an adaptive step per coefficient."""
    rng = np.random.default_rng(seed)
    table = np.zeros((SIZE, 1 + FACTORS), np.float32)
    table[:, 1:] = rng.normal(0, 0.02, (SIZE, FACTORS))
    mean = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model = Machine(math.log(mean / (1 - mean)), table)
    past = np.full_like(table, 1e-4)
    for _ in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 128):
            part = order[at : at + 128]
            index, weight, starts, lengths = stacked([docs[i] for i in part])
            raw, sums = model.raw(index, weight, starts)
            slope = (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - labels[part]).astype(np.float32) / len(part)
            model.bias -= 0.5 * float(slope.sum())
            each = np.repeat(slope, lengths)
            touched, place = np.unique(index, return_inverse=True)
            grad = np.empty((len(touched), 1 + FACTORS), np.float32)
            grad[:, 0] = np.bincount(place, each * weight, len(touched))
            pull = (each * weight)[:, None] * (np.repeat(sums, lengths, axis=0) - table[index, 1:] * weight[:, None])
            for f in range(FACTORS):
                grad[:, 1 + f] = np.bincount(place, pull[:, f], len(touched))
            grad += 1e-5 * table[touched]
            past[touched] += grad * grad
            table[touched] -= rate * grad / np.sqrt(past[touched])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _inputs(docs: DataFrame) -> list[Column]:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("text").alias("fm_text"), n_chars.alias("fm_chars")]


def _document_features(batch: pa.RecordBatch, known: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    return [features(t, n, known) for t, n in zip(encoded(batch.column("fm_text")), batch.column("fm_chars").to_pylist())]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on a bounded sample; only its features come to the driver."""
    ship(__name__)
    usable = labels.select(F.col("doc_id").alias("fm_id"), F.col(label).cast("int").alias("fm_label")).filter("fm_id IS NOT NULL AND fm_label IN (0, 1)")
    chosen = usable.filter(~held_out(F.col("fm_id"))).orderBy(F.xxhash64("fm_id"), "fm_id", "fm_label").limit(sample)
    rows = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(chosen), F.col("doc_id") == F.col("fm_id"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            made = _document_features(batch, known)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("fm_id").cast(pa.int64()),
                    "label": batch.column("fm_label"),
                    "numbers": pa.array([i.tobytes() for i, _ in made], pa.binary()),
                    "weights": pa.array([w.tobytes() for _, w in made], pa.binary()),
                }
            )

    found = rows.mapInArrow(extract, "id long, label int, numbers binary, weights binary").toArrow()
    found = found.sort_by([("id", "ascending"), ("label", "ascending"), ("numbers", "ascending")])
    made = [(np.frombuffer(i, np.int32), np.frombuffer(w, np.float32)) for i, w in zip(found["numbers"].to_pylist(), found["weights"].to_pylist())]
    return fit(made, found["label"].to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """All columns of `docs` and the score."""
    ship(__name__)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.table))  # SIZE x (1 + FACTORS) numbers, whatever the data
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, machine = Words(), Machine(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [*part.columns[:-2], pa.array(machine.scores(_document_features(part, known)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-2], name])

    return docs.select("*", *_inputs(docs)).mapInArrow(rate, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rated = score(docs.select("doc_id", "text", *[c for c in ("n_chars",) if c in docs.columns]), train(docs, labels))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    return score(docs, train(docs, labels), "fm_score").filter(F.col("fm_score") >= threshold).select(*docs.columns)
