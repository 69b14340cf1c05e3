"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes.

Indicators of word n-grams and of word-shape n-grams are hashed to a fixed space.  Each is
scaled by its class log-count ratio, rows are brought to length one, and the model is fit
by dual coordinate descent.  Margins become scores by a logistic curve fit on a part of the
training rows that the model has not seen.

Fitting uses a bounded sample of the labelled rows (SAMPLE_ROWS, and SAMPLE_FEATURES
indicators in all), so it fits a driver at any corpus size; every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail.llm.common import WORD, Memo, bounded_batches, map_rows, mix64, per_worker, whole_text

SPACE_BITS = 18
SHAPE_ORDERS, WORD_ORDERS = 3, 2
SAMPLE_ROWS = 4_000
SAMPLE_FEATURES = 20_000_000
CALIBRATION = 5  # every fifth sampled row shapes the curve, not the model
FOLDS = 5
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 15
WORDS_KEPT = 500_000

_words = re.compile(WORD)
_runs = re.compile(r"([^\W\d_]+)|(\d+)|(.)\3*", re.DOTALL)


def shape(word: str) -> str:
    """Letter runs as a, A or Aa, digit runs as 0, other runs as their character."""
    out = []
    for m in _runs.finditer(word):
        letters = m[1]
        if letters:
            out.append("a" if letters.islower() else "A" if letters.isupper() and len(letters) > 1
                       else "Aa" if letters[0].isupper() else "b")
        else:
            out.append("0" if m[2] else m[3])
    return "".join(out)


def _word_and_shape(word: str) -> int:
    """Hash of the lower-case word above a hash of its shape, 32 bits each."""
    return xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape(word))


def features(text: str) -> np.ndarray:
    """Sorted indices of the indicators that a text has; none for a text without words."""
    memo = per_worker("quality-words", lambda: Memo(_word_and_shape, WORDS_KEPT))
    words = _words.findall(text)
    both = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    # whether a word repeats the one before belongs to its shape
    again = np.zeros(len(words), np.uint64)
    again[1:] = word[1:] == word[:-1]
    found = []
    for kind, base, orders in ((1, form * np.uint64(2) + again, SHAPE_ORDERS), (2, word, WORD_ORDERS)):
        h = np.full(len(words), kind, np.uint64)
        for n in range(orders):
            h = mix64(h[:len(h) - (n > 0)] * np.uint64(31) + base[n:])
            found.append(h >> np.uint64(64 - SPACE_BITS))
    return np.unique(np.concatenate(found)).astype(np.int32)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


@dataclass
class Model:
    weights: np.ndarray  # of each indicator, the naive Bayes ratio included
    ratios: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, index: np.ndarray) -> float:
        if not len(index):
            return self.bias
        norm = float(np.sqrt(np.square(self.ratios[index], dtype=np.float64).sum()))
        return self.bias + float(self.weights[index].sum(dtype=np.float64)) / (norm or 1.0)

    def score(self, text: str) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << SPACE_BITS), SMOOTHING)
    for index, label in zip(rows, labels):
        counts[int(label > 0), index] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; rows are (indices, values), labels -1 or 1.

    One dual variable a row, from 0 to `cost`; rows in a fixed shuffled order each epoch.
    """
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    squares = np.array([float(v @ v) + 1 for _, v in rows])
    random = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            index, values = rows[i]
            gradient = labels[i] * (float(w[index] @ values) + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), cost)
            step = (new - alpha[i]) * labels[i]
            if step:
                w[index] += step * values
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on smoothed targets."""
    n1 = int((labels > 0).sum())
    n0 = len(labels) - n1
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        q = p * (1 - p) + 1e-9
        cross = float((q * margins).sum())
        h = np.array([[float((q * margins**2).sum()) + 1e-6, cross], [cross, float(q.sum()) + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit_model(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of index rows with labels -1 and 1; a constant one where a class is missing."""
    size = 1 << SPACE_BITS
    if not len(rows) or len(set(labels.tolist())) < 2:
        share = (float((labels > 0).sum()) + 1) / (len(rows) + 2)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % CALIBRATION == 0
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        held[:] = False
    ratios = log_count_ratios([r for r, h in zip(rows, held) if not h], labels[~held])

    def scaled(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = ratios[index]
        return index, values / (np.sqrt(values @ values) or 1.0)

    w, bias = dual_descent([scaled(r) for r, h in zip(rows, held) if not h], labels[~held], size)
    model = Model((w * ratios).astype(np.float32), ratios.astype(np.float32), bias)
    curve = [(model.margin(r), y) for r, y, h in zip(rows, labels, held) if h or not held.any()]
    model.slope, model.offset = fit_curve(*map(np.array, zip(*curve)))
    return model


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Indicators and labels of the sample: labelled rows outside the held-out fold, by a hash of the id."""
    order = F.xxhash64(F.lit("quality"), "doc_id")
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & (fold() != 0))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(order, "doc_id").limit(SAMPLE_ROWS)
    )
    # at most SAMPLE_ROWS pairs of numbers
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for doc, text, quality in zip(*(c.to_pylist() for c in batch.columns)):
                yield doc, int(quality), features(text).tobytes()

    kept, marks, total = [], [], 0
    found = map_rows(texts.select("doc_id", "text", "quality"), rows, "doc_id long, quality int, found binary")
    found = found.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", F.xxhash64("found")).limit(SAMPLE_ROWS)
    for row in found.toLocalIterator():
        index = np.frombuffer(row["found"], np.int32)
        total += len(index)
        if total > SAMPLE_FEATURES:
            break
        kept.append(index)
        marks.append(1 if row["quality"] else -1)
    return kept, np.array(marks)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit_model(*training_rows(docs, labels))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `score` and `predicted` of every whole text.

    Null and empty texts get the score of a text without indicators.  Labels, language,
    source and id are not looked at; equal texts get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of fixed size

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                score = sent.value.score(text)
                yield doc, score, int(score >= THRESHOLD)

    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", whole_text().alias("text"))
    return map_rows(source, rows, f"doc_id {kind}, score double, predicted int")


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose score reaches THRESHOLD."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def kept(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [sent.value.score(t or "") >= THRESHOLD for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(marks, pa.bool_()))

    return bounded_batches(docs).mapInArrow(kept, docs.schema)
