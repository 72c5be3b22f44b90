"""A quality classifier on supervised subword embeddings.

Words and the character n-grams inside them are hashed to rows of one table of vectors; a
word that repeats one of the two before it counts as a feature of its own besides. A text
is the mean of its vectors; a softmax layer on top gives the probability of each label.
Table and layer are learned together by stochastic gradient descent in numpy.

The bound on learning: ``TRAIN_ROWS`` labelled ids, the first in a fixed shuffled order, one
label (the smaller) and one text (that with the least hash) of each. These texts are read
whole, in tasks; what reaches the driver is, per id, the share of each of at most ``BUCKETS``
features. Every other row is scored whole.

To score, the layer is applied to the table once, which leaves two numbers per feature; the
mean of these over a text is what the layer makes of its mean vector.

Cases: a null, empty or blank text has no feature and gets what the layer makes of a zero
vector. Words longer than ``LONGEST`` bytes are read in pieces of that length. Repeated rows
score alike. Without labelled rows every score is 0.5. A null id, or a null label, is not
learned from. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TRAIN_ROWS = 4000
BUCKETS = 1 << 15
DIMENSIONS = 12
GRAMS = (2, 3, 4)
LONGEST = 64
EPOCHS = 12
RATE = 4.0
_PIECE = 1 << 20  # bytes of a text that are hashed at once

_U = np.uint32
_PRIME, _SPREAD = _U(16777619), _U(2654435761)
_AGAIN = _U(97)  # the feature of a word that repeats one of the two before it


def _features_of(raw: np.ndarray) -> np.ndarray:
    """Feature numbers of a stretch of bytes; 1 stands at both ends of each word."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    step = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, np.int64)
    pieces = (end - start + LONGEST - 1) // LONGEST
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(start, pieces) + nth * LONGEST
    end = np.minimum(np.repeat(end, pieces), start + LONGEST)
    size = end - start
    marked = np.ones(int((size + 2).sum()), _U)  # each word between two marks
    first = np.cumsum(size + 2) - size - 2
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letter = raw[np.repeat(start, size) + nth].astype(_U) + _U(2)
    marked[np.repeat(first + 1, size) + nth] = letter
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(LONGEST, _PRIME, _U), dtype=_U)
        words = np.add.reduceat(letter * powers[nth], np.cumsum(size) - size, dtype=_U)
        again = np.zeros(len(words), bool)
        for back in (1, 2):
            again[back:] |= words[back:] == words[:-back]
        found = [words * _SPREAD + _U(1), np.repeat(_AGAIN, again.sum())]
        word = np.repeat(np.arange(len(size)), size + 2)
        for n in GRAMS:
            if len(marked) < n:
                continue
            value = np.zeros(len(marked) - n + 1, _U)
            for i in range(n):
                value = value * _PRIME + marked[i:len(marked) - n + 1 + i]
            found.append((value * _SPREAD + _U(n))[word[:len(value)] == word[n - 1:]])
    every = np.concatenate(found)
    return ((every ^ (every >> _U(15))) & _U(BUCKETS - 1)).astype(np.int64)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Feature numbers of the whole text, in pieces that end at a space where there is one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        if end < len(raw):
            end = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end), at) + 1
            end = end if end > at + 1 else min(len(raw), at + _PIECE)
        yield _features_of(np.frombuffer(raw, np.uint8, end - at, at))
        at = end


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dimensions
    layer: np.ndarray  # dimensions x labels
    bias: np.ndarray

    def per_feature(self) -> np.ndarray:
        """How far each feature pulls from label 0 to label 1."""
        both = self.vectors @ self.layer
        return both[:, 1] - both[:, 0]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Stochastic gradient descent over ``(features, shares, label)``, one row at a time."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS, np.zeros((DIMENSIONS, 2)), np.zeros(2))
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, shares, label = rows[i]
            now = rate * (1 - done / steps) if done else rate
            done += 1
            mean = shares @ model.vectors[ids]
            logits = mean @ model.layer + model.bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = model.layer @ wrong
            model.layer -= 0.1 * now * np.outer(mean, wrong)
            model.bias -= 0.02 * now * wrong
            model.vectors[ids] -= now * np.outer(shares, back)
    return model


def counted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Feature counts of the first ``rows`` ids of ``labels (doc_id, label)``, which are
    chosen before any text is read. One row per id, however often it repeats."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, label in zip(batch["doc_id"], batch["text"], batch["label"]):
                total = np.zeros(BUCKETS, np.int64)
                for found in features(text):
                    total += np.bincount(found, minlength=BUCKETS)
                ids = np.flatnonzero(total)
                out.append((doc_id, label, ids.astype("<u2").tobytes(),
                            (total[ids] / max(1, total.sum())).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "label", "ids", "shares"])

    usable = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min(F.col("label").cast("int")).alias("label"))
    first = usable.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(rows)
    said = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_said"))
    one = said.join(F.broadcast(first), "doc_id").groupBy("doc_id", "label").agg(F.min("_said").alias("_said"))
    found = said.join(F.broadcast(one), ["doc_id", "_said"]).select("doc_id", "text", "label").mapInPandas(
        of, "doc_id bigint, label int, ids binary, shares binary")
    # rows that repeat as a whole give the same counts
    return found.groupBy("doc_id").agg(F.min(F.struct("label", "ids", "shares")).alias("_row")).select("doc_id", "_row.*")


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model, or None without rows. ``docs`` has ``doc_id, text``, ``labels`` ``doc_id, label``."""
    found = [(r["doc_id"], r["label"], np.frombuffer(r["ids"], "<u2").astype(np.int64), np.frombuffer(r["shares"], "<f4"))
             for r in counted(docs, labels, rows).collect()]
    found.sort(key=lambda r: (r[0], r[1], len(r[2])))
    found = [(ids, shares, label) for _, label, ids, shares in found if len(ids)]
    return train(found) if found else None


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``score``, the probability of label 1, for every row."""
    pull = model.per_feature().astype(np.float64) if model else np.zeros(BUCKETS)
    bias = float(model.bias[1] - model.bias[0]) if model else 0.0

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                total = number = 0
                for found in features(text):
                    total += pull[found].sum()
                    number += len(found)
                scores.append(float(1 / (1 + np.exp(-np.clip(bias + total / max(1, number), -30, 30)))))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(scores, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*keep, F.col("text").alias("_read"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(of, f"{kept}, score double")
