"""Quality by Bradley-Terry ranking of preference pairs.

Every text becomes a short vector of surface features. A pair of labelled
training texts, a good one and a bad one drawn at random, says that the good
one is preferred; the model's score is linear in the features, and the
probability of a preference is the logistic function of the score difference,
so training is logistic loss on feature differences. The cut is a quantile of
the training texts' scores, the one at which most of them are told right; the
logistic function, shifted so that the cut becomes ``CUT``, maps scores to 0..1.

Defined cases: null and empty texts have a vector of their own and are scored;
without both labels every text scores 1 (nothing is rejected); repeated rows
score alike; texts are read whole, however long; an empty table gives an empty
result; texts with equal features tie and are kept or rejected together; where
labels of one doc_id contradict each other, 1 counts; extra columns are ignored
by ``scored`` and kept by ``kept``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import words as W
from palisade.llm.labelled import fold, sample
from palisade.llm.workers import released

MOST = 3000  # labelled rows of each class
PAIRS = 60_000  # preference pairs, drawn from them
CUT = 0.3  # the score at which a text is kept
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "bang": (33,),
    "bar": (124,), "mark": (35, 36, 37, 38, 42), "stop": (44, 46, 58, 59, 63), "other": (*range(34, 36), *range(39, 48), *range(60, 63), 64, *range(91, 97), 123, 125, 126), "wide": range(128, 256),
}
_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF[list(_bytes)] = _i


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text, none of which knows a language, a source or an id."""
    raw, _ = W.raw(texts)
    w = W.words(texts)
    n = len(texts)
    size = np.maximum(1, np.diff(w.offsets)).astype(np.float64)
    kinds = len(_CLASSES) + 1
    owner = np.repeat(np.arange(n), np.diff(w.offsets))
    share = np.bincount(owner * kinds + _OF[raw], minlength=n * kinds).reshape(n, kinds) / size[:, None]
    h, count = W.hashes(w), np.diff(w.first).astype(np.float64)
    some = np.maximum(count, 1)
    text = w.text_of()
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(text, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(text, length * length, n) / some - mean * mean))
    ends = np.zeros(len(h), np.int64)
    if len(h):
        ends = _OF[raw[w.end - 1]]
    marked = [np.bincount(text, ends == k, n) / some for k in (_OF[ord("!")], _OF[ord("#")], _OF[ord("|")], _OF[ord(",")])]
    loud = np.zeros(n)
    if len(h):
        upper = np.concatenate([[0], np.cumsum(_OF[raw] == 0)])
        all_upper = (upper[w.end] - upper[w.start] >= np.maximum(2, 0.6 * length)).astype(np.float64)
        loud = np.bincount(text, all_upper, n) / some
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    same = np.bincount(text, again, n) / some
    distinct, runs = np.ones(n), np.ones(n)
    s, at = W.shingles(w, h, 3)
    for i in np.flatnonzero(count > 1):
        distinct[i] = len(np.unique(h[w.first[i] : w.first[i + 1]])) / count[i]
        runs[i] = len(np.unique(s[at[i] : at[i + 1]])) / (at[i + 1] - at[i])
    long = np.log1p(count)
    plain = np.column_stack([share, *marked, loud, same, 1 - distinct, 1 - runs, mean / 8, spread / 8])
    saturated = np.column_stack([np.minimum(1, 8 * x) for x in (*marked[:3], loud, same, 1 - runs, share[:, 5], share[:, 6], share[:, 7])])
    return np.column_stack([plain, saturated, long / 8, (1 - distinct) * long / 8, (long < 3.5), (count == 0)])


class Model:
    """Weights, cut and scale."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 3):
        y = np.array(labels, np.int64)
        self.ready = len(set(labels)) == 2
        if not self.ready:
            return
        x = np.concatenate([features(pa.array(texts[i : i + 1000], pa.string())) for i in range(0, len(texts), 1000)])
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.spread
        rng = np.random.default_rng(seed)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        left, right = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
        difference = x[left] - x[right]
        self.weights, moment, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for step in range(1, 1501):
            part = difference[rng.integers(0, PAIRS, 512)]
            missed = 1 / (1 + np.exp(np.clip(part @ self.weights, -30, 30)))
            slope = -(missed @ part) / len(part) + 1e-3 * self.weights
            moment += 0.1 * (slope - moment)
            second += 0.01 * (slope * slope - second)
            self.weights -= 0.03 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        score = x @ self.weights
        order = np.argsort(score)
        # told right if the lowest i texts are rejected; both classes weigh as much
        right_bad = np.concatenate([[0], np.cumsum(y[order] == 0)]) / len(bad)
        right_good = 1 - np.concatenate([[0], np.cumsum(y[order] == 1)]) / len(good)
        value = right_bad + right_good
        best = np.flatnonzero(value >= value.max() - 1e-9)
        self.quantile = best[len(best) // 2] / len(y)
        self.cut = float(np.quantile(score, self.quantile))
        self.scale = 4 / max(1e-6, float(np.median(score[y == 1]) - np.median(score[y == 0])))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.ready:
            return np.ones(len(texts))
        score = ((features(texts) - self.mean) / self.spread) @ self.weights
        z = self.scale * (score - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*sample(docs, labels, "quality", MOST))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.pieces(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = CUT) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``; their texts are read once and not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.pieces(whole):
                score = shared.value.scores(b.column(b.schema.get_field_index("text")))
                yield b.filter(pa.array(score >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
