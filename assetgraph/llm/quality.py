"""Quality by ordinal cumulative-link regression on graded ratings.

A text is a bag of hashed features (words, word pairs, endings, shapes, repetitions); its position s is the mean of their
shared weights. Ordered thresholds t_1 < ... < t_K give P(grade >= k) = sigmoid(s - t_k), hence the expected grade and
the tail probability that selects documents.

The fit uses at most `SAMPLE_ROWS` rated rows and `SAMPLE_BYTES` bytes of their texts, those with the smallest key hashes; scoring covers
every document whole. The sample's features come to the driver as counts of distinct features, at most one for each five bytes of text or so.
Defined results: null and empty texts have no features and take s = 0. Ratings that are null are left out, of several for a
document the smallest counts; with fewer than two grades the model is flat (all weights 0). Repeated rows are rated and scored as rows of
their own. An empty table gives no rows; further columns are not looked at (`score`) or stay (`select`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import bounded, doc_texts, map_blocks, sample_texts
from assetgraph.llm.textvec import LOWER, mix, ngram_hash, span_hash, text_bytes, words

#: The bounds on the rows that the fit sees and on their texts.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 12 << 20
BITS = 18
STEPS = 120
L2 = 1e-4

_U = np.uint64
_SHAPE = np.full(256, 4, np.int64)
_SHAPE[:128] = 3
_SHAPE[48:58] = 2
_SHAPE[65:91] = 1
_SHAPE[97:123] = 0


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all texts in a block and the n + 1 offsets of each text's."""
    buf, offsets = text_bytes(column)
    starts, ends, of = words(buf, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = span_hash(LOWER[buf], starts, ends)
    ending = span_hash(buf, np.maximum(starts, ends - 3), ends)
    first, last, second = buf[starts], buf[ends - 1], buf[np.minimum(starts + 1, ends - 1)]
    shape = ((_SHAPE[first] * 5 + _SHAPE[second]) * 5 + _SHAPE[last]) * 16 + np.minimum(ends - starts, 15)
    again = np.zeros(n, bool)
    again[1:] = word[1:] == word[:-1]
    again[of[:-1][of[:-1] < n]] = False
    pair, pair_of = ngram_hash(word, of, 2)
    own = np.stack([word, mix(ending + _U(1)), mix(shape.astype(_U) + _U(1 << 20)), mix(again.astype(_U) + _U(1 << 30))], axis=1)
    own[again, :3] = mix(np.arange(3, dtype=_U) + _U(1 << 31))  # a repeated word says that it repeats, not what it is
    own = own.ravel()
    at = np.concatenate([own, mix(pair + _U(7))])
    text = np.concatenate([np.repeat(np.arange(len(of) - 1), np.diff(of) * 4), np.repeat(np.arange(len(of) - 1), np.diff(pair_of))])
    order = np.argsort(text, kind="stable")
    return (at >> _U(64 - bits)).astype(np.int64)[order], of * 4 + pair_of


@dataclass(frozen=True)
class Ordinal:
    """A fitted cumulative-link model; thresholds[k - 1] belongs to grade k."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[int, ...]

    def position(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each threshold, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -60, 60)))

    def expected(self, s: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(s) @ np.diff(np.asarray(self.grades, float))


class Sample:
    """Counted features of rated documents, by document and by feature, so that both sums of a step are sums over ranges."""

    def __init__(self, doc: np.ndarray, feature: np.ndarray, count: np.ndarray, docs: int):
        """doc ascends; each (doc, feature) stands once."""
        self.docs, self.doc, n = docs, doc.astype(np.int32), len(doc)
        total = np.maximum(np.bincount(self.doc, count, docs), 1).astype(np.float32)
        self.share = count.astype(np.float32) / total[self.doc]
        new = np.ones(n, bool)
        new[1:] = self.doc[1:] != self.doc[:-1]
        self.doc_at = np.flatnonzero(new)
        self.filled = self.doc[self.doc_at]
        by = np.argsort(feature, kind="stable").astype(np.int32)
        self.by_doc, self.by_share, feature = self.doc[by], self.share[by], feature[by]
        new[1:] = feature[1:] != feature[:-1]
        self.feature_at = np.flatnonzero(new)
        self.seen = feature[self.feature_at]
        self.place = np.empty(n, np.int32)
        self.place[by] = np.cumsum(new, dtype=np.int32) - 1

    def positions(self, w: np.ndarray) -> np.ndarray:
        """The mean weight of each document's features; w: of the features that occur."""
        out = np.zeros(self.docs)
        if len(self.filled):
            each = w.astype(np.float32)[self.place]
            each *= self.share
            out[self.filled] = np.add.reduceat(each, self.doc_at, dtype=np.float64)
        return out

    def gradient(self, by_doc: np.ndarray) -> np.ndarray:
        if not len(self.seen):
            return np.zeros(0)
        each = by_doc.astype(np.float32)[self.by_doc]
        each *= self.by_share
        return np.add.reduceat(each, self.feature_at, dtype=np.float64)


def loss_and_gradient(sample: Sample, y: np.ndarray, w: np.ndarray, raw: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood with its penalty, and its gradient by w and raw. Thresholds: raw[0], then gaps exp(raw[k])."""
    n, k = len(y), len(raw)
    gaps = np.exp(raw[1:])
    ext = np.concatenate([[-1e9], raw[0] + np.concatenate([[0.0], np.cumsum(gaps)]), [1e9]])
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    s = sample.positions(w)
    upper, lower = sigmoid(ext[y + 1] - s), sigmoid(ext[y] - s)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    gt = (np.bincount(y + 1, -du / p / n, k + 2) + np.bincount(y, dl / p / n, k + 2))[1:-1]
    after = np.cumsum(gt[::-1])[::-1]
    return float(-np.log(p).mean() + l2 / n / 2 * (w * w).sum()), np.concatenate([sample.gradient((du - dl) / p / n) + l2 / n * w, [after[0]], after[1:] * gaps])


def fit_ordinal(sample: Sample, grade: np.ndarray, bits: int = BITS, steps: int = STEPS, l2: float = L2) -> Ordinal:
    """Maximum likelihood by Adam over the whole sample; thresholds stay ordered as cumulated positive gaps."""
    grades = tuple(int(g) for g in np.unique(grade))
    weights = np.zeros(1 << bits, np.float32)
    if len(grades) < 2:
        return Ordinal(weights, np.zeros(0), grades or (0,))
    y = np.searchsorted(grades, grade)
    share = np.array([(y >= j + 1).mean() for j in range(len(grades) - 1)])
    t0 = np.log((1 - share + 1e-6) / (share + 1e-6))
    raw = np.concatenate([t0[:1], np.log(np.maximum(np.diff(t0), 1e-3))])
    size = len(sample.seen)
    w, m, v = np.zeros(size), np.zeros(size + len(raw)), np.zeros(size + len(raw))
    for step in range(1, steps + 1):
        _, g = loss_and_gradient(sample, y, w, raw, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w -= move[:size]
        raw = raw - 0.2 * move[size:]
    weights[sample.seen] = w
    return Ordinal(weights, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]), grades)


def counted(ids: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of the distinct features of a block, by document."""
    pair, count = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) << bits | ids, return_counts=True)
    return pair >> bits, pair & ((1 << bits) - 1), count


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, bits: int = BITS) -> Ordinal:
    """ratings: doc_id and an integer grade. Features are made on the executors; those of a sample bounded in rows and bytes come back."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    texts = sample_texts(docs, rated, sample, size)

    def run(batches):
        from assetgraph.llm.textvec import blocks

        for batch in batches:
            for b in blocks(batch, "text"):
                doc, feature, count = counted(*features(b.column("text"), bits), bits)
                at = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (feature, count)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), *lists], ["doc_id", "grade", "ids", "counts"])

    found = texts.mapInArrow(run, "doc_id long, grade int, ids array<int>, counts array<int>").toArrow().sort_by([("doc_id", "ascending")])
    flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in found.column(c).chunks] or [np.zeros(0, np.int32)])
    sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in found.column("ids").chunks] or [np.zeros(0, np.int32)])
    grade = found.column("grade").to_numpy().copy()
    made = Sample(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), flat("ids"), flat("counts"), len(sizes))
    del found, flat
    model = fit_ordinal(made, grade, bits)
    del made
    pa.default_memory_pool().release_unused()  # the driver needs the sample no longer
    return model


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 junk, 1 sound but toxic, 2 sound."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).when(F.col("quality") == 0, 0).alias("grade"))


def score(docs: DataFrame, model: Ordinal, at_least: int = 1, bits: int = BITS) -> DataFrame:
    """doc_id, expected_grade, tail (the probability of a grade of `at_least` or more) and selected (tail >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights
    column = max(0, int(np.searchsorted(model.grades, at_least)) - 1)

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        s = model.position(*features(block.column("text"), bits))
        tails = model.tails(s)
        tail = tails[:, column] if tails.shape[1] else np.full(len(s), 0.5)
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(model.expected(s) if tails.shape[1] else np.full(len(s), float(model.grades[0]))), pa.array(tail), pa.array(tail >= 0.5)],
            ["doc_id", "expected_grade", "tail", "selected"],
        )

    return map_blocks(doc_texts(docs), "text", run, "doc_id long, expected_grade double, tail double, selected boolean")


def select(docs: DataFrame, model: Ordinal, at_least: int = 1, bits: int = BITS) -> DataFrame:
    """docs without the rows whose tail probability is under one half; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = max(0, int(np.searchsorted(model.grades, at_least)) - 1)
    where = docs.columns.index("text")

    def run(batches):
        from assetgraph.llm.textvec import blocks

        model = shared.value
        for batch in batches:
            for b in blocks(batch, batch.schema.names[where]):
                tails = model.tails(model.position(*features(b.column(where), bits)))
                yield b.filter(pa.array(tails[:, column] >= 0.5)) if tails.shape[1] else b

    return bounded(docs).mapInArrow(run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, graded(table(spark, sf_dir, "labels"))))
