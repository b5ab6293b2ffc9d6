"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Words, mix, range_hashes, slices

FEATURE_BITS = 20
#: Labelled documents that models are fitted on, the ones with the smallest hashes of their ids.
SAMPLE = 12000
SELECTED = 1500
FOLDS = 3
PREFIXES = (4, 5, 6)
RIDGE = 0.1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, and where each text's begin: whole words, and word beginnings of 4 to 6 bytes."""
    words = Words(texts)
    low = np.where((words.raw >= 65) & (words.raw <= 90), words.raw + 32, words.raw).astype(np.uint64) + np.uint64(1)
    parts = [words.hash]
    for size in PREFIXES:
        head = range_hashes(low, words.start, np.minimum(words.start + size, words.end)) if len(words.start) else words.hash
        parts.append(mix(head + np.uint64(size)))
    hashed = (np.stack(parts, axis=1) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    code = (words.text_of()[:, None] << FEATURE_BITS | hashed).ravel()
    code = np.unique(code)
    first = np.searchsorted(code, np.arange(len(words.count) + 1) << FEATURE_BITS)
    return code & ((1 << FEATURE_BITS) - 1), first


class Rows:
    """A sparse 0/1 matrix in rows, with a few dense columns beside it."""

    def __init__(self, columns: np.ndarray, first: np.ndarray, width: int, dense: np.ndarray):
        self.columns, self.first, self.width, self.dense = columns, first, width, dense
        self.counts = np.diff(first)

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[: self.width][self.columns])])
        return total[self.first[1:]] - total[self.first[:-1]] + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.columns, np.repeat(r, self.counts), self.width), self.dense.T @ r])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: Rows, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps whose systems are solved by conjugate gradients."""
    w = np.zeros(x.width + x.dense.shape[1])
    for _ in range(12):
        p = sigmoid(x.times(w))
        gradient, curve = x.back(p - y) + RIDGE * w, p * (1 - p) + 1e-6
        step, residual = np.zeros_like(w), -gradient
        direction, size = residual.copy(), residual @ residual
        for _ in range(25):
            if size < 1e-10:
                break
            bent = x.back(curve * x.times(direction)) + RIDGE * direction
            pace = size / (direction @ bent)
            step += pace * direction
            residual -= pace * bent
            size, before = residual @ residual, size
            direction = residual + size / before * direction
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _select(columns: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features that tell the classes apart best, by the chi-square statistic of presence."""
    n, positive = len(y), y.sum()
    seen = np.bincount(columns, minlength=1 << FEATURE_BITS).astype(float)
    hit = np.bincount(columns[np.repeat(y > 0, np.diff(first))], minlength=1 << FEATURE_BITS).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hit * n - seen * positive) ** 2 / (seen * (n - seen) * positive * (n - positive)) * n
    chi[~np.isfinite(chi) | (seen < 2)] = 0
    best = np.argsort(-chi, kind="stable")[:SELECTED]
    return np.sort(best[chi[best] > 0])


def _narrow(columns: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.full(1 << FEATURE_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    at = place[columns]
    some = at >= 0
    inside = np.zeros(len(at) + 1, np.int64)
    np.cumsum(some, out=inside[1:])
    return at[some], inside[first]


def _take(columns: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows, in ascending order."""
    counts = np.diff(first)
    wanted = np.zeros(len(counts), bool)
    wanted[rows] = True
    return columns[np.repeat(wanted, counts)], np.concatenate([[0], np.cumsum(counts[rows])])


class Chain:
    """A fitted chain: for each category its features, weights and threshold."""

    def __init__(self, names: list[str]):
        self.names, self.kept, self.weights, self.threshold = names, [], [], []

    def _dense(self, n: int, earlier: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.ones(n), *earlier], axis=1)

    def learn(self, columns: np.ndarray, first: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> Chain:
        """``labels`` has a column a category. Later models learn from out-of-fold predictions, as they will meet unseen documents."""
        earlier: list[np.ndarray] = []
        n = len(folds)

        def model(rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            part, start = _take(columns, first, rows)
            kept = _select(part, start, y[rows])
            return kept, fit(Rows(*_narrow(part, start, kept), len(kept), self._dense(n, earlier)[rows]), y[rows])

        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            unseen = np.full(n, y.mean() if n else 0.0)
            for fold in range(FOLDS):
                train, test = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
                if len(train) and len(test):
                    kept, w = model(train, y)
                    unseen[test] = sigmoid(Rows(*_narrow(*_take(columns, first, test), kept), len(kept), self._dense(n, earlier)[test]).times(w))
            kept, w = model(np.arange(n), y)
            self.kept.append(kept)
            self.weights.append(w)
            self.threshold.append(_cut(unseen, y))
            earlier.append(unseen)
        return self

    def predict(self, columns: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for kept, w in zip(self.kept, self.weights, strict=True):
            out.append(sigmoid(Rows(*_narrow(columns, first, kept), len(kept), self._dense(len(first) - 1, out)).times(w)))
        return out


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1 on out-of-fold probabilities, halfway (in log odds) to the next lower one; 0.5 without both classes."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    score = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    score[:-1][p[:-1] == p[1:]] = -1
    best = int(np.argmax(score))
    odds = lambda v: np.log(np.clip(v, 1e-9, 1 - 1e-9) / np.clip(1 - v, 1e-9, 1))
    below = p[best + 1] if best + 1 < len(p) else p[best] / 2
    return float(sigmoid(np.array((odds(p[best]) + odds(below)) / 2)))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents (the documented bound of what reaches one task).

    ``categories`` maps names, in the order of the chain, to SQL conditions over ``labels``; a null condition leaves the row out.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.expr(sql).cast("int").alias(f"y{i}") for i, sql in enumerate(categories.values())))
    known = known.dropna().groupBy("doc_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))))
    chosen = known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    names = list(categories)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                columns, first = features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(columns, pa.int32()))
                yield pa.record_batch([lists, part.column("turn"), *(part.column(f"y{i}") for i in range(len(names)))], names=["f", "turn", *(f"y{i}" for i in range(len(names)))])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("f", pa.list_(pa.int32())), ("turn", pa.int64()), *((f"y{i}", pa.int32()) for i in range(len(names)))]))
        if table.num_rows:
            table = table.sort_by("turn").combine_chunks()
            lists = table.column("f").combine_chunks()
            columns = lists.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            y = np.stack([table.column(f"y{i}").to_numpy() for i in range(len(names))], axis=1)
            folds = table.column("turn").to_numpy() % FOLDS
            yield pa.record_batch([pa.array([pickle.dumps(Chain(names).learn(columns, first, y, folds))])], names=["chain"])

    ys = ", ".join(f"y{i} int" for i in range(len(names)))
    found = rows.mapInArrow(compact, f"f array<int>, turn long, {ys}").repartition(1).mapInArrow(learn, "chain binary").collect()
    if found:
        return pickle.loads(bytes(found[0].chain))
    return Chain(names).learn(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, len(names))), np.zeros(0, np.int64))


def _scored(spark: SparkSession, chain: Chain):
    held = spark.sparkContext.broadcast(chain)
    return lambda texts: held.value.predict(*features(texts))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` and a decision ``is_<category>`` for each category.

    Null and empty texts have no features and get the models' base rates; without labels every probability is one half and no decision
    is made. Very long texts are read whole. Repeated rows give repeated rows; other columns are not read.
    """
    predict, names, thresholds = _scored(docs.sparkSession, chain), chain.names, chain.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ps = predict(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(p) for p in ps), *(pa.array(p > t) for p, t in zip(ps, thresholds, strict=True))], names=["doc_id", *(f"p_{n}" for n in names), *(f"is_{n}" for n in names)])

    schema = ", ".join(["doc_id long", *(f"p_{n} double" for n in names), *(f"is_{n} boolean" for n in names)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def drop(docs: DataFrame, chain: Chain, category: str) -> DataFrame:
    """The rows of ``docs`` that the chain does not count to ``category``, with all their columns."""
    predict, c, threshold = _scored(docs.sparkSession, chain), chain.names.index(category), chain.threshold[chain.names.index(category)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(predict(part.column("text"))[c] <= threshold))

    return docs.mapInArrow(run, docs.schema)


#: The labels at hand: junk first, then toxic.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
