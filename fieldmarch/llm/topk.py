"""Exact top-k search without random access: sorted lists read in step, bounds on every score, then final scores of the few left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by a task at a time, and candidates whose lists are sorted together.
QUERY_BLOCK = 8192
LIST_LENGTH = 4096
SCALE = 256
#: Sums of products below the first are exact in doubles, below the second in 64-bit integers.
EXACT, LARGEST = float(1 << 53), float(1 << 63)
#: Lists are read in two parts, and all queries' parts in so many rounds.
ROUNDS = 6


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of usable rows, for each length of vector."""
    kept = batch.filter(pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("embedding"))))
    lists = kept.column("embedding")
    if not len(lists):
        return
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = kept.column("vec_id").to_numpy()
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        block = flat[first[rows][:, None] + np.arange(size)]
        good = np.isfinite(block).all(axis=1)
        yield ids[rows][good], np.floor(SCALE * block[good])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Queries:
    """Queries of one vector length, with the best candidates of each so far."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.number, self.ids, self.matrix, self.k = number, ids, matrix, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        #: The k-th best score known: nobody below it can qualify.
        self.bar = np.full(len(ids), np.iinfo(np.int64).min)
        self.read_entries = self.all_entries = 0

    def read(self, ids: np.ndarray, block: np.ndarray) -> None:
        """Read the sorted lists of a block of candidates, part by part, until each query's best are known with their scores.

        A query reads the list of a component from the top if its weight is positive, from the bottom if negative: first the half at that
        end, later the rest. It reads parts in order of what they can settle, weight times the spread of their values, a share of all parts
        a round. Values read add up to a candidate's known score; a value not read yet lies between the list's far end and the value that
        was read last. That bounds every score from both sides, and what cannot reach the k-th best lower bound is left. Scores are final
        when nothing of a candidate is unread, so they come from the lists alone.
        """
        n, d, k = len(ids), block.shape[1], self.k
        largest = d * float(np.abs(block).max(initial=0)) * float(np.abs(self.matrix).max(initial=0))
        if 2 * largest >= LARGEST:
            raise ValueError("scores do not fit a long")
        kind = np.float64 if 2 * largest < EXACT else np.int64
        w, block = self.matrix.astype(kind), block.astype(kind)
        # oriented: the upper end is where reading begins; columns d.. are those of negative weights
        lists = np.concatenate([block, -block], axis=1)
        ordered = np.sort(lists, axis=0)
        far, near, middle = ordered[0], ordered[-1], ordered[n // 2]
        early = lists > middle  # in the half that is read first
        weights = np.concatenate([np.maximum(w, 0), np.maximum(-w, 0)], axis=1)
        spread = np.concatenate([near - middle, middle - far])
        gain = np.concatenate([weights, weights], axis=1) * spread
        gain[:, : 2 * d] += gain[:, 2 * d :]  # the first half comes no later than the second
        turn = np.empty(gain.shape, np.int64)
        np.put_along_axis(turn, np.argsort(-gain, axis=1, kind="stable"), np.arange(4 * d)[None] * ROUNDS // (2 * d), axis=1)
        turn[:, 2 * d :] = np.maximum(turn[:, 2 * d :], turn[:, : 2 * d])
        used = weights > 0
        first, second = np.where(used, turn[:, : 2 * d], 0), np.where(used, turn[:, 2 * d :], 0)
        last = max(int(first.max(initial=0)), int(second.max(initial=0)))

        alive = self.ids[:, None] != ids[None, :]
        columns = np.arange(n)
        for now in range(last + 1):
            one, two = weights * (first <= now), weights * (second <= now)
            e, v = early[columns].astype(kind), lists[columns]
            # what is read, and what is not: those past the middle of half-read lists, and all of unread ones
            known = one @ (e * v).T + two @ ((1 - e) * v).T
            half, none = one - two, weights - one
            rest = (1 - e).T
            lower = known + (half * far) @ rest + (none @ far)[:, None]
            upper = known + (half * middle) @ rest + (none @ near)[:, None]
            at = alive[:, columns]
            bound = np.where(at, lower, np.iinfo(np.int64).min if kind is np.int64 else -np.inf)
            if len(columns) > k:
                best = np.partition(bound, len(columns) - k, axis=1)[:, len(columns) - k]
                self.bar = np.maximum(self.bar, np.where(np.isfinite(best), best, np.iinfo(np.int64).min).astype(np.int64) if kind is np.float64 else best)
            at &= upper >= self.bar[:, None]
            alive[:, columns] = at
            left = at.any(axis=0)
            if now == last or not left.any() or (lower[at] == upper[at]).all():
                break
            columns = columns[left]
        # a part of a list is half its entries; one that a query without candidates would read is not read
        self.all_entries += int(used.sum()) * n
        self.read_entries += (int((one > 0).sum()) + int((two > 0).sum())) * n // 2
        for q in np.flatnonzero(at.any(axis=1)):
            mine = np.flatnonzero(at[q])
            held, scores = self.found[q]
            every, score = np.concatenate([held, ids[columns[mine]]]), np.concatenate([scores, lower[q, mine].astype(np.int64)])
            best = _best(every, score, k)
            self.found[q] = every[best], score[best]
            if len(best) == k:
                self.bar[q] = max(self.bar[q], score[best[-1]])


def top_k(vectors_of: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` best rows of each query: ``query_id, rank, vec_id, score``; queries are the rows whose ``vec_id`` ``every`` divides.

    Components become ``floor(256 * x)``; the score is the inner product; ties go to the smaller ``vec_id``. Vectors that are null,
    empty, or hold a null or non-finite component take no part, nor do rows without an id; a query meets vectors of its own length
    only, and no row of its own id. Equal query rows are asked once; query rows that share an id but not their vector are queries of
    their own. Sums are doubles while they are exact and 64-bit integers beyond; a score that might not fit a long raises an error.
    An empty table gives no rows; a very long vector is one like others; other columns are not read, so their names cannot clash.

    Queries are a stated set, held in blocks of 8192; each block reads the vectors once, and every task keeps k rows a query.
    """
    spark = vectors_of.sparkSession
    source = vectors_of.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = source.filter((F.col("vec_id") % every == 0) & F.col("embedding").isNotNull()).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in vectors(batch):
                yield pa.record_batch([pa.array(ids), pa.array(list(block), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    def blocks() -> Iterator[dict[int, tuple[list, list, list]]]:
        held: dict[int, tuple[list, list, list]] = {}
        n = 0
        for r in asked.mapInArrow(pack, "vec_id long, embedding array<double>").toLocalIterator():
            numbers, ids, rows = held.setdefault(len(r.embedding), ([], [], []))
            numbers.append(n)
            ids.append(r.vec_id)
            rows.append(r.embedding)
            n += 1
            if n % QUERY_BLOCK == 0:
                yield held
                held = {}
        if held:
            yield held

    schema, out = "query long, query_id long, vec_id long, score long", None
    for held in blocks():
        shared = spark.sparkContext.broadcast({d: (np.array(n), np.array(i), np.array(m)) for d, (n, i, m) in held.items()})

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = {d: Queries(*q, k) for d, q in shared.value.items()}
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def settle(d: int) -> None:
                ids, block = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
                for a in range(0, len(ids), LIST_LENGTH):
                    queries[d].read(ids[a : a + LIST_LENGTH], block[a : a + LIST_LENGTH])

            for batch in batches:
                for ids, block in vectors(batch):
                    d = block.shape[1]
                    if d in queries and len(ids):
                        waiting.setdefault(d, []).append((ids, block))
                        if sum(len(i) for i, _ in waiting[d]) >= LIST_LENGTH:
                            settle(d)
            for d in list(waiting):
                settle(d)
            for q in queries.values():
                sizes = [len(ids) for ids, _ in q.found]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(q.number, sizes)), pa.array(np.repeat(q.ids, sizes)),
                        pa.array(np.concatenate([ids for ids, _ in q.found])), pa.array(np.concatenate([s for _, s in q.found])),
                    ],
                    names=["query", "query_id", "vec_id", "score"],
                )

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
