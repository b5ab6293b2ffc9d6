"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Words, shingles, slices

SEED_WORDS = 3
#: Shorter items have seeds of one word less: few runs of three words survive an edit there.
SHORT_ITEM = 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items are a query set: so many characters of them are held at a time, whatever their number.
BLOCK_CHARS = 8_000_000
FILTER_BITS = 20


class Items:
    """A block of benchmark items as word hashes, with all their n-grams as seeds in order."""

    def __init__(self, ids: list, texts: list[str | None]):
        words = Words(pa.array(texts, pa.large_string()))
        self.ids = ids
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.length = words.count
        short = words.count < SHORT_ITEM
        seeds, owner, place = [], [], []
        for size, chosen in ((SEED_WORDS - 1, short), (SEED_WORDS, ~short)):
            grams, first = shingles(words, size)
            item = np.repeat(np.arange(len(ids)), np.diff(first))
            mine = chosen[item]
            seeds.append(grams[mine])
            owner.append(item[mine])
            place.append((np.arange(len(grams)) - first[item])[mine])
        seeds, owner, place = np.concatenate(seeds), np.concatenate(owner), np.concatenate(place)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order], owner[order], place[order]
        #: lengths of n-grams to look for: shorter ones only if some item is that short
        self.sizes = sorted({min(n, SEED_WORDS - (n < SHORT_ITEM)) for n in words.count.tolist()} - {0})


def _mask(hashes: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << FILTER_BITS, bool)
    mask[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return mask


def _found(hashes: np.ndarray, known: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Positions of ``hashes`` that are in sorted ``known``."""
    at = np.flatnonzero(mask[hashes >> np.uint64(64 - FILTER_BITS)])
    spot = np.minimum(np.searchsorted(known, hashes[at]), max(0, len(known) - 1))
    return at[known[spot] == hashes[at]] if len(known) else at[:0]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and where it ends in ``window``; a row of the table at a time."""
    slide = np.arange(1, len(window) + 1) * -GAP
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row[:-1] + np.where(window == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        # gaps along the row: the best earlier cell less the gaps to it
        row[1:] = np.maximum.accumulate(step + slide) - slide
        at = int(np.argmax(row))
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _document_hits(words: np.ndarray, spots: np.ndarray, grams: np.ndarray, items: Items, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word) of one document whose n-grams at ``spots`` are seeds."""
    lo, hi = np.searchsorted(items.seeds, grams[spots], "left"), np.searchsorted(items.seeds, grams[spots], "right")
    at = np.repeat(spots, hi - lo)
    which = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
    item, diagonal = items.owner[which], at - items.place[which]
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    reach = items.length[item] // 2 + 8
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (np.diff(diagonal) > reach[1:])
    bounds = [*np.flatnonzero(fresh), len(item)]
    best: dict[int, tuple[float, int, int]] = {}
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = items.words[item[a]]
        left, right = max(0, int(diagonal[a]) - reach[a]), min(len(words), int(diagonal[b - 1]) + len(own) + reach[a])
        window = words[left:right]
        # every match is a word of the window: too few common words cannot reach the threshold
        if np.isin(own, window).sum() < threshold * len(own) or best.get(item[a], (0,))[0] >= 1:
            continue
        score, end = align(own, window)
        if score >= threshold * MATCH * len(own):
            _, back = align(own[::-1], window[:end][::-1])
            if score / (MATCH * len(own)) > best.get(item[a], (0,))[0]:
                best[item[a]] = (score / (MATCH * len(own)), left + end - back, left + end - 1)
    for i, (score, first, last) in sorted(best.items()):
        yield i, score, first, last


def _hits(texts: pa.Array, items: Items, mask: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word) of a slice of texts."""
    words = Words(texts)
    for size in items.sizes:
        grams, first = shingles(words, size)
        spots = _found(grams, items.seeds, mask)
        row = np.searchsorted(first, spots, side="right") - 1
        # a text of fewer words is looked up whole under its own size
        spots, row = spots[words.count[row] >= size], row[words.count[row] >= size]
        for r in np.unique(row):
            mine = spots[row == r] - first[r]
            yield from ((r, *hit) for hit in _document_hits(words.hash[words.first[r] : words.first[r + 1]], mine, grams[first[r] : first[r + 1]], items, threshold))


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, streamed a partition at a time."""
    ids, texts, held = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text or "")
        if held >= BLOCK_CHARS:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def _seeded(spark: SparkSession, benchmark: DataFrame) -> Iterator:
    """Broadcast blocks of items that have seeds."""
    for items in _blocks(benchmark):
        if len(items.seeds):
            yield spark.sparkContext.broadcast(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that hold benchmark items: ``doc_id, item_id, score, first_word, last_word``.

    Words are compared lower-cased (A-Z). ``score`` is the local alignment score over the score of the whole item, 1 for a verbatim copy;
    a quarter of the words replaced gives about 0.62. A row for each document and item with ``score >= threshold``, at the best passage.
    Every run of 3 words of an item, of 2 in items under 16 words, is a seed: a passage is scored if one of them stayed as it was.
    Null or empty texts on either side give no rows; null ids are carried through; items of fewer than 3 words have one seed, all their
    words. Repeated rows give repeated rows. Other columns are not read.
    """
    spark, out = docs.sparkSession, None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    for block in _seeded(spark, benchmark):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = block.value
            mask = _mask(items.seeds)
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column("doc_id")
                    hits = [(ids[int(r)].as_py(), items.ids[i], s, int(a), int(b)) for r, i, s, a, b in _hits(part.column("text"), items, mask, threshold)]
                    columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, judged where they are read: nothing is shuffled."""
    spark = docs.sparkSession
    for block in _seeded(spark, benchmark):

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            mask = _mask(block.value.seeds)
            for batch in batches:
                for part in slices(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[hit[0] for hit in _hits(part.column("text"), block.value, mask, threshold)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
