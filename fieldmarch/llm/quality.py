"""Quality rules on repetition inside a text: suffix arrays over words, longest common prefixes, spans of maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SPACE, byte_set, numbered, runs
from .words import slices, text_buffers

#: Repeats of so many words count; published rules reject a tenth of the characters in repeated runs of ten words.
LEAST_WORDS = 10
MOST_PERCENT = 10
#: No run of more words may occur twice.
MOST_WORDS = 50
WINDOW = 5
_SYMBOLS = byte_set(*b"#*$%&|<>")
SLICE = 2 << 20


def suffix_ranks(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix arrays of all texts at once, one after the other, and the ranks after 1, 2, 4, ... words.

    ``words`` are numbers of words, ``text`` tells whose each is. Prefix doubling: suffixes that are told apart already are not sorted again.
    """
    n = len(words)
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])[:n]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1] if n else 0
    levels, step = [rank.copy()], 1
    while True:
        tied = ~head | np.append(~head[1:], False)
        at = np.flatnonzero(tied)
        if not len(at):
            return order, levels
        suffix = order[at]
        then = np.minimum(suffix + step, n - 1)
        inside = (suffix + step < n) & (text[then] == text[suffix])
        group, follow = rank[suffix], np.where(inside, rank[then], -1)
        by = np.lexsort((follow, group))
        order[at] = suffix[by]
        group, follow = group[by], follow[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        head[at] = new
        rank[order[at]] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        levels.append(rank.copy())
        step *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it; 0 across texts. Found by halving steps over the doubling's ranks."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = order[:-1].copy(), order[1:].copy()
    alive = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, shared = a[alive], b[alive], np.zeros(len(alive), np.int64)
    own = text[a]
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + shared, b + shared
        fits = (x < n) & (y < n)
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        # equal ranks of a level are suffixes that share that many words, or both end
        same = fits & (text[x] == own) & (text[y] == own) & (levels[level][x] == levels[level][y])
        shared += same.astype(np.int64) << level
    out[1 + alive] = shared
    return out


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """At each word, the most words from there on that occur again in its text: the depth of its suffix's innermost interval."""
    if not len(words):
        return np.zeros(0, np.int64)
    order, levels = suffix_ranks(words, text)
    shared = common_prefixes(order, levels, text)
    out = np.empty(len(words), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], 0))
    return out


def maximal(depth: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Where occurrences of maximal repeats of ``least`` words or more begin: those that the word before does not extend to the left."""
    before = np.concatenate([[0], np.where(text[1:] == text[:-1], depth[:-1], 0)])[: len(depth)]
    return np.flatnonzero((depth >= least) & (before <= depth))


def covered(depth: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of the spans of all maximal repeats of ``least`` words or more."""
    at = maximal(depth, text, least)
    edge = np.zeros(len(depth) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + depth[at], -1)
    return np.cumsum(edge[:-1]) > 0


class Measures:
    """Counts of every text of a column."""

    def __init__(self, texts: pa.Array, least: int):
        raw, offsets = text_buffers(texts)
        inside = ~SPACE[raw]
        start, end = runs(inside, offsets)
        first = np.searchsorted(start, offsets)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        ids, _ = numbered(raw, start, end)
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        chars = begun[end] - begun[start]
        depth = longest_repeats(ids, text)
        per = lambda values, at: np.diff(np.concatenate([[0], np.cumsum(values)])[at])
        self.n_words = np.diff(first)
        self.word_chars = per(chars, first)
        self.n_symbols = per(_SYMBOLS[raw], offsets)
        self.n_dup_lines = self._repeated_lines(raw, offsets, inside)
        self.n_repeat_words = per(covered(depth, text, WINDOW), first)
        self.repeated_chars = per(np.where(covered(depth, text, least), chars, 0), first)
        self.n_repeats = np.bincount(text[maximal(depth, text, least)], minlength=len(first) - 1)
        self.longest_repeat = np.zeros(len(first) - 1, np.int64)
        some = self.n_words > 0
        if some.any():
            self.longest_repeat[some] = np.maximum.reduceat(depth, first[:-1][some])

    @staticmethod
    def _repeated_lines(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
        start, end = runs(raw != 10, offsets)
        solid = np.concatenate([[0], np.cumsum(inside)])
        full = solid[end] > solid[start]
        ids, _ = numbered(raw, start[full], end[full])
        text = np.searchsorted(offsets, start[full], side="right") - 1
        key = text * (int(ids.max(initial=0)) + 1) + ids
        n = len(offsets) - 1
        return np.bincount(text, minlength=n) - np.bincount(text[np.unique(key, return_index=True)[1]], minlength=n)


def repetition(docs: DataFrame, least: int = LEAST_WORDS, percent: int = MOST_PERCENT, most: int = MOST_WORDS) -> DataFrame:
    """Every row's counts and verdict: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeats, repeated_chars,
    longest_repeat, base_failed, kept``.

    Words are parted by space and U+0009..U+000D and compared as written. ``n_repeat_words`` are words in 5-word windows that occur twice
    or more in the text; ``base_failed`` if under 10 words or over 20 % of such. Otherwise a text is kept if at most ``percent`` % of its
    words' characters (``repeated_chars``) lie in repeats of ``least`` words or more and its ``longest_repeat`` has at most ``most`` words.
    All occurrences of a repeat count, the first too; those that overlap count once. ``n_repeats`` are occurrences of maximal repeats.

    A null or empty text, or one of white space, has no words and fails. Very long texts are taken whole, alone in their slice; time grows
    with ``n log n`` whatever they repeat. Repeated rows, ids and null ids are rows of their own: no row looks at another. An empty table
    gives no rows. Other columns are not read, so their names cannot clash. One scan, no shuffle.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "repeated_chars", "longest_repeat"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = Measures(part.column("text"), least)
                yield pa.record_batch([part.column("doc_id"), *(pa.array(getattr(found, c).astype(np.int64)) for c in counts)], names=["doc_id", *counts])

    measured = source.mapInArrow(measure, ", ".join(f"{c} long" for c in ["doc_id", *counts]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = (100 * F.col("repeated_chars") <= percent * F.col("word_chars")) & (F.col("longest_repeat") <= most)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
