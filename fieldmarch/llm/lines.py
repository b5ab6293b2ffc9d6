"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, distributed union-find, one line a component stays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmarch.columns import settle
from fieldmarch.session import cut, discard

from .links import join_keyed, one_of_each
from .words import mix, range_hashes, sets, signed, slices, text_buffers

SHINGLE = 5
BANDS = 22
ROWS = 5
#: Bits of a line's sketch, one a minimum; at the threshold 6 of them differ on average and over UNLIKE about once in a million.
SKETCH = 64
UNLIKE = 20
#: So many lines have their bins in memory at a time.
LINES_AT_ONCE = 1 << 9
RUNS_AT_ONCE = 1 << 15
LEAST_CHARS = 1
SLICE = 1 << 20
MARKED_CHARS = 1 << 18
#: So many keys are sorted by a task at a time.
KEYS_A_TASK = 1 << 19
_BLANK = np.zeros(128, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CHAR = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Lines:
    """Lines of a column of texts, trimmed, as ranges of code points with A-Z lower-cased; ``text`` and ``number`` say whose they are."""

    def __init__(self, texts: pa.Array):
        raw, offsets = text_buffers(texts)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = offsets
        if len(points) < len(raw):
            begun = (raw & 0xC0) != 0x80
            at = np.concatenate([[0], np.cumsum([np.count_nonzero(begun[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])])
        self.points = np.where((points >= 65) & (points <= 90), points + 32, points)
        breaks = np.flatnonzero(points == 10)
        owner = np.searchsorted(at, breaks, side="right") - 1
        # a line starts with its text or after a break
        start = np.concatenate([at[:-1], breaks + 1])
        text = np.concatenate([np.arange(len(at) - 1), owner])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        stop = np.where(np.append(text[1:] == text[:-1], False), np.append(start[1:], 0) - 1, at[text + 1])
        self.text = text
        self.number = np.arange(len(text)) - np.searchsorted(text, text)
        solid = np.flatnonzero(~((self.points < 128) & _BLANK[np.minimum(self.points, 127)]))
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, stop)
        full = lo < hi
        self.start, self.stop = start.copy(), start.copy()
        self.start[full], self.stop[full] = solid[lo[full]], solid[hi[full] - 1] + 1
        self.size = self.stop - self.start
        self._known: dict[int, np.ndarray] = {}

    @cached_property
    def values(self) -> np.ndarray:
        high = self.points >> 16
        out = _CHAR[self.points & 0xFFFF]
        return out + high.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) if high.any() else out

    def _runs(self, chars: int) -> np.ndarray:
        """Hash of the ``chars`` characters from each place on, worked out once for all parts of the lines."""
        if chars in self._known:
            return self._known[chars]
        n = max(len(self.points) - chars + 1, 0)
        out = np.zeros(n, np.uint64)
        for a in range(0, n, RUNS_AT_ONCE):
            b = min(a + RUNS_AT_ONCE, n)
            h = self.values[a:b].copy()
            for j in range(1, chars):
                h *= _STEP
                h += self.values[a + j : b + j]
            out[a:b] = mix(h)
        self._known[chars] = out
        return out

    def shingles(self, rows: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``chars`` characters of the chosen lines, shorter lines whole, and where each line's begin."""
        runs = np.where(self.size[rows] >= chars, self.size[rows] - chars + 1, np.minimum(self.size[rows], 1))
        first = np.concatenate([[0], np.cumsum(runs)])
        short = np.flatnonzero((runs > 0) & (self.size[rows] < chars))
        at = np.arange(first[-1]) + np.repeat(self.start[rows] - first[:-1], runs)
        at[first[short]] = 0
        known = self._runs(chars)
        out = known[at] if len(known) else np.zeros(len(at), np.uint64)
        if len(short):
            out[first[short]] = range_hashes(self.values, self.start[rows[short]], self.stop[rows[short]])
        return out, first


def _sets_of(chars: int):
    """Sets of shingles of texts that are single lines."""

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lines = Lines(texts)
        return sets(*lines.shingles(np.flatnonzero(lines.number == 0), chars))

    return run


def _scatter(values: np.ndarray) -> np.ndarray:
    """32-bit hashes whose every bit depends on all of a value's."""
    values = (values ^ (values >> np.uint32(16))) * np.uint32(0x7FEB352D)
    values = (values ^ (values >> np.uint32(15))) * np.uint32(0x846CA68B)
    return values ^ (values >> np.uint32(16))


def _folded(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) ^ (values >> np.uint64(32)).astype(np.uint32)


def _donors(n: int) -> np.ndarray:
    """For each of ``n`` bins the order in which it looks at others when it is empty: the same for all lines."""
    order = _scatter(np.arange(n, dtype=np.uint32)[:, None] * np.uint32(0x9E3779B1) + np.arange(n, dtype=np.uint32)[None] + np.uint32(1))
    order[np.arange(n), np.arange(n)] = 0  # itself first
    return np.argsort(order, axis=1, kind="stable")


_DONORS, _SKETCH_DONORS = _donors(BANDS), _donors(8)
_EMPTY = np.uint32(0xFFFFFFFF)


def _filled(at: np.ndarray, h: np.ndarray, lines: int, n: int, donors: np.ndarray) -> np.ndarray:
    """The least hash of each of a line's ``n`` bins, or that of the bin's first donor with one."""
    bins = np.full(lines * n, _EMPTY)
    np.minimum.at(bins, at, h)
    bins = bins.reshape(lines, n)
    short = np.flatnonzero((bins == _EMPTY).any(axis=1))
    donor = np.argmax((bins[short] != _EMPTY)[:, donors], axis=2)
    bins[short] = np.take_along_axis(bins[short], donors[np.arange(n), donor], axis=1)
    return bins


def band_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each line of at least one shingle.

    One-permutation MinHash, ROWS times: a hash deals a line's shingles to BANDS bins, each keeps its least; an empty bin takes the value
    of the first filled one in its own order of the others. A band's key joins its bin of all permutations.
    """
    n, line = len(first) - 1, np.repeat(np.arange(len(first) - 1) * BANDS, np.diff(first))
    low = _folded(values)
    keys = np.zeros((n, BANDS), np.uint64)
    for k in range(ROWS):
        h = _scatter(low ^ np.uint32(0x9E3779B1 * (k + 1) & 0xFFFFFFFF))
        bins = _filled(line + ((h >> np.uint32(16)) * np.uint32(BANDS) >> np.uint32(16)), h, n, BANDS, _DONORS)
        keys = mix(keys + bins + np.uint64(k))
    return mix(keys + np.arange(BANDS, dtype=np.uint64))


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH bits of each line of at least one shingle: one of each least hash of 8 bins in 8 permutations, empty bins filled as for keys."""
    low, n = _folded(values), len(first) - 1
    out, line = np.zeros(n, np.uint64), np.repeat(np.arange(n) * 8, np.diff(first))
    for k in range(SKETCH // 8):
        h = _scatter(low ^ np.uint32(0x85EBCA6B * (k + 1) & 0xFFFFFFFF))
        bins = _filled(line + (h >> np.uint32(29)), h, n, 8, _SKETCH_DONORS)
        bits = _scatter(bins ^ np.arange(1, 9, dtype=np.uint32)) & np.uint32(1)
        out |= (bits.astype(np.uint64) << np.arange(8 * k, 8 * k + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _classes(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are not blank, and a number for each that equal ones share."""
    rows = np.flatnonzero(lines.size > 0)
    return rows, range_hashes(lines.values, lines.start[rows], lines.stop[rows]) if len(rows) else np.zeros(0, np.uint64)


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lines = Lines(part.column("text"))
                rows, cls = _classes(lines)
                keep = lines.size[rows] >= least
                rows, cls = rows[keep], cls[keep]
                at = pa.array(lines.text[rows])
                yield pa.record_batch(
                    [part.column("doc_id").take(at), part.column("row").take(at), pa.array(lines.number[rows]), pa.array(signed(cls))],
                    names=["doc_id", "row", "line", "cls"],
                )

    return run


def _keyed(chars: int, least: int):
    """A row for each key of each line, lines that repeat in a slice once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lines = Lines(part.column("text"))
                rows, cls = _classes(lines)
                keep = lines.size[rows] >= least
                rows, cls = rows[keep], cls[keep]
                once = np.sort(np.unique(cls, return_index=True)[1])
                rows, cls = rows[once], cls[once]
                for a in range(0, len(rows), LINES_AT_ONCE):
                    keys = band_keys(*lines.shingles(rows[a : a + LINES_AT_ONCE], chars))
                    yield pa.record_batch([pa.array(signed(keys.ravel())), pa.array(np.repeat(signed(cls[a : a + LINES_AT_ONCE]), BANDS))], names=["key", "cls"])

    return run


def _pick(chars: int):
    """Texts of wanted lines, with the number of distinct shingles and the sketch of each: ``wanted`` lists (line, cls) of the row.

    Rows that repeat meet in one task and answer once.
    """

    def marked(cls: list[int], texts: list[str]) -> pa.RecordBatch:
        column = pa.array(texts, pa.string())
        values, first = _sets_of(chars)(column)
        return pa.record_batch([pa.array(cls, pa.int64()), column, pa.array(np.diff(first)), pa.array(signed(sketches(values, first)))], names=["cls", "text", "size", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cls: list[int] = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for row, text, wanted in zip(*(batch.column(c) for c in ("row", "text", "wanted")), strict=True):
                if row.as_py() in seen:
                    continue
                seen.add(row.as_py())
                lines = text.as_py().split("\n")
                for w in wanted.as_py():
                    cls.append(w["cls"])
                    texts.append(lines[w["line"]])
                    held += len(texts[-1])
                    if held >= MARKED_CHARS:
                        yield marked(cls, texts)
                        cls, texts, held = [], [], 0
        yield marked(cls, texts)

    return run


def _source(docs: DataFrame) -> DataFrame:
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.withColumn("row", F.xxhash64("doc_id", "text"))


def fuzzy_lines(docs: DataFrame, percent: int = 80, chars: int = SHINGLE, least: int = LEAST_CHARS) -> DataFrame:
    """Every line of ``least`` characters or more, with 1 every line that is not blank: ``doc_id, row, line, first_doc_id, first_line, kept``.

    Lines end at a line feed and count from 0; white space at their ends and the case of A-Z do not matter. Lines are linked when their
    sets of shingles of ``chars`` characters have a Jaccard similarity of ``percent`` or more; a line of fewer characters is one shingle.
    Of each component the line of the smallest document and number stays; the others name it. Shorter and blank lines are never copies
    and are not listed; nulls and empty texts have no lines; an empty table gives no rows. Null ids come last and can keep a line. Rows
    that repeat id and text are one document (``row`` is the number of both). Very long texts and lines are taken whole. Other columns are
    not read, so their names cannot clash. Long shingles link only long lines: one changed character spoils ``chars`` of them.

    22 bands of 5 minima find 99.9 % of pairs at the threshold itself, and more above it; equal lines are one class before that.
    Candidates are tested if their numbers of shingles and their sketches allow the similarity.
    """
    source = _source(docs)
    found = cut(source.mapInArrow(_found(least), "doc_id long, row long, line long, cls long"))
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order"), "row", "line", "doc_id")
    classes = cut(found.groupBy("cls").agg(F.min(place).alias("first")))

    def texts_of(wanted: DataFrame) -> DataFrame:
        spots = classes.join(wanted, "cls", "left_semi").select(F.col("first.row").alias("row"), F.struct(F.col("first.line").alias("line"), "cls").alias("spot"))
        by_row = spots.groupBy("row").agg(F.collect_list("spot").alias("wanted"))
        return source.select("row", "text").join(by_row.hint("shuffle_hash"), "row").mapInArrow(_pick(chars), "cls long, text string, size long, sketch long")

    def near(a: str, b: str) -> Column:
        x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
        return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) <= UNLIKE)

    def may(own: np.ndarray, others: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(others[:, 0], own[0]) >= percent * np.maximum(others[:, 0], own[0])
        return fits & (np.bitwise_count((others[:, 1] ^ own[1]).view(np.uint64)) <= UNLIKE)

    keys = source.mapInArrow(_keyed(chars, least), "key long, cls long")
    tasks = 1 + found.count() * BANDS // KEYS_A_TASK
    roots = join_keyed(keys, tasks, near, may, texts_of, _sets_of(chars), percent)
    rooted = classes.select("cls", "first").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    named = rooted.join(best, "root").select("cls", "best")
    out = cut(
        found.select("doc_id", "row", "line", "cls").join(named.hint("merge"), "cls")
        .select(
            "doc_id", "row", "line", F.col("best.doc_id").alias("first_doc_id"), F.col("best.line").alias("first_line"),
            ((F.col("row") == F.col("best.row")) & (F.col("line") == F.col("best.line"))).alias("kept"),
        )
    )
    for table in (found, classes):
        discard(table)
    return out


def drop_repeated_lines(docs: DataFrame, percent: int = 80, chars: int = SHINGLE, least: int = LEAST_CHARS) -> DataFrame:
    """``docs`` without the lines that ``fuzzy_lines`` does not keep; documents that had words and keep none are left out.

    Of rows that repeat id and text one stays, if the text has words; null and empty texts stay. Texts without such lines stay as they
    are, to the byte. ``n_chars`` follows the text where the table has it.
    """
    row, own, gone, emptied = (f"__lines_{x}" for x in ("row", "own", "gone", "emptied"))
    dropped = fuzzy_lines(docs, percent, chars, least).filter("not kept").groupBy(F.col("row").alias(own)).agg(F.collect_set("line").alias(gone))
    marked = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    marked = one_of_each(marked, row, marked.filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).groupBy(row).count())
    joined = marked.join(dropped.hint("shuffle_hash"), F.col(row) == F.col(own), "left")
    # split once: a lambda would split the text again for every line
    split = settle(joined, __lines_all=F.when(F.col(gone).isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("__lines_all").cast("long") - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda n: F.get("__lines_all", n.cast("int"))), "\n"))
    cleaned = split.withColumn("text", text).withColumn(emptied, F.col(gone).isNotNull() & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    kept = cleaned.filter(~F.col(emptied))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
