"""Collocations: count streams of word sequences in prefix and in suffix order, merge-joined for left, right and extension counts.

Words of a language are numbered in byte order, so sorted numbers are sorted words. Blocks of documents count their own three-word
entries; the entries of all blocks are dealt by range and sorted in prefix order, and one pass over each sorted stream adds equal
neighbours to three-word counts and, over all third words and none, to two-word counts. What occurs often enough is kept in that order;
a second copy is sorted by the last words. Counts of beginnings come from lockstep merge joins along the first, counts of ends along the
second, and so does the most frequent extension on either side. No step looks a count up in a hash table, and none holds a group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmarch.session import cut, discard

from .tokens import LOWER, byte_set, numbered, runs
from .words import slices, text_buffers

LEAST = 10
EXTENDED_PERCENT = 50
TOP = 2000
BLOCK_BYTES = 8 << 20
_GAP = byte_set(0x20, 0x09)
_BREAK = byte_set(*b".,;:!?", *range(0x0A, 0x0E))
#: Two numbers of words are packed in one long, so there may be 2**31 words that occur often enough.
_HIGH = 31
_NONE = -1


def _block(part: pa.RecordBatch) -> pa.RecordBatch:
    """One row a block: its distinct (lang, word) in order with their counts, and its tokens by their place there, pieces parted by -1."""
    raw, offsets = text_buffers(part.column("text"))
    raw = LOWER[raw]
    breaks = _BREAK[raw]
    start, end = runs(~(breaks | _GAP[raw]), offsets)
    ids, words = numbered(raw, start, end)
    coded = part.column("lang").dictionary_encode()
    langs = coded.dictionary
    text = np.searchsorted(offsets, start, side="right") - 1
    lang = coded.indices.to_numpy(zero_copy_only=False)[text].astype(np.int64)
    # distinct pairs, put in order of their strings
    pair, own, count = np.unique(lang * max(1, len(words)) + ids, return_inverse=True, return_counts=True)
    table = pa.table({"lang": langs.take(pa.array(pair // max(1, len(words)))), "word": words.take(pa.array(pair % max(1, len(words))))})
    order = pc.sort_indices(table, sort_keys=[("lang", "ascending"), ("word", "ascending")])
    place = np.empty(len(pair), np.int64)
    place[order.to_numpy()] = np.arange(len(pair))
    table = table.take(order)
    # pieces end at breaks and texts
    passed = np.concatenate([[0], np.cumsum(breaks)])[start]
    new = np.flatnonzero((passed[1:] != passed[:-1]) | (text[1:] != text[:-1])) + 1
    tokens = np.insert(place[own].astype(np.int32), new, _NONE)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), values.combine_chunks().cast(kind))
    return pa.record_batch(
        [
            pa.array([uuid.uuid4().int >> 65], pa.int64()), one(table["lang"], pa.string()), one(table["word"], pa.string()),
            pa.ListArray.from_arrays(pa.array([0, len(pair)], pa.int32()), pa.array(count[order.to_numpy()])),
            pa.array([len(tokens)], pa.int64()), pa.array([pa.compress(tokens.tobytes(), "zstd", asbytes=True)], pa.binary()),
        ],
        names=["block", "langs", "words", "counts", "n_tokens", "tokens"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", BLOCK_BYTES):
            yield _block(part)


def _entries(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted three-word entries of a stream of numbers (-1: no word): first two words in one long, third or -1, count."""
    two = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
    third = np.append(numbers, _NONE)[two + 2]
    heads, at = np.unique(numbers[two] << _HIGH | numbers[two + 1], return_inverse=True)
    # heads in a block number less than 2**31, thirds too: again one long
    key, count = np.unique(at.astype(np.int64) << 32 | third + 1, return_counts=True)
    return heads[key >> 32], (key & 0xFFFFFFFF).astype(np.int32) - 1, count


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's own count stream in prefix order; words that are not numbered part their neighbours."""
    for batch in batches:
        for n, data, places, ids, size in zip(*(batch.column(c) for c in ("n_tokens", "tokens", "places", "ids", "n_words")), strict=True):
            tokens = np.frombuffer(pa.decompress(data.as_buffer(), 4 * n.as_py(), "zstd", asbytes=True), np.int32)
            numbers = np.full(size.as_py() + 1, _NONE, np.int64)  # the last one is that of -1
            numbers[places.values.to_numpy()] = ids.values.to_numpy()
            head, third, count = _entries(numbers[tokens])
            for a in range(0, len(head), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.record_batch([pa.array(head[b]), pa.array(third[b]), pa.array(count[b])], names=["head", "third", "f"])


def _added(least: int):
    """One pass over a sorted stream: entries that occur ``least`` times, and two-word counts (third -1), those at its ends in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_three: tuple | None = None  # the entry and the two words that the next batch may go on with
        open_two: tuple | None = None
        first = True

        def rows(head, third, f):
            return pa.record_batch([pa.array(head, pa.int64()), pa.array(third, pa.int32()), pa.array(f, pa.int64())], names=["head", "third", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            head, third, f = (batch.column(c).to_numpy() for c in ("head", "third", "f"))
            if open_three:
                head, third, f = np.insert(head, 0, open_three[0]), np.insert(third, 0, open_three[1]), np.insert(f, 0, open_three[2])
            at = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (third[1:] != third[:-1])]))
            f = np.add.reduceat(f, at)
            head, third = head[at], third[at]
            open_three = (head[-1], third[-1], f[-1])
            head, third, f = head[:-1], third[:-1], f[:-1]
            if not len(head):
                continue
            often = (f >= least) & (third >= 0)
            yield rows(head[often], third[often], f[often])
            at = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            two, both = head[at], np.add.reduceat(f, at)
            if open_two:
                if two[0] == open_two[0]:
                    both[0] += open_two[1]
                else:
                    two, both = np.insert(two, 0, open_two[0]), np.insert(both, 0, open_two[1])
            open_two = (two[-1], both[-1])
            # the first pair of words may have begun in the range before
            often = both[:-1] >= least
            if first and len(often):
                often[0], first = True, False
            yield rows(two[:-1][often], np.full(often.sum(), _NONE), both[:-1][often])
        if open_three:
            yield rows(*([x] for x in open_three)) if open_three[2] >= least and open_three[1] >= 0 else rows([], [], [])
            if open_two and open_two[0] != open_three[0]:
                yield rows([open_two[0]], [_NONE], [open_two[1]])
                open_two = None
            yield rows([open_three[0]], [_NONE], [open_three[2] + (open_two[1] if open_two else 0)])

    return run


def _vocabulary(words: DataFrame) -> DataFrame:
    """``lang, word, f`` with ``id``, the place in order of lang and word, counted along a table sorted by range."""
    parted = cut(words.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # one row a partition: how many words lie before it
    sizes = parted.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = cut(parted.withColumn("part", part).join(before, "part").select("lang", "word", "f", (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("id")))
    discard(parted)
    return out


def _times(*counts: str) -> Column:
    """Product of counts without rounding; a count has at most 15 digits."""
    out = None
    for c in counts:
        value = F.col(c).cast("decimal(15,0)")
        out = value if out is None else out * value
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered words ``(lang, word, f, id)`` and sequences ``(head, third, f)`` that occur ``least`` times, and ``(lang, n)``.

    ``head`` packs the numbers of the first two words, ``third`` is -1 in two-word sequences. All three are written tables.
    """
    source = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = cut(source.mapInArrow(_blocks, "block long, langs array<string>, words array<string>, counts array<long>, n_tokens long, tokens binary"))
    flat = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("place", "w"))
    own = cut(flat.select("block", "place", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("f")))
    counted = cut(own.groupBy("lang", "word").agg(F.sum("f").alias("f")))
    totals = cut(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    words = _vocabulary(counted.filter(F.col("f") >= least))
    # the place in a block and the number of each of its words that is common enough
    known = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("w"))
    numbered_blocks = blocks.select("block", "n_tokens", "tokens", F.size("words").alias("n_words")).join(known, "block")
    entries = numbered_blocks.select("n_tokens", "tokens", "n_words", F.col("w.place").alias("places"), F.col("w.id").alias("ids")).mapInArrow(_streams, "head long, third int, f long")
    sums = cut(entries.repartitionByRange("head", "third").sortWithinPartitions("head", "third").mapInArrow(_added(least), "head long, third int, f long"))
    threes = sums.filter("third >= 0")
    twos = sums.filter("third < 0").groupBy("head", "third").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    often = cut(threes.union(twos))
    for table in (blocks, own, counted, sums):
        discard(table)
    return words, often, totals


def collocations(docs: DataFrame, least: int = LEAST, extended_percent: int = EXTENDED_PERCENT, top: int | None = TOP) -> DataFrame:
    """The ``top`` phrases of two and three words of each language (all with None): ``lang, rank, phrase, a, l, r, n, score``.

    Texts, with A-Z lower-cased, end in pieces at ``. , ; : ! ?`` and U+000A..U+000D; words are parted by space and tab. ``a`` is the
    phrase's count within pieces, overlaps included; phrases of fewer than ``least`` are no candidates. Cut after its first or second word
    a phrase has the counts ``l`` and ``r`` of both parts and the score ``floor(1000000 * a * a / (l * r))``; the lowest cut counts, the
    first among equal ones. Candidates inside a longer one of ``extended_percent`` % of their count or more are left out. ``n`` counts the
    language's words. Ties in score go to the larger ``a``, then to the phrase that is first in bytes.

    A null language is ``und``, a null text empty; ids are not read, so repeated rows count as often as they come. Very long texts are
    one block alone. An empty table gives no rows. Other columns are not read, so their names cannot clash. Products of counts are
    decimals of up to 37 digits: exact for counts under 10**15.
    """
    words, often, totals = phrase_counts(docs, least)
    low = (1 << _HIGH) - 1
    w0, w1 = F.shiftright("head", _HIGH), F.col("head").bitwiseAND(F.lit(low))
    grams = often.select(w0.alias("w0"), w1.alias("w1"), F.col("third").cast("long").alias("w2"), F.col("f").alias("a"))
    ones = words.select("id", "f")
    twos = cut(grams.filter("w2 < 0").select("w0", "w1", "a"))
    threes = grams.filter("w2 >= 0")

    def one(at: str, name: str) -> DataFrame:
        return ones.select(F.col("id").alias(at), F.col("f").alias(name)).hint("merge")

    # in prefix order: counts of the first word and of the first two; in suffix order: of the last two and of the last
    begun = threes.join(twos.select("w0", "w1", F.col("a").alias("f01")).hint("merge"), ["w0", "w1"]).join(one("w0", "f0"), "w0")
    ended = cut(begun.join(twos.select(F.col("w0").alias("w1"), F.col("w1").alias("w2"), F.col("a").alias("f12")).hint("merge"), ["w1", "w2"]).join(one("w2", "f2"), "w2"))

    def score(left: str, right: str, name: str) -> dict[str, Column]:
        return {f"{name}_over": _times("a", "a") * F.lit(1000000).cast("decimal(7,0)"), f"{name}_under": _times(left, right)}

    made = ended.withColumns(score("f0", "f12", "x") | score("f01", "f2", "y"))
    made = made.withColumns({"x": F.expr("x_over div x_under"), "y": F.expr("y_over div y_under")})
    early = F.col("x") <= F.col("y")
    best3 = made.select(
        "w0", "w1", "w2", "a", F.when(early, F.col("f0")).otherwise(F.col("f01")).alias("l"), F.when(early, F.col("f12")).otherwise(F.col("f2")).alias("r"),
        F.least("x", "y").alias("score"),
    )
    # the most frequent candidate that goes on after two words, and the one that comes to them
    after = ended.groupBy("w0", "w1").agg(F.max("a").alias("after"))
    ahead = ended.groupBy(F.col("w1").alias("w0"), F.col("w2").alias("w1")).agg(F.max("a").alias("ahead"))
    alone = twos.join(after.hint("merge"), ["w0", "w1"], "left").join(ahead.hint("merge"), ["w0", "w1"], "left")
    alone = alone.filter(100 * F.coalesce(F.greatest("after", "ahead"), F.lit(0)) < extended_percent * F.col("a"))
    made2 = alone.join(one("w0", "l"), "w0").join(one("w1", "r"), "w1").withColumns(score("l", "r", "x"))
    best2 = made2.select("w0", "w1", F.lit(_NONE).cast("long").alias("w2"), "a", "l", "r", F.expr("x_over div x_under").alias("score"))

    text = lambda at, name: words.select(F.col("id").alias(at), F.col("word").alias(name))
    named = best2.union(best3).join(words.select(F.col("id").alias("w0"), "lang", F.col("word").alias("a0")), "w0")
    named = named.join(text("w1", "a1"), "w1").join(text("w2", "a2"), "w2", "left").join(totals, "lang")
    named = named.select("lang", F.concat_ws(" ", "a0", "a1", "a2").alias("phrase"), "a", "l", "r", "n", "score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(by))
    ranked = ranked.filter(F.col("rank") <= top) if top else ranked
    return ranked.withColumn("rank", F.col("rank").cast("long"))
