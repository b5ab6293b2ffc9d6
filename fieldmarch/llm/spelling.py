"""Spelling variants: words one edit apart, by search schemes on bidirectional FM-indexes of the delimited vocabulary.

One edit leaves one half of a word as it is. So a search matches a half exactly and extends across the other, allowing one error: the last
half from right to left on the index of the vocabulary's text, the first half from left to right on the index of the reversed text. Both
are the same backward steps over suffix-rank intervals, once over words and once over reversed words.

No task holds the vocabulary. A word is asked for under each of its halves and stored under each half that a word of its length, or one
more or less, may ask for; equal halves meet in one group. Groups are packed into indexes of bounded size, and a half that more words hold
is dealt to several, each of which answers all who ask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmarch.session import cut, discard

#: A run is a word's spelling; other letters, digits and marks part runs.
RUN = "[A-Za-zÀ-ÿ]+"
EDITED = 31
LEAST_CHARS = 7
LEAST_COUNT = 2
FORM_RATIO = 10
#: Words in one index, and askers of a group that are searched at a time.
INDEX_WORDS = 1 << 14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Index:
    """FM-index of ``$word$word$...$``: suffix ranks by prefix doubling, the symbol before each suffix, and ranks of symbols in it."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.letters, coded = np.unique(text, return_inverse=True)  # the delimiter is the least
        n = self.n = len(text)
        rank, step = coded.astype(np.int64), 1
        while True:
            then = np.zeros(n, np.int64)
            then[:-step] = rank[step:] + 1
            key = rank * (n + 1) + then
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
            if step >= n:
                break
        self.order = order
        self.before = coded[order - 1].astype(np.int64)
        self.size = len(self.letters)
        #: Places of each symbol in ``before``, all symbols in one sorted list: a rank is a binary search.
        self.places = np.sort(self.before * (n + 1) + np.arange(n))
        self.first = np.searchsorted(coded[order], np.arange(self.size + 1))
        #: Which word a place of the text belongs to.
        self.word = np.cumsum(coded == 0) - 1

    def code(self, text: str) -> np.ndarray:
        """Numbers of the letters of a text; -1 where the index has none."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), self.size - 1)
        return np.where(self.letters[at] == points, at, -1)

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol and go on as those of ``[lo, hi)``."""
        known = np.maximum(symbol, 0)
        base = known * (self.n + 1)
        shift = self.first[known] - np.searchsorted(self.places, base)
        lo = np.searchsorted(self.places, base + lo) + shift
        hi = np.searchsorted(self.places, base + hi) + shift
        return np.where(symbol < 0, 0, lo), np.where(symbol < 0, 0, hi)

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval the distinct symbols before its suffixes: (which interval, symbol); the delimiter is not one."""
        size = hi - lo
        wide = size > self.size
        rows, each = np.flatnonzero(~wide), size[~wide]
        at = np.arange(each.sum()) + np.repeat(lo[rows] - np.concatenate([[0], np.cumsum(each)])[:-1], each)
        near = np.unique(np.repeat(rows, each) * self.size + self.before[at])
        far = (np.flatnonzero(wide)[:, None] * self.size + np.arange(self.size)).ravel()
        both = np.concatenate([near, far])
        both = both[both % self.size > 0]
        return both // self.size, both % self.size


def search(index: Index, asked: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asker, word of the index) of words one edit apart that have the asker's last ``exact`` letters at their end.

    An insertion or deletion inside a run of equal letters is tried at the run's left end only, so a pair is found once.
    """
    n = len(asked)
    size = np.array([len(w) for w in asked], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    letters = index.code("".join(asked))
    who = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, index.first[1])  # the end of a word: the delimiter after it
    # states without an error, by the number of letters still to match; all askers go on a letter a round
    left = size.copy()
    erring: list[tuple[np.ndarray, ...]] = []

    def stretch(who, lo, hi, left):
        """Go on without errors to the delimiter before the word."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            done = left == 0
            symbol = np.where(done, 0, letters[np.maximum(first[who] + left - 1, 0)])
            lo, hi = index.step(lo, hi, symbol)
            ended = done & (lo < hi)
            if ended.any():
                # one word is delimited so; the suffix begins with its delimiter
                found.append((who[ended], index.word[index.order[lo[ended]]]))
            alive = ~done & (lo < hi)
            who, lo, hi, left = who[alive], lo[alive], hi[alive], left[alive] - 1
        return found

    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while len(who):
        free = size[who] - left >= exact[who]
        if free.any():
            w, a, b, rest = who[free], lo[free], hi[free], left[free]
            after = np.where(rest > 0, letters[np.maximum(first[w] + rest - 1, 0)], -2)
            over = np.where(rest > 1, letters[np.maximum(first[w] + rest - 2, 0)], -3)
            row, symbol = index.symbols(a, b)
            other = symbol != after[row]
            row, symbol = row[other], symbol[other]
            x, y = index.step(a[row], b[row], symbol)
            # another letter in the word instead of this one, or besides it
            swap = rest[row] > 0
            erring.append((w[row][swap], x[swap], y[swap], rest[row][swap] - 1))
            erring.append((w[row], x, y, rest[row]))
            # this letter is not in the word
            gone = (rest > 0) & (after != over)
            erring.append((w[gone], a[gone], b[gone], rest[gone] - 1))
            pairs += stretch(*(np.concatenate(x) for x in zip(*erring, strict=True)))
            erring = []
        more = left > 0
        who, lo, hi, left = who[more], lo[more], hi[more], left[more]
        lo, hi = index.step(lo, hi, letters[first[who] + left - 1])
        alive = lo < hi
        who, lo, hi, left = who[alive], lo[alive], hi[alive], left[alive] - 1
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    key = np.unique(a * len(index.word) + b)
    return key // len(index.word), key % len(index.word)


def _answers(index_words: int):
    """Partial answers ``(word, n_near, best)`` from rows ordered by side, half, block and role: words of the index, then askers."""

    def solve(side: int, held: dict[str, int], stored: set[tuple[str, str]], askers: dict[str, None]) -> pa.RecordBatch:
        words, asked = list(held), list(askers)
        turn = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
        exact = np.array([len(w) // 2 if side == 0 else len(w) - len(w) // 2 for w in asked], np.int64)
        near: dict[str, int] = {}
        best: dict[str, tuple[int, str]] = {}
        for a, b in zip(*(x.tolist() for x in search(Index([turn(w) for w in words]), [turn(w) for w in asked], exact)), strict=True):
            asker, word = asked[a], words[b]
            first, last = asker[: len(asker) // 2], asker[len(asker) // 2 :]
            # a word that is here under another half answers where it is stored under this one; pairs that share the first half, from there
            if (last if side else first, word) not in stored or (side and word.startswith(first)):
                continue
            near[asker] = near.get(asker, 0) + 1
            best[asker] = min(best.get(asker, (0, "")), (-held[word], word))
        return pa.record_batch(
            [pa.array(near.keys(), pa.string()), pa.array(near.values(), pa.int64()), pa.array([-best[w][0] for w in near], pa.int64()), pa.array([best[w][1] for w in near], pa.string())],
            names=["word", "n_near", "best_n", "best"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group's askers follow its words, so an index closes when its words are many and a new group begins; askers of one group
        # may be more than fit, so they are searched in parts
        words: dict[str, int] = {}
        stored: set[tuple[str, str]] = set()
        asked: dict[str, None] = {}
        side, at = -1, None
        for batch in batches:
            for s, half, block, role, word, n in zip(*(batch.column(c).to_pylist() for c in ("side", "half", "block", "role", "word", "n")), strict=True):
                group = (s, half, block)
                if group != at:
                    if s != side or len(words) >= index_words:
                        if words and asked:
                            yield solve(side, words, stored, asked)
                        words, stored, asked, side = {}, set(), {}, s
                    at = group
                if role == 0:
                    words[word] = n
                    stored.add((half, word))
                else:
                    asked[word] = None
                    if len(asked) >= 2 * index_words:
                        yield solve(side, words, stored, asked)
                        asked = {}
        if words and asked:
            yield solve(side, words, stored, asked)

    return run


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: runs of letters of all texts, A-Z lower-cased, one in 31 with a letter struck out by its checksum."""
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    runs = docs.select(ids.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    struck = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    word = F.when(F.pmod(h, F.lit(EDITED)) == 0, struck).otherwise(F.col("run"))
    long_enough = runs.filter(F.char_length("run") >= least_chars).select(word.alias("word")).filter(F.char_length("word") >= least_chars)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def near_words(words: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """``word, n_near, best_n, best`` of each word of ``words(word, n)`` that has another one edit away, from all of them."""
    size = F.char_length("word")

    def first(k: Column) -> Column:
        return F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), k).alias("half"))

    def last(k: Column) -> Column:
        return F.struct(F.lit(1).alias("side"), F.substring("word", size - k + 1, k).alias("half"))

    def half(m: Column) -> Column:
        return F.floor(m / 2).cast("int")

    asks = words.select("word", "n", F.explode(F.array(first(half(size)), last(size - half(size)))).alias("at"))
    lengths = [size - 1, size, size + 1]
    stored = words.select("word", "n", F.explode(F.array_distinct(F.array(*[first(half(m)) for m in lengths], *[last(m - half(m)) for m in lengths]))).alias("at"))
    stored, asks = (x.select("at.side", "at.half", "word", "n") for x in (stored, asks))
    # halves that many words hold are dealt to several indexes
    crowded = cut(stored.groupBy("side", "half").agg(F.ceil(F.count("*") / index_words).cast("int").alias("blocks")).filter("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = stored.join(crowded, ["side", "half"], "left").select("side", "half", F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"), F.lit(0).alias("role"), "word", "n")
    spread = asks.join(crowded, ["side", "half"], "left").select("side", "half", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("role"), "word", "n")
    rows = dealt.union(spread).repartition("side", "half", "block").sortWithinPartitions("side", "half", "block", "role", "word")
    parts = rows.mapInArrow(_answers(index_words), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.order")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the chain of forms of each word that has one, by doubling pointers."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not longer.filter("moved").isEmpty()
        discard(links)
        links = longer
        if not moved:
            return links.select("word", "root")


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, index_words: int = INDEX_WORDS) -> DataFrame:
    """Every word of the documents with its near words: ``word, form, root, n, n_near, form_n``.

    Words are runs of letters (A-Z, a-z, U+00C0..U+00FF; A-Z lower-cased) of ``least_chars`` code points or more that occur
    ``least_count`` times; a run whose checksum with its document's id is a multiple of 31 loses a letter first. Words are near if one
    inserted, deleted or replaced code point parts them. ``form`` is the near word of the largest ``n``, of equal ones the first by code
    points, if that is at least ``ratio`` times the word's ``n``; ``root`` follows forms to the last. Counts grow along a chain of forms by
    ``ratio`` (over 1), so chains end.

    Null and empty texts have no words; a null id counts as an empty one; repeated rows count again. Very long runs are words like others,
    a search takes a step a letter. An empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    words = cut(vocabulary(docs, least_chars, least_count))
    near = cut(near_words(words, index_words))
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    roots = _roots(formed.filter("form is not null"))
    for table in (words, near):
        discard(table)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
