"""Near-duplicate documents: multi-index Hamming join of b-bit MinHash signatures, exact sets, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmarch.session import cut, discard

from .links import join_classes, one_of_each
from .words import Words, fold, minima, mix, sets, shingles, signed, slices

CHUNKS = 9
SYMBOLS = 4
BITS = 16
ERRORS = 1
#: Pigeonhole: with so many unlike symbols at most, one of the chunks has no more than ERRORS of them.
MOST = CHUNKS * (ERRORS + 1) - 1
SIGNATURE = [f"s{i}" for i in range(CHUNKS)]


def _sets_of(words: int):
    return lambda texts: sets(*shingles(Words(texts), words))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = np.uint64(1) << (np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(BITS))
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = _sets_of(words)(part.column("text"))
                low = mix(minima(values, first, CHUNKS * SYMBOLS)) >> np.uint64(64 - BITS)
                chunks = (low.reshape(-1, CHUNKS, SYMBOLS) * lanes).sum(axis=2, dtype=np.uint64)
                size = np.diff(first)
                cls = pa.array(signed(fold(values, first)), mask=size == 0)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("row"), pa.array(size), cls, *(pa.array(signed(np.ascontiguousarray(chunks[:, i]))) for i in range(CHUNKS))],
                    names=["doc_id", "row", "n_shingles", "cls", *SIGNATURE],
                )

    return run


def _keys() -> Column:
    """A key for each chunk and each symbol that may be wrong: the chunk with that symbol blanked, numbered in the blank's place."""
    keys = []
    for c, name in enumerate(SIGNATURE):
        for s in range(SYMBOLS):
            field = ((1 << BITS) - 1) << (BITS * s)
            field -= (1 << 64) if field >= 1 << 63 else 0
            tag = (c + 1) << (BITS * s)
            tag -= (1 << 64) if tag >= 1 << 63 else 0
            # which symbol is blank must count too, so chunks that differ in two places do not meet by their tags
            keys.append(F.xxhash64(F.lit(s), F.col(name).bitwiseAND(F.lit(~field)).bitwiseOR(F.lit(tag))))
    return F.array(*keys)


def _unlike(a: str, b: str, name: str) -> Column:
    """Symbols in which one chunk of two signatures differs."""
    x = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
    for shift in (8, 4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))


def _distance(a: str, b: str) -> Column:
    """Symbols in which two signatures differ."""
    return reduce(lambda x, y: x + y, [_unlike(a, b, name) for name in SIGNATURE])


def _may(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the signatures ``others`` differ from ``own`` in MOST symbols at most."""
    unlike = np.ascontiguousarray(others).view(np.uint16) != np.ascontiguousarray(own).view(np.uint16)
    return unlike.sum(axis=1) <= MOST


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Ids, whole texts and a number for each pair of the two."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.withColumn("row", F.xxhash64("doc_id", "text"))


def near_copies(docs: DataFrame, words: int = 4, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id with ``n_shingles``, ``component_id``, ``kept`` and ``row``, a number for its id and text.

    Texts are sets of distinct shingles of ``words`` words; a text with fewer words is one shingle, an empty or null one has none and is
    linked with nothing. Texts with ``100 * intersection >= percent * union`` are linked; ``component_id`` is the smallest id reachable.

    Signatures hold 9 chunks of 4 symbols of 16 bits. Texts of which at most 17 of the 36 symbols differ have a chunk with at most one
    unlike symbol, so blanking each symbol in turn makes them meet in one of 36 keys, for certain. Texts at the threshold itself differ
    in 7 symbols on average and in over 17 about once in 20 000. Links are confirmed on full sets; copies with equal sets are one class.

    Null ids: such rows take part, but a component without any id has a null ``component_id`` and keeps none. Rows that repeat an id
    are rows of their own and share its fate. Other columns are not read, so their names cannot clash.
    """
    return _grouped(docs, words, percent, doc_id, text).drop("root")


def _grouped(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Rows of ``near_copies`` with ``root``, a number of the component; null for rows without words."""
    source = _source(docs, doc_id, text)
    marks = ", ".join(f"{s} long" for s in SIGNATURE)
    signed_rows = cut(source.mapInArrow(_signatures(words), f"doc_id long, row long, n_shingles long, cls long, {marks}"))
    classes = cut(
        signed_rows.filter("cls is not null").groupBy("cls")
        .agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), *(F.first(s).alias(s) for s in SIGNATURE))
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = classes.select("cls", "row").join(wanted, "cls", "left_semi").hint("shuffle_hash")
        return source.select("row", "text").join(rows, "row").select("cls", "text")

    roots = join_classes(classes.select("cls", _keys().alias("keys"), *SIGNATURE), lambda a, b: _distance(a, b) <= MOST, _may, texts_of, _sets_of(words), percent)
    rooted = classes.select("cls", "least").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("cls", "root", "component_id")
    out = cut(
        signed_rows.select("doc_id", "row", "n_shingles", "cls").join(named, "cls", "left")
        .select("doc_id", "row", "n_shingles", "root", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
    for table in (signed_rows, classes):
        discard(table)
    return out


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near copies keeps one row of its smallest id; rows without words stay.

    A row without an id goes if any of its group has one, or else all but one go. Of rows that tie on the id the one with the smallest
    number of id and text stays, and of rows that repeat both any one.
    """
    found = _grouped(docs, words, percent, "doc_id", "text").filter("root is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = found.groupBy("root").agg(F.min(order)["row"].alias("kept_row"))
    gone = found.select("root", "row").distinct().join(kept, "root").filter("row <> kept_row").select(F.col("row").alias("gone_row"))
    near_row = "__near_row"
    marked = docs.withColumn(near_row, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    left = marked.join(gone, marked[near_row] == gone["gone_row"], "left_anti")
    return one_of_each(left, near_row, found.groupBy(F.col("row").alias(near_row)).count()).select(*docs.columns)
