"""Language-model scores of whole documents by a weighted backoff automaton that is counted and handed out by shuffles.

States are the word sequences seen in training, up to the model's order less one; the root is the empty one. A state has an arc for each
token seen after it, weighted with the token's smoothed probability, and a failure arc to its sequence without the first word, weighted
with the mass kept back: ``(count of arc + m * probability at the shorter state) / (count of state + m)``, so an unseen token costs the
failure weights ``m / (count of state + m)`` down to the state that knows it. The root knows every token and one unknown.

No task or broadcast holds the whole automaton. Documents are packed in blocks; a block asks for the counts of its own n-grams, packed by
ranges of their hashes; each range adds up all blocks' training counts and answers each block. A block then holds exactly the part of the
automaton that its documents can walk, and walks it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmarch.session import cut, discard

from .words import Words, mix, slices

ORDER = 3
#: Mass kept back at a state, by the length of its sequence.
KEPT_BACK = {1: 200.0, 2: 4.0}
ADDED = 0.1
BLOCK_BYTES = 2 << 20
#: N-grams are told apart by so many bits, two of them for the order: fewer bytes to move, one in a million mistaken at 10**10 n-grams.
HASH_BITS = 56
RANGE_GRAMS = 1_500_000
_BEGIN, _END = mix(np.array([0xB0, 0xE0], np.uint64))
_STEP = np.uint64(0xA0761D6478BD642F)
_TAG = np.uint64(3)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed: sorted hashes' steps and small counts shrink well."""
    width = values.dtype.itemsize
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(data, n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


class Walk:
    """Tokens of a block's documents and the n-grams that end at each, with the order in an n-gram's lowest bits (0: a beginning)."""

    def __init__(self, texts: pa.Array, order: int):
        words = Words(texts)
        n = len(words.count)
        self.tokens = words.count + 1
        at = np.concatenate([[0], np.cumsum(words.count + 2)])
        steps = np.empty(at[-1], np.uint64)
        inner = np.ones(at[-1], bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        steps[inner], steps[at[:-1]], steps[at[1:] - 1] = words.hash, _BEGIN, _END
        place = np.arange(at[-1]) - np.repeat(at[:-1], words.count + 2)
        self.spot = np.flatnonzero(place > 0)  # where tokens are
        self.first = np.concatenate([[0], np.cumsum(self.tokens)])
        self.document = np.repeat(np.arange(n), self.tokens)
        #: By order: hashes of all n-grams that end at each place; shorter ones than the order where a document begins.
        self.grams = []
        h = steps
        for k in range(1, order + 1):
            if k > 1:
                longer = np.zeros_like(h)
                longer[1:] = mix(h[:-1] * _STEP + steps[1:])
                h = longer
            tag = np.where(place >= k - 1, np.uint64(k), np.uint64(0))
            if k == 1:
                tag = np.where(place > 0, np.uint64(1), np.uint64(0))
            self.grams.append((h >> np.uint64(64 - HASH_BITS) & ~_TAG) | tag)
        self.place = place

    def known(self, k: int) -> np.ndarray:
        """Places where an n-gram of order ``k`` ends (order 1 counts beginnings, which are states too)."""
        return np.flatnonzero(self.place >= k - 1)


def _asked(walk: Walk) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct n-grams of a block, and for each order the index of each place's n-gram (-1: none)."""
    own, index = [], []
    for k, grams in enumerate(walk.grams, 1):  # an order at a time, to hold less at once
        p = walk.known(k)
        distinct, back = np.unique(grams[p], return_inverse=True)
        at = np.full(len(walk.place), -1, np.int32)
        at[p] = back
        own.append(distinct)
        index.append(at)
    every = np.sort(np.concatenate(own))
    for distinct, at in zip(own, index, strict=True):
        at[at >= 0] = np.searchsorted(every, distinct).astype(np.int32)[at[at >= 0]]
    return every, index


def _packed(docs: DataFrame) -> DataFrame:
    """Blocks of about 2 MB of whole documents, compressed: ``block, ids, held, texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.record_batch([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                held.append(part)
                size += part.column("text").nbytes
                if size >= BLOCK_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return docs.mapInArrow(run, "block long, docs binary")


def _opened(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


def score(docs: DataFrame, order: int = ORDER, kept_back: dict[int, float] = KEPT_BACK) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, from all rows that are not held out.

    Tokens are the words (A-Z lower-cased, parted by space and U+0009..U+000D) and one end; a null or empty text is an end alone. Rows
    with ``crc32(doc_id as text) % 10 = 0`` are held out, a null id counting as the empty text. ``base_score`` is the sum of
    ``log10((c + 0.1) / (N + 0.1 * (V + 1)))``; ``score`` is the log10 probability of the text under the automaton, whose root is that
    base model. Repeated rows are counted and scored each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = cut(_packed(source))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 4 * order / RANGE_GRAMS / 2))))  # about four bytes a token at worst, half of them new

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                part = _opened(data.as_buffer())
                walk = Walk(part.column("text"), order)
                grams, index = _asked(walk)
                learn = ~part.column("held_out").to_numpy(zero_copy_only=False)
                taught = np.repeat(learn, walk.tokens + 1)
                total = np.zeros(len(grams), np.int64)
                for at in index:
                    total += np.bincount(at[taught & (at >= 0)], minlength=len(grams))
                edges = np.searchsorted(grams, (np.arange((1 << bits) + 1, dtype=object) << (HASH_BITS - bits))[:-1].astype(np.uint64)) if bits else np.zeros(1, np.int64)
                edges = np.append(edges, len(grams))
                full = np.flatnonzero(edges[:-1] < edges[1:])
                yield pa.record_batch(
                    [
                        pa.array(full), pa.array(np.full(len(full), block)), pa.array(edges[full + 1] - edges[full]),
                        pa.array([_pack(np.diff(grams[edges[r] : edges[r + 1]], prepend=np.uint64(0))) for r in full], pa.binary()),
                        pa.array([_pack(total[edges[r] : edges[r + 1]].astype(np.uint32)) for r in full], pa.binary()),
                    ],
                    names=["range", "block", "n", "grams", "counts"],
                )

    def answer(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        grams = np.concatenate([np.cumsum(_unpack(g.as_buffer(), n, np.uint64), dtype=np.uint64) for g, n in zip(table.column("grams"), sizes, strict=True)])
        own = np.concatenate([_unpack(c.as_buffer(), n, np.uint32) for c, n in zip(table.column("counts"), sizes, strict=True)])
        distinct, back = np.unique(grams, return_inverse=True)
        total = np.bincount(back, own, len(distinct)).astype(np.int64)
        word = (distinct & _TAG) == 1
        first = np.concatenate([[0], np.cumsum(sizes)])
        replies = [_pack(total[back[a:b]].astype(np.uint32)) for a, b in zip(first[:-1], first[1:], strict=True)]
        n = len(replies)
        return pa.table({
            "range": table.column("range"), "block": table.column("block"), "n": table.column("n"), "counts": pa.array(replies, pa.binary()),
            "tokens": pa.array([int(total[word].sum())] + [0] * (n - 1)), "types": pa.array([int((total[word] > 0).sum())] + [0] * (n - 1)),
        })

    reply = "range long, block long, n long, counts binary, tokens long, types long"
    asked = blocks.mapInArrow(ask, "range long, block long, n long, grams binary, counts binary")
    replies = cut(asked.groupBy("range").applyInArrow(answer, reply))
    sums = replies.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = sums.tokens or 0, sums.types or 0
    floor = ADDED / (tokens + ADDED * (types + 1))

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, parts in zip(batch.column("docs"), batch.column("parts").to_pylist(), strict=True):
                part = _opened(data.as_buffer())
                walk = Walk(part.column("text"), order)
                grams, index = _asked(walk)
                counts = np.concatenate([_unpack(p["counts"], p["n"], np.uint32) for p in sorted(parts, key=lambda p: p["range"])]).astype(np.float64)
                if len(counts) != len(grams):
                    raise ValueError("a block lacks answers")
                spot = walk.spot
                seen = counts[index[0][spot]]
                # arcs of the root, then of longer and longer states; a state that is not there hands on what its failure arc reaches
                base = p = seen * (floor / ADDED) + floor
                for k in range(2, order + 1):
                    there = index[k - 1][spot] >= 0
                    arc = np.where(there, counts[index[k - 1][spot]], 0)
                    state = np.where(there, counts[index[k - 2][spot - 1]], 0)
                    p = (arc + kept_back[k - 1] * p) / (state + kept_back[k - 1])
                total = lambda x: np.add.reduceat(x, walk.first[:-1])  # noqa: E731, B023
                yield pa.record_batch(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(walk.tokens), pa.array(total((seen > 0).astype(np.int64))),
                        pa.array(np.full(part.num_rows, tokens)), pa.array(total(np.log10(base))), pa.array(total(np.log10(p))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    by_block = replies.groupBy("block").agg(F.collect_list(F.struct("range", "n", "counts")).alias("parts"))
    out = cut(
        blocks.join(by_block, "block").select("docs", "parts")
        .mapInArrow(walk_all, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
    discard(blocks)
    discard(replies)
    return out
