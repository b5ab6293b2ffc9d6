"""Similarity links between classes of equal items, and their components, without all pairs of a group.

Items are classes (numbered ``cls``); a class has keys, and any two classes that may be alike share one. Candidates of a key form a star
around its smallest class; they are verified exactly on their texts and merged by distributed union-find. Only keys that still hold
several components are looked at again: their classes outside the largest component, the stragglers, are dealt in blocks and meet the
members of that component and one another, and what may be alike is verified inside the task. So a key shared by a third of all rows costs
one test a row and one look a straggler and row, no pair is ever written down unless it is a link, and none is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmarch.session import cut, discard

MEMBERS_A_GROUP = 64
STRAGGLERS_A_PART = 512


def components(edges: DataFrame) -> DataFrame:
    """Union-find by contraction: ``edges(a, b)`` to ``(node, root)``, roots being nodes.

    In each round every node points to the smallest of itself and its neighbours, by number or, every second round, by a changing
    random order; edges are contracted along the pointers. Chains and stars shrink by a constant factor, so rounds grow with the
    logarithm of the longest chain. Each round ends in written tables.
    """
    live = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        order = (lambda c: c) if len(steps) % 2 == 0 else (lambda c, t=len(steps): F.xxhash64(c, F.lit(t)))
        both = live.select("a", "b").union(live.select("b", "a"))
        rank = lambda c: F.struct(order(F.col(c)).alias("o"), F.col(c).alias("to"))  # noqa: E731, B023
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("best")).select("node", F.least(rank("node"), "best")["to"].alias("to")))
        of_a = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        of_b = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        fresh = cut(
            live.join(of_a, "a").join(of_b, "b").filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        discard(live)
        live = fresh
        steps.append(step)
    discard(live)
    roots = None
    for step in reversed(steps):  # the last and smallest first
        nxt = step.withColumnRenamed("to", "root") if roots is None else _compose(step.withColumnRenamed("to", "root"), roots)
        roots = cut(nxt)
        discard(step)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots


def _compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """``(node, root)`` whose roots are nodes of ``then`` get the roots there."""
    return first.join(then.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))


def verify(pairs: DataFrame, texts: DataFrame, sets_of: Callable, percent: int) -> DataFrame:
    """Pairs (pivot, cls) whose full sets have ``100 * intersection >= percent * union``.

    A pivot's partners are dealt to groups of about 64, each with its own copy of the pivot's text, so a pivot of many partners is
    spread over tasks and every text moves once a pair. ``sets_of(texts)`` gives sorted distinct hashes and where each text's begin.
    """
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS_A_GROUP).alias("groups"))
    dealt = pairs.join(groups, "pivot").select("pivot", F.pmod(F.xxhash64("cls"), F.col("groups")).alias("part"), "cls")
    rows = (
        dealt.select("pivot", "part").distinct().select("pivot", "part", F.lit(0).alias("role"), F.col("pivot").alias("cls"))
        .union(dealt.select("pivot", "part", F.lit(1), "cls"))
        .join(texts.hint("merge"), "cls").select("pivot", "part", "role", "cls", "text")
        .repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role", "cls")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, role, cls = (batch.column(c).to_numpy() for c in ("pivot", "role", "cls"))
            values, first = sets_of(batch.column("text"))
            size = np.diff(first)
            found = []
            # members follow their pivot, which may be in the batch before
            heads = np.flatnonzero(role == 0)
            for head, stop in zip([-1, *heads], [*heads, len(role)], strict=True):
                if head >= 0:
                    own = values[first[head] : first[head + 1]].copy()
                a = head + 1
                if a < stop and len(own):
                    mine = values[first[a] : first[stop]]
                    hit = own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine
                    seen = np.concatenate([[0], np.cumsum(hit)])
                    both = seen[first[a + 1 : stop + 1] - first[a]] - seen[first[a:stop] - first[a]]
                    found.append(a + np.flatnonzero(100 * both >= percent * (len(own) + size[a:stop] - both)))
            found = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(pivot[found]), pa.array(cls[found])], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long").distinct()


def _screen(rows: DataFrame, marks: list[str], may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The ``rows(group, part, role, cls, root, *marks)`` that have anybody to be tested with, told by marks alone: no text moves for others."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, hit = None, [], set()
        names = ["group", "part", "role", "cls", "root"]

        def rows_of(role: int, cls: list[int], root: list[int]) -> pa.RecordBatch:
            group, part = at
            n = len(cls)
            return pa.record_batch([pa.array([group] * n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([role] * n, pa.int32()), pa.array(cls, pa.int64()), pa.array(root, pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, part, role, cls, root = (batch.column(c).to_numpy() for c in names)
            mark = np.stack([batch.column(m).to_numpy() for m in marks], axis=1)
            edges = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(role)], strict=True):
                if at != (group[a], part[a]):
                    if hit:
                        yield rows_of(0, [mine[i][0] for i in hit], [mine[i][1] for i in hit])
                    at, mine, hit = (group[a], part[a]), [], set()
                if role[a] == 0:
                    mine += zip(cls[a:b].tolist(), root[a:b].tolist(), mark[a:b], strict=True)
                    continue
                met = np.zeros(b - a, bool)
                for i, (_, own_root, own) in enumerate(mine):
                    which = may(own, mark[a:b]) & (root[a:b] != own_root)
                    if which.any():
                        hit.add(i)
                        met |= which
                if met.any():
                    yield rows_of(1, cls[a:b][met].tolist(), root[a:b][met].tolist())
        if hit:
            yield rows_of(0, [mine[i][0] for i in hit], [mine[i][1] for i in hit])

    dealt = rows.repartition("group", "part").sortWithinPartitions("group", "part", "role", "cls")
    return dealt.mapInArrow(check, "group long, part long, role int, cls long, root long")


def _settle(rows: DataFrame, marks: list[str], may: Callable[[np.ndarray, np.ndarray], np.ndarray], sets_of: Callable, percent: int) -> DataFrame:
    """Links ``(a, b)`` between roots from ``rows(group, part, role, cls, root, text, *marks)``: stragglers (role 0), then whom they meet."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine, found = None, [], set()
        for batch in batches:
            if not batch.num_rows:
                continue
            group, part, role, root = (batch.column(c).to_numpy() for c in ("group", "part", "role", "root"))
            mark = np.stack([batch.column(m).to_numpy() for m in marks], axis=1)
            values, first = sets_of(batch.column("text"))
            size, links = np.diff(first), []
            edges = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(role)], strict=True):
                if at != (group[a], part[a]):
                    at, mine, found = (group[a], part[a]), [], set()
                if role[a] == 0:
                    mine += [(root[i], mark[i], values[first[i] : first[i + 1]].copy()) for i in range(a, b)]
                    continue
                for own_root, own_mark, own in mine:
                    fits = (root[a:b] != own_root) & (100 * np.minimum(size[a:b], len(own)) >= percent * np.maximum(size[a:b], len(own)))
                    which = a + np.flatnonzero(fits)
                    which = which[may(own_mark, mark[which])]
                    # one link between two components is enough
                    which = which[[(own_root, r) not in found for r in root[which].tolist()]] if len(which) else which
                    if not len(which):
                        continue
                    runs = np.concatenate([[0], np.cumsum(size[which])])
                    theirs = values[np.arange(runs[-1]) + np.repeat(first[which] - runs[:-1], size[which])]
                    seen = np.concatenate([[0], np.cumsum(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs)])
                    both = seen[runs[1:]] - seen[runs[:-1]]
                    for r in set(root[which[100 * both >= percent * (len(own) + size[which] - both)]].tolist()):
                        found.add((own_root, r))
                        links.append((own_root, r))
            yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

    order = ["group", "part", "role", "cls"]
    return rows.repartition("group", "part").sortWithinPartitions(*order).mapInArrow(check, "a long, b long").distinct()


def join_classes(members: DataFrame, near: Callable[[str, str], Column], may: Callable[[np.ndarray, np.ndarray], np.ndarray], texts_of: Callable[[DataFrame], DataFrame], sets_of: Callable, percent: int) -> DataFrame:
    """Roots of linked classes: ``members(cls, keys, ...)`` to ``(cls, root)``; classes without a link are left out.

    The other columns of ``members`` are numbers that mark a class: ``near(a, b)`` tells from the marks of two aliases whether to test
    them, and ``may`` the same from one row of marks and a matrix of others. ``texts_of(wanted)`` gives ``(cls, text)`` of the wanted.
    """
    keys = members.select("cls", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other"), F.count("*").alias("members")).filter("pivot < other")
    # by merge: Spark sizes exploded keys as their lists, a small part of what they are, and would broadcast them
    held = cut(keys.join(shared.select("key", "pivot", "members").hint("merge"), "key"))
    marks = [c for c in members.columns if c not in ("cls", "keys")]
    sigs = cut(members.select("cls", *marks).join(held.select("cls").distinct(), "cls", "left_semi"))
    star = cut(_star(held, sigs, near))
    texts = cut(texts_of(star.select("pivot").union(star.select("cls")).union(held.filter("members > 2").select("cls")).toDF("cls").distinct()))
    return _rooted(held, star, sigs, marks, texts, may, sets_of, percent)


def join_keyed(keys: DataFrame, tasks: int, near: Callable[[str, str], Column], may: Callable[[np.ndarray, np.ndarray], np.ndarray], texts_of: Callable[[DataFrame], DataFrame], sets_of: Callable, percent: int) -> DataFrame:
    """As ``join_classes``, from rows ``keys(key, cls)`` that may repeat, sorted in ``tasks``; ``texts_of`` gives the marks with the texts.

    Keys move once, and only classes that share one get marks.
    """
    held = cut(shared_keys(keys, tasks))
    texts = cut(texts_of(held.select("cls").distinct()))
    marks = [c for c in texts.columns if c not in ("cls", "text")]
    sigs = texts.select("cls", *marks)
    return _rooted(held, cut(_star(held, sigs, near)), sigs, marks, texts, may, sets_of, percent)


def shared_keys(keys: DataFrame, tasks: int = 1) -> DataFrame:
    """``key, cls, pivot, members`` of the keys that two classes or more have; ``pivot`` is the least class, ``members`` counts to 3.

    One exchange: each task goes once along its rows in order of key and class and holds two rows of a key at most, so a key of any
    number of classes streams by.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)  # the first rows of a key that has shown no third one yet
        ruling: tuple[int, int, int] | None = None  # key, pivot and last class of a key whose rows go out already

        def rows(key, cls, pivot, members):
            return pa.record_batch([pa.array(key), pa.array(cls), pa.array(pivot), pa.array(np.broadcast_to(members, len(key)).astype(np.int64))], names=["key", "cls", "pivot", "members"])

        for batch in batches:
            key, cls = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("key", "cls")])], axis=1)
            held = held[:, :0]
            if not len(key):
                continue
            new = np.concatenate([[ruling is None or (key[0], cls[0]) != (ruling[0], ruling[2])], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
            key, cls = key[new], cls[new]
            if ruling:
                on = int(np.searchsorted(key, ruling[0], side="right"))
                if on:
                    yield rows(key[:on], cls[:on], np.full(on, ruling[1]), 3)
                    ruling = (ruling[0], ruling[1], int(cls[on - 1]))
                    key, cls = key[on:], cls[on:]
            if not len(key):
                continue
            ruling = None
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            if size[-1] >= 3:
                ruling = (int(key[-1]), int(cls[first[-1]]), int(cls[-1]))
            else:  # the next batch may go on with it
                held = np.stack([key[first[-1] :], cls[first[-1] :]])
                key, cls, first, size = key[: first[-1]], cls[: first[-1]], first[:-1], size[:-1]
            members, pivot = np.repeat(size, size), np.repeat(cls[first], size)
            out = members > 1
            yield rows(key[out], cls[out], pivot[out], np.minimum(members[out], 3))
        if held.shape[1] == 2:
            yield rows(held[0], held[1], np.full(2, held[1, 0]), 2)

    return keys.repartition(max(tasks, 1), "key").sortWithinPartitions("key", "cls").mapInArrow(mark, "key long, cls long, pivot long, members long")


def _star(held: DataFrame, sigs: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (pivot, cls) of a key whose marks allow the similarity."""
    star = held.filter("cls <> pivot").select("pivot", "cls").distinct()
    a, b = sigs.alias("a"), sigs.alias("b")
    star = star.withColumnRenamed("cls", "leaf").join(a, F.col("pivot") == F.col("a.cls")).join(b, F.col("leaf") == F.col("b.cls"))
    return star.filter(near("a", "b")).select("pivot", F.col("leaf").alias("cls"))


def _rooted(held: DataFrame, star: DataFrame, sigs: DataFrame, marks: list[str], texts: DataFrame, may: Callable, sets_of: Callable, percent: int) -> DataFrame:
    # a key of two classes is settled by its star
    crowd = held.filter("members > 2")
    linked = cut(verify(star, texts.select("cls", "text"), sets_of, percent))
    roots = components(linked)
    keyed = crowd.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    sizes = keyed.groupBy("key", "root").count()
    ruling = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("group"), F.count("*").alias("parts")).filter("parts > 1")
    stragglers = cut(keyed.join(ruling.select("key", "group"), "key").filter("root <> group").select("group", "cls", "root").distinct())
    # a group is a ruling component and all stragglers of its keys; stragglers go to parts of a bounded size
    parts = stragglers.groupBy("group").agg(F.ceil(F.count("*") / STRAGGLERS_A_PART).alias("parts"))
    own = stragglers.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    ruled = keyed.select("cls", "root").distinct().join(parts.select(F.col("group").alias("root"), "parts"), "root")
    met = ruled.select(F.col("root").alias("group"), "cls", "root", "parts").union(stragglers.join(parts, "group").select("group", "cls", "root", "parts"))
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = own.select("group", "part", F.lit(0).alias("role"), "cls", "root").union(met.select("group", "part", F.lit(1), "cls", "root"))
    rows = cut(_screen(rows.join(sigs.select("cls", *marks), "cls"), marks, may))
    screened = rows
    rows = rows.join(sigs.select("cls", *marks), "cls").join(texts.select("cls", "text").hint("merge"), "cls")
    found = cut(_settle(rows.select("group", "part", "role", "cls", "root", "text", *marks), marks, may, sets_of, percent))
    merged = components(found)
    # roots that were lone classes until now have no row yet
    out = cut(_compose(roots, merged).union(merged.join(roots, "node", "left_anti").select("node", "root")))
    for done in (held, star, texts, sigs, linked, roots, stragglers, screened, found, merged):
        discard(done)
    return out.select(F.col("node").alias("cls"), "root")


def one_of_each(rows: DataFrame, number: str, counts: DataFrame) -> DataFrame:
    """``rows`` with one row left of those that share a ``number`` which ``counts(number, count)`` has more than once.

    Only repeated rows are grouped, with a combine before the shuffle, so a row repeated by the million is no large task.
    """
    many = cut(counts.filter("count > 1").select(number))
    return rows.join(many, number, "left_anti").unionByName(rows.join(many, number, "left_semi").dropDuplicates([number]))
