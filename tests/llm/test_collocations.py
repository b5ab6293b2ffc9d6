"""Collocations against plain counts; awkward rows; exactness of scores."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from fieldmarch.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, top=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    gone = {s for g, a in found.items() if len(g) == 4 for s in (g[:3], (g[0], *g[2:])) if 100 * a >= 50 * found[s]}
    by = {}
    for g, a in found.items():
        if g not in gone:
            cuts = [(1000000 * a * a // (f[g[: 1 + k]] * f[(g[0], *g[1 + k :])]), k) for k in range(1, len(g) - 1)]
            score, k = min(cuts)
            by.setdefault(g[0], []).append((score, a, " ".join(g[1:]), f[g[: 1 + k]], f[(g[0], *g[1 + k :])]))
    out = []
    for lang, phrases in by.items():
        phrases.sort(key=lambda p: (-p[0], -p[1], p[2].encode()))
        out += [(lang, i, p[2], p[1], p[3], p[4], n[lang], p[0]) for i, p in enumerate(phrases[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    words = ["a", "b", "A", "c\x01", "c", "é", "the", "d-e", "\x00"]
    rows = [(rng.choice(["en", "en", "en", None, "de", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    return rows + [(None, None), ("en", ""), ("en", " .\n"), ("fr", "x y z " * 400)] + [("fr", "twice told, twice told")] * 12


def test_against_plain_counts(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 400)  # many blocks
    df = spark.createDataFrame([(i, lang, text, 0) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # counts go on over many batches
    try:
        assert sorted(map(tuple, collocations.collocations(df).select(*COLUMNS).collect())) == plain(rows)
        few = collocations.collocations(df, top=3).select(*COLUMNS).collect()
        assert sorted(map(tuple, few)) == plain(rows, top=3)
        assert collocations.collocations(df.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_adding_a_sorted_stream_whatever_the_batches():
    rng = np.random.default_rng(1)
    head, third = np.sort(rng.integers(0, 5, 400)), rng.integers(-1, 3, 400)
    order = np.lexsort((third, head))
    third, f = third[order], rng.integers(1, 4, 400)
    threes = {(h, t): int(f[(head == h) & (third == t)].sum()) for h, t in set(zip(head.tolist(), third.tolist())) if t >= 0}
    for size in (1, 3, 50, 400):
        batches = [pa.record_batch([pa.array(x[i : i + size]) for x in (head, third.astype(np.int32), f)], names=["head", "third", "f"]) for i in range(0, 400, size)]
        got = pa.Table.from_batches(list(collocations._added(20)(iter(batches)))).to_pylist()
        assert {(r["head"], r["third"]): r["f"] for r in got if r["third"] >= 0} == {k: v for k, v in threes.items() if v >= 20}
        twos = Counter()
        for r in got:
            if r["third"] < 0:
                twos[r["head"]] += r["f"]
        assert twos == Counter({h: int(f[head == h].sum()) for h in range(5)})
