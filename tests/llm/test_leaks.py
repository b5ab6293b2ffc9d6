"""Decontamination against plain dynamic programming, planted edits, awkward rows."""

import random

import numpy as np

from fieldmarch.llm import leaks

from . import brute


def plain_score(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


def test_alignment_matches_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 40))
        assert leaks.align(a, b)[0] == plain_score(a, b)


def test_planted_edits_and_awkward_rows(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)] + ["of", "the", "and"] * 40
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(14, 60))) for i in range(20)] + [(100, ["only", "two"]), (101, []), (None, text(30))]
    docs, want = [], set()
    for d in range(300):
        words = text(rng.randrange(0, 300))
        if d % 3 == 0:
            i, own = rng.choice([x for x in items if x[1]])
            own = list(own)
            if len(own) > 5:
                for k in sorted(rng.sample(range(len(own)), len(own) // 8), reverse=True):
                    own[k : k + 1] = rng.choice([[], ["edit"], [own[k], "more"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in own]
            want.add((d, i))
        docs.append((d, " ".join(words), 1))
    docs += [(None, " ".join(items[0][1]), 2), (900, None, 3), (901, "", 4), (902, "z " * 200_000 + " ".join(items[1][1]), 5)]
    want |= {(None, 0), (902, 1)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(102, None)], "item_id long, text string")
    found = leaks.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    by_id, text_of = dict(items), {d: t for d, t, _ in docs}
    for r in found:
        if r.doc_id != 902:
            own = by_id[r.item_id]
            assert abs(r.score - plain_score(own, brute.words(text_of[r.doc_id])) / (2 * len(own))) < 1e-9
    kept = leaks.drop_leaks(df, bench).collect()
    assert len(kept) == len(docs) - len({d for d, _ in want}) and kept[0].asDict().keys() == {"doc_id", "text", "item_id"}
    assert leaks.find_leaks(df.limit(0), bench).collect() == [] and leaks.find_leaks(df, bench.limit(0)).collect() == []


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, bench).collect()}
    items = [(r.item_id, " ".join(brute.words(r.text))) for r in bench.collect()]
    verbatim = {(r.doc_id, i) for r in df.collect() for i, t in items if f" {t} " in f" {' '.join(brute.words(r.text))} "}
    assert verbatim and found >= verbatim and all(r.score > 0.9 for r in leaks.find_leaks(df, bench).collect())


def test_recall_against_full_alignment(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, [word() for _ in range(rng.choice([5, 8, 12, 16, 16, 20, 24, 30]))]) for i in range(120)]
    docs, want = [], set()
    for d in range(3600):
        i, own = items[d % len(items)]
        copy = list(own)
        for k in rng.sample(range(len(own)), round(len(own) * rng.choice([0.25, 0.3, 0.33]))):
            copy[k] = f"e{rng.random()}"
        words = [word() for _ in range(20)] + copy + [word() for _ in range(20)]
        docs.append((d, " ".join(words)))
        number = {w: n for n, w in enumerate(dict.fromkeys(own + words))}
        if leaks.align(np.array([number[w] for w in own]), np.array([number[w] for w in words]))[0] >= len(own):
            want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in leaks.find_leaks(df, bench).collect()]
    assert len(want) > 2500 and len(found) == len(set(found))
    missed = want - set(found)
    assert len(missed) <= 0.002 * len(want), (len(missed), len(want))
    kept = {r.doc_id for r in leaks.drop_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}


def test_short_texts_are_found_once(spark):
    df = spark.createDataFrame([(1, "only two"), (2, "one")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "only two"), (8, "a long item " + "of many words " * 6), (9, "one")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.find_leaks(df, bench).collect()) == [(1, 7), (2, 9)]
