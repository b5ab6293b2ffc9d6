"""Mixing: targets against a plain loop, nearness, limits, awkward rows."""

import re

from fieldmarch.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [n for n in names if n not in fixed]
        unit = (total - sum(fixed.values())) / max(1, sum(weight[n] for n in left))
        over = [n for n in left if unit * weight[n] > most * sizes[n]]
        if not over:
            return fixed | {n: unit * weight[n] for n in left}
        fixed |= {n: most * sizes[n] for n in over}


def check(df, slack):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want, got, taken = plain_targets(sizes), mixing.mix(df).collect(), {}
    source = {}
    for r in rows:
        source.setdefault((r.doc_id, len(WORD.findall(r.text or ""))), r.source)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= slack(s, t), (s, taken[s], t)
    return got


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = check(df, lambda s, t: 0.002 * t + 2)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, first)) == sorted(map(key, mixing.mix(df.repartition(5)).collect()))


def test_awkward_rows(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, None, "x", 2), (None, "d\te\x0bf", None, 3), (3, "", "empty", 4), (4, "w " * 5000, "é", 5), (5, "u v", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    check(df, lambda s, t: 5000)
    assert mixing.mix(df.limit(0)).collect() == []
    out = mixing.repeat_rows(df)
    assert out.columns == ["doc_id", "text", "source", "size", "copy"]
    assert sum(r.copies for r in mixing.mix(df).collect()) == out.count()
