"""Top-k against all scores."""

import math
import random

from fieldmarch.llm import topk


def plain(rows, k, every):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in usable if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_random_ties_and_awkward_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, rng.uniform(-2, 2)]) for _ in range(6)]) for i in range(700)]
    rows += [(i, [0.5, 0.5, -0.25, 0.0, 1.0, -1.0]) for i in range(700, 1000)]
    rows += [(1000, None), (1005, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1010, [float("nan")] * 6), (1015, [float("inf")] * 6), (1020, []), (None, [1.0] * 6), (1025, [1.0, 2.0]), (1026, [0.5, -0.5]), (-10, [0.25] * 6), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    assert got(topk.top_k(df, 5, 5)) == plain(rows, 5, 5)
    assert got(topk.top_k(df.filter("vec_id < 4"), 5, 2)) == plain([r for r in rows if r[0] is not None and r[0] < 4], 5, 2)
    assert topk.top_k(df.limit(0)).collect() == []


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert got(topk.top_k(df)) == plain([(r.vec_id, r.embedding) for r in df.collect()], 5, 50)
