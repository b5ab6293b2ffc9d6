"""Exact ranks by slices against sorted lists, with one group holding nearly all rows."""

import random

from pyspark.sql import functions as F

from fieldmarch.operators import evaluation


def test_ranks_of_uneven_groups(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.uniform(0, 1e6), rng.randrange(20) * 0.5, -3.25])) for _ in range(20_000)]
    rows += [("same", 7.0)] * 50 + [("one", -1.0), ("two", 5.0), ("two", 1.0), ("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    n = F.col("n")
    got = {r.k: r for r in evaluation.at_rank(df, ["k"], "v", F.floor((n - 1) / 2), F.floor(n / 2), n - 1).collect()}
    for k in ("hot", "same", "one", "two"):
        own = sorted(v for g, v in rows if g == k and v is not None)
        assert (got[k].n, got[k].min_v, got[k].max_v) == (len(own), own[0], own[-1])
        assert (got[k].v0, got[k].v1, got[k].v2) == (own[(len(own) - 1) // 2], own[len(own) // 2], own[-1])
    assert (got["none"].n, got["none"].v0) == (0, None)
