"""Toxicity: accuracy on labelled documents held out of training, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from fieldmarch.llm import toxicity


def test_fit_matches_plain_newton():
    rng = np.random.default_rng(2)
    dense = (rng.random((200, 12)) < 0.3).astype(float)
    y = (dense @ rng.normal(size=12) + rng.normal(size=200) > 0).astype(float)
    first = np.concatenate([[0], np.cumsum(dense.sum(axis=1))]).astype(int)
    got = toxicity.fit(toxicity.Rows(np.nonzero(dense)[1], first, 12, np.ones((200, 1))), y)
    x, w = np.hstack([dense, np.ones((200, 1))]), np.zeros(13)
    for _ in range(50):
        p = toxicity.sigmoid(x @ w)
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + toxicity.RIDGE * np.eye(13), x.T @ (p - y) + toxicity.RIDGE * w)
    assert np.abs(got - w).max() < 1e-3


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    chain = toxicity.train(docs, labels.filter(~held), toxicity.CATEGORIES)
    rows = toxicity.score(docs, chain).join(labels.filter(held), "doc_id").select("is_toxic", "toxic").collect()
    wrong = [r for r in rows if r.is_toxic != bool(r.toxic)]
    assert len(rows) > 500 and len(wrong) <= 0.03 * len(rows), (len(wrong), len(rows))


def test_awkward_rows(spark):
    rows = [(i, f"fine words {i} again" + (" vile" if i % 3 == 0 else ""), 0.5) for i in range(60)] + [(None, "vile", 1.0), (900, None, 1.0), (901, "", 1.0), (902, "fine " * 200_000 + "vile", 1.0), (5, "fine", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, labels, toxicity.CATEGORIES)
    got = {(r.doc_id, r.is_toxic) for r in toxicity.score(df, chain).collect()}
    assert got == {(i, i % 3 == 0) for i in range(60)} | {(None, True), (900, False), (901, False), (902, True)}
    assert toxicity.drop(df, chain, "toxic").count() == 43 and toxicity.drop(df, chain, "toxic").columns == df.columns
    assert toxicity.score(df.limit(0), chain).collect() == []
    blank = toxicity.train(df, labels.limit(0), toxicity.CATEGORIES)
    assert not any(r.is_toxic for r in toxicity.score(df, blank).collect())
