"""Near copies against all pairs."""

import random

import duckdb

from fieldmarch.llm import near_copies
from fieldmarch.llm.links import components

from . import brute


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=repr)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7000, 7000)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, by.values())) == [200, 301]


def test_awkward_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30 ", "x30 ")
    rows = [
        (5, base), (3, base.upper()), (9, near), (None, near), (4, None), (6, ""), (7, "  \t\n"), (8, "one two"), (2, "One  two"),
        (9, "other words of a row that repeats its id"), (11, "ünï cödé ünï"), (12, "x" * 400_000), (13, "x" * 400_000 + " y"), (None, None),
    ]
    df = spark.createDataFrame([(d, t, "z", 0) for d, t in rows], "doc_id long, text string, cls string, root int")
    assert got(near_copies.near_copies(df)) == brute.near_copies(rows, 4, 80)
    assert near_copies.near_copies(df.limit(0)).collect() == []
    kept = near_copies.drop_near_copies(df, 4).collect()
    assert len(kept) == 10 and {r.doc_id for r in kept} == {3, 4, 6, 7, 2, 9, 11, 12, 13, None} and kept[0].asDict().keys() == {"doc_id", "text", "cls", "root"}


def test_family_of_borderline_copies(spark):
    rng = random.Random(4)
    rows = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(120)]
        for copy in range(40):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            rows.append((family * 100 + copy, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(near_copies.near_copies(df)) == brute.near_copies(rows, 4, 80)


def test_given_documents(spark):
    rows = duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(near_copies.near_copies(df)) == brute.near_copies(rows, 4, 80)


def test_one_row_of_each_component_stays(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(1, text("a"), "x")] * 40 + [(1, text("a").replace("a30 ", "z "), "y"), (3, text("a"), "x")]
    rows += [(None, text("b"), "x")] * 30 + [(None, text("b").replace("b30 ", "z "), "y")]
    rows += [(None, text("c"), "x"), (8, text("c"), "y"), (9, text("d"), "x"), (9, text("e"), "x"), (None, None, "x"), (None, None, "x"), (5, " ", "x"), (5, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    left = [tuple(r) for r in near_copies.drop_near_copies(df, 5).collect()]
    first = lambda i: [(d, (t or "").split(" ")[0]) for d, t, _ in left if d == i]
    assert first(1) == [(1, "a0")] and first(3) == [] and first(8) == [(8, "c0")] and sorted(first(9)) == [(9, "d0"), (9, "e0")]
    assert sorted(first(None)) == [(None, ""), (None, ""), (None, "b0")] and len(first(5)) == 2 and len(left) == 9
    assert set(left) <= set(rows)
    assert near_copies.near_copies(df).columns == ["doc_id", "row", "n_shingles", "component_id", "kept"]
    assert near_copies.drop_near_copies(df.limit(0), 5).collect() == []
