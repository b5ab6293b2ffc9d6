"""Fuzzy lines against all pairs, awkward rows."""

import random

import corpus_pipeline
import numpy as np

from fieldmarch.llm import lines, links, queries, words

from . import brute


def shingle_set(line):
    line = brute.lower(line).strip(" \t\n\x0b\x0c\r")
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def test_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["of", "the", "ßen", "tion", "and", "𝔘nder", "ing"]) + rng.choice(["a", "er", "st", "é"]) * rng.randrange(1, 4)
    stock = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = []
    for d in range(90):
        text = []
        for _ in range(rng.randrange(0, 6)):
            line = rng.choice(stock) if rng.random() < 0.6 else " ".join(word() for _ in range(12))
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(line) + 1)
                line = line[:at] + rng.choice(["", "x", " "]) + line[at + 1 :]
            text.append(rng.choice(["", "  ", "\t"]) + rng.choice([line, line.upper() if line.isascii() else line]))
        rows.append((d, "\n".join(text)))
    rows += [(None, stock[0]), (None, None), (200, ""), (201, "\n\n"), (202, "y" * 300_000 + "\n" + "y" * 300_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, cls int").repartition(5)
    got = lines.fuzzy_lines(df).collect()
    assert sorted([(r.doc_id, r.line, r.first_doc_id, r.first_line, r.kept) for r in got], key=repr) == brute.like_lines(rows, 5, 1)
    assert lines.fuzzy_lines(df.limit(0)).collect() == []

    gone = {}
    for d, n, _, _, kept in brute.like_lines(rows, 5, 1):
        if not kept:
            gone.setdefault(d, set()).add(n)
    want = []
    for d, t in rows:
        if t is not None and not (d is None and t is None) and gone.get(d):
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d])
            if not brute.words(t):
                continue
        want.append((d, t))
    left = lines.drop_repeated_lines(df)
    assert left.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=repr) == sorted(want, key=repr)


def edited_pairs(seed):
    """Lines of 40 to 150 characters, each with a copy that has one word or one character changed in the middle."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 9)))
    for i in range(240):
        words, size = [], rng.randrange(40, 150)
        while len(" ".join(words)) < size:
            words.append(word())
        line, copy = " ".join(words), list(words)
        if i % 2:
            copy[len(copy) // 2] = word()
            yield line, " ".join(copy)
        else:
            at = len(line) // 2
            yield line, f"{line[:at]}*{line[at + 1 :]}"


def test_edits_of_ordinary_lines_as_the_query_runs_it(spark, tmp_path):
    pairs = list(edited_pairs(5))
    five = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    alike = [100 * len(five(a) & five(b)) >= 80 * len(five(a) | five(b)) for a, b in pairs]
    missed_at_12 = [x and 100 * len(shingle_set(a) & shingle_set(b)) < 80 * len(shingle_set(a) | shingle_set(b)) for x, (a, b) in zip(alike, pairs, strict=True)]
    assert sum(missed_at_12) > 40
    rows = [(2 * i + j, line) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.first_doc_id, r.kept) for r in queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    for i, linked in enumerate(alike):
        assert got[2 * i + 1] == ((2 * i, False) if linked else (2 * i + 1, True)), pairs[i]


def test_short_lines_as_the_query_runs_it(spark, tmp_path):
    rows = [(0, "Home\nx\n  \n" + "a line of ordinary length, to be kept\nok"), (1, "home \n\n\tHOME\nX"), (2, "\n \n"), (3, None), (4, "OK\nmenu"), (None, "menu\nno"), (5, "-")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()
    assert sorted([(r.doc_id, r.line, r.first_doc_id, r.first_line, r.kept) for r in got], key=repr) == brute.like_lines(rows, 5, 1)
    assert len(got) == 12 and sum(not r.kept for r in got) == 5
    left = {r.doc_id: r.text for r in corpus_pipeline.remove_repeated_lines(spark, df, str(tmp_path)).collect()}
    assert left == {0: rows[0][1], 2: "\n \n", 3: None, 4: "menu", None: "no", 5: "-"}


def test_given_lines_at_the_query_measure(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.QUERIES["op8_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted([(r.doc_id, r.line, r.first_doc_id, r.first_line, r.kept) for r in got], key=repr) == brute.like_lines(rows, 5, 1)


def test_repeated_rows_stay_once(spark):
    text = "first line of the text\nsecond line, which is another"
    rows = [(1, text)] * 20 + [(None, text + " one of no id at all")] * 5 + [(2, " \n")] * 2 + [(3, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = lines.drop_repeated_lines(df, chars=5, least=1)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(1, text), (None, "second line, which is another one of no id at all"), *rows[-4:]], key=repr)


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    for union in (5, 10, 40, 85, 160):
        both, n = union * 4 // 5, 1500
        values = rng.integers(0, 1 << 63, (n, union), dtype=np.uint64)
        one = values[:, : both + (union - both) // 2]
        two = np.concatenate([values[:, :both], values[:, one.shape[1] :]], axis=1)
        keys = [lines.band_keys(np.ascontiguousarray(x).ravel(), np.arange(0, n * x.shape[1] + 1, x.shape[1])) for x in (one, two)]
        assert (keys[0] == keys[1]).any(axis=1).mean() > 0.997, union
        # unlike lines hardly meet
        assert (keys[0] == np.roll(keys[0], 1, axis=0)).any(axis=1).mean() < 0.01


def test_sketches_allow_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for union in (5, 10, 85, 400):
        both, n = union * 4 // 5, 3000
        values = rng.integers(0, 1 << 63, (n, union), dtype=np.uint64)
        one = values[:, : both + (union - both) // 2]
        two = np.concatenate([values[:, :both], values[:, one.shape[1] :]], axis=1)
        bits = [lines.sketches(np.ascontiguousarray(x).ravel(), np.arange(0, n * x.shape[1] + 1, x.shape[1])) for x in (one, two)]
        apart = np.bitwise_count(bits[0] ^ bits[1])
        assert apart.max() <= lines.UNLIKE and 6 < apart.mean() < 7, union
        # of unlike lines half the bits differ
        assert (np.bitwise_count(bits[0] ^ np.roll(bits[0], 1)) > lines.UNLIKE).mean() > 0.99


def test_sets_of_texts_apart():
    values, first = words.sets(np.array([7, 3, 7, 7, 9, 9, 2], np.uint64), np.array([0, 3, 3, 4, 7, 7]))
    assert values.tolist() == [3, 7, 7, 2, 9] and first.tolist() == [0, 2, 2, 3, 5, 5]


def test_shared_keys_whatever_the_batches(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(-40, 40), rng.randrange(12) - 6) for _ in range(300)] + [(99, c) for c in range(50)] * 2 + [(100, 7)] * 30 + [(101, 1), (101, 2)]
    by = {}
    for k, c in rows:
        by.setdefault(k, set()).add(c)
    want = sorted((k, c, min(cs), min(3, len(cs))) for k, cs in by.items() if len(cs) > 1 for c in cs)
    for size in (1, 2, 7, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = links.shared_keys(spark.createDataFrame(rows, "key long, cls long")).select("key", "cls", "pivot", "members").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, got)) == want
