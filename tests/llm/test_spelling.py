"""Spelling variants against plain edit distance; the index by itself; awkward rows; split groups."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldmarch.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_search_finds_each_word_once():
    rng = random.Random(5)
    for _ in range(150):
        letters = "abé"[: rng.randrange(1, 4)]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(40)})
        asked = [*words, "abzab", "zzz", "abab"]
        got = spelling.search(spelling.Index(words), asked, np.array([len(w) - len(w) // 2 for w in asked]))
        want = [(i, j) for i, p in enumerate(asked) for j, w in enumerate(words) if near(p, w) and w.endswith(p[len(p) // 2 :])]
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want


def plain(rows):
    """rows: (id, text)."""
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = best if best and n[best] >= 10 * n[w] else None, len(others)

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted([(w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n], key=repr)


def corpus():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghéÀ") for _ in range(rng.randrange(5, 12))) for _ in range(60)]

    def edit(w):
        i, c = rng.randrange(len(w)), rng.choice("abcé")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])

    rows = []
    for i in range(400):
        t = " ".join(rng.choice([w, w, w.upper(), edit(w), edit(edit(w))]) for w in rng.choices(base, k=rng.randrange(30)))
        rows.append((rng.choice([i, i, None]), rng.choice([t, t, t, None, "", f"{t}7{t}"])))
    # a chain: each of the forms occurs ten times as often as the one before
    rows += [(1000 + i, "chainword") for i in range(220)] + [(2000 + i, "chaimword") for i in range(21)] + [(3000 + i, "chaimwordd") for i in range(2)]
    return [*rows, (5, f"{'a' * 300} {'a' * 301} " * 2), (5, f"{'a' * 300} {'a' * 301} " * 2)]


@pytest.mark.parametrize("index_words", [1 << 14, 5])
def test_against_plain_distances(spark, index_words):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, word int").repartition(3)
    got = spelling.variants(df, index_words=index_words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
