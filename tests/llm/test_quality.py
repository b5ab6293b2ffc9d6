"""Repetition measures against plain ones, suffix by suffix; awkward rows; limits."""

import random
import re

import numpy as np

from fieldmarch.llm import quality

from .brute import WORD


def plain(text, least=10, percent=10, most=50):
    text = text or ""
    w = [(m.group(), len(m.group())) for m in WORD.finditer(text)]
    words, n = [x for x, _ in w], len(w)
    depth = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            depth[i], depth[j] = max(depth[i], k), max(depth[j], k)

    def inside(size):
        return [any(depth[j] >= size and j <= i < j + depth[j] for j in range(i + 1)) for i in range(n)]

    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars, repeats = sum(c for _, c in w), sum(inside(5))
    held = sum(c for (_, c), x in zip(w, inside(least), strict=True) if x)
    failed = n < 10 or 100 * repeats > 20 * n
    starts = sum(depth[i] >= least and (i == 0 or depth[i - 1] <= depth[i]) for i in range(n))
    longest = max(depth, default=0)
    return (n, chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, starts, held, longest, failed, not failed and 100 * held <= percent * chars and longest <= most)


def test_against_plain(spark):
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a", "a " * 40, "x\nx\n\nx\n", "ß 𝔘 ß 𝔘 " * 12]
    for _ in range(60):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 3) + rng.choice(["", "é", "#", "|"]) for _ in range(rng.randrange(5, 90))]
        if rng.random() < 0.6:
            at, size = rng.randrange(len(words)), rng.randrange(4, 30)
            words += [f"w{i}" for i in range(rng.randrange(60))] + words[at : at + size]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t "]) for w in words))
    clean = " ".join(f"w{i}" for i in range(400))
    texts += [clean, clean + " " + clean, " ".join(f"v{i}" for i in range(2000)) + " " + " ".join(f"v{i}" for i in range(55))]
    rows = [(i % 50 if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(1, clean, 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(4)
    got = quality.repetition(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "repeated_chars", "longest_repeat", "base_failed", "kept")
    want = sorted([(d, *plain(t)) for d, t, _ in rows], key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {(w[-2], w[-1]) for w in want} == {(True, False), (False, False), (False, True)}
    assert quality.repetition(df.limit(0)).collect() == []


def test_one_word_ten_thousand_times():
    zeros = np.zeros(10_000, np.int64)
    want = np.maximum(np.arange(9_999, -1, -1), 0)  # each suffix but the longest is a prefix of the one before it
    want[1:] = np.arange(9_999, 0, -1)
    assert quality.longest_repeats(zeros, zeros).tolist() == want.tolist()


def test_repeats_do_not_cross_texts():
    words, text = np.array([1, 2, 3, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1])
    assert quality.longest_repeats(words, text).tolist() == [0] * 6
