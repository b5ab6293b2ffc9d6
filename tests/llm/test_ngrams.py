"""Language model: probabilities against plain dictionaries, proper mass, awkward rows."""

import math
import zlib
from collections import Counter

import duckdb

from fieldmarch.llm import ngrams

from . import brute


def plain(rows, order=3, kept=ngrams.KEPT_BACK):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    grams = Counter()
    for d, t in rows:
        if not held(d):
            s = ["<begin>", *brute.words(t), "<end>"]
            for k in range(1, order + 1):
                grams.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    single = {g[0]: c for g, c in grams.items() if len(g) == 1 and g != ("<begin>",)}
    n, v = sum(single.values()), len(single)

    def chance(s, i):
        p = (single.get(s[i], 0) + 0.1) / (n + 0.1 * (v + 1))
        for k in range(2, order + 1):
            if i >= k - 1:
                p = (grams[tuple(s[i - k + 1 : i + 1])] + kept[k - 1] * p) / (grams[tuple(s[i - k + 1 : i])] + kept[k - 1])
        return p

    out = []
    for d, t in rows:
        s = ["<begin>", *brute.words(t), "<end>"]
        out.append((d, held(d), len(s) - 1, sum(w in single for w in s[1:]), n, sum(math.log10((single.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in s[1:]), sum(math.log10(chance(s, i)) for i in range(1, len(s)))))
    return out, single, chance


def same(got, want):
    got, want = (sorted(map(tuple, x), key=repr) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and all(abs(a - b) < 1e-6 * max(1, abs(b)) for a, b in zip(g[5:], w[5:], strict=True)), (g, w)


def test_given_documents_and_awkward_rows(spark):
    rows = duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    rows += [(None, "of the and"), (None, None), (9001, ""), (9002, " \t"), (9003, "w " * 200_000), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame([(d, t, True) for d, t in rows], "doc_id long, text string, held_out boolean").repartition(5)
    want, single, chance = plain(rows)
    same(ngrams.score(df).collect(), want)
    assert ngrams.score(df.limit(0)).collect() == []
    # the chances of all tokens after a state, with one unknown, sum to one
    for state in (["<begin>"], ["<begin>", "of"], ["<begin>", "of", "the"], ["<begin>", "never seen"]):
        assert abs(sum(chance([*state, w], len(state)) for w in [*single, "unknown"]) - 1) < 1e-9
