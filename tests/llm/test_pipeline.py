"""The pipeline against its stages' plain twins in a row, on a small corpus with planted cases."""

import random

import corpus_pipeline

from . import brute
from .test_leaks import plain_score
from .test_mixing import plain_targets


def corpus():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("ran", "sten", "tor", "vul") for c in ("a", "is", "ok", "um", "en")]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(25)) for i in range(4)]
    shared = [line(60), line(55)]
    docs = []
    for d in range(160):
        lines = [line(rng.randrange(15, 40)) for _ in range(rng.randrange(1, 4))]
        if d % 8 == 1:
            words = lines[0].split()
            words[3:3] = ["vileword"]
            lines[0] = " ".join(words)
        if d % 9 == 2:
            lines.append(rng.choice(shared))
        if d % 20 == 3:
            lines.append(f"{line(5)} {rng.choice(items)[1].upper()} {line(5)}")
        docs.append((d, "\n".join(lines)))
    for d in range(160, 180):
        words = docs[d - 160][1].split(" ")
        words[len(words) // 2] = "edited"
        docs.append((d, " ".join(words)))
    docs += [(180, docs[0][1]), (181, ""), (182, None)]
    sources = ["x", "x", "y", "z", None]
    rows = [(d, t, "en", sources[d % 5], len(t or "")) for d, t in docs]
    labels = [(d, 1, int("vileword" in (t or ""))) for d, t in docs]
    return rows, labels, items


def test_pipeline(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    source = {r[0]: r[3] for r in rows}
    left = [(d, t) for d, t, *_ in rows if "vileword" not in (t or "")]
    gone = {}
    for d, n, _, _, kept in brute.like_lines(left, 5, 1):
        if not kept:
            gone.setdefault(d, set()).add(n)
    cut = [(d, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) if d in gone else t) for d, t in left]
    left = [(d, t) for d, t in cut if d not in gone or brute.words(t)]
    kept = {d for d, _, c, k in brute.near_copies(left, 5, 80) if k}
    left = [(d, t) for d, t in left if d in kept]
    left = dict((d, t) for d, t in left if not any(plain_score(brute.words(i), brute.words(t)) >= 25 for _, i in items))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = {}
    for r in got:
        assert left[r.doc_id] == r.text and r.source == source[r.doc_id] and (r.n_chars == len(r.text or ""))
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert all(n <= 3 for n in copies.values())
    sizes, taken = {}, {}
    for d, t in left.items():
        n = len(brute.words(t))
        sizes[source[d]] = sizes.get(source[d], 0) + n
        taken[source[d]] = taken.get(source[d], 0) + n * copies.get(d, 0)
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= 15, (s, taken[s], target)
