"""NFKC on the JVM where a text is composed as it stands; Python sees only what it may change."""

import random
import unicodedata

from pyspark.sql import functions as F

from fieldmarch.functions import text as X

TEXTS = [
    "", "plain\nline", "Größe é à ñ Ç", "한글 문장", "漢字かな", "été x", "́a", "ﬁne №5 ①", "ạ̇́b", "한 한",
    "がき", "x y…", "ไทย ภาษา", "\U0001d400\U0001f600z", "¨ µ ½", "Å\n̈́", None,
]


def test_nfkc_equals_unicodedata(spark):
    rng = random.Random(2)
    pool = "aZ 9\n.éßŁ가각각゙̣́か漢ﬁ½①ไ…‑̀Ӂ\U0001d400"
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.nfkc(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.n == (texts[r.i] and unicodedata.normalize("NFKC", texts[r.i])), repr(texts[r.i])


def test_stable_characters_are_stable():
    import re

    joins = {int(d.split()[1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and len(d.split()) == 2}
    for c in re.findall(f"[{X.STABLE}]", "".join(chr(c) for c in range(0xd800))):
        assert unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0 and ord(c) not in joins


def test_composed_texts_stay_on_the_jvm(spark):
    df = spark.createDataFrame([("Größe und Überfluß " * 50,), ("한글 " * 50,), ("é " + "x" * 500,)], "t string")
    sent = df.select(F.when(~F.col("t").rlike(X.COMPOSED), F.regexp_extract_all("t", F.lit(X.UNSURE), F.lit(0))).alias("u")).collect()
    assert [r.u for r in sent] == [None, None, ["é"]]
