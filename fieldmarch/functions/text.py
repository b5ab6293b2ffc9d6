"""Utterance text as column expressions. Only NFKC needs Python, and only for characters that it may change."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_all(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda items: None if items is None else [unicodedata.normalize("NFKC", x) for x in items])


#: Characters that NFKC leaves alone, that never join what stands before them, and that no mark moves past: of ASCII, Latin, basic Cyrillic, usual
#: punctuation, kana, Han and Hangul syllables. A text of these is composed as it stands.
STABLE = (
    r"\x00-\x9f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0"
    r"\u01f4-\u024f\u0400-\u045f\u2010\u2012-\u2016\u2018-\u2023\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
)
COMPOSED = f"^[{STABLE}]*$"
#: Other characters with the one before them, which a mark may join.
UNSURE = f"[{STABLE}]?[^{STABLE}]+"


def nfkc(text: Column) -> Column:
    """Compatibility composition; only characters that it may change travel to Python, so its memory does not grow with the texts."""
    unsure = F.when(~text.rlike(COMPOSED), F.regexp_extract_all(text, F.lit(UNSURE), F.lit(0)))
    fixed, none = _nfkc_all(unsure), F.lit("")
    joined = F.array_join(F.zip_with(F.split(text, UNSURE, -1), fixed, lambda a, b: F.concat(F.coalesce(a, none), F.coalesce(b, none))), "")
    return F.when(fixed.isNotNull(), joined).otherwise(text)


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), r"[?!.,;:~…·]+", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_utterance(text: Column) -> Column:
    """NFKC, lower case, punctuation and white space runs to one space."""
    return _tidy(nfkc(F.coalesce(text, F.lit(""))))


def apply_lexicon(text: Column, rules: list[tuple[str, str]], squeeze: bool = True) -> Column:
    """Ordered regex replacements, then white space runs to one space."""
    out = reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " ")) if squeeze else out


def any_of(patterns: list[str], text: Column) -> Column:
    """Whether any pattern is found; one scan of the text for the whole list."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def yes_no(norm: Column, yes: list[str], no: list[str]) -> Column:
    return F.when(norm == "", None).when(any_of(no, norm), False).when(any_of(yes, norm), True)


def sentences(text: Column, ends: str = ".!?。！？") -> Column:
    """Sentences of a text; a point inside a number does not end one."""
    parts = F.split(F.trim(text), rf"(?U)(?<=[{ends}])\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def repeat_pieces(text: Column) -> Column:
    """Clauses of a transcript, cut after ``. ? ! ,`` and white space."""
    return sentences(text, ".?!,")


def nfkc_pieces(pieces: Column) -> Column:
    """Clauses in compatibility composition; arrays that are composed as they stand skip Python."""
    plain = F.forall(pieces, lambda p: p.rlike(COMPOSED))
    return F.coalesce(_nfkc_all(F.when(~plain, pieces)), pieces)


def tidy_pieces(composed: Column) -> Column:
    return F.transform(composed, _tidy)


def collapse_repeats(pieces: Column, tidy: Column) -> Column:
    """Join clauses, dropping one that says the same as the one before it.

    ``tidy`` is :func:`tidy_pieces` of :func:`nfkc_pieces`. Both inputs should be settled: a lambda
    would work an expression out again for every clause, and cannot call Python at all.
    """
    kept = F.filter(pieces, lambda p, i: (i == 0) | (F.get(tidy, i) != F.get(tidy, i - 1)))
    return F.array_join(kept, " ")


def fold_loop(text: Column, words: Column) -> Column:
    """The shortest word prefix that, three or more times over, is the whole text; else the text.

    ``words`` is the text split at spaces, settled.
    """
    n = F.size(words)

    def loops(size):
        unit = F.concat(F.array_join(F.slice(words, F.lit(1), size), " "), F.lit(" "))
        return F.when((n % size == 0) & (n / size >= 3), F.repeat(unit, (n / size).cast("int")) == F.concat(text, F.lit(" "))).otherwise(False)

    sizes = F.when(n >= 3, F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 3).cast("int"))), loops))
    first = F.get(sizes, F.lit(0))
    return F.coalesce(F.array_join(F.slice(words, F.lit(1), first), " "), text)


def asr_clean(text: Column, noise: list[str]) -> Column:
    """Transcript lines without blanks and noise markers, joined by a space."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    return F.trim(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin(noise)), " "))


def char_classes(text: Column) -> Column:
    """How many characters are Hangul, ASCII letters or digits, and neither these nor spaces."""
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]", ""))
    hangul, plain, spaces = count("가-힣"), count("A-Za-z0-9"), count(" ")
    return F.struct(hangul.alias("hangul"), plain.alias("plain"), F.greatest(F.length(text) - hangul - plain - spaces, F.lit(0)).alias("other"))


def tokens_of(hangul: Column, plain: Column, other: Column) -> Column:
    return F.ceil(hangul / 1.3 + plain / 3.5 + other / 1.5)


def estimate_tokens(text: Column) -> Column:
    """Cautious token estimate from counts of Hangul, ASCII letters and digits, and the rest."""
    n = char_classes(text)
    return tokens_of(n["hangul"], n["plain"], n["other"])


def strip_fillers(norm: Column, fillers: list[str]) -> Column:
    """Drop leading filler words but keep at least one word."""
    words = F.split(norm, " ")
    first = F.array_position(F.transform(words, lambda w: w.isin(fillers)), F.lit(False))
    drop = F.when(first == 0, F.size(words) - 1).otherwise(first - 1)
    return F.array_join(F.slice(words, (drop + 1).cast("int"), F.size(words)), " ")


def match_wake(norm: Column, exact: list[str], prefixes: list[str], command_only: list[str]) -> Column:
    """``variant, remainder`` when the text is an exact variant or starts with a prefix, spaces aside.

    The longest prefix wins; some count only with a command behind them.
    """
    compact = F.regexp_replace(norm, r"(?U)\s+", "")
    squeeze = lambda items: [i.lower().replace(" ", "") for i in items]
    ordered = sorted([(p, False) for p in squeeze(prefixes)] + [(p, True) for p in squeeze(command_only)], key=lambda x: -len(x[0]))
    hit = F.coalesce(*[
        F.when(compact.startswith(p) & ((F.length(compact) > len(p)) if only else F.lit(True)), F.lit(p)) for p, only in ordered
    ])
    whole = compact.isin(squeeze(exact))
    rest = F.regexp_replace(norm, F.concat(F.lit("^(?: *[^ ]){"), F.length(hit).cast("string"), F.lit("}")), F.lit(""))
    rest = F.btrim(rest, F.lit(" ,"))
    return F.when(norm == "", None).when(whole, F.struct(compact.alias("variant"), F.lit("").alias("remainder"))).when(
        hit.isNotNull(), F.struct(hit.alias("variant"), rest.alias("remainder")))
