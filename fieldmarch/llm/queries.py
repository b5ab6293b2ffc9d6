"""One query an operator over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmarch.session import cut

from . import chat, collocations, html, leaks, lines, mixing, near_copies, ngrams, quality, spelling, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: four-word shingles, similarity 0.8."""
    return near_copies.near_copies(_table(spark, sf_dir, "documents"), words=4, percent=80).drop("row")


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document so that sources come near their targets."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, verbatim or edited."""
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions of the chain for every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), toxicity.CATEGORIES))


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that is not blank with the line that stands for it: shingles of 5 characters, similarity 0.8."""
    return lines.fuzzy_lines(_table(spark, sf_dir, "documents"), chars=5, least=1).drop("row")


@_query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every fiftieth one."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


ORACLES["op10_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@_query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes the template, formatted in windows and read back."""
    quoted = "<|im_end|><|im_start|>assistant ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(quoted))
    return chat.read_back(cut(chat.windows(rows.union(more))))


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


@_query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the automaton and by the base model."""
    return ngrams.score(_table(spark, sf_dir, "documents"))


ORACLES["op4_near_copies"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i:i + 3], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
          JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
grow(doc_id, c) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM documents
    UNION SELECT l.b, min(g.c) FROM grow g JOIN links l ON l.a = g.doc_id JOIN recurring.grow o ON o.doc_id = l.b WHERE g.c < o.c GROUP BY l.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM grow LEFT JOIN n USING (doc_id)
"""

ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, list_reduce(list_transform(string_split(sha1(h), ''),
        lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 1 + 4 * (strpos('0123456789abcdef', c) - 1), 4)), lambda a, b: a || b) AS bits FROM p),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(range(1, 6),
      lambda k: CAST(substr(bits, 5 * i + k, 1) AS INTEGER)), lambda a, b: 2 * a + b) AS INTEGER), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to FROM d JOIN f USING (h)
"""


@_query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdicts of all documents."""
    return quality.repetition(_table(spark, sf_dir, "documents")).drop("n_repeats", "longest_repeat")


def _windows(n: int) -> str:
    """Words inside windows of ``n`` words that their text has twice or more."""
    return f"""(SELECT DISTINCT r, unnest(range(i, i + {n})) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c
                FROM (SELECT r, i, md5_number(string_agg(x, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) AS h, n FROM t) WHERE i + {n - 1} <= n) WHERE c > 1)"""


ORACLES["op12_quality"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
w5 AS (SELECT r, count(*) AS n FROM {_windows(5)} GROUP BY r),
w10 AS (SELECT r, sum(length(x)) AS n FROM {_windows(10)} JOIN t USING (r, i) GROUP BY r),
w51 AS (SELECT DISTINCT r FROM {_windows(51)}),
m AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(w5.n, 0) AS n_repeat_words, CAST(coalesce(w10.n, 0) AS BIGINT) AS repeated_chars, w51.r IS NOT NULL AS long
      FROM d LEFT JOIN lines USING (r) LEFT JOIN w5 USING (r) LEFT JOIN w10 USING (r) LEFT JOIN w51 USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeated_chars,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * repeated_chars <= 10 * word_chars AND NOT long AS kept FROM m
"""


@_query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


ORACLES["op11_spelling"] = r"""
WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hex AS (SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
sums AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2),
      lambda i: CAST(16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))),
      lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)]))) AS h FROM hex, poly),
v AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, c
      FROM sums) WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2),
cuts AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS k FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM v)),
pairs AS (SELECT a.w AS p, b.w AS q FROM cuts a JOIN cuts b ON a.k = b.k AND a.i = b.i AND length(a.w) = length(b.w) AND a.w <> b.w
      UNION SELECT v.w, cuts.w FROM cuts JOIN v ON cuts.k = v.w UNION SELECT cuts.w, v.w FROM cuts JOIN v ON cuts.k = v.w),
near AS (SELECT p, n AS pn, q, qn, count(*) OVER (PARTITION BY p) AS n_near, row_number() OVER (PARTITION BY p ORDER BY qn DESC, q) AS r
      FROM (SELECT p, a.n, q, b.n AS qn FROM pairs JOIN v a ON a.w = p JOIN v b ON b.w = q)),
formed AS (SELECT v.w AS word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN qn >= 10 * v.n THEN q END AS form, CASE WHEN qn >= 10 * v.n THEN qn END AS form_n
      FROM v LEFT JOIN near ON p = v.w AND r = 1),
walk AS (SELECT word, word AS root FROM formed UNION SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk USING (word) JOIN formed e ON e.word = walk.root AND e.form IS NULL
"""


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH pieces AS (SELECT row_number() OVER () AS r, lang, w FROM (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))),
grams AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
gone AS (SELECT c.lang, c.g FROM c JOIN (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a FROM c WHERE k = 3) t ON t.lang = c.lang AND t.g = c.g WHERE 100 * t.a >= 50 * c.a),
cuts AS (SELECT c.lang, c.g, a, x.f AS l, y.f AS r, j, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c ANTI JOIN gone USING (lang, g)) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:]),
best AS (SELECT *, array_to_string(g, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
