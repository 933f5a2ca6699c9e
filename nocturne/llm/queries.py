"""One query per operator, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from nocturne.llm import (
    bpe, cascade, contentsort, cotraining, disclosure, hardnegatives, jaccard, kdshard, licenses, packing, spelling,
    suffix_tree, topk,
)
from nocturne.llm.common import read, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op7_bpe_rank_array")
def op7(spark, sf_dir):
    return bpe.encoding_digests(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_tiled_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op3(spark, sf_dir):
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


WORD = r"[^\x20\x09-\x0D]+"


@query("op6_rule_cascade", rf"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT k, i, array_to_string(w[i : i + 7], ' ') AS g FROM t, unnest(range(1, len(w) - 6)) r(i)
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1
), repeated AS (
  SELECT k, count(DISTINCT i + j) AS n FROM again, range(0, 8) r(j) GROUP BY k
), l AS (
  SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{WORD}') GROUP BY k
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '[A-Za-z]')) AS letters,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters
  FROM t LEFT JOIN repeated USING (k) LEFT JOIN l USING (k)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * capitals > 6 * letters
    OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words) OR 10 * stutters > 3 * n_words) AS kept
FROM f
""")
def op6(spark, sf_dir):
    return cascade.judge(read(spark, sf_dir, "documents"))


@query("op10_license_set_join", licenses.twin())
def op10(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op4_certified_best_fit")
def op4(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_kd_tree")
def op8(spark, sf_dir):
    return kdshard.shard(read(spark, sf_dir, "documents"), 16)


@query("op9_combination_prefix_join", rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS MATERIALIZED (
  SELECT k, doc_id, CASE WHEN len(w) >= 5
    THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t
), x AS MATERIALIZED (SELECT k, hash(unnest(s)) AS g FROM s),
p AS MATERIALIZED (SELECT a.k AS a, b.k AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k),
n AS MATERIALIZED (SELECT k, len(s) AS n FROM s),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n u ON u.k = a JOIN n v ON v.k = b WHERE 100 * c >= 80 * (u.n + v.n - c)
), r(k, m) AS (
  SELECT k, k FROM n UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.m
), c AS (SELECT r.k, min(o.doc_id) AS least FROM r JOIN s o ON o.k = r.m GROUP BY r.k)
SELECT doc_id, len(s) AS n_shingles, CASE WHEN len(s) > 0 THEN least ELSE doc_id END AS component_id
FROM s JOIN c USING (k)
""")
def op9(spark, sf_dir):
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


@query("op1_co_training")
def op1(spark, sf_dir):
    return cotraining.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_disclosure")
def op5(spark, sf_dir):
    return disclosure.find(read(spark, sf_dir, "documents"))


@query("op2_suffix_tree")
def op2(spark, sf_dir):
    return suffix_tree.scores(read(spark, sf_dir, "documents"))


@query("op11_slot_negatives", """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS j FROM s WHERE same
), w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.j ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM p JOIN s n ON p.j <= 5 AND n.a = p.a AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
""")
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hardnegatives.labelled_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256)
    return hardnegatives.mine(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


@query("op12_content_sort", r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER same = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW same AS (PARTITION BY t ORDER BY doc_id NULLS LAST)
""")
def op12(spark, sf_dir):
    return contentsort.equal_texts(read(spark, sf_dir, "documents"))


# The checksum goes byte by byte over a table of 256 numbers built by its rule.
@query("op13_trie_pairs", r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), d AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, ord(x) - 64] END))),
    lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM d, tab
), v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
      ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), skip AS MATERIALIZED (
  SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM v, range(1, length(word) + 1) t(i)
), near AS MATERIALIZED (
  SELECT DISTINCT x.word, y.word AS other, y.n FROM skip x JOIN skip y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM skip x JOIN v y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM skip x JOIN v y ON y.word = x.a || x.b
), best AS MATERIALIZED (
  SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(other, (-n, other)) AS form FROM near GROUP BY word
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form,
    CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)
), walk(word, root) AS (
  SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
), ends AS (SELECT walk.word, root FROM walk JOIN f ON f.word = root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
""")
def op13(spark, sf_dir):
    return spelling.group_variants(read(spark, sf_dir, "documents"))
