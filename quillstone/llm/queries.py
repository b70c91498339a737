"""The opN queries: each applies one operator to its whole table and returns the columns agreed for it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe_coding, exact_dedup, langid, license_scan, mixing, near_dedup, packing, prefix_trie, quality, suffix_dedup, token_align, token_hist, toxicity
from quillstone.llm.common import cut, documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("p_good", 6).alias("p_good"), "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_hist.length_table(documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_align.align(documents(spark, sf_dir))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return token_align.scored(cut(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(prefix_trie.end_digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))


def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_coding.encode(documents(spark, sf_dir))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe_coding.ids_sha256("ids").alias("ids_sha256"), F.sha2(bpe_coding.decoded("ids"), 256).alias("decoded_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents
), g AS (
  SELECT doc_id, points, plain,
    first_value(doc_id) OVER w AS keep_id, first_value(points) OVER w AS most,
    count(*) OVER (PARTITION BY plain) AS group_size
  FROM d WINDOW w AS (PARTITION BY plain ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AND points = most AS kept, sha256(plain) AS text_sha256 FROM g
"""

OP7_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sizes GROUP BY source
), w AS (
  SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM src
), q AS (
  SELECT source, s, w, sum(s) OVER () AS total,
    coalesce(sum(s) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER (ORDER BY s / w, source NULLS LAST) AS k
  FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * before) / rest AS level FROM q
), t AS (
  SELECT source, s, w, arg_min(CASE WHEN level * w < 2.0::DOUBLE * s THEN level END, CASE WHEN level * w < 2.0::DOUBLE * s THEN k END) OVER () AS shared FROM l
), r AS (
  SELECT source, s, CASE WHEN shared IS NULL THEN 2.0::DOUBLE * s ELSE least(2.0::DOUBLE * s, shared * w) END AS target FROM t
), e AS (
  SELECT d.doc_id, d.size, r.s AS source_size, r.target, CASE WHEN r.s > 0 THEN r.target / r.s ELSE 0.0::DOUBLE END AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR) || ':', '') || 'mix-1'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS draw
  FROM sizes d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM e
"""

def _op1_sql(rules: tuple[quality.Rule, ...] = quality.RULES, iterations: int = quality.ITERATIONS) -> str:
    """Counts by windows over words; votes by the rules' own conditions; expectation-maximisation as a recursive query."""
    n = len(rules)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 ELSE -1 END" for r in rules)
    ratio = "CASE v[j] WHEN 1 THEN ln(g[j] / b[j]) WHEN 0 THEN ln((1 - g[j]) / (1 - b[j])) ELSE 0 END"
    odds = lambda v: f"ln(prior / (1 - prior)) + list_sum(list_transform(range(1, {n + 1}), lambda j: {ratio.replace('v[j]', v + '[j]')}))"
    share = lambda start, p, voted: f"({start} + list_sum(list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN {voted} THEN ps[i].n * {p} ELSE 0.0::DOUBLE END)))"
    rate = lambda start, p: f"list_transform(range(1, {n + 1}), lambda j: least(0.999::DOUBLE, greatest(0.001::DOUBLE, {share(start, p, 'ps[i].v[j] = 1')} / {share('2.0::DOUBLE', p, 'ps[i].v[j] >= 0')})))"
    return rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), grams AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS times FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), repeats AS (
  SELECT k, count(DISTINCT i + d) AS n_repeat_words FROM grams, range(0, 3) AS r(d) WHERE times > 1 GROUP BY k
), counts AS (
  SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^.!?]+', '', 'g')) AS n_stops
  FROM t LEFT JOIN repeats USING (k)
), voted AS MATERIALIZED (
  SELECT *, [{votes}] AS v, n_words < {quality.FEWEST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), patterns AS (
  SELECT coalesce(list({{'v': v, 'n': n}}), []) AS ps FROM (SELECT v, count(*)::DOUBLE AS n FROM voted WHERE NOT base_failed GROUP BY v)
), em AS (
  SELECT 0 AS k, 0.9::DOUBLE AS prior, list_transform(range({n}), lambda x: 0.95::DOUBLE) AS g, list_transform(range({n}), lambda x: 0.4::DOUBLE) AS b, ps FROM patterns
  UNION ALL SELECT k + 1, least(0.99::DOUBLE, greatest(0.01::DOUBLE, (0.9::DOUBLE + list_sum(list_transform(range(1, len(ps) + 1), lambda i: ps[i].n * pp[i]))) / (1.0::DOUBLE + list_sum(list_transform(ps, lambda x: x.n))))),
    {rate('1.9::DOUBLE', 'pp[i]')}, {rate('0.8::DOUBLE', '(1 - pp[i])')}, ps
  FROM (SELECT em.*, list_transform(ps, lambda x: 1 / (1 + exp(-({odds('x.v')})))) AS pp FROM em WHERE k < {iterations} AND len(ps) > 0)
), judged AS (
  SELECT voted.* EXCLUDE (v), 1 / (1 + exp(-({odds('v')}))) AS p FROM voted, (SELECT prior, g, b FROM em ORDER BY k DESC LIMIT 1)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(p, 6) AS p_good, NOT base_failed AND p >= {quality.THRESHOLD} AS kept FROM judged
"""


#: Each window of 100 bytes, told by its md5, and the runs of bytes that later ones cover.
OP4_SQL = r"""
WITH h AS (
  SELECT doc_id, hex(coalesce(text, '')) AS hx, strlen(coalesce(text, '')) AS n FROM documents
), parts AS (
  SELECT doc_id, c * 1000 AS base, substr(hx, c * 2000 + 1, 2198) AS part FROM (SELECT doc_id, hx, unnest(range(0, (n + 999) // 1000)) AS c FROM h WHERE n >= 100)
), windows AS (
  SELECT doc_id, base + i AS start, md5(substr(part, 2 * i + 1, 200)) AS m FROM (SELECT *, unnest(range(0, least(1000, length(part) // 2 - 99))) AS i FROM parts WHERE length(part) >= 200)
), late AS (
  SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, start) > 1
), marked AS (
  SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 100 THEN 0 ELSE 1 END AS fresh FROM late
), runs AS (
  SELECT doc_id, min(start) AS s, max(start) + 100 AS e FROM (SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM marked) GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM runs
), cut AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(substr(hx, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(hx), 2 * max(e) + 1) AS kept
  FROM pieces JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)
"""

#: All pairs that share a shingle, and what is reached from each document.
OP6_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t
), one AS (
  SELECT doc_id, unnest(g) AS x, len(g) AS n FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT DISTINCT a AS id, a AS r FROM edges UNION SELECT reached.id, edges.b FROM reached JOIN edges ON reached.r = edges.a
), least AS (
  SELECT id, min(r) AS c FROM reached GROUP BY id
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN least ON id = doc_id
"""

#: Each prefix by the digests of its turns, its members, and what lies behind it by all prefixes of each node.
OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, sha256(length(role) || ':' || role || text) AS x, length(text) AS points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT conv_id, list(x ORDER BY p) AS xs, list(points ORDER BY p) AS ps, conv_id - (conv_id % 100 + 100) % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 6 AS h
  FROM t GROUP BY conv_id
), built AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(b.xs, 1, o.h), []), list_slice(o.xs, o.h + 1, len(o.xs))) AS xs, list_concat(coalesce(list_slice(b.ps, 1, o.h), []), list_slice(o.ps, o.h + 1, len(o.ps))) AS ps
  FROM own o LEFT JOIN own b ON b.conv_id = o.base
), members AS (
  SELECT conv_id, d, array_to_string(list_slice(xs, 1, d), '') AS k, d = len(xs) AS ended, coalesce(ps[d], 0) AS points FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM built)
), nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(points) AS points, coalesce(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM members GROUP BY k, d
), children AS (
  SELECT left(k, 64 * (d - 1)) AS k, d - 1 AS d, count(*) AS c FROM nodes WHERE d > 0 GROUP BY 1, 2
), whole AS (
  SELECT nodes.*, coalesce(c, 0) AS c FROM nodes LEFT JOIN children USING (k, d)
), sums AS (
  SELECT left(k, 64 * a) AS k, a AS d, count(*) FILTER (WHERE c = 0) AS leaves, sum((n - 1) * points) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM whole) GROUP BY 1, 2
)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.c AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN sums s ON s.k = w.k AND s.d = w.d LEFT JOIN nodes p ON w.d > 0 AND p.d = w.d - 1 AND p.k = left(w.k, 64 * (w.d - 1))
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_license_scan, op4_suffix_dedup, op5_exact_dedup, op6_minhash_near_dedup, op7_source_mixing, op8_language_id, op9_best_fit_packing, op10_toxicity, op11_token_alignment, op12_conversation_trie, op13_bpe_coding)}
_SQL = {"op1_quality_rules": _op1_sql(), "op4_suffix_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op7_source_mixing": OP7_SQL, "op12_conversation_trie": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
