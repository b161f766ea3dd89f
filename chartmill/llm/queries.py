"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartmill.llm import (
    cas_archive,
    cover_tree,
    divergence,
    dom_crf,
    hamming_join,
    kn_quality,
    packing,
    poisson_mix,
    prefix_trie,
    separator_scan,
    set_join,
    skip_chain,
    url_trees,
)
from chartmill.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, found in flat token files written from all documents."""
    return separator_scan.document_token_counts(read(spark, sf_dir, "documents"))


@query
def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: one row per piece."""
    return packing.piece_digests(packing.pack(read(spark, sf_dir, "documents")))


@query
def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_trees.filter_urls(read(spark, sf_dir, "pages"))


@query
def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return skip_chain.span_digests(skip_chain.find_personal_data(read(spark, sf_dir, "documents")))


@query
def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to tempered source weights, as many characters as before in the mean."""
    return poisson_mix.mix(read(spark, sf_dir, "documents"))


@query
def op6_hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return hamming_join.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op7_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    return cas_archive.archive_round_trip(read(spark, sf_dir, "pages"))


@query
def op8_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every fiftieth vector among all others."""
    return cover_tree.top_k(read(spark, sf_dir, "embeddings"))


@query
def op9_dom_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return dom_crf.extract_main_text(read(spark, sf_dir, "pages"))


@query
def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and verdict for every document."""
    return kn_quality.judge(read(spark, sf_dir, "documents")).drop("lang")


@query
def op11_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


@query
def op12_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links between sets of four-word shingles."""
    return set_join.linked_documents(read(spark, sf_dir, "documents"))


@query
def op13_late_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every source from the others of its language, and the words it stands out by."""
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


ORACLE_SQL["op5_poisson_mix"] = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(greatest(length(coalesce(text, '')), 1))::BIGINT AS chars FROM documents GROUP BY source),
weighted AS (SELECT source, chars, round(pow(chars::DOUBLE, 0.5) * 1000)::BIGINT AS weight FROM sizes),
rates AS (
  SELECT source, weight::DOUBLE / (SELECT sum(weight)::DOUBLE FROM weighted) * (SELECT sum(chars)::DOUBLE FROM weighted)
    / chars::DOUBLE AS rate FROM weighted),
parted AS (SELECT source, rate / greatest(ceil(rate / 500), 1) AS rate, greatest(ceil(rate / 500), 1)::BIGINT AS parts FROM rates),
steps AS (
  SELECT source, rate, parts, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM parted
  UNION ALL
  SELECT source, rate, parts, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps
  WHERE k < ceil(rate + 12 * sqrt(rate) + 25)),
listed AS (SELECT source, parts, list(c ORDER BY k) AS steps FROM steps GROUP BY source, parts),
drawn AS (
  SELECT d.*, list_transform(range(parts), lambda part: ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))
      || CASE WHEN part > 0 THEN ':' || part ELSE '' END), 1, 12))::BIGINT / 281474976710656.0::DOUBLE) AS u, l.steps
  FROM documents d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source),
counted AS (
  SELECT * EXCLUDE (u, steps), list_sum(list_transform(u, lambda one: len(list_filter(steps, lambda c: c <= one))))::INTEGER AS n_copies
  FROM drawn),
copies AS (SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM counted)
SELECT *, md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':' || copy) AS shuffle_key FROM copies"""

ORACLE_SQL["op7_content_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha256(html)) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d"""

ORACLE_SQL["op8_cover_tree_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5"""


ORACLE_SQL["op13_late_divergence"] = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
g AS (
  SELECT e.lang, e.source, coalesce(s.n, 0)::HUGEINT AS n, coalesce(l.v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d) e
  LEFT JOIN sizes s ON e.lang = s.lang AND e.source = s.source LEFT JOIN langs l ON e.lang = l.lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v) AS p
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 5)) // (l.n + 5 * l.v) AS q FROM kept k JOIN langs l ON k.lang = l.lang),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50"""

ORACLE_SQL["op11_prefix_fingerprints"] = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
heads AS (SELECT c.conv_id, pos + 1 AS depth, digest, words FROM c JOIN t ON t.conv_id = c.base WHERE pos < c.h),
lengths AS (SELECT c.conv_id, any_value(h) AS h, count(heads.depth) AS taken FROM c LEFT JOIN heads ON heads.conv_id = c.conv_id GROUP BY 1),
turns AS (
  SELECT * FROM heads UNION ALL
  SELECT t.conv_id, pos - h + taken + 1, digest, words FROM t JOIN lengths l ON t.conv_id = l.conv_id WHERE pos >= h),
walked AS (
  SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
    coalesce(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above,
    depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM turns) FROM c),
n AS (
  SELECT depth, sha256(prefix) AS node, sha256(any_value(above)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM walked GROUP BY depth, prefix),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.depth = n.depth + 1 AND m.parent = n.node) AS n_children FROM n),
s AS (
  SELECT w.depth, sha256(w.prefix) AS node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
    sum((k.n_convs - 1) * k.words)::BIGINT AS saved_tokens
  FROM k JOIN walked w ON w.conv_id = k.conv_id AND w.depth <= k.depth GROUP BY ALL)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM k JOIN s ON k.depth = s.depth AND k.node = s.node LEFT JOIN n p ON p.depth = k.depth - 1 AND p.node = k.parent"""
