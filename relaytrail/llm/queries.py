"""The registered query of each operator, on whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from relaytrail.llm import bpe, exact_dedup, mixing, plane_clusters, prefix_trie, quality, sharding, simhash, substring_dedup, token_files, toxicity, url_filters, warc
from relaytrail.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


@_query("op1_substring_dedup", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, md5(array_to_string(w[i:i+34], ' ')) AS s FROM d, unnest(generate_series(1, len(w) - 34)) AS t(i) WHERE len(w) >= 35
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT r, list_distinct(flatten(list(generate_series(i, i + 34)))) AS g FROM hit GROUP BY r
), word AS (
  SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT word.r, string_agg(x, ' ' ORDER BY i) AS k FROM word ANTI JOIN (SELECT r, unnest(g) AS i FROM gone) n USING (r, i) GROUP BY word.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(table(spark, sf_dir, "documents"))


@_query("op2_exact_dedup", r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents
), ranked AS (
  SELECT doc_id, norm, row_number() OVER w AS place, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER w AS keep_id
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@_query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.token_folder(docs)
    files = token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return token_files.read_token_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shares = [F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    return rated.select("doc_id", "tokens", *shares, "rate", "copies")


@_query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op6_quality_rules", quality.ORACLE_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query("op7_url_filters", url_filters.ORACLE_SQL)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"))


@_query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_NEAREST = """, d{n} AS (
  SELECT r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} c USING (j) GROUP BY r, c.k
), a{n} AS (
  SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)"""
_MEANS = """, m{n} AS (
  SELECT k, j, sum(x) AS s, count(*) AS n FROM v JOIN a{n} USING (r) GROUP BY k, j
), c{next} AS (
  SELECT c.k, j, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} c LEFT JOIN m{n} USING (k, j)
)"""


@_query("op11_plane_clusters", """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS (
  SELECT r, j, CAST(floor(64 * CAST(embedding[j] AS DOUBLE)) AS HUGEINT) AS x FROM e, unnest(generate_series(1, 64)) AS t(j)
), s AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM e QUALIFY k < 16
), c0 AS (
  SELECT k, j, x FROM s JOIN v USING (r)
)""" + "".join(_NEAREST.format(n=n) + _MEANS.format(n=n, next=n + 1) for n in range(3)) + _NEAREST.format(n=3) + """, h AS (
  SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY k
)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN e USING (r) JOIN h USING (k)
""")
def op11_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""


@_query("op12_prefix_trie", """
WITH t AS (
  SELECT conv_id, md5(length(r) || ':' || r || x) AS id, length(x) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(r) || ':' || r || x), 1, 32)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS donor, """ + _CRC32.format(text="CAST(conv_id AS VARCHAR)") + """ % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
  SELECT c.conv_id, 0 AS own, pos, id, size FROM c JOIN t ON t.conv_id = donor AND pos < h
  UNION ALL SELECT conv_id, 1, pos, id, size FROM c JOIN t USING (conv_id) WHERE pos >= h
), s AS (
  SELECT conv_id, coalesce(list(id ORDER BY own, pos) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(size ORDER BY own, pos) FILTER (id IS NOT NULL), []) AS sizes
  FROM c LEFT JOIN b USING (conv_id) GROUP BY conv_id
), p AS (
  SELECT conv_id, d, len(ids) AS n, ids[1:d] AS node, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size FROM s, unnest(generate_series(0, len(ids))) AS u(d)
), n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY node, d
), k AS (
  SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, d)
), below AS (
  SELECT a.node, a.d, count(*) FILTER (z.n_children = 0) AS n_leaves, sum((z.n_convs - 1) * z.size) AS saved
  FROM m a JOIN m z ON z.d >= a.d AND z.node[1:a.d] = a.node GROUP BY a.node, a.d
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN below USING (node, d) LEFT JOIN m u ON u.d = m.d - 1 AND u.node = m.node[1:m.d - 1] AND m.d > 0
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@_query("op13_warc", """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS original
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND place > 1 THEN original END AS refers_to
FROM r
""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))
