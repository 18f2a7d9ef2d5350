"""The registered queries over the corpus tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, extract, jaccard, linedup, merkle, packing, quality, rules, shards, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file, and the split pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.tiktoken"))


def op3_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.json"))
    return packing.pack(parts)


def op6_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), 40)


def op8_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.drop_spread_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op11_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, pattern = vocabulary("byte_bpe_50k.json")
    found = align.alignment(table(spark, sf_dir, "documents"), path_a, vocabulary("piece_bpe_32k.model")[0], pattern, kind="end")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_fractal_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.manifest(table(spark, sf_dir, "documents"), claimed=merkle.without_breaks(2))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_crf_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"), extract.fit(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_posting_lists,
        op2_byte_bpe,
        op3_warc_merge,
        op4_ngram_jaccard,
        op5_best_fit_packing,
        op6_random_indexing,
        op7_histogram_shards,
        op8_noisy_channel,
        op9_robust_rules,
        op10_line_spread,
        op11_elementary_intervals,
        op12_fractal_manifest,
        op13_crf_extraction,
    )
}

_DIGIT = "(strpos('0123456789abcdef', substr(h, 5 * i + {j} + 1, 1)) - 1)"
_VALUE = " + ".join(f"{_DIGIT.format(j=j)} * {16 ** (4 - j)}" for j in range(5))
_SIGNS = " || ".join(f"substr('{warc.BASE32}', ((v >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))

OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(list_transform(range(0, 8), lambda i: CAST({_VALUE} AS INTEGER)), lambda v: {_SIGNS}), '') AS digest,
             max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, strlen(html) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS g FROM w),
k AS (SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) END AS k, g FROM s),
c AS (SELECT k, any_value(n) AS n, any_value(g) AS g FROM k WHERE k IS NOT NULL GROUP BY k),
t AS (SELECT k, n, unnest(g) AS gram FROM c),
l AS (
  SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.gram = b.gram AND a.k <> b.k
  GROUP BY a.k, b.k HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
least AS (SELECT r.a AS k, min(k.doc_id) AS least FROM reach r JOIN k ON k.k = r.b GROUP BY r.a)
SELECT k.doc_id, k.n AS n_shingles, coalesce(least.least, k.doc_id) AS component_id FROM k LEFT JOIN least ON least.k = k.k
"""

# What the model should find in the pages of these tables, whose article is an element of that name.
OP13_SQL = r"""
WITH b AS (
  SELECT page_id, url, list_filter(list_transform(
    string_split_regex(regexp_replace(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks
  FROM pages)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10))) AS n_chars FROM b
"""

ORACLES: dict[str, str] = {
    "op3_warc_merge": OP3_SQL,
    "op4_ngram_jaccard": OP4_SQL,
    "op10_line_spread": linedup.ORACLE_SQL,
    "op12_fractal_manifest": merkle.ORACLE_SQL,
    "op13_crf_extraction": OP13_SQL,
}
