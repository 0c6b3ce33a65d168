"""One query per operator, over its whole table, and the SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, html_text, language, licenses, line_dedup, media, mixing, neighbours, ngram_join, pii
from gneiss.plans.storage import scratch_path
from gneiss.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer() -> str:
    """Where the public tokenizers' package keeps the vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose vec_id 20 divides."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to equal source weights and shuffled: all columns, ``mix_copy`` and ``mix_key``."""
    return mixing.replicate(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source AS mix_source, CAST(sum(greatest(coalesce(n_chars, 0), 0)) AS DOUBLE) AS size FROM documents GROUP BY 1
), total AS (SELECT sum(size) AS size, CAST(count(*) AS DOUBLE) AS n FROM sizes
), rates AS (
  SELECT mix_source, CASE WHEN sizes.size > 0 THEN 1.0 / n * total.size / sizes.size ELSE 0 END AS full_rate FROM sizes, total
), parts AS (
  SELECT mix_source, CASE WHEN full_rate > 500 THEN floor(full_rate) ELSE 0 END AS fixed,
         full_rate - CASE WHEN full_rate > 500 THEN floor(full_rate) ELSE 0 END AS rate FROM rates
), steps AS (
  SELECT mix_source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM parts
  UNION ALL
  SELECT mix_source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM steps
  WHERE k < ceil(rate + 10 * sqrt(rate) + 20)
), seeded AS (
  SELECT *, CAST(CAST('0x' || substr(md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT seeded.*, CAST(parts.fixed AS BIGINT) + (SELECT count(*) FROM steps
    WHERE steps.mix_source IS NOT DISTINCT FROM seeded.source AND steps.cdf <= seeded.u) AS n
  FROM seeded JOIN parts ON parts.mix_source IS NOT DISTINCT FROM seeded.source
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS BIGINT) AS mix_copy FROM counted WHERE n > 0
)
SELECT *, md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(mix_copy AS VARCHAR)) AS mix_key FROM copies
"""


def op3_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a grey PNG in an archive, read back through the data source."""
    folder = scratch_path(spark, "media")
    media.write_archives(table(spark, sf_dir, "documents"), folder)
    return media.features(media.read_archives(spark, folder))


def op4_combination_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingle sets at similarity 0.9: every document's set size and component."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document under the public byte-level vocabulary."""
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.load_vocabulary(spark, tokenizer()))


def op6_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, digest of the patterned spans, all spans."""
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op8_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model fitted outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after deleting aligned common blocks from the later one of each pair."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_additive_neighbours": op1_additive_neighbours,
    "op2_poisson_mixing": op2_poisson_mixing,
    "op3_media_archives": op3_media_archives,
    "op4_combination_prefix_join": op4_combination_prefix_join,
    "op5_backtracking_bpe": op5_backtracking_bpe,
    "op6_license_minhash": op6_license_minhash,
    "op7_bootstrapped_pii": op7_bootstrapped_pii,
    "op8_line_block_text": op8_line_block_text,
    "op9_crf_language": op9_crf_language,
    "op10_patience_line_dedup": op10_patience_line_dedup,
}
SQL = {"op2_poisson_mixing": OP2_SQL}
