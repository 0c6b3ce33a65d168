"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in
the shared folder and hands it on reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, language, line_dedup, mixing, ngram_join
from gneiss.llm.queries import tokenizer
from gneiss.plans.storage import arrow_rows, scratch, scratch_path, stored
from gneiss.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Language ID rejects texts without letters and those whose best language has less than this of their words.
LEAST_SCORE = 0.5
#: Near duplicates: word shingles of this size, this similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Texts that a worker of the tokenizer gets at a time.
ROWS = 1_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of one known language."""
    return language.confident(docs.select(*COLUMNS), language.train(docs), LEAST_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks that an earlier one holds; those of which nothing is left go."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.where((F.col("lines_removed") == 0) | F.coalesce("text", F.lit("")).rlike(r"\S")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates, and the least row of each repeated doc_id."""
    groups = ngram_join.jaccard_components(docs, size=SHINGLE, percent=PERCENT)
    surplus = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("surplus")).distinct(), "surplus")
    few = surplus.count() <= ngram_join.BROADCAST_IDS
    kept = docs.select(*COLUMNS).join(F.broadcast(surplus) if few else surplus, F.col("doc_id") == F.col("surplus"), "left_anti").select(*COLUMNS)
    several = stored(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    if several.isEmpty():
        return kept
    one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(several, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to equal weights of all sources, in random order."""
    return mixing.replicate(docs).select(*COLUMNS)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every copy, written here so that few texts go to a worker at a time."""
    with arrow_rows(spark, ROWS):
        return stored(bpe.digests(docs, bpe.load_vocabulary(spark, tokenizer())), "digests")


STAGES = [
    ("language id", language_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", tokenize_stage),
]

#: A fitted random field, alignment and byte-pair merges are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed corpus: each stage's result is written and reread, and what a stage has
    stored on its way is deleted when it ends.

    Null texts and texts without letters go in the first stage; of rows that repeat a doc_id the least stays after
    near duplicates; extra columns and columns of clashing names are left out by the first
    stage; an empty table goes through all stages and gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
            keep(path)
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    return docs
