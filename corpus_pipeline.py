"""From raw documents to packed training sequences: language ID, line dedup, near duplicates, decontamination, packing.

Every stage takes all rows its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from terrafold.llm.shared import stored

#: A prediction below this is a guess: with four languages chance alone gives 0.25.
LEAST_SCORE = 0.35

#: Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without text or letters, or with a score under LEAST_SCORE, go."""
    found = language_id.identify(docs).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    ids = found.select(F.col("doc_id").alias("known_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("known_id")), "left_semi")


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier line; a document of which nothing is left goes. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, min_words=line_dedup.EVERY_LINE).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once."""
    groups = ngram_join.linked_components(docs)
    heads = groups.where("component_id = doc_id").select(F.col("doc_id").alias("head_id")).distinct()
    kept = docs.join(heads, F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)) == F.col("head_id"), "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("doc_id"))
    return kept.withColumn("copy", copy).where("copy = 1").select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unique_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", uncontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
