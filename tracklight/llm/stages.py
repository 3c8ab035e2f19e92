"""The stages of the corpus pipeline, each of one operator. A stage gets (spark, docs, sf_dir); all but the last give the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm import jaccard, language, mixing, quality, sentence_pieces
from tracklight.llm.common import checkpoint, freeing_shuffles, table

#: A document goes if its language is undetermined or has less than this mean chance.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are, by the field fitted on the documents, mostly in one known language."""
    found = language.identify(docs, language.train(docs))
    sure = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return found.where(sure).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the boosted trees keep."""
    return quality.rate(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more over shingles of five words: the one of the smallest doc_id.

    Links are exact Jaccard similarities, which pivot tables of fingerprints have left to verify. The documents' rows are numbered as they are
    read, so that equal rows can be told apart; of several with the smallest doc_id the first stays. What the search for groups shuffles
    is deleted step by step.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    with freeing_shuffles(spark):
        groups = jaccard.similar_groups(numbered, "_row")
    groups = groups.join(numbered.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = groups.groupBy("group").agg(first.alias("first")).select("first._row")
    return numbered.join(kept, "_row", "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole, in the order of training positions."""
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    sizes = checkpoint(numbered.select("_row", "source", mixing.n_words().alias("size")))
    mixed = mixing.mix(sizes.withColumnRenamed("_row", "doc_id")).where("copies > 0")
    passes = F.filter(
        F.array(
            F.when(F.col("copies") > 0, F.coalesce("position", "position2")),
            F.when(F.col("copies") > 1, F.col("position2")),
        ),
        lambda x: x.isNotNull(),
    )
    mixed = mixed.select(F.col("doc_id").alias("_row"), F.explode(passes).alias("_position"))
    return numbered.join(mixed, "_row").orderBy("_position", "_row").select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and whether the pieces decode to the text."""
    coded = sentence_pieces.encode(docs.select("doc_id", "source", "text"), drop_text=True)
    return coded.select("doc_id", "source", "ids", "n_tokens", "ids_sha256", "round_trip")
