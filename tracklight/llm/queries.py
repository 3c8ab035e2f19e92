"""The operators applied to the driver's tables: a query for each, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm import chat, html_text, language, licenses, mixing, quality, sentence_pieces, simhash, token_counts, vector_dups
from tracklight.llm.common import checkpoint, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = checkpoint(simhash.fingerprints(docs, drop_text=True))
    found = simhash.near_duplicates(prints)
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip, n_mismatches of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_pieces.encode(docs, ids=False, drop_text=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every document, sorted by position: that of the first pass over its source.

    Words that a second pass takes have their position in position2 of mix(), which isn't given here.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size"))
    mixed = mixing.in_order(mixing.mix(checkpoint(docs)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages, drop_page=True)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_finds, licenses (distinct, sorted, joined by commas), best_dice of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, drop_text=True)
    return found.select(
        "doc_id",
        F.size("finds").cast("long").alias("n_finds"),
        F.array_join(F.array_sort(F.array_distinct("finds.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("finds.dice"), F.lit(0.0)).alias("best_dice"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = quality.rate(docs, table(spark, sf_dir, "labels"), drop_text=True)
    return rated.select("doc_id", *quality.BASE, "base_failed", "kept", "score")


def op8_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return vector_dups.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    field = language.train(learned)
    found = language.identify(docs.select("doc_id", "text"), field, drop_text=True)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and digests of every conversation and of -1, read back from the formatted turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_turns(turns.unionByName(chat.tricky(turns))))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_mixing": op4_mixing,
    "op5_html_text": op5_html_text,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_vector_dups": op8_vector_dups,
    "op9_language": op9_language,
    "op10_chat": op10_chat,
}

ORACLE_SQL = {
    "op4_mixing": mixing.SQL,
    "op8_vector_dups": vector_dups.SQL,
    "op10_chat": chat.SQL,
}
