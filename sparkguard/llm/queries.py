"""The registered queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, exact_dedup, language_id, lexical, minhash, ngram_join, packing, periodic_runs, sql, token_counts, token_output, topk_search, toxicity
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are conversations 2k (chosen) and 2k + 1 (rejected); spans are shown as text."""
    found = chat_format.format_preferences(chat_format.neighbouring_pairs(table(spark, sf_dir, "conversations")))
    masks = {side + "_mask": chat_format.mask_text(found[side + "_spans"]) for side in ("chosen", "rejected")}
    return found.withColumns(masks).drop("chosen_spans", "rejected_spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_digests(spark, token_output.write_ids(table(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.planted(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_topk_search": op4_topk_search,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_token_output": op10_token_output,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": chat_format.ORACLE,
    "op4_topk_search": topk_search.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_ngram_join": sql.similar_sets(5, 80),
    "op11_periodic_runs": sql.PERIODIC_RUNS,
    "op12_lexical_search": lexical.ORACLE,
    "op13_minhash_dedup": sql.similar_sets(3, 85, kept=True),
}
