"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import alignment, decontamination, jaccard, lpf, quality, resync, sharding, spans, spelling, tokens, topk, toxicity, warc
from lumenlake.llm.common import held_out, read_table

#: The public vocabulary that op6, op11 and the pipeline encode with, and the one that op13 holds it against.
VOCABULARY, OTHER_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return _predicted(toxicity.score_documents(docs, model), toxicity.THRESHOLD)


def op2_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lpf.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_weighted_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def op5_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return _predicted(quality.score_documents(docs, net), quality.THRESHOLD)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_documents(docs, vocabulary_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_bayesian_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select(F.col("doc").alias("doc_id"), "class_id", "class_size", "n_links")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeated(docs).select(
        "doc_id", F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_kept"),
        F.col("text").alias("kept_text"))


def op10_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.array_sort("leaks.item_id").alias("item_ids"),
                        F.coalesce(F.array_max("leaks.coverage"), F.lit(0.0)).alias("coverage"))


def op11_overlap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return resync.count_tokens(docs, vocabulary_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, vocabulary_path(), vocabulary_path(OTHER_VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_automata": op1_toxicity_automata,
    "op2_lpf_dedup": op2_lpf_dedup,
    "op3_warc_capture_index": op3_warc_capture_index,
    "op4_weighted_tree_sharding": op4_weighted_tree_sharding,
    "op5_byte_cnn_quality": op5_byte_cnn_quality,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_segment_topk": op7_segment_topk,
    "op8_bayesian_jaccard": op8_bayesian_jaccard,
    "op9_sentence_spans": op9_sentence_spans,
    "op10_greedy_tiling": op10_greedy_tiling,
    "op11_overlap_token_counts": op11_overlap_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL_BY_QUERY: dict[str, str | None] = {
    "op3_warc_capture_index": warc.ORACLE_SQL,
    "op4_weighted_tree_sharding": sharding.oracle_sql(),
    "op7_segment_topk": topk.oracle_sql(),
    "op12_spelling_variants": spelling.oracle_sql(),
}
