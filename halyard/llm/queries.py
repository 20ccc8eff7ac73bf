"""The registered queries of the training-data operators: thin callables over (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm.oracles import ORACLES
from halyard.llm.shared import table

__all__ = ["ORACLES", "QUERIES", "tokenizer_path"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.suffix_dedup import repeat_digest

    return repeat_digest(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.simhash import fingerprint_digest

    return fingerprint_digest(table(spark, sf_dir, "documents"))


def op5_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.toxicity import judge_toxicity

    return judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.warc import archive_digest

    return archive_digest(table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.pieces import piece_digest

    return piece_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.token_file import token_digest

    return token_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.whitening import whitening_digest

    return whitening_digest(table(spark, sf_dir, "embeddings"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_source_mix": op2_source_mix,
    "op3_repeated_strings": op3_repeated_strings,
    "op4_fingerprints": op4_fingerprints,
    "op5_embedding_links": op5_embedding_links,
    "op6_toxicity": op6_toxicity,
    "op7_archives": op7_archives,
    "op8_pieces": op8_pieces,
    "op9_url_filter": op9_url_filter,
    "op10_token_ids": op10_token_ids,
    "op11_whitened": op11_whitened,
    "op12_lines": op12_lines,
    "op13_filter_audit": op13_filter_audit,
}
