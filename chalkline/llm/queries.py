"""The ``opN_*`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chalkline.llm import bpe, chunk_bpe, exact_dedup, html_text, katz, license_scan, mixing, prefix_trie, simhash, term_scan, topk, toxicity, warc
from chalkline.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def dedup_second_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that the English ones have filled before."""
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, expected=docs.count())
    exact_dedup.exact_dedup(docs.where("lang = 'en'"), index, "english")
    return exact_dedup.exact_dedup(docs, index, "all")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk.search(docs, docs.where("doc_id % 50 = 0"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return chunk_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_warc": op7_warc,
    "op8_license_scan": op8_license_scan,
    "op9_mixing": op9_mixing,
    "op10_exact_topk": op10_exact_topk,
    "op11_lexical_search": op11_lexical_search,
    "op12_chunk_bpe": op12_chunk_bpe,
    "op13_prefix_trie": op13_prefix_trie,
    "dedup_second_batch": dedup_second_batch,
}

ORACLES: dict[str, str] = {
    "op1_html_extraction": html_text.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_warc": warc.SQL,
    "op10_exact_topk": topk.SQL,
    "op11_lexical_search": term_scan.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
    "dedup_second_batch": exact_dedup.SECOND_BATCH_SQL,
}
