"""The queries opN of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from fathomline.llm import bpe, fp_tree, kneser_ney, matroska, mixing, permutation_index, prefix_trie, secret_scan, simhash, suffix_dedup, token_counts, toxicity, wrappers
from fathomline.llm.common import table


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies; the library is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_permutation_index": lambda spark, d: permutation_index.neighbours(table(spark, d, "embeddings")),
    "op2_matroska": lambda spark, d: matroska.digests(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity.judged(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_simhash": lambda spark, d: simhash.classes(table(spark, d, "documents")),
    "op5_kneser_ney": lambda spark, d: kneser_ney.quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_suffix_dedup": lambda spark, d: suffix_dedup.digests(table(spark, d, "documents")),
    "op7_token_counts": lambda spark, d: token_counts.report(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k.tiktoken")),
    "op8_mixing": lambda spark, d: mixing.plan(table(spark, d, "documents")),
    "op9_bpe": lambda spark, d: bpe.digests(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k.json")),
    "op10_wrappers": lambda spark, d: wrappers.articles(table(spark, d, "pages")),
    "op11_secret_scan": lambda spark, d: secret_scan.digests(table(spark, d, "documents")),
    "op12_prefix_trie": lambda spark, d: prefix_trie.nodes_of(table(spark, d, "conversations")),
    "op13_fp_tree": lambda spark, d: fp_tree.ranked(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLE: dict[str, str] = {"op8_mixing": mixing.ORACLE, "op11_secret_scan": secret_scan.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_fp_tree": fp_tree.ORACLE}
