"""The registered queries of this folder: one per operator, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .decontaminate import leaks
from .html_text import extract_pages
from .mixing import mix
from .near_dedup import near_duplicates
from .neighbours import nearest
from .ngram_trie import score_texts
from .packing import pack_tokens
from .passages import repeated_passages
from .prefix_trie import prefix_trie
from .quality import judge
from .secrets import find_secrets, joined
from .sharding import histogram_sort
from .spelling import spelling_variants


def tokenizer() -> dict[str, str]:
    """The public byte-level vocabulary that the queries use, where it is installed."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_token_packing(spark, sf_dir):
    return pack_tokens(table(spark, sf_dir, "documents"), **tokenizer())


def op2_composite_text_density(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_template_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


def op4_histogram_sort(spark, sf_dir):
    return histogram_sort(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_likelihood_ratio(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=None)
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "score")


def op6_elias_fano_trie(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op9_randomness_battery(spark, sf_dir):
    base, added = F.col("base"), F.col("added")

    def n(kind: int):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat(base, added))).alias("spans"))


def op10_sparse_suffix_array(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_balanced_parentheses_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_block_matrix_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_packing, op2_composite_text_density,
                                   op3_template_decontamination, op4_histogram_sort,
                                   op5_ngram_likelihood_ratio, op6_elias_fano_trie,
                                   op7_mixing,
                                   op8_minhash_near_dedup, op9_randomness_battery,
                                   op10_sparse_suffix_array, op11_spelling_variants,
                                   op12_balanced_parentheses_trie, op13_block_matrix_neighbours)}
