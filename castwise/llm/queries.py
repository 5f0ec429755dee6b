"""The registered queries opN_<name> of the operators, thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .boosted_trees import quality_scores
from .common import table
from .imatch import imatch
from .importance import IMPORTANCE_SQL, importance_scores
from .licenses import license_scan
from .line_dedup import LINE_DEDUP_SQL, line_dedup
from .packing import pack
from .pieces import sentencepiece_round_trip
from .pii import pii_spans
from .prefix_trie import TRIE_SQL, prefix_trie, rebuilt
from .simhash import simhash_components
from .substrings import SUBSTRING_SQL, substring_dedup
from .token_files import token_files
from .topk import TOP_K_SQL, top_k


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=5)
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_removed").cast("long").alias("n_removed"), "text")


def op2_imatch(spark, sf_dir):
    return imatch(table(spark, sf_dir, "documents"), low=0.002, high=0.05)


def op3_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"), radius=3)


def op4_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"), coverage=0.8)


def op5_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op6_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=0.7, sample=20_000)


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, length=2048)


def op8_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), k=20, query_every=20, factor=64)


def op9_sentencepiece(spark, sf_dir):
    return sentencepiece_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_pii(spark, sf_dir):
    return pii_spans(table(spark, sf_dir, "documents"))


def op11_importance(spark, sf_dir):
    out = importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_n=1, buckets=10_000, min_words=20, percent=10, seed="2024")
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_substrings(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"), words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations"), block=100, heads=6))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_imatch, op3_simhash, op4_license_scan, op5_token_files, op6_quality, op7_packing, op8_top_k, op9_sentencepiece, op10_pii, op11_importance, op12_substrings, op13_prefix_trie)}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP_SQL, "op8_top_k": TOP_K_SQL, "op11_importance": IMPORTANCE_SQL, "op12_substrings": SUBSTRING_SQL, "op13_prefix_trie": TRIE_SQL}
