"""The queries of this subpackage: one opN_ per operator, and the pipeline."""

from __future__ import annotations

from . import exact_search, fingerprints, lexical_search, minhash, sharding, spelling
from .common import table
from .importance import resample
from .language_id import identify
from .mixing import mix
from .packing import pack
from .quality_rules import judge
from .suffix_dedup import removal_report
from .toxicity import score_toxicity


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_importance(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return removal_report(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_spelling(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexical_search.search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_search(spark, sf_dir):
    return exact_search.top_inner_products(table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_minhash,
    op2_mixing,
    op3_importance,
    op4_toxicity,
    op5_packing,
    op6_suffix_dedup,
    op7_fingerprints,
    op8_quality_rules,
    op9_language_id,
    op10_sharding,
    op11_spelling,
    op12_lexical_search,
    op13_exact_search,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {
        "op1_minhash": minhash.sql(3, 85),
        "op7_fingerprints": fingerprints.SQL,
        "op10_sharding": sharding.SQL,
        "op11_spelling": spelling.SQL,
        "op12_lexical_search": lexical_search.SQL,
        "op13_exact_search": exact_search.SQL,
    }
