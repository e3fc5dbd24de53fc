"""The training-corpus pipeline: quality rules, near-dedup, repeat removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from ctxloom.llm.common import mark, materialize, release, release_since, table
from ctxloom.llm.minhash import drop_near_duplicates
from ctxloom.llm.mixing import mix_documents
from ctxloom.llm.packing import pack
from ctxloom.llm.quality_rules import keep_good
from ctxloom.llm.suffix_dedup import remove_repeats


def quality_rules(spark, docs, sf_dir):
    """Rejected documents go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


def repeat_removal(spark, docs, sf_dir):
    """Passages of 240 bytes or more that stand in several places go, wherever they stand."""
    return remove_repeats(docs)


def source_mixing(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def packing(spark, docs, sf_dir):
    """Length buckets and token-budget batches."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Hashing, signatures and random draws are not SQL that another engine repeats.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents. What a stage wrote on its way goes once its result is on disk, and that once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        point = mark()
        kept = materialize(stage(spark, docs, sf_dir), name)
        release_since(point, kept)
        if i:
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
