"""A corpus from raw documents to packed sequences, stage by stage; each stage is written and read again."""

import public_tokenizers

from leadloom.llm import jaccard_join, packing, quality_rules, toxicity
from leadloom.llm.tables import read, small_batches
from leadloom.session import stored

#: The stages are learned models and tokenizer ids, which SQL cannot express; tests/llm holds brute-force versions.
ORACLE_SQL = None


def mild(spark, docs, sf_dir):
    """Documents without toxic ones."""
    small_batches(spark)
    return toxicity.mild_documents(docs, read(spark, sf_dir, "labels"))


def good(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.good_documents(docs, read(spark, sf_dir, "labels"))


def different(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    small_batches(spark)
    return jaccard_join.distinct_documents(docs)


def sequences(spark, docs, sf_dir):
    """Pieces of documents in windows of 2048 ids."""
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", mild), ("quality_rules", good), ("ngram_jaccard_join", different), ("packing", sequences)]


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
