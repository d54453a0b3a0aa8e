"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

import public_tokenizers

from leadloom.llm import (bpe, filter_audit, html_extraction, jaccard_join, lm_scoring, packing, prefix_trie, quality_classifier, quality_rules, sql, toxicity, url_filters,
                          vector_dedup, warc)
from leadloom.llm.tables import read

TOKENIZER = "word_bpe_49k.json"


#: Rules of op1 as (host, path, verdict).
RULES = """VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, verdict)"""


def op1_url_filters(spark, sf_dir):
    return url_filters.url_filters(read(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {RULES}"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scoring(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_bpe_encoding(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_packing(spark, sf_dir):
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_embedding_near_dedup(spark, sf_dir):
    return vector_dedup.vector_dedup(read(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_warc(spark, sf_dir):
    return warc.archived(read(spark, sf_dir, "pages"))


def op11_filter_interaction_audit(spark, sf_dir):
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_html_extraction(spark, sf_dir):
    return html_extraction.html_extraction(read(spark, sf_dir, "pages"))


def op13_conversation_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_ngram_jaccard_join, op3_lm_scoring, op4_quality_classifier, op5_bpe_encoding, op6_packing,
    op7_embedding_near_dedup, op8_quality_rules, op9_toxicity, op10_warc, op11_filter_interaction_audit,
    op12_html_extraction, op13_conversation_prefix_trie)}
#: The others are learned models, tokenizer ids and packing, which SQL cannot express; tests/llm holds brute-force versions.
SQL = {"op1_url_filters": sql.OP1, "op2_ngram_jaccard_join": sql.OP2, "op7_embedding_near_dedup": sql.OP7,
       "op10_warc": sql.OP10, "op11_filter_interaction_audit": sql.OP11,
       "op12_html_extraction": sql.OP12, "op13_conversation_prefix_trie": sql.OP13}
