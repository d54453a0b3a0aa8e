"""Every operator over nulls, empty and long texts, ties, repeated rows, clashing columns, and over empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import (bpe, jaccard_join, lm_scoring, packing, quality_classifier, quality_rules, toxicity, url_filters,
                          vector_dedup, warc)

PATH = public_tokenizers.path("word_bpe_49k.json")
PER_ROW = {
    "jaccard": lambda d, l: jaccard_join.jaccard_join(d),
    "lm": lambda d, l: lm_scoring.lm_scoring(d),
    "quality": quality_classifier.quality_classifier,
    "bpe": lambda d, l: bpe.digests(d, PATH),
    "bpe_texts": lambda d, l: bpe.encoded(d, PATH),
    "rules": quality_rules.quality_rules,
    "toxicity": toxicity.toxicity,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row(odd_docs, odd_labels, name):
    rows = PER_ROW[name](odd_docs, odd_labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.collect())
    # Repeated rows get equal results.
    assert len({str(r) for r in rows if r.doc_id == 8}) == 1


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(odd_docs, odd_labels, name):
    assert PER_ROW[name](odd_docs.limit(0), odd_labels).collect() == []
    assert PER_ROW[name](odd_docs.limit(0), odd_labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["quality", "rules", "toxicity"])
def test_without_labels(odd_docs, odd_labels, name):
    rows = PER_ROW[name](odd_docs, odd_labels.limit(0)).collect()
    assert len(rows) == odd_docs.count()
    if name == "quality":
        assert {r.score for r in rows} == {0.5}
    if name == "toxicity":
        assert not any(r.toxic for r in rows)


def test_packing_rows(odd_docs):
    pieces = packing.packed(odd_docs, PATH).collect()
    assert {str(p.doc_id) for p in pieces} == {str(r.doc_id) for r in odd_docs.collect()}
    assert [p.length for p in pieces if p.doc_id == 0] == [1]
    assert packing.packed(odd_docs.limit(0), PATH).collect() == []


def test_stages_on_odd_rows(spark, odd_docs, odd_labels, tmp_path):
    folder = str(tmp_path)
    odd_labels.write.parquet(f"{folder}/labels.parquet")
    for empty in (False, True):
        docs = odd_docs.limit(0) if empty else odd_docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == odd_docs.columns
            assert kept.exceptAll(docs).count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= (0 if empty else docs.count())


def test_jaccard_odd_values(odd_docs):
    rows = {r.doc_id: r for r in jaccard_join.jaccard_join(odd_docs).collect()}
    assert rows[0].n_links == rows[1].n_links == rows[2].n_links == 0 and rows[2].class_id == 2
    assert rows[7].class_id == rows[7].copy_id == 6 and rows[6].n_links == 1
    assert rows[8].n_links == 1 and rows[8].kept


def test_jaccard_null_and_repeated_ids(spark, odd_docs):
    """A row without an id stays if nothing resembles it; a near copy with the id of a kept row doesn't come back."""
    assert sum(r.doc_id is None for r in jaccard_join.distinct_documents(odd_docs).collect()) == 1
    words = [f"w{k}" for k in range(80)]
    first, near, other = " ".join(words), " ".join(words[:79] + ["x"]), " ".join(reversed(words))
    rows = [(1, first), (1, near), (None, other), (None, other + " y"), (2, "alone " * 9), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joined = jaccard_join.jaccard_join(docs).collect()
    assert sorted(r.n_links for r in joined) == [0, 0, 0, 1, 1, 1, 1] and sum(r.kept for r in joined) == 5
    left = [(r.doc_id, r.text) for r in jaccard_join.distinct_documents(docs).collect()]
    assert len(left) == 5 and len({first, near} & {t for _, t in left}) == 1
    assert len({other, other + " y"} & {t for _, t in left}) == 1
    clashing = docs.withColumn("_kept_row", F.lit(1)).withColumn("_kept_rows", F.lit("x")).withColumn("row", F.lit(2)).withColumn("high", F.lit(3))
    assert len(jaccard_join.distinct_documents(clashing).collect()) == 5 and jaccard_join.distinct_documents(clashing).columns == clashing.columns


def test_urls_and_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (3, "http://A.com/x", "h" * 2_000_000), (3, "http://A.com/x", "h" * 2_000_000),
                                   (None, "x://", "é"), (4, "http://" + "a." * 5000 + "com/" + "p/" * 5000, "h" * 2_000_000)],
                                  "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("rows", F.lit("x"))
    rules = spark.sql("SELECT * FROM VALUES ('com', '/', 'block') AS r(host, path, verdict)")
    rows = url_filters.url_filters(pages, rules).collect()
    assert len(rows) == 6 and sum(r.verdict == "block" for r in rows) == 3
    assert url_filters.url_filters(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filters.url_filters(pages, rules.limit(0), default="block").collect()} == {"block"}
    back = warc.archived(pages).collect()
    assert sorted(str(r.page_id) for r in back) == ["1", "2", "3", "3", "4", "None"]
    assert {r.page_id: (r.record_type, r.refers_to) for r in back}[3] == ("revisit", 4)
    assert warc.archived(pages.limit(0)).collect() == []


def test_text_ids_of_records(spark):
    """Ids with line ends, brackets and signs come back as they are; the empty id is not null."""
    ids = ["a\r\nX: 1", "", None, "é>%20", "<urn:page:1>", "same", "same"]
    pages = spark.createDataFrame([(i, "http://a", "h" * (2000 if k > 2 else 5)) for k, i in enumerate(ids)], "page_id string, url string, html string")
    back = warc.archived(pages).collect()
    assert sorted(map(str, (r.page_id for r in back))) == sorted(map(str, ids)) and sum(r.page_id is None for r in back) == 1
    assert {r.refers_to for r in back if r.record_type == "revisit"} == {max(i for i in ids[3:])}
    assert warc.qualified(spark, "/tmp/x").startswith("file:/")


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]),
            (9, [1.0]), (10, [1e-30, 1e-31]), (10, [1e-30, 1e-31]), (None, [0.0, -1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("x")).withColumn("copies", F.lit(1))
    out = vector_dedup.vector_dedup(vectors).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: r for r in out}
    assert [got[k].n_links for k in (1, 2, 9, 10)] == [4, 4, 4, 4] and got[10].component_id == 1
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (3, 4, 5, 6, 7, 8))
    assert vector_dedup.vector_dedup(vectors.limit(0)).collect() == []
    none = vectors.where("vec_id in (3, 5)")
    assert [r.n_links for r in vector_dedup.vector_dedup(none).collect()] == [0, 0]
