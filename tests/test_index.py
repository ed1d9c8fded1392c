"""A hand-made corpus: outcomes, ids, statistics and ranked answers; and what must hold for any corpus."""

import pytest
from pyspark.sql import functions as F

from ravelin.app import SearchApp, search, search_with_fallback
from ravelin.operators.indexer import IndexTables, append, build_index, corpus_totals, dense_ids, document_frequencies, index_counts, outcome_ids
from ravelin.operators.parsing import EmptyQuery, EngineInit, InvalidTopK, parse_queries
from ravelin.operators.retrieval import batch_search, bm25_scores, candidates, document, document_frequency, document_length, enrich, term_frequency
from ravelin.schemas import PAGES_IN

W = "https://en.wikipedia.org/wiki/"
PAGES = [
    (1, W + "A", "Alpha", "Running dogs run. The dog stopped."),
    (2, W + "B", "Beta", "The cat played; cats were playing, and the dog slept."),
    (3, W + "C", "Gamma", "Cities and series of books: the book of running."),
    (4, f" {W}A ", "Dup", "ignored duplicate body"),
    (5, "", "NoUrl", "x"),
    (6, W + "D", "Empty", "   "),
    (7, W + "E", "Punct", "?!..."),
    (8, W + "E", "Later", "The dog returns later."),
]
OUTCOMES = {1: (1, "added"), 2: (2, "added"), 3: (3, "added"), 4: (1, "duplicate"), 5: (None, "err_url"), 6: (None, "err_body"), 7: (None, "err_tokens"), 8: (4, "added")}
ANSWERS = {
    "the dog": [(4, 0.565794), (1, 0.497097), (2, 0.439669), (3, 0.095892)],
    "running": [(1, 1.001649), (3, 0.630853)],
    "playing cats": [(2, 2.538126)],
    "books": [(3, 1.550221)],
    "Dogs dogs RUN": [(1, 2.296985), (3, 0.630853)],
    "zebra": [],
    "Alpha": [],
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, PAGES_IN)


@pytest.fixture(scope="module")
def index(pages):
    built = build_index(pages)
    return IndexTables(built.documents.cache(), built.terms.cache(), built.stats.cache())


def test_outcomes(pages):
    assert {r.ord: (r.doc_id, r.status) for r in outcome_ids(pages.repartition(5)).collect()} == OUTCOMES
    assert {r.status: r.pages for r in index_counts(outcome_ids(pages)).collect()} == {"added": 4, "duplicate": 1, "err_url": 1, "err_body": 1, "err_tokens": 1}


def test_statistics(index):
    assert index.stats.first().asDict() == {"id": 1, "total_docs": 4, "total_doc_len": 29, "next_doc_id": 5}
    assert corpus_totals(index.documents).first().avg_doc_len == 7.25
    assert document_frequencies(index.terms).count() == 17
    assert index.terms.count() == 24
    lengths = {r.doc_id: r.length for r in index.documents.collect()}
    assert lengths == {1: 6, 2: 10, 3: 9, 4: 4}
    assert {r.doc_id: r.n for r in index.terms.groupBy("doc_id").agg(F.sum("freq").alias("n")).collect()} == lengths


@pytest.mark.parametrize("query", ANSWERS)
def test_answers(index, query):
    got = [(r.doc_id, round(r.score, 6)) for r in search(index, query, 10).collect()]
    assert got == ANSWERS[query]
    assert [r.doc_id for r in search(index, query, 2).collect()] == [d for d, _ in ANSWERS[query]][:2]


def test_batch_agrees_with_single(spark, index):
    asked = list(ANSWERS)
    parsed = parse_queries(spark.createDataFrame(list(enumerate(asked)), "qid long, raw string"))
    got = {}
    for r in sorted(batch_search(index, parsed, 10).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(asked[r.qid], []).append((r.doc_id, round(r.score, 6)))
    assert got == {q: a for q, a in ANSWERS.items() if a}


def test_requests(index):
    app = SearchApp(index)
    view = app.run("the dog", 2).collect()
    assert [(r["rank"], r.doc_id, r.title, r.url) for r in view] == [(1, 4, "Later", W + "E"), (2, 1, "Alpha", W + "A")]
    assert view[1].snippet == "Running dogs run. The dog stopped."
    for query, k, error in (("", 1, EmptyQuery), (" ", 0, EmptyQuery), ("?!", 1, EmptyQuery), ("x", 0, InvalidTopK), ("x", -1, InvalidTopK)):
        with pytest.raises(error):
            app.run(query, k)
    with pytest.raises(EngineInit):
        SearchApp(None).run("x", 1)
    with pytest.raises(EngineInit):
        search(None, "x", 1)


def test_hits_without_document_are_left_out(spark, index):
    best = spark.createDataFrame([(1, 2.0), (77, 3.0)], "doc_id long, score double")
    assert [r.doc_id for r in enrich(best, index.documents).collect()] == [1]


def test_fallback(spark, index):
    rows, used = search_with_fallback(index, "zebra", 5, lambda q: build_index(spark.createDataFrame([(1, W + "Z", "Z", f"a {q} here")], PAGES_IN)))
    assert [r.title for r in rows] == ["Z"]
    assert used is not index
    rows, used = search_with_fallback(index, "dog", 5, lambda q: pytest.fail("not needed"))
    assert used is index


def test_lookups(index):
    assert document_frequency(index.terms, " dog ").first().df == 3
    assert document_frequency(index.terms, "dogs").first().df == 1
    assert document_frequency(index.terms, "none").first().df == 0
    assert term_frequency(index.terms, "run", 1).first().freq == 2
    assert term_frequency(index.terms, "run", 9).first().freq == 0
    assert document_length(index.documents, 3).first().length == 9
    assert document_length(index.documents, 0).first().length == 0
    assert document(index.documents, 2).first().title == "Beta"
    assert document(index.documents, -2).count() == 0
    assert sorted(r.doc_id for r in candidates(index.terms, ["run", "cat", "none"]).collect()) == [1, 2, 3]
    assert bm25_scores(index, []).count() == 0


def test_append(spark, index):
    more = spark.createDataFrame([(1, W + "A", "A again", "dog"), (2, W + "F", "New", "zebra dog"), (3, W + "F", "New", "zebra")], PAGES_IN)
    grown = append(index, more)
    assert grown.stats.first().asDict() == {"id": 1, "total_docs": 5, "total_doc_len": 31, "next_doc_id": 6}
    assert [(r.doc_id, r.title) for r in grown.documents.filter("doc_id > 4").collect()] == [(5, "New")]


def test_empty_and_null_pages(spark):
    nothing = spark.createDataFrame([], PAGES_IN)
    assert build_index(nothing).stats.first().asDict() == {"id": 1, "total_docs": 0, "total_doc_len": 0, "next_doc_id": 1}
    assert search(build_index(nothing), "x", 3).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None), (2, W, None, None), (3, W, None, "word")], PAGES_IN)
    assert {r.ord: r.status for r in outcome_ids(nulls).collect()} == {1: "err_url", 2: "err_body", 3: "added"}


def test_hot_url_and_dense_ids(spark):
    rows = [(i * 50_000, W + ("hot" if i % 3 else str(i)), "t", f"body {i}") for i in range(300)]
    got = sorted((r.ord, r.doc_id) for r in outcome_ids(spark.createDataFrame(rows, PAGES_IN).repartition(7)).filter("status = 'added'").collect())
    want = [o for o, u, _, _ in rows if not u.endswith("hot")] + [50_000]
    assert got == [(o, i + 1) for i, o in enumerate(sorted(want))]
    ids = dense_ids(spark.createDataFrame([(-5,), (3,), (10**12,)], "x long"), "x", "id", 7)
    assert sorted((r.x, r.id) for r in ids.collect()) == [(-5, 7), (3, 8), (10**12, 9)]
