"""What plans read: how often, and which tables."""

import re

import pytest

from ravelin.operators import indexer, retrieval
from ravelin.operators.parsing import parse_queries
from ravelin.operators.skew import top_records
from ravelin.schemas import PAGES_IN
from ravelin.sources.store import add, load, parts, save

W = "https://en.wikipedia.org/wiki/"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    rows = [(i, W + str(i % 900), "t", f"river town {i} the old bridge" if i % 9 else None) for i in range(1000)]
    spark.createDataFrame(rows, PAGES_IN).write.parquet(str(folder / "pages"))
    pages = spark.read.schema(PAGES_IN).parquet(str(folder / "pages"))
    save(indexer.build_index(pages), str(folder / "index"))
    return pages, load(spark, str(folder / "index"))


def test_outcomes_read_the_pages_once(stored):
    pages, _ = stored
    text = plan(indexer.outcome_ids(pages))
    assert len(re.findall("FileScan parquet", text)) <= 4
    assert not re.search(r"(?<!_)body", text.replace("err_body", ""))  # what the bodies tell has been written


def test_ranking_reads_postings_and_totals_only(stored):
    _, index = stored
    text = plan(retrieval.bm25_scores(index, ["river", "town"]))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert scans
    assert not any("body" in s or "length" in s for s in scans)
    assert "In(term" in text


def test_batch_places_postings_by_document_only(spark, stored):
    _, index = stored
    parsed = parse_queries(spark.createDataFrame([(1, "river town"), (2, "old bridge")], "qid long, raw string"))
    text = plan(retrieval.batch_scores(index, parsed))
    assert "SortMergeJoin" not in text
    keys = set(re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", text))
    assert keys <= {"doc_id", "term"}
    assert not re.search(r"Exchange hashpartitioning\(qid", text)


def test_blocks_of_queries(spark, stored, monkeypatch):
    _, index = stored
    parsed = parse_queries(spark.createDataFrame([(i, f"river {i} bridge") for i in range(30)], "qid long, raw string"))
    whole = sorted(map(tuple, retrieval.batch_search(index, parsed, 5).collect()))
    monkeypatch.setattr(retrieval, "QUERIES_PER_BLOCK", 7)
    assert sorted(map(tuple, retrieval.batch_search(index, parsed, 5).collect())) == whole


def test_pairs_of_query_and_document_are_no_rows(spark, stored):
    _, index = stored
    parsed = parse_queries(spark.createDataFrame([(i, f"river {i} bridge") for i in range(30)], "qid long, raw string"))
    best = retrieval.batch_search(index, parsed, 5)
    assert best.count() == 150
    text = plan(best)
    assert not re.search(r"keys=\[qid#\d+L?, doc_id", text)
    assert "MapInArrow" in text


@pytest.mark.parametrize("k", [0, 1, 4, 1000])
def test_best_of_a_batch_are_those_of_all_scores(spark, k):
    def text(i):
        return " ".join([*["the"] * (i % 5 + 1), *["river"] * (i % 3), *["bridge"] * (i % 7 == 0), *["old"] * (i % 11 % 4), *["town"] * (i % 13), f"w{i % 40}"])

    index = indexer.build_index(spark.createDataFrame([(i, W + str(i), "t", text(i)) for i in range(300)], PAGES_IN))
    asked = ["the", "the river", "bridge the", "old bridge of the river town", "w3", "w3 the w4 zzz", "zzz", "", "town old", "the the", *[f"w{i} the river" for i in range(25)]]
    parsed = parse_queries(spark.createDataFrame([*enumerate(asked), (None, "river")], "qid long, raw string"))
    order = lambda r: (r.qid is None, r.qid, r["rank"])
    pairs = top_records(retrieval.batch_scores(index, parsed), "qid", "doc_id", "score", k).select("qid", "rank", "doc_id", "score")
    got = sorted(retrieval.batch_search(index, parsed, k).collect(), key=order)
    assert got == sorted(pairs.collect(), key=order)
    assert bool(got) == bool(k)


def test_words_are_counted_where_texts_are_placed(spark, stored, tmp_path):
    pages, _ = stored
    built = indexer.build_index(pages.repartition("ord"))
    assert "hashpartitioning(term" not in plan(built.terms)
    save(built, str(tmp_path / "index"))
    assert sorted(p.name for p in (tmp_path / "index" / "v=1").iterdir()) == ["documents", "stats", "terms"]
    index = load(spark, str(tmp_path / "index"))
    for name in ("terms", "stats"):
        rows = [sorted(map(tuple, getattr(x, name).collect())) for x in (index, built)]
        assert rows[0] == rows[1]
    assert index.documents.drop("created_at").exceptAll(built.documents.drop("created_at")).count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_scores_of_batch_and_single_query_agree(spark, stored):
    _, index = stored
    parsed = parse_queries(spark.createDataFrame([(1, "river town 7 bridge")], "qid long, raw string"))
    batch = {r.doc_id: r.score for r in retrieval.batch_scores(index, parsed).collect()}
    single = {r.doc_id: r.score for r in retrieval.bm25_scores(index, ["river", "town", "7", "bridge"]).collect()}
    assert batch.keys() == single.keys()
    assert all(abs(batch[d] - single[d]) < 1e-11 for d in single)


def test_sparse_order_has_few_blocks(spark):
    rows = spark.createDataFrame([(i * 10**13 - 5 * 10**14,) for i in range(100)], "x long")
    got = sorted((r.x, r.id) for r in indexer.dense_ids(rows, "x", "id").collect())
    assert [i for _, i in got] == list(range(1, 101))
    assert indexer.dense_ids(rows.limit(0), "x", "id").count() == 0


def test_parts_and_old_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    page = lambda i: spark.createDataFrame([(1, W + str(i), "t", f"word{i} common")], PAGES_IN)
    save(indexer.build_index(page(0)), path)
    for i in (1, 2, 3):
        add(indexer.new_part(load(spark, path), page(i)), path)
    index = load(spark, path)
    assert parts(spark, path) == [1, 2, 3, 4]
    assert index.stats.first().asDict() == {"id": 1, "total_docs": 4, "total_doc_len": 8, "next_doc_id": 5}
    assert sorted(map(tuple, index.terms.filter("term = 'common'").collect())) == [("common", d, 1) for d in (1, 2, 3, 4)]
    save(index, path)  # whole again: parts stay as long as the pointer before names them
    save(load(spark, path), path)
    assert sorted(p.name for p in (tmp_path / "index").glob("v=*")) == ["v=5", "v=6"]
    assert load(spark, path).documents.count() == 4
