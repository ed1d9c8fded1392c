"""Saved indexes, streams of pages and the command line."""

import pytest

from ravelin import cli
from ravelin.operators.indexer import build_index
from ravelin.schemas import PAGES_IN, WEB
from ravelin.sources.store import EmptyIndex, current_version, load, save
from ravelin.streaming.ingest import landing_stream, live_outcomes, start_ingest

W = "https://en.wikipedia.org/wiki/"


def pages(spark, *rows):
    return spark.createDataFrame([(i, W + n, n, b) for i, (n, b) in enumerate(rows)], PAGES_IN)


def content(index):
    return sorted(map(tuple, index.terms.collect())), sorted((r.doc_id, r.url, r.length) for r in index.documents.collect()), index.stats.first()


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "index")
    assert load(spark, path) is None
    index = build_index(pages(spark, ("A", "one two two"), ("B", "two")))
    assert save(index, path) == 1
    first = content(load(spark, path))
    assert first[0] == [("one", 1, 1), ("two", 1, 2), ("two", 2, 1)]
    assert save(load(spark, path), path) == 2  # over what it is read from
    assert content(load(spark, path)) == first
    plan = load(spark, path).terms.filter("term = 'two'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,two)" in plan


def test_empty_index_is_not_saved_over(spark, tmp_path):
    path = str(tmp_path / "index")
    save(build_index(pages(spark, ("A", "one"))), path)
    with pytest.raises(EmptyIndex):
        save(build_index(pages(spark)), path)
    assert current_version(spark, path) == 1
    save(build_index(pages(spark)), path, replace_with_empty=True)
    assert load(spark, path) is None
    with pytest.raises(ValueError, match="folder"):
        save(build_index(pages(spark)), "")


def test_stream(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "index")

    def run():
        query = start_ingest(landing_stream(spark, landing), path, str(tmp_path / "cp"))
        query.awaitTermination(120)
        query.stop()

    pages(spark, ("A", "one"), ("A", "again"), ("", "no title")).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert load(spark, path).stats.first().total_docs == 2
    pages(spark, ("A", "one"), ("B", "two")).coalesce(1).write.mode("append").parquet(landing)
    run()
    version = current_version(spark, path)
    assert [(r.doc_id, r.url) for r in load(spark, path).documents.orderBy("doc_id").collect()] == [(1, W + "A"), (2, W), (3, W + "B")]
    pages(spark, ("B", "two")).coalesce(1).write.mode("append").parquet(landing)
    run()
    assert current_version(spark, path) == version  # nothing new


def test_live_counts_of_a_batch(spark):
    rows = spark.sql("SELECT timestamp'2025-01-01 00:01:00' AS arrived_at, '' AS url, 'x' AS body UNION ALL SELECT timestamp'2025-01-01 00:02:00', 'u', ' '")
    assert sorted((r.kind, r.pages) for r in live_outcomes(rows).collect()) == [("err_body", 1), ("err_url", 1)]


def test_command_line(spark, tmp_path, capsys):
    html = "<title>{}</title><p>{} is a word in a paragraph of enough characters.</p><a href='/wiki/{}'>x</a>"
    web = [(W + a, 200, "text/html", html.format(a, a, b)) for a, b in (("S", "T"), ("T", "S"), ("Zebra", "S"))]
    spark.createDataFrame(web, WEB).write.parquet(str(tmp_path / "web"))
    common = ["--index", str(tmp_path / "index"), "--web", str(tmp_path / "web")]
    assert cli.main([*common, "--seed", W + "S", "-q", "t word"]) == 0
    out = capsys.readouterr().out
    assert "Top 2 results" in out
    assert out.index("1) T") < out.index("2) S")
    seeds = lambda url: (200, f'["q", [], [], ["{W}Zebra"]]')
    assert cli.main([*common, "-q", "zebra"], get=seeds) == 0  # nothing found: crawled again from the query's page
    assert "1) Zebra" in capsys.readouterr().out
    assert cli.main([*common, "-q", "?!"]) == 1
    assert "EmptyQuery" in capsys.readouterr().err
    assert cli.main([*common, "-q", "x", "-k", "0"]) == 1
    assert cli.main(["--index", str(tmp_path / "none"), "-q", "x", "--seed", W + "S"]) == 1
