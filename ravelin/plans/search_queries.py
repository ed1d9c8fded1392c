"""Queries over the index, the crawl and the output functions, and their SQL. Documents arrive in the order of ``doc_id``."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.app import search
from ravelin.functions.formatting import snippet, truncate_lines, wrap_text
from ravelin.functions.ranking import idf, tf_norm
from ravelin.functions.text import normalize_text, stem, words
from ravelin.functions.urls import LinkPolicy, canonical_link, is_article
from ravelin.operators import crawl as crawling
from ravelin.operators import indexer, retrieval
from ravelin.operators.parsing import parse_queries
from ravelin.session import cut_lineage, ensure_checkpoint_dir
from ravelin.sources.html import extract
from ravelin.sources.store import load, save

#: The flagship query, and limits of the crawl over the made-up web.
FLAGSHIP = "the southern river of the old kingdom"
CRAWL_PAGES, CRAWL_BYTES, CRAWL_DEPTH, FAN_OUT = 50, 40_000, 3, 5
WIKI = LinkPolicy()
LEXIPEDIA = LinkPolicy("en.lexipedia.example")
WRAP, LINES = 60, 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as pages in order of arrival; spread out first, as one file may be one row group."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "url", "title", "body")
    return docs.repartition("ord")


def the_index(spark: SparkSession, sf_dir: str) -> indexer.IndexTables:
    return indexer.build_index(pages_in(spark, sf_dir))


def saved_index(spark: SparkSession, sf_dir: str) -> indexer.IndexTables:
    """The index as it is searched: built and saved by the first query of a session that needs it, then loaded."""
    name = hashlib.sha1(os.fsencode(sf_dir)).hexdigest()[:12]
    folder = f"{ensure_checkpoint_dir(spark)}/ravelin-saved-{spark.sparkContext.applicationId}-{name}"
    index = load(spark, folder)
    if index is None:
        save(the_index(spark, sf_dir), folder)
        index = load(spark, folder)
    return index or the_index(spark, sf_dir)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "body").repartition("doc_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = saved_index(spark, sf_dir)
    return retrieval.enrich(search(index, FLAGSHIP, 10), index.documents).withColumn("score", F.round("score", 6))


def normalized(spark, sf_dir):
    return _bodies(spark, sf_dir).select("doc_id", normalize_text(F.col("body")).alias("norm"))


def tokenized(spark, sf_dir):
    rows = _bodies(spark, sf_dir).select("doc_id", normalize_text(F.col("body")).alias("norm"))
    return indexer.exploded_tokens(rows, "doc_id")


def stem_vocab(spark, sf_dir):
    vocabulary = _bodies(spark, sf_dir).select(F.explode(words(F.col("body"))).alias("word")).distinct()
    return vocabulary.select("word", stem(F.col("word")).alias("stem"))


def term_freq(spark, sf_dir):
    return the_index(spark, sf_dir).terms


def doc_freq(spark, sf_dir):
    return indexer.document_frequencies(the_index(spark, sf_dir).terms)


def doc_length(spark, sf_dir):
    return the_index(spark, sf_dir).documents.select("doc_id", "length")


def corpus_stats(spark, sf_dir):
    return indexer.corpus_totals(the_index(spark, sf_dir).documents)


def index_stats(spark, sf_dir):
    return the_index(spark, sf_dir).stats


def index_outcomes(spark, sf_dir):
    return indexer.outcome_ids(pages_in(spark, sf_dir))


def index_counts(spark, sf_dir):
    return indexer.index_counts(indexer.outcomes(pages_in(spark, sf_dir)))


def logged_outcomes(spark, sf_dir):
    return indexer.index_counts(_table(spark, sf_dir, "index_outcome"))


def url_dedup(spark, sf_dir):
    index = the_index(spark, sf_dir)
    return index.documents.select("doc_id", "url", "title")


def index_append(spark, sf_dir):
    """Documents of odd ids indexed first, the even ones appended."""
    pages = pages_in(spark, sf_dir)
    first = indexer.build_index(pages.filter("ord % 2 = 1"))
    return indexer.append(first, pages.filter("ord % 2 = 0")).documents.select("doc_id", "url", "length")


def postings_lookup(spark, sf_dir):
    return retrieval.postings(saved_index(spark, sf_dir).terms, " river ")


def index_lookups(spark, sf_dir):
    index = saved_index(spark, sf_dir)
    found = [
        retrieval.document_frequency(index.terms, "river").select(F.lit("df river").alias("what"), F.col("df").alias("value")),
        retrieval.document_frequency(index.terms, "zzzz").select(F.lit("df zzzz").alias("what"), F.col("df").alias("value")),
        retrieval.term_frequency(index.terms, "the", 2).select(F.lit("tf the 2").alias("what"), F.col("freq").alias("value")),
        retrieval.document_length(index.documents, 2).select(F.lit("length 2").alias("what"), F.col("length").alias("value")),
        retrieval.document_length(index.documents, -1).select(F.lit("length -1").alias("what"), F.col("length").alias("value")),
        retrieval.document(index.documents, 2).agg(F.count(F.lit(1)).alias("value")).select(F.lit("document 2").alias("what"), "value"),
    ]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def candidates_or(spark, sf_dir):
    return retrieval.candidates(saved_index(spark, sf_dir).terms, ["river", "kingdom", "zzzz"])


def idf_values(spark, sf_dir):
    index = saved_index(spark, sf_dir)
    df = indexer.document_frequencies(index.terms)
    totals = F.broadcast(index.stats.select("total_docs"))
    return df.join(totals).select("term", F.round(idf(F.col("df"), F.col("total_docs")), 6).alias("idf"))


def tf_norm_values(spark, sf_dir):
    index = saved_index(spark, sf_dir)
    rows = index.postings().join(F.broadcast(index.totals()))
    return rows.select("term", "doc_id", F.round(tf_norm(F.col("freq"), F.col("dl"), F.col("avg_doc_len")), 6).alias("tf_norm"))


def bm25_scores(spark, sf_dir):
    scores = retrieval.bm25_scores(saved_index(spark, sf_dir), ["river", "the", "kingdom", "castle"])
    return scores.select("doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf_dir):
    best = search(saved_index(spark, sf_dir), "castle of the northern kingdoms", 25)
    return best.select("doc_id", F.round("score", 6).alias("score"))


def parsed_queries(spark, sf_dir):
    parsed = parse_queries(_table(spark, sf_dir, "search_query"))
    return parsed.select("qid", "status", F.array_join("terms", " ").alias("terms"))


def batch_search(spark, sf_dir):
    parsed = parse_queries(_table(spark, sf_dir, "search_query"))
    best = retrieval.batch_search(saved_index(spark, sf_dir), parsed, 10)
    return best.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def snippets(spark, sf_dir):
    return _bodies(spark, sf_dir).select("doc_id", snippet(F.col("body")).alias("snippet"))


def wrapped(spark, sf_dir):
    text = wrap_text(snippet(F.col("body")), WRAP)
    return _bodies(spark, sf_dir).select("doc_id", text.alias("wrapped"), truncate_lines(text, LINES).alias("cut"))


def index_roundtrip(spark, sf_dir):
    """The index saved, saved again over itself and loaded."""
    folder = f"{ensure_checkpoint_dir(spark)}/ravelin-index-{hashlib.sha1(os.fsencode(sf_dir)).hexdigest()[:12]}"
    save(the_index(spark, sf_dir), folder)
    save(load(spark, folder), folder)
    return load(spark, folder).terms


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up web: each document as an article with noise around it, linked to the ``FAN_OUT`` pages below it."""

    def escaped(column):
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            column = F.replace(column, F.lit(raw), F.lit(safe))
        return column

    docs = _table(spark, sf_dir, "documents").select("doc_id", "title", "body").repartition("doc_id")
    url = F.concat(F.lit(f"{WIKI.root}P"), F.col("doc_id").cast("string"))
    paragraphs = F.transform(F.split(F.coalesce("body", F.lit("")), "\n\n"), lambda p: F.concat(F.lit("<p>"), escaped(p)))
    below = F.sequence(F.col("doc_id") * FAN_OUT - (FAN_OUT - 2), F.col("doc_id") * FAN_OUT + 1)
    links = F.transform(below, lambda n: F.concat(F.lit('<a href="/wiki/P'), n.cast("string"), F.lit('?x=1#top">next</a>')))
    html = F.concat(
        F.lit("<html><head><title> "), escaped(F.coalesce("title", F.lit(""))), F.lit("\n </title><script>var t='</p>';</script></head><body>"),
        F.lit('<div id="mw-content-text"><div class="mw-parser-output"><table class="infobox"><tr><td><p>Not part of the article, however long it is.</table>'),
        F.array_join(paragraphs, "</p>\n"), F.lit('<sup class="reference">[1]</sup></p><p>Too short.</p></div></div><a href="/wiki/File:X.png">f</a>'),
        F.array_join(links, " "), F.lit("</body>"),
    )
    return docs.select(F.col("doc_id"), url.alias("url"), F.lit(200).alias("status"), F.lit("text/html; charset=UTF-8").alias("content_type"), html.alias("html"))


def extracted(spark, sf_dir):
    return extract(html_pages(spark, sf_dir), WIKI).select("doc_id", "title", "body")


def extracted_links(spark, sf_dir):
    return extract(html_pages(spark, sf_dir), WIKI).select("doc_id", F.posexplode("links").alias("place", "link"))


def extracted_links_escaped(spark, sf_dir):
    """Links that pages write with raw letters and spaces, and broken ones."""
    titles = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\p{L}\p{N}]+", " ").alias("t"))
    html = F.concat(F.lit('<a href="/wiki/'), "t", F.lit('">1</a><a href="'), "t", F.lit('#x">the same</a><a href="/wiki/'), "t", F.lit('%zz">2</a>'))
    pages = titles.select("doc_id", F.lit(f"{WIKI.root}P").alias("url"), html.alias("html"))
    return extract(pages, WIKI).select("doc_id", F.explode("links").alias("link"))


def page_search(spark, sf_dir):
    """Pages to text to index to ranked answer."""
    pages = extract(html_pages(spark, sf_dir), WIKI).select(F.col("doc_id").alias("ord"), "url", "title", "body")
    index = indexer.build_index(cut_lineage(pages))  # parsed once
    best = search(index, "castle of the northern kingdoms", 25)
    return best.select("doc_id", F.round("score", 6).alias("score"))


def faulty_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up web, every document in it; a seventh answers with a bad status or another content type."""
    status = F.when(F.col("doc_id") % 14 == 6, 404).otherwise(F.col("status"))
    kind = F.when(F.col("doc_id") % 14 == 13, "application/pdf").otherwise(F.col("content_type"))
    return html_pages(spark, sf_dir).withColumns({"status": status, "content_type": kind})


def _crawled(spark, sf_dir, **limits):
    return crawling.crawl(spark, faulty_web(spark, sf_dir), crawling.CrawlConfig(f"{WIKI.root}P1", max_depth=CRAWL_DEPTH, **limits))


def crawl_bfs(spark, sf_dir):
    return _crawled(spark, sf_dir, max_pages=CRAWL_PAGES).pages.select("ord", "url", "depth", F.col("err").isNull().alias("ok"))


def crawl_budget(spark, sf_dir):
    return _crawled(spark, sf_dir, max_total_bytes=CRAWL_BYTES).stats.select("scheduled", "successful", "failed", "total_bytes")


def frontier_first(spark, sf_dir):
    return crawling.first_seen(_table(spark, sf_dir, "frontier"))


def frontier_admitted(spark, sf_dir):
    queue = crawling.first_seen(_table(spark, sf_dir, "frontier"))
    return crawling.admitted(queue, CRAWL_PAGES, 2).select("url", "depth", "ord", "slot")


def frontier_unseen(spark, sf_dir):
    """Queued urls that no document has."""
    return crawling.unseen(_table(spark, sf_dir, "frontier"), _table(spark, sf_dir, "documents"))


def article_links(spark, sf_dir):
    rows = _table(spark, sf_dir, "frontier").select("ord", canonical_link(F.col("url"), LEXIPEDIA).alias("link"))
    return rows.filter(is_article(F.col("link"), LEXIPEDIA))


def crawl_durations(spark, sf_dir):
    runs = _table(spark, sf_dir, "crawl_stats")
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return runs.select("run_id", seconds.alias("seconds"), (F.col("successful") + F.col("failed") == F.col("scheduled")).alias("complete"))


def crawl_totals(spark, sf_dir):
    return _table(spark, sf_dir, "crawl_stats").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("scheduled").alias("scheduled"), F.sum("successful").alias("successful"),
        F.sum("failed").alias("failed"), F.sum("total_bytes").alias("total_bytes"), F.count(F.when(F.col("finished_at").isNull(), 1)).alias("unfinished"),
    )


def running_bytes(spark, sf_dir):
    """Runs in order of start as long as those before took less than a budget in all; counted within days, then over days."""
    runs = _table(spark, sf_dir, "crawl_stats").select("run_id", "total_bytes", F.to_date("started_at").alias("day"))
    days = runs.groupBy("day").agg(F.sum("total_bytes").alias("b"))
    before_day = F.coalesce(F.sum("b").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_run = F.coalesce(F.sum("total_bytes").over(Window.partitionBy("day").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("_in", before_run).join(days.select("day", before_day.alias("_days")), "day")
    return placed.select("run_id", (F.col("_in") + F.col("_days")).alias("before")).filter(F.col("before") < crawling.MAX_TOTAL_BYTES)


_QUERIES = (
    flagship, normalized, tokenized, stem_vocab, term_freq, doc_freq, doc_length, corpus_stats, index_stats, index_outcomes, index_counts,
    logged_outcomes, url_dedup, index_append, postings_lookup, index_lookups, candidates_or, idf_values, tf_norm_values, bm25_scores,
    bm25_topk, parsed_queries, batch_search, snippets, wrapped, index_roundtrip, extracted, extracted_links, extracted_links_escaped, page_search, crawl_bfs,
    crawl_budget, frontier_first, frontier_admitted, frontier_unseen, article_links, crawl_durations, crawl_totals, running_bytes,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}
