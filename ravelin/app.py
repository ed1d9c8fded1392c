"""The search application: one request against one index, and the rebuild when nothing is found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.ranking import B, K1
from ravelin.operators.indexer import IndexTables
from ravelin.operators.parsing import EmptyQuery, EngineInit, InvalidTopK, parse_query
from ravelin.operators.retrieval import bm25_scores, enrich, top_k

DEFAULT_K = 10
#: So many best ids come to the driver to filter the scan of documents; more are joined.
MOST_COLLECTED = 1_000


def search(index: IndexTables | None, raw: str, k: int = DEFAULT_K, k1: float = K1, b: float = B) -> DataFrame:
    """``doc_id``, ``score``: the ``k`` best documents for a raw query."""
    if index is None:
        raise EngineInit("there is no index")
    if k <= 0:
        raise InvalidTopK("k must be positive")
    return top_k(bm25_scores(index, parse_query(raw).terms, k1, b), k)


class SearchApp:
    """Answers requests over an index with titles, addresses and snippets."""

    def __init__(self, index: IndexTables | None):
        self.index = index

    def run(self, query: str, top_k: int = DEFAULT_K) -> DataFrame:
        """``rank``, ``doc_id``, ``score``, ``title``, ``url``, ``snippet``, best first.

        The request is checked in this order: index, empty query, ``top_k``, then the query itself. Up to ``MOST_COLLECTED``
        ids come to the driver, so that the scan of the documents is filtered by them; more are joined with the documents.
        """
        if self.index is None:
            raise EngineInit("there is no index")
        if not query.strip():
            raise EmptyQuery("the query is empty")
        if top_k <= 0:
            raise InvalidTopK("top_k must be positive")
        documents = self.index.documents
        if top_k > MOST_COLLECTED:
            return enrich(search(self.index, query, top_k), documents, few=False)
        best = [(r["doc_id"], r["score"]) for r in search(self.index, query, top_k).collect()]
        rows = documents.sparkSession.createDataFrame(best, "doc_id long, score double")
        return enrich(rows, documents.filter(F.col("doc_id").isin([d for d, _ in best])))


def search_with_fallback(index: IndexTables | None, query: str, top_k: int, rebuild: Callable[[str], IndexTables]) -> tuple[list, IndexTables | None]:
    """Rows of the answer and the index they come from. Without any hit the index is rebuilt for the query, once.

    ``top_k`` rows are collected at most.
    """
    rows = SearchApp(index).run(query, top_k).collect()
    if rows:
        return rows, index
    fresh = rebuild(query)
    return SearchApp(fresh).run(query, top_k).collect(), fresh
