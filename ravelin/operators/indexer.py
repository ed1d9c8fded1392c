"""Building and extending an index: outcome of every arriving page, dense document ids, term frequencies, totals.

Pages have ``ord`` (unique, the order of arrival), ``url``, ``title``, ``body``. A url that owns many pages doesn't gather
them in one task: its first sound page is a partial aggregate, and where every page needs its outcome, that of hot urls is
broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import normalize_text, stem, trim_spaces
from ravelin.operators.skew import join_states
from ravelin.session import cut_lineage, written

ADDED, DUPLICATE, ERR_URL, ERR_BODY, ERR_TOKENS = "added", "duplicate", "err_url", "err_body", "err_tokens"
#: Ids are counted in blocks of about so many rows.
ID_BLOCK = 65_536


@dataclass(frozen=True)
class IndexTables:
    """``documents``, ``terms`` and the one-row ``stats`` of an index; ``weighted`` is ``terms`` with ``dl``, the length of the document.

    Of an index that isn't saved yet, ``numbered`` has ``doc_id``, ``url``, ``title``, ``body``, and ``before`` the totals it goes on from.
    """

    documents: DataFrame
    terms: DataFrame
    stats: DataFrame
    weighted: DataFrame | None = None
    numbered: DataFrame | None = None
    before: dict | None = None

    def postings(self) -> DataFrame:
        """``term``, ``doc_id``, ``freq``, ``dl``; built and saved indexes have it without a join."""
        if self.weighted is not None:
            return self.weighted
        return self.terms.join(self.documents.select("doc_id", F.col("length").alias("dl")), "doc_id").select("term", "doc_id", "freq", "dl")

    def totals(self) -> DataFrame:
        """One row: ``total_docs``, ``avg_doc_len``, from ``stats``; no document is looked at."""
        average = F.when(F.col("total_docs") > 0, F.col("total_doc_len").cast("double") / F.col("total_docs")).otherwise(F.lit(0.0))
        return self.stats.select("total_docs", average.alias("avg_doc_len"))


def dense_ids(rows: DataFrame, order: str, name: str, first: Column | int = 1) -> DataFrame:
    """Number the rows ``first``, ``first + 1``, ... by the unique integer column ``order``.

    Rows are numbered within blocks of equal ranges of ``order``, as wide as hold about ``ID_BLOCK`` rows; only the counts
    per block pass through one task, one for each ``ID_BLOCK`` rows, however sparse the values are. ``rows`` should be
    stored, as it is read several times.
    """
    seen = rows.agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count(F.lit(1)).alias("n")).first()
    width = max(ID_BLOCK, (seen["z"] - seen["a"]) * ID_BLOCK // seen["n"]) if seen["n"] else ID_BLOCK
    blocked = rows.withColumn("_block", F.expr(f"`{order}` div {width}L - IF(`{order}` < 0, 1L, 0L)"))
    sizes = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    start = first if isinstance(first, Column) else F.lit(first)
    numbered = blocked.withColumn("_place", place).join(offsets, "_block")
    return numbered.withColumn(name, (F.col("_before") + F.col("_place") - 1 + start).cast("long")).drop("_block", "_place", "_before")


def prepare(pages: DataFrame) -> DataFrame:
    """``ord`` and trimmed ``url``, ``title``, ``body``; null counts as empty."""
    trimmed = [F.coalesce(trim_spaces(F.col(c)), F.lit("")).alias(c) for c in ("url", "title", "body")]
    return pages.select(F.col("ord").cast("long").alias("ord"), *trimmed)


def _looked_at(pages: DataFrame) -> DataFrame:
    """``ord``, ``url`` and whether there is a body and a word in it. Bodies are read in the scan, none is shuffled."""
    has_words = F.col("body").rlike(r"[\p{L}\p{N}]")
    return prepare(pages).select("ord", "url", (F.col("body") != "").alias("_body"), has_words.alias("_words"))


def _added(looked: DataFrame, existing: DataFrame | None) -> DataFrame:
    sound = looked.filter((F.col("url") != "") & F.col("_body") & F.col("_words"))
    first = sound.groupBy("url").agg(F.min("ord").alias("ord"))
    return first if existing is None else first.join(existing.select("url"), "url", "left_anti")


def added_pages(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``url``, ``ord`` of the pages that are added: of each url the first with a body and a word, unless the index has it."""
    return _added(_looked_at(pages), existing)


def _decided(looked: DataFrame, known: DataFrame) -> DataFrame:
    """``looked`` with ``status`` and the columns of ``known``: ``url``, ``_first``, the place of the page that owns the url, and others."""
    status = (
        F.when(F.col("url") == "", ERR_URL)
        .when(~F.col("_body"), ERR_BODY)
        .when(F.col("_first") < F.col("ord"), DUPLICATE)
        .when(~F.col("_words"), ERR_TOKENS)
        .otherwise(ADDED)
    )
    return join_states(looked, known, "url", how="left").withColumn("status", status)


def outcomes(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``ord``, ``url``, ``status`` of each page; ``existing`` has the ``url`` of documents that are already indexed.

    In this order: an empty url or body is an error; a url that an earlier added page or the index has is a duplicate,
    whatever its body; a body without words is an error and leaves its url free; everything else is added. Bodies are read
    once; what they tell, two flags, is written to the checkpoint folder with the urls.
    """
    looked = written(_looked_at(pages))
    known = _added(looked, existing).select("url", F.col("ord").alias("_first"))
    if existing is not None:
        known = known.unionByName(existing.select("url", F.lit(-(2**63)).cast("long").alias("_first")).distinct())
    return _decided(looked, known).select("ord", "url", "status")


def outcome_ids(pages: DataFrame, existing: DataFrame | None = None, next_id: int = 1) -> DataFrame:
    """``ord``, ``url``, ``doc_id``, ``status``: the outcome of each page; a duplicate has the id of the document it repeats.

    ``existing`` has ``url`` and ``doc_id``, each url once.
    """
    looked = written(_looked_at(pages))
    added = written(_added(looked, existing))
    known = dense_ids(added, "ord", "doc_id", next_id).select("url", F.col("ord").alias("_first"), "doc_id")
    if existing is not None:
        known = known.unionByName(existing.select("url", F.lit(-(2**63)).cast("long").alias("_first"), "doc_id"))
    rows = _decided(looked, known)
    return rows.select("ord", "url", F.when(F.col("status").isin(ADDED, DUPLICATE), F.col("doc_id")).alias("doc_id"), "status")


def exploded_tokens(rows: DataFrame, key: str, norm: str = "norm") -> DataFrame:
    """``key``, ``pos``, ``term``: one row per stemmed word of the normalised text ``norm``, positions from 0."""
    words = rows.filter(F.col(norm) != "").select(key, F.posexplode(F.split(norm, " ")).alias("pos", "word"))
    return words.select(key, "pos", stem(F.col("word")).alias("term"))


def term_frequencies(rows: DataFrame, key: str = "doc_id", norm: str = "norm") -> DataFrame:
    """``term``, ``key``, ``freq``; partial counts are formed before the shuffle."""
    return exploded_tokens(rows, key, norm).groupBy("term", key).agg(F.count(F.lit(1)).alias("freq"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """``term``, ``df``."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def token_count(norm: Column) -> Column:
    """Words of a normalised text, without splitting it."""
    gaps = F.char_length(norm) - F.char_length(F.translate(norm, " ", ""))
    return F.when(norm == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def corpus_totals(documents: DataFrame) -> DataFrame:
    """One row: ``total_docs``, ``total_doc_len``, ``avg_doc_len`` (0 for an empty index)."""
    totals = documents.agg(F.count(F.lit(1)).alias("total_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_doc_len"))
    average = F.when(F.col("total_docs") > 0, F.col("total_doc_len").cast("double") / F.col("total_docs")).otherwise(F.lit(0.0))
    return totals.withColumn("avg_doc_len", average)


def build_index(pages: DataFrame) -> IndexTables:
    """The index of pages in order of arrival; document ids are dense from 1. Titles are stored, only bodies are indexed."""
    return _index_of(pages, added_pages(pages), 1)


def new_part(index: IndexTables, pages: DataFrame) -> IndexTables:
    """Documents and terms of the pages whose urls the index doesn't have, ids from ``next_doc_id``; ``stats`` are of both together."""
    old = index.stats.first().asDict()
    return _index_of(pages, added_pages(pages, index.documents), old["next_doc_id"], old)


def append(index: IndexTables, pages: DataFrame) -> IndexTables:
    """The index with further pages; urls that it has already are left out, ids go on from ``next_doc_id``."""
    new = new_part(index, pages)
    weighted = index.postings().unionByName(new.postings())
    return IndexTables(index.documents.unionByName(new.documents), weighted.drop("dl"), new.stats, weighted)


def stats_of(documents: DataFrame, before: dict | None = None) -> DataFrame:
    """One row: the totals of ``documents`` and of those in ``before`` together."""
    old = before or {"total_docs": 0, "total_doc_len": 0, "next_doc_id": 1}
    return documents.agg(
        F.lit(1).alias("id"),
        (F.count(F.lit(1)) + F.lit(old["total_docs"])).cast("long").alias("total_docs"),
        (F.coalesce(F.sum("length"), F.lit(0)) + F.lit(old["total_doc_len"])).cast("long").alias("total_doc_len"),
        F.greatest(F.coalesce(F.max("doc_id"), F.lit(0)) + 1, F.lit(old["next_doc_id"])).cast("long").alias("next_doc_id"),
    )


def documents_of(numbered: DataFrame) -> DataFrame:
    """The ``documents`` table of texts that have their ids."""
    length = token_count(normalize_text(F.col("body")))
    return numbered.select("doc_id", "url", "title", "body", length.alias("length"), F.current_timestamp().alias("created_at"))


def _index_of(pages: DataFrame, added: DataFrame, next_id: int, before: dict | None = None) -> IndexTables:
    """Texts meet their ids in one join by ``ord``, the only place where they are shuffled.

    The ids, 16 bytes a document, are written to the checkpoint folder first, as all three tables begin with them. Words are
    counted where that join leaves the texts; where ids are few enough to be broadcast, where the pages are placed by ``ord``.
    """
    ids = cut_lineage(dense_ids(written(added.select("ord")), "ord", "doc_id", next_id))
    numbered = prepare(pages).join(ids, "ord")
    documents = documents_of(numbered)
    normal = numbered.select("ord", "doc_id", normalize_text(F.col("body")).alias("norm"))
    counted = normal.select("ord", "doc_id", "norm", token_count(F.col("norm")).alias("dl"))  # before the words part, so once per text; each has a word
    words = counted.select("ord", "doc_id", "dl", F.explode(F.split("norm", " ")).alias("word"))
    terms = words.select("ord", "doc_id", "dl", stem(F.col("word")).alias("term"))
    weighted = terms.groupBy("term", "ord", "doc_id", "dl").agg(F.count(F.lit(1)).alias("freq")).select("term", "doc_id", "freq", "dl")
    return IndexTables(documents, weighted.drop("dl"), stats_of(documents, before), weighted, numbered.drop("ord"), before)


def index_counts(outcome: DataFrame) -> DataFrame:
    """``status``, ``pages``."""
    return outcome.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))
