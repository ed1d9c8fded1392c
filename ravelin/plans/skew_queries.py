"""Queries over keys of which a few own most rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import canonical_term, words
from ravelin.operators.postings import clean_postings, merge_blocks
from ravelin.operators.skew import eager_join_aggregate, top_records, top_records_of_hot_keys

#: A term is a hot key from this share of the stored rows on, in per cent.
HOT_PERCENT = 2
TOP_DOCUMENTS = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_postings(terms: DataFrame) -> DataFrame:
    """Every stored row, with the term in canonical form; nothing filtered, so that shares are of all rows."""
    return terms.select(canonical_term(F.col("term")).alias("term"), "doc_id", "seg", "freq")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_postings(_table(spark, sf_dir, "terms"))
    best = top_records_of_hot_keys(stored, lambda rows: merge_blocks(clean_postings(rows)), "term", "doc_id", "tf", TOP_DOCUMENTS, HOT_PERCENT)
    return best.select("term", "doc_id")


def p3_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every term of the index."""
    states = merge_blocks(clean_postings(_table(spark, sf_dir, "terms")))
    return top_records(states, "term", "doc_id", "tf", TOP_DOCUMENTS).select("term", "doc_id", "tf", "rank")


def p3_query_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings and occurrences that the logged queries touch, by word: a join of two skewed inputs, aggregated eagerly."""
    queries = _table(spark, sf_dir, "search_query")
    asked = queries.select("qid", F.explode(words(F.col("raw"))).alias("term"))
    postings = clean_postings(_table(spark, sf_dir, "terms"))
    return eager_join_aggregate(asked, postings, "term", {"qid_sum": "qid"}, {"freq_sum": "freq"})


def queries() -> dict:
    return {"p3_found": p3_found, "p3_top_documents": p3_top_documents, "p3_query_load": p3_query_load}


#: Terms as stored, in canonical form.
_STORED = """stored AS (
  SELECT lower(trim(term, chr(32) || chr(9))) AS term, doc_id, seg, freq FROM terms)"""
_MERGED = """merged AS (
  SELECT term, doc_id, sum(freq)::BIGINT AS tf
  FROM (SELECT term, doc_id, seg, max(coalesce(freq, 0)) AS freq FROM stored
        WHERE term <> '' AND doc_id IS NOT NULL GROUP BY term, doc_id, seg)
  GROUP BY term, doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH {_STORED}, {_MERGED}, hot AS (
  SELECT term FROM stored WHERE term <> '' GROUP BY term
  HAVING count(*) * 100 >= (SELECT count(*) FROM stored) * {HOT_PERCENT})
SELECT term, doc_id FROM merged JOIN hot USING (term)
QUALIFY row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) <= {TOP_DOCUMENTS}""",
        "p3_top_documents": f"""WITH {_STORED}, {_MERGED}
SELECT term, doc_id, tf, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id)::INT AS rank
FROM merged QUALIFY rank <= {TOP_DOCUMENTS}""",
        "p3_query_load": f"""WITH {_STORED}, asked AS (
  SELECT qid, unnest(string_split(trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS term
  FROM search_query),
l AS (SELECT term, qid FROM asked WHERE term <> '')
SELECT l.term, count(*)::BIGINT AS pairs, sum(l.qid)::BIGINT AS qid_sum, sum(coalesce(s.freq, 0))::BIGINT AS freq_sum
FROM l JOIN stored s ON s.term = l.term AND s.doc_id IS NOT NULL GROUP BY l.term""",
    }
