"""SQL that checks this package's queries on whole tables."""

from __future__ import annotations

_MERGED = """merged AS (
  SELECT term, doc_id, sum(freq)::BIGINT AS tf
  FROM (SELECT lower(trim(term, chr(32) || chr(9))) AS term, doc_id, seg, max(coalesce(freq, 0)) AS freq FROM terms
        WHERE doc_id IS NOT NULL GROUP BY ALL)
  WHERE term <> '' GROUP BY term, doc_id)"""
_COUNTS = f"""WITH {_MERGED}, counts AS (
  SELECT term, sum(tf)::BIGINT AS occurrences, count(*)::BIGINT AS docs FROM merged GROUP BY term),
marked AS (
  SELECT *, CASE WHEN docs <= 2 THEN 'rare'
    WHEN docs * 100 >= (SELECT count(*) FROM documents) * 55 THEN 'common' END AS mark FROM counts)"""

_GRAMS = """grams AS (
  SELECT DISTINCT id, list_aggregate(w[i : i + 11], 'string_agg', ' ') AS gram
  FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM (
    SELECT id, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w FROM %s)))"""

_SHINGLES = """w AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS w
  FROM (SELECT doc_id, body %s) WHERE body IS NOT NULL),
s AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""
_SIMILAR = """both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 100 >= (x.n + y.n - c) * 70)"""

_PLACED_GRAMS = _GRAMS.replace("SELECT DISTINCT id, ", "SELECT id, i, ")


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_COUNTS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p1_term_counts": f"{_COUNTS} SELECT term, occurrences, docs, mark FROM marked",
        "p2_found": f"""WITH {_MERGED}, df AS (SELECT term, count(*) AS df FROM merged GROUP BY term),
lengths AS (SELECT doc_id, max(coalesce(length, 0)) AS length FROM documents GROUP BY doc_id)
SELECT doc_id, term FROM merged JOIN df USING (term) JOIN lengths USING (doc_id)
WHERE df BETWEEN 2 AND 10 AND tf >= 3 AND tf * 100 >= length * 2""",
        "p2_weights": f"""WITH {_MERGED}, words AS (SELECT greatest(coalesce(sum(length), 1), 1) AS words FROM documents),
stats AS (SELECT term, count(*)::BIGINT AS df, least(1.0::DOUBLE, sum(tf)::DOUBLE / (SELECT words FROM words)) AS bg FROM merged GROUP BY term),
lengths AS (SELECT doc_id, max(coalesce(length, 0)) AS length FROM documents GROUP BY doc_id),
r AS (SELECT doc_id, term, tf, df, bg, row_number() OVER (PARTITION BY doc_id ORDER BY tf / bg DESC, term) AS i FROM merged JOIN stats USING (term)),
-- the limit of expectation-maximisation: the k terms with the largest tf / bg have mass, for the largest k whose last term still gets some
c AS (SELECT *, (1 + 9 * sum(bg) OVER w) / sum(tf) OVER w AS c FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, max(i) AS k, max_by(c, i) AS c FROM c WHERE tf * c > 9 * bg GROUP BY doc_id),
p AS (SELECT r.doc_id, term, tf, df, CASE WHEN i <= k THEN tf * c - 9 * bg ELSE 0 END AS weight FROM r JOIN k USING (doc_id))
SELECT doc_id, term, tf, df, length, round(weight, 6) AS weight FROM p LEFT JOIN lengths USING (doc_id)""",
        "p4_found": f"""WITH {_SHINGLES % "FROM documents"}, {_SIMILAR}
SELECT a AS doc_id_a, b AS doc_id_b FROM links""",
        "p4_classes": f"""WITH texts AS (
  SELECT doc_id, trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM documents WHERE body IS NOT NULL),
members AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS class_id, count(*) OVER (PARTITION BY norm) AS copies
  FROM texts WHERE len(string_split(norm, ' ')) >= 20),
{_SHINGLES % "FROM documents WHERE doc_id IN (SELECT class_id FROM members)"}, {_SIMILAR},
degree AS (SELECT rep, count(*) AS n FROM (SELECT a AS rep FROM links UNION ALL SELECT b FROM links) GROUP BY rep)
SELECT doc_id, class_id, copies, coalesce(n, 0)::BIGINT AS links FROM members LEFT JOIN degree ON rep = class_id""",
        "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_found": f"""WITH d AS (SELECT doc_id AS id, text FROM documents), e AS (SELECT item_id AS id, text FROM eval_items),
dg AS (WITH {_GRAMS % "d"} SELECT * FROM grams), eg AS (WITH {_GRAMS % "e"} SELECT * FROM grams)
SELECT DISTINCT dg.id AS doc_id, eg.id AS item_id FROM dg JOIN eg USING (gram)""",
        "p7_spans": f"""WITH blank AS (
  SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' ') AS ws FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM blank),
placed AS (SELECT doc_id, w, place, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY place) - length(w) - 1 AS first FROM pieces),
words AS (SELECT doc_id, first, first + length(w) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM placed WHERE w <> ''),
d AS (SELECT doc_id AS id, text FROM documents), e AS (SELECT item_id AS id, text FROM eval_items),
dg AS (WITH {_PLACED_GRAMS % "d"} SELECT * FROM grams), eg AS (WITH {_PLACED_GRAMS % "e"} SELECT * FROM grams),
met AS (SELECT DISTINCT dg.id AS doc_id, eg.id AS item_id, dg.i, dg.i - eg.i AS shift FROM dg JOIN eg USING (gram)),
runs AS (
  SELECT doc_id, item_id, min(i) AS a, max(i) + 11 AS z FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS run FROM met) GROUP BY doc_id, item_id, shift, run)
SELECT DISTINCT doc_id, item_id, x.first::BIGINT AS "begin", y.last::BIGINT AS "end", (z - a + 1)::BIGINT AS words
FROM runs JOIN words x USING (doc_id) JOIN words y USING (doc_id) WHERE x.i = a AND y.i = z""",
    }
