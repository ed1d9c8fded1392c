"""SQL for the queries over the index, the crawl and the output functions."""

from __future__ import annotations

from ravelin.functions.formatting import SNIPPET_BYTES
from ravelin.operators.crawl import MAX_TOTAL_BYTES
from ravelin.plans import search_queries as q


def _trim(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '^\\s+|\\s+$', '', 'g')"


def _norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _undouble(stem: str) -> str:
    return f"CASE WHEN length({stem}) > 1 AND {stem}[-1] = {stem}[-2] AND strlen({stem}[-1]) = 1 THEN {stem}[:-2] ELSE {stem} END"


def _stem(w: str) -> str:
    return f"""CASE WHEN strlen({w}) <= 3 THEN {w}
  WHEN {w} LIKE '%ing' AND strlen({w}) > 6 THEN {_undouble(f"({w}[:-4])")}
  WHEN {w} LIKE '%ed' AND strlen({w}) > 5 THEN {_undouble(f"({w}[:-3])")}
  WHEN {w} LIKE '%ies' AND strlen({w}) > 4 THEN {w}[:-4] || 'y'
  WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND strlen({w}) > 4 THEN {w}[:-2] ELSE {w} END"""


#: Arrivals, their outcome, ids, tokens and the three tables, each built on the one before.
_PAGES = f"""pages AS (
  SELECT doc_id AS ord, {_trim("url")} AS url, {_trim("title")} AS title, {_trim("body")} AS body, {_norm("coalesce(body, '')")} AS norm FROM documents),
firsts AS (SELECT url, min(ord) AS first FROM pages WHERE url <> '' AND body <> '' AND norm <> '' GROUP BY url),
outcome AS (
  SELECT p.*, CASE WHEN p.url = '' THEN 'err_url' WHEN body = '' THEN 'err_body' WHEN first < ord THEN 'duplicate'
    WHEN norm = '' THEN 'err_tokens' ELSE 'added' END AS status
  FROM pages p LEFT JOIN firsts USING (url)),
docs AS (
  SELECT row_number() OVER (ORDER BY ord) AS doc_id, url, title, body, norm, len(string_split(norm, ' ')) AS length
  FROM outcome WHERE status = 'added')"""
_TERMS = f"""{_PAGES},
words AS (SELECT doc_id, unnest(string_split(norm, ' ')) AS w FROM docs),
terms_ AS (SELECT {_stem("w")} AS term, doc_id, count(*) AS freq FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM terms_ GROUP BY term),
totals AS (SELECT count(*) AS n, coalesce(sum(length), 0)::BIGINT AS total, CASE WHEN count(*) > 0 THEN sum(length)::DOUBLE / count(*) ELSE 0 END AS avg FROM docs)"""
_IDF = "ln(1.0::DOUBLE + ((n - df)::DOUBLE + 0.5) / (df::DOUBLE + 0.5))"
_TF_NORM = "(freq::DOUBLE * (1.2::DOUBLE + 1)) / (freq::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length::DOUBLE / avg)))"


def _scores(terms: list[str]) -> str:
    asked = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""{_TERMS}, asked(pos, term) AS (VALUES {asked}),
scores AS (
  SELECT doc_id, sum({_IDF} * {_TF_NORM} ORDER BY pos) AS score
  FROM terms_ JOIN asked USING (term) JOIN df USING (term) JOIN docs USING (doc_id), totals GROUP BY doc_id)"""


def _best(terms: list[str], k: int) -> str:
    return f"{_scores(terms)} SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY round(score, 9) DESC, doc_id LIMIT {k}"


_COLLAPSED = "trim(regexp_replace(coalesce(body, ''), '[\\s\\v\\x{85}\\p{Z}]+', ' ', 'g'))"


def _snippet(size: int) -> str:
    return f"""SELECT doc_id, CASE WHEN strlen(t) <= {size} THEN t ELSE left(t, n) || CASE WHEN strlen(left(t, n)) < {size} THEN chr(65533) ELSE '' END || '...' END AS snippet
FROM (SELECT doc_id, t, list_max(list_filter(range(0, {size} + 1), lambda i: strlen(left(t, i)) <= {size})) AS n
      FROM (SELECT doc_id, {_COLLAPSED} AS t FROM documents))"""


_LINES = f"""w AS (SELECT doc_id, string_split(snippet, ' ') AS w FROM s),
l AS (SELECT doc_id, list_reduce(w, lambda a, x: CASE WHEN strlen(regexp_extract(a, '[^\\n]*$')) + 1 + strlen(x) > {q.WRAP}
  THEN a || chr(10) || x ELSE a || ' ' || x END) AS wrapped FROM w)"""

_QUERY = f"""parsed AS (
  SELECT qid, {_trim("raw")} AS raw, list_filter(string_split({_norm("coalesce(raw, '')")}, ' '), lambda w: w <> '') AS words FROM search_query),
stemmed AS (SELECT qid, i, {_stem("w")} AS term FROM (SELECT qid, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM parsed)),
firsts_q AS (SELECT qid, term, min(i) AS i FROM stemmed GROUP BY ALL),
listed AS (SELECT qid, list(term ORDER BY i) AS terms FROM firsts_q GROUP BY qid),
checked AS (
  SELECT qid, terms, CASE WHEN raw = '' THEN 'empty' WHEN strlen(raw) > 4096 THEN 'too_long' WHEN terms IS NULL THEN 'empty'
    WHEN len(terms) > 64 THEN 'too_many_terms' ELSE 'ok' END AS status
  FROM parsed LEFT JOIN listed USING (qid))"""

#: The made-up web as text, for its sizes; paragraphs escaped as in the pages.
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_HTML = f"""web AS (
  SELECT doc_id, '{q.WIKI.root}P' || doc_id AS url,
    '<html><head><title> ' || {_ESC.format("coalesce(title, '')")} || chr(10) || ' </title><script>var t=''</p>'';</script></head><body>' ||
    '<div id="mw-content-text"><div class="mw-parser-output"><table class="infobox"><tr><td><p>Not part of the article, however long it is.</table>' ||
    array_to_string(list_transform(string_split(coalesce(body, ''), chr(10) || chr(10)), lambda p: '<p>' || {_ESC.format("p")}), '</p>' || chr(10)) ||
    '<sup class="reference">[1]</sup></p><p>Too short.</p></div></div><a href="/wiki/File:X.png">f</a>' ||
    array_to_string(list_transform(range({q.FAN_OUT} * doc_id - {q.FAN_OUT - 2}, {q.FAN_OUT} * doc_id + 2), lambda n: '<a href="/wiki/P' || n || '?x=1#top">next</a>'), ' ') || '</body>' AS html
  FROM documents)"""
#: The crawl of a tree in which page n links to the FAN_OUT pages below it, missing pages not followed.
_TREE = f"""RECURSIVE tree(n, depth) AS (
  SELECT 1::BIGINT, 0 UNION ALL
  SELECT unnest(range({q.FAN_OUT} * n - {q.FAN_OUT - 2}, {q.FAN_OUT} * n + 2)), depth + 1 FROM tree JOIN documents ON doc_id = n WHERE n % 7 <> 6 AND depth < {q.CRAWL_DEPTH}),
queue AS (SELECT row_number() OVER (ORDER BY depth, n) - 1 AS ord, n, depth FROM tree)"""
#: What the extraction gives for these pages: paragraphs of 40 characters or more, else the whole text of the article.
_SPACES = "'[\\s\\v\\x{85}\\p{Z}]+'"
_TEXT = f"""paragraphs AS (
  SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i
  FROM (SELECT doc_id, string_split(coalesce(body, ''), chr(10) || chr(10)) AS ps FROM documents)),
cleaned AS (SELECT doc_id, i, p, trim(regexp_replace(p, {_SPACES}, ' ', 'g')) AS c FROM paragraphs),
kept AS (SELECT doc_id, string_agg(c, chr(10) || chr(10) ORDER BY i) AS text FROM cleaned WHERE length(c) >= 40 GROUP BY doc_id),
whole AS (
  SELECT doc_id, trim(regexp_replace(string_agg(p, chr(10) ORDER BY i) || 'Too short.', {_SPACES}, ' ', 'g')) AS text
  FROM paragraphs GROUP BY doc_id),
texts AS (
  SELECT doc_id, trim(regexp_replace(coalesce(title, ''), {_SPACES}, ' ', 'g')) AS title, coalesce(k.text, w.text) AS body
  FROM documents LEFT JOIN kept k USING (doc_id) JOIN whole w USING (doc_id))"""

def oracle_sql() -> dict[str, str]:
    flagship = ["the", "southern", "river", "of", "old", "kingdom"]
    castle = ["castle", "of", "the", "northern", "kingdom"]
    return {
        "flagship": f"""{_with(_scores(flagship))},
best AS (SELECT doc_id, score FROM scores ORDER BY round(score, 9) DESC, doc_id LIMIT 10),
cut AS ({_snippet(SNIPPET_BYTES).replace("FROM documents", "FROM docs JOIN best USING (doc_id)")})
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score, title, url, snippet
FROM best JOIN docs USING (doc_id) JOIN cut USING (doc_id)""",
        "normalized": f"SELECT doc_id, {_norm('body')} AS norm FROM documents",
        "tokenized": f"""SELECT doc_id, pos, {_stem("w")} AS term FROM (
  SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws)))::INT AS pos FROM (
    SELECT doc_id, string_split({_norm("body")}, ' ') AS ws FROM documents WHERE {_norm("body")} <> ''))""",
        "stem_vocab": f"""SELECT w AS word, {_stem("w")} AS stem FROM (
  SELECT DISTINCT unnest(string_split({_norm("body")}, ' ')) AS w FROM documents) WHERE w <> ''""",
        "term_freq": f"WITH {_TERMS} SELECT term, doc_id, freq FROM terms_",
        "doc_freq": f"WITH {_TERMS} SELECT term, df FROM df",
        "doc_length": f"WITH {_PAGES} SELECT doc_id, length FROM docs",
        "corpus_stats": f"WITH {_TERMS} SELECT n AS total_docs, total AS total_doc_len, avg AS avg_doc_len FROM totals",
        "index_stats": f"WITH {_TERMS} SELECT 1 AS id, n AS total_docs, total AS total_doc_len, n + 1 AS next_doc_id FROM totals",
        "index_outcomes": f"""WITH {_PAGES} SELECT ord, o.url, CASE WHEN status IN ('added', 'duplicate') THEN d.doc_id END AS doc_id, status
FROM outcome o LEFT JOIN docs d ON d.url = o.url""",
        "index_counts": f"WITH {_PAGES} SELECT status, count(*) AS pages FROM outcome GROUP BY status",
        "logged_outcomes": "SELECT status, count(*) AS pages FROM index_outcome GROUP BY status",
        "url_dedup": f"WITH {_PAGES} SELECT doc_id, url, title FROM docs",
        "index_append": f"""WITH {_PAGES.replace("SELECT doc_id AS ord", "SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 1000000000 ELSE 0 END AS ord")}
SELECT doc_id, url, length FROM docs""",
        "postings_lookup": f"WITH {_TERMS} SELECT doc_id, freq FROM terms_ WHERE term = 'river'",
        "index_lookups": f"""WITH {_TERMS}
SELECT 'df river' AS what, count(*) AS value FROM terms_ WHERE term = 'river'
UNION ALL SELECT 'df zzzz', count(*) FROM terms_ WHERE term = 'zzzz'
UNION ALL SELECT 'tf the 2', coalesce(sum(freq), 0)::BIGINT FROM terms_ WHERE term = 'the' AND doc_id = 2
UNION ALL SELECT 'length 2', coalesce(max(length), 0) FROM docs WHERE doc_id = 2
UNION ALL SELECT 'length -1', 0 UNION ALL SELECT 'document 2', count(*) FROM docs WHERE doc_id = 2""",
        "candidates_or": f"WITH {_TERMS} SELECT DISTINCT doc_id FROM terms_ WHERE term IN ('river', 'kingdom', 'zzzz')",
        "idf_values": f"WITH {_TERMS} SELECT term, round({_IDF}, 6) AS idf FROM df, totals",
        "tf_norm_values": f"WITH {_TERMS} SELECT term, doc_id, round({_TF_NORM}, 6) AS tf_norm FROM terms_ JOIN docs USING (doc_id), totals",
        "bm25_scores": f"WITH {_scores(['river', 'the', 'kingdom', 'castle'])} SELECT doc_id, round(score, 6) AS score FROM scores",
        "bm25_topk": f"WITH {_best(castle, 25)}",
        "parsed_queries": f"WITH {_QUERY} SELECT qid, status, CASE WHEN status = 'ok' THEN array_to_string(terms, ' ') END AS terms FROM checked",
        "batch_search": f"""WITH {_TERMS}, {_QUERY},
asked AS (SELECT qid, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM checked WHERE status = 'ok'),
scores AS (
  SELECT qid, doc_id, sum({_IDF} * {_TF_NORM} ORDER BY pos) AS score
  FROM terms_ JOIN asked USING (term) JOIN df USING (term) JOIN docs USING (doc_id), totals GROUP BY ALL)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)::INT AS rank, doc_id, round(score, 6) AS score
FROM scores QUALIFY rank <= 10""",
        "snippets": _snippet(SNIPPET_BYTES),
        "wrapped": f"""WITH s AS ({_snippet(SNIPPET_BYTES)}), {_LINES}, p AS (SELECT doc_id, wrapped, string_split(wrapped, chr(10)) AS ls FROM l)
SELECT doc_id, wrapped, CASE WHEN len(ls) <= {q.LINES} THEN wrapped
  ELSE array_to_string(list_append(ls[: {q.LINES - 1}], trim(ls[{q.LINES}]) || '...'), chr(10)) END AS cut FROM p""",
        "index_roundtrip": f"WITH {_TERMS} SELECT term, doc_id, freq FROM terms_",
        "extracted": f"WITH {_TEXT} SELECT doc_id, title, body FROM texts",
        "page_search": f"WITH {_TEXT}, {_best(castle, 25).replace('FROM documents)', 'FROM page_texts)', 1)}".replace(
            ", pages AS (", f", page_texts AS (SELECT doc_id, '{q.WIKI.root}P' || doc_id AS url, title, body FROM texts), pages AS (", 1
        ),
        "extracted_links": f"""SELECT doc_id, place::INT AS place, '{q.WIKI.root}P' || ({q.FAN_OUT} * doc_id - {q.FAN_OUT - 2} + place) AS link
FROM documents, range({q.FAN_OUT}) r(place)""",
        "extracted_links_escaped": f"""SELECT doc_id, '{q.WIKI.root}' || CASE WHEN t = '' THEN 'P' ELSE url_encode(t) END AS link FROM (
  SELECT doc_id, regexp_replace(coalesce(title, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS t FROM documents)""",
        "crawl_bfs": f"""WITH {_TREE} SELECT ord, '{q.WIKI.root}P' || n AS url, depth, (n % 7 <> 6 AND doc_id IS NOT NULL) AS ok
FROM queue LEFT JOIN documents ON doc_id = n WHERE ord < {q.CRAWL_PAGES}""",
        "crawl_budget": f"""WITH {_TREE}, {_HTML}, got AS (
  SELECT ord, CASE WHEN n % 7 <> 6 THEN strlen(html) END AS bytes FROM queue LEFT JOIN web ON doc_id = n),
cut AS (SELECT bytes, coalesce(sum(bytes) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, ord FROM got)
SELECT count(*) AS scheduled, count(bytes) AS successful, count(*) - count(bytes) AS failed, coalesce(sum(bytes), 0)::BIGINT AS total_bytes
FROM cut WHERE before < {q.CRAWL_BYTES} AND ord < 50""",
        "frontier_first": "SELECT url, depth, ord FROM frontier WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1",
        "frontier_admitted": f"""WITH f AS (SELECT url, depth, ord FROM frontier WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)
SELECT url, depth, ord, row_number() OVER (ORDER BY ord)::INT AS slot FROM f WHERE depth <= 2 QUALIFY slot <= {q.CRAWL_PAGES}""",
        "frontier_unseen": """WITH f AS (SELECT url, depth, ord FROM frontier WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)
SELECT url, depth, ord FROM f WHERE url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL)""",
        "article_links": f"""WITH l AS (SELECT ord, regexp_replace(trim(url), '[?#].*$', '') AS link FROM frontier)
SELECT ord, link FROM (SELECT ord, link, substr(link, {len(q.LEXIPEDIA.root) + 1}) AS title FROM l WHERE starts_with(link, '{q.LEXIPEDIA.root}'))
WHERE title NOT IN ('', 'Main_Page') AND title NOT LIKE '%:%' AND lower(title) NOT LIKE '%(disambiguation)%'""",
        "crawl_durations": """SELECT run_id, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6::DOUBLE AS seconds, successful + failed = scheduled AS complete
FROM crawl_stats""",
        "crawl_totals": """SELECT count(*) AS runs, sum(scheduled)::BIGINT AS scheduled, sum(successful)::BIGINT AS successful, sum(failed)::BIGINT AS failed,
  sum(total_bytes)::BIGINT AS total_bytes, count(*) FILTER (WHERE finished_at IS NULL) AS unfinished FROM crawl_stats""",
        "running_bytes": f"""SELECT run_id, before FROM (
  SELECT run_id, coalesce(sum(total_bytes) OVER (ORDER BY CAST(started_at AT TIME ZONE 'UTC' AS DATE), run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM crawl_stats) WHERE before < {MAX_TOTAL_BYTES}""",
    }


def _with(sql: str) -> str:
    return f"WITH {sql}"
