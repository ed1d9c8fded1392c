"""Relational operators of the index: postings, building, retrieval, ranking, crawling and skew-safe aggregation."""
