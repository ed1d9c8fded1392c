"""ravelin: a Spark-native crawl, indexing and ranked-search engine."""

__version__ = "0.1.0"
