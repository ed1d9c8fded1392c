"""Column functions: text, urls, ranking arithmetic and output formatting."""
