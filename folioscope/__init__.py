"""Spark-first engine for documentation corpora: crawl, split, index, search and publish as DataFrame plans."""
