"""Corpus and citation-graph analytics on Spark."""
